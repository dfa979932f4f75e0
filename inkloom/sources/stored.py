"""Stored tables that change together: every change is a new version, and a version is its manifest.

A store is a folder. Its tables have a column book_id and lie in BUCKETS buckets by its hash, a folder for each bucket that has been written. A change writes new folders for the buckets that it touches and last a manifest that names,
for every table, the folders of all its buckets; until the manifest is there, readers see the version before, so a job that is lost in between leaves no trace but unused folders. The manifest is put in place by a rename that fails
where the name is taken: of two changes that began with the same version one is refused. Deleted books are a tombstone: a small table of ids and the version from which it holds; it hides their rows in buckets written before, and goes
into effect in the files when a bucket is written again.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkloom.functions.keys import edge_key, graph_key
from inkloom.functions.text import name_key
from inkloom.operators import graph, sync
from inkloom.operators.components import written

BUCKETS = 32
UNIT = "book_id"


class Conflict(RuntimeError):
    """Another change has made the next version."""


def bucket(unit: Column | str = UNIT) -> Column:
    return F.pmod(F.xxhash64(unit), F.lit(BUCKETS)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._fs.Path("/".join([self.root, *parts]))

    def version(self) -> int:
        """The number of the last version; 0 for a store without any."""
        folder = self._path("manifest")
        files = folder.getFileSystem(self._conf)
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "tables": {}, "tombstones": []}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/manifest/{version:09d}.json").collect()))

    def _publish(self, manifest: dict) -> None:
        """Puts a manifest in place, at once and only if its version isn't there yet."""
        own, name = self._path("manifest", f".{uuid.uuid4().hex}"), self._path("manifest", f"{manifest['version']:09d}.json")
        out = own.getFileSystem(self._conf).create(own)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        try:
            context = self._fs.FileContext.getFileContext(name.toUri() if name.toUri().getScheme() else own.getFileSystem(self._conf).getUri(), self._conf)
            none = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
            context.rename(own, name, none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            raise Conflict(f"version {manifest['version']} is there already") from e

    def read(self, table: str, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """A table as of a version (the last by default), of all buckets or of some; None for a table that isn't there."""
        return self._read(self.manifest(version), table, only)

    def _read(self, manifest: dict, table: str, only: list[int] | None = None) -> DataFrame | None:
        entry = manifest["tables"].get(table)
        if entry is None:
            return None
        schema = StructType.fromJson(entry["schema"])
        chosen = [b for n, b in entry["buckets"].items() if only is None or int(n) in only]
        parts = []
        for v in sorted({b["version"] for b in chosen}):
            rows = self.spark.read.schema(schema).parquet(*[b["path"] for b in chosen if b["version"] == v])
            gone = [self.spark.read.parquet(t["path"]) for t in manifest["tombstones"] if t["version"] > v]
            parts.append(rows.join(reduce(DataFrame.unionByName, gone).distinct(), UNIT, "left_anti").select(*rows.columns) if gone else rows)
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def begin(self) -> Change:
        return Change(self)

    def expire(self, keep: int = 2) -> int:
        """Removes the folders that none of the last `keep` versions names, and older manifests; how many folders went. No change may be under way."""
        last = self.version()
        kept = [self.manifest(v) for v in range(max(1, last - keep + 1), last + 1)]
        named = {"/".join(b["path"].split("/")[:-1]) for m in kept for t in m["tables"].values() for b in t["buckets"].values()} | {t["path"] for m in kept for t in m["tombstones"]}
        data, gone = self._path("data"), 0
        files = data.getFileSystem(self._conf)
        for f in files.listStatus(data) if files.exists(data) else []:
            if f"{self.root}/data/{f.getPath().getName()}" not in named:
                gone += files.delete(f.getPath(), True)
        for v in range(1, last - keep + 1):
            files.delete(self._path("manifest", f"{v:09d}.json"), False)
        return gone


class Change:
    """What the next version has in place of the last. Nothing of it is seen before commit()."""

    def __init__(self, store: Store) -> None:
        self.store, self.next = store, store.manifest()
        self.next["version"] += 1

    def read(self, table: str, only: list[int] | None = None) -> DataFrame | None:
        """A table with what this change has done to it."""
        return self.store._read(self.next, table, only)

    def _put(self, table: str, rows: DataFrame, touched: list[int]) -> None:
        """Writes the touched buckets of a table: one job, a folder for each bucket."""
        path = f"{self.store.root}/data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", bucket()).write.partitionBy("_bucket").parquet(path)
        folder = self.store._path("data", path.rpartition("/")[2])
        there = {f.getPath().getName() for f in folder.getFileSystem(self.store._conf).listStatus(folder)}
        entry = self.next["tables"].setdefault(table, {"buckets": {}})
        entry["schema"] = json.loads(rows.schema.json())
        for n in touched:
            entry["buckets"].pop(str(n), None)
            if f"_bucket={n}" in there:
                entry["buckets"][str(n)] = {"path": f"{path}/_bucket={n}", "version": self.next["version"]}

    def _touched(self, *rows: DataFrame) -> list[int]:
        return sorted({r[0] for df in rows for r in df.select(bucket()).distinct().collect()})  # BUCKETS at most

    def _merged(self, table: str, rows: DataFrame, touched: list[int], keep) -> None:
        old = self.read(table, touched)
        self._put(table, rows if old is None else keep(old).unionByName(rows, allowMissingColumns=True), touched)

    def replace(self, table: str, rows: DataFrame, units: DataFrame | None = None) -> Change:
        """The rows of `units` (book_id; those of `rows` by default) are exactly `rows`: children are replaced as a whole, and a unit without new rows has none."""
        units = (rows if units is None else units).select(UNIT).distinct()
        self._merged(table, rows, self._touched(units), lambda old: old.join(units, UNIT, "left_anti").select(*old.columns))
        return self

    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> Change:
        """Rows take the place of those with their keys (book_id among them), with all columns; others stay."""
        self._merged(table, rows, self._touched(rows), lambda old: old.join(rows.select(*keys).distinct(), keys, "left_anti").select(*old.columns))
        return self

    def delete(self, units: DataFrame) -> Change:
        """Hides the units' rows in every table, as of this version."""
        path = f"{self.store.root}/data/{uuid.uuid4().hex}"
        units.select(UNIT).distinct().write.parquet(path)
        self.next["tombstones"].append({"path": path, "version": self.next["version"]})
        # Buckets that this change has written itself are of its version, which the tombstone doesn't reach: their rows go now.
        for table, entry in self.next["tables"].items():
            own = [int(n) for n, b in entry["buckets"].items() if b["version"] == self.next["version"]]
            if own:
                rows = self.read(table, own)
                self._put(table, written(rows.join(units.select(UNIT).distinct(), UNIT, "left_anti").select(*rows.columns)), own)
        return self

    def note(self, name: str, value: int | str) -> Change:
        """Writes a fact about the store into the version."""
        self.next.setdefault("notes", {})[name] = value
        return self

    def notes(self) -> dict:
        return self.next.get("notes", {})

    def exchange(self, table: str, rows: DataFrame, gone: DataFrame, keys: list[str]) -> Change:
        """Upserts `rows` by their keys (book_id among them), and takes out the rows whose keys are in `gone`."""
        old = [rows.select(*keys), gone.select(*keys)]
        out = reduce(DataFrame.unionByName, old).distinct()
        self._merged(table, rows, self._touched(*old), lambda kept: kept.join(out, keys, "left_anti").select(*kept.columns))
        return self

    def commit(self) -> int:
        """Makes the version; its number. Raises Conflict if another change was first."""
        self.store._publish(self.next)
        return self.next["version"]


def with_ids(books: DataFrame, stored: DataFrame | None, reuse: bool = True) -> DataFrame:
    """`books` (title, ...) with book_id: the latest stored id of the title (with `reuse`), else numbers after the largest stored one in order of the titles. One row stays for each title."""
    books = books.dropDuplicates(["title"])
    spark = books.sparkSession
    stored = spark.createDataFrame([], "book_id bigint, title string") if stored is None else stored.select("book_id", "title")
    latest = stored.groupBy(F.col("title").alias("_t")).agg(F.max("book_id").alias("book_id"))
    if not reuse:
        latest = latest.limit(0)
    met = written(books.join(latest, F.col("title").eqNullSafe(F.col("_t")), "left").drop("_t"))
    fresh = sync.next_ids(met.where("book_id IS NULL").drop("book_id"), stored.withColumnRenamed("book_id", "id"), ["title"]).withColumnRenamed("id", "book_id")
    return met.where("book_id IS NOT NULL").unionByName(fresh.withColumn("book_id", F.col("book_id").cast("bigint")))


def add_books(store: Store, books: DataFrame, chapters: DataFrame, reuse: bool = True) -> Change:
    """A change that stores `books` (title, ...) and their `chapters` (title, ...) as a unit; titles that are stored keep their latest id and get the new chapters in place of all old ones."""
    change = store.begin()
    given = written(with_ids(books, change.read("books"), reuse))
    ids = given.select("title", "book_id").withColumnRenamed("title", "_t")
    rows = chapters.join(ids, F.col("title").eqNullSafe(F.col("_t"))).drop("title", "_t")
    return change.upsert("books", given, ["book_id"]).replace("chapters", rows, given)


def merge_graph(store: Store, nodes: DataFrame, edges: DataFrame, events: DataFrame) -> Change:
    """A change that merges nodes (book_id, node_key, ...) and edges (book_id, edge_key, ...) by key; the events (book_id, edge_key, ...) of a merged edge are replaced as a whole."""
    nodes, edges = written(nodes), written(edges)  # each is asked several times, and how few they are decides how events meet them
    change = store.begin().upsert("nodes", nodes, ["book_id", "node_key"]).upsert("edges", edges, ["book_id", "edge_key"])
    keys = edges.select("book_id", "edge_key").distinct()
    change._merged("edge_events", events.join(keys, ["book_id", "edge_key"], "left_semi"), change._touched(keys), lambda old: old.join(keys, ["book_id", "edge_key"], "left_anti").select(*old.columns))
    return change


def save_profiles(store: Store, profiles: DataFrame) -> Change:
    """A change that stores profiles (book_id, character_id, ...) by character, all columns replaced."""
    return store.begin().upsert("profiles", profiles, ["book_id", "character_id"])


def sync_subgraph(store: Store, characters: DataFrame, relations: DataFrame, events: DataFrame) -> Change:
    """A change that merges what is known of some characters into a book's graph.

    characters: (book_id, want_id, character_id, name, aliases), want_id being a number within the change; relations: (book_id, source, target, ...) and events: (source, target, ...) name them by it. A character is the stored node
    of its id, else the only stored stub that has one of its names, which then takes over the id and the names but keeps its key, so that edges stay; else it is a new node. Of a node that several characters of the change are, the one
    with an id counts. An edge takes the place of the stored one with all its events.
    """
    change = store.begin()
    stored = change.read("nodes")
    empty = characters.sparkSession.createDataFrame([], "book_id bigint, node_key string, character_id bigint, name string, aliases array<string>")
    known = (empty if stored is None else stored).withColumnRenamed("node_key", "graph_key")
    tidy = lambda df: df.withColumns({"name": name_key(F.col("name")), "aliases": F.transform("aliases", lambda a: name_key(a))})
    found = graph.resolve_nodes(tidy(characters), tidy(known), UNIT)
    fresh = graph_key(F.col(UNIT), F.coalesce("character_id", F.lit(0)), F.col("name"))
    placed = written(characters.join(found, "want_id").withColumn("node_key", F.when(F.col("how") == "new", fresh).otherwise(F.col("graph_key"))).drop("graph_key", "how"))
    best = placed.groupBy(UNIT, "node_key").agg(F.max_by(F.struct("character_id", "name", "aliases"), F.struct(F.coalesce("character_id", F.lit(0)), -F.col("want_id"))).alias("b")).select(UNIT, "node_key", "b.*")
    old = known.select(F.col(UNIT).alias("_b"), F.col("graph_key").alias("_k"), F.col("character_id").alias("_id"), F.col("name").alias("_name"), F.col("aliases").alias("_aliases"))
    both = best.join(old, (F.col(UNIT) == F.col("_b")) & (F.col("node_key") == F.col("_k")), "left")
    # A node with an id isn't renamed by a mention without one.
    keeps = (F.coalesce("character_id", F.lit(0)) == 0) & (F.coalesce("_id", F.lit(0)) > 0)
    nodes = written(both.select(UNIT, "node_key", F.when(keeps, F.col("_id")).otherwise(F.col("character_id")).alias("character_id"), F.when(keeps, F.col("_name")).otherwise(F.col("name")).alias("name"), F.array_distinct(F.concat(F.coalesce("_aliases", F.array().cast("array<string>")), "aliases")).alias("aliases")))
    ends = placed.select("want_id", "node_key")
    side = lambda rows, c: rows.join(ends.withColumnsRenamed({"want_id": f"_{c}", "node_key": f"{c}_key"}), F.col(c) == F.col(f"_{c}")).drop(c, f"_{c}")
    keyed = lambda rows: side(side(rows, "source"), "target").withColumn("edge_key", edge_key(F.col("source_key"), F.col("target_key")))
    edges = written(keyed(relations).dropDuplicates([UNIT, "edge_key"]))
    keys = edges.select(UNIT, "edge_key")
    lines = keyed(events).join(keys, "edge_key", "left_semi") if UNIT in events.columns else keyed(events).join(keys, "edge_key")
    change.upsert("nodes", nodes, [UNIT, "node_key"]).upsert("edges", edges, [UNIT, "edge_key"])
    change._merged("edge_events", lines.drop("source_key", "target_key"), change._touched(keys), lambda kept: kept.join(keys, [UNIT, "edge_key"], "left_anti").select(*kept.columns))
    return change
