"""Named entries of a plot's chapters, merged by shared names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions.aliases import primary_and_aliases
from inkloom.functions.text import name_key


def merged_entries(entries: DataFrame) -> DataFrame:
    """(book_id, plot_id, place, name, aliases, records) of entries (book_id, plot_id, chapter_index, pos, name, description).

    Entries come in order of chapter and place. Each joins the earliest merged entry that has one of its names (blanks and case aside), or begins one; so where an entry goes
    depends on those before it. A task walks through its plots' entries in order and holds the name keys of one plot; what it finds, the place and which names are new there, is
    aggregated. The first spelling of each name counts. Records are distinct (chapter, description), in order.
    """
    keys = ["book_id", "plot_id"]
    every = lambda n: F.transform(F.concat(F.array(n["primary"]), n["aliases"]), lambda x: F.struct(x.alias("name"), name_key(x).alias("token")))
    names = F.filter(F.transform(F.array(primary_and_aliases(F.col("name"))), every)[0], lambda x: x["token"] != "")
    named = entries.select(*keys, F.col("chapter_index").cast("bigint").alias("chapter_index"), F.col("pos").cast("int").alias("pos"), names.alias("names"), F.trim(F.coalesce("description", F.lit(""))).alias("description"))
    dealt = named.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_last("chapter_index"), F.asc_nulls_last("pos"), "names", "description")
    types = {f.name: f.dataType.simpleString() for f in named.schema.fields}
    rows = dealt.mapInArrow(_placed, f"book_id {types['book_id']}, plot_id {types['plot_id']}, chapter_index bigint, pos int, place int, fresh array<string>, description string")
    spelled = F.sort_array(F.collect_list(F.when(F.size("fresh") > 0, F.struct("chapter_index", "pos", "fresh"))))
    records = F.sort_array(F.collect_set(F.struct(F.col("chapter_index").alias("chapter"), F.col("description").alias("text"))))
    found = rows.groupBy(*keys, "place").agg(F.flatten(F.transform(spelled, lambda x: x["fresh"])).alias("aliases"), records.alias("records"))
    primary, others = F.col("aliases")[0], F.slice("aliases", 2, F.size("aliases"))
    shown = F.when(F.size("aliases") > 1, F.concat(primary, F.lit("（"), F.array_join(others, "/"), F.lit("）"))).otherwise(primary)
    return found.select(*keys, "place", shown.alias("name"), "aliases", "records")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in order, with their places and the names that their places didn't have before; entries without a name go."""
    plot, home, seen, begun = None, {}, set(), 0
    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column("names")), 0))
        names = batch.column("names")
        flat, sizes = names.flatten(), pc.list_value_length(names).to_numpy(zero_copy_only=False)
        tokens = flat.field("token").to_pylist()
        places, new, at = [], [], 0
        for now, size in zip(zip(batch.column("book_id").to_pylist(), batch.column("plot_id").to_pylist()), sizes.tolist()):
            if now != plot:
                plot, home, seen, begun = now, {}, set(), 0
            own = tokens[at : at + size]
            at += size
            here = min((home[t] for t in own if t in home), default=begun)
            begun += here == begun
            for t in own:
                home[t] = min(home.get(t, here), here)
                new.append((here, t) not in seen)
                seen.add((here, t))
            places.append(here)
        mask = np.array(new, bool)
        counts = np.concatenate([[0], np.cumsum(mask)])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        fresh = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), flat.field("name").filter(pa.array(mask)))
        columns = [batch.column(c) for c in ("book_id", "plot_id", "chapter_index", "pos")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.int32()), fresh, batch.column("description")], ["book_id", "plot_id", "chapter_index", "pos", "place", "fresh", "description"])
