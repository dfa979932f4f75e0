"""The data source of book files: batch and stream, partitions, schema and conditions."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from inkloom.sources import book_source, books

PAGES = {"c1.xhtml": "<h1>One</h1><p>first text</p>", "nav.xhtml": "<p>contents</p>", "cover.xhtml": "<p>Cover</p>", "c2.xhtml": "<p>untitled</p>", "empty.xhtml": "<p> </p>"}


def epub(path):
    items = "".join(f'<item id="i{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(PAGES))
    refs = "".join(f'<itemref idref="i{k}"/>' for k in range(len(PAGES)))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        z.writestr("OEBPS/p.opf", f"<package><metadata/><manifest>{items}</manifest><spine>{refs}</spine></package>")
        for name, body in PAGES.items():
            z.writestr(f"OEBPS/{name}", f"<html><body>{body}</body></html>")


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "books"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_bytes("第一章 开始\n内容".encode("gb18030"))
    (root / "sub" / "b.TXT").write_bytes(b"\xef\xbb\xbfplain")
    epub(root / "c.epub")
    (root / "broken.epub").write_bytes(b"no zip")
    (root / "note.md").write_text("left out")
    return root


def loaded(reader, folder, **options):
    return reader.format("books").options(**options).load(str(folder))


def rows(df):
    return sorted((os.path.basename(r.path), r.kind, r.place, r.doc, r.title, r.text) for r in df.collect())


EXPECTED = [
    ("a.txt", "txt", 0, "", "", "第一章 开始\n内容"), ("b.TXT", "txt", 0, "", "", "plain"), ("broken.epub", "epub", 0, "", "", None),
    ("c.epub", "epub", 0, "OEBPS/c1.xhtml", "One", "One\n\nfirst text"), ("c.epub", "epub", 3, "OEBPS/c2.xhtml", "", "untitled"),
]


def test_batch_gives_every_document(spark, folder):
    book_source.register(spark)
    assert rows(loaded(spark.read, folder)) == EXPECTED
    older = books.read_epubs(books.read_files(spark, str(folder / "c.epub"))).select("place", "doc", "title", "text").collect()
    assert sorted(map(tuple, older)) == [r[2:] for r in EXPECTED if r[0] == "c.epub"]


def test_partitions_by_size_schema_and_conditions(spark, folder):
    book_source.register(spark)
    assert loaded(spark.read, folder, partitionBytes="1").rdd.getNumPartitions() >= 4
    assert loaded(spark.read, folder).rdd.getNumPartitions() == 1
    files = [book_source.File(str(i), "txt", s, 0) for i, s in enumerate([9, 1, 1, 1, 8, 2])]
    assert sorted(sum(f.size for f in p.files) for p in book_source.packed(files, 11)) == [11, 11]
    listing = loaded(spark.read.schema("kind string, size bigint"), folder)
    assert sorted(map(tuple, listing.collect())) == sorted((n.rpartition(".")[2].lower(), p.stat().st_size) for n in ("a.txt", "sub/b.TXT", "c.epub", "broken.epub") for p in [folder / n])
    try:
        (folder / "c.epub").chmod(0o000)
        texts = loaded(spark.read, folder).where((F.col("kind") == "txt") & F.col("path").endswith("a.txt") & (F.col("place") == 0))
        assert rows(texts) == EXPECTED[:1]
        reader = book_source.BatchReader({"path": str(folder)}, spark.createDataFrame([], "path string").schema)
        from pyspark.sql.datasource import EqualTo, GreaterThan

        left = list(reader.pushFilters([EqualTo(("kind",), "txt"), GreaterThan(("size",), 1)]))
        assert left == [GreaterThan(("size",), 1)] and sorted(f.kind for p in reader.partitions() for f in p.files) == ["txt", "txt"]
    finally:
        (folder / "c.epub").chmod(0o644)


def test_a_stream_gives_the_same_rows_and_later_only_new_files(spark, folder, tmp_path):
    book_source.register(spark)
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"

    def step():
        query = loaded(spark.readStream, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    step()
    assert rows(spark.read.parquet(out)) == EXPECTED == rows(loaded(spark.read, folder))
    step()
    assert rows(spark.read.parquet(out)) == EXPECTED
    new = folder / "new.txt"
    new.write_text("new book")
    later = max(p.stat().st_mtime_ns for p in folder.rglob("*")) + 10**9
    os.utime(new, ns=(later, later))
    step()
    assert rows(spark.read.parquet(out)) == sorted([*EXPECTED, ("new.txt", "txt", 0, "", "", "new book")]) == rows(loaded(spark.read, folder))


def test_an_empty_folder(spark, tmp_path):
    book_source.register(spark)
    (tmp_path / "none").mkdir()
    assert loaded(spark.read, tmp_path / "none").collect() == []
