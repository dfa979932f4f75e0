"""Exact substring dedup over super-k-mers.

A window is `width` consecutive words of one document. Every word covered by a window whose word sequence also starts earlier
(smaller id, or same document and earlier start) is removed; windows are judged on the input.

A window's minimiser is the smallest hash among its word 3-grams, so equal windows have equal minimisers. Consecutive windows that share
one travel together as a super-k-mer, one packed string instead of a string per window, to their minimiser's bucket. There the windows are
sorted by hash, and equal hashes are settled by comparing the words themselves. Before that, windows that occur in a batch already are
settled in the batch.

Minimisers of very many windows (those in and around a common passage) would fill one bucket. A sample of documents shows which they
are; their windows travel one by one, to buckets by their own hash, and a task settles those that an earlier document of its own batches has sent already. So
a passage of many documents reaches its buckets once or a few times for each task, whatever its copies. The sample steers the layout only: the result is the same for any.

What bounds a task's memory: batches of BATCH_BYTES of text (a longer document is its own batch), SEEN remembered windows, and a few buckets of `bucket_bytes`
at a time, whose number grows with the input.

Defined cases: null texts have no words; very long texts are read whole; a null id comes after all others; documents with one id and different texts are ordered by
their texts' hash; repeated rows (same id and text) are one document and each row gets its result; ids must be whole numbers or their text (others fail); an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.wordhash import cut, mixed, sliding_min, window_hashes, word_hashes

GRAM = 3
LAST = np.iinfo(np.int64).max
BATCH_BYTES = 4 << 20
SEEN = 100_000
NEWLINE = 10


def _windows(blob: np.ndarray, start: np.ndarray, end: np.ndarray, part: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window at each word, and whether it lies within its part (part: rising number of each word's text)."""
    h = window_hashes(word_hashes(blob, start, end), width)
    return h, part[: len(h)] == part[width - 1 :] if len(h) else np.empty(0, bool)


def _repeats(data: bytes, start: np.ndarray, end: np.ndarray, at: np.ndarray, h: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
    """Which of the windows that begin at the words `at` (in order of precedence) occur earlier among them. key: two windows of equal key are one.

    Words in `data` have one byte between them. Equal hashes count only if the bytes are equal too.
    """
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(h), bool)
    same[1:] = h[order][1:] == h[order][:-1]
    found = np.zeros(len(h), bool)
    tails = np.flatnonzero(same)
    if not len(tails):
        return found
    heads = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))[tails]
    tail, head = order[tails], order[heads]
    a, b, c, d = start[at[tail]], end[at[tail] + width - 1], start[at[head]], end[at[head] + width - 1]
    equal = np.fromiter((data[w:x] == data[y:z] for w, x, y, z in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())), bool, len(tail))
    found[tail[equal & (key[tail] != key[head])]] = True
    for g in set(heads[~equal].tolist()):  # different words under one hash
        seen: dict[bytes, int] = {}
        for i in order[g : g + 1].tolist() + tail[heads == g].tolist():
            first = seen.setdefault(data[start[at[i]] : end[at[i] + width - 1]], i)
            found[i] = first != i and key[first] != key[i]
    return found


def _runs(at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of consecutive `at` whose other arrays don't change."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    breaks = at[1:] != at[:-1] + 1
    for x in same:
        breaks |= x[1:] != x[:-1]
    first = np.concatenate([[0], np.flatnonzero(breaks) + 1])
    return first, np.concatenate([first[1:] - 1, [len(at) - 1]])


class _Batch:
    """The words of some documents, in order of precedence, one byte between words."""

    def __init__(self, rows: list[tuple[int, int, bytes]], width: int):
        rows = sorted({(i, t): text for i, t, text in rows}.items())
        self.ids = np.array([k[0] for k, _ in rows], np.int64)
        self.tags = np.array([k[1] for k, _ in rows], np.int64)
        raw = np.frombuffer(b"\n" + b"\n".join(text for _, text in rows) + b"\n", np.uint8)
        offset = np.cumsum([1, *(len(text) + 1 for _, text in rows)])[:-1]
        begin, stop = cut(raw)
        self.first = np.searchsorted(begin, offset)
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[begin], inside[stop] = 1, -1
        keep = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        keep[stop] = True
        keep[0] = True
        lengths = stop - begin
        self.start = 1 + np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(begin) else begin
        self.end = self.start + lengths
        blob = raw[keep].copy()
        blob[self.end] = 32
        self.blob, self.data = blob, blob.tobytes()
        self.doc = np.repeat(np.arange(len(rows)), np.diff([*self.first, len(begin)]))
        self.place = np.arange(len(begin)) - self.first[self.doc] if len(rows) else begin
        self.hash, self.valid = _windows(blob, self.start, self.end, self.doc, width)
        grams = window_hashes(word_hashes(blob, self.start, self.end), GRAM)
        self.least = sliding_min(grams, width - GRAM + 1)


def _sent_before(b: _Batch, width: int, at: np.ndarray, seen: dict[int, tuple[tuple[int, int, int], bytes]]) -> np.ndarray:
    """Which of the windows that begin at the words `at` an earlier batch of the task has sent for an earlier place. Remembers the others."""
    found = np.zeros(len(at), bool)
    rows = zip(b.hash[at].tolist(), b.ids[b.doc[at]].tolist(), b.tags[b.doc[at]].tolist(), b.place[at].tolist(), b.start[at].tolist(), b.end[at + width - 1].tolist())
    for k, (h, i, tag, place, a, z) in enumerate(rows):
        known, here = seen.get(h), (i, tag, place)
        if known is None:
            if len(seen) < SEEN:
                seen[h] = here, b.data[a:z]
        elif known[1] == b.data[a:z]:
            found[k] = known[0] < here
            if here < known[0]:
                seen[h] = here, known[1]
    return found


def _packed(b: _Batch, width: int, hot: np.ndarray, buckets: int, seen: dict) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of the batch's super-k-mers, and the runs of windows that are settled here."""
    at = np.flatnonzero(b.valid)
    doc = b.doc[at]
    repeated = _repeats(b.data, b.start, b.end, at, b.hash[at], np.arange(len(at)), width)
    often = np.flatnonzero(np.isin(b.least[at], hot) & ~repeated)
    repeated[often] = _sent_before(b, width, at[often], seen)
    dup = at[repeated]
    first, last = _runs(dup, b.doc[dup])
    settled = np.stack([b.ids[b.doc[dup[first]]], b.tags[b.doc[dup[first]]], b.place[dup[first]], last - first + 1]).astype(np.int64) if len(dup) else np.empty((4, 0), np.int64)
    at, doc = at[~repeated], doc[~repeated]
    least = b.least[at]
    alone = np.isin(least, hot)
    by = np.where(alone, b.hash[at], least)
    first, last = _runs(at, doc, by, alone)
    bucket = (mixed(by[first]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first, last, bucket = first[order], last[order], bucket[order]
    a, z = b.start[at[first]], b.end[at[last] + width - 1]
    meta = np.stack([b.ids[doc[first]], b.tags[doc[first]], b.place[at[first]]]).astype(np.int64) if len(first) else np.empty((3, 0), np.int64)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.array([0])
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        text = b"\n".join([b.data[x:y] for x, y in zip(a[i:j].tolist(), z[i:j].tolist())])
        runs, settled = settled, settled[:, :0]
        yield int(bucket[i]), squeeze(struct.pack("<qq", j - i, runs.shape[1]) + meta[:, i:j].tobytes() + runs.tobytes() + text)
    if settled.shape[1]:
        yield 0, squeeze(struct.pack("<qq", 0, settled.shape[1]) + settled.tobytes())


def _counted(blobs: list[bytes], width: int) -> np.ndarray:
    """Runs (id, tag, start, windows) of a bucket's windows that occur earlier, with those settled before."""
    metas, texts, settled, expand = [], [], [], zstandard.ZstdDecompressor().decompress
    for blob in blobs:
        x = expand(blob)
        n, r = struct.unpack_from("<qq", x)
        metas.append(np.frombuffer(x, np.int64, 3 * n, 16).reshape(3, n))
        settled.append(np.frombuffer(x, np.int64, 4 * r, 16 + 24 * n).reshape(4, r))
        if n:
            texts += x[16 + 24 * n + 32 * r :].split(b"\n")
    meta, settled = np.concatenate(metas, axis=1), np.concatenate(settled, axis=1)
    if not texts:
        return settled
    order = np.lexsort((meta[2], meta[1], meta[0]))
    meta = meta[:, order]
    data = b"\n" + b"\n".join([texts[i] for i in order.tolist()]) + b"\n"
    del texts
    blob = np.frombuffer(data, np.uint8)
    start, end = cut(blob)
    part = np.cumsum(blob[start - 1] == NEWLINE) - 1
    h, valid = _windows(blob, start, end, part, width)
    at = np.flatnonzero(valid)
    opens = np.searchsorted(part, np.arange(meta.shape[1]))
    mine = part[at]
    place = meta[2][mine] + at - opens[mine]
    # Rows of one document may be in several batches: its own windows are not copies of each other.
    doc = np.cumsum(np.concatenate([[0], (meta[0][1:] != meta[0][:-1]) | (meta[1][1:] != meta[1][:-1])]))[mine]
    dup = np.flatnonzero(_repeats(data, start, end, at, h[at], doc * (1 << 32) + place, width))
    first, last = _runs(place[dup], mine[dup])
    found = np.stack([meta[0][mine[dup[first]]], meta[1][mine[dup[first]]], place[dup[first]], last - first + 1]).astype(np.int64) if len(dup) else np.empty((4, 0), np.int64)
    return np.concatenate([settled, found], axis=1)


def _batches(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[_Batch]:
    for record in rows:
        held, size = [], 0
        ids = record.column(0).fill_null(LAST).to_pylist()
        for i, tag, text in zip(ids, record.column(1).to_pylist(), record.column(2)):
            text = text.as_buffer().to_pybytes() if text.is_valid else b""
            held.append((i, tag, text))
            size += len(text)
            if size >= BATCH_BYTES:
                yield _Batch(held, width)
                held, size = [], 0
        if held:
            yield _Batch(held, width)


def repeated_runs(docs: DataFrame, width: int = 20, bucket_bytes: int = 4 << 20, layout_sample: int = 32, most_hot: int = 100_000) -> DataFrame:
    """(id, tag, runs): for each document of `docs` (id, tag, text), the runs of window starts whose sequence starts earlier elsewhere."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))

    def minimisers(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(rows, width):
            at = np.flatnonzero(b.valid)
            first, _ = _runs(at, b.doc[at], b.least[at])
            value, n = np.unique(b.least[at[first]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["m", "n"])

    sample = docs.where(F.pmod(F.xxhash64("id", F.lit("layout")), F.lit(layout_sample)) == 0)
    often = bucket_bytes // 50 // 4 // layout_sample
    hot = sample.mapInArrow(minimisers, "m bigint, n bigint").groupBy("m").agg(F.sum("n").alias("n")).where(F.col("n") > often)
    hot = np.array([r.m for r in hot.orderBy(F.desc("n"), "m").limit(most_hot).collect()], np.int64).view(np.uint64)

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in _batches(rows, width):
            bucket, blob = zip(*x) if (x := list(_packed(b, width, hot, buckets, seen))) else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(blob, pa.binary())], ["bucket", "blob"])

    def count(table: pa.Table) -> pa.Table:
        found = _counted(table.column("blob").to_pylist(), width)
        return pa.table([pa.array(x) for x in found], ["id", "tag", "start", "n"])

    packed = docs.mapInArrow(pack, "bucket bigint, blob binary").repartition(max(1, buckets // 4), "bucket")
    found = packed.groupBy("bucket").applyInArrow(count, "id bigint, tag bigint, start bigint, n bigint")
    return found.groupBy("id", "tag").agg(F.collect_list(F.struct(F.col("start").cast("int"), F.col("n").cast("int"))).alias("runs"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, carry: list[str] | None = None, **layout: int) -> DataFrame:
    """(id, n_words, n_removed, kept, rest): every row with the words that stay, joined by one space, and the columns `carry` as a struct (null without any)."""
    rest = F.struct(*carry) if carry else F.lit(None).cast("boolean")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), rest.alias("rest"))
    rows = rows.select("id", F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("text"), "rest")
    runs = repeated_runs(rows.select("id", "tag", "text"), width, **layout).withColumnsRenamed({"id": "_id", "tag": "_tag"})
    joined = rows.join(runs, F.coalesce("id", F.lit(int(LAST))).eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left").select("id", "text", "runs", "rest")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, runs in zip(batch.column(1), batch.column(2)):
                parts = text.as_buffer().to_pybytes().split()
                n.append(len(parts))
                if runs.is_valid:
                    mark = np.zeros(len(parts) + 1, np.int64)
                    start, length = (runs.values.field(k).to_numpy() for k in (0, 1))
                    np.add.at(mark, start, 1)
                    np.add.at(mark, start + length + width - 1, -1)
                    stays = np.cumsum(mark[:-1]) == 0
                    parts = [parts[i] for i in np.flatnonzero(stays).tolist()]
                gone.append(n[-1] - len(parts))
                kept.append(b" ".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), batch.column(3)], ["id", "n_words", "n_removed", "kept", "rest"])

    return joined.mapInArrow(keep, f"id bigint, n_words bigint, n_removed bigint, kept string, rest {rows.schema['rest'].dataType.simpleString()}")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What substring dedup removes from every document."""
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
