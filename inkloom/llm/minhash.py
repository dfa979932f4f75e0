"""Document fingerprints by one-permutation MinHash.

A text's 5-word shingles are hashed once; a hash's upper part names one of BINS bins and its lower part competes for the bin's
minimum. An empty bin takes the value of a filled one, found by a walk of hashes of (bin, attempt) that is the same for all texts
(optimal densification). Of each bin's value, mixed with the bin's number, the lowest BITS bits are stored, packed. So bins that
hold one value by densification don't agree by one chance. Two fingerprints agree in a bin with probability
J + (1 - J) / 2^BITS, so the likeness is (share - 2^-BITS) / (1 - 2^-BITS), held within 0 and 1.

What bounds a task's memory: texts are read in slices of SLICE_BYTES or SLICE_ROWS; a longer text is a slice of its own, whole.

Defined cases: a text of fewer than 5 words has one shingle, all of it; null texts and texts without words have an empty
fingerprint, which is wholly like another empty one and unlike all others; ties (hashes of one bin) are settled by the smaller value; repeated rows get a row each; ids must be whole numbers or their text
(others fail); other columns are ignored; an empty table gives an empty table.
In the chain of neighbours a null id comes first, rows of one id follow each other by text, and the row after the last is the first. Rows of one id, null included, lie in one range: ids are meant to tell documents apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.llm.wordhash import cut, mixed, window_hashes, word_hashes

WIDTH = 5
BINS = 512
BITS = 4
SLICE_BYTES = 2 << 20
SLICE_ROWS = 4096
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_walks: list[np.ndarray] = []


def _walk(attempt: int) -> np.ndarray:
    """The bin that each empty bin looks at in an attempt."""
    while len(_walks) <= attempt:
        x = np.arange(BINS, dtype=np.uint64) + np.uint64(BINS * (len(_walks) + 1))
        _walks.append((mixed(x * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int64))
    return _walks[attempt]


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of BINS values of BITS bits for each text, and whether the text has words."""
    blob = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    start, end = cut(blob)
    offset = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
    first = np.searchsorted(start, offset)
    n = np.diff([*first, len(start)])
    h = word_hashes(blob, start, end)
    doc = np.repeat(np.arange(len(texts)), n)
    full = window_hashes(h, WIDTH)
    inside = doc[: len(full)] == doc[WIDTH - 1 :] if len(full) else np.empty(0, bool)
    value, owner = full[inside], doc[: len(full)][inside]
    short = np.flatnonzero((n > 0) & (n < WIDTH))
    if len(short):
        own = []
        for d in short.tolist():
            x = np.array([n[d]], np.uint64)
            for k in range(first[d], first[d] + n[d]):
                x = mixed(x * np.uint64(0x9DDFEA08EB382D69) + h[k : k + 1])
            own.append(x)
        value, owner = np.concatenate([value, *own]), np.concatenate([owner, short])
    table = np.full(len(texts) * BINS, _EMPTY)
    if len(value):
        value = mixed(value)
        slot = owner * BINS + (value >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        low = np.uint64((1 << 32) - 1)
        order = np.sort((slot.astype(np.uint64) << np.uint64(32)) | (value & low))
        slot = (order >> np.uint64(32)).astype(np.int64)
        head = np.concatenate([[True], slot[1:] != slot[:-1]])
        table[slot[head]] = order[head] & low
    table = table.reshape(len(texts), BINS)
    filled, attempt = table != _EMPTY, 0
    rows, bins = np.nonzero(~filled & (n > 0)[:, None])
    while len(rows):
        to = _walk(attempt)[bins]
        hit = filled[rows, to]
        table[rows[hit], bins[hit]] = table[rows[hit], to[hit]]
        rows, bins, attempt = rows[~hit], bins[~hit], attempt + 1
    table = mixed(table * np.uint64(BINS) + np.arange(BINS, dtype=np.uint64))
    return (table & np.uint64((1 << BITS) - 1)).astype(np.uint8), n > 0


def packed(signature: np.ndarray) -> str:
    """A signature as hex, one digit a bin (BITS is 4)."""
    return (signature[0::2] << 4 | signature[1::2]).astype(np.uint8).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, has_a: np.ndarray, has_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of signatures, row by row."""
    chance = 0.5**BITS
    found = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(has_a & has_b, found, (has_a == has_b).astype(float))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]
            for a, b in _slices([len(t) for t in raw]):
                sig, has = signatures(raw[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([packed(s) if h else "" for s, h in zip(sig, has)])], ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fingerprint string")


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    a, held = 0, 0
    for i, size in enumerate(sizes):
        if i > a and (held + size > SLICE_BYTES or i - a >= SLICE_ROWS):
            yield a, i
            a, held = i, 0
        held += size
    if a < len(sizes):
        yield a, len(sizes)


def in_order(docs: DataFrame, id_col: str, text_col: str, rows_each: int = 4096) -> DataFrame:
    """(id, text, own) dealt to partitions by id range and sorted within, each range followed by the row after it (own false).

    The ranges' first ids are the only thing that the driver gathers: one for each `rows_each` rows, and 20,000 at most (then the ranges grow).
    Those ids' rows go to their own range and to the one before; the first row goes after the last one too.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    parts = min(20_000, max(1, n // rows_each))
    low = int(np.iinfo(np.int64).min)
    key = F.coalesce("id", F.lit(low))
    cuts: list[int] = []
    if parts > 1:
        shares = [k / parts for k in range(1, parts)]
        cuts = sorted(set(rows.agg(F.percentile_approx(key, shares, max(10_000, 4 * parts)).alias("c")).first().c))
    least = rows.agg(F.min(key)).first()[0]
    cuts = [c for c in cuts if c > least]
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>")
    rows = rows.withColumn("key", key)
    # The number of cuts at or below the key: a binary search over the sorted cuts would need a function of its own, the ranges are few.
    edges = rows.sparkSession.createDataFrame(pa.table({"cut": pa.array(cuts, pa.int64()), "range": pa.array(range(1, len(cuts) + 1), pa.int32())})) if cuts else None
    last = len(cuts)
    part = F.size(F.filter(bounds, lambda c: c <= F.col("key"))) if len(cuts) <= 64 else None
    if part is None:
        step = -(-len(cuts) // 64)
        coarse = F.array(*map(F.lit, cuts[::step]))
        groups = F.array(*[F.array(*map(F.lit, cuts[i : i + step])) for i in range(0, len(cuts), step)])
        g = F.size(F.filter(coarse, lambda c: c <= F.col("key")))
        fine = F.get(groups, g - 1)
        part = F.when(g == 0, 0).otherwise((g - 1) * step + F.size(F.filter(fine, lambda c: c <= F.col("key"))))
    rows = rows.withColumn("part", part.cast("int"))
    places = F.array(F.struct(F.col("part").alias("to"), F.lit(True).alias("own")))
    heads = set(cuts)
    if edges is not None:
        is_head = F.col("key").isin(*heads) if len(heads) <= 400 else None
        if is_head is None:
            flag = edges.select(F.col("cut").alias("key"), F.lit(True).alias("head"))
            rows = rows.join(F.broadcast(flag), "key", "left")  # as many rows as there are ranges, 20,000 at most
            is_head = F.coalesce("head", F.lit(False))
        places = F.when(is_head, F.array_append(places, F.struct((F.col("part") - 1).alias("to"), F.lit(False).alias("own")))).otherwise(places)
    if least is not None:
        places = F.when(F.col("key") == least, F.array_append(places, F.struct(F.lit(last).alias("to"), F.lit(False).alias("own")))).otherwise(places)
    spread = rows.select("id", "key", "text", F.explode(places).alias("p")).select("id", "key", "text", "p.to", "p.own")
    # A row that closes a range sorts after it, the wrapped first row too.
    spread = spread.repartitionById(last + 1, F.col("to")).sortWithinPartitions("to", F.desc("own"), "key", "text")
    return spread.select("id", "text", "own")


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint, that of its edited text, and its likeness to both the edited text and the next row."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def answer(ids: list, texts: list[str]) -> pa.RecordBatch:
        """For all rows but the last, which is only the one after."""
        after = [edited(a, b) for a, b in zip(texts, texts[1:])]
        raw = [t.encode("utf-8", "surrogatepass") for t in after]
        own, has = signatures([t.encode("utf-8", "surrogatepass") for t in texts])
        new, has_new = signatures(raw)
        show = lambda sig, has: [packed(s) if h else "" for s, h in zip(sig, has)]
        columns = [pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), [hashlib.sha256(t).hexdigest() for t in raw], show(own[:-1], has[:-1]), show(new, has_new)]
        columns += [likeness(own[:-1], new, has[:-1], has_new), likeness(own[:-1], own[1:], has[:-1], has[1:])]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, closed = [], [], 0, False
        for batch in batches:
            for i, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if closed or not own and not ids:  # of the rows that close the range only the first counts
                    continue
                closed = not own
                ids.append(i)
                texts.append(text)
                size += len(text)
                if len(ids) > 1 and (size > SLICE_BYTES or len(ids) > SLICE_ROWS):
                    yield answer(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if len(ids) > 1:
            yield answer(ids, texts)

    return in_order(docs, id_col, text_col).mapInArrow(run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
