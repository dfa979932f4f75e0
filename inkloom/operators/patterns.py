"""Many fixed strings in many texts: one automaton over all of them finds every pattern in one pass over a text.

The patterns go to every task as a broadcast, if they are MOST_BYTES at most, which is checked before; a larger set has another way, for which the caller falls back on a shuffle. A task holds the automaton (about 40 times its patterns),
a batch of texts, and as Python objects SLICE of its texts with their hits at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 16 << 20
#: How many rows of a batch are Python objects at a time: a batch's texts and what is found in them take many times its size.
SLICE = 256
HITS = pa.list_(pa.struct([("pattern", pa.string()), ("n", pa.int64())]))


def within_bound(patterns: DataFrame, column: str, most: int = MOST_BYTES) -> list[str] | None:
    """The distinct patterns that aren't empty, if they are `most` bytes together at most, else None."""
    some = patterns.select(F.col(column).alias("p")).where("p <> ''").distinct()
    if (some.agg(F.sum(F.octet_length("p") + 16)).first()[0] or 0) > most:
        return None
    return sorted(r[0] for r in some.collect())


def counts(text: str, automaton: ahocorasick.Automaton) -> dict[str, int]:
    """How often each pattern is in a text, occurrences of one pattern not overlapping."""
    found: dict[str, int] = {}
    reached: dict[str, int] = {}
    for end, pattern in automaton.iter(text) if len(automaton) else ():
        if end - len(pattern) >= reached.get(pattern, -1):
            found[pattern] = found.get(pattern, 0) + 1
            reached[pattern] = end
    return found


def automaton_of(patterns: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for p in patterns:
        out.add_word(p, p)
    if patterns:
        out.make_automaton()
    return out


def counted(rows: DataFrame, text: str, patterns: list[str]) -> DataFrame:
    """`rows` with hits, an array of (pattern, n) in order of the patterns, in place of the text; a null text has none."""
    given = rows.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(given.value)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                hits = [[] if t is None else [{"pattern": p, "n": n} for p, n in sorted(counts(t, automaton).items())] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hits, HITS)], ["row", "hits"])

    keep = [c for c in rows.columns if c not in (text, "hits")]
    packed = rows.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(run, f"row {kind}, hits array<struct<pattern:string,n:bigint>>").select("row.*", "hits")
