"""What model services do, behind functions: an embedding, a reranker, a summary. The defaults are deterministic and need no network; pass others of the same shape in their place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.functions.text import overlap_score, overlap_tokens

Embedder = Callable[[Column], Column]
Reranker = Callable[[Column, Column], Column]
Summariser = Callable[[Column], Column]


def hashed_embedding(size: int = 64) -> Embedder:
    """A text's distinct tokens counted in `size` buckets by hash."""

    def embed(text: Column) -> Column:
        buckets = F.transform(overlap_tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(size)))
        # Sorted with every bucket's number once more, a bucket's count is the distance to the next bucket's first place.
        marked = F.array_sort(F.concat(buckets, F.sequence(F.lit(0).cast("bigint"), F.lit(size).cast("bigint"))))
        place = lambda b, i: F.array_position(b, i.cast("bigint"))
        return F.transform(F.array(marked), lambda b: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (place(b, i + 1) - place(b, i) - 1).cast("float")))[0]

    return embed


def overlap_reranker(query: Column, text: Column) -> Column:
    """The share of the query's tokens that the text has."""
    return overlap_score(overlap_tokens(query), overlap_tokens(text))


#: A sentence and the marks that end it, as `[^.!?。！？]+[.!?。！？]*` has it; with ASCII apart from the rest, Java finds it in a sixth of the time.
SENTENCE = r"(?:[^.!?\u0080-\uFFFF]|[\u0080-\uFFFF&&[^。！？]])++[.!?。！？]*+"


def edge_sentences(chars: int = 120) -> Summariser:
    """The first, the longest and the last sentence of the whole text, each once and `chars` long at most."""

    def summarise(text: Column) -> Column:
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))

        def chosen(s: Column) -> Column:
            longest = F.aggregate(s, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
            parts = F.transform(F.array(F.get(s, F.lit(0)), longest, F.try_element_at(s, F.lit(-1))), lambda x: F.trim(F.substring(F.trim(x), 1, chars)))
            return F.array_join(F.array_distinct(F.filter(parts, lambda x: x != "")), " ")

        return F.transform(F.array(found), chosen)[0]

    return summarise


def first_sentences(chars: int = 200) -> Summariser:
    """A text's beginning, cut at the last sentence end within `chars`."""

    def summarise(text: Column) -> Column:
        head = F.substring(F.coalesce(text, F.lit("")), 1, chars)
        whole = F.regexp_extract(head, r"(?s)^(.*[.。!！?？])", 1)
        return F.when(whole == "", head).otherwise(whole)

    return summarise
