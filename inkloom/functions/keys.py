"""Stable keys and hashes, scores and other arithmetic as Column expressions."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.functions.text import name_key


def graph_key(book: Column, character: Column, name: Column) -> Column:
    """A node's key: by character id if there is one, else a stub by the name's hash."""
    stub = F.concat(F.lit("stub:"), book.cast("string"), F.lit(":"), F.substring(F.sha1(name_key(name)), 1, 12))
    return F.when(character > 0, F.concat(F.lit("character:"), book.cast("string"), F.lit(":"), character.cast("string"))).otherwise(stub)


def edge_key(source: Column, target: Column) -> Column:
    return F.concat_ws("|", source, target)


def event_key(edge: Column, *parts: Column) -> Column:
    return F.concat(edge, F.lit("|"), F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16))


def embedding_hash(model: str, text: Column) -> Column:
    """Changes when either the model or the text does."""
    return F.sha2(F.concat(F.lit(model + "\n"), F.coalesce(text, F.lit(""))), 256)


def version_hash(*columns: str) -> Column:
    """The hash of a row's columns as JSON, keys sorted."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


@F.pandas_udf(T.LongType())
def point_id(key: pd.Series) -> pd.Series:
    """A stable id of a key: its version 5 UUID, modulo 2^63 - 1."""
    return key.map(lambda k: uuid.uuid5(uuid.NAMESPACE_URL, k or "").int % ((1 << 63) - 1))


@F.pandas_udf(T.StringType())
def session_id(scope: pd.Series) -> pd.Series:
    return scope.map(lambda k: str(uuid.uuid5(uuid.NAMESPACE_URL, k or "")))


def cosine(left: Column, right: Column) -> Column:
    """The cosine of two vectors of equal length, in doubles; null if one is a zero vector."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when(norm > 0, dot(left, right) / norm)


def reciprocal_ranks(*ranks: Column, k: int = 60) -> Column:
    """The sum of 1 / (k + rank) over the ranks that are there."""
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.coalesce(F.lit(1.0) / (F.lit(k) + r), F.lit(0.0))
    return total


def retry_delay(retries: Column, first: int = 60, most: int = 3600) -> Column:
    return F.least(F.lit(float(most)), F.lit(float(first)) * F.pow(F.lit(2.0), retries.cast("double"))).cast("bigint")


def clipped_end(start: Column, end: Column, limit: int = 8) -> Column:
    """The end of a window that begins at start (1 at least) and spans `limit` at most."""
    low = F.greatest(F.lit(1), start)
    return F.least(F.greatest(low, end), low + limit - 1)
