"""Databases as sources: where they are, reads in partitions of about equal size, and rows by lists of ids.

A connection is a DSN such as mysql+driver://user:password@host:port/name; user, password and name may be percent-encoded. Partitions come from a histogram that the database makes itself: a number of equal slices between the
column's least and largest value with their counts, merged into ranges of about equal counts; so a column whose values lie close together in one place gives even partitions, and only the slices come to the driver. Lists of ids
become IN conditions of bounded length, a partition each.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import NamedTuple
from urllib.parse import quote, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PORTS = {"mysql": 3306, "mariadb": 3306, "postgresql": 5432}
#: How many slices a histogram has, how many ids go into one condition, and how many are asked for by conditions at all.
SLICES, IDS, MOST_IDS = 1024, 500, 20_000
#: What passwords begin with that nobody has filled in.
PLACEHOLDER = "change-me"


class Connection(NamedTuple):
    kind: str
    host: str
    port: int
    user: str
    password: str
    database: str


def parsed(dsn: str | None) -> Connection | None:
    """The parts of a DSN; None unless it has a host, a user and a database and is of a known kind."""
    found = urlsplit((dsn or "").strip())
    kind = found.scheme.partition("+")[0]
    database = unquote(found.path.lstrip("/"))
    if kind not in PORTS or not (found.hostname and found.username and database):
        return None
    return Connection(kind, found.hostname, found.port or PORTS[kind], unquote(found.username), unquote(found.password or ""), database)


def is_placeholder(dsn: str | None) -> bool:
    """Whether a DSN is empty or still has the password of an example."""
    return not (dsn or "").strip() or PLACEHOLDER in (dsn or "")


def built(values: Mapping[str, str], prefix: str = "MYSQL", defaults: Mapping[str, str] | None = None) -> str:
    """A DSN from single settings such as MYSQL_USER; blank ones have their default."""
    of = lambda name, other="": (values.get(f"{prefix}_{name}") or "").strip() or (defaults or {}).get(name, other)
    return f"mysql+pymysql://{quote(of('USER'), safe='')}:{quote(of('PASSWORD'), safe='')}@{of('HOST', 'mysql')}:{of('PORT', '3306')}/{quote(of('DATABASE'), safe='')}"


def resolved(values: Mapping[str, str], prefix: str = "MYSQL", defaults: Mapping[str, str] | None = None) -> str:
    """The DSN to use: the whole one (MYSQL_DSN) unless it is a placeholder, else one built of the single settings, else none."""
    whole = (values.get(f"{prefix}_DSN") or "").strip()
    single = any((values.get(f"{prefix}_{n}") or "").strip() for n in ("USER", "PASSWORD", "DATABASE", "HOST", "PORT"))
    if whole and not is_placeholder(whole):
        return whole
    return built(values, prefix, defaults) if whole or single else ""


def options(dsn: str) -> dict[str, str]:
    """Options for Spark's JDBC reader and writer."""
    found = parsed(dsn)
    if found is None:
        raise ValueError("not a DSN")
    return {"url": f"jdbc:{found.kind}://{found.host}:{found.port}/{quote(found.database, safe='')}", "user": found.user, "password": found.password}


def asked(spark: SparkSession, how: Mapping[str, str], query: str) -> DataFrame:
    return spark.read.format("jdbc").options(**how).option("query", query).load()


def quoted(spark: SparkSession, how: Mapping[str, str], column: str) -> str:
    """A column's name as the database spells it."""
    return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(how["url"]).quoteIdentifier(column)


def ranges(histogram: Iterable[tuple[int, int]], low: int, width: int, partitions: int) -> list[tuple[int, int]]:
    """(first value, value behind the last) of about equally many rows each, from (slice, rows) pairs."""
    pairs = sorted((int(n), int(rows)) for n, rows in histogram)
    share = sum(rows for _, rows in pairs) / max(1, partitions)
    out, start, held = [], pairs[0][0] if pairs else 0, 0
    for k, (n, rows) in enumerate(pairs):
        held += rows
        last = k == len(pairs) - 1
        if last or held >= share:
            out.append((low + start * width, low + (n + 1) * width))
            start, held = n + 1, 0
    return out


def predicates(spark: SparkSession, how: Mapping[str, str], table: str, column: str, partitions: int, slices: int = SLICES) -> list[str]:
    """Conditions on an integer column that part a table: every row, also one with a null, meets exactly one."""
    column = quoted(spark, how, column)
    ends = asked(spark, how, f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}").first()
    if ends is None or ends[0] is None:
        return ["1 = 1"]
    low, high = int(ends[0]), int(ends[1])
    width = max(1, -(-(high - low + 1) // slices))
    counts = asked(spark, how, f"SELECT b, COUNT(*) AS n FROM (SELECT ({column} - {low}) / {width} AS b FROM {table} WHERE {column} IS NOT NULL) s GROUP BY b").collect()
    found = ranges([(int(r[0]), int(r[1])) for r in counts], low, width, partitions)
    conditions = [f"{column} >= {a} AND {column} < {b}" for a, b in found]
    conditions[0] = f"({column} < {found[0][1]} OR {column} IS NULL)"
    conditions[-1] = f"{column} >= {found[-1][0]}" if len(found) > 1 else "1 = 1"
    return conditions


def scan(spark: SparkSession, how: Mapping[str, str], table: str, column: str, partitions: int = 8) -> DataFrame:
    """A whole table, read in partitions of about equally many rows by an integer column."""
    rest = {k: v for k, v in how.items() if k != "url"}
    return spark.read.jdbc(how["url"], table, predicates=predicates(spark, how, table, column, partitions), properties=rest)


def id_conditions(column: str, ids: Iterable[int], fixed: str = "", most: int = IDS) -> list[str]:
    """IN conditions of `most` ids at most over the distinct positive ids in order, each with the fixed condition."""
    wanted = sorted({int(i) for i in ids if i is not None and int(i) > 0})
    head = f"{fixed} AND " if fixed else ""
    return [f"{head}{column} IN ({', '.join(map(str, wanted[k : k + most]))})" for k in range(0, len(wanted), most)]


def fetched(spark: SparkSession, how: Mapping[str, str], table: str, column: str, ids: DataFrame, fixed: str = "", partitions: int = 8) -> DataFrame:
    """The rows of a table whose column is among `ids` (one integer column). Up to MOST_IDS of them the database chooses; more meet the whole table by a join."""
    rest = {k: v for k, v in how.items() if k != "url"}
    name = ids.columns[0]
    wanted = ids.select(F.col(name).alias("_id")).where("_id > 0").distinct()
    some = [r[0] for r in wanted.limit(MOST_IDS + 1).collect()]
    if len(some) > MOST_IDS:
        rows = scan(spark, how, f"(SELECT * FROM {table} WHERE {fixed}) f" if fixed else table, column, partitions)
        return rows.join(wanted, F.col(column) == F.col("_id"), "left_semi")
    return spark.read.jdbc(how["url"], table, predicates=id_conditions(quoted(spark, how, column), some, fixed) or ["1 = 0"], properties=rest)


def among(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are wanted; the last key must be positive, as ids and chapters are. The same as an IN list, for tables of any source and lists of any length."""
    good = wanted.where(F.col(keys[-1]) > 0).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    met = F.lit(True)
    for k in keys:
        met = met & (F.col(k) == F.col(f"_{k}"))
    return rows.join(good, met, "left_semi")
