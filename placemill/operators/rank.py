"""Numbers, cuts and carried values within groups that may hold a large share of all rows.

A plain window puts one key's rows into one task. These helpers split a key
into spans of at most ``span`` consecutive order values first. ``ord`` is a
unique integer per key, so a span can never hold more than ``span`` rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placemill.session import written

SPAN = 100_000
GROUP_LIMIT = 1000  # up to here Spark cuts each map task's rows per key before the shuffle


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def join_small(df: DataFrame, other: DataFrame, names: list[str]) -> DataFrame:
    """Left join on null-safe names, keeping one copy of them."""
    renamed = other.select(*[F.col(n).alias(f"_r_{n}") for n in names], *[c for c in other.columns if c not in names])
    on = reduce(lambda a, b: a & b, [df[n].eqNullSafe(renamed[f"_r_{n}"]) for n in names]) if names else F.lit(True)
    return df.join(renamed, on, "left").drop(*[f"_r_{n}" for n in names])


def _ordered(order) -> list[tuple[str, bool]]:
    return [(o[1:], True) if o.startswith("-") else (o, False) for o in order]


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], ord_col: str = "ord", out: str = "rn", span: int = SPAN
) -> DataFrame:
    """1-based number of each row within ``keys``, by ``order`` ("-x" = descending), ties by ``ord_col``.

    The columns of ``order`` take few values (scores, flags), so the rows per
    (key, order values, span) are counted map-side, the counts summed up, and
    the running total joined back.
    """
    lead = [name for name, _ in _ordered(order)]
    df = df.withColumn("_span", F.floor(F.col(ord_col) / span))
    parts = [*keys, *lead, "_span"]
    by = [F.col(n).desc() if desc else F.col(n).asc() for n, desc in _ordered(order)] + [F.col("_span").asc()]
    before = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy(*parts).orderBy(ord_col)))
    return join_small(local, offsets, parts).withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before", "_span")


def in_ranges(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` written in ranges of (keys, order) as ``_part``, so that a hot key lies in many parts; later parts hold later rows."""
    return written(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()), "ranges")


def _before(parts: DataFrame, keys: list[str], n: Column) -> DataFrame:
    """(keys, _part, _n, _before): what each part holds of a key, and what the parts before it hold."""
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*keys, "_part").agg(n.alias("_n"))
    return sums.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def number_in_order(df: DataFrame, keys: list[str], order: list[Column], out: str = "rn") -> DataFrame:
    """1-based number of each row within ``keys`` by any order, collated text too: ranges are numbered on their own and begin where those before end.

    ``order`` must tell all rows of a key apart.
    """
    parts = in_ranges(df, keys, order)
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    offsets = _before(parts, keys, F.count(F.lit(1))).drop("_n")
    return join_small(local, offsets, [*keys, "_part"]).withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before", "_part")


def value_at(counts: DataFrame, keys: list[str], value: str, n: str, position: Column, out: str) -> DataFrame:
    """(keys, out): the value that stands at ``position`` (from 1, an expression over ``_total``) of each key's values in order.

    ``counts``: keys, distinct values, how often each occurs. The part that holds the
    position is found from the parts' sums, then the value within that part.
    """
    parts = in_ranges(counts.select(*keys, value, n), keys, [F.col(value)])
    sums = _before(parts, keys, F.sum(n)).withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    reached = sums.withColumn("_want", position).where((F.col("_before") < F.col("_want")) & (F.col("_want") <= F.col("_before") + F.col("_n")))
    inside = join_small(parts, reached.select(*keys, "_part", "_before", "_want"), [*keys, "_part"]).where(F.col("_want").isNotNull())
    upto = F.sum(n).over(Window.partitionBy(*keys, "_part").orderBy(value))
    passed = inside.withColumn("_upto", F.col("_before") + upto).where(F.col("_upto") >= F.col("_want"))
    return passed.groupBy(*keys).agg(F.min(value).alias(out))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rn", salt_on: str = "ord") -> DataFrame:
    """The first ``k`` rows of each key, numbered. Beyond Spark's own group limit the key is salted first."""
    by = Window.partitionBy(*keys).orderBy(*order)
    if k > GROUP_LIMIT:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(64)))
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_pre", F.row_number().over(first)).where(F.col("_pre") <= k).drop("_pre", "_salt")
    return df.withColumn(out, F.row_number().over(by)).where(F.col(out) <= k)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; map tasks send at most one row per key."""
    return top_k(df, keys, order, 1, out="_first").drop("_first")


def last_value_before(
    df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, span: Column
) -> DataFrame:
    """Newest non-null ``value`` at or before each row; ``span`` grows with the order."""
    df = df.withColumn("_v", value).withColumn("_span", span)
    here = Window.partitionBy(*keys, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))
    carried = (
        df.groupBy(*keys, "_span").agg(newest.alias("_c"))
        .withColumn("_carry", F.last("_c", ignorenulls=True).over(earlier))
        .drop("_c")
    )
    local = df.withColumn("_here", F.last("_v", ignorenulls=True).over(here))
    return join_small(local, carried, [*keys, "_span"]).withColumn(out, F.coalesce("_here", "_carry")).drop(
        "_here", "_carry", "_v", "_span"
    )


def next_value(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, span: Column) -> DataFrame:
    """``value`` of the following row of the key; ``span`` grows with the order."""
    df = df.withColumn("_span", span)
    here = Window.partitionBy(*keys, "_span").orderBy(*order)
    later = Window.partitionBy(*keys).orderBy("_span")
    firsts = (
        df.groupBy(*keys, "_span").agg(F.min_by(value, F.struct(*order)).alias("_f"))
        .withColumn("_following", F.lead("_f").over(later))
        .drop("_f")
    )
    local = df.withColumn("_here", F.lead(F.struct(value)).over(here))
    return join_small(local, firsts, [*keys, "_span"]).withColumn(
        out, F.when(F.col("_here").isNotNull(), F.col(f"_here.{value}")).otherwise(F.col("_following"))
    ).drop("_here", "_following", "_span")


def batch_ids(df: DataFrame, keys: list[str], size: int, ord_col: str = "ord") -> DataFrame:
    """Chunks of ``size`` rows in order: batch number and position inside it, both from 0."""
    rows = number_rows(df, keys, [], ord_col, "_rn")
    at = F.col("_rn") - 1
    return rows.withColumn("batch_no", F.floor(at / size)).withColumn("batch_pos", F.pmod(at, F.lit(size))).drop("_rn")
