"""Stored results: newest versions, history, bounds, and lookups as of a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill import dims
from placemill.operators.rank import first_per, last_value_before

SPAN_US = 600_000_000


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970, without a time zone."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", zero, ts.cast("timestamp_ntz"))


def cache_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.lower(F.trim(p.cast("string"))) for p in parts])


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Newest version of each result."""
    return newest_per_key(stored.unionByName(incoming, allowMissingColumns=True), ["id"])


def newest_per_key(results: DataFrame, keys: list[str]) -> DataFrame:
    return first_per(results, keys, [F.col("created_at").desc(), F.col("ord").desc()])


def live_per_key(results: DataFrame, keys: list[str], now: Column, ttl_seconds: int = dims.CACHE_TTL_SECONDS) -> DataFrame:
    """Newest version of each key younger than the time to live; old rows never reach the shuffle."""
    fresh = results.where(epoch_us(F.col("created_at")) > epoch_us(now) - ttl_seconds * 1_000_000)
    return newest_per_key(fresh, keys)


def history(results: DataFrame, n: int = 25) -> DataFrame:
    return results.orderBy(F.col("created_at").desc(), F.col("ord").desc()).limit(n)


def bounded_store(results: DataFrame, n: int = 200) -> DataFrame:
    """The newest ``n`` keys by their last save."""
    return history(newest_per_key(results, ["cache_key"]), n)


def cached_as_of(requests: DataFrame, results: DataFrame, ttl_seconds: int = dims.CACHE_TTL_SECONDS) -> DataFrame:
    """Newest result of the key at each request, null when older than the time to live.

    Requests and results are merged in time order and cut into ten-minute spans,
    so a busy key spreads over as many tasks as it has spans.
    """
    save = results.select("cache_key", "ts", "event_id", F.lit(0).alias("kind"))
    ask = requests.select("cache_key", "ts", "event_id", F.lit(1).alias("kind"))
    both = ask.unionByName(save).withColumn("us", epoch_us(F.col("ts")))
    value = F.when(F.col("kind") == 0, F.struct(F.col("us").alias("us"), F.col("event_id").alias("event_id")))
    seen = last_value_before(both, ["cache_key"], ["us", "kind", "event_id"], value, "hit", F.floor(F.col("us") / SPAN_US))
    fresh = F.when(F.col("us") - F.col("hit.us") < ttl_seconds * 1_000_000, F.col("hit"))
    return seen.where("kind = 1").select(
        "event_id", "cache_key", "ts", fresh["event_id"].alias("result_id"), (F.col("us") - fresh["us"]).alias("age_us")
    )


def clamp_limit(requested: Column, ceiling: int = dims.MAX_RESULTS) -> Column:
    """Results wanted: within 1..ceiling; nothing or 0 means all."""
    return F.least(F.greatest(F.coalesce(F.when(requested != 0, requested), F.lit(ceiling)), F.lit(1)), F.lit(ceiling))


def fetch_sizes(limit: Column) -> Column:
    """How many rows each discovery source is asked for."""
    return F.struct(
        F.least(F.lit(3000), F.greatest(limit * 6, F.lit(150))).alias("overpass"),
        F.least(limit * 3, F.lit(120)).alias("wikidata"),
        F.least(limit, F.lit(40)).alias("nominatim"),
    )
