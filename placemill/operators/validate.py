"""Row rules: violations listed as field and message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill import dims

Rule = tuple[str, Column, str]  # field, condition that must hold, message


def between(field: str, low: float, high: float) -> Rule:
    return field, F.col(field).between(low, high), f"must lie between {low} and {high}"


def at_most(field: str, limit: int, at_least: int = 0) -> Rule:
    size = F.length(field)
    return field, (size <= limit) & (size >= at_least), f"must have {at_least} to {limit} characters"


def one_of(field: str, values: list[str]) -> Rule:
    return field, F.col(field).isin(values), "is not an allowed value"


def items_at_most(field: str, limit: int) -> Rule:
    return field, F.size(field) <= limit, f"must have at most {limit} entries"


def place_rules() -> list[Rule]:
    return [
        at_most("id", 80), one_of("osm_type", ["node", "way", "relation"]), at_most("name", 200, 1),
        between("lat", -90, 90), between("lon", -180, 180), at_most("category", 60), at_most("category_label", 80), at_most("summary", 4000),
    ]


def photo_rules() -> list[Rule]:
    return [one_of("source", list(dims.SOURCE_WEIGHTS)), at_most("title", 200), at_most("credit", 300), at_most("license", 200)]


def search_rules() -> list[Rule]:
    return [at_most("keyword", 80, 2), at_most("city", 120, 1), at_most("country", 120, 1), between("requested_limit", 0, dims.MAX_RESULTS)]


def validate_rows(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``violations``; a null field breaks no rule. Rules on absent columns are skipped."""
    checks = [
        F.when(~F.coalesce(ok, F.lit(True)), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))
        for field, ok, message in rules if field in df.columns
    ]
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    checked = validate_rows(df, rules)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)
