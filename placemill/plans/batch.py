"""A sheet of regions to exports: every region at once, the sequence kept only as ``region_ord``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill.operators import export, quality, resolve, targets


def regions_of(sheet: DataFrame) -> DataFrame:
    """Distinct numbered targets of a sheet."""
    return targets.number_targets(targets.targets_of(targets.fill_country(sheet)))


def export_regions(
    regions: DataFrame, results: DataFrame, photos: DataFrame, exported: DataFrame | None = None, allow_duplicates: bool = False
) -> dict[str, DataFrame]:
    """Claims, manifest, outcomes and report of a run.

    ``results``: region_ord, place_id, place_rank, osm_id, name; ``regions``: region_ord, country, region, and
    where known ``error`` and ``skipped``, from which a region's status follows.
    """
    found = results.select("region_ord", "place_id")
    claimed = found.distinct() if allow_duplicates else resolve.claim_across_regions(found, exported)
    fresh = results.join(claimed, ["region_ord", "place_id"]).join(regions.select("region_ord", "country", F.col("region").alias("city")), "region_ord")
    manifest = export.export_manifest(fresh.withColumn("ord", F.col("place_rank")), photos)
    ended = regions if "error" in regions.columns else regions.withColumn("error", F.lit(None).cast("string"))
    outcomes = quality.region_outcomes(found, claimed, ended)
    return {"claims": claimed, "manifest": manifest, "outcomes": outcomes, "report": export.run_report(outcomes, claimed)}
