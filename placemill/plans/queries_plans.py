"""Registered end-to-end queries: top places, whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from placemill.plans import batch, search
from placemill.plans.queries_places import FOLD, SCORED
from placemill.plans.registry import query
from placemill.plans.samples import places_with_tags, sample, using


@query("top_places_per_search", using("places") + f", s as ({SCORED}){FOLD}" + """
, r as (select *, row_number() over (partition by search_id order by score desc, bucket_ord, first_ord) as place_rank from deduped)
select search_id, ord, segments, score, place_rank from r where place_rank <= 10""")
def top_places(spark, folder):
    return search.top_places(places_with_tags(spark, folder)).select("search_id", "ord", "segments", "score", "place_rank")


@query("region_runs", using("sheet", "claims") + """
, f as (select *, last_value(nullif(trim(country), '') ignore nulls) over (order by ord rows unbounded preceding) as filled from fx_sheet),
t as (select ord * 2 as ord, filled as country, 'city' as kind, nullif(trim(city), '') as region from f union all select ord * 2 + 1, filled, 'province', nullif(trim(province), '') from f),
u as (select *, row_number() over (partition by kind, lower(country), lower(region) order by ord) as rn from t where region is not null and country is not null),
g as (select row_number() over (order by ord) as region_ord, country, region from u where rn = 1),
c as (select place_id, min(region_ord + 1) as region_ord from fx_claims group by 1), n as (select region_ord, count(*) as k from c group by 1), m as (select region_ord + 1 as region_ord, count(*) as k from fx_claims group by 1)
select concat(rpad('done', 9, ' '), ' ', region, ', ', country, ' — ', coalesce(n.k, 0), ' place(s)', case when m.k - coalesce(n.k, 0) > 0 then concat(', ', m.k - coalesce(n.k, 0), ' duplicate(s) skipped') else '' end) as line
from g left join n using (region_ord) left join m using (region_ord) union all select concat('Unique places exported: ', count(*)) from c""")
def region_runs(spark, folder):
    results = sample(spark, folder, "claims").select(
        (F.col("region_ord") + 1).alias("region_ord"), "place_id", F.col("place_id").alias("place_rank"), F.col("place_id").alias("osm_id"), F.concat(F.lit("P"), "place_id").alias("name")
    )
    photos = sample(spark, folder, "photos").withColumn("place_id", F.col("ord"))
    return batch.export_regions(batch.regions_of(sample(spark, folder, "sheet")), results, photos)["report"].select("line")
