"""Views that give the sample tables the shape of place data.

Each view is a list of expressions over one table, valid in Spark SQL and in
DuckDB alike, so both sides of a comparison start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.functions.tags import tag_map


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


VIEWS: dict[str, tuple[str, list[str]]] = {}

VIEWS["places"] = ("part", [
    "p_partkey % 5 as search_id", "p_partkey as ord", "concat('node/', p_partkey) as id", "p_name as name",
    "cast(24.8 + p_size * 0.0005 as double) as lat", "cast(67.0 + (p_partkey % 40) * 0.0005 as double) as lon",
    "case p_partkey % 3 when 0 then 'overpass' when 1 then 'wikidata' else 'nominatim' end as source",
    "case when p_partkey % 7 = 0 then 'relation' else 'node' end as osm_type",
    "case when p_type = 'PROMO' then p_brand end as brand",
    "case p_type when 'ECONOMY' then 'cafe' when 'MEDIUM' then 'museum' when 'STANDARD' then 'library' "
    "when 'SMALL' then 'bank' when 'LARGE' then 'university' else 'restaurant' end as amenity",
    "case when p_partkey % 4 = 0 then concat('Q', p_partkey) end as wikidata",
    "case when p_partkey % 6 = 0 then concat('en:', p_name) end as wikipedia",
    "case when p_partkey % 5 = 0 then concat('https://p', p_partkey, '.example.org') end as website",
    "case when p_partkey % 9 = 0 then concat('+92 21 ', p_partkey) end as phone",
    "case when p_partkey % 8 = 0 then 'Mo-Fr 09:00-17:00' end as opening_hours",
])

# The same rows with names in two scripts and a wider choice of tags.
VIEWS["rich"] = ("part", [
    "p_partkey % 5 as search_id", "p_partkey as ord", "p_partkey as osm_id", "concat('node/', p_partkey) as id",
    "cast(24.8 + p_size * 0.0005 as double) as lat", "cast(67.0 - (p_partkey % 40) * 0.0005 as double) as lon",
    "case p_partkey % 10 when 0 then concat('博物馆', p_partkey) when 5 then concat('  ', p_name, ' Café ') "
    "when 7 then null else p_name end as name",
    "case when p_partkey % 20 = 0 then concat(p_name, ' Hall') when p_partkey % 40 = 7 then concat(p_name, ' Spot') end as name_en",
    "case when p_partkey % 30 = 10 then concat(p_name, ' Int') end as int_name",
    "case when p_size % 9 = 0 then concat('Op ', p_brand) end as operator",
    "case when p_type = 'PROMO' then p_brand end as brand",
    "case p_type when 'ECONOMY' then 'fast_food' when 'MEDIUM' then 'museum' when 'STANDARD' then 'yes' "
    "when 'SMALL' then 'bank' when 'LARGE' then 'arts_centre' end as amenity",
    "case when p_size % 4 = 0 then 'art-deco_house' end as tourism",
    "case when p_partkey % 13 = 0 then concat('A fine   place, no. ', p_partkey) end as description",
    "case when p_partkey % 4 = 0 then concat(' Q', p_partkey, ' ') end as wikidata",
    "case p_partkey % 12 when 0 then concat('De:', p_name) when 6 then p_name when 3 then 'fr:Tour (x)!' end as wikipedia",
    "case p_partkey % 15 when 0 then concat('https://p', p_partkey, '.example.org/a?b=c') when 5 then concat('p', p_partkey, '.example.org') "
    "when 10 then 'ftp://files.example.org' when 3 then 'https://bad host/x' end as website",
    "case when p_partkey % 9 = 0 then concat('+92 21 ', p_partkey) end as phone",
    "case when p_partkey % 11 = 0 then concat('m', p_partkey, '@example.org') end as email",
    "case when p_partkey % 8 = 0 then 'Mo-Fr 09:00-17:00' end as opening_hours",
    "case when p_partkey % 7 = 0 then concat('Street ', p_size) end as street",
    "case when p_partkey % 14 = 0 then cast(p_size as varchar(10)) end as housenumber",
    "case when p_partkey % 3 = 0 then concat('Ward ', p_size) end as suburb",
    "case when p_partkey % 2 = 0 then 'Karachi' end as addr_city",
    "case when p_partkey % 21 = 0 then 'coffee;tea' end as cuisine",
    "case when p_partkey % 22 = 0 then 'sikh' end as religion",
    "case when p_partkey % 23 = 0 then '1851' end as start_date",
    "case when p_partkey % 25 = 0 then '4' end as stars",
    "case when p_partkey % 6 = 0 then 'yes' when p_partkey % 6 = 1 then 'no' end as wheelchair",
    "case p_partkey % 7 when 0 then 'relation' when 1 then 'way' else 'node' end as osm_type",
    "case p_partkey % 6 when 0 then 'CN' when 1 then 'pk' when 2 then ' De ' when 3 then 'zz' end as addr_country",
])

VIEWS["photos"] = ("orders", [
    "o_orderkey as photo_id", "o_orderkey as ord",
    "cast(24.7 + (o_orderkey % 50) * 0.005 as double) as lat", "cast(66.9 + (o_custkey % 40) * 0.005 as double) as lon",
    "concat('node/', o_custkey % 200) as place_id", "800 + (o_orderkey % 30) * 100 as width",
    "case o_orderstatus when 'F' then 'wikidata' when 'O' then 'commons-category' else 'openverse' end as source",
    "case o_orderkey % 5 when 0 then 'image/svg+xml' when 1 then 'image/png' else 'image/jpeg' end as mime",
    "concat('https://upload.wikimedia.org/x/', 640 + o_orderkey % 3, 'px-Photo_', o_custkey % 300, '.jpg?w=', o_orderkey % 7) as url",
    "concat('Photo of place ', o_custkey % 120, ' ', o_orderkey % 4, '.jpg') as title",
    "case when o_orderkey % 3 = 0 then concat('<b>Ann</b> ', o_custkey) end as credit",
    "case when o_orderkey % 2 = 0 then 'CC BY 4.0' end as license",
])

VIEWS["claims"] = ("lineitem", ["l_suppkey % 25 as region_ord", "l_partkey as place_id"])

VIEWS["entity_claims"] = ("lineitem", [
    "concat('Q', l_suppkey) as entity_id", "(l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as ord",
    "case l_linenumber when 1 then 'P31' when 2 then 'P571' when 3 then 'P84' when 4 then 'P2048' "
    "when 5 then 'P1174' when 6 then 'P131' else 'P17' end as property",
    "case l_linenumber when 2 then 'time' when 4 then 'quantity' when 5 then 'quantity' else 'wikibase-entityid' end as datatype",
    "case l_linenumber when 2 then concat('+', 1800 + l_partkey % 200, case when l_partkey % 2 = 0 then '-00-00' else '-07-04' end, 'T00:00:00Z') "
    "when 4 then concat('+', l_partkey) when 5 then concat('+', l_partkey) else concat('Q', l_partkey) end as value",
])

VIEWS["labels_of"] = ("part", [
    "concat('Q', p_partkey) as entity_id",
    "case when p_partkey % 3 <> 0 then case when p_partkey % 7 = 0 then concat('塔', p_partkey) else p_name end end as label",
    "case when p_partkey % 5 = 0 then concat(p_name, ' alias') end as alias",
])

VIEWS["edges"] = ("part", ["p_partkey as child", "cast(floor(p_partkey / 3) as bigint) as parent"])

VIEWS["needles"] = ("benchmark", ["item_id as place_id", "item_id as ord", "split_part(text, '.', 1) as name"])

# A stored response: reasoning noise, fences, a cut-off block, or plain records.
VIEWS["completions"] = ("conversations", [
    "conv_id as batch_id", "turn as pos",
    "case turn % 4 when 0 then concat('<think>1. noise [', turn, ']</think>', '[', {obj}, ']') "
    "when 1 then concat(repeat('`', 3), 'json', '[', {obj}, ']', repeat('`', 3)) "
    "when 2 then concat('<think>cut ', turn) else concat('[', {obj}, ']') end as raw",
])
_OBJ = (
    "concat('{{\"i\":', turn, ',\"keep\":', case when turn % 3 = 0 then 'false' else 'true' end, "
    "',\"name\":\"n', conv_id % 50, ' x', turn, '\",\"score\":', (turn * 17 + conv_id) % 101, '}}')"
)
VIEWS["completions"] = ("conversations", [e.replace("{obj}", _OBJ).replace("{{", "{").replace("}}", "}") for e in VIEWS["completions"][1]])

# One response per conversation text: a numbered list holding the text's words.
VIEWS["numbered"] = ("conversations", [
    "conv_id as batch_id", "turn as pos",
    "concat(turn + 1, '. ', split_part(text, ' ', 1), chr(10), ' ', turn + 2, ') \"', split_part(text, ' ', 2), '\"', chr(10), 'no number') as raw",
])

VIEWS["hours"] = ("events", [
    "event_id",
    "case event_id % 6 when 0 then null when 1 then 'Th-Tu 10:00-17:00' when 2 then 'Mo-Fr 09:00-17:00' "
    "when 3 then '24/7' when 4 then '10:00-23:00' else 'Mo,We,Fr 09:00-12:00' end as tag",
    "case event_id % 7 when 0 then 'A museum. Open Monday to Friday from 09:00 to 17:00.' "
    "when 1 then 'A park with open green space.' when 2 then 'A site. Open daily from 10:00 to 23:00.' "
    "when 3 then 'A hall. Open weekends only. It is old.' when 4 then 'A cafe. Closed Wednesday. Good tea!' "
    "when 5 then concat('A fort. Opens 9:00. Built in ', 1800 + user_id, '.') else '' end as summary",
])

# Articles: first line as overview, the remaining lines as history, the whole text again as visitor notes.
VIEWS["articles"] = ("documents", [
    "doc_id", "lang", "source", "n_chars", "split_part(text, chr(10), 1) as overview",
    "case when n_chars > 2000 then substr(text, length(split_part(text, chr(10), 1)) + 2) end as history",
    "case when doc_id % 3 = 0 then text end as visiting",
    "case when doc_id % 4 = 0 then 0 else 1 end as llm_generated",
])

VIEWS["geocode"] = ("customer", [
    "c_nationkey as query_id", "c_custkey as ord",
    "case c_custkey % 3 when 0 then 'relation' when 1 then 'way' else 'node' end as osm_type",
    "3600 + c_custkey as osm_id",
    "case c_mktsegment when 'BUILDING' then 'boundary' when 'MACHINERY' then 'place' else 'amenity' end as class",
    "case c_custkey % 5 when 0 then 'city' when 1 then 'administrative' else 'cafe' end as type",
    "case when c_custkey % 4 = 0 then 2 else 1 end as attempt",
])

VIEWS["links"] = ("supplier", [
    "s_suppkey as ord", "case when s_suppkey % 17 = 0 then '' else concat(s_name, ' (x)!') end as name",
    "case when s_suppkey % 34 = 0 then '' else concat('City  ', s_nationkey) end as city",
    "case s_nationkey % 5 when 0 then 'CN' when 1 then 'hk' when 2 then 'PK' when 3 then 'MO' end as country_code",
])

VIEWS["searches"] = ("orders", [
    "o_orderkey as search_id", "case when o_orderkey % 7 = 0 then null else o_orderkey % 400 end as requested_limit",
    "o_custkey as key_id", "o_orderdate as ts",
])

# Keywords as users type them, one per order: category words, their plurals, free words.
VIEWS["keywords"] = ("orders", [
    "o_orderkey as ord",
    "case o_orderkey % 12 when 0 then 'Museums' when 1 then 'tourist places' when 2 then 'coffee' when 3 then 'fast food  joints' "
    "when 4 then 'historical sites' when 5 then 'uni' when 6 then 'police station' when 7 then concat('xylophone ', o_custkey % 50) "
    "when 8 then 'Bus  Station' when 9 then 'bar' when 10 then concat(lower(o_orderpriority), ' report') else '' end as keyword",
])

VIEWS["cache_ops"] = ("events", [
    "event_id", "ts", "concat('u', user_id) as cache_key",
    "case when event_type = 'view' then 'save' when event_type = 'click' then 'get' end as op",
])

VIEWS["progress"] = ("events", [
    "concat('u', user_id) as id", "ts", "event_id as ord",
    "case event_type when 'signup' then 'starting' when 'view' then 'discovering' when 'click' then 'filtering' "
    "when 'purchase' then 'done' else 'failed' end as stage",
])

# A sheet of regions, one row per supplier: a country only where its block starts.
VIEWS["sheet"] = ("supplier", [
    "s_suppkey as ord",
    "case when s_suppkey % 6 = 3 then concat('Country ', s_nationkey % 4) end as country",
    "case when s_suppkey % 5 <> 4 then concat('City ', s_nationkey) end as city",
    "case when s_suppkey % 4 = 0 then concat('province ', s_nationkey % 7) end as province",
    "case s_suppkey % 9 when 4 then 'museums' when 8 then ' ' end as attributes",
    "case s_suppkey % 8 when 2 then 'no path' when 5 then concat('/data/run', s_suppkey) when 6 then concat('C:', chr(92), 'out') end as path",
    "case when s_suppkey % 2 = 0 then concat('see https://src', s_suppkey % 13, '.example.org/a), ok') "
    "when s_suppkey % 7 = 0 then 'ftp://src.example.org' end as add_source",
])

BASE_FILTER = {"cache_ops": "event_type in ('view', 'click')", "edges": "p_partkey > 0"}


def sample(spark: SparkSession, folder: str, name: str) -> DataFrame:
    base, exprs = VIEWS[name]
    df = table(spark, folder, base)
    if name in BASE_FILTER:
        df = df.where(BASE_FILTER[name])
    df = df.selectExpr(*exprs)
    return df.distinct() if name == "claims" else df


def view_sql(name: str) -> str:
    base, exprs = VIEWS[name]
    where = f" where {BASE_FILTER[name]}" if name in BASE_FILTER else ""
    unique = "distinct " if name == "claims" else ""
    return f"select {unique}{', '.join(exprs)} from {base}{where}"


def using(*names: str, recursive: bool = False) -> str:
    """``with`` clause that defines the named views as fx_<name>."""
    head = "with recursive " if recursive else "with "
    return head + ", ".join(f"fx_{n} as ({view_sql(n)})" for n in names) + " "


def place_tags() -> Column:
    """Tag map of the ``places`` view."""
    keys = "name brand amenity wikidata wikipedia website phone opening_hours".split()
    return tag_map(**{k: F.col(k) for k in keys})


def places_with_tags(spark: SparkSession, folder: str) -> DataFrame:
    return sample(spark, folder, "places").select(
        "search_id", "ord", "id", "name", "lat", "lon", "source", "osm_type", place_tags().alias("tags")
    )


RICH_KEYS = {
    "name": "name", "name__en": "name_en", "int_name": "int_name", "operator": "operator", "brand": "brand",
    "amenity": "amenity", "tourism": "tourism", "description": "description", "wikidata": "wikidata",
    "wikipedia": "wikipedia", "website": "website", "phone": "phone", "email": "email",
    "opening_hours": "opening_hours", "addr__street": "street", "addr__housenumber": "housenumber",
    "addr__suburb": "suburb", "addr__city": "addr_city", "cuisine": "cuisine", "religion": "religion",
    "start_date": "start_date", "stars": "stars", "wheelchair": "wheelchair", "addr__country": "addr_country",
}


def rich_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Raw map elements: type, id, coordinates (own or centre only), tags."""
    df = sample(spark, folder, "rich")
    own = F.col("ord") % 3 != 0
    return df.select(
        "search_id", "ord", F.col("osm_type").alias("type"), F.col("osm_id").alias("id"),
        F.when(own, F.col("lat")).alias("lat"), F.when(own, F.col("lon")).alias("lon"),
        F.when(F.col("ord") % 6 != 3, F.struct("lat", "lon")).alias("center"),
        tag_map(**{k: F.col(v) for k, v in RICH_KEYS.items()}).alias("tags"),
    )


def rich_places(spark: SparkSession, folder: str) -> DataFrame:
    from placemill.sources.readers import osm_places

    return osm_places(rich_elements(spark, folder), F.lit("Place"), F.lit("custom"))
