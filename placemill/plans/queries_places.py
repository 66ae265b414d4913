"""Registered queries over place records: names, scores, selection, duplicates, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from placemill import dims
from placemill.functions import geo, tags as tg, text as tx
from placemill.operators import export, quality, resolve, score, select, validate
from placemill.operators.rank import batch_ids, number_rows
from placemill.plans.registry import query
from placemill.plans.samples import places_with_tags, rich_elements, rich_places, sample, table, using
from placemill.session import written

# --- SQL fragments shared by the checks --------------------------------------

# Tag presence of the ``places`` view; s_* are the parts of the information score.
SCORED = """
  select *, (1 + (brand is not null)::int + 1 + (wikidata is not null)::int + (wikipedia is not null)::int
    + (website is not null)::int + (phone is not null)::int + (opening_hours is not null)::int) as n_tags,
    (8 * (wikidata is not null)::int + 6 * (wikipedia is not null)::int + 4 * (website is not null)::int
    + 4 * (phone is not null)::int + (osm_type <> 'node')::int) as bonus,
    (brand is not null or amenity in ('cafe', 'bank', 'restaurant')) as chain,
    regexp_replace(lower(name), '[^a-z0-9\\x{3400}-\\x{9FFF}]+', '', 'g') as name_key
  from fx_places"""

KM = "2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + pow(sin(radians({b}.lon - {a}.lon) / 2), 2) * cos(radians({a}.lat)) * cos(radians({b}.lat)))))"

CLEAN = (
    "trim(regexp_replace(regexp_replace({c}, '[\\x00-\\x1F\\x7F-\\x{{9F}}\\x{{A0}}\\x{{2007}}\\x{{202F}}\\x{{FEFF}}]', ' ', 'g'), "
    "'[\\s\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+', ' ', 'g'))"
)


def clean(c: str) -> str:
    return CLEAN.format(c=c)


def non_latin(c: str) -> str:
    return (
        f"coalesce(length(regexp_replace({c}, '[\\x00-\\x{{24F}}]', '', 'g')) * 1.0 "
        f"/ nullif(length(regexp_replace({c}, '[\\x00-\\x20]', '', 'g')), 0) > 0.3, false)"
    )


# Names of the ``rich`` view as they arrive, and the one chosen for display.
NAMED = f"""
  select *, nullif({clean('name')}, '') as local_name, coalesce(name_en, int_name) as latin from fx_rich"""
CHOSEN = f"""
  select *, case when {non_latin('local_name')} and latin is not null then latin
    else coalesce(local_name, latin, operator, brand) end as chosen from named"""
PLACED = """
  select *, search_id, 'x' as k from chosen where chosen is not null and not (ord % 3 = 0 and ord % 6 = 3)"""
RICH = using("rich") + f", named as ({NAMED}), chosen as ({CHOSEN}), placed as ({PLACED}) "


# --- B: names, coordinates, filters --------------------------------------------

@query("b1_preferred_name", RICH + "select ord, chosen as name from chosen")
def b1(spark, folder):
    return rich_elements(spark, folder).select("ord", tg.preferred_name(F.col("tags")).alias("name"))


@query("b2_coords", using("rich") + """
select ord, case when ord % 3 <> 0 or ord % 6 <> 3 then round(lat, 6) end as lat,
  case when ord % 3 <> 0 or ord % 6 <> 3 then round(lon, 6) end as lon from fx_rich""")
def b2(spark, folder):
    at = geo.coords(F.col("lat"), F.col("lon"), F.col("center"))
    rows = rich_elements(spark, folder).select("ord", at.alias("at"))
    return rows.select("ord", F.round("at.lat", 6).alias("lat"), F.round("at.lon", 6).alias("lon"))


@query("b3_drop_unplaced", RICH + "select search_id, count(*) as n, sum(ord)::bigint as ords from placed group by search_id")
def b3(spark, folder):
    return rich_places(spark, folder).groupBy("search_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ord").alias("ords"))


@query("b4_keep_local_name", RICH + """
select ord, chosen as name, case when local_name is not null and local_name <> chosen then local_name end as local from placed""")
def b4(spark, folder):
    return rich_places(spark, folder).select("ord", "name", F.col("tags")["name:local"].alias("local"))


@query("b5_filter_by_selectors", using("rich") + """
, hit as (select unnest(
  case amenity when 'fast_food' then ['restaurant'] when 'bank' then ['bank'] when 'arts_centre' then ['cinema'] else [] end) as category, ord from fx_rich)
select category, count(*) as n, sum(ord)::bigint as ords from hit group by category""")
def b5(spark, folder):
    rows = rich_elements(spark, folder).withColumn("category", F.explode(select.matching_categories(F.col("tags"))))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("ord").alias("ords"))


@query("b6_filter_generic", using("rich") + """
select ord from fx_rich where regexp_matches(coalesce(amenity, ''), '(?i)art.*house') or regexp_matches(coalesce(tourism, ''), '(?i)art.*house')
  or regexp_matches(coalesce(name, ''), '(?i)art.*house')""")
def b6(spark, folder):
    return select.filter_generic(rich_elements(spark, folder), "  Art   HOUSE!").select("ord")


@query("b7_within_area", using("places") + """
select search_id, ord from fx_places where (search_id = 0 and lat between 24.803 and 24.81 and lon between 67.002 and 67.015)
  or (search_id = 1 and lat between 24.8 and 24.82 and lon between 67.0 and 67.005)
  or (search_id = 2 and osm_type = 'relation')""")
def b7(spark, folder):
    places = places_with_tags(spark, folder)
    areas = spark.sql(
        "select * from values (0L, cast(null as bigint), 24.803D, 67.002D, 24.81D, 67.015D), "
        "(1L, null, 24.8D, 67.0D, 24.82D, 67.005D), (2L, 3600000007L, 0D, 0D, 0D, 0D) as t(search_id, area_id, south, west, north, east)"
    )
    members = places.where("osm_type = 'relation'").select(F.lit(3600000007).alias("area_id"), "id")
    return select.within_area(places, areas, members).select("search_id", "ord")


@query("b10_keep_heuristic", RICH + "select search_id, count(*) filter (where length(chosen) > 1) as kept, count(*) as n from placed group by search_id")
def b10(spark, folder):
    return rich_places(spark, folder).groupBy("search_id").agg(
        F.count_if(F.length("name") > 1).alias("kept"), F.count(F.lit(1)).alias("n")
    )


@query("b16_clamp_limit", using("searches") + """
select search_id, least(greatest(coalesce(nullif(requested_limit, 0), 300), 1), 300) as max_rows,
  least(3000, greatest(6 * least(greatest(coalesce(nullif(requested_limit, 0), 300), 1), 300), 150)) as fetch from fx_searches""")
def b16(spark, folder):
    from placemill.operators.store import clamp_limit, fetch_sizes

    limit = clamp_limit(F.col("requested_limit"))
    return sample(spark, folder, "searches").select("search_id", limit.alias("max_rows"), fetch_sizes(limit)["overpass"].alias("fetch"))


@query("b17_validate_rows", """
with rows as (select p_partkey as ord, p_partkey * 0.05 - 5 as lat, case when p_partkey % 50 = 0 then repeat(p_name, 30) when p_partkey % 61 = 0 then '' else p_name end as name,
    case p_partkey % 5 when 4 then 'area' else 'node' end as osm_type from part)
select ord, trim(concat(case when not osm_type in ('node', 'way', 'relation') then 'osm_type ' else '' end,
  case when length(name) > 200 or length(name) < 1 then 'name ' else '' end, case when not lat between -90 and 90 then 'lat' else '' end)) as fields
from rows where not osm_type in ('node', 'way', 'relation') or length(name) > 200 or length(name) < 1 or not lat between -90 and 90""")
def b17(spark, folder):
    rows = table(spark, folder, "part").selectExpr(
        "p_partkey as ord", "cast(p_partkey * 0.05 - 5 as double) as lat",
        "case when p_partkey % 50 = 0 then repeat(p_name, 30) when p_partkey % 61 = 0 then '' else p_name end as name",
        "case p_partkey % 5 when 4 then 'area' else 'node' end as osm_type",
    )
    _, bad = validate.split_valid(rows, validate.place_rules())
    return bad.select("ord", F.array_join("violations.field", " ").alias("fields"))


@query("b20_whitelist_tags", RICH + f"""
select ord, {clean('description')} as description, {clean('name')} as name, null::varchar as addr_country,
  (local_name is not null or coalesce({clean('name')}, '') <> '')::int + (name_en is not null)::int + (int_name is not null)::int + (operator is not null)::int
  + (brand is not null)::int + (amenity is not null)::int + (tourism is not null)::int + (description is not null)::int + (wikidata is not null)::int
  + (wikipedia is not null)::int + (website is not null)::int + (phone is not null)::int + (email is not null)::int + (opening_hours is not null)::int
  + (street is not null)::int + (housenumber is not null)::int + (suburb is not null)::int + (addr_city is not null)::int + (cuisine is not null)::int
  + (religion is not null)::int + (start_date is not null)::int + (stars is not null)::int + (wheelchair is not null)::int as n_tags
from chosen""")
def b20(spark, folder):
    kept = tg.whitelist_tags(F.col("tags"))
    return rich_elements(spark, folder).select(
        "ord", kept["description"].alias("description"), kept["name"].alias("name"),
        kept["addr:country"].alias("addr_country"), F.size(kept).alias("n_tags"),
    )


@query("b21_first_tags", using("rich") + """
select ord, array_to_string(list_sort(list_filter([
  case when amenity is not null then concat('amenity=', amenity) end, case when phone is not null then concat('phone=', phone) end,
  case when tourism is not null then concat('tourism=', tourism) end, case when wheelchair is not null then concat('wheelchair=', wheelchair) end],
  lambda x: x is not null))[1:3], ',') as tags from fx_rich""")
def b21(spark, folder):
    df = sample(spark, folder, "rich").select(
        "ord", tg.tag_map(amenity=F.col("amenity"), phone=F.col("phone"), tourism=F.col("tourism"), wheelchair=F.col("wheelchair"),
                          source__x=F.lit("s"), ref__y=F.lit("r")).alias("tags")
    )
    first = F.transform(tg.first_tags(F.col("tags"), 3), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return df.select("ord", F.array_join(first, ",").alias("tags"))


# --- I: scores, links, labels, coordinates -------------------------------------

@query("i2_sanitize_path_segment", """
with raw as (select p_partkey as ord, case p_partkey % 8 when 0 then concat('a/b:', p_name, '..', p_brand) when 1 then concat('..', p_name, '. ') when 2 then 'Con'
  when 3 then repeat(concat(p_name, '. '), 12) when 4 then '???' when 5 then concat(p_name, chr(9), chr(10), 'x') else concat('Café ', p_name) end as s from part),
a as (select ord, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(s), '[\\x00-\\x1F\\x7F-\\x{9F}]', ' ', 'g'), '[<>:"/\\\\|?*]', ' ', 'g'), '\\.{2,}', '.', 'g'), '\\s+', ' ', 'g')) as s from raw),
b as (select ord, regexp_replace(regexp_replace(s, '^[.\\s]+', ''), '[.\\s]+$', '') as s from a),
c as (select ord, case when length(s) > 80 then trim(regexp_replace(s[1:80], '[.\\s]+$', '')) else s end as s from b)
select ord, case when lower(s) = 'con' then concat(s, '_') when s = '' then 'unnamed' else s end as segment from c""")
def i2(spark, folder):
    raw = table(spark, folder, "part").selectExpr(
        "p_partkey as ord",
        "case p_partkey % 8 when 0 then concat('a/b:', p_name, '..', p_brand) when 1 then concat('..', p_name, '. ') when 2 then 'Con' "
        "when 3 then repeat(concat(p_name, '. '), 12) when 4 then '???' when 5 then concat(p_name, char(9), char(10), 'x') else concat('Café ', p_name) end as s",
    )
    return raw.select("ord", tx.sanitize_path_segment(F.col("s")).alias("segment"))


@query("i6_slug", using("rich") + """
select ord, coalesce(nullif(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')[1:60], ''), replace(id, '/', '-')) as slug
from fx_rich where name is not null""")
def i6(spark, folder):
    return sample(spark, folder, "rich").where("name is not null").select("ord", tx.slug(F.col("name"), F.col("id")).alias("slug"))


_TITLED = "array_to_string(list_transform(string_split({c}, ' '), lambda w: concat(upper(w[1:1]), w[2:])), ' ')"


@query("i7_to_title_case", "select p_partkey as ord, " + _TITLED.format(c="p_name") + " || '-' || upper(p_type[1:1]) || lower(p_type[2:]) || ' A_b éX' as title from part")
def i7(spark, folder):
    s = F.concat("p_name", F.lit("-"), F.lower("p_type"), F.lit(" a_b éx"))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("ord"), tx.to_title_case(s).alias("title"))


@query("i8_label_from_tags", using("rich") + """
select ord, case when amenity is not null and amenity <> 'yes' then case amenity when 'fast_food' then 'Fast Food' when 'arts_centre' then 'Arts Centre'
  when 'museum' then 'Museum' else 'Bank' end when tourism is not null then 'Art-Deco House' else 'Place' end as label from fx_rich""")
def i8(spark, folder):
    return rich_elements(spark, folder).select("ord", tg.label_from_tags(F.col("tags"), F.lit("Place")).alias("label"))


@query("i9_label_from_types", """
select p_partkey as ord, case when p_partkey % 4 = 0 then 'custom' else lower(p_type) || '_shop' end as id,
  case when p_partkey % 4 = 0 then 'Place' else p_type[1:1] || lower(p_type[2:]) || ' shop' end as label from part""")
def i9(spark, folder):
    kinds = F.expr(
        "case when p_partkey % 4 = 0 then array('point_of_interest', 'premise') else array('establishment', concat(lower(p_type), '_shop'), 'x') end"
    )
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("ord"), tg.label_from_types(kinds).alias("l"))
    return rows.select("ord", "l.id", "l.label")


@query("i17_safe_website", using("rich") + """
select ord, case p_site when 1 then website when 2 then 'https://' || website when 3 then null when 4 then 'https://' || website end as website
from (select *, case ord % 15 when 0 then 1 when 5 then 2 when 10 then 4 when 3 then 3 end as p_site from fx_rich)""")
def i17(spark, folder):
    # 'ftp://...' has no known scheme, so https:// is put in front.
    return sample(spark, folder, "rich").select("ord", tg.safe_website(F.col("website")).alias("website"))


_ADDRESS = """array_to_string(list_filter([nullif(concat_ws(' ', housenumber, street), ''), suburb, addr_city], lambda x: x is not null), ', ')"""


@query("i18_extract_contact", using("rich") + f"""
select ord, phone, email, nullif({_ADDRESS}, '') as address, opening_hours from fx_rich""")
def i18(spark, folder):
    rows = rich_elements(spark, folder).select("ord", tg.extract_contact(F.col("tags")).alias("c"))
    return rows.select("ord", "c.phone", "c.email", "c.address", "c.opening_hours")


_ENC = "replace(replace(replace(replace(url_encode({c}), '%28', '('), '%29', ')'), '%21', '!'), '+', '%20')"


@query("i19_url_builders", using("rich") + f"""
select ord, case ord % 12 when 0 then 'https://de.wikipedia.org/wiki/' || url_encode(replace(split_part(wikipedia, ':', 2), ' ', '_'))
  when 6 then 'https://en.wikipedia.org/wiki/' || url_encode(replace(wikipedia, ' ', '_'))
  when 3 then 'https://fr.wikipedia.org/wiki/Tour_(x)!' end as article_url,
  case when wikidata is not null then 'https://www.wikidata.org/wiki/' || trim(wikidata) end as entity_url,
  'https://www.openstreetmap.org/' || osm_type || '/' || osm_id as osm_url,
  'https://www.google.com/maps/search/?api=1&query=' || {_ENC.format(c="concat(coalesce(name_en, 'x'), ' ', osm_id, case osm_id % 3 when 0 then '.5,-67.25' when 1 then ',-67' else '.25,0.00012' end)")} as map_url from fx_rich""")
def i19(spark, folder):
    """Coordinates with a fraction, whole ones, and one so small that a double is written with an exponent."""
    df = sample(spark, folder, "rich")
    by_id = lambda *values: F.get(F.array(*[F.lit(v).cast("double") for v in values]), (F.col("osm_id") % 3).cast("int"))
    return df.select(
        "ord", tg.article_url(F.col("wikipedia")).alias("article_url"), tg.entity_url(F.col("wikidata")).alias("entity_url"),
        tg.osm_url(F.col("osm_type"), F.col("osm_id")).alias("osm_url"),
        tg.map_url(F.coalesce("name_en", F.lit("x")), F.col("osm_id") + by_id(0.5, 0.0, 0.25), by_id(-67.25, -67.0, 0.00012)).alias("map_url"),
    )


@query("i23_haversine", using("places") + f"""
, centre as (select search_id, avg(lat) as lat, min(lon) as lon from fx_places group by search_id)
select p.ord, round({KM.format(a='p', b='c')}, 4) as metres from fx_places p join centre c on p.search_id = c.search_id""")
def i23(spark, folder):
    places = sample(spark, folder, "places")
    centre = places.groupBy("search_id").agg(F.avg("lat").alias("_lat"), F.min("lon").alias("_lon"))
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    return places.join(centre, "search_id").select("ord", F.round(d, 4).alias("metres"))


@query("i24_information_score", using("places") + f", s as ({SCORED}) select ord, n_tags + bonus as score from s")
def i24(spark, folder):
    return score.with_information_score(places_with_tags(spark, folder)).select("ord", "score")


@query("i25_heuristic_score", using("rich") + """
select ord, least(100, 40 + 15 * (wikidata is not null)::int + 10 * (wikipedia is not null)::int + 8 * (description is not null)::int + 8 * (website is not null)::int
  + 7 * (phone is not null)::int + 6 * (street is not null)::int + 3 * (opening_hours is not null)::int + 3 * (operator is not null or brand is not null)::int
  + 3 * (osm_type <> 'node')::int) as score from fx_rich""")
def i25(spark, folder):
    return rich_elements(spark, folder).select("ord", tg.heuristic_score(F.col("tags"), F.col("type")).alias("score"))


@query("i26_rating_score", "select p_partkey as ord, case when p_partkey % 9 = 0 then 50 else cast(floor(p_size / 10.0 * 20 + 0.5) as int) end as score from part")
def i26(spark, folder):
    rating = F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") / 10.0)
    return table(spark, folder, "part").select(F.col("p_partkey").alias("ord"), tg.rating_score(rating).alias("score"))


@query("i27_hash31", """
select p_partkey as ord, list_reduce(list_transform(string_split(concat(p_name, '-', p_partkey), ''), lambda c: ascii(c)::hugeint),
  lambda h, c: (h * 31 + c) % 4294967296, 0::hugeint)::bigint as hash from part""")
def i27(spark, folder):
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("ord"), tx.hash31(F.concat_ws("-", "p_name", F.col("p_partkey").cast("string"))).alias("hash")
    )


@query("i28_area_id", using("geocode") + """
select ord, case osm_type when 'relation' then 3600000000 + osm_id when 'way' then 2400000000 + osm_id end as area_id from fx_geocode""")
def i28(spark, folder):
    return sample(spark, folder, "geocode").select("ord", geo.area_id(F.col("osm_type"), F.col("osm_id")).alias("area_id"))


@query("i31_format_coordinate", """
select p_partkey as ord, concat(printf('%.6f', p_size * 0.25), '° N, ', printf('%.6f', p_partkey * 0.125), '° ', case when p_partkey = 0 then 'E' else 'W' end,
  '  (', printf('%.6f', p_size * 0.25), ', ', case when p_partkey = 0 then '' else '-' end, printf('%.6f', p_partkey * 0.125), ')') as shown from part""")
def i31(spark, folder):
    lat, lon = (F.col("p_size") * F.lit(0.25)).cast("double"), (-F.col("p_partkey") * F.lit(0.125)).cast("double")
    return table(spark, folder, "part").select(F.col("p_partkey").alias("ord"), geo.format_coordinate(lat, lon).alias("shown"))


@query("i39_parse_point", """
select p_partkey as ord, case when p_partkey % 6 = 0 then null else (p_size * 0.5)::double end as lat, case when p_partkey % 6 = 0 then null else (0.0 - p_partkey * 0.25)::double end as lon from part""")
def i39(spark, folder):
    wkt = F.expr(
        "case when p_partkey % 6 = 0 then concat('Point(', p_partkey, ')') "
        "else concat('POINT( ', cast(-p_partkey * 0.25 as string), '  ', cast(p_size * 0.5 as string), ' )') end"
    )
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("ord"), geo.parse_point(wkt).alias("at"))
    return rows.select("ord", "at.lat", "at.lon")


@query("i40_parse_lang_title", using("rich") + """
select ord, case ord % 12 when 0 then 'de' when 3 then 'fr' when 6 then 'en' end as lang,
  case ord % 12 when 0 then split_part(wikipedia, ':', 2) when 3 then 'Tour (x)!' when 6 then wikipedia end as title from fx_rich""")
def i40(spark, folder):
    rows = sample(spark, folder, "rich").select("ord", tg.lang_title(F.col("wikipedia")).alias("t"))
    return rows.select("ord", "t.lang", "t.title")


@query("i41_language_for_country", using("rich") + """
select ord, case lower(trim(addr_country)) when 'cn' then 'zh' when 'pk' then 'ur' when 'de' then 'de' end as lang from fx_rich""")
def i41(spark, folder):
    return sample(spark, folder, "rich").select("ord", tg.language_for_country(F.col("addr_country")).alias("lang"))


@query("i42_map_functions", using("rich") + """
select ord, (operator is not null)::int + (street is not null)::int + 1 as n, coalesce(street, 'none') as street,
  case when street is not null then 1 else 0 end as prefixed from fx_rich""")
def i42(spark, folder):
    df = sample(spark, folder, "rich").select("ord", tg.tag_map(operator=F.col("operator"), addr__street=F.col("street")).alias("t"))
    full = tg.overlay(F.create_map(F.lit("addr:street"), F.lit("none"), F.lit("k"), F.lit("v")), F.col("t"))
    prefixed = F.map_filter(F.col("t"), lambda k, _: k.startswith("addr:"))
    n = F.size(F.map_filter(full, lambda k, v: v != "none"))
    return df.select("ord", n.alias("n"), full["addr:street"].alias("street"), F.size(prefixed).alias("prefixed"))


# --- C, D: joins and duplicates --------------------------------------------------

@query("c13_drop_exported", using("claims") + """
select place_id, min(region_ord) as region_ord from fx_claims where place_id not in (select p_partkey from part where p_size > 40) group by place_id""")
def c13(spark, folder):
    exported = table(spark, folder, "part").where("p_size > 40").select(F.col("p_partkey").alias("place_id"))
    rows = resolve.drop_exported(sample(spark, folder, "claims"), exported)
    return rows.groupBy("place_id").agg(F.min("region_ord").alias("region_ord"))


@query("c14_restrict_to_wanted", using("claims") + """
select region_ord, count(*) as n from fx_claims where place_id in (select p_partkey from part where p_brand = 'Brand#7') group by region_ord""")
def c14(spark, folder):
    wanted = table(spark, folder, "part").where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("place_id"))
    return quality.count_by(resolve.restrict_to(sample(spark, folder, "claims"), wanted), "region_ord")


@query("c15_same_name_pairs", using("places") + f"""
, s as ({SCORED}), p as (select a.search_id, a.name_key, {KM.format(a='a', b='b')} as d from s a join s b
  on a.search_id = b.search_id and a.name_key = b.name_key and a.ord < b.ord and (a.chain or b.chain))
select search_id, name_key, count(*) as pairs from p where d < 250 group by search_id, name_key""")
def c15(spark, folder):
    pairs = resolve.same_name_pairs(places_with_tags(spark, folder))
    return pairs.groupBy("search_id", "name_key").agg(F.sum("pairs").alias("pairs"))


@query("d1_name_key", using("rich") + """
select ord, regexp_replace(lower(name), '[^a-z0-9\\x{3400}-\\x{9FFF}]+', '', 'g') as name_key from fx_rich where name is not null""")
def d1(spark, folder):
    return sample(spark, folder, "rich").where("name is not null").select("ord", tx.name_key(F.col("name")).alias("name_key"))


# The whole ordered fold as one list reduction per bucket.
FOLD_STEP = f"""
  case when {{slot}} is null then list_concat(acc, x)
  else list_transform(acc, lambda k, i: case when i <> {{slot}} then k else struct_pack(
    ord := case when {{better}} then x[1].ord else k.ord end, first_ord := k.first_ord, n := k.n + 1,
    lat := case when {{better}} then x[1].lat else k.lat end, lon := case when {{better}} then x[1].lon else k.lon end,
    rel := case when {{better}} then x[1].rel else k.rel end, tags := k.tags | x[1].tags,
    brand := case when {{better}} then coalesce(x[1].brand, k.brand) else coalesce(k.brand, x[1].brand) end,
    amenity := case when {{better}} then x[1].amenity else k.amenity end,
    wikidata := case when {{better}} then coalesce(x[1].wikidata, k.wikidata) else coalesce(k.wikidata, x[1].wikidata) end) end) end"""


def _score(k: str) -> str:
    t = f"{k}.tags"
    return f"(2 + bit_count({t}) + 8 * ({t} & 1) + 6 * (({t} >> 1) & 1) + 4 * (({t} >> 2) & 1) + 4 * (({t} >> 3) & 1) + {k}.rel)"


def _chain(k: str) -> str:
    return f"({k}.brand is not null or {k}.amenity in ('cafe', 'bank', 'restaurant'))"


_SLOT = (
    "list_position(list_transform(acc, lambda k2: case when " + _chain("k2") + " or " + _chain("x[1]") + " then "
    + KM.format(a="k2", b="x[1]") + " < 250 else true end), true)"
)
FOLD = f"""
, bits as (select *, (wikidata is not null)::int + 2 * (wikipedia is not null)::int + 4 * (website is not null)::int + 8 * (phone is not null)::int
    + 16 * (brand is not null)::int + 32 * (opening_hours is not null)::int as tagbits from s),
ordered as (select search_id, name_key, list([struct_pack(ord := ord, first_ord := ord, n := 1, lat := lat::double, lon := lon::double, rel := (osm_type <> 'node')::int,
    tags := tagbits, brand := brand, amenity := amenity, wikidata := wikidata)] order by ord) as rows from bits group by search_id, name_key),
folded as (select search_id, name_key, list_reduce(rows, lambda acc, x: {FOLD_STEP.format(slot=_SLOT, better=_score('x[1]') + ' > ' + _score('k'))}) as kept from ordered),
merged as (select search_id, name_key, kept[1].first_ord as bucket_ord, unnest(kept) as k from folded),
deduped as (select search_id, name_key, bucket_ord, k.ord as ord, k.first_ord as first_ord, k.n as segments, k.brand as brand, k.wikidata as wikidata, k.lat as lat, k.lon as lon,
    {_score('k')} + (k.n > 1)::int as score from merged)"""


@query("d2_dedupe_places", using("places") + f", s as ({SCORED}){FOLD} select search_id, ord, first_ord, segments, brand, wikidata, score from deduped")
def d2(spark, folder):
    out = resolve.dedupe_places(places_with_tags(spark, folder))
    return out.select(
        "search_id", "ord", "first_ord", "segments", F.col("tags")["brand"].alias("brand"), F.col("tags")["wikidata"].alias("wikidata"), "score"
    )


@query("d2_dedupe_landmarks", using("places") + f"""
, s as ({SCORED}){FOLD}, landmark as (select search_id, name_key from s group by search_id, name_key having not bool_or(chain))
select search_id, ord, segments, score from deduped semi join landmark using (search_id, name_key)""")
def d2_landmarks(spark, folder):
    places = places_with_tags(spark, folder).withColumn("k", tx.name_key(F.col("name")))
    chains = places.where(tg.is_chain_like(F.col("tags"))).select("search_id", "k").distinct()
    return resolve.dedupe_places(places.join(chains, ["search_id", "k"], "left_anti").drop("k")).select("search_id", "ord", "segments", "score")


@query("d3_segments", using("places") + f", s as ({SCORED}){FOLD} select search_id, case when segments > 1 then segments::varchar end as segments, count(*) as n from deduped group by all")
def d3(spark, folder):
    out = resolve.dedupe_places(places_with_tags(spark, folder))
    return out.groupBy("search_id", F.col("tags")["x:segments"].alias("segments")).agg(F.count(F.lit(1)).alias("n"))


@query("d4_merge_rule", using("places") + f", s as ({SCORED}){FOLD} select ord, round(lat, 6) as lat, round(lon, 6) as lon, score from deduped where segments > 1")
def d4(spark, folder):
    out = resolve.dedupe_places(places_with_tags(spark, folder)).where("segments > 1")
    return out.select("ord", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "score")


@query("d5_is_chain_like", using("rich") + """
select ord, (brand is not null or operator is not null or coalesce(amenity in ('fast_food', 'bank'), false)) as chain from fx_rich""")
def d5(spark, folder):
    return rich_elements(spark, folder).select("ord", tg.is_chain_like(F.col("tags")).alias("chain"))


@query("d7_dedupe_after_naming", using("places") + f"""
, s as ({SCORED}){FOLD}, again as (select search_id from s group by search_id having bool_or(ord = 6))
select search_id, ord, segments::bigint as segments from deduped where search_id in (from again)
union all select search_id, ord, 1 from s where search_id not in (from again)""")
def d7(spark, folder):
    places = places_with_tags(spark, folder).withColumn("translated", F.col("ord") == 6)
    return resolve.dedupe_after_naming(places).select("search_id", "ord", "segments")


@query("d11_claim_across_regions", using("claims") + """
select place_id, min(region_ord) as region_ord from fx_claims where place_id not in (select p_partkey from part where p_size = 1) group by place_id""")
def d11(spark, folder):
    earlier = table(spark, folder, "part").where("p_size = 1").select(F.col("p_partkey").alias("place_id"))
    return resolve.claim_across_regions(sample(spark, folder, "claims"), earlier)


# --- E: counts ---------------------------------------------------------------------

@query("e1_search_stats", using("places") + f"""
, s as ({SCORED}){FOLD}, kept as (select * from deduped where score >= 12), pictured as (select distinct concat('node/', o_custkey % 200) as id from orders)
select r.search_id, r.n as raw_count, d.n as after_dedupe, k.n as after_filter, coalesce(w.n, 0) as with_images
from (select search_id, count(*) as n from s group by 1) r left join (select search_id, count(*) as n from deduped group by 1) d using (search_id)
left join (select search_id, count(*) as n from kept group by 1) k using (search_id)
left join (select search_id, count(*) as n from kept where concat('node/', ord) in (from pictured) group by 1) w using (search_id)""")
def e1(spark, folder):
    raw = places_with_tags(spark, folder)
    deduped = written(resolve.dedupe_places(raw).select("search_id", F.col("id").alias("place_id"), "score"), "deduped")
    photos = sample(spark, folder, "photos").select("place_id")
    return quality.search_stats(raw, deduped, deduped.where("score >= 12"), photos)


_NAMING = """case p_partkey % 6 when 0 then concat('塔塔塔', p_partkey % 900) when 1 then p_name when 3 then 'ab'
  when 4 then concat(upper(p_name), ' 塔塔塔', p_partkey % 900) else concat('Tower ', p_partkey) end"""


@query("e2_name_quality", f"""
with r as (select p_partkey as ord, concat('塔塔塔', p_partkey % 900) as original, {_NAMING} as name from part where p_partkey % 5 <> 2),
c as (select *, lag(original) over (partition by lower(name) order by ord) as prior from r where name <> original)
select (select count(*) from r) as needing, count(*) as translated, count(*) filter (where contains(name, '塔')) as residual_script,
  count(*) filter (where contains(name, original)) as echoed_original, count(*) filter (where length(regexp_replace(name, '[^A-Za-z]', '', 'g')) < 3) as too_short,
  count(*) filter (where prior <> original) as collisions from c""")
def e2(spark, folder):
    original = "case when p_partkey % 5 <> 2 then concat('塔塔塔', p_partkey % 900) else concat('tower ', p_partkey) end as original"
    return quality.name_quality(table(spark, folder, "part").selectExpr("p_partkey as ord", original, f"{_NAMING} as name"))


@query("e10_result_bounds", using("places") + """
select search_id, round(min(lat) - 0.02, 6) as south, round(min(lon) - 0.02, 6) as west, round(max(lat) + 0.02, 6) as north, round(max(lon) + 0.02, 6) as east from fx_places group by search_id
union all select 99, 0.98::double, 1.98::double, 3.02::double, 4.02::double""")
def e10(spark, folder):
    places = sample(spark, folder, "places")
    areas = places.select("search_id").distinct().unionByName(spark.range(99, 100).select(F.col("id").alias("search_id")))
    for c, v in (("south", 1.0), ("west", 2.0), ("north", 3.0), ("east", 4.0)):
        areas = areas.withColumn(c, F.lit(v))
    box = quality.result_bounds(places, areas)
    return box.select("search_id", *[F.round(c, 6).alias(c) for c in ("south", "west", "north", "east")])


def _folded(source: str) -> str:
    """The fold's SQL over ``source``, its tables named after it."""
    out = FOLD.replace(" from s)", f" from {source})")
    for name in ("bits", "ordered", "folded", "merged", "deduped"):
        out = out.replace(f"{name} as (", f"{source}_{name} as (").replace(f"from {name}", f"from {source}_{name}")
    return out


@query("e12_extra_source_gain", using("places") + f"""
, s as ({SCORED}){FOLD}, f as (select * from s where source = 'overpass'){_folded("f")}
select i.search_id, (select count(*) from deduped d where d.search_id = i.search_id) - (select count(*) from f_deduped d where d.search_id = i.search_id) as gain
from (select distinct search_id from s) i""")
def e12(spark, folder):
    raw = places_with_tags(spark, folder)
    gain = quality.extra_source_gain(raw, resolve.dedupe_places(raw), resolve.dedupe_places(raw.where("source = 'overpass'")))
    return gain.select("search_id", "gain")


# --- F, G: ranks and cuts --------------------------------------------------------------

_RANKED = using("places") + f", s as ({SCORED}), r as (select search_id, ord, n_tags + bonus as score, row_number() over (partition by search_id order by n_tags + bonus desc, ord) as rn from s) "


@query("f1_rank_candidates", _RANKED + "select search_id, ord, rn as candidate_rank from r")
def f1(spark, folder):
    places = score.with_information_score(places_with_tags(spark, folder))
    return score.rank_candidates(places).select("search_id", "ord", "candidate_rank")


@query("f3_unique_names", using("places") + """
, r as (select *, row_number() over (partition by search_id, lower(name) order by ord) as n from fx_places)
select ord, case when n > 1 then concat(name, ' (', n, ')') else name end as unique_name from r""")
def f3(spark, folder):
    return export.unique_names(sample(spark, folder, "places"), ["search_id"]).select("ord", "unique_name")


@query("f8_best_geocode", using("geocode") + """
, r as (select *, row_number() over (partition by query_id order by attempt, (case when osm_type = 'relation' then 10 else 0 end) + (case when class in ('boundary', 'place') then 5 else 0 end)
  + (case when type in ('city', 'administrative') then 5 else 0 end) desc, ord) as rn from fx_geocode) select query_id, ord, osm_id from r where rn = 1""")
def f8(spark, folder):
    return select.best_geocode(sample(spark, folder, "geocode")).select("query_id", "ord", "osm_id")


@query("f9_batch_ids", using("places") + """
select search_id, ord, (row_number() over (partition by search_id order by ord) - 1) // 5 as batch_no, (row_number() over (partition by search_id order by ord) - 1) % 5 as batch_pos from fx_places""")
def f9(spark, folder):
    return batch_ids(sample(spark, folder, "places"), ["search_id"], 5).select("search_id", "ord", "batch_no", "batch_pos")


@query("f11_summary_listing", using("places") + """
select search_id, n, concat(n, '. ', name) as line, concat(amenity, ' · ', printf('%.5f', lat::double), ', ', printf('%.5f', lon::double)) as detail
from (select *, row_number() over (partition by search_id order by ord) as n from fx_places)""")
def f11(spark, folder):
    places = sample(spark, folder, "places").withColumn("display_name", F.col("name")).withColumn("category_label", F.col("amenity"))
    return export.summary_listing(places.withColumn("lat", F.col("lat").cast("double")).withColumn("lon", F.col("lon").cast("double")))


@query("g1_cut_candidates", _RANKED + "select search_id, ord, rn as candidate_rank from r where rn <= 54")
def g1(spark, folder):
    places = score.with_information_score(places_with_tags(spark, folder))
    return score.cut_candidates(places, limit=30).select("search_id", "ord", "candidate_rank")


@query("g2_cut_results", _RANKED + """
, q as (select search_id, ord, row_number() over (partition by search_id order by case when ord % 6 = 0 then 0 else ord % 97 end desc, rn) as place_rank from r)
select * from q where place_rank <= 25""")
def g2(spark, folder):
    places = score.rank_candidates(score.with_information_score(places_with_tags(spark, folder)))
    places = places.withColumn("quality", F.when(F.col("ord") % 6 != 0, F.col("ord") % 97))
    return score.cut_results(places, limit=25).select("search_id", "ord", "place_rank")


@query("g3_order_results", using("places") + """
, c as (select concat('node/', o_custkey % 200) as id, count(*) as n from orders group by 1)
select p.search_id, p.ord, row_number() over (partition by p.search_id order by p.name, p.ord) as by_name,
  row_number() over (partition by p.search_id order by coalesce(c.n, 0) desc, p.ord) as by_images from fx_places p left join c using (id)""")
def g3(spark, folder):
    places = sample(spark, folder, "places")
    counts = sample(spark, folder, "photos").groupBy(F.col("place_id").alias("id")).agg(F.count(F.lit(1)).alias("image_count"))
    named = score.order_results(places.join(counts, "id", "left").fillna({"image_count": 0}), "name", "by_name")
    return score.order_results(named, "image_count", "by_images").select("search_id", "ord", "by_name", "by_images")


@query("g5_over_fetch", using("places") + """
, r as (select *, row_number() over (partition by search_id, source order by ord) as rn from fx_places)
select search_id, source, ord from r where rn <= case source when 'overpass' then 150 when 'wikidata' then 30 else 10 end""")
def g5(spark, folder):
    return score.over_fetch(places_with_tags(spark, folder), 10).select("search_id", "source", "ord")


@query("g6_first_pages", using("places") + """
select search_id, ord from (select *, row_number() over (partition by search_id order by ord) as rn from fx_places) where rn <= 45""")
def g6(spark, folder):
    return score.first_pages(sample(spark, folder, "places"), 45).select("search_id", "ord")


@query("h1_union_sources", using("places") + "select search_id, source, count(*) as n, count(brand) as branded from fx_places group by 1, 2")
def h1(spark, folder):
    from placemill.sources.readers import union_all

    places = sample(spark, folder, "places")
    parts = [places.where(F.col("source") == s) for s in ("overpass", "wikidata", "nominatim")]
    parts[1] = parts[1].withColumn("extra", F.lit(1))
    return union_all(*parts, None).groupBy("search_id", "source").agg(F.count(F.lit(1)).alias("n"), F.count("brand").alias("branded"))


# --- M: summaries and shown names ------------------------------------------------------------

@query("m2_heuristic_summary", RICH + f"""
, t as (select *, case when amenity is not null and amenity <> 'yes' then replace(amenity, '_', ' ') when tourism is not null then 'art-deco house' else 'place' end as label from placed)
select ord, case when description is not null then {clean('description')} else
  concat(chosen, ' is ', case when label[1:1] in ('a', 'e', 'i', 'o', 'u') then 'an ' else 'a ' end, label, ' in Karachi, Pakistan.',
    case when operator is not null or cuisine is not null or religion is not null or start_date is not null or stars is not null or opening_hours is not null or wheelchair = 'yes' then
      concat(' ', array_to_string(list_filter(['Operated by ' || operator, 'Cuisine: coffee, tea' || cuisine[1:0], 'Religious affiliation: ' || religion,
        'Dates from ' || start_date, stars || '-star rating', 'Opening hours: ' || opening_hours, case when wheelchair = 'yes' then 'Wheelchair accessible' end], lambda x: x is not null), '. '), '.') else '' end) end as summary
from t""")
def m2(spark, folder):
    places = rich_places(spark, folder)
    text = tg.heuristic_summary(F.col("name"), F.col("category_label"), F.lit("Karachi"), F.lit("Pakistan"), F.col("tags"))
    return places.select("ord", text.alias("summary"))


@query("m8_display_name", using("rich") + """
select ord, case when length(coalesce(name, '')) > 1 then name when name_en is not null then name_en when int_name is not null then int_name
  else concat('Place (OSM ', osm_type, '/', osm_id, ')') end as shown from fx_rich""")
def m8(spark, folder):
    df = sample(spark, folder, "rich").withColumn("tags", tg.tag_map(name__en=F.col("name_en"), int_name=F.col("int_name")))
    shown = tg.display_name(F.coalesce("name", F.lit("")), F.col("tags"), F.lit("Place"), F.col("osm_type"), F.col("osm_id"))
    return df.select("ord", shown.alias("shown"))


@query("m9_repair_summary", """
select p_partkey as ord, case p_partkey % 3 when 0 then concat('Hall', p_partkey, ' stands. Hall', p_partkey, ' is old.') when 1 then concat('Hall', p_partkey, ' is a hall.')
  else concat(p_name, ' is a hall.') end as summary from part""")
def m9(spark, folder):
    rows = table(spark, folder, "part").selectExpr(
        "p_partkey as ord", "case when p_partkey % 3 = 2 then 'Zz' else p_name end as raw", "concat('Hall', p_partkey) as shown",
        "case p_partkey % 3 when 0 then concat(p_name, ' stands. ', p_name, ' is old.') when 1 then ' is a hall.' else concat(p_name, ' is a hall.') end as s",
    )
    return rows.select("ord", tg.repair_summary(F.col("s"), F.col("raw"), F.col("shown")).alias("summary"))
