"""Registered queries over photos, links, sheets of regions and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from placemill import dims
from placemill.functions import text as tx
from placemill.operators import export, links, photos, quality, rank, resolve, select, targets
from placemill.plans.queries_places import KM
from placemill.plans.registry import query
from placemill.plans.samples import places_with_tags, sample, table, using
from placemill.session import fresh_path
from placemill.sources import readers, writers

# --- photos -------------------------------------------------------------------

_IDENTITY = "regexp_replace(lower(regexp_extract(regexp_extract(url, '^([^?]*)', 1), '([^/]*)$', 1)), '^[0-9]+px-', '')"
_STEM = (
    "trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '\\.[a-z]{3,4}$', ''), '[\\s_-]*\\(?[0-9]+\\)?$', ''), '[^a-z0-9]+', ' ', 'g'))"
)
PHOTOS = using("photos") + f", p as (select *, {_IDENTITY} as identity, {_STEM} as stem from fx_photos) "


@query("a14_read_photos", using("photos") + """
, c as (select 'commons' as source, ord, case when width > 2560 then url || '.thumb' else url end as download_url, case when title = '' then null else title end as title,
    case when credit is not null then 'Ann ' || regexp_extract(credit, '([0-9]+)$', 1) end as credit, license from fx_photos where mime <> 'image/svg+xml'),
f as (select 'flickr', ord, url, title, 'u' || ord, case when ord % 3 = 0 then 'CC BY 2.0' else 'Creative Commons' end from fx_photos where ord % 2 = 0 and width >= 1600),
e as (select 'europeana', ord, url, title, null, 'Europeana (open reuse)' from fx_photos where ord % 4 <> 1),
o as (select 'openverse', ord, url, title, 'By ' || ord, 'BY 4.0' from fx_photos),
u as (select 'unsplash', ord, url || '&w=2560&fit=max&fm=jpg&q=95', title, 'U on Unsplash', 'Unsplash License' from fx_photos)
select * from c union all select * from f union all select * from e union all select * from o union all select * from u""")
def a14(spark, folder):
    p = sample(spark, folder, "photos").withColumn("place_name", F.col("place_id")).withColumn("city", F.lit("Karachi"))
    commons = readers.commons_photos(p.select(
        "place_id", "ord", "url", F.col("url").alias("descriptionurl"), F.concat("url", F.lit(".thumb")).alias("thumburl"), F.lit(2560).alias("thumbwidth"),
        "width", F.lit(900).alias("height"), "mime", F.concat(F.lit("File:"), "title").alias("title"), F.col("credit").alias("artist"), F.lit("").alias("credit"), "license",
    ))
    flickr = readers.flickr_photos(p.select(
        "place_id", "place_name", "city", "ord", F.col("ord").alias("id"), "title", F.concat(F.lit("u"), "ord").alias("ownername"),
        F.when(F.col("ord") % 3 == 0, "4").otherwise("77").alias("license"),
        *[(F.when(F.col("ord") % 2 == 0, F.col("url")) if s == "k" else F.lit(None).cast("string")).alias(f"url_{s}") for s in "okhb"],
        *[F.col("width").alias(f"width_{s}") for s in "okhb"], *[F.lit(900).alias(f"height_{s}") for s in "okhb"],
    ))
    europeana = readers.europeana_photos(p.select(
        "place_id", "place_name", "ord", F.when(F.col("ord") % 4 != 1, F.array("url")).alias("edmIsShownBy"), F.lit(None).cast("array<string>").alias("edmPreview"),
        F.array("title").alias("title"), F.lit(None).cast("array<string>").alias("dataProvider"), F.lit(None).cast("array<string>").alias("rights"), F.col("url").alias("guid"),
    ))
    openverse = readers.openverse_photos(p.select(
        "place_id", "ord", "url", "title", F.lit(None).cast("string").alias("thumbnail"), "width", F.lit(900).alias("height"),
        F.concat(F.lit("By "), "ord").alias("creator"), F.lit("by").alias("license"), F.lit("4.0").alias("license_version"), F.col("url").alias("foreign_landing_url"),
    ))
    unsplash = readers.unsplash_photos(p.select(
        "place_id", "ord", F.col("url").alias("raw"), "width", F.lit(900).alias("height"), F.lit(None).cast("string").alias("description"),
        F.col("title").alias("alt_description"), F.lit("U").alias("user_name"), F.col("url").alias("html_link"),
    ))
    out = readers.union_all(commons, flickr, europeana, openverse, unsplash)
    return out.select("source", "ord", "download_url", "title", "credit", "license")


@query("b14_drop_furniture", """
with t as (select o_orderkey as ord, concat('Photo ', o_custkey, case o_orderkey % 7 when 0 then '.svg' when 1 then ' Flag.jpg' when 2 then '.GIF' when 3 then ' edited.png' else '.jpg' end) as title from orders)
select ord from t where not regexp_matches(lower(title), '\\.(svg|gif)$|flag|edit')""")
def b14(spark, folder):
    rows = table(spark, folder, "orders").selectExpr(
        "o_orderkey as ord",
        "concat('Photo ', o_custkey, case o_orderkey % 7 when 0 then '.svg' when 1 then ' Flag.jpg' when 2 then '.GIF' when 3 then ' edited.png' else '.jpg' end) as title",
    )
    return rows.where(~photos.is_furniture(F.col("title"))).select("ord")


@query("b15_with_photos", using("places", "photos") + "select search_id, count(*) as n from fx_places where id in (select place_id from fx_photos) group by 1")
def b15(spark, folder):
    places = sample(spark, folder, "places").withColumn("place_id", F.col("id"))
    return quality.count_by(photos.with_photos(places, sample(spark, folder, "photos")), "search_id")


@query("c6_entity_photos", using("places", "photos") + """
, claims as (select 'Q' || (o_custkey % 200 * 4) as entity_id, case o_orderkey % 4 when 0 then 'P18' when 1 then 'P3451' when 2 then 'P373' else 'P5252' end as property, o_orderkey as ord,
   case when o_orderkey % 2 = 0 then 'File:' else '' end || 'Pic ' || o_custkey % 90 || '.jpg' as value from orders),
files as (select distinct 'Pic ' || o_custkey % 60 || '.jpg' as title from orders)
select p.ord, count(*) as n, sum(c.ord)::bigint as claim_ords from fx_places p join claims c on p.wikidata = c.entity_id and c.property in ('P18', 'P3451', 'P5252') join files f on replace(c.value, 'File:', '') = f.title group by 1""")
def c6(spark, folder):
    orders = table(spark, folder, "orders")
    claims = orders.selectExpr(
        "concat('Q', o_custkey % 200 * 4) as entity_id", "case o_orderkey % 4 when 0 then 'P18' when 1 then 'P3451' when 2 then 'P373' else 'P5252' end as property",
        "o_orderkey as ord", "concat(case when o_orderkey % 2 = 0 then 'File:' else '' end, 'Pic ', o_custkey % 90, '.jpg') as value",
    )
    files = orders.selectExpr("concat('File:Pic ', o_custkey % 60, '.jpg') as title").distinct()
    places = sample(spark, folder, "places").select(F.col("ord").alias("place_id"), F.col("wikidata").alias("entity_id"))
    out = photos.entity_photos(places, claims, files)
    return out.groupBy(F.col("place_id").alias("ord")).agg(F.count(F.lit(1)).alias("n"), F.sum("claim_ord").alias("claim_ords"))


_NEAR = using("places", "photos") + f"""
, near as (select pl.ord as place_id, ph.photo_id, {KM.format(a='pl', b='ph')} as metres from fx_places pl join fx_photos ph
  on ph.lat between pl.lat - 0.01 and pl.lat + 0.01 and ph.lon between pl.lon - 0.011 and pl.lon + 0.011) """


@query("c10_photos_near", _NEAR + "select place_id, count(*) as n, sum(photo_id)::bigint as photo_ids, round(sum(metres), 3) as metres from near where metres <= 1000 group by place_id")
def c10(spark, folder):
    places = sample(spark, folder, "places").select(F.col("ord").alias("place_id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    shot = sample(spark, folder, "photos").select("photo_id", "ord", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return photos.photo_totals(places, shot, 1.0).withColumn("metres", F.round("metres", 3))


@query("c10_nearest_photos", _NEAR + """
, r as (select *, row_number() over (partition by place_id order by round(metres, 3), photo_id) as rn from near where metres <= 1000) select place_id, photo_id, rn from r where rn <= 5""")
def c10_nearest(spark, folder):
    places = sample(spark, folder, "places").select(F.col("ord").alias("place_id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    shot = sample(spark, folder, "photos").select("photo_id", "ord", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return photos.nearest_photos(places, shot, 1.0, 5).select("place_id", "photo_id", F.col("near_rank").alias("rn"))


@query("d8_image_identity", using("photos") + """
select ord, lower(regexp_replace(url_decode(replace(split_part(split_part(u, '?', 1), '/', -1), '+', '%2B')), '^[0-9]+px-', '')) as identity
from (select ord, case when ord % 3 = 0 then replace(url, 'Photo_', 'Fo%C3%A9%20A+B_') else url end as u from fx_photos)""")
def d8(spark, folder):
    url = F.when(F.col("ord") % 3 == 0, F.replace("url", F.lit("Photo_"), F.lit("Fo%C3%A9%20A+B_"))).otherwise(F.col("url"))
    return sample(spark, folder, "photos").select("ord", photos.image_identity(url).alias("identity"))


@query("d9_dedupe_images", PHOTOS + """
, a as (select * from (select *, row_number() over (partition by place_id, identity order by ord) as rn from p) where rn = 1),
b as (select *, row_number() over (partition by place_id, case when length(stem) > 8 then 't' || stem else 'i' || identity end order by ord) as r2 from a)
select place_id, ord from b where r2 = 1""")
def d9(spark, folder):
    return photos.dedupe_images(sample(spark, folder, "photos"), ["place_id"]).select("place_id", "ord")


# Three sources that hold the same files: the surer source comes first, whatever the order within each.
@query("d9_dedupe_poured", PHOTOS + """
, q as (select *, case ord % 3 when 0 then 8 when 1 then 0 else 2 end as so from p),
a as (select * from (select *, row_number() over (partition by place_id, identity order by so, ord) as rn from q) where rn = 1),
b as (select *, row_number() over (partition by place_id, case when length(stem) > 8 then 't' || stem else 'i' || identity end order by so, ord) as r2 from a)
select place_id, ord, so as source_order from b where r2 = 1""")
def d9_poured(spark, folder):
    order = F.expr("case ord % 3 when 0 then 8 when 1 then 0 else 2 end")
    return photos.dedupe_images(sample(spark, folder, "photos").withColumn("source_order", order), ["place_id"]).select("place_id", "ord", "source_order")


@query("d10_claim_across_places", PHOTOS + """
, q as (select *, replace(place_id, 'node/', '')::int as place_rank, source <> 'openverse' as explicit from p),
f as (select *, row_number() over (partition by identity order by place_rank, ord) as rn from q where not explicit and identity not in (select identity from q where explicit))
select ord, identity from q where explicit union all select ord, identity from f where rn = 1""")
def d10(spark, folder):
    p = sample(spark, folder, "photos").withColumn("place_rank", F.regexp_extract("place_id", "([0-9]+)$", 1).cast("int"))
    return photos.claim_across_places(p, []).select("ord", "identity")


@query("d10_claim_text_matches", PHOTOS + """
, q as (select *, replace(place_id, 'node/', '')::int as place_rank from p where source = 'openverse')
select ord from (select *, row_number() over (partition by identity order by place_rank, ord) as rn from q) where rn = 1""")
def d10_text(spark, folder):
    p = sample(spark, folder, "photos").where("source = 'openverse'")
    p = p.withColumn("place_rank", F.regexp_extract("place_id", "([0-9]+)$", 1).cast("int"))
    return photos.claim_across_places(p, []).select("ord")


@query("f2_rank_images", PHOTOS + """
, r as (select place_id, ord, row_number() over (partition by place_id order by (width >= 1600)::int desc, case source when 'wikidata' then 10 when 'commons-category' then 8 else 2 end desc, width desc, ord) as image_rank from p)
select * from r where image_rank <= 10""")
def f2(spark, folder):
    return photos.rank_images(sample(spark, folder, "photos"), ["place_id"]).select("place_id", "ord", "image_rank")


@query("f4_file_names", PHOTOS + """
, r as (select place_id, ord, row_number() over (partition by place_id order by ord) as n from p)
select ord, concat(replace(place_id, '/', '-'), '_', lpad(n::varchar, 2, '0'), '.jpeg') as file_name from r where n <= 24""")
def f4(spark, folder):
    p = sample(spark, folder, "photos").withColumn("base_name", F.replace("place_id", F.lit("/"), F.lit("-")))
    return export.file_names(p).select("ord", "file_name")


# One place in two cities: each has its own numbers and its own bound.
@query("f4_file_names_by_city", PHOTOS + """
, c as (select *, unnest(['A', 'B']) as city from p), r as (select place_id, ord, city, row_number() over (partition by city, place_id order by ord) as n from c)
select ord, city, concat(replace(place_id, '/', '-'), '_', lpad(n::varchar, 2, '0'), '.jpeg') as file_name from r where n <= 24""")
def f4_by_city(spark, folder):
    p = sample(spark, folder, "photos").withColumn("base_name", F.replace("place_id", F.lit("/"), F.lit("-")))
    p = p.withColumn("city", F.explode(F.array(F.lit("A"), F.lit("B"))))
    return export.file_names(p, keys=("city", "place_id")).select("ord", "city", "file_name")


# Every source in turn: how many it has, how many it may add, what is then collected.
_POUR = ", ".join(["s0 as (select place_id, 0 as total from (select distinct place_id from q))"] + [
    f"s{i + 1} as (select s.place_id, s.total + t as total, t from (select s{i}.place_id, s{i}.total, case when s{i}.total >= 10 then 0 else "
    f"least(coalesce(c.n, 0){'' if factor is None else f', (10 - s{i}.total) * {factor}'}{'' if ceiling is None else f', {ceiling}'}) end as t "
    f"from s{i} left join c on c.place_id = s{i}.place_id and c.so = {i}) s)"
    for i, (_, factor, ceiling) in enumerate(dims.WATERFALL)
])
_TAKES = " union all ".join(f"select place_id, {i} as so, t from s{i + 1}" for i in range(len(dims.WATERFALL)))


@query("h2_waterfall_union", using("photos") + f"""
, q as (select ord, place_id, case when ord % 20 = 0 then 0 when ord % 20 < 3 then 1 when ord % 20 < 5 then 2 when ord % 20 < 8 then 4 when ord % 20 < 9 then 5 when ord % 20 < 14 then 7 else 8 end as so from fx_photos),
c as (select place_id, so, count(*) as n from q group by 1, 2), {_POUR}, takes as ({_TAKES}),
r as (select *, row_number() over (partition by place_id, so order by ord) as rn from q)
select r.place_id, r.ord, r.so as source_order from r join takes t on r.place_id = t.place_id and r.so = t.so where rn <= t.t""")
def h2(spark, folder):
    names = [name for name, _, _ in dims.WATERFALL]
    pick = F.expr("case when ord % 20 = 0 then 0 when ord % 20 < 3 then 1 when ord % 20 < 5 then 2 when ord % 20 < 8 then 4 when ord % 20 < 9 then 5 when ord % 20 < 14 then 7 else 8 end")
    p = sample(spark, folder, "photos").withColumn("source", F.element_at(F.array(*[F.lit(n) for n in names]), pick + 1))
    return photos.waterfall_union(p).select("place_id", "ord", "source_order")


@query("i20_identity_and_stem", PHOTOS + "select ord, identity, stem from p")
def i20(spark, folder):
    return sample(spark, folder, "photos").select("ord", photos.image_identity(F.col("url")).alias("identity"), photos.title_stem(F.col("title")).alias("stem"))


@query("i21_caption", using("photos") + """
select ord, concat_ws(' ', case when ord % 5 = 0 then concat('Place (', ord % 3, ')') else title end, '— ' || credit, '[' || license || ']', 'via ' || source) as caption from fx_photos""")
def i21(spark, folder):
    title = F.when(F.col("ord") % 5 != 0, F.col("title"))
    c = tx.caption(F.lit("Place"), F.col("ord") % 3, title, F.col("credit"), F.col("license"), F.col("source"))
    return sample(spark, folder, "photos").select("ord", c.alias("caption"))


# --- links ------------------------------------------------------------------------

_TERM = "trim(regexp_replace(concat_ws(' ', nullif(name, ''), nullif(city, '')), '\\s+', ' ', 'g'))"
_ENC = "replace(replace(replace(url_encode({c}), '%28', '('), '%29', ')'), '%21', '!')"


@query("c17_travel_links", using("links") + f"""
, t as (select *, {_TERM} as term from fx_links), p as (select unnest([
  struct_pack(pos := 0, id := 'tripadvisor', base := 'https://www.tripadvisor.com/Search?q=', china := false, generic := false),
  struct_pack(pos := 1, id := 'viator', base := 'https://www.viator.com/searchResults/all?text=', china := false, generic := false),
  struct_pack(pos := 2, id := 'getyourguide', base := 'https://www.getyourguide.com/s/?q=', china := false, generic := false),
  struct_pack(pos := 3, id := 'tripcom', base := 'https://www.trip.com/things-to-do/list?keyword=', china := false, generic := false),
  struct_pack(pos := 4, id := 'chinahighlights', base := 'https://www.chinahighlights.com/search-result/?q=', china := true, generic := false),
  struct_pack(pos := 5, id := 'travelchina', base := 'https://www.travelchina.org.cn/en/', china := true, generic := true)], recursive := true))
select ord, pos, id, case when generic then base else base || {_ENC.format(c='term')} end as url, generic from t, p where term <> '' and (not china or coalesce(upper(country_code) in ('CN', 'HK', 'MO'), false))""")
def c17(spark, folder):
    out = links.travel_links(sample(spark, folder, "links"), [p[0] for p in dims.PROVIDERS])
    return out.select("ord", "pos", "id", "url", "generic")


# --- keywords and classes ------------------------------------------------------------

_TOKENS = ", ".join(
    f"({i}, '{c.id}', '{c.label}', '{t}')" for i, c in enumerate(dims.CATEGORIES) for t in c.tokens
)
_RESOLVED = using("keywords") + f"""
, tokens as (select * from (values {_TOKENS}) as t(rank, id, label, token)),
k as (select ord, trim(regexp_replace(lower(keyword), '\\s+', ' ', 'g')) as k from fx_keywords),
hits as (select ord, rank, id, label, max(length(token)) as score from k join tokens on contains(k, token) or contains(token, k) group by all),
best as (select *, row_number() over (partition by ord order by score desc, rank) as rn from hits),
resolved as (select k.ord, k.k, a.id as first, a.label as first_label, b.id as second from k left join best a on a.ord = k.ord and a.rn = 1 left join best b on b.ord = k.ord and b.rn = 2) """


@query("c1_resolve_keyword", _RESOLVED + """
select ord, concat_ws(',', first, second) as categories, first is null as generic,
  coalesce(first_label, array_to_string(list_transform(string_split(k, ' '), lambda w: concat(upper(w[1:1]), w[2:])), ' ')) as label,
  case when first is null then replace(k, ' ', '.*') end as pattern from resolved""")
def c1(spark, folder):
    out = select.resolve_keyword(sample(spark, folder, "keywords"))
    return out.select("ord", F.array_join("categories", ",").alias("categories"), "generic", "label", "pattern")


_CLASSES = ", ".join(f"('{c}', '{q}')" for c, qs in dims.CLASSES.items() for q in qs)


@query("c2_classes_for_category", _RESOLVED + f", cl as (select * from (values {_CLASSES}) as t(category, class_id)) select ord, class_id from resolved join cl on first = category")
def c2(spark, folder):
    out = select.resolve_keyword(sample(spark, folder, "keywords"))
    first = out.select("ord", F.try_element_at("categories", F.lit(1)).alias("category"))
    return select.classes_for(first).select("ord", "class_id")


@query("c3_subclass_closure", """
with recursive e as (select p_partkey as child, cast(floor(p_partkey / 3) as bigint) as parent from part where p_partkey > 0),
up as (select child, parent as ancestor, 1 as depth from e union all select up.child, e.parent, depth + 1 from up join e on up.ancestor = e.child)
select child, ancestor, depth from up""")
def c3(spark, folder):
    return select.subclass_closure(sample(spark, folder, "edges"))


@query("c3_instances_of", """
with recursive e as (select p_partkey as child, cast(floor(p_partkey / 3) as bigint) as parent from part where p_partkey > 0),
up as (select child, parent as ancestor from e union all select up.child, e.parent from up join e on up.ancestor = e.child),
m as (select s_suppkey as entity_id, s_nationkey * 7 as type_id from supplier), below as (select entity_id, type_id as c from m union all select entity_id, ancestor from m join up on type_id = child)
select distinct entity_id, case c when 4 then 'museum' when 13 then 'park' when 2 then 'park' end as category from below where c in (2, 4, 13)""")
def c3_instances(spark, folder):
    members = table(spark, folder, "supplier").selectExpr("s_suppkey as entity_id", "cast(s_nationkey * 7 as bigint) as type_id")
    classes = spark.sql("select * from values (4L, 'museum'), (13L, 'park'), (2L, 'park') as t(class_id, category)")
    return select.instances_of(members, sample(spark, folder, "edges"), classes)


@query("i10_escape_keyword", """
select p_partkey as ord, trim(regexp_replace(regexp_replace(concat(p_name, '"]; out; [', chr(9), p_brand, '_x-y  ', case when p_partkey % 3 = 0 then repeat(p_name, 9) else '' end), '[^A-Za-z0-9 _-]', ' ', 'g'), '\\s+', ' ', 'g'))[1:60] as safe from part""")
def i10(spark, folder):
    raw = F.expr("""concat(p_name, '"]; out; [', char(9), p_brand, '_x-y  ', case when p_partkey % 3 = 0 then repeat(p_name, 9) else '' end)""")
    return table(spark, folder, "part").select(F.col("p_partkey").alias("ord"), tx.escape_keyword(raw).alias("safe"))


@query("k4_unicode_norm", """
select doc_id, md5(nfc_normalize(text || 'e' || chr(769))) as nfc, length(nfc_normalize(text || 'e' || chr(769))) as n from documents""")
def k4(spark, folder):
    c = tx.unicode_norm(F.concat("text", F.lit("e" + chr(769))), "NFC")
    return table(spark, folder, "documents").select("doc_id", F.md5(c).alias("nfc"), F.length(c).alias("n"))


# --- sheets of regions ----------------------------------------------------------------

SHEET = using("sheet") + """
, f as (select *, last_value(nullif(trim(country), '') ignore nulls) over (order by ord rows unbounded preceding) as filled from fx_sheet),
t as (select ord * 2 as ord, filled as country, 'city' as kind, nullif(trim(city), '') as region from f union all select ord * 2 + 1, filled, 'province', nullif(trim(province), '') from f),
ranked as (select *, row_number() over (partition by kind, lower(country), lower(region) order by ord) as rn from t where region is not null and country is not null) """


def _filled(spark, folder):
    return targets.fill_country(sample(spark, folder, "sheet"), span=7)


@query("a7_read_targets_sheet", using("sheet") + """
select country, city, province, nullif(trim(attributes), '') as attributes, path, add_source as cell, count(*) as n from fx_sheet
  where coalesce(country, city, province, nullif(trim(attributes), ''), path, add_source) is not null group by all""")
def a7(spark, folder):
    """The sheet written as quoted CSV and read back through the reader."""
    path = fresh_path(spark, "sheet")
    sheet = sample(spark, folder, "sheet").select(
        F.col("country").alias("Country"), F.col("city").alias("City"), F.col("province").alias("Province/State"),
        F.col("attributes").alias("Attributes"), F.col("path").alias("Path"), F.col("add_source").alias("Add source"),
    )
    sheet.write.option("header", True).option("escape", '"').csv(path)
    rows = readers.read_targets_sheet(spark, path).withColumn("cell", tx.opt(F.element_at("cells", -1)))
    return rows.groupBy("country", "city", "province", "attributes", "path", "cell").agg(F.count(F.lit(1)).alias("n"))


@query("f5_fill_country", SHEET + "select ord, filled as country from f")
def f5(spark, folder):
    return _filled(spark, folder).select("ord", "country")


@query("f5_skipped_rows", SHEET + """
select ord, concat('Skipped "', region, '" — no country on or above its row.') as warning from t where region is not null and country is null""")
def f5_skipped(spark, folder):
    return targets.target_warnings(_filled(spark, folder))


@query("d12_distinct_targets", SHEET + "select ord, country, kind, region from ranked where rn = 1")
def d12(spark, folder):
    return targets.targets_of(_filled(spark, folder)).select("ord", "country", "kind", "region")


@query("e11_targets_by_kind", SHEET + "select kind, count(*) as n from ranked where rn = 1 group by kind")
def e11(spark, folder):
    return quality.count_by(targets.targets_of(_filled(spark, folder)), "kind")


@query("f6_sheet_settings", using("sheet") + """
select (select trim(attributes) from fx_sheet where trim(attributes) <> '' order by ord limit 1) as attribute,
  (select path from fx_sheet where regexp_matches(path, '^([a-zA-Z]:[\\\\/]|/)') order by ord limit 1) as output_path""")
def f6(spark, folder):
    return targets.sheet_settings(sample(spark, folder, "sheet"))


@query("i16_looks_like_path", """
with r as (select s_suppkey as ord, concat(case s_suppkey % 6 when 0 then '/' when 1 then 'C:\\' when 2 then 'd:/' when 3 then '\\\\' when 4 then 'C:' else '' end, s_name) as v from supplier)
select ord, regexp_matches(v, '^[a-zA-Z]:[\\\\/]') or starts_with(v, '\\\\') or starts_with(v, '/') as is_path from r""")
def i16(spark, folder):
    lead = F.when(F.col("ord") % 6 == 0, "/").when(F.col("ord") % 6 == 1, "C:\\").when(F.col("ord") % 6 == 2, "d:/").when(F.col("ord") % 6 == 3, "\\\\").when(F.col("ord") % 6 == 4, "C:").otherwise("")
    rows = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("ord"), "s_name")
    return rows.select("ord", tx.looks_like_path(F.concat(lead, "s_name")).alias("is_path"))


@query("i22_archive_filename", using("sheet") + """
select ord, concat(lower(replace(coalesce(nullif(trim(attributes), ''), 'export'), ' ', '-')), '_', lower(replace(coalesce(city, 'export'), ' ', '-')), '_', lower(replace(coalesce(country, 'export'), ' ', '-')), '.zip') as file_name from fx_sheet""")
def i22(spark, folder):
    return sample(spark, folder, "sheet").select("ord", tx.archive_filename(F.col("attributes"), F.col("city"), F.col("country")).alias("file_name"))


_LINKED = using("sheet") + """
, u as (select ord, regexp_replace(unnest(regexp_extract_all(coalesce(add_source, ''), 'https?://[^\\s",]+')), '[),.;]+$', '') as url from fx_sheet), d as (select url, min(ord) as ord from u group by url) """


def _sheet_links(spark, folder):
    return targets.sheet_links(sample(spark, folder, "sheet").withColumn("cells", F.array("country", "attributes", "path", "add_source")))


@query("d14_distinct_links", _LINKED + "select url, ord from d")
def d14(spark, folder):
    return _sheet_links(spark, folder).select("url", F.floor(F.col("ord") / 1_000_000).alias("ord"))


_TYPED = """, y as (select s_suppkey as ord, unnest([struct_pack(pos := 0, url := 'https://t' || s_suppkey % 9 || '.example/x'), struct_pack(pos := 1, url := 'notalink ' || s_suppkey % 5), struct_pack(pos := 2, url := 'ftp://f.example')], recursive := true) from supplier) """


def _typed(spark, folder):
    text = F.expr("concat(' https://t', s_suppkey % 9, '.example/x ,', char(10), 'notalink ', s_suppkey % 5, char(10), ',ftp://f.example,')")
    return targets.split_links(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("ord"), text.alias("text")))


@query("b19_split_links", _LINKED + _TYPED + "select url, min(ord) as ord, 1 as ok from y where pos = 0 group by url union all select url, ord, 0 from y where pos > 0")
def b19(spark, folder):
    good, bad = _typed(spark, folder)
    rows = good.withColumn("ok", F.lit(1)).unionByName(bad.withColumn("ok", F.lit(0)))
    return rows.select("url", F.floor(F.col("ord") / 1_000_000).alias("ord"), "ok")


@query("h3_merge_links", _LINKED + _TYPED + """
, a as (select url, 0 as part, min(ord) as ord from y where pos = 0 group by url union all select url, 1, ord from d), b as (select url, min(part) as part, min_by(ord, part) as ord from a group by url)
select url, part from b order by part, ord limit 20""")
def h3(spark, folder):
    good, _ = _typed(spark, folder)
    return targets.merge_links(good, _sheet_links(spark, folder)).select("url", "part")


# --- exports --------------------------------------------------------------------------------

@query("a10_export_manifest", using("places", "photos") + """
, p as (select *, row_number() over (partition by search_id order by ord) as rn from fx_places), k as (select *, row_number() over (partition by search_id, lower(name) order by ord) as nth from p where rn <= 300),
b as (select search_id, ord, id, case when nth > 1 then concat(name, ' (', nth, ')') else name end as base from k),
ph as (select f.place_id, row_number() over (partition by f.place_id order by f.ord) as n from fx_photos f join b on f.place_id = b.id)
select concat('Land', search_id % 2, '/City ', search_id, '/', base, '/', base, '_details.pdf') as path, 'document' as kind, null::varchar as note from b
union all select concat('Land', search_id % 2, '/City ', search_id, '/', base, '/', base, '_', lpad(n::varchar, 2, '0'), '.jpeg'), 'picture', null from ph join b on ph.place_id = b.id where n <= 24
union all select distinct concat('Land', search_id % 2, '/City ', search_id, '/_search-summary.pdf'), 'summary', null from b
union all select null, 'note', concat('Only the first 300 of ', count(*), ' places were included.') from p group by search_id having count(*) > 300""")
def a10(spark, folder):
    places = sample(spark, folder, "places").select(
        F.concat(F.lit("Land"), F.col("search_id") % 2).alias("country"), F.concat(F.lit("City  "), "search_id").alias("city"), "ord",
        F.col("id").alias("place_id"), F.col("ord").alias("osm_id"), "name",
    )
    return export.export_manifest(places, sample(spark, folder, "photos")).select("path", "kind", "note")


_OUTCOME = using("claims") + """
, c as (select place_id, min(region_ord) as region_ord from fx_claims group by 1), n as (select region_ord, count(*) as place_count from c group by 1),
m as (select region_ord, count(*) as matches from fx_claims group by 1), o as (select m.region_ord, coalesce(place_count, 0) as place_count, matches - coalesce(place_count, 0) as duplicates_skipped from m left join n using (region_ord)) """


def _outcomes(spark, folder):
    found = sample(spark, folder, "claims")
    return quality.region_outcomes(found, resolve.claim_across_regions(found))


@query("e9_region_outcomes", _OUTCOME + """
, r as (select unnest(range(0, 28)) as region_ord), j as (select region_ord, coalesce(place_count, 0) as place_count, coalesce(duplicates_skipped, 0) as duplicates_skipped,
  case when region_ord % 9 = 4 then 'failed' when region_ord % 9 = 5 then 'skipped' else 'done' end as status from r left join o using (region_ord))
select *, case when status = 'done' then case when duplicates_skipped > 0 and place_count = 0 then concat('Region ', region_ord, ': every match was already exported elsewhere; nothing new to write.')
  when duplicates_skipped > 0 then concat('Region ', region_ord, ': skipped ', duplicates_skipped, ' place(s) already exported for another region in this run.')
  when place_count = 0 then concat('Region ', region_ord, ': no matching places found; nothing exported.') end end as note from j""")
def e9(spark, folder):
    """Three regions found nothing; some failed or were skipped."""
    found = sample(spark, folder, "claims")
    regions = spark.range(28).select(
        F.col("id").alias("region_ord"), F.concat(F.lit("Region "), "id").alias("region"), F.when(F.col("id") % 9 == 4, "timed out").alias("error"), (F.col("id") % 9 == 5).alias("skipped")
    )
    out = quality.region_outcomes(found, resolve.claim_across_regions(found), regions)
    return out.select("region_ord", "place_count", "duplicates_skipped", "status", "note")


@query("e8_progress_totals", _OUTCOME + """
select count(*) as total, count(*) filter (where region_ord % 4 <> 3) as finished, count(*) filter (where region_ord % 4 = 2) as failed, sum(place_count)::bigint as places from o""")
def e8(spark, folder):
    status = F.element_at(F.array(*[F.lit(s) for s in ("done", "skipped", "failed", "searching")]), (F.col("region_ord") % 4 + 1).cast("int"))
    return quality.progress_totals(_outcomes(spark, folder).withColumn("status", status))


@query("a11_run_report", _OUTCOME + """
select concat(rpad('done', 9, ' '), ' Region ', region_ord, ', Land — ', place_count, ' place(s)', case when duplicates_skipped > 0 then concat(', ', duplicates_skipped, ' duplicate(s) skipped') else '' end) as line from o
union all select concat('Unique places exported: ', count(*)) from c""")
def a11(spark, folder):
    found = sample(spark, folder, "claims")
    rows = _outcomes(spark, folder).withColumn("region", F.concat(F.lit("Region "), "region_ord")).withColumn("country", F.lit("Land")).withColumn("error", F.lit(None).cast("string"))
    return export.run_report(rows, resolve.claim_across_regions(found)).select("line")


@query("j5_publish_partitions", using("places") + "select concat('City ', search_id) as city_dir, count(*) as n from fx_places group by 1")
def j5(spark, folder):
    """Two publishes of the same partitions: the second replaces the first, whole."""
    path = fresh_path(spark, "manifest")
    places = places_with_tags(spark, folder).select(
        F.lit("Land").alias("country_dir"), F.concat(F.lit("City "), "search_id").alias("city_dir"), F.col("id").alias("place_id"), F.col("name").alias("path")
    )
    writers.write_export_manifest(places, path)
    writers.write_export_manifest(places, path)
    return spark.read.parquet(path).groupBy("city_dir").agg(F.count(F.lit(1)).alias("n"))
