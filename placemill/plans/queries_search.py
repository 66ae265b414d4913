"""The whole search as one query, with stored answers, vectors and responses in play, and its SQL.

The SQL tells the search again over the sample tables: tags are maps there too, and
every merge is one list reduction per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill import dims
from placemill.plans import search
from placemill.plans.queries_jobs import _ENTITY, _GAZ, _GAZ_OK, _gazetteer_rows
from placemill.plans.queries_places import CHOSEN, KM, NAMED, clean, non_latin
from placemill.plans.registry import query
from placemill.plans.samples import RICH_KEYS, rich_elements, sample, table, using
from placemill.sources import readers

LIMIT = 50
COSINE = 0.4
# Scores of stored responses; in search 3 none is high enough to overrule a rejection.
TOLD_SCORE = "(batch_no * 13 + p * 7) % case when search_id = 3 then 60 else 101 end"
TOLD = "(batch_no % 3 <> 1 or search_id = 3)"
KEYWORDS = ("fast food", "banks", "museums", "theatre", "art house")


def _searches(spark: SparkSession, folder: str) -> DataFrame:
    """One search per map region of the sample, its keyword by number."""
    ids = sample(spark, folder, "rich").select("search_id").distinct()
    words = F.array(*[F.lit(w) for w in KEYWORDS])
    return ids.select(
        "search_id", F.element_at(words, (F.col("search_id") + 1).cast("int")).alias("keyword"), F.concat(F.lit("City "), "search_id").alias("city"),
        F.lit("Pakistan").alias("country"), F.lit("pk").alias("country_code"),
    )


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """A stored translation for every second candidate; some agree, so translated places merge."""
    ranks = spark.range(1, 91).select(F.col("id").alias("ord")).where("ord % 2 = 0")
    return _searches(spark, folder).select("search_id").join(ranks).select("search_id", "ord", F.concat(F.lit("Hall "), F.col("ord") % 8).alias("name"))


def _completions(spark: SparkSession, folder: str) -> DataFrame:
    """A stored response for two batches in three: renamed, scored, some rejected; in search 3 all are."""
    batches = spark.range(0, 18).select(F.col("id").alias("batch_no"))
    keep = "case when search_id = 3 or (batch_no + p) % 4 = 0 then 'false' else 'true' end"
    record = f"concat('{{\"i\":', p, ',\"keep\":', {keep}, ',\"name\":\"Renamed ', batch_no, '-', p, '\",\"score\":', {TOLD_SCORE}, '}}')"
    raw = F.expr(f"concat('<think>', batch_no, '</think>[', array_join(transform(sequence(0, 4), p -> {record}), ','), ']')")
    return _searches(spark, folder).select("search_id").join(batches).where(TOLD).select("search_id", "batch_no", raw.alias("raw"))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    ids = F.explode(F.array(F.concat(F.lit("wikidata/Q"), "vec_id"), F.concat(F.lit("node/"), "vec_id")))
    return table(spark, folder, "embeddings").select(ids.alias("id"), F.col("embedding").alias("vector"))


def run(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    entities = readers.entity_places(table(spark, folder, "part").selectExpr(*_ENTITY), F.lit("Place"), F.lit("custom"))
    return search.run_searches(
        _searches(spark, folder), rich_elements(spark, folder), entities, readers.gazetteer_places(_gazetteer_rows(spark, folder)),
        sample(spark, folder, "labels_of"), completions=_completions(spark, folder), answers=_answers(spark, folder), vectors=_vectors(spark, folder),
        photos=sample(spark, folder, "photos"), settings=search.Settings(limit=LIMIT, cosine=COSINE),
    )


# --- the same in SQL ----------------------------------------------------------------

def _tags(pairs: dict[str, str]) -> str:
    entries = ", ".join(f"struct_pack(k := '{k}', v := ({v})::varchar)" for k, v in pairs.items())
    return f"map_from_entries(list_filter([{entries}], lambda x: x.v is not null))"


def _has(t: str, *keys: str) -> str:
    return "(" + " or ".join(f"coalesce({t}['{k}'], '') <> ''" for k in keys) + ")"


def _points(pairs: list[tuple[tuple[str, ...], int]], t: str, kind: str) -> str:
    return " + ".join(f"{n} * {_has(t, *keys)}::int" for keys, n in pairs) + f" + ({kind} <> 'node')::int"


SITE, PHONE = ("website", "contact:website"), ("phone", "contact:phone")
_INFORMATION = [(("wikidata",), 8), (("wikipedia",), 6), (SITE, 4), (PHONE, 4), (("description",), 3), (("addr:street",), 2)]
_QUALITY = [(("wikidata",), 15), (("wikipedia",), 10), (("description",), 8), (SITE, 8), (PHONE, 7), (("addr:street",), 6), (("opening_hours",), 3), (("operator", "brand"), 3)]


def _score(k: str) -> str:
    return f"(cardinality({k}.tags) + {_points(_INFORMATION, f'{k}.tags', f'{k}.osm_type')})"


def _branded(t: str) -> str:
    return _has(t, "brand", "brand:wikidata", "operator")


def _chain(t: str) -> str:
    values = ", ".join(f"'{v}'" for v in dims.CHAIN_VALUES)
    return "(" + " or ".join([_branded(t), *(f"coalesce({t}['{k}'] in ({values}), false)" for k in dims.CHAIN_KEYS)]) + ")"


_KEPT = ["id", "osm_type", "osm_id", "name", "lat", "lon", "category", "category_label", "source", "vec"]


def _fold(name: str, source: str, keys: str, match: str, segments: bool) -> str:
    """CTEs that merge ``source`` in order of ``ord``; ``match`` tells whether the kept record k2 takes x[1] in."""
    slot = f"list_position(list_transform(acc, lambda k2: coalesce({match}, false)), true)"
    better = f"{_score('x[1]')} > {_score('k')}"
    pick = ", ".join(f"{c} := case when {better} then x[1].{c} else k.{c} end" for c in ["ord", *_KEPT])
    first = ", ".join(f"{c} := {c}" for c in ["ord", *_KEPT])
    tags = f"tags := case when {better} then map_concat(k.tags, x[1].tags) else map_concat(x[1].tags, k.tags) end"
    said = "case when k.n > 1 then map_concat(k.tags, map {'x:segments': k.n::varchar}) else k.tags end" if segments else "k.tags"
    return f"""
{name}_rows as (select {keys}, list([struct_pack({first}, first_ord := ord, n := 1, tags := tags)] order by ord) as rows from {source} group by {keys}),
{name}_kept as (select {keys}, list_reduce(rows, lambda acc, x: case when {slot} is null then list_concat(acc, x) else list_transform(acc, lambda k, i: case when i <> {slot} then k else
  struct_pack({pick}, first_ord := k.first_ord, n := k.n + 1, {tags}) end) end) as kept from {name}_rows),
{name} as (select {keys}, bucket_ord, k.ord as ord, k.first_ord as first_ord, {', '.join(f'k.{c} as {c}' for c in _KEPT)}, {said} as tags
  from (select {keys}, kept[1].first_ord as bucket_ord, unnest(kept) as k from {name}_kept))"""


_NAME_KEY = "regexp_replace(lower(name), '[^a-z0-9\\x{3400}-\\x{9FFF}]+', '', 'g') as name_key"
_NEAR = f"case when {_chain('k2.tags')} or {_chain('x[1].tags')} then {KM.format(a='k2', b='x[1]')} < 250 else true end"
_ALIKE = f"list_cosine_similarity(k2.vec, x[1].vec) >= {COSINE}"
_FIELDS = "search_id, ord, id, osm_type, osm_id, name, lat, lon, tags, category, category_label, source, null::double[] as vec"


def _title(c: str) -> str:
    words = f"regexp_extract_all({c}, '[0-9A-Za-z_]+|[^0-9A-Za-z_]+')"
    return f"list_aggregate(list_transform({words}, lambda w: case when regexp_matches(w, '^[a-z]') then concat(upper(w[1]), w[2:]) else w end), 'string_agg', '')"


def _label(t: str, fallback: str) -> str:
    first = ", ".join(f"nullif(nullif({t}['{k}'], 'yes'), '')" for k in dims.LABEL_KEYS)
    return f"coalesce({_title(f'''replace(coalesce({first}), '_', ' ')''')}, {fallback})"


def _summary() -> str:
    said = lambda text, key: f"case when {_has('tags', key)} then concat('{text}', {clean(f'''tags['{key}']''')}) end"
    details = ", ".join([
        said("Operated by ", "operator"), f"case when {_has('tags', 'cuisine')} then concat('Cuisine: ', replace({clean('''tags['cuisine']''')}, ';', ', ')) end",
        said("Religious affiliation: ", "religion"), said("Dates from ", "start_date"),
        f"case when {_has('tags', 'stars')} then concat({clean('''tags['stars']''')}, '-star rating') end",
        said("Opening hours: ", "opening_hours"), "case when tags['wheelchair'] = 'yes' then 'Wheelchair accessible' end",
    ])
    first = "concat(name, ' is ', case when regexp_matches(category_label, '(?i)^[aeiou]') then 'an' else 'a' end, ' ', lower(category_label), ' in City ', search_id, ', Pakistan.')"
    return f"coalesce(nullif({clean('''tags['description']''')}, ''), concat_ws(' ', {first}, nullif(concat(concat_ws('. ', {details}), '.'), '.')))"


SEARCH_SQL = using("rich", "labels_of") + f""", named as ({NAMED}), chosen as ({CHOSEN}),
elements as (select *, {_tags({k.replace('__', ':'): v for k, v in RICH_KEYS.items()})} as raw from chosen where chosen is not null and not (ord % 3 = 0 and ord % 6 = 3)),
asked as (select *, case search_id when 0 then 'restaurant' when 1 then 'bank' when 2 then 'museum' when 3 then 'cinema' else 'custom' end as category,
  case search_id when 0 then 'Restaurant' when 1 then 'Bank' when 2 then 'Museum' when 3 then 'Cinema / theatre' else 'Art House' end as label from elements
  where case search_id when 2 then coalesce(tourism in ('museum', 'gallery'), false) when 1 then coalesce(amenity in ('bank', 'bureau_de_change'), false)
    when 0 then coalesce(amenity in ('restaurant', 'fast_food', 'food_court'), false) when 3 then coalesce(amenity in ('cinema', 'theatre', 'arts_centre'), false)
    else regexp_matches(coalesce(amenity, ''), '(?i)art.*house') or regexp_matches(coalesce(tourism, ''), '(?i)art.*house') or regexp_matches(coalesce(name, ''), '(?i)art.*house') end),
osm0 as (select search_id, ord, concat(osm_type, '/', osm_id) as id, osm_type, osm_id, chosen as name, lat, lon,
  case when local_name is not null and local_name <> chosen then map_concat(raw, map {{'name:local': local_name}}) else raw end as tags, category, {_label('raw', 'label')} as category_label, 'overpass' as source from asked),
osm as (select {_FIELDS}, {_NAME_KEY} from osm0 qualify row_number() over (partition by search_id order by ord) <= 300),
{_fold('first', 'osm', 'search_id, name_key', _NEAR, True)},
ranked as (select search_id, row_number() over (partition by search_id order by {_score('first')} desc, bucket_ord, first_ord) as ord, id, osm_type, osm_id, name, lat, lon, tags, category, category_label, source from first),
ents as (select {', '.join(_ENTITY)} from part),
ent0 as (select *, {clean('itemLabel')} as name, regexp_extract(item, '([^/]*)$', 1) as q from ents where item <> '' and itemLabel is not null and not regexp_matches({clean('itemLabel')}, '^Q[0-9]+$') and coord <> 'nowhere'),
ent as (select search_id, ord + 1099511627776 as ord, concat('wikidata/', q) as id, 'node' as osm_type, ord as osm_id, name, split_part(replace(replace(coord, 'Point(', ''), ')', ''), ' ', 2)::double as lat,
  split_part(replace(replace(coord, 'Point(', ''), ')', ''), ' ', 1)::double as lon,
  {_tags({'name': 'name', 'wikidata': 'q', 'description': f"nullif({clean('itemDescription')}, '')", 'website': 'website', 'wikimedia_commons': "'Category:' || regexp_replace(commons, '(?i)^category:', '')"})} as tags,
  'custom' as category, coalesce(nullif({clean('typeLabel')}, ''), 'Place') as category_label, 'wikidata' as source from ent0 qualify row_number() over (partition by search_id order by ord) <= 120),
gaz0 as (select {', '.join(_GAZ)} from customer),
gaz as (select search_id, ord + 2199023255552 as ord, concat(osm_type, '/', osm_id) as id, osm_type, osm_id, coalesce(name, concat('Display ', ord)) as name, lat::double as lat, lon::double as lon,
  {_tags({'name': "coalesce(name, concat('Display ', ord))", 'wheelchair': "'yes'", 'amenity': 'case when category is not null then type end', 'addr:street': "concat('Road ', road)", 'addr:city': "'Karachi'"})} as tags,
  'custom' as category, case when type is not null then 'fast food' else 'Place' end as category_label, 'nominatim' as source from gaz0 where {_GAZ_OK} and search_id < 5 qualify row_number() over (partition by search_id order by ord) <= 40),
found as (select {_FIELDS}, {_NAME_KEY} from (from ranked union all by name from ent union all by name from gaz)),
{_fold('second', 'found', 'search_id, name_key', _NEAR, True)},
candidates as (select *, row_number() over (partition by search_id order by {_score('second')} desc, bucket_ord, first_ord) as candidate_rank from second qualify candidate_rank <= 90),
english as (select entity_id, min(t) as t from (select entity_id, {clean('coalesce(label, alias)')} as t from fx_labels_of) where t <> '' and not {non_latin('t')} group by 1),
translated as (select c.search_id, candidate_rank as ord, id, osm_type, osm_id, lat, lon, category, category_label, source, c.name as old,
  case when {non_latin('c.name')} then coalesce(t, case when candidate_rank % 2 = 0 then concat('Hall ', candidate_rank % 8) end) end as fresh, tags
  from candidates c left join english on entity_id = nullif(trim(tags['wikidata']), '')),
renamed0 as (select * exclude (old, fresh, tags), coalesce(fresh, old) as name, fresh is not null as translated,
  case when fresh is null then tags else map_concat(map_concat(tags, map {{'name:local': coalesce(nullif(tags['name:local'], ''), old)}}), map {{'name:en': fresh}}) end as tags from translated),
renamed as (select {_FIELDS}, {_NAME_KEY}, bool_or(translated) over (partition by search_id) as again from renamed0),
to_merge as (select * from renamed where again),
{_fold('third', 'to_merge', 'search_id, name_key', _NEAR, True)},
exact as (select search_id, bucket_ord, first_ord, id, osm_type, osm_id, name, lat, lon, tags, category, category_label, source from third
  union all by name select search_id, ord as bucket_ord, ord as first_ord, id, osm_type, osm_id, name, lat, lon, tags, category, category_label, source from renamed where not again),
numbered as (select e.*, row_number() over (partition by search_id order by bucket_ord, first_ord) as ord, embedding::double[] as vec from exact e
  left join (select unnest(['wikidata/Q' || vec_id, 'node/' || vec_id]) as vid, embedding from embeddings) v on v.vid = e.id),
plain as (select * exclude (bucket_ord, first_ord), {_branded('tags')} or vec is null as alone from numbered),
to_compare as (select * from plain where not alone),
{_fold('fourth', 'to_compare', 'search_id', _ALIKE, False)},
unlike as (select search_id, first_ord, id, osm_type, osm_id, name, tags, category_label from fourth union all by name select search_id, ord as first_ord, id, osm_type, osm_id, name, tags, category_label from plain where alone),
placed as (select *, row_number() over (partition by search_id order by first_ord) as ord from unlike),
batched as (select *, (ord - 1) // 5 as batch_no, (ord - 1) % 5 as p from placed),
told as (select *, {TOLD} as had, {TOLD_SCORE} as told_score, length(name) > 1 as rule_keep,
  least(100, 40 + {_points(_QUALITY, 'tags', 'osm_type')} + 2 * (osm_type <> 'node')::int) as rule_quality, {_summary()} as summary from batched),
judged as (select *, case when had then search_id <> 3 and (batch_no + p) % 4 <> 0 or told_score >= 80 else rule_keep end as keep, case when had then told_score else rule_quality end as quality,
  case when had then concat('Renamed ', batch_no, '-', p) else name end as final from told),
guarded as (select *, case when bool_or(keep) over (partition by search_id) then keep else rule_keep end as stays from judged)
select search_id, row_number() over (partition by search_id order by quality desc, ord) as place_rank, id as place_id, final as name, quality, summary, concat('https://www.openstreetmap.org/', osm_type, '/', osm_id) as osm_url
from guarded where stays qualify place_rank <= {LIMIT}"""


@query("search_results", SEARCH_SQL)
def search_results(spark, folder):
    return run(spark, folder)["results"].select("search_id", "place_rank", "place_id", "name", "quality", "summary", "osm_url")
