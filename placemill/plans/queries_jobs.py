"""Registered queries over stored responses, stored results, vectors, snapshot files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from placemill.functions import responses as rs, vectors
from placemill.functions.tags import tag_map
from placemill.operators import quality, resolve, responses, store
from placemill.plans.queries_places import RICH, clean
from placemill.plans.registry import query
from placemill.plans.samples import rich_elements, sample, table, using
from placemill.session import fresh_path
from placemill.sources import readers, writers
from placemill.streaming import jobs

# --- responses -----------------------------------------------------------------

_STRIPPED = (
    "trim(regexp_replace(regexp_replace(regexp_replace(raw, '(?is)<think>.*?</think>|<thinking>.*?</thinking>|<reasoning>.*?</reasoning>', ' ', 'g'), "
    "'(?is)<(think|thinking|reasoning)>.*$', ' '), '(?i)</?(think|thinking|reasoning)>', ' ', 'g'))"
)
_CLEANED = f"trim(regexp_replace({_STRIPPED}, '(?i)```(?:jsonc|json)?', '', 'g'))"


@query("i43_strip_reasoning", using("completions") + f"select batch_id, pos, {_STRIPPED} as text from fx_completions")
def i43(spark, folder):
    return sample(spark, folder, "completions").select("batch_id", "pos", rs.strip_reasoning(F.col("raw")).alias("text"))


@query("i44_clean_completion", using("completions") + f"select batch_id, pos, {_CLEANED} as text from fx_completions")
def i44(spark, folder):
    return sample(spark, folder, "completions").select("batch_id", "pos", rs.clean_completion(F.col("raw")).alias("text"))


@query("a12_read_completions", using("completions") + "select batch_id, count(*) as n, sum(length(raw))::bigint as chars from fx_completions group by 1")
def a12(spark, folder):
    path = fresh_path(spark, "completions")
    sample(spark, folder, "completions").write.parquet(path)
    rows = readers.read_completions(spark, path)
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw")).alias("chars"))


# Each response of the view that holds a record describes the place at its own position.
_RECORDS = using("completions") + f"""
, c as (select batch_id, pos, {_CLEANED} as text from fx_completions),
r as (select batch_id, pos, json_extract(text, '$[0]') as j from c where json_valid(text) and starts_with(text, '[')),
v as (select batch_id, pos, (j->>'$.i')::bigint as i, (j->>'$.keep')::boolean as keep, j->>'$.name' as name, (j->>'$.score')::int as score from r) """


@query("i45_parse_records", _RECORDS + "select batch_id, pos, i, name from v")
def i45(spark, folder):
    rows = sample(spark, folder, "completions").select("batch_id", "pos", F.explode(rs.parse_records(F.col("raw"))).alias("v"))
    return rows.select("batch_id", "pos", F.try_variant_get("v", "$.i", "bigint").alias("i"), F.try_variant_get("v", "$.name", "string").alias("name"))


@query("k2_scan_objects", _RECORDS + "select batch_id, pos, i, name, 2 as found from v")
def k2(spark, folder):
    """The same records after the array brackets are spoiled: recovered as balanced objects."""
    spoiled = F.regexp_replace(F.regexp_replace("raw", r"\[\{", "here: {"), r"\}\]", '} and {"i":0} {bad} ]')
    rows = sample(spark, folder, "completions").select("batch_id", "pos", rs.parse_records(spoiled).alias("v"))
    rows = rows.where(F.size("v") > 0)
    return rows.select(
        "batch_id", "pos", F.try_variant_get(F.col("v")[0], "$.i", "bigint").alias("i"), F.try_variant_get(F.col("v")[0], "$.name", "string").alias("name"),
        F.size("v").alias("found"),
    )


@query("i47_validate_record", _RECORDS + "select batch_id, pos, i, keep, name, (case when pos % 5 = 1 then 60 else score end)::double as score from v where pos % 5 <> 0 and pos % 5 <> 2")
def i47(spark, folder):
    """Some records get a text score, some a missing one, some a name that is no text: defaults and rejections."""
    spoil = (
        F.when(F.col("pos") % 5 == 0, F.regexp_replace("raw", '"score":([0-9]+)', '"score":"$1"'))
        .when(F.col("pos") % 5 == 1, F.regexp_replace("raw", ',"score":[0-9]+', ""))
        .when(F.col("pos") % 5 == 2, F.regexp_replace("raw", '"name":"[^"]*"', '"name":null')).otherwise(F.col("raw"))
    )
    out = responses.completions_to_records(sample(spark, folder, "completions").withColumn("raw", spoil), ["batch_id", "pos"])
    return out.select("batch_id", "pos", "r.i", "r.keep", "r.name", "r.score")


@query("b11_should_keep", _RECORDS + "select batch_id, pos, keep or score >= 80 as keep from v")
def b11(spark, folder):
    out = responses.completions_to_records(sample(spark, folder, "completions"), ["batch_id", "pos"])
    return out.select("batch_id", "pos", rs.should_keep(F.col("r")).alias("keep"))


def _batches(spark, folder):
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("batch_pos"))


def _records(spark, folder):
    return responses.completions_to_records(sample(spark, folder, "completions"), ["batch_id", "pos"])


@query("c12_records_to_places", _RECORDS + """
, b as (select conv_id as batch_id, turn as batch_pos, count(*) over (partition by conv_id) as size from conversations)
select b.batch_id, b.batch_pos, v.name, v.score::double as score from b join v on b.batch_id = v.batch_id and v.i = b.batch_pos""")
def c12(spark, folder):
    out = responses.records_to_places(_records(spark, folder), _batches(spark, folder), ["batch_id"])
    return out.select("batch_id", "batch_pos", "r.name", "r.score")


@query("c11_keep_rows", _RECORDS + """
select t.conv_id as batch_id, count(*) as kept from conversations t left join v on t.conv_id = v.batch_id and t.turn = v.i where coalesce(v.keep or v.score >= 80, true) group by 1""")
def c11(spark, folder):
    batches = _batches(spark, folder)
    found = responses.records_to_places(_records(spark, folder), batches, ["batch_id"])
    flags = found.select("batch_id", "batch_pos", rs.should_keep(F.col("r")).alias("keep"))
    return quality.count_by(responses.keep_rows(batches, flags, ["batch_id", "batch_pos"]), "batch_id").withColumnRenamed("n", "kept")


_ENRICHED = _RECORDS + """
, t as (select conv_id as batch_id, turn as batch_pos, 'Hall ' || turn as name, case turn % 2 when 0 then '+1 ' || conv_id end as phone from conversations),
e as (select t.*, v.i is not null as had, coalesce(v.keep or v.score >= 80, true) as keep0, coalesce(v.name, t.name) as enriched_name, coalesce(v.score, case when t.phone is not null then 47 else 40 end) as quality
  from t left join v on t.batch_id = v.batch_id and t.batch_pos = v.i),
g as (select *, bool_or(keep0) over (partition by batch_id) as any_kept from e) """


def _enriched(spark, folder):
    places = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("batch_id"), F.col("conv_id").alias("search_id"), F.col("turn").alias("batch_pos"), F.concat(F.lit("Hall "), "turn").alias("name"),
        F.lit("Hall").alias("category_label"), F.lit("node").alias("osm_type"), F.lit("Karachi").alias("city"), F.lit("Pakistan").alias("country"),
        tag_map(phone=F.expr("case turn % 2 when 0 then concat('+1 ', conv_id) end")).alias("tags"),
    )
    return responses.enrich(places, _records(spark, folder), ["batch_id"])


@query("m3_merge_response", _ENRICHED + "select batch_id, batch_pos, enriched_name, phone, quality, had as llm_processed, 'Hall ' || batch_pos || ' is a hall in Karachi, Pakistan.' as summary from e")
def m3(spark, folder):
    return _enriched(spark, folder).select("batch_id", "batch_pos", "enriched_name", "contact.phone", "quality", "llm_processed", "summary")


@query("b12_guard_all_rejected", _ENRICHED + "select batch_id, batch_pos, case when any_kept then keep0 else true end as keep from g")
def b12(spark, folder):
    return _enriched(spark, folder).select("batch_id", "batch_pos", "keep")


@query("h4_merge_over_heuristic", _ENRICHED + "select batch_id, count(*) as n, count(*) filter (where had) as merged, sum(quality)::bigint as quality from e group by 1")
def h4(spark, folder):
    g = _enriched(spark, folder).groupBy("batch_id")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if("llm_processed").alias("merged"), F.sum("quality").alias("quality"))


@query("m4_final_name", _ENRICHED + """
select batch_id, batch_pos, case when batch_pos % 3 = 0 then name when batch_pos % 3 = 1 then enriched_name else name end as name from e""")
def m4(spark, folder):
    e = _enriched(spark, folder)
    answer = F.when(F.col("batch_pos") % 3 == 0, "塔塔塔").when(F.col("batch_pos") % 3 == 1, F.col("enriched_name"))
    return e.select("batch_id", "batch_pos", responses.final_name(answer, F.col("name")).alias("name"))


@query("e3_filter_quality", _ENRICHED + """
select batch_id % 7 as city, count(*) as scored, count(*) filter (where not case when any_kept then keep0 else true end) as dropped, count(*) filter (where had) as llm_processed,
  0 as empty_summary, 0 as renamed_to_non_latin, count(*) filter (where batch_pos % 4 = 1) as hours_without_source from g group by 1""")
def e3(spark, folder):
    rows = _enriched(spark, folder).select(
        (F.col("batch_id") % 7).alias("city"), F.col("name").alias("original_name"), F.col("enriched_name").alias("name"), "keep", "llm_processed",
        F.when(F.col("batch_pos") % 4 == 1, F.concat("summary", F.lit(" Open 9:00 - 17:00."))).otherwise(F.col("summary")).alias("summary"),
        F.lit(None).cast("string").alias("tag"),
    )
    return quality.filter_quality(rows, ["city"])


_WORDS = using("numbered") + """
, w as (select conv_id as batch_id, turn as pos, turn + 1 as n1, trim(split_part(text, ' ', 1)) as a, turn + 2 as n2, trim(split_part(text, ' ', 2)) as b from conversations) """


@query("i51_parse_numbered_list", using("numbered") + """
, l as (select batch_id, pos, unnest(string_split(raw, chr(10))) as line from fx_numbered)
select batch_id, pos, regexp_extract(line, '^\\s*([0-9]+)\\s*[.)]\\s*(.+?)\\s*$', 1)::bigint as number, regexp_extract(line, '^\\s*([0-9]+)\\s*[.)]\\s*(.+?)\\s*$', 2) as text
from l where regexp_matches(line, '^\\s*([0-9]+)\\s*[.)]\\s*(.+?)\\s*$')""")
def i51(spark, folder):
    rows = sample(spark, folder, "numbered").select("batch_id", "pos", F.explode(rs.parse_numbered_list(F.col("raw"))).alias("e"))
    return rows.select("batch_id", "pos", "e.number", "e.text")


@query("d13_drop_collisions", using("numbered") + f"""
, l as (select batch_id, pos, unnest(string_split(raw, chr(10))) as line from fx_numbered),
p as (select batch_id, pos, regexp_extract(line, '^\\s*([0-9]+)\\s*[.)]\\s*(.+?)\\s*$', 1)::bigint as number, {clean("regexp_replace(regexp_extract(line, '^\\s*([0-9]+)\\s*[.)]\\s*(.+?)\\s*$', 2), '^[\"''`]|[\"''`]$', '', 'g')")} as name from l where regexp_matches(line, '^\\s*([0-9]+)\\s*[.)]\\s*(.+?)\\s*$')),
c as (select *, count(*) over (partition by batch_id, lower(name)) as n from p where name <> '')
select batch_id, number, name from c where n = 1""")
def d13(spark, folder):
    rows = sample(spark, folder, "numbered").select("batch_id", F.explode(rs.parse_numbered_list(F.col("raw"))).alias("e"))
    named = rows.select("batch_id", "e.number", rs.translated_name(F.col("e.text")).alias("name")).where(F.col("name").isNotNull())
    return resolve.drop_collisions(named, ["batch_id"])


@query("i50_strip_echoed_original", """
select conv_id as batch_id, turn as pos, case turn % 4 when 0 then 'Tower ' || turn when 1 then case when length(turn::varchar) >= 3 then turn::varchar else '' end when 2 then 'plain ' || turn else 'Great Hall' end as name from conversations""")
def i50(spark, folder):
    text = F.expr(
        "case turn % 4 when 0 then concat('塔', turn, ' - Tower ', turn) when 1 then concat('塔塔 (', turn, ')') when 2 then concat('plain ', turn) else '塔/ab| Great Hall ：x' end"
    )
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("pos"), rs.strip_echoed_original(text).alias("name"))


@query("i46_parse_object", """
select conv_id as batch_id, turn as pos, case when turn % 6 = 4 then null else 'Hall ' || turn end as overview, case when turn % 6 in (0, 1, 2, 5) then 'https://x.example/' || turn end as link from conversations""")
def i46(spark, folder):
    """Plain objects, comments, trailing commas, a cut-off tail, text without an object, and a key given twice."""
    head = """'{"overview":"Hall ', turn, '"'"""
    link = """',"link":"https://x.example/', turn, '"'"""
    shapes = [
        f"concat({head}, {link}, '}}')", f"concat({head}, {link}, ', // note', char(10), '/* more */ }}')", f"concat('so: ', {head}, {link}, ',}} ok')",
        f"concat({head}, ',\"history\":\"cut off')", "'no object here'",
        """concat('{"overview":"old","link":[1],"overview":"Hall ', turn, '"', ',"link":"https://x.example/', turn, '"}')""",
    ]
    raw = "case turn % 6 " + " ".join(f"when {k} then {v}" for k, v in enumerate(shapes)) + " end"
    rows = table(spark, folder, "conversations").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("pos"), rs.parse_object(F.expr(raw)).alias("o"))
    return rows.select("batch_id", "pos", F.try_variant_get("o", "$.overview", "string").alias("overview"), F.try_variant_get("o", "$.link", "string").alias("link"))


@query("i48_to_prose", """
select conv_id as batch_id, turn as pos, case turn % 4 when 0 then trim(role) when 1 then '1851. Built: by ' || turn || ' people' when 2 then 'Opening hours: 9 to 5. Best Time: true' else 'a b; c' end as prose from conversations""")
def i48(spark, folder):
    value = F.expr(
        "case turn % 4 when 0 then to_json(named_struct('v', role)) when 1 then concat('{\"v\":[\"1851.\",{\"Built\":\"by ', turn, ' people\"}]}') "
        "when 2 then '{\"v\":{\"opening_hours\":\"9 to 5\",\"bestTime\":true,\"x\":null}}' else '{\"v\":[\"a\",[\"b\",\"c\"]]}' end"
    )
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("batch_id"), F.col("turn").alias("pos"), rs.to_prose(rs.json_field(value, "v")).alias("prose")
    )
    return rows


@query("i49_to_bullets", """
select conv_id as batch_id, turn as pos, case turn % 3 when 0 then 'first hall|View: the ' || turn when 1 then 'alpha|beta ' || turn || '|Gamma.' else '' end as bullets from conversations""")
def i49(spark, folder):
    value = F.expr(
        "case turn % 3 when 0 then concat('[\"first hall\",\"ab\",{\"view\":\"the ', turn, '\"}]') when 1 then concat('\"- alpha; beta ', turn, '\\\\nGamma. x\"') else 'null' end"
    )
    value = F.when(F.col("turn") % 3 == 1, F.concat(F.lit('"- alpha; beta '), F.col("turn").cast("string"), F.lit('\\nGamma.\\nx"'))).otherwise(value)
    bullets = rs.to_bullets(value)
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("pos"), F.array_join(bullets, "|").alias("bullets"))


@query("k3_article_fields", """
select conv_id as batch_id, turn as pos, 'Text ' || turn as overview, 'Year: ' || (1800 + turn) || '. Event: built' as history, 2 as n_highlights from conversations""")
def k3(spark, folder):
    raw = F.expr("concat('<think>{}</think>{\"overview\":\" Text ', turn, ' \",\"history\":[{\"year\":', 1800 + turn, ',\"event\":\"built\"}],\"highlights\":\"one hall; two halls\"}')")
    rows = table(spark, folder, "conversations").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("pos"), raw.alias("raw"))
    return responses.parse_articles(rows, ["batch_id", "pos"]).select("batch_id", "pos", "overview", "history", F.size("highlights").alias("n_highlights"))


# --- stored results -----------------------------------------------------------------

_US = "epoch_us({c}::timestamp)"


def _results(spark, folder):
    return sample(spark, folder, "searches").select(
        F.col("search_id").alias("id"), F.col("search_id").alias("ord"), F.col("key_id").alias("cache_key"), F.col("ts").alias("created_at"), "requested_limit"
    )


@query("a9_save_results", using("searches") + """
select id, max_by(search_id, (ts, search_id)) as ord from (select *, search_id % 300 as id from fx_searches) group by id""")
def a9(spark, folder):
    """Two appends of result versions, read back as the newest per id."""
    path = fresh_path(spark, "results")
    rows = _results(spark, folder).withColumn("id", F.col("ord") % 300)
    older = rows.where("ord % 2 = 0")
    writers.save_results(older, path)
    stored = spark.read.parquet(path).drop("month").select(*rows.columns)
    return store.upsert(stored, rows.where("ord % 2 = 1")).select("id", "ord")


@query("f7_live_per_key", using("searches") + """
, l as (select max(ts) as now from fx_searches), r as (select key_id, search_id, row_number() over (partition by key_id order by ts desc, search_id desc) as rn from fx_searches, l where epoch_us(ts) > epoch_us(now) - 17280000000000)
select key_id as cache_key, search_id as id from r where rn = 1""")
def f7(spark, folder):
    results = _results(spark, folder)
    now = results.agg(F.max("created_at")).first()[0]
    return store.live_per_key(results, ["cache_key"], F.lit(now), 200 * 86400).select("cache_key", "id")


@query("g4_history", using("searches") + "select search_id as id, key_id as cache_key from fx_searches order by ts desc, search_id desc limit 25")
def g4(spark, folder):
    return store.history(_results(spark, folder)).select("id", "cache_key")


@query("g7_bounded_store", using("searches") + """
, r as (select *, row_number() over (partition by key_id order by ts desc, search_id desc) as rn from fx_searches) select search_id as id, key_id as cache_key from r where rn = 1 order by ts desc, search_id desc limit 200""")
def g7(spark, folder):
    return store.bounded_store(_results(spark, folder)).select("id", "cache_key")


@query("c20_cached_as_of", using("cache_ops") + """
, g as (select * from fx_cache_ops where op = 'get'), s as (select cache_key, ts, max(event_id) as result_id from fx_cache_ops where op = 'save' group by 1, 2)
select g.event_id, case when epoch_us(g.ts) - epoch_us(s.ts) < 21600000000 then s.result_id end as result_id, case when epoch_us(g.ts) - epoch_us(s.ts) < 21600000000 then epoch_us(g.ts) - epoch_us(s.ts) end as age_us
from g asof left join s on g.cache_key = s.cache_key and g.ts >= s.ts""")
def c20(spark, folder):
    ops = sample(spark, folder, "cache_ops")
    return store.cached_as_of(ops.where("op = 'get'"), ops.where("op = 'save'")).select("event_id", "result_id", "age_us")


@query("f12_stage_durations", using("progress") + "select ord, epoch_us(lead(ts) over (partition by id order by ts, ord)) - epoch_us(ts) as duration_us from fx_progress")
def f12(spark, folder):
    return quality.stage_durations(sample(spark, folder, "progress")).select("ord", "duration_us")


# --- vectors ---------------------------------------------------------------------------

_THRESHOLD = 0.40
_VEC = """with v as (select vec_id as ord, label % 2 as search_id, embedding::double[] as vec, label = 3 as branded, case when vec_id % 3 = 0 then 1 else 0 end + case when vec_id % 5 = 0 then 2 else 0 end as tags from embeddings) """


def _vector_places(spark, folder):
    return table(spark, folder, "embeddings").select(
        (F.col("label") % 2).cast("bigint").alias("search_id"), F.col("vec_id").alias("ord"), F.lit("node").alias("osm_type"),
        tag_map(
            name=F.concat(F.lit("n"), "vec_id"), brand=F.when(F.col("label") == 3, "b"),
            wikidata=F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("Q"), "vec_id")), wikipedia=F.when(F.col("vec_id") % 5 == 0, F.lit("en:x")),
        ).alias("tags"),
        F.col("embedding").alias("vector"),
    )


@query("c16_similar_pairs", _VEC + f"""
select a.search_id, a.ord as ord_a, b.ord as ord_b, round(list_cosine_similarity(a.vec, b.vec), 5) as cosine from v a join v b on a.search_id = b.search_id and a.ord < b.ord and not a.branded and not b.branded
where list_cosine_similarity(a.vec, b.vec) >= {_THRESHOLD}""")
def c16(spark, folder):
    pairs = resolve.similar_pairs(_vector_places(spark, folder), _THRESHOLD)
    return pairs.select("search_id", "ord_a", "ord_b", F.round("cosine", 5).alias("cosine"))


_VSCORE = "(1 + bit_count({k}.tags) + 8 * ({k}.tags & 1) + 6 * (({k}.tags >> 1) & 1))"
_VBETTER = f"{_VSCORE.format(k='x[1]')} > {_VSCORE.format(k='k')}"
_VSLOT = f"list_position(list_transform(acc, lambda k2: list_cosine_similarity(k2.vec, x[1].vec) >= {_THRESHOLD}), true)"
_VFOLD = _VEC + f"""
, o as (select search_id, list([struct_pack(ord := ord, first_ord := ord, n := 1, tags := tags, vec := vec)] order by ord) as rows from v where not branded group by 1),
f as (select search_id, unnest(list_reduce(rows, lambda acc, x: case when {_VSLOT} is null then list_concat(acc, x) else list_transform(acc, lambda k, i: case when i <> {_VSLOT} then k else
  struct_pack(ord := case when {_VBETTER} then x[1].ord else k.ord end, first_ord := k.first_ord, n := k.n + 1, tags := k.tags | x[1].tags, vec := case when {_VBETTER} then x[1].vec else k.vec end) end) end)) as k from o),
merged as (select search_id, k.ord as ord, k.first_ord as first_ord, k.n as merged from f union all select search_id, ord, ord, 1 from v where branded) """


@query("d6_semantic_dedupe", _VFOLD + "select * from merged")
def d6(spark, folder):
    return resolve.semantic_dedupe(_vector_places(spark, folder), _THRESHOLD).select("search_id", "ord", "first_ord", "merged")


@query("k5_semantic_fold", _VFOLD + "select search_id, merged, count(*) as n from merged group by 1, 2")
def k5(spark, folder):
    """The same fold with groups forced into rounds."""
    out = resolve.semantic_dedupe(_vector_places(spark, folder), _THRESHOLD, max_group=2, batch=4)
    return out.groupBy("search_id", "merged").agg(F.count(F.lit(1)).alias("n"))


@query("e6_duplicate_totals", _VFOLD + """
select search_id, sum(merged - 1)::bigint as merged, case when sum(merged - 1) > 0 then concat('Merged ', sum(merged - 1), ' near-duplicate place name(s).') end as note from merged group by 1""")
def e6(spark, folder):
    return quality.duplicate_totals(resolve.semantic_dedupe(_vector_places(spark, folder), _THRESHOLD))


@query("e6_duplicate_summary", _VFOLD + """
, t as (select search_id, sum(merged - 1)::bigint as merged from merged group by 1),
n as (select concat('Merged ', merged, ' near-duplicate place name(s).') as note, search_id from t where merged > 0 order by search_id limit 5)
select count(*) as groups, sum(merged)::bigint as merged, (select string_agg(note, '|' order by search_id) from n) as notes from t""")
def e6_summary(spark, folder):
    totals = quality.duplicate_totals(resolve.semantic_dedupe(_vector_places(spark, folder), _THRESHOLD))
    return quality.duplicate_summary(totals).select("groups", "merged", F.array_join("notes", "|").alias("notes"))


@query("i29_cosine", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def i29(spark, folder):
    e = table(spark, folder, "embeddings")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(following, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


# --- snapshot files ------------------------------------------------------------------------

@query("a1_read_osm_elements", RICH + """
select concat(osm_type, '/', osm_id) as id, chosen as name, round(lat, 6) as lat, round(lon, 6) as lon, 'overpass' as source from placed""")
def a1(spark, folder):
    path = fresh_path(spark, "osm")
    rich_elements(spark, folder).write.json(path)
    places = readers.read_osm_elements(spark, path)
    return places.select("id", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "source")


_ENTITY = [
    "p_partkey % 5 as search_id", "p_partkey as ord", "case when p_partkey % 31 = 7 then '' else concat('http://www.wikidata.org/entity/Q', p_partkey) end as item",
    "case when p_partkey % 10 = 0 then concat('Q', p_partkey) when p_partkey % 17 = 1 then null else p_name end as itemLabel",
    "case when p_partkey % 3 = 0 then concat(' hall  no. ', p_partkey) end as itemDescription",
    "case when p_partkey % 11 = 0 then 'nowhere' else concat('Point(', p_partkey * 0.5, ' ', p_size * 0.25, ')') end as coord",
    "case when p_partkey % 2 = 0 then lower(p_type) end as typeLabel", "case when p_partkey % 4 = 0 then 'https://x.example' end as website",
    "case when p_partkey % 6 = 0 then concat('category:', p_name) when p_partkey % 6 = 1 then p_name end as commons",
]


@query("a2_read_entity_places", f"""
with e as (select {', '.join(_ENTITY)} from part)
select 'wikidata/Q' || ord as id, ord as osm_id, itemLabel as name, round(split_part(replace(replace(coord, 'Point(', ''), ')', ''), ' ', 2)::double, 6) as lat,
  coalesce(typeLabel, 'Place') as category_label, 'Category:' || replace(commons, 'category:', '') as commons, 2 + (itemDescription is not null)::int + (website is not null)::int + (commons is not null)::int as n_tags
from e where item <> '' and itemLabel is not null and itemLabel not like 'Q%' and coord <> 'nowhere'""")
def a2(spark, folder):
    path = fresh_path(spark, "entities")
    table(spark, folder, "part").selectExpr(*_ENTITY).write.json(path)
    p = readers.read_entity_places(spark, path)
    return p.select("id", "osm_id", "name", F.round("lat", 6).alias("lat"), "category_label", F.col("tags")["wikimedia_commons"].alias("commons"), F.size("tags").alias("n_tags"))


@query("b8_named_entities", f"""
with e as (select {', '.join(_ENTITY)} from part)
select search_id, count(*) as n from e where item <> '' and itemLabel is not null and itemLabel not like 'Q%' and coord <> 'nowhere' group by 1""")
def b8(spark, folder):
    rows = table(spark, folder, "part").selectExpr(*_ENTITY)
    return quality.count_by(readers.entity_places(rows, F.lit("Place"), F.lit("custom")), "search_id")


_GAZ = [
    "c_nationkey as search_id", "c_custkey as ord", "case c_custkey % 4 when 0 then 'node' when 1 then 'way' when 2 then 'relation' else 'area' end as osm_type",
    "case when c_custkey % 13 = 5 then null else c_custkey end as osm_id", "case when c_custkey % 9 = 4 then 'x' else cast(24.5 as varchar(9)) end as lat", "cast(67.25 as varchar(9)) as lon",
    "case when c_custkey % 5 <> 0 then c_name end as name", "concat('Display ', c_custkey, ', Karachi') as display_name",
    "case when c_custkey % 2 = 0 then 'amenity' end as category", "case when c_custkey % 3 <> 0 then 'fast_food' end as type", "c_custkey % 7 as road",
]
_GAZ_OK = "osm_type <> 'area' and osm_id is not null and osm_id <> 0 and lat <> 'x'"


def _gazetteer_rows(spark, folder):
    rows = table(spark, folder, "customer").selectExpr(*_GAZ)
    return rows.withColumn("extratags", F.create_map(F.lit("wheelchair"), F.lit("yes"))).withColumn(
        "address", F.create_map(F.lit("road"), F.concat(F.lit("Road "), "road"), F.lit("city"), F.lit("Karachi"), F.lit("country"), F.lit("Pakistan"))
    ).drop("road")


@query("a3_read_gazetteer_places", f"""
with g as (select {', '.join(_GAZ)} from customer)
select ord, osm_type || '/' || osm_id as id, coalesce(name, 'Display ' || ord) as name, 'Road ' || road as street, case when category is not null and type is not null then 'fast_food' end as amenity,
  case when type is not null then 'fast food' else 'Place' end as category_label, 4 + (category is not null and type is not null)::int as n_tags from g where {_GAZ_OK}""")
def a3(spark, folder):
    path = fresh_path(spark, "gazetteer")
    _gazetteer_rows(spark, folder).write.json(path)
    p = readers.read_gazetteer_places(spark, path)
    return p.select("ord", "id", "name", F.col("tags")["addr:street"].alias("street"), F.col("tags")["amenity"].alias("amenity"), "category_label", F.size("tags").alias("n_tags"))


@query("b9_valid_gazetteer_rows", f"with g as (select {', '.join(_GAZ)} from customer) select search_id, count(*) as n from g where {_GAZ_OK} group by 1")
def b9(spark, folder):
    return quality.count_by(readers.gazetteer_places(_gazetteer_rows(spark, folder)), "search_id")


_GOOGLE = using("places") + """
, f as (select ord, search_id, case when ord % 17 = 3 then null else 'ch' || ord end as place_id, case when ord % 19 = 2 then '  ' else name end as name, case when ord % 23 <> 1 then lat end as lat,
    case when ord % 4 <> 0 then (ord % 9 + 1) * 0.5 end as rating from fx_places),
d as (select 'ch' || ord as pid, 'Full ' || name as dname, case when ord % 3 = 0 then 4.5 end as drating, case when ord % 5 = 0 then '+1 ' || ord end as phone from fx_places where ord % 2 = 0),
g as (select f.*, d.* from f left join d on f.place_id = d.pid where place_id is not null and trim(name) <> '' and lat is not null) """


def _google(spark, folder):
    p = sample(spark, folder, "places")
    found = p.select(
        "search_id", "ord", F.expr("case when ord % 17 = 3 then null else concat('ch', ord) end").alias("place_id"), F.expr("case when ord % 19 = 2 then '  ' else name end").alias("name"),
        F.expr("case when ord % 23 <> 1 then cast(lat as double) end").alias("lat"), F.col("lon").cast("double").alias("lon"), F.array(F.lit("premise"), F.lit("tourist_stop")).alias("types"),
        F.expr("case when ord % 4 <> 0 then cast((ord % 9 + 1) * 0.5 as double) end").alias("rating"), F.lit(7).cast("bigint").alias("user_ratings_total"), F.lit("Somewhere").alias("formatted_address"),
    )
    details = p.where("ord % 2 = 0").select(
        F.concat(F.lit("ch"), "ord").alias("place_id"), F.concat(F.lit("Full "), "name").alias("name"), F.lit("https://s.example").alias("website"),
        F.expr("case when ord % 3 = 0 then 4.5D end").alias("rating"), F.expr("case when ord % 5 = 0 then concat('+1 ', ord) end").alias("formatted_phone_number"),
    )
    return found, details


@query("a4_read_google_places", _GOOGLE + """
select 'google/' || place_id as id, coalesce(dname, name) as name, case when coalesce(drating, rating) is null then 50 else cast(floor(coalesce(drating, rating) * 20 + 0.5) as int) end as quality,
  'Tourist stop' as category_label, case when coalesce(drating, rating) is not null then concat('Rated ', regexp_replace(coalesce(drating, rating)::varchar, '\\.0+$', ''), '/5 by 7 Google reviewers.') else '' end as summary, phone from g""")
def a4(spark, folder):
    found, details = _google(spark, folder)
    a, b = fresh_path(spark, "google"), fresh_path(spark, "details")
    found.write.json(a)
    details.write.json(b)
    p = readers.read_google_places(spark, a, b)
    return p.select("id", "name", "quality", "category_label", "summary", F.col("contact.phone").alias("phone"))


@query("c18_details_win", _GOOGLE + "select ord, dname is not null as detailed, 3 + (coalesce(drating, rating) is not null)::int + (dname is not null)::int + (phone is not null)::int as n_tags from g")
def c18(spark, folder):
    from functools import reduce

    found, details = _google(spark, folder)
    extra = "url international_phone_number overview formatted_address".split()
    details = reduce(lambda d, c: d.withColumn(c, F.lit(None).cast("string")), extra, details)
    details = details.withColumn("user_ratings_total", F.lit(None).cast("bigint")).withColumn("weekday_text", F.lit(None).cast("array<string>")).withColumn("types", F.lit(None).cast("array<string>"))
    p = readers.google_places(found, details)
    return p.select("ord", F.col("tags")["website"].isNotNull().alias("detailed"), F.size("tags").alias("n_tags"))


@query("e12_dropped_counts", _GOOGLE + "select f.search_id, count(*) - (select count(*) from g where g.search_id = f.search_id) as dropped from f group by 1")
def e12_dropped(spark, folder):
    found, details = _google(spark, folder)
    extra = "url international_phone_number overview formatted_address".split()
    for c in extra:
        details = details.withColumn(c, F.lit(None).cast("string"))
    details = details.withColumn("user_ratings_total", F.lit(None).cast("bigint")).withColumn("weekday_text", F.lit(None).cast("array<string>")).withColumn("types", F.lit(None).cast("array<string>"))
    return quality.dropped_counts(found, readers.google_places(found, details))


def _corpus(spark, folder):
    p = sample(spark, folder, "places").select(
        "ord", F.concat(F.lit("City "), "search_id").alias("city"), F.lit("Land").alias("country"), F.when(F.col("ord") % 3 == 0, "cjk").otherwise("latin").alias("script"),
        F.lit("museums").alias("keyword"),
        F.struct("id", "osm_type", F.col("ord").alias("osm_id"), "name", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"),
                 tag_map(brand=F.col("brand")).alias("tags"), F.lit("custom").alias("category"), F.col("amenity").alias("category_label"), "source").alias("place"),
    )
    path = fresh_path(spark, "corpus")
    writers.write_corpus(p, path)
    return path


@query("a5_read_corpus", using("places") + "select ord, id, name, brand from fx_places order by ord limit 500")
def a5(spark, folder):
    rows = readers.read_corpus(spark, _corpus(spark, folder), 500)
    return rows.select("ord", "place.id", "place.name", F.col("place.tags")["brand"].alias("brand"))


@query("a6_write_corpus", using("places") + "select case when ord % 3 = 0 then 'cjk' else 'latin' end as script, count(*) as n from fx_places group by 1")
def a6(spark, folder):
    return quality.count_by(readers.read_corpus(spark, _corpus(spark, folder)), "script")


@query("a13_read_entity_claims", using("entity_claims") + "select entity_id, property, count(*) as n, count(distinct value) as n_values from fx_entity_claims group by 1, 2")
def a13(spark, folder):
    """Claims gathered into entity documents, written as JSON and read back one row per claim."""
    path = fresh_path(spark, "claims")
    claims = sample(spark, folder, "entity_claims")
    per = claims.groupBy("entity_id", "property").agg(F.collect_list(F.struct("datatype", "value")).alias("v"))
    per.select("entity_id", F.create_map("property", "v").alias("claims")).write.json(path)
    rows = readers.read_entity_claims(spark, path)
    return rows.groupBy("entity_id", "property").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"))


# --- streams -----------------------------------------------------------------------------------

def _stream(spark, folder, name):
    shape = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(shape).parquet(f"{folder}/{name}.parque[t]")


@query("j1_resolve_stream", using("claims") + "select place_id, min(region_ord) as region_ord from fx_claims group by 1")
def j1(spark, folder):
    found = _stream(spark, folder, "lineitem").selectExpr("l_suppkey % 25 as region_ord", "l_partkey as place_id")
    claims = fresh_path(spark, "claims")
    jobs.run_available(jobs.resolve_stream(found, claims, fresh_path(spark, "checkpoint")))
    return jobs.read_claims(spark, claims)


# The times of a key in order; one joins the passed ones when the last of them is six hours old.
@query("j2_dedupe_requests", """
with t as (select concat('u', user_id) as cache_key, list([epoch_us(ts::timestamp)] order by ts) as times from events where event_type = 'click' group by 1)
select cache_key, unnest(list_reduce(times, lambda acc, x: case when x[1] - acc[-1] >= 21600000000 then list_concat(acc, x) else acc end)) as us from t""")
def j2(spark, folder):
    requests = _stream(spark, folder, "events").where("event_type = 'click'").selectExpr("concat('u', user_id) as cache_key", "cast(ts as timestamp) as ts")
    out = fresh_path(spark, "passed")
    passed = jobs.dedupe_requests(requests)
    jobs.run_available(passed.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "checkpoint")))
    return spark.read.schema(jobs.PASSED).parquet(out).select("cache_key", F.unix_micros("ts").alias("us"))


def _progress_rows(df):
    stage = "case event_type when 'signup' then 'starting' when 'view' then 'discovering' when 'click' then 'filtering' when 'purchase' then 'done' else 'failed' end as stage"
    return df.selectExpr("concat('u', user_id) as id", "cast(ts as timestamp) as ts", "event_id as ord", stage)


_LATEST = using("progress") + "select id, arg_max(stage, (ts, ord)) as stage, arg_max(ord, (ts, ord)) as ord from fx_progress group by id"


@query("j3_latest_stage", _LATEST)
def j3(spark, folder):
    out = fresh_path(spark, "stages")
    live = jobs.latest_stage(_progress_rows(_stream(spark, folder, "events")))
    sink = live.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch_id={n}"))
    jobs.run_available(sink.option("checkpointLocation", fresh_path(spark, "checkpoint")))
    emitted = spark.read.schema(jobs.STAGE).parquet(f"{out}/batch_id=*")
    return jobs.latest_stage_batch(emitted).select("id", "stage", "ord")


@query("j3_latest_stage_batch", _LATEST)
def j3_batch(spark, folder):
    return jobs.latest_stage_batch(_progress_rows(table(spark, folder, "events"))).select("id", "stage", "ord")


@query("j4_job_counters", """
with c as (select l_suppkey % 25 as region_ord, l_shipdate as ts, case l_linenumber % 4 when 0 then 'searching' when 1 then 'done' when 2 then 'failed' else 'exporting' end as status, l_partkey as place_count from lineitem),
n as (select region_ord, max((ts, status, place_count)) as s from c group by 1)
select count(*) as total, count(*) filter (where s[2] in ('done', 'skipped', 'failed')) as finished, count(*) filter (where s[2] = 'failed') as failed, sum(s[3])::bigint as places from n""")
def j4(spark, folder):
    """The totals after the last of several micro-batches."""
    parts = fresh_path(spark, "changes")
    rows = table(spark, folder, "lineitem").selectExpr(
        "l_suppkey % 25 as region_ord", "cast(l_shipdate as timestamp) as ts",
        "case l_linenumber % 4 when 0 then 'searching' when 1 then 'done' when 2 then 'failed' else 'exporting' end as status", "l_partkey as place_count",
    )
    # Three micro-batches; the files of each grow in number with the input, not in size.
    files = rows.rdd.getNumPartitions()
    rows.repartition(3 * files, "place_count").write.parquet(parts)
    changes = spark.readStream.schema(jobs.CHANGES).option("maxFilesPerTrigger", files).parquet(parts)
    counters = fresh_path(spark, "counters")
    jobs.run_available(jobs.job_counters(changes, counters, fresh_path(spark, "checkpoint")))
    last = F.max_by(F.struct("total", "finished", "failed", "places"), "batch_id").alias("last")
    return jobs.read_counters(spark, counters).agg(last).select("last.*")


