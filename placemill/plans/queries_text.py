"""Registered queries over whole texts: cleaning, HTML, hours claims, articles, excerpts."""

from __future__ import annotations

from pyspark.sql import functions as F

from placemill.functions import hours as hr, tags as tg, text as tx
from placemill.operators import content, quality
from placemill.plans.queries_places import RICH, clean, non_latin
from placemill.plans.registry import query
from placemill.plans.samples import place_tags, rich_places, sample, table, using
from placemill.sources.readers import page_documents, page_warnings

# --- documents -----------------------------------------------------------------

@query("i1_clean_text", f"""
select doc_id, length({clean('text')}) as n, md5({clean('text')}) as digest, {clean('text')}[1:40] as head from documents""")
def i1(spark, folder):
    c = tx.clean_text(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.length(c).alias("n"), F.md5(c).alias("digest"), F.substring(c, 1, 40).alias("head"))


@query("i3_to_latin1_safe", """
with d as (select doc_id, case when doc_id % 3 = 0 then '“Ünï”–x… ‘y’ • z 塔 ' || text else text end as text from documents),
n as (select doc_id, replace(replace(replace(replace(replace(replace(replace(text, '“', '"'), '”', '"'), '‘', ''''), '’', ''''), '–', '-'), '•', '-'), '…', '...') as t from d)
select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(regexp_replace(t, '[\\x00-\\x1F\\x7F-\\x{9F}\\x{A0}]', ' ', 'g')), '[^\\x20-\\x{FF}]', '', 'g'), 'ß', 'ß', 'g'), '\\s+', ' ', 'g'))) as digest from n""")
def i3(spark, folder):
    head = F.when(F.col("doc_id") % 3 == 0, "“Ünï”–x… ‘y’ • z 塔 ").otherwise("")
    return table(spark, folder, "documents").select("doc_id", F.md5(tx.to_latin1_safe(F.concat(head, "text"))).alias("digest"))


@query("i4_is_mostly_non_latin", f"""
with d as (select doc_id, case when doc_id % 4 = 0 then concat(repeat('塔', 1 + cast(n_chars // 3 as int)), text) else text end as text from documents)
select doc_id, {non_latin('text')} as non_latin from d""")
def i4(spark, folder):
    d = table(spark, folder, "documents")
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(F.expr("repeat('塔', 1 + cast(n_chars div 3 as int))"), "text")).otherwise(F.col("text"))
    return d.select("doc_id", tx.is_mostly_non_latin(text).alias("non_latin"))


@query("i5_has_readable_content", """
with d as (select doc_id, case doc_id % 3 when 0 then text when 1 then regexp_replace(text, '[A-Za-z]', '', 'g') else concat(doc_id, ' é') end as text from documents)
select doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 2 or regexp_matches(text, '[0-9]{4}') as readable from d""")
def i5(spark, folder):
    text = F.expr("case doc_id % 3 when 0 then text when 1 then regexp_replace(text, '[A-Za-z]', '') else concat(doc_id, ' é') end")
    return table(spark, folder, "documents").select("doc_id", tx.has_readable_content(text).alias("readable"))


@query("i30_percent", """
select source, count(*) as n, count(*) filter (where lang = 'en') as english,
  case when count(*) = 0 then 'n/a' else concat(printf('%.1f', round(100.0 * count(*) filter (where lang = 'en') / count(*), 1)), '%') end as share from documents group by source""")
def i30(spark, folder):
    g = table(spark, folder, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("english"))
    return g.withColumn("share", tx.percent(F.col("english"), F.col("n")))


@query("i38_split_sentences", """
select doc_id, len(list_filter(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: regexp_matches(s, '[^\\s\\x{A0}]'))) as sentences from documents""")
def i38(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.size(hr.split_sentences(F.col("text"))).alias("sentences"))


@query("e5_upper_median", """
select lang, list_sort(list(n_chars))[1 + len(list(n_chars)) // 2] as upper_median from documents group by lang""")
def e5(spark, folder):
    return quality.upper_median(table(spark, folder, "documents"), ["lang"], "n_chars")


@query("e7_count_by_script", "select lang, count(*) as n from documents group by lang")
def e7(spark, folder):
    return quality.count_by(table(spark, folder, "documents"), "lang")


# --- pages -----------------------------------------------------------------------

STRIP = (
    "trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace("
    "regexp_replace(regexp_replace(regexp_replace(html, '<script[\\s\\S]*?</script>', ' ', 'gi'), '<style[\\s\\S]*?</style>', ' ', 'gi'), "
    "'<!--[\\s\\S]*?-->', ' ', 'g'), '<(br|p|div|li|h[1-6]|tr|section|article)[^>]*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), "
    "'&nbsp;', ' '), '&amp;', '&'), '&quot;', '\"'), '&#39;|&apos;', '''', 'g'), '&lt;', '<'), '&gt;', '>'), "
    "'[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))"
)


@query("i12_strip_html", f"select page_id, length({STRIP}) as n, md5({STRIP}) as digest from pages")
def i12(spark, folder):
    t = tx.strip_html(F.col("html"))
    return table(spark, folder, "pages").select("page_id", F.length(t).alias("n"), F.md5(t).alias("digest"))


_TITLE = clean("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")


@query("i13_html_title", f"""
with p as (select page_id, url, case when page_id % 3 = 0 then regexp_replace(html, '(?is)<title', '<no', 'g') else html end as html from pages)
select page_id, coalesce(nullif({_TITLE}[1:120], ''), nullif(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), ''), url) as title from p""")
def i13(spark, folder):
    html = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "(?is)<title", "<no")).otherwise(F.col("html"))
    return table(spark, folder, "pages").select("page_id", tx.html_title(html, F.col("url")).alias("title"))


@query("i14_strip_tags_short", f"select page_id, {clean('regexp_replace(html, ' + chr(39) + '<[^>]*>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}[1:200] as credit from pages")
def i14(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.strip_tags_short(F.col("html")).alias("credit"))


@query("i15_extract_urls", """
select page_id, len(u) as n, array_to_string(list_transform(u, lambda x: regexp_replace(x, '[),.;]+$', '')), ' ') as urls
from (select page_id, regexp_extract_all(concat(html, ' (see HTTPS://a.example/b).'), '(?i)https?://[^\\s",]+') as u from pages)""")
def i15(spark, folder):
    u = tx.extract_urls(F.concat("html", F.lit(" (see HTTPS://a.example/b).")))
    return table(spark, folder, "pages").select("page_id", F.size(u).alias("n"), F.array_join(u, " ").alias("urls"))


@query("a8_read_pages", f"select page_id as doc_id, length({STRIP}) as n, length({STRIP}) >= 200 as usable from pages")
def a8(spark, folder):
    docs = page_documents(table(spark, folder, "pages"))
    return docs.select("doc_id", F.length("text").alias("n"), "usable")


@query("a8_page_warnings", f"select page_id as doc_id, concat('Source ', url, ' returned too little readable text to use.') as warning from pages where length({STRIP}) < 200")
def a8_warnings(spark, folder):
    return page_warnings(page_documents(table(spark, folder, "pages")))


@query("b13_filter_images", """
with p as (select page_id, case page_id % 6 when 0 then replace(url, 'http://', 'https://') when 1 then 'https://de.wikipedia.org/a.jpg' when 2 then 'http://upload.wikimedia.org/a.jpg'
  when 3 then 'https://live.staticflickr.com/a.jpg' when 4 then 'http://localhost:4000/api/google-photo?ref=1' else 'https://wikipedia.org.evil.example/a.jpg' end as url,
  case page_id % 5 when 0 then 'image/svg+xml' when 1 then null else 'image/png' end as mime, case page_id % 6 when 3 then 'flickr' else 'commons' end as source, 1000 + 100 * (page_id % 10) as width from pages)
select page_id from p where coalesce(mime, 'image/png') = 'image/png' and (regexp_matches(url, '^https://(de.wikipedia.org|live.staticflickr.com)/') or starts_with(url, 'http://localhost')) and (source <> 'flickr' or width >= 1600)""")
def b13(spark, folder):
    from placemill.operators.photos import filter_images

    rows = table(spark, folder, "pages").selectExpr(
        "page_id", "case page_id % 6 when 0 then replace(url, 'http://', 'https://') when 1 then 'https://de.wikipedia.org/a.jpg' when 2 then 'http://upload.wikimedia.org/a.jpg' "
        "when 3 then 'https://live.staticflickr.com/a.jpg' when 4 then 'http://localhost:4000/api/google-photo?ref=1' else 'https://wikipedia.org.evil.example/a.jpg' end as url",
        "case page_id % 5 when 0 then 'image/svg+xml' when 1 then null else 'image/png' end as mime",
        "case page_id % 6 when 3 then 'flickr' else 'commons' end as source", "1000 + 100 * (page_id % 10) as width",
    )
    return filter_images(rows).select("page_id")


# --- hours ---------------------------------------------------------------------------

# Day sets and times by hand for the tags and sentences of the view.
HOURS = using("hours") + """
, t as (select event_id, tag, summary,
  case tag when 'Th-Tu 10:00-17:00' then 123 when 'Mo-Fr 09:00-17:00' then 31 when '24/7' then 127 when '10:00-23:00' then 127 when 'Mo,We,Fr 09:00-12:00' then 21 end as covered,
  regexp_extract_all(coalesce(tag, ''), '\\d{1,2}:\\d{2}') as tag_times,
  list_filter(list_transform(regexp_extract_all(summary, '[^.!?]+[.!?]*'), lambda s: trim(s)), lambda s: s <> '') as sentences from fx_hours),
j as (select event_id, covered, tag_times, sentences, list_transform(sentences, lambda s: struct_pack(s := s,
  claims := regexp_matches(lower(s), '\\b(open|opens|opening|closed|closes|closing|hours)\\b') and (regexp_matches(lower(s), '\\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday|daily|weekdays?|weekends?)\\b') or regexp_matches(s, '\\b\\d{1,2}:\\d{2}\\b')),
  days := case when contains(s, 'Monday to Friday') then 31 when contains(s, 'daily') then 127 when contains(s, 'weekends') then 96 when contains(s, 'Wednesday') then 4 else 0 end,
  times := list_transform(regexp_extract_all(s, '\\b\\d{1,2}:\\d{2}\\b'), lambda x: lpad(x, 5, '0')))) as judged from t),
k as (select event_id, list_filter(judged, lambda g: not g.claims or (covered is not null and (g.days & ~covered) = 0 and list_has_all(tag_times, g.times))) as kept, judged from j) """


@query("i34_times_in", using("hours") + """
select event_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(concat(coalesce(tag, ''), ' ', summary), '\\b(\\d{1,2}:\\d{2})\\b', 1), lambda t: lpad(t, 5, '0')))), ' ') as times from fx_hours""")
def i34(spark, folder):
    text = F.concat_ws(" ", F.coalesce("tag", F.lit("")), "summary")
    return sample(spark, folder, "hours").select("event_id", F.array_join(F.array_sort(hr.times_in(text)), " ").alias("times"))


@query("i35_days_covered", HOURS + "select event_id, covered from t")
def i35(spark, folder):
    return sample(spark, folder, "hours").select("event_id", hr.days_covered(F.col("tag")).alias("covered"))


@query("i36_days_claimed", using("hours") + """
select event_id, case when contains(summary, 'Monday to Friday') then 31 when contains(summary, 'daily') then 127 when contains(summary, 'weekends') then 96
  when contains(summary, 'Wednesday') then 4 else 0 end as claimed from fx_hours""")
def i36(spark, folder):
    return sample(spark, folder, "hours").select("event_id", hr.days_claimed(F.col("summary")).alias("claimed"))


@query("i37_asserts_hours", HOURS + "select event_id, len(list_filter(judged, lambda g: g.claims)) as claims, len(judged) as sentences from j")
def i37(spark, folder):
    parts = hr.split_sentences(F.col("summary"))
    return sample(spark, folder, "hours").select("event_id", F.size(F.filter(parts, hr.asserts_hours)).alias("claims"), F.size(parts).alias("sentences"))


@query("m1_strip_unsupported_hours", HOURS + """
select event_id, array_to_string(list_transform(kept, lambda g: g.s), ' ') as kept, len(judged) - len(kept) as removed from k""")
def m1(spark, folder):
    out = hr.strip_unsupported_hours(F.col("summary"), F.col("tag"))
    return sample(spark, folder, "hours").select("event_id", out.alias("o")).select("event_id", "o.kept", F.size("o.removed").alias("removed"))


# --- articles ---------------------------------------------------------------------------

@query("e4_article_quality", using("articles") + """
select count(*) as attempted, count(*) filter (where llm_generated = 1) as generated, count(*) filter (where llm_generated <> 1) as fell_back,
  count(*) filter (where length(trim(overview)) < 40) as thin_overview,
  count(*) filter (where regexp_matches(concat_ws(' ', overview, history, visiting), '[\\x{3400}-\\x{9FFF}\\x{400}-\\x{4FF}\\x{600}-\\x{6FF}\\x{900}-\\x{97F}\\x{E00}-\\x{E7F}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]')) as residual_script,
  sum(doc_id % 3)::bigint as redactions from fx_articles""")
def e4(spark, folder):
    rows = sample(spark, folder, "articles").withColumn("llm_generated", F.col("llm_generated") == 1)
    rows = rows.withColumn("highlights", F.expr("cast(array() as array<string>)"))
    return quality.article_quality(rows.withColumn("redactions", F.array_repeat(F.lit("x"), (F.col("doc_id") % 3).cast("int"))))


@query("e4_section_fill", using("articles") + """
, c as (select count(*) filter (where length(trim(history)) > 20) as history, count(*) filter (where length(trim(visiting)) > 20) as visiting, count(*) filter (where doc_id % 5 >= 3) as highlights, count(*) as n from fx_articles)
select section, filled, concat(printf('%.1f', round(100.0 * filled / n, 1)), '%') as rate from (select n, unnest([struct_pack(section := 'history', filled := history),
  struct_pack(section := 'visiting', filled := visiting), struct_pack(section := 'highlights', filled := highlights)], recursive := true) from c)""")
def e4_fill(spark, folder):
    rows = sample(spark, folder, "articles").withColumn("highlights", F.array_repeat(F.lit("h"), (F.col("doc_id") % 5).cast("int")))
    return quality.section_fill(rows)


@query("m6_fallback_article", using("articles") + f"""
, a as (select doc_id, overview, {clean('history')} as extract, visiting from fx_articles)
select doc_id as place_id, concat_ws(' ', case when doc_id % 2 = 0 then concat('Hall ', doc_id, ' is a hall.') else concat('Hall ', doc_id, ' is an archive.') end,
  case when length(extract) > 40 then array_to_string(string_split_regex(regexp_replace(extract, '\\.\\s+', '.' || chr(1), 'g'), '\\x01')[1:6], ' ') end)[1:3000] as overview,
  array_to_string(string_split_regex(regexp_replace(visiting, '\\.[\\s]+', '.' || chr(1), 'g'), '\\x01')[1:8], ' ') as visiting,
  case when doc_id % 3 = 0 then concat('Address: Street ', doc_id, '. Phone: 1') end as practical,
  case when doc_id % 3 = 1 then 1 else 0 end + 1 as n_highlights from a""")
def m6(spark, folder):
    df = sample(spark, folder, "articles").select(
        F.col("doc_id").alias("place_id"), F.concat(F.lit("Hall "), "doc_id").alias("name"), F.lit("Archive").alias("category_label"),
        F.when(F.col("doc_id") % 2 == 0, "a hall").alias("description"), tx.clean_text(F.col("history")).alias("extract"),
        F.col("visiting").alias("voyage"),
        F.struct(
            F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Street "), "doc_id")).alias("address"),
            F.when(F.col("doc_id") % 3 == 0, "1").alias("phone"), F.lit(None).cast("string").alias("website"),
            F.when(F.col("doc_id") % 3 == 1, "24/7").alias("opening_hours"),
        ).alias("contact"),
        F.expr("array(struct('Height' as label, '3' as value))").alias("facts"),
        F.expr("cast(array() as array<struct<label:string,text:string>>)").alias("extras"),
    )
    out = content.fallback_article(df)
    return out.select("place_id", "overview", "visiting", "practical", F.size("highlights").alias("n_highlights"))


_GUARD = """list_filter(list_filter(list_transform(regexp_extract_all({c}, '[^.!?]+[.!?]*'), lambda s: trim(s)), lambda s: s <> ''),
  lambda s: not (regexp_matches(lower(s), '\\b(open|opens|opening|closed|closes|closing|hours)\\b') and (regexp_matches(lower(s), '\\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday|daily|weekdays?|weekends?)\\b')
  or regexp_matches(s, '\\b\\d{{1,2}}:\\d{{2}}\\b') or regexp_matches(lower(s), '\\b\\d{{1,2}}\\s*(am|pm)\\b'))))"""


@query("m7_guard_article", using("articles") + f"""
, a as (select doc_id, {clean("concat(overview, ' Open daily. ')")} as o, {clean('visiting')} as v from fx_articles),
g as (select doc_id, {_GUARD.format(c='o')} as o, {_GUARD.format(c="coalesce(v, '')")} as v from a)
select doc_id, md5(array_to_string(o, ' ')) as overview, md5(nullif(array_to_string(v, ' '), '')) as visiting, length(array_to_string(o, ' ')) >= 40 as usable from g""")
def m7(spark, folder):
    df = sample(spark, folder, "articles").withColumn("overview", F.concat("overview", F.lit(" Open daily. "))).drop("history")
    df = df.withColumn("tag", F.lit(None).cast("string")).withColumn("highlights", F.array(F.lit("Open daily from 9:00")))
    out = content.guard_article(df)
    return out.select("doc_id", F.md5("overview").alias("overview"), F.md5("visiting").alias("visiting"), "usable")


@query("m10_article_sections", using("articles") + """
, r as (select doc_id as place_id, unnest([
  struct_pack(pos := 0, heading := 'Overview', body := case when regexp_matches(overview, '[A-Za-z][^A-Za-z]*[A-Za-z]') or regexp_matches(overview, '[0-9]{4}') then overview else 'No English-language description is available for this location.' end),
  struct_pack(pos := 1, heading := case when llm_generated <> 1 and coalesce(history, '') <> '' then 'Background (source extract)' else 'History' end,
    body := case when llm_generated <> 1 and coalesce(history, '') <> '' then 'The following is quoted directly from the sources listed for this place; no summary was generated for it.' || chr(10) || history when regexp_matches(history, '[A-Za-z][^A-Za-z]*[A-Za-z]') or regexp_matches(history, '[0-9]{4}') then history end),
  struct_pack(pos := 5, heading := 'Visiting', body := case when regexp_matches(visiting, '[A-Za-z][^A-Za-z]*[A-Za-z]') or regexp_matches(visiting, '[0-9]{4}') then visiting end)], recursive := true) from fx_articles where doc_id % 7 <> 0
  union all select doc_id, 0, 'Description', 'No English-language description is available for this location.' from fx_articles where doc_id % 7 = 0)
select place_id, pos, heading, md5(body) as body from r where coalesce(body, '') <> ''""")
def m10(spark, folder):
    df = sample(spark, folder, "articles").withColumn("place_id", F.col("doc_id")).withColumn("llm_generated", F.col("llm_generated") == 1)
    df = df.withColumn("summary", F.lit("")).withColumn("raw_name", F.lit("")).withColumn("display_name", F.lit("Hall")).withColumn("has_article", F.col("doc_id") % 7 != 0)
    return content.article_sections(df).select("place_id", "pos", "heading", F.md5("body").alias("body"))


@query("m12_source_block", using("rich") + f"""
select ord as place_id, array_to_string(list_filter([concat('NAME: ', coalesce(name_en, 'x')), 'TYPE: Place', concat('COORDINATES: ', printf('%.5f, %.5f', lat::double, lon::double)),
  case when description is not null then concat('WIKIDATA DESCRIPTION: ', description) end,
  case when ord % 2 = 0 then concat(chr(10), 'STRUCTURED FACTS (Wikidata):', chr(10), '- Height: ', ord) end,
  case when amenity is not null or phone is not null then concat(chr(10), 'OPENSTREETMAP TAGS:',
    coalesce(chr(10) || '- amenity = ' || amenity, ''), coalesce(chr(10) || '- phone = ' || phone, '')) end,
  case when ord % 5 = 0 then concat(chr(10), 'WIKIPEDIA ARTICLE:', chr(10), 'About ', ord) end,
  case when ord % 7 = 0 then concat(chr(10), 'ADDITIONAL SOURCE (page):', chr(10), 'More ', ord) end], lambda x: x is not null), chr(10)) as block from fx_rich""")
def m12(spark, folder):
    df = sample(spark, folder, "rich").select(
        F.col("ord").alias("place_id"), F.coalesce("name_en", F.lit("x")).alias("name"), F.lit("Place").alias("category_label"),
        F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "description",
        F.expr("case when ord % 2 = 0 then array(struct('Height' as label, cast(ord as string) as value)) else cast(array() as array<struct<label:string,value:string>>) end").alias("facts"),
        tg.tag_map(amenity=F.col("amenity"), phone=F.col("phone"), source__x=F.lit("y")).alias("tags"),
        F.expr("case when ord % 5 = 0 then concat('About ', ord) end").alias("extract"), F.lit(None).cast("string").alias("voyage"),
    )
    extras = df.where("place_id % 7 = 0").select("place_id", F.col("place_id").alias("ord"), F.lit("page").alias("label"), F.concat(F.lit("More "), "place_id").alias("text"))
    return content.source_block(df, extras)


@query("m11_assemble_sources", using("rich") + """
select ord, array_to_string(list_filter([case when wikipedia is not null and not contains(wikipedia, ':') then 'Wikipedia — ' || wikipedia end,
  case when wikidata is not null then 'Wikidata — ' || trim(wikidata) end, 'OpenStreetMap — ' || id], lambda x: x is not null), '; ') as sources from fx_rich""")
def m11(spark, folder):
    article = F.when(~F.col("wikipedia").contains(":"), F.struct(F.col("wikipedia").alias("title"), tg.article_url(F.col("wikipedia")).alias("url")))
    none = F.lit(None).cast("struct<title:string,url:string>")
    items = content.assemble_sources(article, none, tg.entity_id(F.col("wikidata")), F.col("id"), tg.osm_url(F.col("osm_type"), F.col("osm_id")))
    return sample(spark, folder, "rich").select("ord", F.array_join(F.transform(items, lambda s: s["label"]), "; ").alias("sources"))


# --- excerpts, articles by title, labels, facts --------------------------------------------

def _needles(spark, folder):
    return sample(spark, folder, "needles")


def _docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text", F.col("source").alias("label"), F.concat(F.lit("https://d/"), "doc_id").alias("url"))


_MENTION = using("needles") + ", n as (select place_id, lower(trim(name)) as needle from fx_needles), m as (select doc_id, place_id, needle, text, lower(text) as low from documents join n on length(needle) >= 3 and contains(lower(text), needle)) "


@query("c9_excerpts", _MENTION + "select doc_id, place_id from m")
def c9(spark, folder):
    return content.excerpts(_docs(spark, folder), _needles(spark, folder)).select("doc_id", "place_id")


@query("c9_excerpts_by_anchor", _MENTION + "select doc_id, place_id from m")
def c9_anchor(spark, folder):
    return content.excerpts(_docs(spark, folder), _needles(spark, folder), edge=2).select("doc_id", "place_id")


_WIN = (
    "trim(regexp_replace(text[greatest(at{i} - 350, 1):least(at{i} - 1 + length(needle) + 350, length(text))], '[\\s\\x{{A0}}]+', ' ', 'g'))"
)


@query("k1_excerpt_windows", _MENTION + f"""
, a1 as (select *, instr(low, needle) as at1 from m), b1 as (select *, least(at1 - 1 + length(needle) + 350, length(text)) as end1 from a1),
a2 as (select *, instr(substr(low, end1 + 1), needle) as r2 from b1), b2 as (select *, case when r2 > 0 then end1 + r2 end as at2 from a2),
c2 as (select *, least(at2 - 1 + length(needle) + 350, length(text)) as end2 from b2),
a3 as (select *, case when at2 is not null then instr(substr(low, end2 + 1), needle) else 0 end as r3 from c2), b3 as (select *, case when r3 > 0 then end2 + r3 end as at3 from a3)
select doc_id, place_id, md5(array_to_string(list_filter([{_WIN.format(i=1)}, case when at2 is not null then {_WIN.format(i=2)} end, case when at3 is not null then {_WIN.format(i=3)} end], lambda x: x is not null), ' […] ')) as excerpt from b3""")
def k1(spark, folder):
    return content.excerpts(_docs(spark, folder), _needles(spark, folder)).select("doc_id", "place_id", F.md5("excerpt").alias("excerpt"))


@query("b18_short_needles", "with n as (select item_id, trim(split_part(text, ' ', 1)) as w from benchmark) select item_id, w from n where length(w) >= 3")
def b18(spark, folder):
    w = tx.trimmed(F.split_part("text", F.lit(" "), F.lit(1)))
    return table(spark, folder, "benchmark").select("item_id", w.alias("w")).where(F.length("w") >= 3)


@query("c19_attach_excerpts", _MENTION + """
, c as (select item_id as place_id from benchmark where item_id % 2 = 0), x as (select place_id, count(*) as n from m group by 1)
select coalesce(c.place_id, x.place_id) as place_id, c.place_id is null as created, coalesce(x.n, 0) as excerpts from c full join x on c.place_id = x.place_id""")
def c19(spark, folder):
    found = content.excerpts(_docs(spark, folder), _needles(spark, folder))
    have = table(spark, folder, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("place_id"))
    sources = have.select("place_id", F.lit(0).alias("pos"), F.lit("OpenStreetMap").alias("label"), F.lit("u").alias("url"))
    rows, _ = content.attach_excerpts(have, sources, found)
    return rows.select("place_id", "created", "excerpts")


@query("c19_source_rows", _MENTION + """
, c as (select item_id as place_id from benchmark where item_id % 2 = 0)
select place_id, 0 as pos, 'u' as url from c union all
select m.place_id, row_number() over (partition by m.place_id order by doc_id) - 1 + (c.place_id is not null)::int, concat('https://d/', doc_id) from m left join c on m.place_id = c.place_id""")
def c19_sources(spark, folder):
    found = content.excerpts(_docs(spark, folder), _needles(spark, folder))
    have = table(spark, folder, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("place_id"))
    sources = have.select("place_id", F.lit(0).alias("pos"), F.lit("OpenStreetMap").alias("label"), F.lit("u").alias("url"))
    _, all_sources = content.attach_excerpts(have, sources, found)
    return all_sources.select("place_id", "pos", "url")


# Titles are the first 1 to 12 words of each document; names are its first 1 to 6 words.
_TITLES = """
with d as (select doc_id, text, regexp_replace(lower(array_to_string(string_split(text, ' ')[1:1 + doc_id % 12], ' ')), '[^a-z0-9\\x{3400}-\\x{9FFF}]+', '', 'g') as title_key,
  regexp_replace(lower(array_to_string(string_split(text, ' ')[1:1 + doc_id % 6], ' ')), '[^a-z0-9\\x{3400}-\\x{9FFF}]+', '', 'g') as key from documents) """


@query("c8_match_articles", _TITLES + """
, hits as (select doc_id as hit_rank, title_key from d where length(text) > 200 and title_key <> ''), names as (select doc_id as place_id, key from d where key <> ''),
j as (select place_id, hit_rank, row_number() over (partition by place_id order by hit_rank) as rn from names join hits on key = title_key
  or (length(key) >= 6 and starts_with(title_key, key)) or (length(title_key) >= 6 and starts_with(key, title_key)))
select place_id, hit_rank as matched from j where rn = 1""")
def c8(spark, folder):
    words = lambda n: F.array_join(F.slice(F.split("text", " "), F.lit(1), n), " ")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    articles = docs.select(F.lit("en").alias("host"), words((1 + F.col("doc_id") % 12).cast("int")).alias("title"), F.col("text").alias("extract"), F.col("doc_id").alias("hit_rank"))
    names = docs.select(F.col("doc_id").alias("place_id"), F.lit("en").alias("host"), F.lit(0).alias("host_rank"), F.lit(0).alias("name_rank"), words((1 + F.col("doc_id") % 6).cast("int")).alias("name"))
    found = content.match_articles(names, articles)
    ranks = articles.where(F.length("extract") > 200).groupBy("title").agg(F.min("hit_rank").alias("matched"))
    return found.join(ranks, "title").select("place_id", "matched")


@query("i11_comparable", _TITLES + "select doc_id, title_key as key from d")
def i11(spark, folder):
    title = F.array_join(F.slice(F.split("text", " "), F.lit(1), (1 + F.col("doc_id") % 12).cast("int")), " ")
    return table(spark, folder, "documents").select("doc_id", tx.name_key(title).alias("key"))


_LABELS = f"""
, l as (select entity_id, {clean('coalesce(label, alias)')}[1:160] as english from fx_labels_of), known as (select * from l where english <> '' and not {non_latin('english')}) """


@query("c4_english_labels", using("rich", "labels_of") + _LABELS + "select r.ord, k.english from fx_rich r left join known k on trim(r.wikidata) = k.entity_id")
def c4(spark, folder):
    labels = content.english_labels(sample(spark, folder, "labels_of"))
    rich = sample(spark, folder, "rich").select("ord", tg.entity_id(F.col("wikidata")).alias("entity_id"))
    return rich.join(labels, "entity_id", "left").select("ord", "english")


@query("m5_apply_english_names", RICH.rstrip() + f""", fx_labels_of as ({using('labels_of').split(' as (', 1)[1].rstrip()[:-1]}){_LABELS}
select p.ord, case when {non_latin('p.chosen')} and k.english is not null then k.english else p.chosen end as name,
  case when {non_latin('p.chosen')} and k.english is not null then k.english when p.name_en is not null then p.name_en end as name_en,
  coalesce({non_latin('p.chosen')} and k.english is not null, false) as translated from placed p left join known k on trim(p.wikidata) = k.entity_id""")
def m5(spark, folder):
    out = content.apply_english_names(rich_places(spark, folder), sample(spark, folder, "labels_of"))
    return out.select("ord", "name", F.col("tags")["name:en"].alias("name_en"), "translated")


_FACTS = using("entity_claims", "labels_of") + """
, r as (select *, row_number() over (partition by entity_id, property order by ord) as rn from fx_entity_claims),
v as (select r.entity_id, property, rn, case datatype when 'wikibase-entityid' then coalesce(l.label, r.value) when 'quantity' then ltrim(r.value, '+')
  else case when contains(r.value, '-00') then r.value[2:5] else concat(r.value[2:5], '-07-04') end end as text from r left join fx_labels_of l on r.value = l.entity_id where rn <= 3) """


@query("c5_entity_facts", _FACTS + """
select entity_id, case property when 'P31' then 0 when 'P571' then 1 when 'P84' then 3 when 'P2048' then 10 when 'P1174' then 12 when 'P131' then 14 else 15 end as pos,
  string_agg(text, ', ' order by rn) as value from v group by all""")
def c5(spark, folder):
    facts = content.entity_facts(sample(spark, folder, "entity_claims"), sample(spark, folder, "labels_of"))
    return facts.select("entity_id", "pos", "value")


@query("f10_first_values", using("entity_claims") + """
select entity_id, property, ord from (select *, row_number() over (partition by entity_id, property order by ord) as rn from fx_entity_claims) where rn <= 3""")
def f10(spark, folder):
    from placemill.operators.rank import top_k

    return top_k(sample(spark, folder, "entity_claims"), ["entity_id", "property"], [F.col("ord")], 3).select("entity_id", "property", "ord")


@query("i32_format_time", using("entity_claims") + """
select ord, case when contains(value, '-00') then value[2:5] else concat(value[2:5], '-07-04') end || case when ord % 2 = 0 then ' BC' else '' end as shown from fx_entity_claims where datatype = 'time'""")
def i32(spark, folder):
    raw = F.when(F.col("ord") % 2 == 0, F.regexp_replace("value", r"^\+", "-")).otherwise(F.col("value"))
    return sample(spark, folder, "entity_claims").where("datatype = 'time'").select("ord", tg.format_time(raw).alias("shown"))


@query("i33_format_quantity", using("entity_claims") + "select ord, ltrim(value, '+') as shown from fx_entity_claims where datatype = 'quantity'")
def i33(spark, folder):
    return sample(spark, folder, "entity_claims").where("datatype = 'quantity'").select("ord", tg.format_quantity(F.col("value")).alias("shown"))


@query("c7_article_titles", using("places") + """
select ord, case when ord % 8 = 0 then 'Linked ' || ord when wikipedia is not null then name end as title, 'en.wikipedia.org' as host from fx_places""")
def c7(spark, folder):
    places = sample(spark, folder, "places").withColumn("tags", place_tags())
    entities = places.where("ord % 8 = 0").select(F.col("wikidata").alias("entity_id"), F.concat(F.lit("Linked "), "ord").alias("sitelink"))
    return content.article_titles(places, entities).select("ord", "title", "host")
