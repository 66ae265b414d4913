"""Text about places: labels, facts, articles, excerpts, and the pieces of an article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill import dims
from placemill.functions import hours, tags as tg
from placemill.functions.text import WHITE, bind, clean_text, has_readable_content, is_mostly_non_latin, name_key, opt, trimmed
from placemill.operators.mentions import EDGE, mentions
from placemill.operators.rank import first_per, number_rows, top_k
from placemill.session import written

LONG_ENOUGH = 200      # characters an article needs to count
WINDOW = 350           # characters shown on either side of a mention
MAX_WINDOWS = 3


# --- names ------------------------------------------------------------------

def english_labels(labels: DataFrame) -> DataFrame:
    """Label, else alias, of each entity; a label in another script is no help."""
    text = clean_text(F.coalesce("label", "alias"), 160)
    return labels.select("entity_id", text.alias("english")).where((F.col("english") != "") & ~is_mostly_non_latin(F.col("english")))


def _no_key(*columns: str) -> Column:
    """A join key that meets nothing, spread over the rows."""
    return F.concat(F.lit("-"), F.xxhash64(*columns).cast("string"))


def apply_english_names(places: DataFrame, labels: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Readable names for places in other scripts: entity label first, then a stored translation.

    Rows that need none get a key of their own that no entity has, so they do not
    meet in one task. The original stays in ``name:local``.
    """
    needing = is_mostly_non_latin(F.col("name"))
    qid = F.coalesce(F.when(needing, tg.entity_id(F.col("tags")["wikidata"])), _no_key("search_id", "ord"))
    known = english_labels(labels).groupBy(F.col("entity_id").alias("_q")).agg(F.min("english").alias("english"))
    out = places.withColumn("_q", qid).join(known, "_q", "left").drop("_q")
    if answers is not None:
        out = out.join(answers.select("search_id", "ord", F.col("name").alias("_answer")), ["search_id", "ord"], "left")
        out = out.withColumn("english", F.coalesce("english", F.when(needing, F.col("_answer")))).drop("_answer")
    renamed = F.col("english").isNotNull()
    local = F.coalesce(tg.tag(F.col("tags"), "name:local"), F.col("name"))
    tags = tg.set_tag(tg.set_tag(F.col("tags"), "name:local", local), "name:en", F.col("english"))
    return (
        out.withColumn("tags", F.when(renamed, tags).otherwise(F.col("tags")))
        .withColumn("name", F.coalesce("english", "name")).withColumn("translated", renamed).drop("english")
    )


# --- facts and articles -------------------------------------------------------

def claim_text(datatype: Column, value: Column, label: Column) -> Column:
    """Value of a claim as text: dates and amounts formatted, entities by label, else as they are."""
    return (
        F.when(datatype == "wikibase-entityid", F.coalesce(label, value)).when(datatype == "time", tg.format_time(value))
        .when(datatype == "quantity", tg.format_quantity(value)).otherwise(value)
    )


def entity_facts(claims: DataFrame, labels: DataFrame, per_property: int = 3) -> DataFrame:
    """One row per entity and fact: the first values of each listed property, joined by commas."""
    listed = claims.where(F.col("property").isin([p for p, _ in dims.FACTS]))
    first = top_k(listed, ["entity_id", "property"], [F.col("ord")], per_property)
    named = labels.select(F.col("entity_id").alias("value"), F.col("label").alias("_label"))
    valued = first.join(named, "value", "left").withColumn("text", claim_text(F.col("datatype"), F.col("value"), F.col("_label")))
    pairs = [x for i, (p, label) in enumerate(dims.FACTS) for x in (F.lit(p), F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label")))]
    about = F.create_map(*pairs)[F.col("property")]
    texts = F.array_sort(F.collect_list(F.struct("rn", "text")))
    return (
        valued.where(opt(F.col("text")).isNotNull()).groupBy("entity_id", "property")
        .agg(F.array_join(F.transform(texts, lambda t: t["text"]), ", ").alias("value"))
        .select("entity_id", about["pos"].alias("pos"), "property", about["label"].alias("label"), "value")
    )


def place_facts(places: DataFrame, facts: DataFrame) -> DataFrame:
    return places.select("place_id", "entity_id").where(F.col("entity_id").isNotNull()).join(facts, "entity_id")


def article_titles(places: DataFrame, entities: DataFrame) -> DataFrame:
    """Host and title of each place's article: the entity's link, else the place's own tag."""
    link = entities.groupBy(F.col("entity_id").alias("_q")).agg(F.min("sitelink").alias("_link"))
    own = tg.lang_title(F.coalesce(F.col("tags")["wikipedia"], F.col("tags")["wikipedia:en"]))
    keyed = places.withColumn("entity_id", tg.entity_id(F.col("tags")["wikidata"]))
    keyed = keyed.withColumn("_q", F.coalesce("entity_id", _no_key(*[c for c in places.columns if c != "tags"])))
    joined = keyed.join(link, "_q", "left").drop("_q").withColumn("own", own)
    lang = F.when(F.col("_link").isNotNull(), "en").otherwise(F.coalesce("own.lang", F.lit("en")))
    return joined.withColumn("host", F.concat(lang, F.lit(".wikipedia.org"))).withColumn(
        "title", F.coalesce("_link", "own.title")
    ).drop("_link", "own")


def match_articles(names: DataFrame, articles: DataFrame, min_chars: int = LONG_ENOUGH) -> DataFrame:
    """First article of each place whose title corresponds to one of its names.

    ``names``: place_id, host, host_rank, name_rank, name. Keys correspond when
    equal or when the shorter, of six characters or more, starts the longer.
    Each longer key offers its prefixes, so both cases are plain equi-joins.
    """
    hits = articles.where(F.length("extract") > min_chars).withColumn("key", name_key(F.col("title")))
    hits = first_per(hits.where(F.col("key") != ""), ["host", "key"], [F.col("hit_rank"), F.col("title")])
    wanted = names.withColumn("key", name_key(F.col("name"))).where(F.col("key") != "")

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        long = df.where(F.length("key") > 6)
        return long.withColumn(name, F.explode(F.transform(F.sequence(F.lit(6), F.length("key") - 1), lambda n: F.substr(F.col("key"), F.lit(1), n))))

    hit = hits.select("host", F.col("key").alias("_k"), "title", "hit_rank")
    equal = wanted.join(hit, (wanted["key"] == hit["_k"]) & (wanted["host"] == hit["host"])).drop(hit["host"])
    longer_title = prefixes(hits, "_k").select(F.col("host").alias("_h"), "_k", "title", "hit_rank")
    longer_title = first_per(longer_title, ["_h", "_k"], [F.col("hit_rank"), F.col("title")])  # of titles with one beginning only the best can win
    by_title = wanted.join(longer_title, (F.col("key") == F.col("_k")) & (F.col("host") == F.col("_h"))).drop("_h")
    longer_name = prefixes(wanted, "_p")
    by_name = longer_name.join(hit.withColumnRenamed("host", "_h"), (F.col("_p") == F.col("_k")) & (F.col("host") == F.col("_h"))).drop("_h", "_p")
    found = equal.unionByName(by_title).unionByName(by_name).drop("_k")
    order = [F.col("host_rank"), F.col("name_rank"), F.col("hit_rank"), F.col("title")]
    return first_per(found, ["place_id"], order).select("place_id", "host", "title")


# --- excerpts -----------------------------------------------------------------

def excerpt_windows(text: Column, needle: Column, around: int = WINDOW, most: int = MAX_WINDOWS) -> Column:
    """Text around the first mentions; each search starts where the last window ended.

    The text in lower case, each place and each end are bound, so that they are found once.
    """

    def window(at: Column, last: Column) -> Column:
        first = F.greatest(at - around, F.lit(1))
        return F.trim(F.regexp_replace(F.substr(text, first, last - first + 1), f"{WHITE}+", " "))

    def following(low: Column, begin: Column, left: int) -> Column:
        def at_mention(at: Column) -> Column:
            last = F.least(at - 1 + F.length(needle) + around, F.length(text))
            here = lambda end: F.array(window(at, end))
            more = lambda end: F.concat(here(end), following(low, end + 1, left - 1)) if left > 1 else here(end)
            return F.when(at > 0, bind(last, more)).otherwise(F.expr("cast(array() as array<string>)"))

        return bind(F.position(needle, low, begin), at_mention)

    return bind(F.lower(text), lambda low: following(low, F.lit(1), most))


def excerpts(docs: DataFrame, places: DataFrame, edge: int = EDGE) -> DataFrame:
    """Passages of each document that mention a place by name (3 characters or more), without case."""
    needle = F.lower(trimmed(F.col("name")))
    named = places.select("place_id", needle.alias("needle")).where(F.length("needle") >= 3)
    pairs = mentions(docs, named.select("needle").distinct(), edge)
    shown = pairs.withColumn("excerpt", F.array_join(excerpt_windows(F.col("text"), F.col("needle")), " […] "))
    return shown.drop("text").join(named, "needle").drop("needle")


def attach_excerpts(content: DataFrame, sources: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Content with a row for every place that has one or an excerpt, and the extended source rows.

    Sources stay one row each, so a place mentioned everywhere is no giant row. The
    mentions are written, as both results and the numbering read them.
    """
    found = written(found.select("place_id", "doc_id", "label", "url"), "found")
    mentioned = found.groupBy("place_id").agg(F.count(F.lit(1)).alias("excerpts"))
    rows = content.withColumn("_had", F.lit(True)).join(mentioned, "place_id", "full")
    rows = rows.withColumn("created", F.col("_had").isNull()).withColumn("excerpts", F.coalesce("excerpts", F.lit(0))).drop("_had")
    base = sources.groupBy("place_id").agg((F.max("pos") + 1).alias("_base"))
    added = number_rows(found.select("place_id", F.col("doc_id").alias("ord"), "label", "url"), ["place_id"], [], "ord", "_n")
    added = added.join(base, "place_id", "left").select(
        "place_id", (F.coalesce("_base", F.lit(0)) + F.col("_n") - 1).cast("bigint").alias("pos"), "label", "url"
    )
    return rows, sources.select("place_id", F.col("pos").cast("bigint").alias("pos"), "label", "url").unionByName(added)


def assemble_sources(article: Column, voyage: Column, entity: Column, place_id: Column, osm_link: Column) -> Column:
    """Where a place's text came from, in fixed order. ``article`` and ``voyage`` are (title, url) structs or null."""
    item = lambda name, title, url: F.struct(F.concat(F.lit(f"{name} — "), title).alias("label"), url.alias("url"))
    return F.array_compact(F.array(
        F.when(article.isNotNull(), item("Wikipedia", article["title"], article["url"])),
        F.when(voyage.isNotNull(), item("Wikivoyage", voyage["title"], voyage["url"])),
        F.when(entity.isNotNull(), item("Wikidata", entity, F.concat(F.lit("https://www.wikidata.org/wiki/"), entity))),
        item("OpenStreetMap", place_id, osm_link),
    ))


# --- articles -----------------------------------------------------------------

SECTIONS = ["overview", "history", "architecture", "context", "visiting", "practical"]


def sentences_after_stops(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, r"(?<=\.)\s+"), 1, n), " ")


def fallback_article(df: DataFrame) -> DataFrame:
    """An article put together from the sources alone.

    Needs place_id, name, category_label, description, extract, voyage, contact
    and ``facts`` and ``extras`` (short arrays of label/value and label/text).
    """
    lead = F.when(
        opt(F.col("description")).isNotNull(), F.concat("name", F.lit(" is "), "description", F.lit("."))
    ).otherwise(F.concat("name", F.lit(" is "), tg.article(F.col("category_label")), F.lit(" "), F.lower("category_label"), F.lit(".")))
    paragraphs = F.filter(
        F.transform(F.split(F.coalesce("extract", F.lit("")), "\n{2,}"), trimmed), lambda p: F.length(p) > 40
    )
    first = F.try_element_at(paragraphs, F.lit(1))
    overview = F.concat_ws(" ", lead, sentences_after_stops(first, 6))
    body = opt(F.array_join(F.slice(paragraphs, F.lit(2), F.greatest(F.size(paragraphs), F.lit(1))), " "))
    line = lambda label, value: F.concat(F.lit(label), opt(value))
    contact = F.col("contact")
    highlights = F.concat(
        F.transform("facts", lambda f: F.concat(f["label"], F.lit(": "), f["value"])),
        F.array_compact(F.array(line("Opening hours: ", contact["opening_hours"]))),
        F.transform("extras", lambda e: F.concat(e["label"], F.lit(": "), F.substring(e["text"], 1, 200))),
    )
    practical = F.concat_ws(". ", line("Address: ", contact["address"]), line("Phone: ", contact["phone"]), line("Website: ", contact["website"]))
    return df.select(
        "place_id", F.substring(overview, 1, 3000).alias("overview"), F.substring(body, 1, 4000).alias("history"),
        F.slice(highlights, 1, 8).alias("highlights"), sentences_after_stops(opt(F.col("voyage")), 8).alias("visiting"),
        opt(practical).alias("practical"), F.lit(False).alias("llm_generated"),
        F.expr("cast(array() as array<string>)").alias("redactions"),
    )


def guard_article(df: DataFrame, section_chars: int | None = None) -> DataFrame:
    """Unsupported hours claims removed from every section and highlight; an empty article is rejected.

    Needs the section columns, ``highlights`` and ``tag`` (the hours tag).
    """
    tag = F.col("tag")
    sections = [s for s in SECTIONS if s in df.columns]
    items = F.transform("highlights", lambda h: hours.strip_unsupported_hours(clean_text(h, 400), tag))
    out = df.withColumn("_items", items)
    for s in sections:
        out = out.withColumn(f"_{s}", hours.strip_unsupported_hours(clean_text(F.col(s), section_chars), tag))
    kept = F.filter(F.transform("_items", lambda i: i["kept"]), lambda t: F.length(t) > 2)
    removed = F.concat(F.flatten(F.transform("_items", lambda i: i["removed"])), *[F.col(f"_{s}.removed") for s in sections])
    out = out.withColumn("highlights", kept).withColumn("redactions", removed)
    for s in sections:
        text = F.col(f"_{s}.kept")
        out = out.withColumn(s, text if s == "overview" else opt(text))
    return out.withColumn("usable", (F.length("overview") >= 40) | (F.size("highlights") > 0)).drop("_items", *[f"_{s}" for s in sections])


# Headings and notices.
NO_TEXT = "No English-language description is available for this location."
QUOTED = "The following is quoted directly from the sources listed for this place; no summary was generated for it."
HEADINGS = [
    ("architecture", "Architecture & design"), ("context", "Significance"), ("highlights", "Highlights"),
    ("visiting", "Visiting"), ("practical", "Practical information"),
]


def article_sections(df: DataFrame, render=lambda c: c) -> DataFrame:
    """(place_id, pos, heading, body) of the sections that have something to say.

    Needs the article columns, ``summary``, ``raw_name`` and ``display_name``. Where
    there is ``has_article``, a place without one gets its summary as the only section.
    """
    repaired = lambda c: tg.repair_summary(c, F.col("raw_name"), F.col("display_name"))
    readable = lambda c: F.when(has_readable_content(render(c)), c)
    col = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    quoted = ~F.col("llm_generated") & opt(col("history")).isNotNull()
    rows = [(F.lit("Overview"), F.coalesce(readable(repaired(col("overview"))), readable(repaired(col("summary"))), F.lit(NO_TEXT)))]
    rows.append((
        F.when(quoted, "Background (source extract)").otherwise("History"),
        F.when(quoted, F.concat(F.lit(QUOTED + "\n"), repaired(col("history")))).otherwise(readable(repaired(col("history")))),
    ))
    for field, heading in HEADINGS:
        if field == "highlights":
            lines = F.filter(F.transform(F.col("highlights"), repaired), lambda h: has_readable_content(render(h)))
            body = opt(F.array_join(lines, "\n")) if "highlights" in df.columns else F.lit(None).cast("string")
        else:
            body = readable(repaired(col(field)))
        rows.append((F.lit(heading), body))
    listed = F.array(*[F.struct(h.alias("heading"), b.alias("body")) for h, b in rows])
    if "has_article" in df.columns:
        plain = F.coalesce(readable(repaired(col("summary"))), F.lit(NO_TEXT))
        listed = F.when(F.col("has_article"), listed).otherwise(F.array(F.struct(F.lit("Description").alias("heading"), plain.alias("body"))))
    return (
        df.select("place_id", F.posexplode(listed).alias("pos", "s"))
        .select("place_id", "pos", "s.heading", "s.body").where(opt(F.col("body")).isNotNull())
    )


def source_block(df: DataFrame, extras: DataFrame | None = None, most: int = 20) -> DataFrame:
    """The text a writer may draw on: name, type, coordinates, facts, tags, extracts, extra passages.

    ``extras`` (place_id, ord, label, text) are cut to the first ``most`` per place, the number of
    extra sources a run may have.
    """
    if extras is not None:
        first = top_k(extras, ["place_id"], [F.col("ord")], most)
        packed = F.transform(F.array_sort(F.collect_list(F.struct("rn", "label", "text"))), lambda e: F.struct(e["label"].alias("label"), e["text"].alias("text")))
        df = df.drop("extras").join(first.groupBy("place_id").agg(packed.alias("extras")), "place_id", "left")
    nonempty = lambda arr, head: F.when(F.size(arr) > 0, F.concat(F.array(F.lit(""), F.lit(head)), arr))
    facts = F.transform("facts", lambda f: F.concat(F.lit("- "), f["label"], F.lit(": "), f["value"]))
    tag_lines = F.transform(tg.first_tags(F.col("tags")), lambda t: F.concat(F.lit("- "), t["key"], F.lit(" = "), t["value"]))
    extract = lambda head, c: F.when(opt(F.col(c)).isNotNull(), F.array(F.lit(""), F.lit(head), F.col(c)))
    more = F.flatten(F.transform("extras", lambda e: F.array(F.lit(""), F.concat(F.lit("ADDITIONAL SOURCE ("), e["label"], F.lit("):")), e["text"])))
    none = F.expr("cast(array() as array<string>)")
    lines = F.concat(
        F.array(
            F.concat(F.lit("NAME: "), "name"), F.concat(F.lit("TYPE: "), "category_label"),
            F.format_string("COORDINATES: %.5f, %.5f", "lat", "lon"),
        ),
        F.coalesce(F.when(opt(F.col("description")).isNotNull(), F.array(F.concat(F.lit("WIKIDATA DESCRIPTION: "), "description"))), none),
        F.coalesce(nonempty(facts, "STRUCTURED FACTS (Wikidata):"), none),
        F.coalesce(nonempty(tag_lines, "OPENSTREETMAP TAGS:"), none),
        F.coalesce(extract("WIKIPEDIA ARTICLE:", "extract"), none),
        F.coalesce(extract("WIKIVOYAGE ARTICLE:", "voyage"), none),
        F.coalesce(more, none),
    )
    return df.select("place_id", F.array_join(lines, "\n").alias("block"))
