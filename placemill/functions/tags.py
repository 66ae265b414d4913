"""Expressions over the open tag map: names, scores, contact data, summaries, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill import dims
from placemill.functions.text import (
    bind, clean_text, first_of, is_mostly_non_latin, is_safe_http_url, opt, percent_encode, to_title_case, trimmed,
)


def tag(tags: Column, key: str) -> Column:
    """A tag's value; empty counts as absent."""
    return opt(tags[key])


class Promoted:
    """Tags looked up once and kept as columns; reads like the map it came from."""

    def __init__(self, keys: set[str]):
        self.keys = keys

    def __getitem__(self, key: str) -> Column:
        return F.col(f"`_tag_{key}`") if key in self.keys else F.lit(None).cast("string")


def promote(df: DataFrame, keys: list[str]) -> tuple[DataFrame, Promoted]:
    """One column per key, so that expressions using a tag several times do not search the map again."""
    return df.withColumns({f"_tag_{k}": F.col("tags")[k] for k in keys}), Promoted(set(keys))


def demote(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_tag_")])


# Keys the rule-based result reads.
RULE_TAGS = (
    "wikidata wikipedia description description:en website contact:website url operator:website phone contact:phone "
    "contact:mobile operator:phone email contact:email addr:housenumber addr:street addr:neighbourhood addr:suburb "
    "addr:district addr:city addr:state addr:postcode opening_hours operator brand cuisine denomination religion "
    "start_date stars wheelchair"
).split()


def has(tags: Column, *keys: str) -> Column:
    return F.coalesce(*[tag(tags, k) for k in keys]).isNotNull()


def points(condition: Column, n: int) -> Column:
    return F.when(condition, F.lit(n)).otherwise(F.lit(0))


def tag_map(**columns: Column) -> Column:
    """Map of the non-null columns; ``__`` in a name stands for a colon."""
    pairs = [x for k, v in columns.items() for x in (F.lit(k.replace("__", ":")), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def overlay(base: Column, top: Column) -> Column:
    """Union of two maps, ``top`` winning, whatever the session's duplicate-key policy."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k)), top)


def set_tag(tags: Column, key: str, value: Column) -> Column:
    return overlay(tags, F.map_filter(F.create_map(F.lit(key), value), lambda _, v: v.isNotNull()))


def preferred_name(tags: Column) -> Column:
    """Display name: an English or international form replaces a local name in another script."""
    value = lambda key: clean_text(tags[key], 160)
    forms = F.struct(
        first_of(value("name")).alias("local"), first_of(value("name:en"), value("official_name:en"), value("int_name")).alias("latin"),
        first_of(value("operator"), value("brand")).alias("other"),
    )
    return bind(forms, lambda f: F.when(is_mostly_non_latin(f["local"]) & f["latin"].isNotNull(), f["latin"]).otherwise(
        F.coalesce(f["local"], f["latin"], f["other"])
    ))


def keep_local_name(tags: Column, name: Column) -> Column:
    """Adds ``name:local`` where the chosen name differs from the mapped one."""
    local = opt(clean_text(tags["name"], 160))
    return F.when(local.isNotNull() & (local != name), set_tag(tags, "name:local", local)).otherwise(tags)


def label_from_tags(tags: Column, fallback: Column) -> Column:
    """First descriptive tag that is not just ``yes``, as a title."""
    values = [F.when(tags[k] != "yes", tag(tags, k)) for k in dims.LABEL_KEYS]
    return F.coalesce(to_title_case(F.replace(F.coalesce(*values), F.lit("_"), F.lit(" "))), fallback)


def label_from_types(types: Column, fallback: str = "Place") -> Column:
    """(id, label) of the first specific type."""
    specific = F.try_element_at(F.filter(types, lambda t: ~t.isin(dims.GENERIC_TYPES)), F.lit(1))
    text = F.replace(specific, F.lit("_"), F.lit(" "))
    label = F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))
    return F.struct(F.coalesce(specific, F.lit("custom")).alias("id"), F.coalesce(label, F.lit(fallback)).alias("label"))


# What a record gains for details that are present, any of the keys.
INFORMATION_POINTS = (
    (("wikidata",), 8), (("wikipedia",), 6), (("website", "contact:website"), 4), (("phone", "contact:phone"), 4), (("description",), 3), (("addr:street",), 2),
)


def information_score(tags: Column, osm_type: Column) -> Column:
    """How richly a record is described."""
    score = F.size(tags)
    for keys, n in INFORMATION_POINTS:
        score = score + points(has(tags, *keys), n)
    return score + points(osm_type != "node", 1)


def heuristic_score(tags: Column, osm_type: Column) -> Column:
    """Quality 40..100 from which details are present."""
    return F.least(
        F.lit(100),
        F.lit(40)
        + points(has(tags, "wikidata"), 15)
        + points(has(tags, "wikipedia"), 10)
        + points(has(tags, "description"), 8)
        + points(has(tags, "website", "contact:website"), 8)
        + points(has(tags, "phone", "contact:phone"), 7)
        + points(has(tags, "addr:street"), 6)
        + points(has(tags, "opening_hours"), 3)
        + points(has(tags, "operator", "brand"), 3)
        + points(osm_type != "node", 3),
    )


def rating_score(rating: Column) -> Column:
    """round(rating * 20) with halves upwards; 50 when unrated."""
    return F.coalesce(F.floor(rating * 20 + 0.5).cast("int"), F.lit(50))


BRAND_KEYS = ("brand", "brand:wikidata", "operator")


def is_branded(tags: Column) -> Column:
    """Brand or operator present: the guard of the vector pass."""
    return has(tags, *BRAND_KEYS)


def is_chain_like(tags: Column) -> Column:
    """Repeated names are expected: branded, or one of the everyday utilities."""
    utility = [F.coalesce(tags[k].isin(dims.CHAIN_VALUES), F.lit(False)) for k in dims.CHAIN_KEYS]
    out = is_branded(tags)
    for u in utility:
        out = out | u
    return out


def extract_contact(tags: Column) -> Column:
    """Phone, email, website, address and hours from the first usable tag of each."""
    pick = lambda *keys: first_of(*[clean_text(tags[k], 300) for k in keys])
    house = F.concat_ws(" ", tag(tags, "addr:housenumber"), tag(tags, "addr:street"))
    parts = [
        house,
        F.coalesce(tags["addr:neighbourhood"], tags["addr:suburb"]),
        tags["addr:district"], tags["addr:city"], tags["addr:state"], tags["addr:postcode"],
    ]
    stated = F.filter(F.array(*[clean_text(p, 120) for p in parts]), lambda p: p != "")
    return F.struct(
        pick("phone", "contact:phone", "contact:mobile", "operator:phone").alias("phone"),
        pick("email", "contact:email").alias("email"),
        safe_website(pick("website", "contact:website", "url", "operator:website")).alias("website"),
        F.when(F.size(stated) > 0, F.array_join(stated, ", ")).alias("address"),
        pick("opening_hours").alias("opening_hours"),
    )


def safe_website(site: Column) -> Column:
    """https:// is assumed where no scheme is given; anything but http(s) is dropped."""
    full = lambda s: F.when(s.rlike("(?i)^https?://"), s).otherwise(F.concat(F.lit("https://"), s))
    return F.try_element_at(F.filter(F.transform(F.array(site), full), is_safe_http_url), F.lit(1))


def article(label: Column) -> Column:
    return F.when(label.rlike("(?i)^[aeiou]"), "an").otherwise("a")


def heuristic_summary(name: Column, label: Column, city: Column, country: Column, tags: Column) -> Column:
    """The description, else one templated sentence and the details the tags hold."""
    described = opt(clean_text(F.coalesce(tags["description:en"], tags["description"]), 600))
    first = F.concat(
        name, F.lit(" is "), article(label), F.lit(" "), F.lower(label), F.lit(" in "), city, F.lit(", "), country, F.lit(".")
    )
    said = lambda key, n: F.when(has(tags, key), clean_text(tags[key], n))
    details = F.concat_ws(
        ". ",
        F.concat(F.lit("Operated by "), said("operator", 120)),
        F.concat(F.lit("Cuisine: "), F.replace(said("cuisine", 120), F.lit(";"), F.lit(", "))),
        F.when(
            has(tags, "denomination", "religion"),
            F.concat(F.lit("Religious affiliation: "), clean_text(F.coalesce(tags["denomination"], tags["religion"]), 80)),
        ),
        F.concat(F.lit("Dates from "), said("start_date", 40)),
        F.concat(said("stars", 10), F.lit("-star rating")),
        F.concat(F.lit("Opening hours: "), said("opening_hours", 120)),
        F.when(tags["wheelchair"] == "yes", F.lit("Wheelchair accessible")),
    )
    return F.coalesce(described, F.concat_ws(" ", first, F.concat(opt(details), F.lit("."))))


def whitelist_tags(tags: Column, keys: list[str] | None = None, limit: int = 300) -> Column:
    """Tags worth showing, values cleaned and cut."""
    kept = F.map_filter(tags, lambda k, v: k.isin(keys or dims.RELEVANT_TAGS) & (v != ""))
    return F.transform_values(kept, lambda _, v: clean_text(v, limit))


def first_tags(tags: Column, n: int = 30) -> Column:
    """First ``n`` entries by key, bookkeeping prefixes left out."""
    entries = F.array_sort(F.map_entries(tags))
    shown = F.filter(entries, lambda e: ~e["key"].startswith("source:") & ~e["key"].startswith("ref:"))
    return F.slice(shown, 1, n)


def lang_title(tag_value: Column) -> Column:
    """``xx:Title`` to (lang, title); English where no language is given."""
    t = trimmed(tag_value)
    pattern = r"(?i)^([a-z-]{2,12}):(.+)$"
    return F.when(
        t != "",
        F.struct(
            F.coalesce(opt(F.lower(F.regexp_extract(t, pattern, 1))), F.lit("en")).alias("lang"),
            F.coalesce(opt(F.regexp_extract(t, pattern, 2)), t).alias("title"),
        ),
    )


def wiki_address(host: Column, title: Column) -> Column:
    return F.concat(F.lit("https://"), host, F.lit("/wiki/"), percent_encode(F.replace(title, F.lit(" "), F.lit("_"))))


def article_url(tag_value: Column) -> Column:
    parts = lang_title(tag_value)
    return wiki_address(F.concat(parts["lang"], F.lit(".wikipedia.org")), parts["title"])


def entity_id(tag_value: Column) -> Column:
    t = trimmed(tag_value)
    return F.when(t.rlike(r"^Q[0-9]+$"), t)


def entity_url(tag_value: Column) -> Column:
    return F.concat(F.lit("https://www.wikidata.org/wiki/"), entity_id(tag_value))


def plain_number(c: Column) -> Column:
    """A double as people write it: no ``.0``, no exponent down to 18 decimals."""
    text = c.cast("string")
    written_out = F.regexp_replace(F.regexp_replace(text.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", "")
    return F.when(text.contains("E"), F.coalesce(written_out, text)).otherwise(F.regexp_replace(text, r"\.0$", ""))


def map_url(name: Column, lat: Column, lon: Column) -> Column:
    query = F.concat(name, F.lit(" "), plain_number(lat), F.lit(","), plain_number(lon))
    return F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), percent_encode(query))


def osm_url(osm_type: Column, osm_id: Column) -> Column:
    return F.concat_ws("/", F.lit("https://www.openstreetmap.org"), osm_type, osm_id.cast("string"))


def language_for_country(code: Column) -> Column:
    pairs = [x for k, v in dims.LANGUAGES.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[F.lower(trimmed(code))]


def display_name(name: Column, tags: Column, label: Column, osm_type: Column, osm_id: Column, render=lambda c: c) -> Column:
    """First form longer than one character once rendered, else label and id."""
    keys = ("name:en", "int_name", "official_name:en", "alt_name")
    forms = [render(name)] + [render(F.coalesce(tags[k], F.lit(""))) for k in keys]
    usable = [F.when(F.length(f) > 1, f) for f in forms]
    return F.coalesce(*usable, F.concat(label, F.lit(" (OSM "), osm_type, F.lit("/"), osm_id.cast("string"), F.lit(")")))


def repair_summary(summary: Column, raw_name: Column, shown: Column) -> Column:
    """Raw name replaced by the display name; a sentence left headless gets it back."""
    swapped = F.replace(summary, raw_name, shown)
    headless = r"(?i)^\s*is\s"
    fixed = F.when(swapped.rlike(headless), F.concat(shown, F.lit(" is "), F.regexp_replace(swapped, headless, ""))).otherwise(swapped)
    return F.when((F.coalesce(raw_name, F.lit("")) == "") | (raw_name == shown), summary).otherwise(fixed)


def format_time(raw: Column) -> Column:
    """``+1851-07-04T..`` to a date, or the year alone when month or day is unknown."""
    pattern = r"^([+-])([0-9]{4,})-([0-9]{2})-([0-9]{2})"
    part = lambda i: F.regexp_extract(raw, pattern, i)
    era = F.when(part(1) == "-", " BC").otherwise("")
    year = F.regexp_replace(part(2), "^0+(?=[0-9])", "")
    date = F.when((part(3) == "00") | (part(4) == "00"), year).otherwise(F.concat_ws("-", year, part(3), part(4)))
    return F.when(raw.rlike(pattern), F.concat(date, era)).otherwise(raw)


def format_quantity(amount: Column) -> Column:
    return F.regexp_replace(amount, r"^\+", "")


