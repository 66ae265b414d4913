"""String expressions: cleaning, safe path parts, script tests, HTML stripping, URLs."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters treated as a blank, the wider white-space class, the
# characters and names a file system refuses.
BLANK_LIKE = r"[\x00-\x1F\x7F-\x9F\x{A0}\x{2007}\x{202F}\x{FEFF}]"
WHITE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
ILLEGAL_IN_PATH = r'[<>:"/\\|?*]'
RESERVED_NAMES = (
    "con prn aux nul com1 com2 com3 com4 com5 com6 com7 com8 com9 "
    "lpt1 lpt2 lpt3 lpt4 lpt5 lpt6 lpt7 lpt8 lpt9"
).split()
CJK = r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]"
OTHER_SCRIPTS = r"[\x{400}-\x{4FF}\x{600}-\x{6FF}\x{900}-\x{97F}\x{E00}-\x{E7F}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"

# Word edges that look at ASCII word characters only, whatever the JVM version.
EDGE_L = r"(?<![0-9A-Za-z_])"
EDGE_R = r"(?![0-9A-Za-z_])"


def opt(c: Column) -> Column:
    """Empty string counts as absent."""
    return F.nullif(c, F.lit(""))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.transform(F.array(value), body)[0]


def first_of(*cols: Column) -> Column:
    """First value that is neither null nor empty; each is evaluated once."""
    return F.try_element_at(F.filter(F.array(*cols), lambda c: c != ""), F.lit(1))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def clean_text(c: Column, limit: int | None = None) -> Column:
    """Blank-likes to space, runs of white space to one, trimmed, cut to ``limit`` characters."""
    c = F.regexp_replace(F.regexp_replace(c, BLANK_LIKE, " "), f"{WHITE}+", " ")
    c = F.trim(c)
    return F.coalesce(F.substring(c, 1, limit) if limit else c, F.lit(""))


def per_value(step, kind: T.DataType, arrow: pa.DataType):
    """A column function from ``step`` on one text; nulls stay. Values go through Arrow one by one, not as a column of Python objects."""

    @F.arrow_udf(kind)
    def each(values: pa.Array) -> pa.Array:
        return pa.array((None if v is None else step(v) for v in (x.as_py() for x in values)), arrow, size=len(values))

    return each


TEXT = (T.StringType(), pa.string())
TEXTS = (T.ArrayType(T.StringType()), pa.list_(pa.string()))


def unicode_norm(c: Column, form: str) -> Column:
    """Unicode normal form; ASCII values never reach Python's normaliser."""
    normalise = per_value(lambda v: unicodedata.normalize(form, v), *TEXT)
    pair = F.struct(c.alias("plain"), normalise(F.when(c.rlike(r"[^\x00-\x7F]"), c)).alias("wide"))
    return bind(pair, lambda p: F.coalesce(p["wide"], p["plain"]))


def sanitize_path_segment(c: Column, fallback: Column | str = "unnamed", *, ascii_only: bool = False) -> Column:
    """A file-system-safe folder or file name of at most 80 characters."""
    c = F.coalesce(c, F.lit(""))
    c = c if ascii_only else unicode_norm(c, "NFC")
    c = F.regexp_replace(F.regexp_replace(c, BLANK_LIKE, " "), ILLEGAL_IN_PATH, " ")
    c = F.regexp_replace(F.regexp_replace(c, r"\.{2,}", "."), f"{WHITE}+", " ")
    c = F.regexp_replace(c, r"^[.\s]+|[.\s]+$", "")
    c = F.when(F.length(c) > 80, F.regexp_replace(F.substring(c, 1, 80), r"[.\s]+$", "")).otherwise(c)
    c = F.when(F.lower(c).isin(RESERVED_NAMES), F.concat(c, F.lit("_"))).otherwise(c)
    return F.coalesce(opt(c), fallback if isinstance(fallback, Column) else F.lit(fallback))


def to_latin1_safe(c: Column) -> Column:
    """What the core print fonts can draw: marks dropped, quotes and dashes mapped, the rest removed."""
    c = unicode_norm(F.regexp_replace(F.coalesce(c, F.lit("")), BLANK_LIKE, " "), "NFKD")
    c = F.regexp_replace(c, r"[\x{300}-\x{36F}]", "")
    c = F.translate(c, "‘’‛“”‟–—−•·", "'''\"\"\"-----")
    c = F.regexp_replace(c, "…", "...")
    c = F.regexp_replace(c, r"[^\x20-\xFF]", "")
    return F.trim(F.regexp_replace(c, f"{WHITE}+", " "))


def is_mostly_non_latin(c: Column) -> Column:
    """More than 0.3 of the non-blank characters lie above Latin Extended-B."""
    seen = F.length(F.regexp_replace(c, r"[\x00-\x20]", ""))
    foreign = F.length(F.regexp_replace(c, r"[\x00-\x{24F}]", ""))
    return F.coalesce(foreign * 10 > seen * 3, F.lit(False))


def has_residual_script(c: Column) -> Column:
    return c.rlike(CJK) | c.rlike(OTHER_SCRIPTS)


def has_readable_content(c: Column) -> Column:
    """Two ASCII letters or a run of four digits."""
    return F.coalesce(c.rlike("[A-Za-z][^A-Za-z]*[A-Za-z]") | c.rlike("[0-9]{4}"), F.lit(False))


def slug(name: Column, place_id: Column) -> Column:
    s = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, "^-|-$", ""), 1, 60)
    return F.coalesce(opt(s), F.regexp_replace(place_id, "^([^/]*)/", "$1-"))


def to_title_case(c: Column) -> Column:
    """Upper-case every a-z that starts an ASCII word (underscore counts as a word character)."""
    runs = F.regexp_extract_all(c, F.lit("([0-9A-Za-z_]+|[^0-9A-Za-z_]+)"), F.lit(1))
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.when(r.rlike("^[a-z]"), F.concat(F.upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r)))).otherwise(r),
        ),
        "",
    )


def escape_keyword(c: Column, *, ascii_only: bool = False) -> Column:
    """Letters, digits, space, underscore and hyphen only; at most 60 characters."""
    c = c if ascii_only else unicode_norm(c, "NFKD")
    c = F.regexp_replace(c, "[^A-Za-z0-9 _-]", " ")
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, 60)


def normalise_keyword(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), f"{WHITE}+", " "))


def name_key(c: Column, mode: str = "reference") -> Column:
    """Comparison key. ``unicode`` keeps the letters of every script instead of Latin and CJK only."""
    keep = r"[^a-z0-9\x{3400}-\x{9FFF}]+" if mode == "reference" else r"[^\p{L}\p{N}]+"
    return F.regexp_replace(F.lower(c), keep, "")


# Block-level tags that break a line, and the entities decoded.
BLOCK_TAGS = "br|p|div|li|h[1-6]|tr|section|article"
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")]


def strip_html(c: Column) -> Column:
    """Readable text of a page: no scripts, styles or comments; blocks on their own lines."""
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->"):
        c = F.regexp_replace(c, pattern, " ")
    c = F.regexp_replace(c, f"(?i)<({BLOCK_TAGS})[^>]*>", "\n")
    c = F.regexp_replace(c, "<[^>]+>", " ")
    for pattern, plain in ENTITIES:
        c = F.regexp_replace(c, f"(?i){pattern}", plain)
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return trimmed(c)


# An http(s) address with a host; the host is group 2.
HTTP_URL = (
    r"(?i)^https?://([^\s/?#@]*@)?([^\s/?#@:<>^|%\\\[\]]+|\[[0-9a-f:.]+\])(:[0-9]{0,5})?([/?#].*)?$"
)


def host_of(url: Column) -> Column:
    return opt(F.lower(F.regexp_extract(url, HTTP_URL, 2)))


def html_title(html: Column, url: Column) -> Column:
    """Title element, else the host name, else the address itself."""
    title = clean_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), 120)
    return F.coalesce(opt(title), host_of(url), url)


def strip_tags_short(c: Column) -> Column:
    return clean_text(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", " "), 200)


def extract_urls(c: Column) -> Column:
    """http(s) addresses in order of appearance, closing punctuation removed."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r'((?i)https?://[^\s",]+)'), F.lit(1))
    return F.transform(found, lambda u: F.regexp_replace(u, r"[),.;]+$", ""))


def looks_like_path(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-zA-Z]:[\\/]") | c.startswith("\\\\") | c.startswith("/"), F.lit(False))


def is_safe_http_url(c: Column) -> Column:
    """Parses as an address with scheme http or https and a host."""
    return F.coalesce(c.rlike(HTTP_URL), F.lit(False))


def percent_encode(c: Column) -> Column:
    """RFC 3986 component encoding that leaves ``!'()*~`` alone."""
    c = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def percent_decode(c: Column) -> Column:
    """Percent-decoding that keeps a plus sign; malformed input stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def archive_filename(keyword: Column, city: Column, country: Column, *, ascii_only: bool = False) -> Column:
    parts = [
        F.lower(F.regexp_replace(sanitize_path_segment(c, "export", ascii_only=ascii_only), r"\s+", "-"))
        for c in (keyword, city, country)
    ]
    return F.concat(F.concat_ws("_", *parts), F.lit(".zip"))


def caption(name: Column, index: Column, title: Column, credit: Column, license_: Column, source: Column) -> Column:
    """Picture caption; absent parts are left out."""
    return F.concat_ws(
        " ",
        F.coalesce(title, F.concat(name, F.lit(" ("), index.cast("string"), F.lit(")"))),
        F.concat(F.lit("— "), opt(credit)),
        F.concat(F.lit("["), opt(license_), F.lit("]")),
        F.concat(F.lit("via "), source),
    )


def percent(part: Column, whole: Column) -> Column:
    """One-decimal share, ``n/a`` for an empty whole."""
    return F.when(whole == 0, F.lit("n/a")).otherwise(
        F.concat(F.format_string("%.1f", F.round(100.0 * part / F.when(whole != 0, whole), 1)), F.lit("%"))
    )


def hash31(c: Column) -> Column:
    """Unsigned 32-bit rolling hash (times 31 plus the character)."""
    chars = F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != "")
    return F.aggregate(
        chars, F.lit(0).cast("bigint"), lambda h, x: F.pmod(h * 31 + F.ascii(x).cast("bigint"), F.lit(4294967296).cast("bigint"))
    )
