"""Stored model responses: from raw text to clean text, records, objects, prose and lists."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from placemill.functions.text import CJK, TEXT, TEXTS, bind, clean_text, is_mostly_non_latin, opt, per_value, trimmed

# The tags that wrap a model's reasoning, field limits of a record.
REASONING = "think|thinking|reasoning"
TEXT_LIMITS = {"name": 200, "summary": 1200, "phone": 120, "email": 160, "website": 500, "address": 400, "reason": 300}
DEFAULT_SCORE = 60
KEEP_ANYWAY = 80


def strip_reasoning(raw: Column) -> Column:
    """Closed blocks, an unclosed tail and stray tags removed."""
    c = F.regexp_replace(raw, rf"(?is)<({REASONING})>.*?</\1>", " ")
    c = F.regexp_replace(c, rf"(?is)<(?:{REASONING})>.*$", " ")
    c = F.regexp_replace(c, rf"(?i)</?(?:{REASONING})>", " ")
    return F.coalesce(trimmed(c), F.lit(""))


def clean_completion(raw: Column) -> Column:
    return trimmed(F.regexp_replace(strip_reasoning(raw), "(?i)```(?:jsonc|json)?", ""))


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}]', re.S)
_ARRAY = re.compile(r"\[.*\]", re.S)
_NOTE = re.compile(r'("(?:[^"\\]|\\.)*(?:"|\\?\Z))|//[^\n]*(?:\n|\Z)|/\*.*?(?:\*/|\Z)', re.S)


def _reject(name: str):
    raise ValueError(name)


def balanced_objects(text: str) -> list[str]:
    """Top-level ``{...}`` runs that are valid JSON; braces inside strings do not count."""
    out, depth, start = [], 0, None
    for token in _TOKEN.finditer(text):
        if token[0] == "{":
            start = token.start() if depth == 0 else start
            depth += 1
        elif token[0] == "}":
            depth = max(depth - 1, 0)
            if depth == 0 and start is not None:
                piece, start = text[start : token.end()], None
                try:
                    json.loads(piece, parse_constant=_reject)
                    out.append(piece)
                except ValueError:
                    pass
    return out


scan_objects = per_value(balanced_objects, *TEXTS)


def _last_wins(text: str) -> str | None:
    try:
        return json.dumps(json.loads(text, parse_constant=_reject), ensure_ascii=False, allow_nan=False)
    except (ValueError, RecursionError):
        return None


_without_repeats = per_value(_last_wins, *TEXT)


def plain_json(text: Column) -> Column:
    """The text if it is JSON, null if not. Of a key given twice the last value stays; only such texts meet Python."""
    native = F.try_parse_json(text).isNotNull()
    return F.when(native, text).otherwise(_without_repeats(F.when(~native & text.contains('"'), text)))


def _read_anew(text: str) -> list[str | None]:
    """Of a response that is no plain JSON: its outermost array if that is JSON with repeated keys, then all balanced objects, each key with its last value."""
    whole = _ARRAY.search(text)
    listed = _last_wins(whole[0]) if whole and '"' in whole[0] else None
    return [listed, *(_last_wins(o) for o in (balanced_objects(text) if "{" in text else ()))]


# Stands once in an expression; so marked, Spark does not copy it into filters, and a task has one Python worker for it.
_read_again = per_value(_read_anew, *TEXTS).asNondeterministic()


def _bare(text: str) -> str:
    return _NOTE.sub(lambda m: m[1] or ("\n" if m[0].startswith("//") else ""), text)


_drop_comments = per_value(_bare, *TEXT)


def strip_json_comments(c: Column) -> Column:
    """Comments outside strings removed; text without a slash pair skips Python's scanner."""
    noted = F.when(c.contains("//") | c.contains("/*"), c)
    return F.coalesce(_drop_comments(noted), c)


def parse_records(raw: Column) -> Column:
    """Array of VARIANT records: the outermost array, else every balanced object."""
    text = clean_completion(raw)
    array = lambda t: F.try_variant_get(F.try_parse_json(t), "$", "array<variant>")
    native = array(opt(F.regexp_extract(text, r"(?s)\[.*\]", 0)))
    again = _read_again(F.when(native.isNull(), text))
    loose = lambda r: F.transform(F.slice(r, 2, F.greatest(F.size(r), F.lit(1))), lambda o: F.try_parse_json(o))
    return bind(
        F.struct(native.alias("native"), again.alias("again"), text.contains("{").alias("objects")),
        lambda p: F.coalesce(p["native"], array(p["again"][0]), F.when(p["objects"], loose(p["again"]))),
    )


def _kind(v: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))


def validate_record(v: Column) -> Column:
    """Typed record with defaults, or null when a field has the wrong type or exceeds its limit."""
    ok = F.coalesce(_kind(v, "keep") == "BOOLEAN", F.lit(False))
    fields = [F.try_variant_get(v, "$.keep", "boolean").alias("keep")]
    for field, limit in TEXT_LIMITS.items():
        value = F.try_variant_get(v, f"$.{field}", "string")
        kind = _kind(v, field)
        ok = ok & (kind.isNull() | F.coalesce((kind == "STRING") & (F.length(value) <= limit), F.lit(False)))
        fields.append(F.coalesce(value, F.lit("")).alias(field))
    numeric = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
    score, score_kind = F.try_variant_get(v, "$.score", "double"), _kind(v, "score")
    ok = ok & (score_kind.isNull() | F.coalesce(score_kind.rlike(numeric) & score.between(0, 100), F.lit(False)))
    index, index_kind = F.try_variant_get(v, "$.i", "double"), _kind(v, "i")
    whole = F.coalesce(index_kind.rlike(numeric) & (index >= 0) & (index == F.floor(index)), F.lit(False))
    ok = ok & (index_kind.isNull() | whole)
    fields += [F.coalesce(score, F.lit(float(DEFAULT_SCORE))).alias("score"), index.cast("bigint").alias("i")]
    return F.when(ok, F.struct(*fields))


def valid_records(raw: Column) -> Column:
    return F.filter(F.transform(parse_records(raw), validate_record), lambda r: r.isNotNull())


def should_keep(record: Column) -> Column:
    """A name is required; a high score overrules a rejection."""
    named = F.length(clean_text(record["name"], 200)) > 1
    return named & (record["keep"] | (record["score"] >= KEEP_ANYWAY))


def object_text(raw: Column) -> Column:
    """JSON text of the object in a response: as it is, without trailing commas, or cut back to its last complete property."""
    text = trimmed(strip_json_comments(clean_completion(raw)))
    whole = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    no_commas = F.regexp_replace(whole, r",\s*([}\]])", "$1")
    cut = F.concat(opt(F.regexp_extract(text, r'(?s)(\{.*["\]}]),', 1)), F.lit("}"))
    return F.coalesce(*[plain_json(opt(c)) for c in (whole, no_commas, cut)])


def parse_object(raw: Column) -> Column:
    """The object in a response as VARIANT."""
    return F.try_parse_json(object_text(raw))


def json_field(text: Column, field: str) -> Column:
    """One property as JSON text, the key order of nested objects kept (VARIANT would sort them)."""
    value = F.try_variant_get(F.try_parse_json(text), f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.to_json(value)).otherwise(F.get_json_object(text, f"$.{field}"))


def _titled(key: str) -> str:
    words = re.sub(r"([a-z])([A-Z])", r"\1 \2", re.sub("[_-]+", " ", key))
    return words[:1].upper() + words[1:]


def prose(value, nested: bool = False) -> str:
    """Any JSON value as readable text: lists joined, objects as ``Key: text``."""
    if isinstance(value, dict):
        told = ((_titled(k), prose(v, True)) for k, v in value.items())
        return ". ".join(f"{k}: {t}" for k, t in told if t)
    if isinstance(value, list):
        return ("; " if nested else " ").join(t for t in (prose(v, True) for v in value) if t)
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return "" if value is None else str(value).strip()


def _items(text: str) -> list[str] | None:
    parsed = json.loads(text)
    return [t for t in (prose(v, True) for v in parsed) if len(t) > 2] if isinstance(parsed, list) else None


# Prose of a JSON text.
to_prose = per_value(lambda v: prose(json.loads(v)), *TEXT)
_listed = per_value(_items, *TEXTS)


def to_bullets(value: Column) -> Column:
    """A list as it is; other JSON text split at semicolons, lines and sentence ends."""
    text = F.coalesce(to_prose(value), F.lit(""))
    parts = F.transform(F.split(text, r"[;\n]+|(?<=\.)\s+(?=[A-Z])"), lambda p: F.regexp_replace(trimmed(p), r"^[-*•]\s*", ""))
    return F.coalesce(_listed(value), F.filter(parts, lambda p: F.length(p) > 2))


def strip_echoed_original(c: Column) -> Column:
    """Longest fragment of 3+ characters without CJK, when the answer repeats the original."""
    parts = F.transform(F.split(c, r"\s*[-–—:：|/(){}\[\]]\s*"), trimmed)
    latin = F.filter(parts, lambda p: (p != "") & ~p.rlike(CJK))
    best = F.try_element_at(
        F.array_sort(latin, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0)),
        F.lit(1),
    )
    return F.when(~c.rlike(CJK), c).otherwise(F.coalesce(F.when(F.length(best) >= 3, best), F.lit("")))


def parse_numbered_list(raw: Column) -> Column:
    """Array of (number, text) from ``n. text`` and ``n) text`` lines."""
    pattern = r"^\s*([0-9]+)\s*[.)]\s*(.+?)\s*$"
    lines = F.filter(F.split(clean_completion(raw), "\n"), lambda line: line.rlike(pattern))
    return F.transform(
        lines,
        lambda line: F.struct(
            F.regexp_extract(line, pattern, 1).try_cast("bigint").alias("number"),
            F.regexp_extract(line, pattern, 2).alias("text"),
        ),
    )


def translated_name(answer: Column) -> Column:
    """Usable English name of one answer line, else null."""
    bare = F.regexp_replace(answer, "^[\"'`]|[\"'`]$", "")
    name = strip_echoed_original(clean_text(bare, 160))
    return F.when((name != "") & ~is_mostly_non_latin(name) & ~name.rlike(CJK), name)
