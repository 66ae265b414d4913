"""Opening-hours claims in prose, tested against the place's own hours tag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placemill.functions.text import EDGE_L, EDGE_R, trimmed

# Day abbreviations and words, Monday first, and the schedule words.
DAYS = "mo|tu|we|th|fr|sa|su"
DAY_WORDS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
SCHEDULE_WORDS = "open|opens|opening|closed|closes|closing|hours"
ALL, WEEKDAYS, WEEKEND = 127, 31, 96

TAG_RANGE = f"{EDGE_L}(?:{DAYS})\\s*-\\s*(?:{DAYS}){EDGE_R}"
TEXT_RANGE = f"{EDGE_L}(?:{DAY_WORDS})\\s*(?:to|through|-|–|until)\\s*(?:{DAY_WORDS}){EDGE_R}"


def _index(token: Column) -> Column:
    """Monday = 0 ... Sunday = 6, from the first two letters."""
    pairs = [F.when(F.substring(token, 1, 2) == day, F.lit(i)) for i, day in enumerate(DAYS.split("|"))]
    return F.coalesce(*pairs)


def _bit(day: Column) -> Column:
    return F.pow(F.lit(2), day).cast("int")


def _range_mask(text: Column) -> Column:
    """Days from the first to the last one named, wrapping past Sunday."""
    first = _index(text)
    last = _index(F.regexp_extract(text, "([a-z]+)$", 1))
    low, high = _bit(first), _bit(last) * 2
    return F.when(first <= last, high - low).otherwise(F.lit(ALL) - (low - high))


def _union(masks: Column) -> Column:
    return F.aggregate(masks, F.lit(0), lambda acc, m: acc.bitwiseOR(m))


def times_in(text: Column) -> Column:
    """Distinct clock times, hours padded to two digits."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{EDGE_L}(\\d{{1,2}}:\\d{{2}}){EDGE_R}"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.lpad(t, 5, "0")))


def days_covered(tag: Column) -> Column:
    """7-bit day set of an hours tag; null when the tag is absent, all days when it names none."""
    value = F.lower(tag)
    ranges = F.regexp_extract_all(value, F.lit(TAG_RANGE), F.lit(0))
    rest = F.regexp_replace(value, TAG_RANGE, " ")
    singles = F.regexp_extract_all(rest, F.lit(f"{EDGE_L}({DAYS}){EDGE_R}"), F.lit(1))
    mask = _union(F.transform(ranges, _range_mask)).bitwiseOR(_union(F.transform(singles, lambda d: _bit(_index(d)))))
    return F.when(trimmed(tag) != "", F.when(value.contains("24/7") | (mask == 0), F.lit(ALL)).otherwise(mask))


def days_claimed(text: Column) -> Column:
    """7-bit set of the days a sentence says the place is open."""
    value = F.lower(text)
    ranges = _union(F.transform(F.regexp_extract_all(value, F.lit(TEXT_RANGE), F.lit(0)), _range_mask))
    singles = F.regexp_extract_all(value, F.lit(f"{EDGE_L}({DAY_WORDS}){EDGE_R}"), F.lit(1))
    named = F.when(ranges != 0, ranges).otherwise(_union(F.transform(singles, lambda d: _bit(_index(d)))))
    for words, mask in (("daily|every day|all week|seven days", ALL), ("weekdays?", WEEKDAYS), ("weekends?", WEEKEND)):
        named = named.bitwiseOR(F.when(value.rlike(f"{EDGE_L}(?:{words}){EDGE_R}"), F.lit(mask)).otherwise(F.lit(0)))
    return named


def asserts_hours(sentence: Column) -> Column:
    """Mentions a schedule and a time or day."""
    value = F.lower(sentence)
    when = (
        value.rlike(f"{EDGE_L}(?:{DAY_WORDS}|daily|weekdays?|weekends?){EDGE_R}")
        | value.rlike(f"{EDGE_L}\\d{{1,2}}:\\d{{2}}{EDGE_R}")
        | value.rlike(f"{EDGE_L}\\d{{1,2}}\\s*(?:am|pm){EDGE_R}")
    )
    return value.rlike(f"{EDGE_L}(?:{SCHEDULE_WORDS}){EDGE_R}") & when


def split_sentences(text: Column) -> Column:
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(parts, trimmed), lambda s: s != "")


def hours_supported(sentence: Column, covered: Column, times: Column) -> Column:
    """True when the sentence claims no hours, or only days and times the tag has."""
    backed = (days_claimed(sentence).bitwiseAND(F.bitwise_not(covered)) == 0) & (
        F.size(F.array_except(times_in(sentence), times)) == 0
    )
    return ~asserts_hours(sentence) | F.coalesce(backed, F.lit(False))


def strip_unsupported_hours(text: Column, tag: Column) -> Column:
    """Struct of the kept text and the removed sentences; the tag is read once, each sentence judged once."""
    once = lambda value, body: F.transform(F.array(value), body)[0]

    def judge(t: Column) -> Column:
        verdicts = F.transform(
            split_sentences(text), lambda s: F.struct(s.alias("s"), hours_supported(s, t["covered"], t["times"]).alias("ok"))
        )
        return once(verdicts, lambda v: F.struct(
            F.array_join(F.transform(F.filter(v, lambda j: j["ok"]), lambda j: j["s"]), " ").alias("kept"),
            F.transform(F.filter(v, lambda j: ~j["ok"]), lambda j: j["s"]).alias("removed"),
        ))

    return once(F.struct(days_covered(tag).alias("covered"), times_in(tag).alias("times")), judge)


# Fixed value: the stricter pattern by which the quality report finds a schedule.
HOURS_CLAIM = (
    "(?i)" + EDGE_L + r"(?:[01]?\d|2[0-3])[:.][0-5]\d\s*(?:[-–—]|to" + EDGE_R + "|until" + EDGE_R + ")"
    "|" + EDGE_L + r"(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*" + EDGE_R + r"[^.]{0,40}" + EDGE_L + r"(?:[01]?\d|2[0-3])[:.][0-5]\d"
    "|" + EDGE_L + r"open(?:s|ing)?" + EDGE_R + r"[^.]{0,30}" + EDGE_L + r"(?:[01]?\d|2[0-3])[:.][0-5]\d"
)


def claims_hours(text: Column) -> Column:
    return F.coalesce(text.rlike(HOURS_CLAIM), F.lit(False))
