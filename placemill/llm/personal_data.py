"""Personal data: fixed patterns, and identifiers learnt from the contexts that the fixed ones stand in.

Fixed patterns give the seed entities. The words beside a seed are lexical patterns
("call me at _"). Other identifier-like words that stand in the same contexts are
candidates. Patterns and instances form a bipartite graph; pattern scores (how sure
its instances are) and instance scores (how sure its patterns are) are computed from
one another for a few rounds, as joins and sums over the edges. Candidates whose
score passes the threshold are added as spans of kind ``id``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import ROW, packed, stored

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "id")

# The same matches in linear time: from each @ outwards, and from the first digit of a run only.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(EMAIL.pattern.partition("@")[2])
IP_RUN = re.compile("(?<![0-9])" + IP.pattern)
DIGIT = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")
# A candidate is a run without white space with a digit in it, at least this long, outer punctuation aside.
RUN = re.compile(r"[0-9]\S*")
EDGES = "\"'`.,;:!?()[]{}<>|*"
SHORTEST = 5
REACH = 80


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of EMAIL, leftmost and not overlapping."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, by start, then kind; matches that fail their test are dropped."""
    out = []
    if "@" in text:
        out += [(start, 0, end) for start, end in emails(text)]
    if DIGIT.search(text):
        for m in IP_RUN.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGITS.sub("", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: two words before, one before with one after, two after; marks kept, lower case."""
    before = text[max(0, start - REACH) : start].lower().split()[-2:]
    after = text[end : end + REACH].lower().split()[:2]
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    if len(after) == 2:
        out.append(f"_ {after[0]} {after[1]}")
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, list[str]]]:
    """(start, end, patterns) of identifier-like words that no base span touches."""
    if not DIGIT.search(text):
        return []
    out, taken = [], iter(sorted((s, e) for s, _, e in base))
    now = next(taken, None)
    for m in RUN.finditer(text):
        start, end = m.span()
        while start and not text[start - 1].isspace():
            start -= 1
        key = text.rfind("=", start + 1, end - 1)
        label = ""
        if key > 0:
            label, start = text[start : key + 1], key + 1
        while start < end and text[start] in EDGES:
            start += 1
        while end > start and text[end - 1] in EDGES:
            end -= 1
        while now and now[1] <= start:
            now = next(taken, None)
        if end - start < SHORTEST or (now and now[0] < end):
            continue
        own = [f"{label.lower()}_"] if label else []  # what is written onto the word itself is a pattern too
        out.append((start, end, own + contexts(text, start, end)))
    return out


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, base, seeds, found): for each row its base spans, and the patterns around base spans and candidates.

    seeds and found list (start, end, instance, pattern); the text itself is not carried on.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int64())])
        seen = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("pattern", pa.string()), ("seed", pa.bool_())])
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                bases, around = [], []
                for value in part.column(1):
                    text = value.as_py()
                    base = base_spans(text)
                    bases.append([{"start": s, "end": e, "kind": k} for s, k, e in base])
                    here = [(s, e, p, True) for s, _, e in base for p in contexts(text, s, e)]
                    here += [(s, e, p, False) for s, e, ps in candidates(text, base) for p in ps]
                    around.append([{"start": s, "end": e, "instance": text[s:e].lower(), "pattern": p, "seed": is_seed} for s, e, p, is_seed in here])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bases, pa.list_(span)), pa.array(around, pa.list_(seen))], names=["doc_id", "base", "around"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, base array<struct<start:bigint,end:bigint,kind:bigint>>, around array<struct<start:bigint,end:bigint,instance:string,pattern:string,seed:boolean>>")


def score_graph(edges: DataFrame, rounds: int, support: int) -> tuple[DataFrame, DataFrame]:
    """(instance, score) and (pattern, score) after ``rounds`` over distinct (instance, pattern, seed) edges.

    Seeds score 1 throughout, other instances begin at 0. A pattern scores the mean
    of its instances, and nothing unless at least ``support`` of them score a half
    or more; an instance scores 1 - prod(1 - pattern score).
    """
    seeds = edges.groupBy("instance").agg(F.max("seed").alias("seed"))
    instances = seeds.select("instance", "seed", F.col("seed").cast("double").alias("score"))
    patterns = None
    for _ in range(rounds):
        held = edges.select("instance", "pattern").join(instances, "instance")
        patterns = held.groupBy("pattern").agg(F.avg("score").alias("mean"), F.count_if(F.col("score") >= 0.5).alias("sure"))
        patterns = stored(patterns.where(F.col("sure") >= support).select("pattern", F.col("mean").alias("p")), "pattern-scores")
        reached = edges.select("instance", "pattern").join(patterns, "pattern")
        new = reached.groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("p"), F.lit(0.999999)))))).alias("new"))
        instances = seeds.join(new, "instance", "left").select("instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("new", F.lit(0.0))).alias("score"))
        instances = stored(instances, "instance-scores")
    return instances.select("instance", "score"), patterns


def find_personal_data(docs: DataFrame, rounds: int = 3, support: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, base, added): spans (start, end, kind) of every row, in code points of the whole text, end exclusive.

    ``base`` are the fixed patterns' matches, by start and kind; ``added`` the
    identifiers discovered: words whose instance score is ``threshold`` or more by
    patterns with ``support`` sure instances, where they stand in such a pattern.
    A null text counts as empty; a text without data gets empty lists; rows stay
    as they are, with repeated and null ids; other columns are dropped.
    """
    scanned = stored(docs.transform(occurrences).withColumn("_row", F.monotonically_increasing_id()), "occurrences")
    around = scanned.select("_row", F.explode("around").alias("o")).select("_row", "o.*")
    edges = around.groupBy("instance", "pattern").agg(F.max("seed").alias("seed"))
    # A pattern without a seed can be reached from instances of others, so all edges take part.
    edges = stored(edges, "edges")
    instances, patterns = score_graph(edges, rounds, support)
    sure = instances.where(F.col("score") >= threshold)
    met = around.where("not seed").join(patterns.where(F.col("p") >= 0.5).select("pattern"), "pattern").join(sure.select("instance"), "instance")
    # A digest of the candidate's own spans only: one row for each text, however often its identifiers occur elsewhere.
    added = met.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("start", "end", F.lit(len(KINDS) - 1).cast("bigint").alias("kind")))).alias("added"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:bigint>>")
    return scanned.select("_row", "doc_id", "base").join(added, "_row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def span_text(spans):
    """kind:start:end of each span by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"].cast("int")), s["start"], s["end"])), ",")


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets; ``n_chars``, where there is one, follows.

    All rows and columns stay. Overlapping spans become one, named by the first.
    A row of null text stays null. ``docs`` must read the same each time.
    """
    rows = packed(docs)
    spans = find_personal_data(rows.select(F.col(ROW).alias("doc_id"), "whole.text"), **options)
    spans = spans.select(F.col("doc_id").alias(ROW), F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"], s["kind"].alias("kind"), s["end"].alias("end")))).alias("_spans"))
    spans = spans.where(F.size("_spans") > 0)
    names = F.array(*map(F.lit, KINDS))
    begin = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("at"))

    def step(done, s):
        inside = s["start"] < done["at"]
        between = F.substring(F.col("whole.text"), (done["at"] + 1).cast("int"), F.greatest(F.lit(0), (s["start"] - done["at"])).cast("int"))
        text = F.when(inside, done["text"]).otherwise(F.concat(done["text"], between, F.lit("["), F.get(names, s["kind"].cast("int")), F.lit("]")))
        return F.struct(text.alias("text"), F.greatest(done["at"], s["end"]).alias("at"))

    folded = F.aggregate("_spans", begin, step, lambda done: F.concat(done["text"], F.substring(F.col("whole.text"), (done["at"] + 1).cast("int"), F.length("whole.text"))))
    joined = rows.join(spans.hint("merge"), ROW, "left")
    clean = joined.withColumn("_new", F.when(F.col("_spans").isNull(), F.col("whole.text")).otherwise(folded))
    length = F.when(F.col("_spans").isNull(), F.col("whole.n_chars")).otherwise(F.length("_new")) if "n_chars" in docs.columns else None
    new = {"text": F.col("_new")} | ({"n_chars": length.cast(docs.schema["n_chars"].dataType)} if length is not None else {})
    return clean.select(*(new.get(c, F.col("whole")[c]).alias(c) for c in docs.columns))
