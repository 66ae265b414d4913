"""Repeated passages against brute force, and on odd rows."""

import random
import re

from pyspark.sql import functions as F

from placemill.llm import lines


def brute(rows, least, few):
    """(id, text, spans) of rows in the order they lie, word by word."""
    seen, out = set(), []
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        text = rows[i][1] or ""
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\t\n\v\f\r ]+", text)]
        units, unit = [], []
        for k, (a, b) in enumerate(words):
            unit.append((a, b))
            gap = text[b : words[k + 1][0]] if k + 1 < len(words) else "\n"
            if text[b - 1] in ".!?,;:" or "\n" in gap:
                units.append(unit)
                unit = []
        spans, run = [], []
        for unit in [*units, None]:
            key = unit and tuple(text[a:b].lower() for a, b in unit)
            if key in seen:
                run.append(unit)
            else:
                if sum(len(u) for u in run if len(u) >= few) >= least:
                    spans.append((run[0][0][0], run[-1][-1][1]))
                run = []
            if unit:
                seen.add(key)
        kept, at = "", 0
        for a, b in spans:
            kept, at = kept + text[at:a], b
        out.append((rows[i][0], kept + text[at:], spans))
    return sorted(out, key=str)


def cut(docs, least, few):
    return sorted(((r.doc_id, r.text, [tuple(s) for s in r.removed]) for r in lines.cut_passages(docs, least, few).collect()), key=str)


def test_passages_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    words = ["a", "b.", "C,", "d", "é!", "f;", "北京", "g:h", "\U0001f642.", "I"]
    blank = lambda: rng.choice([" ", " ", " ", "\n", " \n ", "\t", "  ", "\r\n"])
    passage = lambda n: "".join(rng.choice(words) + blank() for _ in range(n))
    shared = [passage(rng.randrange(3, 20)) for _ in range(10)]
    rows = [(rng.choice([i, i, None, 4]), rng.choice([None, ""] + [blank() + "".join(rng.choice([rng.choice(shared), passage(rng.randrange(5))]) for _ in range(4))] * 8)) for i in range(120)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows + rows[:8], "doc_id bigint, text string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    lying = [tuple(r) for r in docs.collect()]
    for least, few in ((1, 1), (4, 2), (9, 3)):
        want = brute(lying, least, few)
        assert cut(docs, least, few) == want and sum(len(r[2]) for r in want) > 10


def test_passages_on_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i % 977} and{i % 13}{'.' if i % 7 == 0 else ''}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (4, long), (None, "x, y, z and more words"), (None, "x, y, z and more words"), (5, "," * 3000), (6, ". " * 3000)]
    shape = "doc_id bigint, text string, _row bigint, digest string, pos int, start int, cut string, n bigint"
    path = str(tmp_path / "docs")
    spark.createDataFrame([(*r, 3, "x", 1, 2, "y", 4) for r in rows], shape).repartition(2).write.parquet(path)
    docs = spark.read.parquet(path)
    lying = [(r.doc_id, r.text) for r in docs.orderBy(F.monotonically_increasing_id()).collect()]
    got = cut(docs, 5, 1)
    assert got == brute(lying, 5, 1) and ("None", "", [(0, 22)]) in [(str(i), t, s) for i, t, s in got]
    assert lines.cut_passages(spark.createDataFrame([], shape)).collect() == []


def test_a_passage_inside_longer_lines_goes_and_short_turns_stay(spark):
    passage = "It was a long passage, of many words; " + " ".join(f"w{i}" for i in range(40)) + "."
    rows = [(1, f"A first line. {passage} The end."), (2, f"Quite another beginning, then. {passage} And so on."), (3, "The end. And so on.")]
    got = {r.doc_id: r.text for r in lines.cut_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: rows[0][1], 2: "Quite another beginning, then.  And so on.", 3: rows[2][1]}
