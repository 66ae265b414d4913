"""Vector codes, repeated byte strings and importance resampling against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from placemill.llm import codebooks, resample, suffix_buckets
from placemill.llm.common import ROW
from placemill.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"
LONG = " ".join(f"w{i % 977} and{i % 13}" for i in range(40_000))
SHAPE = "doc_id bigint, text string, lang string, _row bigint, key string, n bigint, rank bigint, segment int, open boolean, score double"
ODD_TEXTS = [
    (1, None), (2, ""), (3, "one"), (4, "  \n\t "), (None, "no id but words " * 20), (5, "mail me at a.b@c.de today please now"), (5, "mail me at a.b@c.de today please now"),
    (6, LONG), (7, "İΣς 北京 é́ ½ \U0001f642 " * 30), (None, None), (8, "0" * 5000 + " " + "ab" * 300), (9, "no id but words " * 20), (9, "0" * 400),
]


def written(spark, tmp_path, rows, shape, parts=3):
    path = str(tmp_path / "table")
    spark.createDataFrame(rows, shape).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rows = [(i, t, None, 3, "x", 2, 1, 4, False, 0.5) for i, t in ODD_TEXTS]
    return written(spark, tmp_path_factory.mktemp("odd"), rows, SHAPE)


@pytest.mark.parametrize("name", ["op11_adaptive_bounds", "op12_bucket_refinement", "op13_regular_sampling"])
def test_sql(spark, name):
    ok, message = compare(spark, connect(FOLDER), FOLDER, name, QUERIES[name], ORACLES[name])
    assert ok, message


# Repeated byte strings


def brute_repeats(rows, length):
    """(id, kept, bytes, spans) of rows in the order they lie."""
    seen, out = set(), []
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        text = (rows[i][1] or "").encode()
        cut = np.zeros(len(text), bool)
        for p in range(len(text) - length + 1):
            if text[p : p + length] in seen:
                cut[p : p + length] = True
            seen.add(text[p : p + length])
        edges = np.flatnonzero(np.diff(np.r_[False, cut, False])).tolist()
        out.append((rows[i][0], bytes(b for b, c in zip(text, cut) if not c), len(text), list(zip(edges[::2], edges[1::2]))))
    return sorted(out, key=str)


def removed(docs, length):
    return sorted(((r.doc_id, bytes(r.kept), r.n_bytes, [(s.start, s.end) for s in r.removed]) for r in suffix_buckets.remove_repeats(docs, length).collect()), key=str)


@pytest.mark.parametrize("length", [8, 20, 33, 100])
def test_repeats_against_brute_force(spark, tmp_path, length):
    rng = random.Random(length)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.randrange(5, 2 * length))) for _ in range(8)]
    rows = []
    for i in range(120):
        kinds = lambda: [rng.choice(passages), "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 40))), "ab" * rng.randrange(length), "x" * rng.randrange(2 * length)]
        text = "".join(rng.choice(kinds()) for _ in range(rng.randrange(7)))
        rows.append((rng.choice([i, i, i, None, 5]), rng.choice([text, text, text, None])))
    docs = written(spark, tmp_path, rows + rows[:10], "doc_id bigint, text string", 1)
    rows = [tuple(r) for r in docs.collect()]
    want = brute_repeats(rows, length)
    assert removed(docs, length) == want and sum(len(r[3]) for r in want) > 50


def test_pieces_of_long_texts_give_the_same_spans(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(2000))) + passage + "z" * rng.randrange(900)) for i in range(20)]
    docs = written(spark, tmp_path, rows, "doc_id int, text string", 1)
    monkeypatch.setattr(suffix_buckets, "CHUNK_BYTES", 256)
    # Tasks have modules of their own, so the pieces are cut here.
    column = pa.array([t.encode() for _, t in rows], pa.binary())
    starts = collections.defaultdict(set)
    for which, data, begin, end, place in suffix_buckets.pieces(column, 99):
        text, _, _, _, lo, hi = suffix_buckets.text_nodes(data, begin, end, 100)
        for t, a, b in zip(text.tolist(), lo.tolist(), hi.tolist()):
            found = {a - int(begin[t]) + int(place[t]) + k for k in range(b - a + 1)}
            assert not found & starts[int(which[t])]
            starts[int(which[t])] |= found
    assert starts == {i: set(range(len(t) - 99)) for i, t in rows}
    assert removed(docs, 100) == brute_repeats([tuple(r) for r in docs.collect()], 100)


def test_repeats_on_odd_rows(spark, odd):
    want = brute_repeats([(r.doc_id, r.text) for r in odd.orderBy(F.monotonically_increasing_id()).collect()], 100)
    assert removed(odd, 100) == want
    assert suffix_buckets.remove_repeats(spark.createDataFrame([], SHAPE)).collect() == []


def test_a_passage_in_every_text_stays_one_row_a_bucket_and_kind(spark, tmp_path):
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(i, "".join(rng.choice("ijklmnop ") for _ in range(200)) + passage + "".join(rng.choice("qrstuvwx ") for _ in range(200))) for i in range(400)]
    docs = written(spark, tmp_path, rows, "doc_id bigint, text string", 4)
    got = removed(docs, 100)
    assert sum(len(r[3]) for r in got) == 399
    assert got == brute_repeats(rows, 100)


# Vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """Plain k-means over the parts of (id, vector, label), all distances measured."""
    kept = [(i, v, b) for i, v, b in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    wide = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    x = np.array([[math.floor(1024 * c) for c in v] + [0] * (wide * parts - len(v)) for _, v, _ in kept], dtype=object).reshape(len(kept), parts, wide)
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[x[i, p].tolist() for i in order] for p in range(parts)]

    def assign():
        out = []
        for i in range(len(kept)):
            d = [min((sum((a - b) ** 2 for a, b in zip(x[i, p], c)), e) for e, c in enumerate(books[p])) for p in range(parts)]
            out.append(([e for _, e in d], sum(s for s, _ in d)))
        return out

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(order)):
                own = [x[i, p] for i in range(len(kept)) if codes[i][0][p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    final = [(i, "".join("%02x" % e for e in c), s) for (i, _, _), (c, s) in zip(kept, assign())]
    return sorted(final, key=str), books


def vectors_of(seed, n, wide, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(wide)] for _ in range(6)]
    return [(i, [float(np.float32(c + rng.gauss(0, 0.2 * spread))) for c in rng.choice(centres)], rng.choice([None, 0, 1])) for i in range(n)]


@pytest.mark.parametrize("seed,n,wide,entries,tracked", [(1, 150, 8, 20, 4), (2, 200, 4, 256, 12), (3, 150, 8, 16, 1), (4, 120, 16, 30, 29)])
def test_codes_against_brute_force(spark, tmp_path, seed, n, wide, entries, tracked):
    rows = vectors_of(seed, n, wide)
    # Coarse vectors bring many equal distances.
    rows += [(1000 + i, [float(round(c)) for c in v], b) for i, v, b in rows[:60]]
    table = written(spark, tmp_path, rows, "vec_id bigint, embedding array<float>, label int")
    out, books = codebooks.compress(table, entries=entries, tracked=tracked)
    want, want_books = brute_codes(rows, entries=entries)
    assert sorted(((r.vec_id, r.code, r.error) for r in out.collect()), key=str) == want
    assert books.tolist() == want_books


def test_codes_on_odd_rows(spark, tmp_path):
    rows = vectors_of(5, 40, 8) + [
        (50, None, 1), (51, [1.0, None] + [0.0] * 6, 1), (52, [float("nan")] * 8, 1), (53, [float("inf")] + [0.0] * 7, 1), (54, [-float("inf")] * 8, None),
        (None, [0.5] * 8, None), (55, [], 2), (56, [0.25, -0.3, 1e-9], 2), (57, [0.5] * 7, None), (57, [0.5] * 7, None), (57, [-0.5] * 7, 3), (58, [900.0] * 8, 0),
    ]
    extra = [(*r, "x", 7, b"y", 1) for r in rows]
    table = written(spark, tmp_path, extra, "vec_id bigint, embedding array<float>, label int, code string, part int, vector binary, n int")
    out, books = codebooks.compress(table, entries=7)
    want, want_books = brute_codes(rows, entries=7)
    got = codebooks.with_label_errors(out).collect()
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=str) == want and books.tolist() == want_books
    by_label = collections.Counter()
    for r in got:
        by_label[r.label] += r.error
    assert all(r.label_error == by_label[r.label] for r in got) and None in by_label
    none = spark.createDataFrame([(1, None, 1)], "vec_id bigint, embedding array<float>, label int")
    for empty in (none, none.limit(0)):
        out, books = codebooks.compress(empty)
        assert codebooks.with_label_errors(out).collect() == [] and books.size == 0
    only_empty = spark.createDataFrame([(1, [], 1), (2, [], None)], "vec_id bigint, embedding array<float>, label int")
    assert sorted((r.vec_id, r.code, r.error) for r in codebooks.compress(only_empty)[0].collect()) == [(1, "00000000", 0), (2, "00000000", 0)]
    huge = spark.createDataFrame([(1, [1e30] * 8, 1)], "vec_id bigint, embedding array<float>, label int")
    with pytest.raises(ValueError):
        codebooks.compress(huge)


def test_large_components_keep_whole_distances():
    rng = np.random.default_rng(1)
    x, book = rng.integers(-(1 << 27), 1 << 27, (30, 4)), rng.integers(-(1 << 27), 1 << 27, (9, 4))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)) for c in book] for r in x]
    assert codebooks.distances(x, book, False).tolist() == want
    assert codebooks._closest(codebooks.distances(x, book, False), 3)[:, 0].tolist() == [d.index(min(d)) for d in want]


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(2)
    x, book = rng.integers(-500, 500, (400, 4)), rng.integers(-500, 500, (40, 4))
    entries, bounds, d = codebooks.search(x, book, 8, True)
    spared = 0
    for step in (60, 20, 5, 0):
        new = book + rng.integers(-step, step + 1, book.shape)
        moves = np.ceil(np.sqrt(((new - book) ** 2).sum(axis=1))).astype(np.int64)
        book = new
        entries, bounds, d, reach = codebooks.assign(x, book, entries, bounds, moves, True)
        all_ = codebooks.distances(x, book, True)
        assert entries[:, 0].tolist() == all_.argmin(axis=1).tolist() and d.tolist() == all_.min(axis=1).tolist()
        for i in range(x.shape[0]):
            assert (np.diff(bounds[i]) >= 0).all()
            assert all(bounds[i, k] ** 2 <= all_[i, entries[i, k + 1]] for k in range(8))
            rest = np.setdiff1d(np.arange(40), entries[i])
            assert bounds[i, 8] ** 2 <= all_[i, rest].min()
        spared += int((reach == 1).sum())
    assert spared > 600


def test_tracked_entries_shrink_with_need():
    assert codebooks.next_tracked(12, {1: 500, 2: 90, 13: 10}) == codebooks.TRACKED_LEAST
    assert codebooks.next_tracked(12, {2: 10, 9: 90}) == 8
    assert codebooks.next_tracked(12, {1: 5, 14: 80}) == 12
    assert codebooks.next_tracked(3, {2: 5}) == 3


# Importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs_of(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def test_checksums_of_runs():
    rng = random.Random(1)
    letters = ["a", "B", "z9", " ", "  ", "\n", "é", "北京", "-", "_", "x" * 70, "\x00", ""]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)] + ["", "A"]
    column = pa.array([t.encode() for t in texts], pa.binary()).slice(3)
    for low, _, data, starts, ends in resample._chunks(column):
        n, runs = resample.features(data, starts, ends)
        for i in range(starts.size):
            words, want = runs_of(texts[low + i + 3])
            assert n[i] == len(words)
            assert sorted(c for t, crc in runs for c in crc[t == i].tolist()) == sorted(zlib.crc32(w.encode()) for w in want)


def brute_resample(docs, target, percent, least, seed, m):
    counts = [collections.Counter(zlib.crc32(f.encode()) % m for _, t in rows for f in runs_of(t)[1]) for rows in (docs, target)]
    s, t = (sum(c.values()) for c in counts)
    gain = [math.floor(1000 * math.log((counts[1][b] + 1) * (s + m) / ((counts[0][b] + 1) * (t + m)))) for b in range(m)]
    out = []
    for place, (i, text) in enumerate(docs):
        words, runs = runs_of(text)
        weight = sum(gain[zlib.crc32(f.encode()) % m] for f in runs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, place])
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[6]))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[5] = k + 1
    return sorted((tuple(r[:6]) for r in out), key=str)


def test_resample_against_brute_force(spark, odd):
    target = spark.createDataFrame([(1, "mail me today"), (2, None), (3, "w1 and1 no id")], "item_id bigint, text string")
    docs = [(r.doc_id, r.text) for r in odd.orderBy(F.monotonically_increasing_id()).collect()]
    got = sorted((tuple(r) for r in resample.resample(odd, target, percent=60, least_words=3).collect()), key=str)
    want = brute_resample(docs, [(r.item_id, r.text) for r in target.collect()], 60, 3, 42, 10_000)
    assert got == want and sum(r[5] is not None for r in want) == 3
    empty = spark.createDataFrame([], SHAPE)
    assert resample.resample(empty, target).collect() == []
    assert all(r["rank"] is None for r in resample.resample(odd, empty, percent=0).collect())


@pytest.mark.parametrize("draw,segments", [(0, 4), (1, 4), (137, 7), (700, 1), (700, 16), (2000, 5)])
def test_ranks_by_regular_sampling(spark, tmp_path, draw, segments):
    rng = random.Random(segments)
    # A third of the rows share one score, and many share an id.
    rows = [(rng.choice([i, i // 3, None]), rng.choice([5, rng.randrange(50), rng.randrange(10**6)]), i, rng.random() < 0.7) for i in range(2000)]
    table = written(spark, tmp_path, rows, f"doc_id bigint, score bigint, {ROW} bigint, open boolean", 5)
    order = sorted((r for r in rows if r[3]), key=lambda r: (-r[1], r[0] is None, r[0] or 0, r[2]))
    want = {r[2]: k + 1 for k, r in enumerate(order[: min(draw, len(order))])}
    got = resample.ranked(table, min(draw, len(order)), len(order), segments).collect()
    assert len(got) == len(rows) and {r[ROW]: r["rank"] for r in got if r["rank"] is not None} == want


def test_splitters_cut_even_segments(spark, tmp_path):
    rows = [(i, (i * 7919) % 10007, i, True) for i in range(10_000)]
    table = written(spark, tmp_path, rows, f"doc_id bigint, score bigint, {ROW} bigint, open boolean", 6)
    cuts = resample.splitters(table, 10_000, 10)
    sizes = collections.Counter(sum(c <= (-s, False, i, r) for c in cuts) for i, s, r, _ in rows)
    assert len(cuts) == 9 and max(sizes.values()) <= 10_000 / 10 + 6 * 100
