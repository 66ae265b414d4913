"""The dealt operators against brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from placemill.llm import bpe, decontaminate, lattice, licences, lines, near_copies, personal_data, prefix_hash, quality, toxicity
from placemill.llm.common import fold, read
from placemill.llm.queries import ORACLES, QUERIES, word_bpe

FOLDER = "/root/testdata/sf0.001"
SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row bigint, whole string, score double, word string, n bigint, component bigint"
LONG = " ".join(f"w{i % 977} and{i % 13}" for i in range(30_000))
ODD_TEXTS = [
    (1, None), (2, ""), (3, "one"), (4, "  \n\t "), (5, "mail me at a.b@c.de today please now"), (None, "no id but words enough to be a text"),
    (5, "mail me at a.b@c.de today please now"), (5, "mail me at a.b@c.de today please now"), (6, LONG), (7, "İΣς 北京 é́ ½ \U0001f642"), (None, None), (8, "one"),
    (9, "Released under the MIT License. and more"), (10, "0" * 5000 + " " + "@" * 300 + "+1" * 500),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rows = [(i, t, None, None, None, 3, "x", 0.5, "y", 2, 9) for i, t in ODD_TEXTS]
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    spark.createDataFrame(rows, SHAPE).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def tests_(spark):
    return spark.createDataFrame([(1, "no id but words enough to be a text"), (2, None), (3, ""), (4, "short one")], "item_id bigint, text string")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


def operators(tests_, no_labels):
    """name -> (function of the documents, whether all rows come back)"""
    return {
        "lattice": (lambda d: lattice.score_documents(d, word_bpe(), fold(F.col("doc_id"), 10) != 0, rounds=1), True),
        "jaccard": (near_copies.jaccard_join, True), "keep_one": (near_copies.keep_one, False), "prefixes": (prefix_hash.edited_fingerprints, True),
        "fingerprints": (prefix_hash.fingerprints, True), "licences": (licences.license_scan, False),
        "bpe": (lambda d: bpe.decode_documents(bpe.encode_documents(d, word_bpe()), word_bpe()), True),
        "toxicity": (lambda d: toxicity.toxicity_scores(d, no_labels), True), "quality": (lambda d: quality.quality_scores(d, no_labels), True),
        "keep_good": (lambda d: quality.keep_good(d, no_labels), True), "contamination": (lambda d: decontaminate.contamination(d, tests_), False),
        "remove": (lambda d: decontaminate.remove_contaminated(d, tests_), False), "personal": (personal_data.find_personal_data, True),
        "redact": (personal_data.redact, True), "lines": (lines.deduplicate, True),
    }


NAMES = ["lattice", "jaccard", "keep_one", "prefixes", "fingerprints", "licences", "bpe", "toxicity", "quality", "keep_good", "contamination", "remove", "personal", "redact", "lines"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, nothing, tests_, no_labels, name):
    fn, whole = operators(tests_, no_labels)[name]
    out = fn(odd)
    rows = out.collect()
    if whole:
        assert sorted((r.doc_id for r in rows), key=str) == sorted((i for i, _ in ODD_TEXTS), key=str)
    if name in ("keep_one", "keep_good", "remove", "redact"):
        assert out.columns == odd.columns and all(r["_row"] == 3 and r["whole"] == "x" and r["score"] == 0.5 for r in rows)
    assert fn(nothing).collect() == []


def texts_of(spark):
    return {r.doc_id: r.text for r in read(spark, FOLDER, "documents").select("doc_id", "text").collect()}


def test_lattice_sums_all_segmentations():
    pieces = [b"a", b"b", b"c", b"ab", b"bc", b"abc"]
    pieces += [p + lattice.STOP for p in pieces]
    rng = np.random.default_rng(1)
    p = rng.random(len(pieces))
    scores = np.log(p / p.sum())
    of = dict(zip(pieces, scores))
    words = [bytes(w) for n in range(1, 6) for w in itertools.product(b"abc", repeat=n)][:200]
    table = lattice.Lattice(pieces)

    def brute(word):
        total, uses = 0.0, collections.Counter()
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            parts = [word[a:b] + (lattice.STOP if b == len(word) else b"") for a, b in zip(at, at[1:])]
            if all(x in of for x in parts):
                q = math.exp(sum(of[x] for x in parts))
                total += q
                for x in parts:
                    uses[x] += q
        return math.log(total), {k: v / total for k, v in uses.items()}

    want = [brute(w) for w in words]
    assert np.allclose(table.forward(words, scores), [w[0] for w in want])
    expected = collections.Counter()
    for _, uses in want:
        expected.update(uses)
    assert np.allclose(table.expected(words, scores), [expected[x] for x in pieces])
    assert np.isneginf(table.forward([b"xyz"], scores)[0])


def test_lattice_scores(spark):
    got = {r.doc_id: r for r in QUERIES["op1_lattice_likelihood"](spark, FOLDER).collect()}
    docs = texts_of(spark)
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t)) + [""] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert -12 * len(ws) - 60 < r.score < 0
    common = lattice.score_documents(read(spark, FOLDER, "documents"), word_bpe(), fold(F.col("doc_id"), 10) != 0, common=10)
    assert all(got[r.doc_id].score == pytest.approx(r.score) and got[r.doc_id].n_known == r.n_known for r in common.collect())


def grams(text, n=5):
    ws = re.findall(r"\w+", (text or "").lower())
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def copies(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, base = [], [word() for _ in range(150)]
    for _ in range(60):
        ws = list(base)
        for _ in range(rng.randrange(0, 5)):
            ws[rng.randrange(150)] = word()
        rows.append(" ".join(ws))
    for _ in range(30):
        ws = [word() for _ in range(rng.randrange(1, 60))]
        rows += [" ".join(ws), " ".join(ws).upper(), " ".join(ws[:-1] + [word()])]
    rng.shuffle(rows)
    path = str(tmp_path / "copies")
    spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(4).write.parquet(path)
    return rows, spark.read.parquet(path)


def brute_links(rows):
    sets = [grams(t) for t in rows]
    near = collections.defaultdict(set)
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            near[i].add(j)
            near[j].add(i)
    parent = {}
    for i in range(len(rows)):
        if i not in parent:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in parent:
                    parent[x] = i
                    stack += near[x]
    return sets, near, parent


@pytest.mark.parametrize("texts, size", [(400, 400_000), (7, 900)])
def test_jaccard_join_against_all_pairs(spark, tmp_path, monkeypatch, texts, size):
    monkeypatch.setattr(near_copies, "BLOCK_TEXTS", texts)
    monkeypatch.setattr(near_copies, "BLOCK_GRAMS", size)
    rows, docs = copies(spark, tmp_path)
    sets, near, parent = brute_links(rows)
    got = {r.doc_id: r for r in near_copies.jaccard_join(docs).collect()}
    for i in range(len(rows)):
        assert got[i].n_links == len(near[i]) and got[i].class_id == parent[i]
        assert got[i].copy_of == min(j for j in range(len(rows)) if sets[j] == sets[i])
        assert got[i].n_text_links == len({frozenset(sets[j]) for j in near[i]} - {frozenset(sets[i])})
    kept = {r.doc_id for r in near_copies.keep_one(docs).collect()}
    assert kept == set(parent.values())


def test_band_counts_reach_the_recall():
    for threshold, recall in [(0.8, 0.999), (0.9, 0.99), (0.5, 0.95), (1.0, 0.999)]:
        bands, rows = near_copies.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 128


def test_prefix_hashes_answer_spans_and_extensions():
    rng = random.Random(2)
    for _ in range(40):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))) for _ in range(2))
        pa_, pb = prefix_hash.Prefixes.of(a), prefix_hash.Prefixes.of(b)
        for _ in range(40):
            i, j, n = rng.randrange(len(a)), rng.randrange(len(b)), rng.randrange(0, 12)
            assert prefix_hash.equal_spans(pa_, i, pb, j, n) == (i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])
            ahead = next((k for k in range(60) if i + k >= len(a) or j + k >= len(b) or a[i + k] != b[j + k]), 0)
            assert prefix_hash.common_extension(pa_, i, pb, j) == ahead
            back = next((k for k in range(60) if k >= i or k >= j or a[i - 1 - k] != b[j - 1 - k]), 0)
            assert prefix_hash.common_extension(pa_, i, pb, j, backwards=True) == back
        assert prefix_hash.fingerprint(pa_.then(pb)) == prefix_hash.fingerprint(prefix_hash.Prefixes.of(a + b))


def test_sketches_of_texts_that_repeat():
    rng = np.random.default_rng(7)
    for values in (np.zeros(5000, np.uint64), rng.integers(0, 20, 5000).astype(np.uint64), np.repeat(rng.integers(0, 2**32, 40), 500).astype(np.uint64), rng.integers(0, 2**32, 5000).astype(np.uint64)):
        assert prefix_hash.smallest_distinct(values, prefix_hash.SKETCH).tolist() == sorted(set(values.tolist()))[: prefix_hash.SKETCH]
    letters = random.Random(11)
    p, q = ("".join(letters.choice("abcdefgh") for _ in range(200)) for _ in range(2))
    one, two = prefix_hash.fingerprint(prefix_hash.Prefixes.of(p * 1000)), prefix_hash.fingerprint(prefix_hash.Prefixes.of((p + q) * 500))
    assert len(one.split(":")[-1]) == len(two.split(":")[-1]) == 8 * prefix_hash.SKETCH
    spans = lambda t: {t[i : i + prefix_hash.SPAN] for i in range(len(t) - prefix_hash.SPAN + 1)}
    a, b = spans(p * 3), spans((p + q) * 3)
    assert abs(prefix_hash.likeness(one, two) - len(a & b) / len(a | b)) < 0.25


def test_edited_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(prefix_hash, "PART_CHARS", 40_000)
    got = {r.doc_id: r for r in QUERIES["op3_prefix_hashes"](spark, FOLDER).collect()}
    docs = texts_of(spark)
    ids = sorted(docs)
    of = lambda t: prefix_hash.fingerprint(prefix_hash.Prefixes.of(t))
    for i, k in zip(ids, [*ids[1:], ids[0]]):
        text, half = docs[i], len(docs[i]) // 2
        edited = text[: len(text) - half] + docs[k][:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (of(text), of(edited))
        assert r.near_edited == (1.0 if edited == text else r.near_edited) and (len(text) < 40 or r.near_edited > 0.4)
        assert r.near_next == prefix_hash.likeness(of(text), of(docs[k])) and 0 <= r.near_next <= 1
    prints = collections.defaultdict(set)
    for i in ids:
        prints[docs[i]].add(got[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({x for p in prints.values() for x in p}) == len(prints)


def test_licences_against_containment(spark, tmp_path):
    rng = random.Random(6)
    fill = lambda n: " ".join("".join(rng.choice("xyzuvw") for _ in range(4)) for _ in range(n))
    names, rows = sorted(licences.TEMPLATES), []
    for i in range(60):
        ws = licences.TEMPLATES[rng.choice(names)].split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            ws[rng.randrange(len(ws))] = "zzzz"
        rows.append((i, f"{fill(rng.randrange(0, 40))} {' '.join(ws)} {fill(rng.randrange(0, 40))}"))
    rows.append((99, fill(50)))
    path = str(tmp_path / "lic")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)

    def sh(text):
        ws = re.findall(r"[^\W_]+", text.lower())
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}

    want = {(i, name) for i, t in rows for name in names if len(sh(licences.TEMPLATES[name]) & sh(t)) >= 0.8 * len(sh(licences.TEMPLATES[name]))}
    got = licences.license_scan(spark.read.parquet(path)).collect()
    assert {(r.doc_id, r.license) for r in got} == want and len(got) == len(want)
    assert all(r.first_word <= r.last_word for r in got)


def test_bpe_against_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_bpe())
    mine = bpe.tokenizer_of(open(word_bpe(), encoding="utf-8").read())
    rng = random.Random(8)
    letters = "aaaabcdeeithnours '\t\n.,!?0123½²ßéÉìΣσςİ한국中文🙂́​\x1c\x1f\x85 _-'sthe"
    cases = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    cases += ["a" * 4000, "haha" * 900, "x<|endoftext|>the <|startoftext|>", ""]
    for text in cases:
        ids = library.encode(text, add_special_tokens=False).ids
        packed = mine.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert mine.decode(packed) == library.decode(ids, skip_special_tokens=False)
    docs = texts_of(spark)
    for r in QUERIES["op5_bpe_automaton"](spark, FOLDER).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    row = spark.createDataFrame([(bytearray(np.array([5, 70000, 49407], "<u4").tobytes()),), (bytearray(),)], "ids binary")
    assert [r[0] for r in row.select(bpe.id_array(F.col("ids"))).collect()] == [[5, 70000, 49407], []]


@pytest.mark.parametrize("name, label", [("op6_counterfactual_toxicity", "toxic"), ("op7_quality_network", "quality")])
def test_classifiers_on_held_out_rows(spark, name, label):
    folder = "/root/testdata/sf0.01"
    scored = QUERIES[name](spark, folder).join(read(spark, folder, "labels"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r[label] for r in scored) / len(scored)
    order = sorted(scored, key=lambda r: r.score)
    ranks = [i for i, r in enumerate(order) if r[label] == 1]
    ones = len(ranks)
    auc = (sum(ranks) - ones * (ones - 1) / 2) / (ones * (len(order) - ones))
    assert right >= 0.9 and auc >= 0.85


def test_swapped_groups_score_alike():
    words = ["women", "men", "idiot", "nice"]
    rng = random.Random(3)
    rows = []
    for i in range(400):
        bad = rng.random() < 0.3
        rows.append(([0] * (rng.random() < (0.9 if bad else 0.1)) + [2] * bad + [3] * (rng.random() < 0.5), float(bad)))
        rows.append(([1] * (rng.random() < 0.3) + [2] * bad, float(bad)))
    plain, even = toxicity.fit(rows, words, evenness=0.0), toxicity.fit(rows, words, evenness=5.0)
    gap = lambda m: abs(m.weights[0] - m.weights[1])
    assert gap(even) < 0.5 * gap(plain) and even.score("you idiot") > 0.7 > even.score("women are here")


def test_swapped_groups_score_alike_with_beginnings(spark, tmp_path):
    index = {w: i for i, w in enumerate(["muslims", "christians", "mus*", "musl*", "chr*", "nice"])}
    assert [sorted(c) for c in toxicity.swaps({"muslims", "music", "nice"}, index) if c] == [[-4, -1, 2, 5]]
    rng = random.Random(4)
    filler = ["".join(rng.choice("bdfgkl") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(1500):
        bad = rng.random() < 0.4
        group = ["muslims"] if rng.random() < (0.8 if bad else 0.1) else ["christians"] if rng.random() < 0.3 else []
        ws = group + ["idiot"] * (bad and rng.random() < 0.8) + rng.sample(filler, 12)
        rng.shuffle(ws)
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(bad)))
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(path)
    model = toxicity.toxicity_model(spark.read.parquet(path), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), evenness=5.0)
    assert model.weights[[model.index[w] for w in ("mus*", "musl*", "muslim*") if w in model.index]].size
    for text in ("{} are here", "a nice day with {} and others", "{} love music"):
        logit = lambda w: math.log(model.score(text.format(w)) / (1 - model.score(text.format(w))))
        scores = [logit(w) for w in ("muslims", "christians", "jews", "buddhists")]
        assert max(scores) - min(scores) < 0.5, (text, scores)
    assert model.score("you idiot") > 0.7 > model.score("muslims are here")


def brute_alignments(docs, items, share, least, masks):
    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    best = {}
    for (i, t), (k, b) in itertools.product(docs, items):
        d, w = words(t), words(b)
        if len(w) < max(least, min(map(len, masks))):
            continue
        for shift in range(-len(w), len(d)):
            same = [0 <= shift + x < len(d) and d[shift + x] == w[x] for x in range(len(w))]
            m = sum(same)
            if m >= max(least, math.ceil(share * len(w))) and any(all(same[p + o] for o, c in enumerate(mask) if c == "1") for mask in masks for p in range(len(w) - len(mask) + 1)):
                best[i, k] = max(m, best.get((i, k), 0))
    return best


@pytest.mark.parametrize("limit", [10**6, 0])
def test_spaced_seeds_against_all_alignments(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", limit)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("klmnop") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 40)))) for i in range(12)]
    docs = []
    for i in range(50):
        ws = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 1, 3, 6])):
            ws[rng.randrange(len(ws))] = word()
        ws = ws[: rng.choice([len(ws), len(ws), len(ws) * 2 // 3])]
        docs.append((i, " ".join([word() for _ in range(rng.randrange(0, 30))] + ws + [word() for _ in range(rng.randrange(0, 30))])))
    path = str(tmp_path / "d")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(path)
    table, tests = spark.read.parquet(path), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_alignments(docs, items, decontaminate.SHARE, decontaminate.LEAST, decontaminate.MASKS)
    got = {(r.doc_id, r.item_id): r.n_match for r in decontaminate.contamination(table, tests).collect()}
    assert got == want and want
    kept = {r.doc_id for r in decontaminate.remove_contaminated(table, tests).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}


def test_spaced_seeds_miss_no_alignment(spark, tmp_path):
    """Against all alignments, without any masks: regular and random substitutions down to the share of equal words."""
    assert all(decontaminate.sure_hits(decontaminate.SHARE, decontaminate.LEAST, decontaminate.MASKS)[decontaminate.LEAST :])
    for n in range(1, 13):
        fewest = min((sum(all(s[p + o] for o, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for p in range(n - len(m) + 1))
                      for s in itertools.product((0, 1), repeat=n) if sum(s) >= max(5, math.ceil(0.6 * n))), default=0)
        assert decontaminate.sure_hits(0.6, 5, decontaminate.MASKS)[n] == fewest
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("klmnop") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([8, 9, 12, 13, 15, 16, 20, 25, 40, 59, 700])]
    docs = []
    for _, text in items:
        n = len(text.split())
        most = n - max(decontaminate.LEAST, math.ceil(decontaminate.SHARE * n))
        gone = [set(range(k, n, 4)) for k in range(4)] + [{x for x in range(n) if x % 5 in k} for k in ((0, 2), (1, 4), (2, 3))]
        gone += [set(rng.sample(range(n), k)) for k in (most, most, most, most + 1)]
        for g in gone:
            ws = [word() if x in g else w for x, w in enumerate(text.split())]
            docs.append((len(docs), " ".join([word() for _ in range(rng.randrange(9))] + ws + [word() for _ in range(rng.randrange(9))])))
    path = str(tmp_path / "d")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(path)
    got = decontaminate.contamination(spark.read.parquet(path), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = brute_alignments(docs, items, decontaminate.SHARE, decontaminate.LEAST, ("1",))
    assert {(r.doc_id, r.item_id): r.n_match for r in got} == want and len(want) > 60


def brute_spans(text):
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in personal_data.EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in personal_data.IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in personal_data.CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in personal_data.PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_personal_data_patterns(spark):
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789..@@ab_-+ ( )é%\n0123") for _ in range(rng.randrange(0, 45)))
        assert personal_data.base_spans(text) == brute_spans(text)
    docs = texts_of(spark)
    for r in QUERIES["op9_bootstrapped_pii"](spark, FOLDER).collect():
        spans = brute_spans(docs[r.doc_id])
        joined = ",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]


def test_contexts_find_unseen_identifiers(spark, tmp_path):
    rows = [(i, f"thanks, please write to user{i}.x@mail.example.com or come by") for i in range(12)]
    rows += [(50 + i, f"thanks, please write to K{i}-998-XQ or come by") for i in range(3)]
    rows += [(80 + i, f"the number of seats is {4000 + i * 37} in that hall") for i in range(20)]
    path = str(tmp_path / "p")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    got = {r.doc_id: r.added for r in personal_data.find_personal_data(spark.read.parquet(path)).collect()}
    for i, text in rows:
        found = [text[s.start : s.end] for s in got[i]]
        assert found == ([f"K{i - 50}-998-XQ"] if 50 <= i < 80 else [])
    clean = {r.doc_id: r.text for r in personal_data.redact(spark.read.parquet(path)).collect()}
    assert clean[3] == "thanks, please write to [email] or come by" and clean[51] == "thanks, please write to [id] or come by" and clean[81] == rows[16][1]


@pytest.mark.parametrize("unit, mark", [("line", "\n"), ("paragraph", "\n\n")])
def test_lines_against_brute_force(spark, tmp_path, unit, mark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcd") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 4))) for _ in range(30)]
    rows = [(i, mark.join(rng.choice(pool) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    path = str(tmp_path / "l")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(path)
    seen, want = set(), {}
    for i, text in rows:
        kept, cut, at = [], [], 0
        for piece in text.split(mark):
            key = " ".join(piece.split()).lower()
            if key and key in seen:
                cut.append((at, at + len(piece)))
            else:
                kept.append(piece)
            if key:
                seen.add(key)
            at += len(piece) + len(mark)
        want[i] = (mark.join(kept), cut, len(text.split(mark)))
    for r in lines.deduplicate(spark.read.parquet(path), unit).collect():
        assert (r.text, [tuple(x) for x in r.removed], r.n_units) == want[r.doc_id] and r.n_removed == len(r.removed)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    ok, message = compare(spark, connect(FOLDER), FOLDER, name, QUERIES[name], ORACLES[name])
    assert ok, message


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = read(spark, FOLDER, "documents")
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, read(spark, FOLDER, "labels")).collect()}
    rows = [(i, t) for i, t in sorted(texts_of(spark).items()) if scores[i] >= 0.5]
    _, _, parent = brute_links([t for _, t in rows])
    rows = [rows[i] for i in sorted(set(parent.values()))]
    items = [(r.item_id, r.text) for r in read(spark, FOLDER, "benchmark").collect()]
    words = {k: set(re.findall(r"\w+", b.lower())) for k, b in items}
    bad = set()
    for i, t in rows:
        near = [(k, b) for k, b in items if len(words[k] & set(re.findall(r"\w+", t.lower()))) >= 0.6 * len(words[k])]
        bad |= {i for i, _ in brute_alignments([(i, t)], near, decontaminate.SHARE, decontaminate.LEAST, decontaminate.MASKS)}
    mine = bpe.tokenizer_of(open(word_bpe(), encoding="utf-8").read())
    want = {}
    for i, t in rows:
        if i not in bad:
            out, at = "", 0
            for s, k, e in brute_spans(t):
                if s >= at:
                    out += t[at:s] + f"[{personal_data.KINDS[k]}]"
                at = max(at, e)
            want[i] = mine.encode(out + t[at:])
    got = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want and bad and len(got) < len(scores)
