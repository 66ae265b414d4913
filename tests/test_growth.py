"""Work that must follow the rows, not their square or the size of a plan."""

import math
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from placemill.functions import geo, responses as rs, text
from placemill.operators import content, mentions, photos, resolve, responses, select, vector_fold
from placemill.plans import queries_jobs, queries_places  # noqa: F401
from placemill.plans.registry import QUERIES
from placemill.session import shared_folder
from placemill.streaming import jobs


def metres(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.sin(math.radians(b[1] - a[1]) / 2) ** 2 * math.cos(la) * math.cos(lb)
    return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(h)))


def positions(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} bigint, ord bigint, lat double, lon double")


def plan_size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_search_radii_plan_does_not_grow_with_levels(spark):
    frames = positions(spark, [(1, 1, 24.8, 67.0)], "place_id"), positions(spark, [(1, 1, 24.8, 67.0)], "photo_id")
    few, many = (plan_size(photos.search_radii(*frames, 1000, 5, levels)) for levels in (2, 9))
    assert many < 1.5 * few


def test_nearest_photos_of_places_at_one_spot(spark):
    """Each place of a spot gets the spot's photos, and a place at two spots the nearest from both."""
    places = [(i, i, 24.8, 67.0 + (i % 2) * 0.001) for i in range(20)] + [(3, 3, 24.805, 67.0)]
    shots = [(i, i, 24.8 + i * 0.0007, 67.0) for i in range(12)]
    want = set()
    for place in {p[0] for p in places}:
        close = sorted((round(d, 3), s[1]) for p in places if p[0] == place for s in shots if (d := metres(p[2:], s[2:])) <= 1000)
        want |= {(place, o, n + 1) for n, (_, o) in enumerate(close[:4])}
    got = photos.nearest_photos(positions(spark, places, "place_id"), positions(spark, shots, "photo_id"), 1.0, 4)
    assert {(r.place_id, r.ord, r.near_rank) for r in got.collect()} == want


def test_photo_totals_count_spots_once(spark):
    """10,000 places on one spot and 10,000 photos on another are one pair; totals equal brute force."""
    rng = random.Random(5)
    places = [(i, i, 24.8 + rng.randrange(4) * 0.004, 67.0) for i in range(30)]
    shots = [(i, i, 24.8 + rng.randrange(5) * 0.005, 67.0 + rng.randrange(2) * 0.003) for i in range(200)]
    want = {}
    for p in places:
        near = [(s[0], d) for s in shots if (d := metres(p[2:], s[2:])) <= 1000]
        want[p[0]] = (len(near), sum(i for i, _ in near), round(sum(d for _, d in near), 3))
    got = photos.photo_totals(positions(spark, places, "place_id"), positions(spark, shots, "photo_id")).collect()
    assert {r.place_id: (r.n, r.photo_ids, round(r.metres, 3)) for r in got} == want
    pile = lambda name, lat: spark.range(10_000).select(F.col("id").alias(name), F.col("id").alias("ord"), F.lit(lat).alias("lat"), F.lit(67.0).alias("lon"))
    big = photos.photo_totals(pile("place_id", 24.8), pile("photo_id", 24.801))
    assert big.agg(F.count(F.lit(1)), F.min("n"), F.max("n")).first() == (10_000, 10_000, 10_000)


@pytest.mark.parametrize("max_group,batch", [(20_000, 500), (2, 3)])
def test_semantic_fold_along_pairs(spark, max_group, batch):
    """One slice or many: faces, first rows, counts and tags of a plain fold over all records, where richer rows replace vectors."""
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(5)]
    kinds = ["wikidata", "wikipedia", "website", "phone", "description", "note", "fax"]
    rows = []
    for i in range(160):
        tags = {k: rng.choice(["", f"{k}{i}", f"{k}{i}"]) for k in rng.sample(kinds, rng.randrange(len(kinds)))}
        vector = rng.choice(rows)[4] if rows and i % 5 == 0 else [c + rng.gauss(0, 0.35) for c in rng.choice(centres)]
        rows.append((i % 2, i, rng.choice(["node", "way", None]), tags | {"name": f"n{i}"}, vector))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    gain = [(("wikidata",), 8), (("wikipedia",), 6), (("website",), 4), (("phone",), 4), (("description",), 3)]
    score = lambda t, kind: len(t) + sum(n for keys, n in gain if any(t.get(k) for k in keys)) + (kind == "way")
    kept = []
    for s, i, kind, tags, v in rows:
        old = next((k for k in kept if k["s"] == s and cos(k["v"], v) >= 0.9), None)
        if old is None:
            kept.append({"s": s, "ord": i, "first": i, "n": 1, "v": v, "kind": kind, "tags": tags})
            continue
        old["n"] += 1
        if score(tags, kind) > score(old["tags"], old["kind"]):
            old |= {"ord": i, "v": v, "kind": kind, "tags": old["tags"] | tags}
        else:
            old["tags"] = tags | old["tags"]
    df = spark.createDataFrame(rows, "search_id bigint, ord bigint, osm_type string, tags map<string,string>, vector array<double>")
    got = resolve.semantic_dedupe(df, 0.9, max_group=max_group, batch=batch).collect()
    plain = lambda *r: (*r[:-1], tuple(sorted(r[-1].items())))
    assert sorted(plain(r.search_id, r.ord, r.first_ord, r.merged, r.tags) for r in got) == sorted(plain(k["s"], k["ord"], k["first"], k["n"], k["tags"]) for k in kept)
    assert 20 < len(kept) < 150 and any(k["ord"] != k["first"] for k in kept)


def test_slices_double(spark):
    """The rounds of a large set grow with the logarithm of its rows, not with rows over the batch."""
    rows = spark.range(2000).select(F.lit(1).alias("search_id"), F.lit(7).alias("component"), F.col("id").alias("ord"))
    sizes = [r.n for r in vector_fold.sliced(rows, 2, 4, most=256).groupBy("slice").agg(F.count(F.lit(1)).alias("n")).orderBy("slice").collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 256 and len(sizes) <= 14


def test_records_meet_python_once(spark):
    """One Python step a row however often the records are used; repeated keys, broken arrays and loose objects as before."""
    raws = ['[{"i":1,"i":2,"keep":true}]', 'x [{"i":1}', '{"i":3} and {"i":4,"i":5} {bad}', '[{"i":0}]', "none", None, '[{"i":7}, {"i":8}] {"i":9']
    want = [[2], [1], [3, 5], [0], None, None, [7, 8]]
    df = spark.createDataFrame(list(enumerate(raws)), "n int, raw string").withColumn("v", rs.parse_records(F.col("raw")))
    got = df.select("n", F.transform("v", lambda v: F.try_variant_get(v, "$.i", "bigint")).alias("i")).orderBy("n").collect()
    assert [r.i or None for r in got] == want
    rows = responses.completions_to_records(spark.createDataFrame([(1, raws[0])], "batch_id int, raw string"), ["batch_id"])
    assert rows.select("r.keep", "r.i")._jdf.queryExecution().optimizedPlan().toString().count("EvalPython") == 1
    wide = text.unicode_norm(F.concat("raw", F.lit("é")), "NFC")
    twice = df.select("raw").select(F.md5(wide), F.length(wide))
    assert twice.count() == len(raws) and df.select(text.unicode_norm(F.lit("é"), "NFC").alias("c")).first().c == "é"


def test_job_counters_write_files_by_input_size(spark):
    """The changes are dealt to more tasks where the input has more splits, in three micro-batches."""
    folder = "/root/testdata/sf0.01"
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        before = set(pathlib.Path(shared_folder(spark).removeprefix("file:")).glob("changes-*"))
        QUERIES["j4_job_counters"](spark, folder).collect()
        made = set(pathlib.Path(shared_folder(spark).removeprefix("file:")).glob("changes-*")) - before
        assert len(list(made.pop().glob("part-*.parquet"))) > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_excerpt_windows_lower_a_text_once(spark):
    """Windows of a plain search, and one lower-case copy of a text however many windows are shown."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Art", "ART  gallery", "étage", "\U0001f642", "x\n", "word" * rng.randrange(1, 90)]) for _ in range(rng.randrange(60))) for _ in range(60)]

    def windows(t, needle):
        out, begin, low = [], 0, t.lower()
        while len(out) < 3 and (at := low.find(needle, begin)) >= 0:
            begin = min(at + len(needle) + 350, len(t))
            out.append(re.sub(r"[\s\xa0]+", " ", t[max(at - 350, 0):begin]).strip(" "))
        return out

    df = spark.createDataFrame([(i, t, n) for i, t in enumerate(texts) for n in ("art", "art  gallery", "étage", "zz")], "id int, text string, needle string")
    shown = df.select("id", "needle", content.excerpt_windows(F.col("text"), F.col("needle")).alias("w"))
    got = {(r.id, r.needle): r.w for r in shown.collect()}
    assert got == {(i, n): windows(t, n) for i, t in enumerate(texts) for n in ("art", "art  gallery", "étage", "zz")}
    assert max(map(len, got.values())) == 3
    assert shown._jdf.queryExecution().analyzed().toString().count("lower(") == 1


def test_words_meet_names_without_a_lambda_per_word(spark):
    """Runs and edges of the vocabulary are plain rows; a run that a word holds twice matches once."""
    vocabulary = spark.createDataFrame([("papapapa", 3), ("spa", 2), ("\U0001f642pap", 1), ("xy", 9)], "word string, texts bigint")
    wanted = spark.createDataFrame([("inside", "papa"), ("inside", "pap"), ("begins", "sp"), ("ends", "papa"), ("whole", "xy")], "kind string, token string")
    matched = mentions.matching_words(vocabulary, wanted)
    assert sorted((r.kind, r.token, r.word, r.texts) for r in matched.collect()) == sorted([
        ("inside", "papa", "papapapa", 3), ("inside", "pap", "papapapa", 3), ("inside", "pap", "\U0001f642pap", 1),
        ("begins", "sp", "spa", 2), ("ends", "papa", "papapapa", 3), ("whole", "xy", "xy", 9),
    ])
    assert "lambda" not in matched._jdf.queryExecution().optimizedPlan().toString()


def test_claims_are_kept_by_the_aggregate(spark, tmp_path):
    """No Python per place; a claim stands when a later micro-batch finds the place in a smaller region, missing ids as in the batch twin."""
    source, claims, checkpoint = (str(tmp_path / d) for d in ("in", "claims", "cp"))
    shape = "place_id bigint, region_ord bigint"
    stream = lambda: spark.readStream.schema(shape).parquet(source)
    batches = [[(1, 5), (1, 4), (2, 9), (None, 8), (None, 3)], [(1, 2), (3, 6), (None, 1)], [(1, 1), (2, 1), (3, 1)]]
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
        jobs.run_available(jobs.resolve_stream(stream(), claims, checkpoint))
    assert {tuple(r) for r in jobs.read_claims(spark, claims).collect()} == {(1, 4), (2, 9), (3, 6), (None, 3)}
    assert jobs.read_claims(spark, claims).count() == 4
    assert "Pandas" not in jobs.first_claims(stream())._jdf.queryExecution().logical().toString()


def test_closure_sends_no_edges_through_the_driver(spark, monkeypatch):
    """No step is broadcast, however small; a chain with a short cut and a cycle has its shortest depths."""
    steps, cut = [], select.cut
    monkeypatch.setattr(select, "cut", lambda df: (steps.append(df), cut(df))[1])
    pairs = [(i, i + 1) for i in range(6)] + [(0, 3), (6, 4), (None, 1), (2, None), (2, 3)]
    got = select.subclass_closure(spark.createDataFrame(pairs, "child bigint, parent bigint")).collect()
    up, want = {}, {}
    for c, p in pairs:
        if c is not None and p is not None:
            up.setdefault(c, set()).add(p)
    for c in up:
        level, depth = up[c], 1
        while level:
            want |= {(c, a): depth for a in level}
            level, depth = {p for a in level for p in up.get(a, ()) if (c, p) not in want}, depth + 1
    assert len(got) == len(want) and {(r.child, r.ancestor): r.depth for r in got} == want
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in steps]
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_search_stats_fold_once(spark):
    """The counts read the stored places, so the fold is in no plan that is left."""
    stats = QUERIES["e1_search_stats"](spark, "/root/testdata/sf0.001")
    assert "collect_list" not in stats._jdf.queryExecution().optimizedPlan().toString()


def test_merge_needs_no_round_per_replaced_record(spark):
    """Each row is richer than the record it joins; the jobs do not follow the rows."""
    rows = [(1, i, f"node/{i}", "Long Hall", 10.0, 20.0, "node", {f"k{j}": str(i) for j in range(i + 1)}) for i in range(14)]
    places = spark.createDataFrame(rows, "search_id bigint, ord bigint, id string, name string, lat double, lon double, osm_type string, tags map<string,string>")
    spark.sparkContext.setJobGroup("long-hall", "merge")
    try:
        got = resolve.dedupe_places(places, max_group=5, batch=2).collect()
        jobs_run = spark.sparkContext.statusTracker().getJobIdsForGroup("long-hall")
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert [(r.ord, r.first_ord, r.bucket_ord, r.segments, len(r.tags)) for r in got] == [(13, 0, 0, 14, 15)]
    assert len(jobs_run) < 12


@pytest.mark.parametrize("batch", [10_000, 7])
def test_merge_along_the_stream(spark, batch):
    """Records of a plain fold: chains at the pole, on the date line and beyond 180 degrees, places unknown, records that move and turn from chain to landmark."""
    rng = random.Random(11)
    spots = [(89.9995, 10.0), (89.9995, -170.0), (10.0, 179.9995), (10.0, -179.9995), (10.0, 180.0005), (10.0, 540.001), (10.001, 20.0), (10.002, 20.0), (10.004, 20.0), (10.006, 20.001), (None, 20.0), (10.0, None)]
    kinds = ["wikidata", "wikipedia", "contact:website", "phone", "description", "addr:street", "note", "fax"]
    rows = []
    for i in range(400):
        name = rng.choice(["Hall A", "hall-a", "Hall B", "Hall C", None])
        tags = {k: rng.choice(["", f"{k}{i}"]) for k in rng.sample(kinds, rng.choice([0, 1, 2, 2, 5]))}
        if name == "Hall B" or rng.random() < 0.6:
            tags["amenity"] = rng.choice(["cafe", "bank"]) if name == "Hall B" else rng.choice(["cafe", "bank", "museum"])
        if rng.random() < 0.1:
            tags[rng.choice(["brand", "operator"])] = rng.choice(["", "Acme"])
        lat, lon = rng.choice(spots)
        rows.append((rng.choice([1, 2, None]), i, f"node/{i}", name, lat, lon, rng.choice(["node", "way", None]), tags))
    rows += [r for r in rows if r[1] % 9 == 0]
    gain = [(("wikidata",), 8), (("wikipedia",), 6), (("website", "contact:website"), 4), (("phone", "contact:phone"), 4), (("description",), 3), (("addr:street",), 2)]
    score = lambda t, kind: len(t) + sum(n for keys, n in gain if any(t.get(k) for k in keys)) + (kind == "way")
    chain = lambda t: bool(t.get("brand") or t.get("operator")) or t.get("amenity") in ("cafe", "bank")
    near = lambda a, b: None not in (*a, *b) and metres(a, b) < 250
    kept, turned = {}, 0
    for s, i, _, name, lat, lon, kind, tags in sorted(rows, key=lambda r: r[1]):
        here = kept.setdefault((s, name and re.sub("[^a-z0-9]", "", name.lower())), [])
        old = next((k for k in here if not (chain(tags) or chain(k["tags"])) or near(k["at"], (lat, lon))), None)
        if old is None:
            here.append({"ord": i, "first": i, "n": 1, "at": (lat, lon), "kind": kind, "tags": tags})
            continue
        was = chain(old["tags"])
        old["n"] += 1
        if score(tags, kind) > score(old["tags"], old["kind"]):
            old |= {"ord": i, "at": (lat, lon), "kind": kind, "tags": old["tags"] | tags}
        else:
            old["tags"] = tags | old["tags"]
        turned += was != chain(old["tags"])
    want = [(s, name, here[0]["first"], k["ord"], k["first"], k["n"], k["at"], k["kind"], k["tags"] | ({"x:segments": str(k["n"])} if k["n"] > 1 else {})) for (s, name), here in kept.items() for k in here]
    df = spark.createDataFrame(rows, "search_id bigint, ord bigint, id string, name string, lat double, lon double, osm_type string, tags map<string,string>")
    got = resolve.dedupe_places(df, batch=batch).collect()
    plain = lambda *r: repr((*r[:-1], sorted(r[-1].items())))
    assert sorted(plain(r.search_id, r.name_key, r.bucket_ord, r.ord, r.first_ord, r.segments, (r.lat, r.lon), r.osm_type, r.tags) for r in got) == sorted(plain(*w) for w in want)
    assert all(r.score == score(r.tags, r.osm_type) for r in got) and len(want) > 40 and turned > 3
