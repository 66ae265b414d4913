"""The paths taken by oversized groups must give what the small ones give."""

import datetime
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from placemill.functions import geo
from placemill.functions.text import name_key
from placemill.operators import content, mentions, photos, quality, rank, resolve, select, vector_pairs
from placemill.operators.components import connected_components
from placemill.plans.samples import places_with_tags, sample, table
from placemill.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def merged(places, **options):
    out = resolve.dedupe_places(places, **options)
    return rows_of(out.select("search_id", "id", "segments", "score", "first_ord", "bucket_ord",
                              F.to_json(F.array_sort(F.map_entries("tags"))).alias("t")))


def hot_places(spark, n=160):
    """One name holds most rows: copies, clusters, a landmark among chains, growing tag sets."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        name = "Hot Place" if i % 4 else ("All Chain" if i % 8 else f"Solo {i}")
        tags = {"name": name}
        if name == "All Chain" or rng.random() < 0.5:
            tags["amenity"] = "cafe"
        for key in ("wikidata", "phone", "website", "brand", "cuisine", "stars"):
            if rng.random() < 0.12 + i / 800:
                tags[key] = f"{key}{i}"
        rows.append((1, i, f"node/{i}", name, 10.0 + rng.choice([0, 0, 0.001, 0.002, 0.01]), 20.0 + rng.choice([0, 0.0015, 0.0022]), rng.choice(["node", "way"]), tags))
    return spark.createDataFrame(rows, "search_id bigint, ord bigint, id string, name string, lat double, lon double, osm_type string, tags map<string,string>")


def test_rounds_equal_fold(spark):
    places = hot_places(spark)
    assert merged(places) == merged(places, max_group=10, batch=6)


def test_merge_is_stable_and_whole(spark):
    places = places_with_tags(spark, FOLDER)
    out = resolve.dedupe_places(places)
    assert out.agg(F.sum("segments")).first()[0] == places.count()
    keyed = places.select(name_key(F.col("name")).alias("name_key")).distinct()
    assert keyed.join(out, "name_key", "left_anti").isEmpty()
    again = resolve.dedupe_places(out.drop("segments", "bucket_ord", "first_ord", "name_key", "score"))
    assert again.count() == out.count()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    parent = list(range(120))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = connected_components(spark.createDataFrame(edges, "u bigint, v bigint"))
    assert {(r.node, r.component) for r in got.collect()} == {(x, find(x)) for x in nodes}


def test_numbers_over_spans(spark):
    df = spark.createDataFrame([(i % 3 if i % 2 else 0, (i * 7) % 5, i * 3) for i in range(200)], "k int, s int, ord bigint")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.col("s").desc(), "ord")))
    assert rows_of(rank.number_rows(df, ["k"], ["-s"], "ord", "rn", span=10).select("k", "s", "ord", "rn")) == rows_of(want)


def test_numbers_and_values_over_ranges(spark):
    """A hot key, a null key, ties and a language-aware order, in more ranges than keys."""
    rng = random.Random(6)
    names = ["Éclair", "eclair", "Zebra", "apple", "Ápple", "zebra", ""]
    rows = [(rng.choice([0, 0, 0, 1, None]), i, rng.choice(names), rng.choice([None, 5, 5, rng.randrange(400)])) for i in range(700)]
    df = spark.createDataFrame(rows, "k int, ord bigint, name string, v bigint").repartition(6)
    collated = [F.collate("name", "UNICODE").asc(), F.col("ord").asc()]
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*collated)))
    assert rows_of(rank.number_in_order(df, ["k"], collated).select("k", "ord", "rn")) == rows_of(want.select("k", "ord", "rn"))
    values = {}
    for k, _, _, v in rows:
        if v is not None:
            values.setdefault(k, []).append(v)
    got = {r.k: r.upper_median for r in quality.upper_median(df, ["k"], "v").collect()}
    assert got == {k: sorted(v)[len(v) // 2] for k, v in values.items()}


def test_instances_follow_the_wanted_classes(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(1, 2), (2, 1), (None, 3), (4, None)]
    members = [(i, rng.randrange(70)) for i in range(90)] + [(91, None)]
    classes = [(2, "a"), (5, "a"), (5, "b"), (65, "c"), (None, "d")]
    want = set()
    for root, category in classes:
        below, queue = {root}, [root]
        while queue:
            new = {c for c, p in edges if p == queue[0] and p is not None and c is not None} - below
            queue = queue[1:] + sorted(new)
            below |= new
        want |= {(e, category) for e, t in members if t is not None and t in below}
    frames = [spark.createDataFrame(r, s) for r, s in ((members, "entity_id int, type_id int"), (edges, "child int, parent int"), (classes, "class_id int, category string"))]
    assert {tuple(r) for r in select.instances_of(*frames).collect()} == want and len(want) > 10


def test_top_k_beyond_group_limit(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("k"), F.col("id").alias("ord"))
    got = rank.top_k(df, ["k"], [F.col("ord").desc()], 1500)
    assert got.count() == 3000 and got.agg(F.min("ord")).first()[0] == 3000


def test_carried_and_next_values(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([("a" if rng.random() < 0.7 else "b", i, rng.randrange(9) if rng.random() < 0.2 else None) for i in range(150)], "k string, t bigint, v int")
    w = Window.partitionBy("k").orderBy("t")
    want = df.withColumn("c", F.last("v", ignorenulls=True).over(w)).withColumn("n", F.lead("t").over(w))
    got = rank.last_value_before(df, ["k"], ["t"], F.col("v"), "c", F.floor(F.col("t") / 7))
    got = rank.next_value(got, ["k"], ["t"], "t", "n", F.floor(F.col("t") / 11))
    assert rows_of(got.select("k", "t", "v", "c", "n")) == rows_of(want)


def metres(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.sin(math.radians(b[1] - a[1]) / 2) ** 2 * math.cos(la) * math.cos(lb)
    return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(h)))


def test_photos_near_everywhere(spark):
    """Grid join against brute force: mid latitudes, both sides of the date line, near a pole."""
    rng = random.Random(11)
    spots = [(0.0, 179.999), (60.0, -179.998), (89.995, 10.0), (-45.0, 30.0), (24.8, 67.0)]
    near = lambda s: (max(-90.0, min(90.0, s[0] + rng.uniform(-0.02, 0.02))), (s[1] + rng.uniform(-0.04, 0.04) + 180) % 360 - 180)
    places = [(i, *near(rng.choice(spots))) for i in range(60)]
    shots = [(i, i, *near(rng.choice(spots))) for i in range(150)]
    want = {(p[0], s[0]) for p in places for s in shots if metres(p[1:], s[2:]) <= 1000}
    got = photos.photos_near(spark.createDataFrame(places, "place_id int, lat double, lon double"), spark.createDataFrame(shots, "photo_id int, ord int, lat double, lon double"))
    pairs = [(r.place_id, r.photo_id) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and want


def test_similar_pairs_in_tiles(spark):
    e = table(spark, FOLDER, "embeddings").select(F.lit(1).cast("bigint").alias("search_id"), F.col("vec_id").alias("ord"), F.create_map(F.lit("name"), F.lit("x")).alias("tags"), F.col("embedding").alias("vector"))
    one, many = resolve.similar_pairs(e, 0.3, tile_rows=10_000), resolve.similar_pairs(e, 0.3, tile_rows=40)
    keep = lambda df: rows_of(df.select("ord_a", "ord_b"))
    assert keep(one) == keep(many) and one.count() > 0


@pytest.mark.parametrize("k", [1, 4, 40])
def test_nearest_photos_everywhere(spark, k):
    """Dense and sparse spots, piles at one point, the date line and a pole; few pairs where photos are dense."""
    rng = random.Random(k)
    spots = [(0.0, 179.9999, 0.0004), (60.0, -179.998, 0.004), (89.9995, 10.0, 0.001), (-45.0, 30.0, 0.02), (24.8, 67.0, 0.0001)]
    near = lambda s: (max(-90.0, min(90.0, s[0] + rng.uniform(-1, 1) * s[2])), (s[1] + rng.uniform(-2, 2) * s[2] + 180) % 360 - 180)
    places = [(i, *near(rng.choice(spots))) for i in range(40)]
    shots = [(i, i, *(near(rng.choice(spots)) if i % 3 else (24.8, 67.0))) for i in range(600)]
    want = set()
    for p in places:
        close = sorted((round(d, 3), s[1]) for s in shots if (d := metres(p[1:], s[2:])) <= 1000)
        want |= {(p[0], o, n + 1) for n, (_, o) in enumerate(close[:k])}
    frames = spark.createDataFrame(places, "place_id int, lat double, lon double"), spark.createDataFrame(shots, "photo_id int, ord int, lat double, lon double")
    got = {(r.place_id, r.ord, r.near_rank) for r in photos.nearest_photos(*frames, 1.0, k).collect()}
    assert got == want and want
    radii = photos.search_radii(*frames, 1000, k).collect()
    assert len(radii) == 40 and (k == 40 or min(r.radius for r in radii) < 100)
    assert photos.nearest_photos(frames[0].limit(0), frames[1]).collect() == []


@pytest.mark.parametrize("threshold,tile_rows", [(0.95, 16), (0.95, 1000), (0.8, 20), (-1.0, 30), (1.0, 25)])
def test_near_pairs_against_all_pairs(spark, threshold, tile_rows):
    """Clusters, copies, opposite vectors and vectors without length, over two searches."""
    rng = random.Random(tile_rows)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = []
    for i in range(260):
        v = [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]
        v = rows[-1][2] if i % 11 == 5 else [-x for x in rows[-1][2]] if i % 11 == 7 else [0.0] * 6 if i % 50 == 3 else v
        rows.append((1 if i % 9 else 2, i, v))
    long = {i: math.sqrt(sum(x * x for x in v)) for _, i, v in rows}
    cos = lambda a, b: sum(x * y for x, y in zip(a[2], b[2])) / long[a[1]] / long[b[1]]
    measured = {(a[0], a[1], b[1]): cos(a, b) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and long[a[1]] and long[b[1]]}
    df = spark.createDataFrame(rows, "search_id bigint, ord bigint, vector array<double>")
    found = vector_pairs.near_pairs(df, threshold, tile_rows).collect()
    got = {(r.search_id, r.ord_a, r.ord_b): r.cosine for r in found}
    assert len(got) == len(found) and all(abs(measured[k] - c) < 1e-9 for k, c in got.items())
    assert {k for k, c in measured.items() if c >= threshold + 1e-9} <= set(got) <= {k for k, c in measured.items() if c >= threshold - 1e-9} and got
    placed = vector_pairs.placed_rows(df, threshold, tile_rows)
    share = {r.search_id: r.compared / r.pairs for r in vector_pairs.compared_pairs(placed, threshold).collect()}
    assert share[1] < 0.5 if threshold == 0.95 and tile_rows == 16 else share[1] <= 1


def test_semantic_fold_with_many_copies(spark):
    """Rows equally rich: each joins the first kept one that is near; a third of all rows share one vector."""
    rng = random.Random(21)
    vectors = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(12)]
    rows = [(1, i, f"n{i}", vectors[0] if i % 3 == 1 else [c + rng.gauss(0, 0.2) for c in rng.choice(vectors)] if i % 7 else None) for i in range(150)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    kept = []
    for _, i, _, v in rows:
        near = [k for k in kept if v and k[1] and cos(k[1], v) >= 0.9]
        if near:
            near[0][2] += 1
        else:
            kept.append([i, v, 1])
    df = spark.createDataFrame([(s, i, "node", {"name": n}, v) for s, i, n, v in rows], "search_id bigint, ord bigint, osm_type string, tags map<string,string>, vector array<double>")
    got = resolve.semantic_dedupe(df, 0.9, tile_rows=20)
    assert sorted((r.ord, r.merged) for r in got.collect()) == sorted((i, n) for i, _, n in kept)


def test_mentions_by_short_and_long_edges(spark):
    docs = spark.createDataFrame([(1, "The Old Art Gallery and smart gallery park"), (2, "x"), (3, "ÉCOLE park")], "doc_id bigint, text string")
    places = spark.createDataFrame([(1, "art gallery"), (2, "PARK"), (3, "école"), (4, "zz"), (5, "the old art gallery and smart")], "place_id bigint, name string")
    both = [rows_of(content.excerpts(docs, places, n).select("doc_id", "place_id", "excerpt")) for n in (6, 1)]
    assert both[0] == both[1] and len(both[0]) == 5


def test_mentions_against_brute_force(spark):
    """Names of several words, inside words, with common and missing words, double blanks, other scripts."""
    rng = random.Random(4)
    parts = ["a", "of", "bay", "baya", "ayb", "the", "éco", "北京", "北京市", "x-y", "★★★", "bay,", "\U0001f642z"]
    blank = lambda: rng.choice([" ", " ", " ", "  ", "\n", ""])
    texts = [(i, "".join(rng.choice(parts) + blank() for _ in range(rng.randrange(12)))) for i in range(80)] + [(80, None), (81, ""), (82, "bay" * 3000)]
    names = {"".join(rng.choice(parts) + rng.choice([" ", " ", "  ", ""]) for _ in range(rng.randrange(1, 5))).strip().lower() for _ in range(150)}
    names = sorted(n for n in names if len(n) >= 3) + ["nowhere", "the nowhere"]
    want = sorted((i, n) for i, t in texts for n in names if t and n in t.lower())
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    needles = spark.createDataFrame([(n,) for n in names], "needle string")
    for edge in (1, 6):
        got = sorted((r.doc_id, r.needle) for r in mentions.mentions(docs, needles, edge).collect())
        assert got == want and len(want) > 200
    assert mentions.mentions(docs.limit(0), needles).collect() == [] and mentions.mentions(docs, needles.limit(0)).collect() == []


def test_claims_stream_in_batches_and_restart(spark, tmp_path):
    source, claims, checkpoint = (str(tmp_path / d) for d in ("in", "claims", "cp"))
    found = sample(spark, FOLDER, "claims").cache()
    shape = "place_id bigint, region_ord bigint"
    for low in (0, 4, 8):
        part = found.where(F.col("region_ord").between(low, low + 3) | ((F.lit(low) == 8) & (F.col("region_ord") > 11)))
        part.select("place_id", "region_ord").coalesce(1).write.mode("append").parquet(source)
        jobs.run_available(jobs.resolve_stream(spark.readStream.schema(shape).parquet(source), claims, checkpoint))
    got = jobs.read_claims(spark, claims)
    want = resolve.claim_across_regions(found)
    assert rows_of(got.select("place_id", "region_ord")) == rows_of(want.select("place_id", "region_ord"))


@pytest.mark.parametrize("files", [1, 4])
def test_requests_pass_again_after_their_time(spark, tmp_path, files):
    """Repeats inside and outside the time to live, in one micro-batch or in several."""
    rng = random.Random(2)
    start = datetime.datetime(2026, 1, 1)
    times = sorted((start + datetime.timedelta(minutes=rng.randrange(0, 5000)), rng.choice("abc")) for _ in range(120))
    want, last = [], {}
    for ts, key in times:
        if key not in last or ts - last[key] >= datetime.timedelta(hours=6):
            want.append((key, ts))
            last[key] = ts
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(files):
        part = times[n * len(times) // files : (n + 1) * len(times) // files]
        spark.createDataFrame([(k, t) for t, k in part], "cache_key string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        passed = jobs.dedupe_requests(spark.readStream.schema(jobs.PASSED).parquet(source))
        jobs.run_available(passed.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")))
    got = [(r.cache_key, r.ts) for r in spark.read.schema(jobs.PASSED).parquet(out).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20


def stages_run(spark, source, out, checkpoint, rows, n):
    shape = "id string, ts timestamp, ord bigint, stage string"
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
    live = jobs.latest_stage(spark.readStream.schema(shape).parquet(source))
    sink = live.writeStream.outputMode("update").foreachBatch(lambda df, b: df.write.mode("overwrite").parquet(f"{out}/run={n}/batch_id={b}"))
    jobs.run_available(sink.option("checkpointLocation", checkpoint))
    emitted = {(r.id, r.ord, r.stage) for r in spark.read.schema(jobs.STAGE).parquet(f"{out}/run={n}/batch_id=*").collect()}
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "live").load()
    return emitted, {r.key.id: r.value.stage for r in state.select("key", "value").collect()}


def test_finished_stages_are_forgotten_after_a_minute_and_a_restart_goes_on(spark, tmp_path):
    at = lambda m, s=0: datetime.datetime(2026, 1, 1, 10, m, s)
    paths = [str(tmp_path / d) for d in ("in", "out", "cp")]
    emitted, state = stages_run(spark, *paths, [("a", at(0), 1, "starting"), ("a", at(1), 2, "done"), ("b", at(1), 3, "filtering"), ("c", at(1), 9, "failed")], 0)
    assert emitted == {("a", 2, "done"), ("b", 3, "filtering"), ("c", 9, "failed")} and state == {"a": "done", "b": "filtering", "c": "failed"}
    # c goes on before its minute is over; the watermark then passes a's minute.
    emitted, _ = stages_run(spark, *paths, [("c", at(1, 30), 10, "starting"), ("b", at(0), 1, "starting"), ("d", at(13), 4, "starting")], 1)
    assert emitted == {("c", 10, "starting"), ("b", 3, "filtering"), ("d", 4, "starting")}
    emitted, state = stages_run(spark, *paths, [("d", at(14), 5, "done")], 2)
    assert emitted == {("d", 5, "done")} and state == {"b": "filtering", "c": "starting", "d": "done"}


def test_counters_take_old_statuses_back(spark, tmp_path):
    """Several micro-batches and a restart, statuses that go back and forth, late rows, regions without a count."""
    rng = random.Random(8)
    start = datetime.datetime(2026, 1, 1)
    rows = [(rng.randrange(9), start + datetime.timedelta(hours=rng.randrange(60)), rng.choice(["searching", "done", "failed", "skipped"]), rng.choice([None, 0, 3, 7])) for _ in range(150)]
    source, counters, checkpoint = (str(tmp_path / d) for d in ("in", "counters", "cp"))
    for low in (0, 50, 100):
        spark.createDataFrame(rows[low : low + 50], jobs.CHANGES).repartition(2).write.mode("append").parquet(source)
        changes = spark.readStream.schema(jobs.CHANGES).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.run_available(jobs.job_counters(changes, counters, checkpoint))
        newest = {}
        for region, ts, status, n in rows[: low + 50]:
            newest[region] = max(newest.get(region, (start, "", -2)), (ts, status, -1 if n is None else n))
        want = (len(newest), sum(s in ("done", "failed", "skipped") for _, s, _ in newest.values()), sum(s == "failed" for _, s, _ in newest.values()), sum(max(0, n) for _, _, n in newest.values()))
        got = jobs.read_counters(spark, counters).orderBy(F.col("batch_id").desc()).first()
        assert tuple(got)[:4] == want and got.batch_id >= low // 50 + 1
