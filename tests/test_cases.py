"""Literal cases: hours claims, response texts, articles, links, sheets."""

import json

import pytest
from pyspark.sql import functions as F

from placemill import dims
from placemill.functions import hours as hr, responses as rs, tags as tg, text as tx
from placemill.operators import links
from placemill.operators.content import apply_english_names
from placemill.operators.export import export_manifest
from placemill.operators.responses import translations
from placemill.sources.readers import locate_columns, read_targets_sheet

HOURS = [
    ("A lighthouse on the western pier. Open Wednesday to Sunday from 11:30 to 15:45.", "Mo-Tu 11:30-15:45", "A lighthouse on the western pier."),
    ("The old mill grinds flour. Open Saturday to Sunday.", None, "The old mill grinds flour."),
    ("Glassworks with a shop. Open daily from 07:15 to 12:40.", "07:15-12:40", "Glassworks with a shop. Open daily from 07:15 to 12:40."),
    ("A reading room. Open Tuesday to Thursday from 13:00 to 18:30.", "Tu-Th 13:00-18:30", "A reading room. Open Tuesday to Thursday from 13:00 to 18:30."),
    ("A reading room. Open Tuesday to Thursday from 13:00 to 18:35.", "Tu-Th 13:00-18:30", "A reading room."),
    ("Meadows beside an open river bend.", None, "Meadows beside an open river bend."),
]


def test_hours_claims(spark):
    df = spark.createDataFrame(HOURS, "s string, tag string, want string")
    got = df.select(hr.strip_unsupported_hours(F.col("s"), F.col("tag"))["kept"].alias("kept"), "want").collect()
    assert [r.kept for r in got] == [r.want for r in got]


def test_day_sets(spark):
    tags = [("24/7", 127), ("Th-Tu 10:00-17:00", 123), ("Mo,We,Fr 09:00", 21), (" ", None), (None, None), ("10:00-23:00", 127)]
    df = spark.createDataFrame(tags, "tag string, want int").select(hr.days_covered(F.col("tag")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())
    text = spark.createDataFrame([("Open weekends only",)], "t string").select(hr.days_claimed(F.col("t")).alias("m"))
    assert text.first().m == 96


RAW = [
    ('<reasoning>first {"x":[]} then stop</reasoning>\n{"history":"a quay"}', '{"history":"a quay"}'),
    ('<thinking>never closed {"x":2}', ""), ('{"k":[3]}</reasoning>', '{"k":[3]}'), ('```\n[{"i":4}]\n```', '[{"i":4}]'), (None, ""),
]


def test_clean_completion(spark):
    got = spark.createDataFrame(RAW, "raw string, want string").select(rs.clean_completion(F.col("raw")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


OBJECTS = [
    ('{"highlights":["a", // one\n"b"]}', {"highlights": ["a", "b"]}),
    ('{"link":"https://example.com/x"} // note', {"link": "https://example.com/x"}),
    ('{"overview":"done","history":"cut off in the mid', {"overview": "done"}),
    ('{"a":"x",}', {"a": "x"}), ("nothing here", None), ('{"a":1,"a":{"b":2,"b":3}}', {"a": {"b": 3}}), ('```json\n{"a":[1,2,],}\n```', {"a": [1, 2]}),
]


def test_parse_object(spark):
    df = spark.createDataFrame([(r,) for r, _ in OBJECTS], "raw string").select(F.to_json(rs.parse_object(F.col("raw"))).alias("o"))
    assert [json.loads(r.o) if r.o else None for r in df.collect()] == [w for _, w in OBJECTS]


def test_records_with_repeated_keys(spark):
    raw = '[{"i":1,"keep":false,"keep":true,"name":"Old Quay","score":70}] and {"i":2,"i":3,"keep":true,"name":"Weir"}'
    cases = [(raw[: raw.index(" and")],), (raw[raw.index("{", 60) :],)]
    rows = spark.createDataFrame(cases, "raw string").select(rs.valid_records(F.col("raw")).alias("r")).collect()
    assert [(x.i, x.keep, x.name) for r in rows for x in r.r] == [(1, True, "Old Quay"), (3, True, "Weir")]


def test_prose_and_bullets():
    assert rs.prose([{"year": 1851, "event": "founded"}, "x"]) == "Year: 1851. Event: founded x"
    assert rs.prose({"opening_hours": "9-5", "bestTime": True}) == "Opening hours: 9-5. Best Time: true"
    assert rs.prose(None) == "" and rs.prose(2.0) == "2"


def test_bullets(spark):
    rows = [('["one hall","ab",{"view":"sea"}]', ["one hall", "View: sea"]), ('"aaa; bbb; ccc"', ["aaa", "bbb", "ccc"]), ('"- first. Second one"', ["first.", "Second one"])]
    df = spark.createDataFrame([(r,) for r, _ in rows], "j string").select(rs.to_bullets(F.col("j")).alias("b"))
    assert [r.b for r in df.collect()] == [w for _, w in rows]


def test_balanced_objects():
    assert rs.balanced_objects('x {"a":"}"} {bad} {"b":{"c":1}} } {"d":1}') == ['{"a":"}"}', '{"b":{"c":1}}', '{"d":1}']
    assert rs.balanced_objects('{"a": NaN}') == []


@pytest.mark.parametrize("code, regional", [("PK", False), ("cn", True), ("HK", True), (None, False)])
def test_travel_links(spark, code, regional):
    df = spark.createDataFrame([(1, "Bell & Tower", "Xi'an", code)], "ord int, name string, city string, country_code string")
    rows = {r.id: r for r in links.travel_links(df, [p[0] for p in dims.PROVIDERS]).collect()}
    assert ("chinahighlights" in rows) == regional and ("travelchina" in rows) == regional
    assert rows["viator"].url.endswith("text=Bell%20%26%20Tower%20Xi'an")
    assert not regional or rows["travelchina"].generic


def test_travel_links_need_a_name(spark):
    df = spark.createDataFrame([(1, "", "", "PK")], "ord int, name string, city string, country_code string")
    assert links.travel_links(df).count() == 0


def test_affiliate_tag(spark):
    df = spark.createDataFrame([(1, "A", "B", "PK")], "ord int, name string, city string, country_code string")
    assert links.travel_links(df, ["viator"], {"viator": "pid=P1"}).first().url.endswith("text=A%20B&pid=P1")


def test_sheet(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text('Country,City,Province/State,Attributes,Save folder,Notes\r\nPakistan,"Kara\nchi",,museums,/out,"see ""x"", https://a.example/b)."\r\n,,Punjab,,,\r\n,,,,,\r\n')
    rows = sorted(read_targets_sheet(spark, str(path)).collect(), key=lambda r: r.ord)
    assert [(r.country, r.city, r.province, r.attributes, r.path) for r in rows] == [
        ("Pakistan", "Kara\nchi", None, "museums", "/out"), (None, None, "Punjab", None, None)]
    assert 'see "x", https://a.example/b).' in rows[0].cells


def test_sheet_wider_than_its_header(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("Country,City\nPakistan,Karachi,see https://a.example/x,more\n\nCountry,City\nPeru,Lima\n")
    rows = sorted(read_targets_sheet(spark, str(path)).collect(), key=lambda r: r.ord)
    assert [(r.country, r.city, r.cells) for r in rows] == [
        ("Pakistan", "Karachi", ["Pakistan", "see https://a.example/x", "more"]), ("Country", "City", ["Country"]), ("Peru", "Lima", ["Peru"])]


def test_plain_numbers(spark):
    got = spark.createDataFrame([(24.0,), (1e-4,), (-0.5,), (-67.25,), (1.5e-7,), (180.0,)], "x double").select(tg.plain_number(F.col("x")).alias("n")).collect()
    assert [r.n for r in got] == ["24", "0.0001", "-0.5", "-67.25", "0.00000015", "180"]


def test_cut_city_is_noted(spark):
    places = spark.createDataFrame([("PK", "A", i, i, i, f"P{i}") for i in range(5)] + [("PK", "B", 0, 0, 0, "P0")], "country string, city string, ord int, place_id int, osm_id int, name string")
    photos = spark.createDataFrame([(0, i, f"https://upload.wikimedia.org/f{i}.jpg") for i in range(3)], "place_id int, ord int, url string")
    rows = export_manifest(places, photos, max_places=4).collect()
    assert [(r.city_dir, r.path, r.note) for r in rows if r.note or r.kind == "note"] == [("A", None, "Only the first 4 of 5 places were included.")]
    names = {city: sorted(r.path[-7:-5] for r in rows if r.kind == "picture" and r.city_dir == city) for city in "AB"}
    assert names == {"A": ["01", "02", "03"], "B": ["01", "02", "03"]}


def test_cities_of_one_folder_share_its_names_and_bound(spark):
    places = spark.createDataFrame([("PK", "A/B", 0, 0, 0, "Fort"), ("PK", "A B", 1, 1, 1, "Fort"), ("PK", "A B", 2, 2, 2, "fort")], "country string, city string, ord int, place_id int, osm_id int, name string")
    photos = spark.createDataFrame([], "place_id int, ord int, url string")
    rows = export_manifest(places, photos, max_places=2).collect()
    paths = sorted(r.path for r in rows if r.kind == "document")
    assert len({r.city_dir for r in rows}) == 1 and len(paths) == 2 and "Fort (2)" in paths[0] and sum(r.kind == "summary" for r in rows) == 1
    assert [r.note for r in rows if r.kind == "note"] == ["Only the first 2 of 3 places were included."]


def test_sheet_without_header(spark, tmp_path):
    path = tmp_path / "plain.csv"
    path.write_text("France,Paris\nItaly,Rome\n")
    rows = read_targets_sheet(spark, str(path)).collect()
    assert {(r.country, r.city, r.has_header) for r in rows} == {("France", "Paris", False), ("Italy", "Rome", False)}
    assert locate_columns(["home country", "country", "city"])["country"] == 1


def test_html_and_names(spark):
    one = spark.range(1)
    html = F.lit("<p>Fish &amp; chips<script>x</script></p><!-- n --><b>now</b>")
    assert one.select(tx.strip_html(html)).first()[0] == "Fish & chips now"
    assert one.select(tx.is_mostly_non_latin(F.lit("北京 Bell"))).first()[0] is True
    assert one.select(tg.format_time(F.lit("-0044-03-15T00:00:00Z"))).first()[0] == "44-03-15 BC"
    assert one.select(tx.sanitize_path_segment(F.lit("../../etc/passwd"))).first()[0] == "etc passwd"


def test_stored_translations(spark):
    """Repeats within a batch drop out; numbers outside it answer nothing and repeat nothing."""
    raw = "1. Old Tower\n2. River Gate\n3) river gate\n9. Old Tower\n4. North Hall"
    rows = spark.createDataFrame([(1, raw)], "batch_id int, raw string")
    sizes = spark.createDataFrame([(1, 4)], "batch_id int, batch_size int")
    got = {r.number: r.name for r in translations(rows, ["batch_id"], sizes).collect()}
    assert got == {1: "Old Tower", 4: "North Hall"}


def test_names_from_labels_then_answers(spark):
    places = spark.createDataFrame(
        [(1, 1, "塔塔", {"wikidata": "Q1"}), (1, 2, "塔塔", {"wikidata": "Q2"}), (1, 3, "塔塔", {}), (1, 4, "Plain", {"wikidata": "Q1"})],
        "search_id int, ord int, name string, tags map<string,string>")
    labels = spark.createDataFrame([("Q1", "Pagoda", None), ("Q2", "塔", "塔")], "entity_id string, label string, alias string")
    answers = spark.createDataFrame([(1, 1, "No"), (1, 2, "Second Tower"), (1, 4, "No")], "search_id int, ord int, name string")
    rows = {r.ord: (r.name, r.tags.get("name:local"), r.translated) for r in apply_english_names(places, labels, answers).collect()}
    assert rows == {1: ("Pagoda", "塔塔", True), 2: ("Second Tower", "塔塔", True), 3: ("塔塔", None, False), 4: ("Plain", None, False)}
