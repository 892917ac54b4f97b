"""Keys, text, geography and extraction: values known from the operators' definitions."""

import math
import uuid

import numpy as np
import pytest
from graphloom.functions import geo, keys, predicates, vectors
from graphloom.operators import extract
from pyspark.sql import functions as F


def values(spark, rows, schema, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_uuid5_equals_the_standard_library(spark):
    ns = uuid.uuid4()
    rows = [(f"Name {i} é", "" if i % 3 else " X ") for i in range(60)] + [("a", None)]
    want = [str(uuid.uuid5(ns, ":".join(p for p in (n.strip().lower(), (s or "").strip().lower()) if p))) for n, s in rows]
    assert values(spark, rows, "a string, b string", keys.uuid5(ns, "a", "b")) == want


def test_cleaning(spark):
    assert values(spark, [(" a   b\n",)], "a string", keys.squash_ws("a")) == ["a b"]
    assert values(spark, [("NaN",), (" n/a ",), ("",), (None,), (" x ",)], "a string", keys.null_tokens("a")) == [None, None, None, None, "x"]
    assert values(spark, [("12.9",), ("-3.5",), ("x",), ("NaN",), (None,), ("1e99",)], "a string", keys.parse_int("a")) == [12, -3, None, None, None, None]


def test_hosts_differ_in_ports_blanks_and_dots(spark):
    rows = [("HTTPS://www.Example.com:8080/a?b",), ("example.com/x",), ("localhost",), ("",), ("http://u:p@shop.example.org",)]
    assert values(spark, rows, "a string", keys.site_host("a")) == ["example.com", "example.com", None, None, "shop.example.org"]
    assert values(spark, rows, "a string", keys.join_domain("a")) == ["example.com:8080", "example.com", "localhost", "", "u:p@shop.example.org"]
    assert values(spark, rows, "a string", keys.chain_domain("a")) == ["example.com", "example.com", "localhost", "", "shop.example.org"]


def test_names(spark):
    rows = [("The Stumptown Roastery",), ("Stumptown Coffee Roasters",), ("Coffee",), ("The Coffee Company",), ("日本",)]
    assert values(spark, rows, "a string", keys.canon_name("a")) == ["stumptown", "stumptown", "coffee", "coffee", "日本"]
    assert values(spark, [("Caffè Nero",), ("Peet's Coffee & Tea",), (None,)], "a string", keys.fold_name("a")) == ["caffe nero", "peets coffee tea", None]


def test_places_and_currency(spark):
    assert values(spark, [("Santa Cruz, CA",), ("Arkansas",), ("",), (None,)], "a string", keys.location_country("a"), keys.location_city("a")) == [("CA", "Santa Cruz"), ("Arkansas", None), ("Other", None), ("Other", None)]
    rows = [(None, "https://a.co.uk", 1.0), ("USD", "https://a.no", 1.0), (None, "https://a.no", None), (None, "https://a.com", 1.0)]
    assert values(spark, rows, "c string, s string, p double", keys.currency_for("c", "s", "p")) == ["GBP", "USD", None, None]


def test_bbox_parse():
    assert predicates.parse_bbox("1,2,3,4") == (1, 2, 3, 4)
    for bad in ("1,2,3", "a,b,c,d", "1,2,3,4,5"):
        with pytest.raises(ValueError):
            predicates.parse_bbox(bad)


def test_distance_and_radius(spark):
    shops = spark.createDataFrame([("s1", 0.01, 0.01, True), ("s2", 0.02, 0.02, False), ("s3", 32.73367593, -117.16245889, True), ("s4", None, None, True)], "id string, lat double, lon double, flag boolean")
    flagged = predicates.only_flagged(shops, "flag")
    assert [r.id for r in geo.nearest(flagged, 0.0, 0.0, 50).collect()] == ["s1"]
    at_home = geo.nearest(flagged, 32.73367593, -117.16245889, 50).collect()
    assert [(r.id, r.distance_km) for r in at_home] == [("s3", 0.0)]
    line = spark.createDataFrame([(i, -90 + i * 0.7, (i * 37) % 360 - 180.0) for i in range(258)], "id long, lat double, lon double")
    got = {(r.query_id, r.id) for r in geo.nearby(line, line.withColumnRenamed("id", "query_id"), 900).collect()}
    rows = line.collect()

    def km(a, b):
        p, q = math.radians(a.lat), math.radians(b.lat)
        return 6371 * math.acos(max(-1, min(1, math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(math.radians(b.lon - a.lon)))))

    assert got == {(a.id, b.id) for a in rows for b in rows if km(a, b) <= 900}


def test_arc(spark):
    points = values(spark, [(-55.0, -10.0, 10.0, 51.0), (170.0, 40.0, -170.0, 40.0)], "a double, b double, c double, d double", geo.arc("a", "b", "c", "d"))
    assert all(len(p) == 49 for p in points)
    assert points[0][0] == [-55.0, -10.0] and points[0][48] == [10.0, 51.0]
    assert points[1][48] == [190.0, 40.0] and max(p[1] for p in points[1]) > 40


@pytest.mark.parametrize("km", [1, 35, 300, 938.2, 2500, 5000, 12000, 20100])
def test_nearby_equals_all_pairs(spark, km):
    rng = np.random.default_rng(int(km))
    lat = np.r_[rng.uniform(-90, 90, 150), rng.uniform(84, 90, 120), -rng.uniform(84, 90, 60), [90, 90, -90, -90, 0, 0, 84.37, 84.37]]
    lon = np.r_[rng.uniform(-180, 180, 150), rng.uniform(-540, 540, 180), [0, 77, 12, -170, 180, -180, 89.9, 184.9]]
    if km <= 35:  # close ones on both sides of the antimeridian and beside the poles
        lat, lon = np.r_[lat, rng.uniform(-0.3, 0.3, 60), 90 - rng.uniform(0, 0.4, 60)], np.r_[lon, 180 + rng.uniform(-0.3, 0.3, 60), rng.uniform(0, 360, 60)]
    frame = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))] + [(-1, None, 1.0), (-2, float("nan"), 1.0), (-3, 1.0, None), (-4, 91.0, 0.0)], "id long, lat double, lon double")
    found = {(r.query_id, r.id) for r in geo.nearby(frame, frame.withColumnRenamed("id", "query_id"), km).collect()}
    a, b = np.radians(lat), np.radians(lon)
    cosine = np.sin(a)[:, None] * np.sin(a) + np.cos(a)[:, None] * np.cos(a) * np.cos(b[:, None] - b)
    away = geo.EARTH_KM * np.arccos(np.clip(cosine, -1, 1))
    sure, maybe = away <= km - 1e-3, away <= km + 1e-3
    assert set(zip(*np.nonzero(sure), strict=True)) <= found <= set(zip(*np.nonzero(maybe), strict=True)) and len(found) > 1


def test_geojson(spark):
    line = values(spark, [(-55.0, -10.0, 10.0, 51.0)], "a double, b double, c double, d double", geo.line_feature("a", "b", "c", "d", id=F.lit("rt1")))[0]
    assert line == '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[-55.0,-10.0],[10.0,51.0]]},"properties":{"id":"rt1"}}'


def test_cosine_and_centroid(spark):
    rows = [("a", [1.0, 0.0], [1.0, 1.0]), ("a", [3.0, 2.0], None), ("b", None, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "g string, v array<float>, w array<float>")
    assert [round(c, 4) if c is not None else None for c in values(spark, rows, "g string, v array<float>, w array<float>", vectors.cosine("v", "w"))] == [0.7071, None, None]
    assert {r.g: r.centroid for r in vectors.centroid(df, "g", "v").collect()} == {"a": [2.0, 1.0], "b": None}


def test_classifier_order(spark):
    rows = [
        ("Ethiopia Washed", None, []), ("Ceramic Mug", "Coffee", []), ("Dark Chocolate", None, []), ("Chocolate Cold Brew", None, []), ("V60", "Coffee Equipment", []),
        ("Instant Pack", "Coffee", ["merch"]), ("Some Record", None, ["Vinyl"]), ("House", "Coffee,Gifts", []), ("House", "Gifts", []), ("豆", "コーヒー豆", []), ("袋", "グッズ", []), ("Monthly", "Subscription", []),
    ]
    want = [True, False, False, True, False, True, False, True, False, True, False, False]
    assert values(spark, rows, "t string, k string, g array<string>", extract.classify("t", "k", "g")) == want


def test_classifier_default_words(spark):
    never = ["AeroPress Go", "Chemex Six Cup", "French Press", "Moccamaster", "Matcha Latte RTD", "Apron", "Milk Pitcher 500ml", "Cup Lids - Hot", "Shot Glass", "Rinza Tablets", "To-Go Barista Box", "Askinosie Chocolate", "The Cupping Table", "Holiday Gifts"]
    never += ["Rocket Appartamento TCA Espressomaskin Stål", "Presskanne glass 8 kopps Typica", "Gjenbrukskopp liten (2,3 dl) hvit", "Typica Nøkkelring Hellekanne Sølv", "VST Filter Basket", "Jura E8", "מטחנה ידנית", "コーヒーメーカー"]
    always = ["Kenya AA Rung'eto, 250g", "Filter Roast — Ethiopia Chelbesa", "Three Africas Filter", "Sweater Weather", "Acaiá Natural", "Horchata Cold Brew with Oatly", "Capsule of Kenya"]
    rows = [(t, None, []) for t in never + always]
    assert values(spark, rows, "t string, k string, g array<string>", extract.classify("t", "k", "g")) == [False] * len(never) + [True] * len(always)
    kinds = [("House", "Carbon Offset", []), ("House", "Brewers", []), ("House", "CDs", []), ("House", "COFFEE & Tea", []), ("House", "Warehouse", [])]
    assert values(spark, kinds, "t string, k string, g array<string>", extract.classify("t", "k", "g")) == [False, False, False, True, False]


def test_weights_and_jsonld_shapes(spark):
    weights = {"0.75 lbs": 340, "1 kg": 1000, "12. oz": 340, ".5kg": 500, "2 Pounds": 907, "net 250G bag": 250, "1.2.3 oz": None, "3 lbsx": None, "0 g": None, ".": None}
    assert values(spark, [(w,) for w in weights], "w string", extract.grams("w")) == list(weights.values())
    product = '{"@type":"Product","name":"%s"}'
    pages = [
        (1, f'<script type="application/ld+json">{product % "a"}</script><p><script type=\'application/ld+json\'>{product % "b"}</script>'), (2, f'<SCRIPT TYPE=application/ld+json async>{product % "c"}</SCRIPT >'),
        (3, f'<script data-x="1 > 0" id=\'>\' type="application/ld+json">{product % "d"}</script>'), (4, f'<script type="text/javascript">{product % "no"}</script><script>var type = "application/ld+json"</script>'), (5, '<script type="application/ld+json">{broken</script>'),
    ]
    found = extract.extract_jsonld(spark.createDataFrame(pages, "id long, html string"))
    assert sorted((r.id, r.name) for r in found.collect()) == [(1, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_tags_and_units(spark):
    assert values(spark, [(["x", " Medium-Dark "],), (["none"],), ([],)], "t array<string>", extract.first_tag("t", extract.ROAST_LEVELS)) == ["medium", None, None]
    assert values(spark, [(["Dark Chocolate", "Medium Roast"],), (["light-roast"],)], "t array<string>", extract.first_tag("t", extract.ROAST_LEVELS, (" roasted", " roast", "-roast"))) == ["medium", "light"]
    assert values(spark, [("Las Lajas semi washed lot",), ("Drying beds",), ("Honey",)], "t string", extract.longest_key("t", extract.PROCESSES)) == ["Semi-Washed", None, "Honey"]
    assert values(spark, [("1.5 lbs",), ("12 oz",), ("250 g",), ("N/A",), ("2.5",), (None,)], "w string", extract.grams("w")) == [680, 340, 250, None, None, None]
    assert values(spark, [("1850", 2), ("0", 2), (None, 2), ("1850", None), ("500", 0)], "a string, u int", extract.minor_price("a", "u")) == [18.5, None, None, 18.5, 500.0]
    assert values(spark, [(" usd ",), ("US$",), (None,)], "c string", extract.iso_currency("c")) == ["USD", None, None]
    assert values(spark, [("javascript:x",), ("https://a",)], "u string", extract.safe_url("u", F.lit("d"))) == ["d", "https://a"]
    assert values(spark, [("Unblended",), ("House Blend",)], "t string", extract.is_blend("t", F.lit(None).cast("string"), F.array().cast("array<string>"))) == [False, True]
    assert values(spark, [("a, b ,, c",)], "t string", extract.as_tags("t")) == [["a", "b", "c"]]
    assert values(spark, [("plain",), (None,), ("&lt;b",)], "h string", extract.unescape_html("h")) == ["plain", None, "<b"]
    assert values(spark, [("<p>Fish &amp; chips</p>\n\n<b>now</b>",), (None,)], "h string", extract.html_text("h")) == ["Fish & chips now", ""]


def test_references_without_a_semicolon(spark):
    rows = [("a &amp",), ("b &copy; &AMP c &amp;lt; &#65; &#x42;",), ("&none; &notit; &amp;amp; &#67",)]
    assert values(spark, rows, "h string", extract.unescape_html("h")) == ["a &", "b © & c &lt; A B", "&none; ¬it; &amp; C"]
    assert values(spark, rows, "h string", extract.unescape_html("h", closed=True)) == ["a &amp", "b © &AMP c &lt; A B", "&none; &notit; &amp; &#67"]


def test_reference_lists(spark):
    rows = [([("Ref A", "7", ""), ("", "1", "2"), ("Ref B", "3", "4")],), ([],), (None,)]
    assert values(spark, rows, "r array<struct<reference:string,flavor:string,aroma:string>>", extract.format_refs("r", "reference", ["flavor", "aroma"])) == ["Ref A: flavor=7; Ref B: flavor=3, aroma=4", None, None]


def test_descriptions(spark):
    meta = lambda text: f'<html><head><meta property="og:description" content="{text}"></head>'
    rows = [(1, meta("We roast coffee &amp; serve it fresh, every day of the week"), "x"), (2, meta("Just another WordPress site"), "x"), (3, "<html></html>", "x"), (4, meta("A parked domain about insurance and loans for all"), "x"), (5, meta("coffee coffee coffee coffee coffee"), "Coffee coffee coffee coffee coffee")]
    got = extract.extract_descriptions(spark.createDataFrame(rows, "id long, html string, title string"), ["coffee", "espresso"]).orderBy("id").collect()
    assert [r.status for r in got] == ["ok", "junk", "empty", "junk", "junk"] and got[0].description == "We roast coffee & serve it fresh, every day of the week"


def test_catalogs(spark):
    shopify = '{"products":[{"title":"Kenya AA ","handle":"kenya","body_html":"<p>Juicy</p>","vendor":"Ritual","product_type":"Coffee","tags":["Light","Washed"],"variants":[{"price":"0.00","grams":3},{"price":"21.00","grams":340},{"price":"60.00","grams":1000}]},{"title":"Tote","handle":"t","variants":[]}]}'
    woo = '[{"name":"Las Lajas Honey","permalink":"https://r.com/p/1","description":"","short_description":"Sweet","type":"simple","tags":[{"name":"Single"}],"categories":[{"name":"Medium Roast"}],"brands":[],"prices":{"price":"2100","currency_code":"usd","currency_minor_unit":2,"price_range":null},"formatted_weight":"12 oz"}]'
    df = spark.createDataFrame([("https://www.r.com", shopify)], "site string, payload string")
    got = extract.normalise_catalog(df, "shopify").collect()
    assert [(r.title, r.roaster, r.url, r.price, r.net_weight_grams, r.roast_level, r.process, r.currency) for r in got] == [("Kenya AA", "Ritual", "https://www.r.com/products/kenya", 21.0, 340, "light", "Washed", None)]
    got = extract.normalise_catalog(spark.createDataFrame([("https://r.com", woo)], "site string, payload string"), "woocommerce").collect()
    assert [(r.title, r.roaster, r.description, r.price, r.net_weight_grams, r.roast_level, r.process, r.currency) for r in got] == [("Las Lajas Honey", "r.com", "Sweet", 21.0, 340, "medium", "Honey", "USD")]
    with pytest.raises(ValueError):
        extract.normalise_catalog(df, "other")
