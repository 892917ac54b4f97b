"""Merging, scoring, composed jobs, sources, sinks and streams."""

import json

import pytest
from graphloom.functions import geo
from graphloom.functions.predicates import capped_union
from graphloom.operators import aggregates as a
from graphloom.operators import jobs, merge
from graphloom.operators import joins as j
from graphloom.sources import readers, sinks
from graphloom.streaming import streams
from pyspark.sql import functions as F


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_upsert_keeps_enrichment(spark):
    base = spark.createDataFrame([("s1", "Old", 4.5, "2024"), ("s9", "Else", 3.0, "2023")], "id string, name string, rating double, created string")
    source = spark.createDataFrame([("s1", "New", 0.5), ("s1", "Newer", 0.9), ("s2", "Fresh", 0.7)], "id string, name string, confidence double")
    out = merge.upsert(base, source, ["name"], confidence="confidence", created="created", now=F.lit("2026"))
    want = [("s1", "Newer", 4.5, "2024"), ("s2", "Fresh", None, "2026"), ("s9", "Else", 3.0, "2023")]
    assert rows(out, "id", "name", "rating", "created") == want
    assert rows(merge.upsert(out, source, ["name"], confidence="confidence", created="created", now=F.lit("2027")), "id", "name", "rating", "created") == want


def test_rebuild_loses_nothing(spark):
    old = spark.createDataFrame([("c1", "A", 1.0), ("c2", "B", 2.0)], "id string, name string, lat double")
    new = spark.createDataFrame([("c1", "A+", None), ("c3", "C", None)], "id string, name string, lat double")
    out = merge.rebuild(old, new, ["lat"])
    assert rows(out, "id", "name", "lat") == [("c1", "A+", 1.0), ("c2", "B", 2.0), ("c3", "C", None)]
    edges = spark.createDataFrame([("c1", "x"), ("gone", "x")], "country string, farm string")
    assert rows(merge.surviving_edges(edges, {"country": (out, "id")}), "country") == [("c1",)]


CHAINS = {"allow": ["Blue Bottle"], "block": ["Starbucks", "Costa Coffee"], "block_hosts": ["chain.example"], "social_hosts": ["instagram.com"]}


def test_score(spark):
    shops = [
        ("chain_no", "Starbucks Reserve", "https://a.com", "text", 5.0, True), ("chain_yes", "Blue Bottle Coffee", None, None, None, None), ("desc", "D", None, "text", None, None), ("roastshop", "R", None, None, None, True),
        ("rated", "T", None, None, 4.6, None), ("weak", "W", "https://w.com", None, 3.0, None), ("nosignal", "N", " ", None, None, None), ("curated", "C", None, None, None, None),
        ("social", "S", "https://m.instagram.com/s", "text", None, None), ("costa", "Costa Rica Coffee", None, "text", None, None), ("by_host", "קפה", "http://www.chain.example/1", "text", 5.0, None),
    ]
    df = spark.createDataFrame(shops, "id string, name string, website string, description string, rating double, roasts_in_house boolean")
    out = {r.id: (round(r.specialty_score, 2), r.is_specialty) for r in merge.score_flag(df, spark.createDataFrame([("curated",)], "shop_id string"), **CHAINS).collect()}
    assert out == {
        "chain_no": (0.0, False), "chain_yes": (1.0, True), "desc": (0.3, True), "roastshop": (0.2, True), "rated": (0.2, True), "weak": (0.1, False), "nosignal": (0.0, False), "curated": (0.6, True),
        "social": (0.1, False), "costa": (0.3, True), "by_host": (0.0, False),
    }


def test_locations_and_currency(spark):
    roasters = spark.createDataFrame([("1", "Verve", "https://verve.com", None), ("2", "Heart", "https://www.heart.com", ""), ("3", "Set", "https://heart.com", "Here, There"), ("4", "None", None, None)], "id string, name string, website string, location string")
    curated = spark.createDataFrame([("Verve", "Santa Cruz, United States")], "name string, location string")
    shops = spark.createDataFrame([("https://heart.com/a", "United States", c) for c in ("Portland", "Portland", "Seattle")], "website string, country string, city string")
    out = merge.fill_locations(roasters, curated, shops)
    want = [("1", "Santa Cruz, United States", "updated"), ("2", "Portland, United States", "updated"), ("3", "Here, There", "already set"), ("4", None, "unmatched")]
    assert rows(out, "id", "location", "status") == want
    products = spark.createDataFrame([("a", "1", 5.0, None), ("b", "1", None, None), ("c", "2", 5.0, "EUR"), ("d", "4", 1.0, None)], "id string, roaster_id string, price double, currency string")
    assert rows(merge.fill_currency(products, out, {"United States": "USD"}), "id", "currency") == [("a", "USD"), ("b", None), ("c", "EUR"), ("d", None)]


def test_work_list(spark):
    log = spark.createDataFrame([("1", "ok"), ("2", "fetch_error"), ("3", "http_error"), ("3", "junk"), ("4", "skip")], "shop_id string, status string")
    items = spark.createDataFrame([(str(i),) for i in range(1, 7)], "shop_id string")
    assert [r.shop_id for r in merge.work_list(items, log, "shop_id", ["ok", "empty", "junk", "skip"], 2).collect()] == ["2", "5"]
    # blocked chains go before the limit: by name, by host, and not if they are allowed
    shops = spark.createDataFrame([("2", "Big Chain Oslo", None), ("3", "Own", "https://own.example"), ("5", "Fine Chain", "https://www.bigchain.example/oslo"), ("6", "Big Chain Reserve", None), ("7", None, "https://seven.example")], "shop_id string, name string, website string")
    left = merge.work_list(shops, log, "shop_id", ["ok", "empty", "junk", "skip"], 2, ["Big Chain Reserve"], ["Big chain"], ["bigchain.example"])
    assert [r.shop_id for r in left.collect()] == ["6", "7"]
    times = spark.createDataFrame([("a", 1), ("b", 3), ("c", None), ("d", 3)], "id string, created_at long")
    assert [r.id for r in merge.newest_first(times, "id").collect()] == ["b", "d", "a", "c"]


def test_activity(spark):
    vertices = spark.createDataFrame([("variety", "v1"), ("variety", "v2")], "entity_type string, id string")
    log = [(1, 1, "u", "add", "v1", None, None, None), (2, 2, "u", "add", "v1", None, None, None), (3, 3, "u", "add", "v2", None, None, None), (4, 4, "u", "remove", "v2", None, None, None), (5, 5, "u", "add", "gone", None, None, None), (6, 6, "w", "add", "v1", None, None, None)]
    log += [(7, 7, "u", "note", "v1", "n1", 80.0, "good"), (8, 8, "u", "note", "v1", "n1", None, "better"), (9, 9, "u", "note", "v1", "n1", 101.0, "bad")]
    df = spark.createDataFrame([(e, t, u, act, "variety", i, n, s, x) for e, t, u, act, i, n, s, x in log], "event_id long, ts long, user_id string, action string, entity_type string, entity_id string, note_id string, score double, notes string")
    favourites, notes = merge.activity_state(df, vertices)
    assert rows(favourites, "user_id", "entity_id", "event_id") == [("u", "v1", 1), ("w", "v1", 6)]
    assert rows(notes, "note_id", "score", "notes") == [("n1", 80.0, "better")]


def test_samples(spark):
    raw = [("Ethiopia", "Sidamo", "Aricha", "Washed / Wet", "1900.5", "Bourbon"), ("Ethiopia", "Sidamo", "Aricha", "Washed / Wet", "1500", "Bourbon"), (None, "X", "Y", "Z", "1", "Bourbon"), ("Kenya", "Nyeri", "nan", "Natural", "NA", "Other"), ("Panama", "Boquete", "Aricha", "Natural", "1600", "geisha")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(raw)], "country string, region string, farm string, process string, altitude string, variety string, at long").repartition(4)
    varieties = spark.createDataFrame([("b", "Bourbon"), ("g", "Geisha (Panama)")], "id string, name string")
    out = jobs.load_samples(df, varieties, synonyms={"Geisha": "Geisha (Panama)"}, methods={"washed / wet": "washed"})
    assert {k: v.count() for k, v in out.items()} == {"countries": 3, "regions": 3, "farms": 2, "methods": 2, "country_variety": 2, "region_variety": 2, "farm_variety": 2, "variety_processing": 2, "unmatched": 0}
    assert sorted(r.altitude for r in out["farms"].collect()) == [1600, 1900]
    assert rows(out["methods"], "name", "category") == [("Natural", "other"), ("Washed / Wet", "washed")]


def test_products(spark):
    cols = "site string, roaster string, title string, product_type string, tags array<string>, price double, currency string, net_weight_grams int, roast_level string, process string, is_blend boolean, url string, description string, at long"
    rec = lambda at, site, vendor, title, kind="Coffee", price=10.0, currency=None: (site, vendor, title, kind, [], price, currency, None, None, None, False, None, None, at)
    data = [rec(1, "https://www.onyx.com", "Onyx Coffee Lab", "A"), rec(2, "https://www.onyx.com", "Onyx coffee lab", "B"), rec(3, "https://www.onyx.com", "Onyx Coffee Lab", "B", price=12.0), rec(4, "https://www.onyx.com", "Other", "Mug"), rec(5, "https://stump.co.uk", "Stumptown Coffee", "C"), rec(6, "https://b.no", "", " "), rec(7, "https://b.no", "", "D", currency="EUR")]
    old = spark.createDataFrame([("seed", "The Stumptown Coffee Roasters", 1), ("late", "Stumptown", 2)], "id string, name string, created_at long")
    out = jobs.load_products(spark.createDataFrame(data, cols), old, aliases={"b.no": "Bean"})
    assert rows(out["products"], "name", "price", "currency") == [("A", 10.0, None), ("B", 12.0, None), ("C", 10.0, "GBP"), ("D", 10.0, "EUR")]
    assert out["products"].where("name = 'C'").first().roaster_id == "seed"
    assert sorted(r.name for r in out["roasters"].collect()) == ["Bean", "Onyx Coffee Lab", "Stumptown", "The Stumptown Coffee Roasters"]
    assert out["counts"].first().dropped == 1


def test_candidates_and_distribution(spark):
    shops = spark.createDataFrame([("a", "A", "https://x.com/1", True, False), ("b", "B", "http://www.x.com", True, False), ("c", "C", "https://known.com", True, None), ("d", "D", "https://y.com", False, True), ("e", "E", "https://z.com", False, False), ("f", "F", None, True, True)], "id string, name string, website string, is_specialty boolean, roasts_in_house boolean")
    known = spark.createDataFrame([("https://www.known.com",)], "website string")
    assert rows(jobs.select_candidates(shops, known), "id", "host") == [("a", "x.com"), ("d", "y.com")]
    countries = spark.createDataFrame([("c_br", "Brazil")], "id string, name string")
    wanted = spark.createDataFrame([("Germany",), ("brazil",), ("GERMANY",)], "name string")
    importers = spark.createDataFrame([("Acme", "Germany"), ("Orphan", "Nowhere")], "name string, country string")
    routes = spark.createDataFrame([("Brazil", "Germany"), ("Brazil", "Mars")], "exporter string, importer string")
    out = jobs.load_distribution(importers, routes, wanted, countries)
    assert out["countries"].count() == 2 and out["routes"].count() == 1 and rows(out["unresolved"], "name") == [("mars",), ("nowhere",)]
    again = jobs.load_distribution(importers, routes, wanted, out["countries"])
    assert again["countries"].count() == 2


def test_geocoding_and_descriptions(spark):
    countries = spark.createDataFrame([("1", "Ivory Coast", None, None), ("2", "Kenya", 9.0, 9.0), ("3", "Atlantis", None, None)], "id string, name string, lat double, lon double")
    centroids = spark.createDataFrame([("Côte d'Ivoire", 7.5, -5.5, "CI"), ("Kenya", 0.0, 38.0, "KE")], "country string, lat double, lon double, iso string")
    out, missing = jobs.geocode_countries(countries, centroids, {"Ivory Coast": "Côte d'Ivoire"})
    assert rows(out, "id", "lat") == [("1", 7.5), ("2", 9.0), ("3", None)] and rows(missing, "name") == [("Atlantis",)]
    regions = spark.createDataFrame([("r1", "Nyeri", "Kenya", "KE", None, None), ("r2", "Huila", "Colombia", None, None, None)], "id string, name string, country string, iso string, lat double, lon double")
    table = spark.createDataFrame([("ke|nyeri, kenya", 1.0, 2.0), ("*|huila, colombia", None, None)], "key string, lat double, lon double")
    out, missing = jobs.geocode_regions(regions, table)
    assert rows(out, "id", "lat") == [("r1", 1.0), ("r2", None)] and rows(missing, "id") == [("r2",)]
    methods = spark.createDataFrame([("m1", "Washed", None), ("m2", "odd", "own")], "id string, category string, description string")
    out, missing = jobs.describe_by_category(methods, {"washed": "clean"})
    assert rows(out, "id", "description") == [("m1", "clean"), ("m2", "own")] and rows(missing, "category") == [("odd",)]


def test_prune(spark):
    shops = spark.createDataFrame([("s1", True), ("s2", False)], "id string, flag boolean")
    edges = spark.createDataFrame([("s1", 1), ("s2", 2), (None, 3)], "shop_id string, n int")
    out = merge.export_pruned({"shops": shops, "edges": edges, "other": edges}, "shops", F.col("flag"), {"edges": "shop_id"})
    assert {k: v.count() for k, v in out.items()} == {"shops": 1, "edges": 2, "other": 3}
    with pytest.raises(ValueError):
        merge.export_pruned({"shops": shops}, "shops", F.lit(False), {})


def test_counts_and_trees(spark):
    roasters = spark.createDataFrame([("r1", "Verve"), ("r2", "Onyx")], "id string, name string")
    products = spark.createDataFrame([("r1",), ("r1",), (None,)], "roaster_id string")
    assert [(r.id, r.n) for r in a.count_children(roasters, products, "roaster_id").collect()] == [("r1", 2), ("r2", 0)]
    assert [r.id for r in a.count_children(roasters, products, "roaster_id", by_name=True).collect()] == ["r2", "r1"]
    flavors = spark.createDataFrame([("Fruity", "Berry", "Cherry"), ("Fruity", None, "Grape"), (None, None, "Odd")], "c string, s string, n string")
    tree = {r.category: {k: [x.n for x in v] for k, v in r.children.items()} for r in a.nest(flavors, "c", "s", F.struct("n")).collect()}
    assert tree == {"Fruity": {"Berry": ["Cherry"], "Other": ["Grape"]}, "Other": {"Other": ["Odd"]}}
    triples = spark.createDataFrame([("a", "rdf:type", "K"), ("b", "rdf:type", "K"), ("K", "rdf:type", "owl:Class"), ("x", "rdf:type", "L")], "subject string, predicate string, object string")
    assert rows(a.triple_stats(triples), "object", "subjects") == [("K", 2), ("L", 1), ("owl:Class", 1)]
    assert rows(j.match_triples(triples), "subject") == [("a",), ("b",)]
    capped = capped_union(spark.createDataFrame([("x", i) for i in range(9)] + [("y", 1)], "s string, id int"), "s", [F.col("id")], 6, 2, "s")
    assert [r.s for r in capped.collect()] == ["x"] * 5 + ["y"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"Country.of.Origin","Region"\nKenya,"Nyeri, North"\n')
    (tmp_path / "b.csv").write_text("Country.of.Origin,Other\n1,2\n")
    df = readers.read_csv_union(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv", f"{tmp_path}/none.csv"], {"Country.of.Origin": "country", "Region": "region"})
    assert rows(df, "country", "region") == [("1", None), ("Kenya", "Nyeri, North")]
    assert readers.read_csv_union(spark, [], {"x": "y"}).columns == ["y"]
    (tmp_path / "doc.json").write_text(json.dumps({"data": [{"name": "Fruity", "definition": "d", "children": [{"name": "Berry", "children": [{"name": "Cherry"}]}]}]}, indent=1))
    node = "name string, definition string"
    roots = readers.read_json_doc(spark, f"{tmp_path}/doc.json", f"data array<struct<{node.replace(' string', ':string').replace(', ', ',')},children:array<struct<name:string,definition:string,children:array<struct<name:string,definition:string>>>>>>", "data")
    assert rows(readers.flatten_tree(roots), "path", "parent_path", "category", "subcategory", "depth") == [("Fruity", None, "Fruity", None, 1), ("Fruity/Berry", "Fruity", "Fruity", "Berry", 2), ("Fruity/Berry/Cherry", "Fruity/Berry", "Fruity", "Berry", 3)]
    (tmp_path / "list.txt").write_text("# c\n\nOslo,NO # here\nTel Aviv, il\n")
    assert rows(readers.read_pairs(spark, f"{tmp_path}/list.txt"), "city", "country") == [("Oslo", "NO"), ("Tel Aviv", "IL")]
    (tmp_path / "bad.txt").write_text("Oslo\n")
    with pytest.raises(Exception, match="City,CC"):
        readers.read_pairs(spark, f"{tmp_path}/bad.txt").collect()
    (tmp_path / "c.json").write_text('{"country":"Kenya","lat":0.5,"lon":38.0,"iso":"KE"}\n')
    assert readers.load_centroids(spark, f"{tmp_path}/c.json").first().iso == "KE"


def test_triples(spark):
    lines = [
        r'<http://a> <p> "say \"hi\" caf\u00E9 \uD83D\uDE00 \U0001F600\n\\u" .', r'<a><p>"1"^^<int>.', "_:b.1 <p> <c> . # note", "_:b.1 <p> <c> .", r'<s\u0041> <p> _:x <graph> .', '<a> <p> "bon\tjour"@fr-CA <g> .', "  ", "# comment",
        "broken", '<a> <p> "open .', r'<a> <p> "\uD83D alone" .', r'<a> <p> "\q" .', '"s" <p> <o> .', "<a b> <p> <o> .",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {tuple(r) for r in readers.load_triples(df, "own").collect()}
    assert got == {
        ("http://a", "p", 'say "hi" café \U0001f600 \U0001f600\n\\u', "literal", None, None, "own"), ("a", "p", "1", "literal", "int", None, "own"), ("_:b.1", "p", "c", "iri", None, None, "own"),
        ("sA", "p", "_:x", "bnode", None, None, "graph"), ("a", "p", "bon\tjour", "literal", None, "fr-CA", "g"),
    }
    assert rows(readers.rejected_triples(df), "value") == sorted((x,) for x in lines[8:])
    long = spark.createDataFrame([('<a> <p> "' + "x" * 200_000 + r"\n" * 50_000 + '" .',)], "value string")
    assert len(readers.load_triples(long).first().object) == 250_000


def test_places(spark):
    place = "id string, names struct<primary:string>, bbox struct<xmin:double,ymin:double>, addresses array<struct<freeform:string,locality:string,country:string>>, websites array<string>, categories struct<primary:string>, confidence double"
    df = spark.createDataFrame([("1", ("A",), (1.0, 1.0), [("s", "c", "US")], ["w"], ("cafe",), 0.9), ("2", ("B",), (50.0, 1.0), [], [], ("cafe",), 0.9), ("3", (None,), (1.0, 1.0), [], [], ("cafe",), 0.9), ("4", ("D",), (2.0, 2.0), [], [], ("cafe",), 0.8), ("5", ("E",), (2.0, 2.0), [], [], ("bar",), 0.9)], place)
    out = readers.scan_places(df, [(0, 0, 3, 3), (10, 10, 11, 11)], ["cafe"], 0.8)
    assert rows(out, "id", "city", "website") == [("1", "c", "w"), ("4", None, None)]


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    first = sinks.write_table(spark.range(3), path)
    again = sinks.write_table(first.where("id > 0"), path)
    assert rows(again, "id") == [(1,), (2,)]
    sinks.write_geojson(spark.createDataFrame([('{"a":1}',)], "feature string"), f"{tmp_path}/g")
    assert spark.read.text(f"{tmp_path}/g").first()[0] == '{"a":1}'


def test_export(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/export"
    shops, edges = spark.createDataFrame([("s1", 1), ("s2", 2)], "id string, n int"), spark.createDataFrame([("s1", "v")], "shop_id string, v string")
    columns = {"shops": {"n": "long", "id": "string", "new": "double"}, "later": {"x": "int"}}
    assert sinks.export_tables({"shops": shops, "edges": edges}, path, columns) == {"shops": 2, "edges": 1, "later": 0}
    assert spark.read.parquet(f"{path}/shops").columns == ["n", "id", "new"] and spark.read.parquet(f"{path}/later").count() == 0
    with pytest.raises(RuntimeError, match="row counts differ for edges"):
        sinks.export_tables({"shops": shops.limit(1), "edges": edges}, path, columns, {"edges": 5})
    with pytest.raises(Exception, match="zero|ZERO"):
        sinks.export_tables({"shops": shops.selectExpr("id", "1 / (n - 1) as n")}, path)
    assert spark.read.parquet(f"{path}/shops").count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["export"]
    assert sinks.export_tables({"shops": shops.limit(1)}, path) == {"shops": 1} and not (tmp_path / "export" / "edges").exists()


def test_feature_collection(spark, tmp_path):
    path = f"{tmp_path}/collection"
    features = spark.range(5000).select(geo.point_feature(F.lit(1.0), F.lit(2.0), id="id").alias("feature")).repartition(7)
    for df, n in ((features, 5000), (features.limit(0), 0), (features.limit(1).unionByName(features.limit(1)), 2), (features.unionByName(spark.createDataFrame([(None,)], "feature string")), 5000)):
        names = sinks.write_feature_collection(df, path)
        with open(f"{path}/manifest.json") as f:
            listed = json.load(f)["files"]
        assert [x["name"] for x in listed] == names
        whole = b"".join(open(f"{path}/{x}", "rb").read() for x in names)
        assert sum(x["bytes"] for x in listed) == len(whole)
        document = json.loads(whole)
        assert document["type"] == "FeatureCollection" and len(document["features"]) == n
        texts = [json.dumps(x, separators=(",", ":")) for x in document["features"]]
        assert texts == sorted(texts)


def test_ledger(spark, tmp_path):
    ledger = sinks.Ledger(spark, f"file://{tmp_path}/table")
    frame = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    assert ledger.read("k string, v int").count() == 0
    assert ledger.add(0, frame(("a", 1), ("b", 1)))
    # a crash after the rows of a batch and before its entry: these are no rows yet, and the batch may come again
    sinks.write_table(frame(("a", 9), ("x", 9)), f"{ledger.path}/rows/batch=1")
    assert rows(ledger.read("k string, v int"), "k", "v") == [("a", 1), ("b", 1)]
    assert ledger.add(1, frame(("a", 2)))
    # a crash after the entry: the batch comes again and changes nothing
    assert not ledger.add(1, frame(("a", 3), ("z", 3)))
    assert rows(ledger.read("k string, v int", ["k"]), "k", "v", "batch") == [("a", 2, 1), ("b", 1, 0)]
    assert ledger.finished() == [0, 1]


def product_log(spark, path, titles):
    df = spark.createDataFrame([("https://a.com", t, 1.0) for t in titles], "site string, title string, price double")
    sinks.write_scrape_log(df, path, spark.createDataFrame([("https://a.com", "ok")], "site string, status string"))


def test_scrape_log_and_its_stream(spark, tmp_path):
    path = f"{tmp_path}/log"
    product_log(spark, path, ["x", "y"])
    with open(f"{path}/part-cut.json", "w") as f:
        f.write('{"site":"https://a.com","product":{"title":"cut')
    assert rows(readers.read_scrape_log(spark, path), "site", "title") == [("https://a.com", "x"), ("https://a.com", "y")]
    load = lambda df: df.select("site", "title", "price")
    ledger = sinks.Ledger(spark, f"{tmp_path}/table")
    for titles in ([], ["z", "x"]):
        if titles:
            product_log(spark, path, titles)
        streams.stream_scrape_log(spark, path, f"{tmp_path}/check", f"{tmp_path}/table", load).awaitTermination()
    assert rows(ledger.read("site string, title string, price double", ["site", "title"]), "title", "batch") == [("x", 1), ("y", 0), ("z", 1)]
    # the stream's own record of the last batch is lost, so it comes again
    for name in ("1", ".1.crc"):
        (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
    streams.stream_scrape_log(spark, path, f"{tmp_path}/check", f"{tmp_path}/table", lambda df: load(df).where("false")).awaitTermination()
    assert ledger.read("site string, title string, price double").count() == 4


def test_favourites_stream(spark, tmp_path):
    """Removes, late rows and two restarts against the batch job."""
    import random

    rng = random.Random(4)
    log = [(i, rng.randrange(50), f"u{rng.randrange(4)}", rng.choice(["add", "add", "remove"]), "variety", f"v{rng.randrange(3)}", None, None, None) for i in range(120)]
    df = spark.createDataFrame(log, "event_id long, ts long, user_id string, action string, entity_type string, entity_id string, note_id string, score double, notes string").withColumn("ts", F.timestamp_seconds("ts"))
    vertices = spark.createDataFrame([("variety", f"v{i}") for i in range(3)], "entity_type string, id string")
    rng.shuffle(log)
    for part in (log[:50], log[50:90], log[90:]):
        df.join(spark.createDataFrame([(r[0],) for r in part], "event_id long"), "event_id", "left_semi").repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        writer = streams.stream_favourites(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
        writer.trigger(availableNow=True).start().awaitTermination()
        seen = spark.read.schema(df.schema).parquet(f"{tmp_path}/in")
        columns = ["user_id", "entity_type", "entity_id", "created_at", "event_id"]
        assert rows(streams.favourites_of(spark.read.parquet(f"{tmp_path}/out")), *columns) == rows(merge.activity_state(seen, vertices)[0], *columns)
    assert spark.read.parquet(f"{tmp_path}/out").where("not live").count() > 0


def test_catalog_ids_do_not_change(spark):
    items = spark.createDataFrame([("Geisha", "Arabica", 1), ("SL28", "Arabica", 2), ("geisha ", "arabica", 3), (" ", "x", 4)], "name string, species string, at long").repartition(3)
    out = [rows(jobs.load_catalog(items, jobs.NAMESPACE, "variety"), "id", "name") for _ in range(2)]
    assert out[0] == out[1] and sorted(n for _, n in out[0]) == ["SL28", "geisha "]
