"""Edge building, traversal, search and recommendation on small graphs with known answers."""

import random
import re
from collections import Counter

import pytest
from graphloom.operators import graph as g
from graphloom.operators import joins as j
from graphloom.operators import search
from graphloom.operators.aggregates import overlap
from pyspark.sql import functions as F

VERTICES = [("c1", "country", "Ethiopia"), ("c2", "country", "Brazil"), ("r1", "region", "Yirg"), ("f1", "farm", "Konga"), ("v1", "variety", "Geisha"), ("fl1", "flavor", "Jasmine"), ("p1", "processing", "Washed")]
EDGES = [("country_region", "c1", "r1"), ("region_farm", "r1", "f1"), ("farm_variety", "f1", "v1"), ("variety_flavor", "v1", "fl1"), ("variety_processing", "v1", "p1")]


@pytest.fixture
def small(spark):
    return spark.createDataFrame(EDGES, "edge_type string, src_id string, dst_id string"), spark.createDataFrame(VERTICES, "id string, entity_type string, label string")


def traverse(spark, small, seed, depth, **options):
    nodes, edges, cut = g.traverse(spark.createDataFrame([(seed,)], "seed string"), *small, depth, **options)
    return {r.id: r.depth for r in nodes.collect()}, {(r.src_id, r.dst_id) for r in edges.collect()}, cut.first().truncated


def test_traverse(spark, small):
    assert traverse(spark, small, "c1", 2) == ({"c1": 0, "r1": 1, "f1": 2}, {("c1", "r1"), ("r1", "f1")}, False)
    assert traverse(spark, small, "fl1", 1) == ({"fl1": 0, "v1": 1}, {("v1", "fl1")}, False)
    assert traverse(spark, small, "c1", 5, types=["country_region"])[0] == {"c1": 0, "r1": 1}
    assert traverse(spark, small, "c2", 3) == ({"c2": 0}, set(), False)
    nodes, edges, cut = traverse(spark, small, "c1", 3, max_nodes=2)
    assert (nodes, edges, cut) == ({"c1": 0, "r1": 1}, {("c1", "r1")}, True)
    assert traverse(spark, small, "v1", 1, max_edges=1)[2]


def paths(spark, small, pairs, **options):
    found = g.shortest_path(spark.createDataFrame(pairs, "start string, end string"), *small, **options)
    return {(r.start, r.end): (r.path, r.weight) for r in found.collect()}


def test_shortest_path(spark, small):
    got = paths(spark, small, [("c1", "fl1"), ("c1", "v1"), ("c1", "c2"), ("c1", "c1"), ("c1", "gone"), ("fl1", "c1")])
    assert got == {("c1", "fl1"): (["c1", "r1", "f1", "v1", "fl1"], 4), ("c1", "v1"): (["c1", "r1", "f1", "v1"], 3), ("c1", "c1"): (["c1"], 0), ("fl1", "c1"): (["fl1", "v1", "f1", "r1", "c1"], 4)}
    assert paths(spark, small, [("c1", "v1")], types=["country_region", "region_farm"]) == {}
    assert paths(spark, small, [("c1", "fl1")], max_depth=3) == {}
    edges = small[0].union(spark.createDataFrame([("shortcut", "fl1", "r1")], small[0].schema))
    found = g.shortest_path(spark.createDataFrame([("c1", "fl1")], "start string, end string"), edges, small[1])
    assert found.first().weight == 2
    assert [(r.step, r.src_id, r.dst_id, r.edge_type) for r in g.path_rows(found, edges).orderBy("step").collect()] == [(0, "c1", "r1", "country_region"), (1, "fl1", "r1", "shortcut")]


def test_induced(spark):
    nodes = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1), ("d", 2)], "id string, depth int")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d")], "src_id string, dst_id string")
    kept, inside = g.induced(nodes, edges, 2, pinned="d")
    assert {r.id for r in kept.collect()} == {"a", "b", "d"} and [tuple(r) for r in inside.collect()] == [("a", "b")]


def test_foreign_keys(spark):
    farms = spark.createDataFrame([("f1", "r1"), ("f2", "r1"), ("f3", "r3"), ("orphan", None)], "farm string, region string")
    for _ in range(2):
        assert {r.id for r in g.edges_from_fk(farms, "region", "farm", "rf").collect()} == {"rf:r1:f1", "rf:r1:f2", "rf:r3:f3"}


def test_catalog(spark):
    assert len(set(g.EDGE_TYPES)) == 20
    tables = {f"edges_{k}": spark.createDataFrame([("x", "y"), ("x", "y"), (None, "y")], f"{g.ID_OF.get(k.split('_', 1)[0], k.split('_', 1)[0] + '_id')} string, {g.ID_OF.get(k.split('_', 1)[1], k.split('_', 1)[1] + '_id')} string") for k in g.EDGE_TYPES}
    got = g.catalog_edges(tables)
    assert got.count() == 20
    ends = {r.edge_type: (r.src_type, r.dst_type) for r in got.collect()}
    assert ends["product_roast"] == ("product", "roast_profile") and ends["variety_processing"] == ("variety", "processing")
    with pytest.raises(ValueError):
        g.catalog_edges({})


def test_path_budget(spark):
    edges = spark.createDataFrame([("a", f"n{i}", "t") for i in range(9)] + [("n0", "z", "t"), ("p", "q", "t"), ("lone", "lone2", "t")], "src_id string, dst_id string, edge_type string")
    vertices = spark.createDataFrame([(x,) for x in ["a", "z", "p", "q", "lone", "lone2", *(f"n{i}" for i in range(9))]], "id string")
    pairs = spark.createDataFrame([("n8", "z"), ("p", "q"), ("a", "lone")], 'start string, end string')
    whole = {(r.start, r.end): r.path for r in g.shortest_path(pairs, edges, vertices).collect()}
    assert whole == {("n8", "z"): ["n8", "a", "n0", "z"], ("p", "q"): ["p", "q"]}
    cut = {(r.start, r.end): (r.weight, r.truncated) for r in g.shortest_path(pairs, edges, vertices, max_visited=6).collect()}
    assert cut == {("p", "q"): (1, False), ("a", "lone"): (None, True)} | ({("n8", "z"): (3, False)} if ("n8", "z") in cut and cut["n8", "z"][0] else {("n8", "z"): (None, True)})


def test_similarity_edges(spark):
    e = lambda *at: [1.0 if i in at else 0.0 for i in range(8)]
    varieties = spark.createDataFrame([(1, e(0)), (2, None)], "id long, vec array<float>")
    flavors = spark.createDataFrame([(10, e(0)), (11, e(0, 1)), (12, e(7)), (13, None), (14, e())], "id long, vec array<float>")
    found = lambda k, thr: {(r.a_id, r.b_id): round(r.strength, 4) for r in g.edges_from_similarity(varieties, flavors, "id", "id", "vec", k, thr).collect()}
    assert found(2, 0.0) == {(1, 10): 1.0, (1, 11): 0.7071}
    assert found(10, 0.9) == {(1, 10): 1.0}
    assert len(found(10, None)) == 3


def test_similarity_blocks_and_ties(spark, monkeypatch):
    from graphloom.functions import vectors

    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "id long, vec array<float>")
    whole = set(map(tuple, vectors.similarity_join(rows, rows, "id", "id", "vec", None, 4, exclude_self=True).collect()))
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 100)
    assert set(map(tuple, vectors.similarity_join(rows, rows, "id", "id", "vec", None, 4, exclude_self=True).collect())) == whole and len(whole) == 120


PRODUCTS = [("p1", "Ethiopia Yirgacheffe Gesha", "ro-verve", "light", "Fruity notes of jasmine and honey"), ("p2", "Colombia Bourbon La Esperanza", "ro-verve", None, "Bright cherry from various Konga lots")]


def test_product_edges(spark):
    products = spark.createDataFrame(PRODUCTS, "id string, name string, roaster_id string, roast_level string, description string")
    docs = products.select("id", F.concat_ws(" ", "name", "description").alias("text"))
    names = lambda rows: spark.createDataFrame(rows, "id string, name string")
    pairs = lambda df: {(r.doc_id, r.entity_id) for r in df.collect()}
    assert pairs(j.mention_join(docs, names([("c-et", "Ethiopia"), ("c-co", "Colombia")]))) == {("p1", "c-et"), ("p2", "c-co")}
    farms = names([("fa-esp", "La Esperanza"), ("fa-var", "Various"), ("fa-kon", "Konga")])
    assert pairs(j.mention_join(docs, farms, min_length=6, stop=["various"])) == {("p2", "fa-esp")}
    varieties = names([("v-ge", "Geisha"), ("v-bo", "Bourbon")])
    assert pairs(j.mention_join(docs, varieties, min_length=3, aliases={"geisha": ["gesha"]})) == {("p1", "v-ge"), ("p2", "v-bo")}
    flavors = names([("f-jasmine", "Jasmine"), ("f-honey", "Honey"), ("f-cherry", "Cherry")])
    assert pairs(j.mention_join(products.select("id", F.col("description").alias("text")), flavors, stop=["honey"])) == {("p1", "f-jasmine"), ("p2", "f-cherry")}
    shops = spark.createDataFrame([("s-match", "https://vervecoffee.com/pages/sf"), ("s-other", "https://example.com"), ("s-blank", " ")], "id string, website string")
    roasters = spark.createDataFrame([("ro-verve", "HTTPS://www.vervecoffee.com")], "id string, website string")
    made = products.select("roaster_id", F.col("id").alias("product_id"))
    kinds = {"shop_variety": (spark.createDataFrame([("p1", "v-ge"), ("p2", "v-bo")], "product_id string, variety_id string"), "variety_id"), "shop_farm": (spark.createDataFrame([("p2", "fa-esp")], "product_id string, farm_id string"), "farm_id")}
    out = g.edges_from_chain(shops, roasters, made, kinds)
    assert {k: df.count() for k, df in out.items()} == {"shop_roaster": 1, "shop_product": 2, "shop_variety": 2, "shop_farm": 1}
    levels = spark.createDataFrame([("rpf-L", "Light")], "id string, level string")
    assert j.ijoin(products, levels.withColumnRenamed("id", "profile_id"), "roast_level", "level").count() == 1


def test_mentions_with_signs(spark):
    docs = spark.createDataFrame([("1", "Lot of Sl-28, washed"), ("2", "sl 28 natural"), ("3", "Sl-281")], "id string, text string")
    names = spark.createDataFrame([("v", "SL-28")], "id string, name string")
    assert [r.doc_id for r in j.mention_join(docs, names).collect()] == ["1"]


def test_rules(spark):
    rules = spark.createDataFrame([("a", ["Arabica"], 1500), ("b", ["arabica", "robusta"], None), ("c", [], None)], "id string, species array<string>, min_altitude int")
    plants = spark.createDataFrame([("x", "arabica", 1600), ("y", "Arabica", 1200), ("z", "Robusta", None), ("n", "arabica", None)], "id string, species string, altitude_max int")
    assert {(r.rule_id, r.entity_id) for r in j.rule_join(rules, plants).collect()} == {("a", "x"), ("b", "x"), ("b", "y"), ("b", "z"), ("b", "n")}


def test_curation(spark):
    relations = spark.createDataFrame([("washed", ["Floral", "Unknown"], ["Fermented"])], "category string, enhances array<string>, diminishes array<string>")
    methods = spark.createDataFrame([("m1", "Washed"), ("m2", "washed"), ("m3", "natural")], "id string, category string")
    flavors = spark.createDataFrame([("z-leaf", "floral", "p"), ("top", "Floral", None), ("f2", "fermented", "p")], "id string, name string, parent_id string")
    edges, missing = g.edges_from_curation(relations, methods, flavors)
    assert {tuple(r) for r in edges.collect()} == {("m1", "top", "enhances"), ("m2", "top", "enhances"), ("m1", "f2", "diminishes"), ("m2", "f2", "diminishes")}
    assert [r.name for r in missing.collect()] == ["Unknown"]


def test_similar_items(spark):
    flat, near, far = [1.0] * 8, [0.99] * 8, [1.0, -1.0] * 4
    items = spark.createDataFrame([(1, "s", flat), (2, "near", near), (3, "far", far), (4, "graph", None)], "id long, label string, embedding array<float>")
    notes = spark.createDataFrame([(1, "f1"), (1, "f2"), (4, "f1"), (4, "f2"), (2, "f1")], "item long, flavor string")
    edges = {"flavor note": [(notes, "item", "flavor")]}
    got = search.similar(items, edges).collect()
    mine = sorted((r for r in got if r.seed == 1), key=lambda r: -r.score)
    assert [r.label for r in mine] == ["near", "graph", "far"]
    assert {r.label: r.reason for r in mine} == {"near": "Shares 1 flavor note", "graph": "Shares 2 flavor notes", "far": None}
    # a seed without a vector ranks by shared neighbours alone, over the most it shares with one peer
    assert {r.id: r.score for r in got if r.seed == 4} == {1: 1.0, 2: 0.5}
    hidden = search.similar(items, edges, visible=F.col("id") != 4, seeds=items.where("id = 1")).collect()
    assert {r.id: r.score for r in hidden} == {2: 1.25, 3: 0.0}  # the most shared is still that of the hidden peer


def test_hidden_peers_take_no_place(spark):
    # 60 hidden neighbours are nearer than the 5 visible ones
    rows = [(0, "seed", [1.0, 0.0])] + [(i, "hidden", [1.0, i / 1000]) for i in range(1, 61)] + [(100 + i, "shown", [1.0, 0.5 + i / 10]) for i in range(5)]
    items = spark.createDataFrame(rows, "id long, label string, embedding array<float>")
    none = {"flavor note": [(spark.createDataFrame([], "item long, flavor string"), "item", "flavor")]}
    got = search.similar(items, none, seeds=items.where("id = 0"), visible=F.col("label") == "shown").collect()
    assert sorted(r.id for r in got) == [100, 101, 102, 103, 104]
    # the one saved item is hidden, and still says what its user likes
    saved = spark.createDataFrame([(7, 1)], "user_id long, entity_id long")
    got = search.for_user(saved, items, 2, visible=F.col("label") == "shown").orderBy(F.desc("score")).collect()
    assert [(r.id, r.reason) for r in got] == [(100, "Based on 1 item you saved"), (101, "Based on 1 item you saved")]


def test_reason_of_ties_keeps_the_configured_order(spark):
    items = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.1])], "id long, label string, embedding array<float>")
    both = lambda *n: spark.createDataFrame([(i, x) for i in (1, 2) for x in n], "item long, other string")
    edges = {"variety": [(both("v"), "item", "other")], "flavor note": [(both("f"), "item", "other")], "origin": [(both("o"), "item", "other")], "roast profile": [(both("p"), "item", "other")]}
    assert search.similar(items, edges, seeds=items.where("id = 1")).first().reason == "Shares 1 variety, 1 flavor note, 1 origin"
    edges["roast profile"] = [(both("p", "q"), "item", "other")]
    assert search.similar(items, edges, seeds=items.where("id = 1")).first().reason == "Shares 2 roast profiles, 1 variety, 1 flavor note"


def test_heavy_neighbours(spark, monkeypatch):
    from graphloom.operators import joins

    edges = spark.createDataFrame([(i, "hub") for i in range(300)] + [(i, f"n{i % 7}") for i in range(60)] + [(1, "hub"), (2, None), (None, "hub")], "m long, n string")
    of = lambda: Counter(tuple(r) for r in j.peers(edges, "m", "n").collect())
    whole = of()
    assert whole["hub", 1, 2] == 0 and whole[1, 2, "hub"] == 1 and sum(v for k, v in whole.items() if k[2] == "hub") == 300 * 299
    counts = {tuple(r) for r in overlap({"x": [(edges, "m", "n")]}).collect()}
    monkeypatch.setattr(joins, "MEMBERS", 40)
    assert of() == whole and {tuple(r) for r in overlap({"x": [(edges, "m", "n")]}).collect()} == counts
    # no key of the join is larger than a block or two on either side
    plan = joins.member_pairs(joins.member_edges(edges, "m", "n"))
    assert plan.groupBy("neighbour").count().where("neighbour = 'hub'").first()["count"] == 300 * 299 // 2


def test_mentions_follow_their_words(spark):
    texts = ["new york new york city", "york new", "a Côte d'Or, côte", "city of new new york", "", None, "SL-28 and sl 28", "the the the", "long " + "x " * 50 + "name at the end of it"]
    names = ["New York", "New York City", "new new york", "Côte d'Or", "côte", "SL-28", "the the", "name at the end of it", "not there", "city city"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, "again york new york")], "id long, text string")
    table = spark.createDataFrame([(n, n) for n in names] + [("the the", "the the")], "id string, name string")
    want = set()
    for i, t in [*enumerate(texts), (0, "again york new york")]:
        for n in names:
            if t is not None and re.search(r"(^|\W)" + re.escape(n.lower()) + r"(\W|$)", t.lower()):
                want.add((i, n))
    assert {tuple(r) for r in j.mention_join(docs, table, min_length=3).collect()} == want and (2, "Côte d'Or") in want


def least_paths(edges, pairs, depth):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for start, end in pairs:
        level, seen = [(start,)], {start}
        for weight in range(depth + 1):
            hits = [p for p in level if p[-1] == end]
            if hits:
                out[start, end] = (list(min(hits)), weight)
                break
            fresh = {}
            for p in level:
                for n in near.get(p[-1], ()):
                    if n not in seen and (n not in fresh or p + (n,) < fresh[n]):
                        fresh[n] = p + (n,)
            seen |= set(fresh)
            level = list(fresh.values())
    return out


def test_shortest_paths_are_the_least(spark):
    rng = random.Random(2)
    for n, m in ((30, 40), (40, 44), (12, 30)):
        nodes = [f"{rng.choice('abc')}{i}" for i in range(n)]
        edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(m)]
        pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(60)]
        frame = spark.createDataFrame([(a, b, "t") for a, b in edges], "src_id string, dst_id string, edge_type string")
        vertices = spark.createDataFrame([(x,) for x in nodes], "id string")
        for depth in (6, 3):
            found = g.shortest_path(spark.createDataFrame(pairs, "start string, end string"), frame, vertices, depth)
            assert {(r.start, r.end): (r.path, r.weight) for r in found.collect()} == least_paths(edges, pairs, depth)


def test_similarity_blocks_are_skipped(spark, monkeypatch):
    import numpy as np
    from graphloom.functions import vectors

    rng = np.random.default_rng(0)
    centres = np.eye(16)[rng.permutation(16)]
    rows = [(i, [float(v) for v in centres[i % 16] + rng.normal(size=16) / 40]) for i in range(800)] + [(900, [0.0] * 16), (901, None)]
    df = spark.createDataFrame(rows, "id long, vec array<float>").repartition(8)
    joined = lambda **o: {(r.a_id, r.b_id): round(r.similarity, 9) for r in vectors.similarity_join(df, df, "id", "id", "vec", exclude_self=True, **o).collect()}
    cases = [{"threshold": 0.8}, {"k": 5}, {"threshold": 0.97, "k": 3}, {"threshold": -1.0, "k": 60}]
    whole = [joined(**c) for c in cases]
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 50 * 16 * 8)
    monkeypatch.setattr(vectors, "LEFT_ROWS", 50)
    assert [joined(**c) for c in cases] == whole and len(whole[0]) > 800 * 40
    read, passed = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    joined(threshold=0.8, counts=(read, passed))
    assert read.value + passed.value > 0 and passed.value > 3 * read.value


def test_personal_feed(spark):
    items = spark.createDataFrame([(1, "p1", [1.0] * 8), (2, "p2", [0.98] * 8), (3, "p3", [1.0, -1.0] * 4)], "id long, label string, embedding array<float>")
    activity = spark.createDataFrame([(7, 1), (7, 1)], "user_id long, entity_id long")
    got = search.for_user(activity, items).orderBy(F.desc("score")).collect()
    assert [r.id for r in got] == [2, 3] and got[0].reason == "Based on 1 item you saved"
    assert search.for_user(activity.unionByName(activity.selectExpr("user_id", "2L as entity_id")), items, noun="variety").collect()[0].reason == "Based on 2 varieties you saved"
    words = spark.createDataFrame([([("country", 2), ("region", 1)],), ([("variety", 1)],), ([],)], "counts array<struct<label:string,shared:long>>")
    assert [r.r for r in words.select(search.reason(F.col("counts")).alias("r")).collect()] == ["Shares 2 countries, 1 region", "Shares 1 variety", None]
    assert search.for_user(activity.limit(0), items).count() == 0


def test_text_search(spark):
    varieties = spark.createDataFrame([("v1", "Geisha", "Floral aromatic", "Arabica"), ("v4", "Nemaya", "Floral hardy", "Robusta"), ("v2", "100% SL", None, "Arabica")], "id string, label string, description string, species string")
    flavors = spark.createDataFrame([("f1", "Floral", None)], "id string, label string, description string")
    found = lambda q, **o: [r.id for r in search.text_search([("variety", varieties), ("flavor", flavors)], q, **o).collect()]
    assert found("floral") == ["v1", "v4", "f1"]
    assert found("floral", types=["flavor"]) == ["f1"]
    assert found("floral", types=["variety"], where={"variety": F.col("species") == "Robusta"}) == ["v4"]
    assert found("%") == ["v2"] and found("0_") == []


def test_embedding_backfill(spark):
    rows = [("a", "x", None, None), ("b", "y", "d", [9.0] * 8)]
    df = spark.createDataFrame(rows, "id string, name string, description string, embedding array<float>")
    got = {r.id: r.embedding for r in search.embed_missing(df, search.HashEmbedder(8), 8).collect()}
    assert len(got["a"]) == 8 and got["b"] == [9.0] * 8
    tables = {"one": df, "two": df}
    out = search.embed_tables(tables, search.HashEmbedder(8), 8, opt_in=["two"])
    assert out["two"] is df and out["one"].where("embedding is null").count() == 0
    with pytest.raises(ValueError):
        search.embed_tables(tables, search.HashEmbedder(8), 8, targets=["three"])
    with pytest.raises(Exception, match="8 numbers"):
        search.embed_missing(df, search.HashEmbedder(4), 8).collect()
