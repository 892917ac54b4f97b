"""Registered queries against their SQL on small tables made to be odd."""

import duckdb
from graphloom.plans import registry

from .test_queries import plain


def agrees(spark, folder, name, **tables):
    """The query's rows, which are those of its SQL; tables: name -> DataFrame, each written as one file."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = registry.QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)
    return got


CUT = ["Fish &amp; chips of the old harbour &amp", "&copy; Somebody and &quot;others&quot; &am", "A title that has nothing cut in it", "Rods &amp;&amp;&amp of the &middot; middle"]


def cut_pages(spark):
    return spark.createDataFrame([(i, f"https://a.example/{i}", f"<title>{t}</title><p>{t}</p>") for i, t in enumerate(CUT, 1)], "page_id long, url string, html string")


def test_text_of_pages_cut_inside_a_reference(spark, tmp_path):
    agrees(spark, tmp_path, "f22_html_text", pages=cut_pages(spark))


def test_descriptions_cut_inside_a_reference(spark, tmp_path):
    agrees(spark, tmp_path, "f24_descriptions", pages=cut_pages(spark))


def exchanged(df):
    """Records that the shuffles of a query write: its rows are made on the way."""
    df.collect()

    def walk(node, seen):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan(), seen)
        if kind in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec"):
            return walk(node.plan(), seen)
        own, metrics = 0, node.metrics()
        if kind == "ShuffleExchangeExec" and node.id() not in seen:
            seen.add(node.id())
            own = metrics.apply("shuffleRecordsWritten").value()
        children = node.children()
        return own + sum(walk(children.apply(i), seen) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan(), set())


def one_host(spark, n):
    return spark.range(1, n + 1).selectExpr("id AS page_id", "concat('https://', if(id % 50 = 0, 'b', 'a'), '.example/', id) AS url")


def test_chain_over_one_host(spark, tmp_path, monkeypatch):
    from graphloom.operators import joins

    monkeypatch.setattr(joins, "BLOCK", 70, raising=False)
    part = spark.range(500).selectExpr("id AS p_partkey", "concat('Brand#', id % 3) AS p_brand")
    agrees(spark, tmp_path, "g9_chain", pages=one_host(spark, 600), part=part)
    # some 84,000 pairs of shops and roasters and as many of shops and products are not shuffled
    assert exchanged(registry.QUERIES["g9_chain"](spark, str(tmp_path))) < 60_000


def test_chain_of_ids_with_several_domains(spark):
    from graphloom.operators import graph

    shops = spark.createDataFrame([("1", "https://a.example"), ("1", "https://b.example/x"), ("2", "b.example"), (None, "a.example"), ("3", " "), ("4", None)], "id string, website string")
    roasters = spark.createDataFrame([("r", "a.example"), ("r", "b.example"), ("q", "b.example"), (None, "b.example")], "id string, website string")
    made = spark.createDataFrame([("r", "p"), ("q", "p"), ("q", "o"), (None, "n")], "roaster_id string, product_id string")
    out = graph.edges_from_chain(shops, roasters, made, {"shop_kind": (spark.createDataFrame([("p", "k"), ("o", "k")], "product_id string, kind string"), "kind")})
    rows = {k: sorted((tuple(r) for r in df.collect()), key=str) for k, df in out.items()}
    assert rows["shop_roaster"] == sorted([("1", "r"), ("1", "q"), ("1", None), ("2", "r"), ("2", "q"), ("2", None), (None, "r")], key=str)
    assert rows["shop_product"] == sorted([("1", "p"), ("1", "o"), ("2", "p"), ("2", "o"), (None, "p")], key=str)
    assert rows["shop_kind"] == sorted([("1", "k"), ("2", "k"), (None, "k")], key=str)


def test_domain_join_over_one_host(spark, tmp_path, monkeypatch):
    from graphloom.operators import joins

    monkeypatch.setattr(joins, "BLOCK", 70, raising=False)
    agrees(spark, tmp_path, "j6_domain_join", pages=one_host(spark, 600))
    # 84,006 pairs
    df = registry.QUERIES["j6_domain_join"](spark, str(tmp_path))
    assert exchanged(df) < 20_000
    assert df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(bool).count() > 2


def deliveries(spark, tmp_path):
    """A supplier table of few nations, and lineitems of which many repeat a part and supplier, with nulls."""
    supplier = spark.range(300).selectExpr("id AS s_suppkey", "cast(id % 4 AS int) AS s_nationkey")
    lineitem = spark.range(6000).selectExpr("if(id % 97 = 0, null, id * 7919 % 90) AS l_suppkey", "if(id % 89 = 0, null, if(id % 3 = 0, 1, id * 31 % 60)) AS l_partkey")
    return {"supplier": supplier, "lineitem": lineitem}


def test_overlap_in_blocks(spark, tmp_path, monkeypatch):
    from graphloom.operators import joins

    monkeypatch.setattr(joins, "MEMBERS", 70)
    agrees(spark, tmp_path, "a4_overlap", **deliveries(spark, tmp_path))
    # 22,200 rows of pairs of suppliers of one nation alone, and 8,010 of a part
    assert exchanged(registry.QUERIES["a4_overlap"](spark, str(tmp_path))) < 10_000


def test_overlap_of_several_tables_of_a_label(spark):
    from graphloom.operators.aggregates import overlap

    first = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("a", 2)], "m string, n long")
    second = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "1"), (None, "1"), ("c", None)], "m string, n string")
    edges = {"x": [(first, "m", "n"), (second, "m", "n")], "y": [(second, "m", "n")]}
    both = [("a", "b", "x", 2), ("a", "b", "y", 1), ("a", "c", "x", 1), ("b", "a", "x", 2), ("b", "a", "y", 1), ("c", "a", "x", 1)]
    assert sorted(tuple(r) for r in overlap(edges).collect()) == both
    assert sorted(tuple(r) for r in overlap(edges, spark.createDataFrame([("a",)], "id string")).collect()) == both[:3]


def test_peers_in_blocks(spark, tmp_path, monkeypatch):
    from graphloom.operators import joins

    monkeypatch.setattr(joins, "MEMBERS", 70)
    agrees(spark, tmp_path, "j4_peers", **deliveries(spark, tmp_path))
    # each of 4,005 pairs of suppliers shares several parts
    assert exchanged(registry.QUERIES["j4_peers"](spark, str(tmp_path))) < 300


def test_similar_by_blocks(spark, tmp_path, monkeypatch):
    from graphloom.operators import joins

    monkeypatch.setattr(joins, "MEMBERS", 70)
    tables = deliveries(spark, tmp_path)
    # suppliers 250 and up have no vector
    tables["supplier"] = tables["supplier"].selectExpr("*", "concat('S', s_suppkey) AS s_name")
    vectors = spark.range(250).selectExpr("id AS vec_id", "transform(sequence(1, 6), i -> cast((id * id * 37 + i * i * 13 + id * i * i * 7) % 1009 - 500 AS float)) AS embedding", "cast(id % 10 AS int) AS label")
    agrees(spark, tmp_path, "r3_similar", embeddings=vectors, **tables)
    # 30,000 rows of pairs of suppliers that share something
    assert exchanged(registry.QUERIES["r3_similar"](spark, str(tmp_path))) < 40_000


def tasks_of(df):
    """Tasks that make some of the rows."""
    return df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(bool).count()


def test_distances_in_one_nation(spark, tmp_path, monkeypatch):
    from graphloom.operators import joins

    monkeypatch.setattr(joins, "BLOCK", 20, raising=False)
    one = lambda n, key, nation: spark.range(n).selectExpr(f"id * 7 AS {key}", f"cast(if(id % 50 = 9, null, 4) AS int) AS {nation}")
    agrees(spark, tmp_path, "f21_distance", customer=one(150, "c_custkey", "c_nationkey"), supplier=one(120, "s_suppkey", "s_nationkey"))
    assert tasks_of(registry.QUERIES["f21_distance"](spark, str(tmp_path))) > 2


def test_nearby_in_one_cell(spark, monkeypatch):
    from graphloom.functions import geo
    from graphloom.operators import joins

    monkeypatch.setattr(joins, "BLOCK", 20, raising=False)
    places = spark.range(0, 150, 1, 1).selectExpr("id", "10 + id / 1e4 AS lat", "20 + id / 1e4 AS lon")
    found = geo.nearby(places, places.withColumnRenamed("id", "query_id"), 700)
    assert found.count() == 150 * 150 and found.where("query_id = id and distance_km > 1e-3").count() == 0
    assert tasks_of(found) > 2


def test_names_of_many_rows_join_in_several_tasks(spark, tmp_path, monkeypatch):
    from graphloom.operators import joins

    monkeypatch.setattr(joins, "BLOCK", 40, raising=False)
    part = spark.range(300).selectExpr("id AS p_partkey", "if(id % 40 = 3, null, if(id % 2 = 0, 'Brand#3', 'brand#4')) AS p_brand")
    agrees(spark, tmp_path, "j8_ijoin", part=part, supplier=spark.range(900).selectExpr("id AS s_suppkey"))
    assert tasks_of(registry.QUERIES["j8_ijoin"](spark, str(tmp_path))) > 2
    tagged = spark.createDataFrame([("A", {"x": 1}), (None, None)], "name string, tags map<string,int>")
    assert [tuple(r) for r in joins.ijoin(tagged, spark.createDataFrame([("a", 5)], "other string, n int"), "name", "other").select("name", "n").collect()] == [("A", 5)]
