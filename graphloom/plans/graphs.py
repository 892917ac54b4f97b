"""Queries of graph building and traversal, search, recommendation and composed jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import graph as g
from ..operators import jobs, merge, search
from ..operators import joins as j
from .relational import DOMAIN_SQL, HOST_SQL, OVERLAP_SQL, RULES_SQL, rules, supplier_edges
from .scalar import COS_SQL, NS, VEC_SQL
from .tables import Tables, placed_sql, query

# the supply graph: regions, nations, suppliers and the parts they delivered
EDGES_SQL = (
    "e AS (SELECT DISTINCT 'r' || n_regionkey AS src_id, 'n' || n_nationkey AS dst_id, 'region_nation' AS edge_type FROM nation"
    " UNION ALL SELECT DISTINCT 'n' || s_nationkey, 's' || s_suppkey, 'nation_supplier' FROM supplier"
    " UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 'supplier_part' FROM lineitem)"
)
LINKS_SQL = "a AS (SELECT DISTINCT src_id AS node, dst_id AS other FROM e UNION SELECT dst_id, src_id FROM e)"


def supply_edges(t: Tables) -> DataFrame:
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    parts = [
        g.typed_edges(t.nation.select(named("r", "n_regionkey").alias("a"), named("n", "n_nationkey").alias("b")), "region_nation", "a", "region", "b", "nation"),
        g.typed_edges(t.supplier.select(named("n", "s_nationkey").alias("a"), named("s", "s_suppkey").alias("b")), "nation_supplier", "a", "nation", "b", "supplier"),
        g.typed_edges(t.lineitem.select(named("s", "l_suppkey").alias("a"), named("p", "l_partkey").alias("b")), "supplier_part", "a", "supplier", "b", "part"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def supply_vertices(t: Tables) -> DataFrame:
    kinds = {"region": (t.region, "r", "r_regionkey", "r_name"), "nation": (t.nation, "n", "n_nationkey", "n_name"), "supplier": (t.supplier, "s", "s_suppkey", "s_name"), "part": (t.part, "p", "p_partkey", "p_name")}
    return j.union_as({k: df.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.col(label).alias("label")) for k, (df, p, key, label) in kinds.items()}, "entity_type")


@query("g1_adjacency", f"WITH {EDGES_SQL} SELECT node, count(*) AS degree FROM (SELECT src_id AS node FROM e WHERE edge_type <> 'region_nation' UNION ALL SELECT dst_id FROM e WHERE edge_type <> 'region_nation') GROUP BY node")
def _(t: Tables) -> DataFrame:
    return g.adjacency(supply_edges(t), supply_vertices(t), ["nation_supplier", "supplier_part"]).groupBy("node").agg(F.count("*").alias("degree"))


@query("g1_catalog", "SELECT DISTINCT 'country' AS src_type, CAST(n_regionkey AS VARCHAR) AS src_id, 'region' AS dst_type, CAST(n_nationkey AS VARCHAR) AS dst_id, 'country_region' AS edge_type, NULL AS weight, NULL AS effect FROM nation UNION ALL SELECT DISTINCT 'shop', CAST(l_suppkey AS VARCHAR), 'product', CAST(l_partkey AS VARCHAR), 'shop_product', NULL, NULL FROM lineitem UNION ALL SELECT DISTINCT 'processing', p_type, 'flavor', CAST(p_partkey AS VARCHAR), 'processing_flavor', CAST(p_size AS DOUBLE), p_brand FROM part UNION ALL SELECT DISTINCT 'product', CAST(p_partkey AS VARCHAR), 'roast_profile', p_type, 'product_roast', NULL, NULL FROM part")
def _(t: Tables) -> DataFrame:
    tables = {
        "edges_country_region": t.nation.select(F.col("n_regionkey").alias("country_id"), F.col("n_nationkey").alias("region_id")),
        "edges_shop_product": t.lineitem.select(F.col("l_suppkey").alias("shop_id"), F.col("l_partkey").alias("product_id")),
        "processing_flavor": t.part.select(F.col("p_type").alias("method_id"), F.col("p_partkey").alias("flavor_id"), F.col("p_size").alias("weight"), F.col("p_brand").alias("effect")),
        "edges_product_roast": t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("profile_id")),
    }
    return g.catalog_edges(tables).select("src_type", "src_id", "dst_type", "dst_id", "edge_type", "weight", "effect")


SEEDS_SQL = "SELECT 'n' || n_nationkey AS seed FROM nation"


def seeds(t: Tables) -> DataFrame:
    return t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("seed"))


@query("g2_traverse", f"WITH RECURSIVE {EDGES_SQL}, {LINKS_SQL}, w AS (SELECT seed, seed AS node, 0 AS depth FROM ({SEEDS_SQL}) UNION SELECT w.seed, a.other, w.depth + 1 FROM w JOIN a ON w.node = a.node WHERE w.depth < 3) SELECT seed, node AS id, min(depth) AS depth FROM w GROUP BY seed, node")
def _(t: Tables) -> DataFrame:
    nodes, _, _ = g.traverse(seeds(t), supply_edges(t), supply_vertices(t), 3, max_nodes=None, max_edges=None)
    return nodes.select("seed", "id", "depth")


@query("g2_traverse_edges", f"WITH RECURSIVE {EDGES_SQL}, {LINKS_SQL}, w AS (SELECT seed, seed AS node, 0 AS depth FROM ({SEEDS_SQL}) UNION SELECT w.seed, a.other, w.depth + 1 FROM w JOIN a ON w.node = a.node WHERE w.depth < 1) SELECT DISTINCT seed, src_id, dst_id, edge_type FROM w JOIN e ON w.node = e.src_id OR w.node = e.dst_id")
def _(t: Tables) -> DataFrame:
    return g.traverse(seeds(t), supply_edges(t), supply_vertices(t), 2, max_nodes=None, max_edges=None)[1]


ALL_SEEDS_SQL = SEEDS_SQL


all_seeds = seeds


@query("g2_traverse_all", f"WITH RECURSIVE {EDGES_SQL}, {LINKS_SQL}, w AS (SELECT seed, seed AS node, 0 AS depth FROM ({ALL_SEEDS_SQL}) UNION SELECT w.seed, a.other, w.depth + 1 FROM w JOIN a ON w.node = a.node WHERE w.depth < 2) SELECT seed, node AS id, min(depth) AS depth FROM w GROUP BY seed, node")
def _(t: Tables) -> DataFrame:
    nodes, _, _ = g.traverse(all_seeds(t), supply_edges(t), supply_vertices(t), 2, max_nodes=None, max_edges=None)
    return nodes.select("seed", "id", "depth")


@query("g2_traverse_edges_all", f"WITH RECURSIVE {EDGES_SQL}, {LINKS_SQL}, w AS (SELECT seed, seed AS node, 0 AS depth FROM ({ALL_SEEDS_SQL}) UNION SELECT w.seed, a.other, w.depth + 1 FROM w JOIN a ON w.node = a.node WHERE w.depth < 1) SELECT DISTINCT seed, src_id, dst_id, edge_type FROM w JOIN e ON w.node = e.src_id OR w.node = e.dst_id")
def _(t: Tables) -> DataFrame:
    return g.traverse(all_seeds(t), supply_edges(t), supply_vertices(t), 2, max_nodes=None, max_edges=None)[1]


@query("g2_budgets", f"WITH RECURSIVE {EDGES_SQL}, {LINKS_SQL}, w AS (SELECT seed, seed AS node, 0 AS depth FROM ({SEEDS_SQL}) UNION SELECT w.seed, a.other, w.depth + 1 FROM w JOIN a ON w.node = a.node WHERE w.depth < 2), d AS (SELECT seed, node, min(depth) AS depth FROM w GROUP BY seed, node), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS r FROM d) SELECT seed, count(*) > 40 AS truncated, count_if(r <= 40) AS nodes, max(node) FILTER (WHERE r <= 40) AS last FROM r GROUP BY seed")
def _(t: Tables) -> DataFrame:
    nodes, _, cut = g.traverse(seeds(t), supply_edges(t), supply_vertices(t), 2, max_nodes=40, max_edges=None)
    return nodes.groupBy("seed").agg(F.count("*").alias("nodes"), F.max("id").alias("last")).join(cut, "seed")


@query("g3_shortest_path", f"WITH RECURSIVE {EDGES_SQL}, {LINKS_SQL}, q AS (SELECT 'p' || p_partkey AS s, 'p' || (p_partkey + 1) AS z FROM part WHERE p_partkey % 20 = 0 UNION ALL SELECT 's' || s_suppkey, 's' || s_suppkey FROM supplier), w AS (SELECT s, s AS node, 0 AS depth FROM q UNION SELECT w.s, a.other, w.depth + 1 FROM w JOIN a ON w.node = a.node WHERE w.depth < 6), d AS (SELECT s, node, min(depth) AS weight FROM w GROUP BY s, node) SELECT q.s AS \"start\", q.z AS \"end\", weight FROM q JOIN d ON d.s = q.s AND d.node = q.z")
def _(t: Tables) -> DataFrame:
    part = lambda k: F.concat(F.lit("p"), (F.col("p_partkey") + k).cast("string"))
    pairs = t.part.where("p_partkey % 20 = 0").select(part(0).alias("start"), part(1).alias("end"))
    same = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("start"))
    return g.shortest_path(pairs.unionByName(same.withColumn("end", F.col("start"))), supply_edges(t), supply_vertices(t)).select("start", "end", "weight")


@query("g4_path_rows", f"WITH {EDGES_SQL} SELECT 's' || s_suppkey AS \"start\", 'r' || n_regionkey AS \"end\", step, CASE step WHEN 0 THEN 'n' || n_nationkey ELSE 'r' || n_regionkey END AS src_id, CASE step WHEN 0 THEN 's' || s_suppkey ELSE 'n' || n_nationkey END AS dst_id FROM supplier JOIN nation ON s_nationkey = n_nationkey, range(2) r(step)")
def _(t: Tables) -> DataFrame:
    pairs = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("start"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("end"))
    edges = supply_edges(t).where("edge_type <> 'supplier_part'")
    return g.path_rows(g.shortest_path(pairs, edges, supply_vertices(t), 3), edges).select("start", "end", "step", "src_id", "dst_id")


@query("g5_edges_from_fk", "SELECT 'ns:' || s_nationkey || ':' || s_suppkey AS id, s_nationkey, s_suppkey FROM supplier WHERE s_nationkey <> 3")
def _(t: Tables) -> DataFrame:
    return g.edges_from_fk(t.supplier.withColumn("s_nationkey", F.when(F.col("s_nationkey") != 3, F.col("s_nationkey"))), "s_nationkey", "s_suppkey", "ns")


@query("g6_edges_from_similarity", f"WITH {VEC_SQL}, s AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, {COS_SQL} AS c FROM e a, e b WHERE a.label < 5 AND b.label >= 5), k AS (SELECT * FROM s WHERE c >= 0.1 QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY round(c, 9) DESC, b_id) <= 5) SELECT a_id, b_id, round(c, 6) AS strength FROM k")
def _(t: Tables) -> DataFrame:
    e = t.embeddings
    return g.edges_from_similarity(e.where("label < 5"), e.where("label >= 5"), "vec_id", "vec_id", "embedding", 5, 0.1).select("a_id", "b_id", F.round("strength", 6).alias("strength"))


@query("g7_cooccurrence", "SELECT 'brand_type' AS edge_type, p_brand AS a, p_type AS b FROM part WHERE p_type <> 'PROMO' GROUP BY ALL UNION ALL SELECT 'name_brand', p_name, p_brand FROM part GROUP BY p_name, p_brand")
def _(t: Tables) -> DataFrame:
    s = t.part.withColumn("p_type", F.when(F.col("p_type") != "PROMO", F.col("p_type")))
    edges = g.edges_from_cooccurrence(s, {"brand_type": ("p_brand", "p_type"), "name_brand": ("p_name", "p_brand")})
    return j.union_as({k: df.toDF("a", "b") for k, df in edges.items()}, "edge_type")


@query("g8_mentions", r"SELECT 'colour' AS edge_type, p_partkey AS doc_id, c AS entity_id FROM part JOIN (VALUES ('blue'), ('cold'), ('large')) v(c) ON regexp_matches(p_name, '\b' || c || '\b') UNION ALL SELECT 'thing', p_partkey, n FROM part JOIN (SELECT DISTINCT split_part(p_name, ' ', 2) AS n FROM part) ON length(n) >= 5 AND regexp_matches(p_name, '\b' || n || '\b')")
def _(t: Tables) -> DataFrame:
    docs = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    colours = t.part.select(F.split("p_name", " ")[0].alias("name")).where("name in ('blue', 'cold', 'large')").distinct()
    things = t.part.select(F.split("p_name", " ")[1].alias("name")).distinct()
    return g.edges_from_mentions(docs, {"colour": {"names": colours.withColumn("id", F.col("name"))}, "thing": {"names": things.withColumn("id", F.col("name")), "min_length": 5}})


@query("g9_chain", f"WITH x AS (SELECT page_id, {DOMAIN_SQL} AS d FROM pages), s AS (SELECT DISTINCT a.page_id AS shop_id, b.page_id AS roaster_id FROM x a JOIN x b ON a.d = b.d WHERE a.page_id % 2 = 0 AND b.page_id % 2 = 1), p AS (SELECT DISTINCT shop_id, p_partkey AS product_id FROM s JOIN part ON p_partkey % 250 = roaster_id) SELECT 'shop_roaster' AS edge_type, shop_id, CAST(roaster_id AS VARCHAR) AS id FROM s UNION ALL SELECT 'shop_product', shop_id, CAST(product_id AS VARCHAR) FROM p UNION ALL SELECT DISTINCT 'shop_brand', shop_id, p_brand FROM p JOIN part ON product_id = p_partkey")
def _(t: Tables) -> DataFrame:
    shops, roasters = (t.pages.where(f"page_id % 2 = {k}").select(F.col("page_id").alias("id"), F.col("url").alias("website")) for k in (0, 1))
    # ids are text before the pairs are made
    made = t.part.select((F.col("p_partkey") % 250).alias("roaster_id"), F.col("p_partkey").cast("string").alias("product_id"))
    brands = t.part.select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_brand").alias("brand"))
    out = g.edges_from_chain(shops, roasters, made, {"shop_brand": (brands, "brand")})
    return j.union_as({k: df.select("shop_id", F.col(df.columns[1]).cast("string").alias("id")) for k, df in out.items()}, "edge_type")


@query("g10_rules", f"SELECT 'rv:' || rule_id || ':' || p_partkey AS id FROM part JOIN {RULES_SQL} ON lower(p_brand) = s WHERE low IS NULL OR (p_size <> 13 AND p_size >= low)")
def _(t: Tables) -> DataFrame:
    return g.edges_from_rules(*rules(t), "rv").select("id")


@query("g11_curation", "WITH c AS (SELECT * FROM (VALUES ('small', 'BRAND#3', 'enhances'), ('small', 'brand#4', 'enhances'), ('small', 'Brand#5', 'diminishes'), ('promo', 'brand#3', 'diminishes')) v(category, name, effect)), f AS (SELECT lower(p_brand) AS n, min(p_partkey) AS id FROM part GROUP BY n) SELECT DISTINCT p_partkey AS method_id, f.id AS flavor_id, effect FROM c JOIN f ON lower(c.name) = f.n JOIN part ON lower(p_type) = category")
def _(t: Tables) -> DataFrame:
    relations = t.values([("Small", ["BRAND#3", "brand#4", "none such"], ["Brand#5"]), ("promo", [], ["brand#3"])], "category string, enhances array<string>, diminishes array<string>")
    flavors = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.lit(None).cast("long").alias("parent_id"))
    return g.edges_from_curation(relations, t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category")), flavors)[0]


@query("g12_induced", f"WITH {EDGES_SQL}, {LINKS_SQL}, d AS (SELECT 'n3' AS id, 0 AS depth UNION ALL SELECT other, 1 FROM a WHERE node = 'n3'), k AS (SELECT id FROM d ORDER BY depth, id LIMIT 3), p AS (SELECT id FROM k UNION SELECT id FROM d WHERE id = 'r3') SELECT src_id, dst_id FROM e WHERE src_id IN (SELECT id FROM p) AND dst_id IN (SELECT id FROM p)")
def _(t: Tables) -> DataFrame:
    start = t.nation.where("n_nationkey = 3").select(F.lit("n3").alias("seed"))
    nodes, edges, _ = g.traverse(start, supply_edges(t), supply_vertices(t), 1, max_nodes=None, max_edges=None)
    return g.induced(nodes.select("id", "depth"), edges, 3, "r3")[1].select("src_id", "dst_id")


@query("g13_graph_counts", f"WITH {EDGES_SQL} SELECT edge_type, count(*) AS n FROM e GROUP BY edge_type")
def _(t: Tables) -> DataFrame:
    return g.graph_counts(supply_edges(t))


@query("r1_text_search", "WITH u AS (SELECT 0 AS o, 'part' AS entity_type, CAST(p_partkey AS VARCHAR) AS id, p_name AS label FROM part WHERE contains(p_name, 'ring') OR contains(lower(p_type), 'ring') UNION ALL SELECT 1, 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE contains(lower(s_name), 'ring') UNION ALL SELECT 2, 'document', CAST(doc_id AS VARCHAR), substr(text, 1, 30) FROM documents WHERE (contains(lower(substr(text, 1, 30)), 'ring') OR contains(lower(text), 'ring'))), k AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY length(label), CAST(id AS BIGINT)) AS r FROM u) SELECT entity_type, id, label FROM k WHERE r <= 10 ORDER BY o, r LIMIT 30")
def _(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("id"), F.substring("text", 1, 30).alias("label"), F.col("text").alias("description"))
    parts = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("description"))
    suppliers = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit("").alias("description"))
    return search.text_search([("part", parts), ("supplier", suppliers), ("document", docs)], "Ring", 30)


@query("r1_text_search_all", "WITH u AS (SELECT 0 AS o, 'part' AS entity_type, CAST(p_partkey AS VARCHAR) AS id, p_name AS label FROM part WHERE contains(p_name, 'ring') OR contains(lower(p_type), 'ring') UNION ALL SELECT 1, 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE contains(lower(s_name), 'ring') UNION ALL SELECT 2, 'document', CAST(doc_id AS VARCHAR), substr(text, 1, 30) FROM documents WHERE (contains(lower(substr(text, 1, 30)), 'ring') OR contains(lower(text), 'ring'))), k AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY length(label), CAST(id AS BIGINT)) AS r FROM u) SELECT entity_type, id, label FROM k WHERE r <= 10 ORDER BY o, r LIMIT 30")
def _(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("id"), F.substring("text", 1, 30).alias("label"), F.col("text").alias("description"))
    parts = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("description"))
    suppliers = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit("").alias("description"))
    return search.text_search([("part", parts), ("supplier", suppliers), ("document", docs)], "Ring", 30)


QUERY_VECTOR = [((k * 37) % 11 - 5) / 5 for k in range(64)]


@query("r2_semantic_search", f"WITH {VEC_SQL}, q AS (SELECT {[float(x) for x in QUERY_VECTOR]}::DOUBLE[] AS v), s AS (SELECT CASE WHEN label < 3 THEN 'a' WHEN label < 6 THEN 'b' ELSE 'c' END AS entity_type, vec_id, {COS_SQL.replace('b.v', 'q.v')} AS c FROM e a, q), k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY entity_type ORDER BY c DESC, vec_id) <= 7) SELECT entity_type, CAST(vec_id AS VARCHAR) AS id, round(c, 6) AS score FROM k ORDER BY c DESC, entity_type, id LIMIT 20")
def _(t: Tables) -> DataFrame:
    rows = lambda cond: t.embeddings.where(cond).select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), "embedding")
    found = search.semantic_search([("a", rows("label < 3")), ("b", rows("label between 3 and 5")), ("c", rows("label > 5"))], QUERY_VECTOR, 20)
    return found.select("entity_type", "id", F.round("score", 6).alias("score"))


R3_SQL = OVERLAP_SQL + f""", {VEC_SQL}, z AS (SELECT vec_id, v FROM e JOIN supplier ON s_suppkey = vec_id WHERE vec_id % 9 <> 0),
n AS (SELECT a.vec_id AS seed, b.vec_id AS peer, {COS_SQL} AS c FROM z a, z b WHERE a.vec_id <> b.vec_id AND b.vec_id % 5 <> 0),
n50 AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY seed ORDER BY round(c, 9) DESC, peer) <= 50),
t AS (SELECT seed, peer, sum(shared) AS shared, 'Shares ' || string_agg(shared || ' ' || CASE WHEN shared > 1 THEN label || 's' ELSE label END, ', ' ORDER BY shared DESC, label DESC) AS reason FROM u GROUP BY seed, peer),
m AS (SELECT seed, peer, coalesce(c, 0) AS c, coalesce(shared, 0) AS shared, reason FROM n50 FULL JOIN t USING (seed, peer)),
s AS (SELECT seed, peer, reason, round(c + CASE WHEN seed % 9 = 0 OR seed NOT IN (SELECT vec_id FROM e) THEN 1.0 ELSE 0.5 END * CASE WHEN max(shared) OVER (PARTITION BY seed) > 0 THEN shared / max(shared) OVER (PARTITION BY seed) ELSE 0 END, 6) AS score FROM m),
k AS (SELECT * FROM s WHERE peer % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY score DESC, peer) <= 10) SELECT seed, peer AS id, score, reason FROM k"""


@query("r3_similar", R3_SQL)
def _(t: Tables) -> DataFrame:
    # hidden peers take no place among the nearest; the configured labels are part, then nation
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 9 != 0, F.col("embedding")).alias("embedding"))
    items = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label")).join(vectors, "id", "left")
    return search.similar(items, supplier_edges(t), 10, visible=F.col("id") % 5 != 0).select("seed", "id", "score", "reason")


@query("r4_for_user", f"WITH {VEC_SQL}, s AS (SELECT DISTINCT user_id, CAST(floor(value) AS BIGINT) AS id FROM events WHERE event_type IN ('purchase', 'click')), x AS (SELECT user_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM s JOIN e ON s.id = e.vec_id), c AS (SELECT user_id, list(m ORDER BY pos) AS v FROM (SELECT user_id, pos, avg(x) AS m FROM x GROUP BY user_id, pos) GROUP BY user_id), r AS (SELECT a.user_id, b.vec_id AS id, round({COS_SQL}, 6) AS score FROM c a, e b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = a.user_id AND s.id = b.vec_id)), k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) <= 5) SELECT user_id, id, score FROM k")
def _(t: Tables) -> DataFrame:
    activity = t.events.where("event_type in ('purchase', 'click')").select("user_id", F.floor("value").cast("long").alias("entity_id"))
    items = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), "embedding")
    return search.for_user(activity, items, 5).select("user_id", "id", "score")


@query("r4_for_user_visible", f"WITH {VEC_SQL}, s AS (SELECT DISTINCT user_id, CAST(floor(value) AS BIGINT) AS id FROM events WHERE event_type IN ('purchase', 'click')), x AS (SELECT user_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM s JOIN e ON s.id = e.vec_id), c AS (SELECT user_id, list(m ORDER BY pos) AS v FROM (SELECT user_id, pos, avg(x) AS m FROM x GROUP BY user_id, pos) GROUP BY user_id), r AS (SELECT a.user_id, b.vec_id AS id, round({COS_SQL}, 6) AS score FROM c a, e b WHERE b.label < 3 AND NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = a.user_id AND s.id = b.vec_id)), k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) <= 5) SELECT user_id, id, score, 'Based on ' || (SELECT count(*) FROM s WHERE s.user_id = k.user_id) || CASE WHEN (SELECT count(*) FROM s WHERE s.user_id = k.user_id) = 1 THEN ' item' ELSE ' items' END || ' you saved' AS reason FROM k")
def _(t: Tables) -> DataFrame:
    # hidden items still count for a user's mean
    activity = t.events.where("event_type in ('purchase', 'click')").select("user_id", F.floor("value").cast("long").alias("entity_id"))
    items = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("label").alias("kind"), "embedding")
    return search.for_user(activity, items, 5, visible=F.col("kind") < 3).select("user_id", "id", "score", "reason")


LETTERS = "aeiorstn"


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A model that SQL can follow."""
    return [[float(t.count(c)) for c in LETTERS] for t in texts]


@query("r6_embed_missing_values", "SELECT p_partkey AS id, " + ", ".join(f"CASE WHEN p_size % 3 = 0 THEN 9.0 ELSE CAST(length(t) - length(replace(t, '{c}', '')) AS DOUBLE) END AS v{i}" for i, c in enumerate(LETTERS)) + " FROM (SELECT *, p_name || ' — ' || p_type AS t FROM part)")
def _(t: Tables) -> DataFrame:
    # every third has a vector already, which stays
    items = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.when(F.col("p_size") % 3 == 0, F.array_repeat(F.lit(9.0).cast("float"), 8)).alias("embedding"))
    return search.embed_missing(items, letter_counts, 8).select("id", *(F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(8)))


@query("r6_embed_missing", "SELECT count(*) AS n, 8 AS size FROM part")
def _(t: Tables) -> DataFrame:
    items = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.lit(None).cast("array<float>").alias("embedding"))
    return search.embed_missing(items, search.HashEmbedder(8), 8).agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("size"))


@query("e1_upsert", "SELECT coalesce(b.k, s.k) AS id, CASE WHEN s.k IS NOT NULL THEN s.name ELSE b.name END AS name, b.rating FROM (SELECT c_custkey AS k, c_name AS name, c_acctbal AS rating FROM customer WHERE c_custkey % 3 = 0) b FULL JOIN (SELECT o_custkey AS k, arg_max('order ' || o_orderkey, (o_totalprice, 'order ' || o_orderkey)) AS name FROM orders GROUP BY k) s USING (k)")
def _(t: Tables) -> DataFrame:
    base = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("rating"))
    source = t.orders.select(F.col("o_custkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), "o_totalprice")
    return merge.upsert(base, source, ["name"], confidence="o_totalprice")


@query("e2_rebuild", "SELECT n.c_custkey AS id, n.c_name AS name, o.c_acctbal AS rating FROM customer n LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) o USING (c_custkey) WHERE n.c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
def _(t: Tables) -> DataFrame:
    rows = lambda cond, rating: t.customer.where(cond).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), rating.alias("rating"))
    return merge.rebuild(rows("c_custkey % 2 = 0", F.col("c_acctbal")), rows("c_custkey % 3 = 0", F.lit(None).cast("double")), ["rating"])


@query("e4_fill_locations", f"WITH p AS (SELECT {HOST_SQL} AS h, page_id FROM pages WHERE page_id % 2 = 0), m AS (SELECT h, arg_min('Lang ' || l, (-n, l)) AS place FROM (SELECT h, substr(h, 1, 2) AS l, count(*) AS n FROM p GROUP BY h, l) GROUP BY h) SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'set' WHEN page_id % 7 = 0 THEN 'Curated' ELSE place END AS location, CASE WHEN page_id % 5 = 0 THEN 'already set' WHEN page_id % 7 = 0 OR place IS NOT NULL THEN 'updated' ELSE 'unmatched' END AS status FROM (SELECT page_id, {HOST_SQL} AS h FROM pages WHERE page_id % 2 = 1) LEFT JOIN m USING (h)")
def _(t: Tables) -> DataFrame:
    sites = t.pages.where("page_id % 2 = 1").select(F.col("page_id").alias("id"), F.concat(F.lit("site "), F.col("page_id").cast("string")).alias("name"), F.col("url").alias("website"), F.when(F.col("page_id") % 5 == 0, "set").alias("location"))
    shops = t.pages.where("page_id % 2 = 0").select(F.col("url").alias("website"), F.concat(F.lit("Lang "), F.substring(F.regexp_extract("url", r"://(?:www\.)?(..)", 1), 1, 2)).alias("country"), F.lit(None).cast("string").alias("city"))
    curated = t.pages.where("page_id % 7 = 0").select(F.concat(F.lit("site "), F.col("page_id").cast("string")).alias("name"), F.lit("Curated").alias("location"))
    return merge.fill_locations(sites, curated, shops).select(F.col("id").alias("page_id"), "location", "status")


@query("e5_fill_currency", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'SET' WHEN p_size % 3 = 0 THEN NULL WHEN s_nationkey = 1 THEN 'AAA' WHEN s_nationkey = 2 THEN 'BBB' END AS currency FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 100")
def _(t: Tables) -> DataFrame:
    products = t.part.select("p_partkey", (F.col("p_partkey") % 100).alias("roaster_id"), F.when((F.col("p_size") % 3 != 0) | (F.col("p_size") % 4 == 0), F.col("p_retailprice")).alias("price"), F.when(F.col("p_size") % 4 == 0, "SET").alias("currency"))
    roasters = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(", "), "n_name").alias("location"))
    return merge.fill_currency(products, roasters, {"NATION_1": "AAA", "NATION_2": "BBB"}).select("p_partkey", "currency")


@query("e6_score_flag", "WITH s AS (SELECT c_custkey AS id, c_mktsegment = 'BUILDING' AS a, c_mktsegment = 'FURNITURE' OR c_custkey % 10 = 3 AS b, c_custkey % 4 = 0 AS cur, c_custkey % 3 = 0 AND c_custkey % 10 <> 7 AS des, c_acctbal >= 4 AS rat, c_custkey % 10 IN (3, 7) AS web FROM customer), k AS (SELECT id, a, b, CASE WHEN a THEN 1.0 WHEN b THEN 0.0 ELSE least(1.0, CASE WHEN cur THEN 0.6 ELSE 0 END + CASE WHEN des THEN 0.3 ELSE 0 END + CASE WHEN rat THEN 0.2 ELSE 0 END + CASE WHEN web THEN 0.1 ELSE 0 END) END AS score FROM s) SELECT id, CAST(score AS DOUBLE) AS specialty_score, a OR (NOT b AND score >= 0.2) AS is_specialty FROM k")
def _(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    shops = t.customer.select(
        c.alias("id"), F.concat(F.initcap("c_mktsegment"), F.lit(" shop")).alias("name"), F.when(c % 10 == 3, "http://Chain.example/x").when(c % 10 == 7, "https://m.social.example").alias("website"),
        F.when(c % 3 == 0, "text").alias("description"), F.col("c_acctbal").alias("rating"), F.lit(None).cast("boolean").alias("roasts_in_house"),
    )
    curated = t.customer.where("c_custkey % 4 = 0").select(c.alias("shop_id"))
    scored = merge.score_flag(shops, curated, ["Building"], ["building shop x", "Furniture"], ["chain.example"], ["social.example"])
    return scored.select("id", "specialty_score", "is_specialty")


@query("e7_candidates", f"WITH s AS (SELECT page_id, {HOST_SQL} AS host FROM pages WHERE page_id % 3 = 0) SELECT min(page_id) AS id, host FROM s WHERE host NOT IN (SELECT {HOST_SQL} FROM pages WHERE page_id % 3 = 1) GROUP BY host")
def _(t: Tables) -> DataFrame:
    shops = t.pages.where("page_id % 3 <> 1").select(F.col("page_id").alias("id"), F.lit("shop").alias("name"), F.col("url").alias("website"), (F.col("page_id") % 3 == 0).alias("is_specialty"), F.lit(False).alias("roasts_in_house"))
    return jobs.select_candidates(shops, t.pages.where("page_id % 3 = 1").select(F.col("url").alias("website"))).select("id", "host")


@query("e8_work_list", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type IN ('purchase', 'signup')) ORDER BY c_custkey LIMIT 500")
def _(t: Tables) -> DataFrame:
    log = t.events.select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("status"))
    return merge.work_list(t.customer.select("c_custkey"), log, "c_custkey", ["purchase", "signup"], 500)


@query("e8_work_list_chains", "WITH c AS (SELECT c_custkey, c_mktsegment || ' store ' || c_custkey AS name, 'https://www.shop' || (c_custkey % 7) || '.example.com/x' AS website FROM customer) SELECT c_custkey FROM c WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type IN ('purchase', 'signup')) AND NOT (lower(name) LIKE 'building store %') AND NOT (lower(name) LIKE 'furniture store %' AND lower(name) NOT LIKE 'furniture store 1') AND c_custkey % 7 <> 3 ORDER BY c_custkey LIMIT 300")
def _(t: Tables) -> DataFrame:
    log = t.events.select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("status"))
    c = F.col("c_custkey")
    shops = t.customer.select("c_custkey", F.concat(F.initcap("c_mktsegment"), F.lit(" Store "), c.cast("string")).alias("name"), F.concat(F.lit("https://www.shop"), (c % 7).cast("string"), F.lit(".example.com/x")).alias("website"))
    return merge.work_list(shops, log, "c_custkey", ["purchase", "signup"], 300, ["Furniture Store 1"], ["Building Store", "Furniture Store"], ["shop3.example.com"]).select("c_custkey")


LOG_SQL = "l AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 'add' WHEN 'click' THEN 'add' WHEN 'error' THEN 'remove' ELSE 'note' END AS action, CAST(json_extract(props, '$.k') AS BIGINT) AS entity_id, value FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 90))"


def activity_log(t: Tables) -> tuple[DataFrame, DataFrame]:
    action = F.when(F.col("event_type").isin("view", "click"), "add").when(F.col("event_type") == "error", "remove").otherwise("note")
    log = t.events.select("event_id", "ts", "user_id", action.alias("action"), F.lit("supplier").alias("entity_type"), F.get_json_object("props", "$.k").cast("long").alias("entity_id"), F.col("user_id").alias("note_id"), F.col("value").alias("score"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("notes"))
    return log, t.supplier.where("s_suppkey < 90").select(F.lit("supplier").alias("entity_type"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))


@query("e15_favourites", f"WITH {LOG_SQL}, r AS (SELECT user_id, entity_id, max((ts, event_id)) AS gone FROM l WHERE action = 'remove' GROUP BY ALL) SELECT l.user_id, l.entity_id, min(event_id) AS event_id FROM l LEFT JOIN r USING (user_id, entity_id) WHERE action = 'add' AND (gone IS NULL OR (ts, event_id) > gone) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return merge.activity_state(*activity_log(t))[0].select("user_id", "entity_id", "event_id")


@query("e15_notes", f"WITH {LOG_SQL}, n AS (SELECT * FROM l WHERE action = 'note' AND value BETWEEN 0 AND 100) SELECT user_id AS note_id, round(arg_max(value, (ts, event_id)), 6) AS score FROM n GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    return merge.activity_state(*activity_log(t))[1].select("note_id", F.round("score", 6).alias("score"))


SAMPLES_SQL = (
    "s AS (SELECT c_custkey AS k, 'Land ' || c_nationkey AS country, c_mktsegment AS region, CASE WHEN c_custkey % 3 > 0 THEN 'Farm ' || (c_custkey % 50) END AS farm, CAST(trunc(c_acctbal) AS INTEGER) AS altitude, 'washed' AS process, CASE WHEN c_custkey % 7 < 5 THEN 'v' || (c_custkey % 7) END AS variety FROM customer WHERE c_nationkey <> 4)"
)


@query("e3_load_samples", f"WITH {SAMPLES_SQL} SELECT 'farms' AS kind, country || '/' || region || '/' || farm AS a, CAST(arg_min(altitude, k) AS VARCHAR) AS b FROM s WHERE farm IS NOT NULL GROUP BY country, region, farm UNION ALL SELECT 'regions', country || '/' || region, country FROM s GROUP BY country, region UNION ALL SELECT 'countries', country, NULL FROM s GROUP BY country UNION ALL SELECT DISTINCT 'country_variety', country, variety FROM s WHERE variety IS NOT NULL UNION ALL SELECT DISTINCT 'farm_variety', country || '/' || region || '/' || farm, variety FROM s WHERE farm IS NOT NULL AND variety IS NOT NULL UNION ALL SELECT 'unmatched', 'v ' || (c_custkey % 7), CAST(count(*) AS VARCHAR) FROM customer WHERE c_nationkey <> 4 AND c_custkey % 7 >= 5 GROUP BY c_custkey % 7")
def _(t: Tables) -> DataFrame:
    raw = t.customer.select(F.col("c_custkey").alias("at"), F.when(F.col("c_nationkey") != 4, F.concat(F.lit("Land "), F.col("c_nationkey").cast("string"))).otherwise("N/A").alias("country"), F.col("c_mktsegment").alias("region"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("Farm "), (F.col("c_custkey") % 50).cast("string"))).alias("farm"), F.col("c_acctbal").cast("string").alias("altitude"), F.lit("washed").alias("process"), F.concat(F.lit("V "), (F.col("c_custkey") % 7).cast("string")).alias("variety"))
    varieties = t.supplier.where("s_suppkey < 5").select(F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("v "), F.col("s_suppkey").cast("string")).alias("name"))
    out = jobs.load_samples(raw, varieties, NS)
    countries = out["countries"].select(F.col("id").alias("country_id"), F.col("name").alias("country"))
    regions = out["regions"].join(countries, "country_id").select(F.col("id").alias("region_id"), "country", F.concat_ws("/", "country", "name").alias("region"))
    farms = out["farms"].join(regions, "region_id").select(F.col("id").alias("farm_id"), F.concat_ws("/", "region", "name").alias("farm"), "altitude")
    text = lambda kind, df, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), (F.col(b).cast("string") if b else F.lit(None).cast("string")).alias("b"))
    parts = [
        text("farms", farms, "farm", "altitude"), text("regions", regions, "region", "country"), text("countries", countries, "country", None),
        text("country_variety", out["country_variety"].join(countries, "country_id"), "country", "variety_id"), text("farm_variety", out["farm_variety"].join(farms, "farm_id"), "farm", "variety_id"), text("unmatched", out["unmatched"], "variety", "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("e13_load_products", "SELECT split_part(p_name, ' ', 1) AS roaster, p_name || ' ' || p_brand AS name, arg_max(p_retailprice, p_partkey) AS price, arg_max(p_size, p_partkey) AS grams FROM part WHERE NOT contains(p_name, 'anvil') GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    from .scalar import x

    word = F.split("p_name", " ")[0]
    records = t.part.select(
        F.concat(F.lit("https://"), word, F.lit(".example.com")).alias("site"), F.concat(word, F.when(F.col("p_size") > 25, " Coffee").otherwise(" coffee roasters")).alias("roaster"), F.concat_ws(" ", "p_name", "p_brand").alias("title"),
        F.lit(None).cast("string").alias("product_type"), F.array().cast("array<string>").alias("tags"), F.col("p_retailprice").alias("price"), F.lit(None).cast("string").alias("currency"), F.col("p_size").alias("net_weight_grams"),
        F.lit(None).cast("string").alias("roast_level"), F.lit(None).cast("string").alias("process"), F.lit(False).alias("is_blend"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("description"), F.col("p_partkey").alias("at"),
    )
    known = t.part.where("p_partkey < 40").select(F.concat(F.lit("old-"), word).alias("id"), F.concat(F.initcap(word), F.lit(" Roastery")).alias("name"), F.col("p_partkey").alias("created_at")).dropDuplicates(["id"])
    out = jobs.load_products(records, known, x.ProductRules(title_never=("anvil",)))
    names = out["roasters"].select(F.col("id").alias("roaster_id"), F.lower(F.split("name", " ")[0]).alias("roaster"))
    return out["products"].join(names, "roaster_id").select("roaster", "name", "price", F.col("net_weight_grams").alias("grams"))


@query("j14_nearest", f"WITH c AS {placed_sql('customer', 'c_custkey')} SELECT c_custkey AS id FROM c WHERE 6371.0 * acos(least(1.0, greatest(-1.0, sin(radians(10.0)) * sin(radians(lat)) + cos(radians(10.0)) * cos(radians(lat)) * cos(radians(lon) - radians(20.0))))) <= 3000")
def _(t: Tables) -> DataFrame:
    return geo.nearest(t.placed(t.customer, "c_custkey").withColumnRenamed("c_custkey", "id"), 10.0, 20.0, 3000).select("id")
