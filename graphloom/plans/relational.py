"""Queries of filters, joins, aggregates, windows, orderings and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..operators import aggregates as a
from ..operators import joins as j
from .tables import Tables, placed_sql, query

HOST_SQL = r"regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '^([^/?#]*)', 1), ':[0-9]*$', ''), '^www\.', '')"
DOMAIN_SQL = r"split_part(split_part(regexp_replace(lower(url), '^https?://(www\.)?', ''), '/', 1), '?', 1)"


@query("p1_public", "SELECT vec_id, label FROM embeddings")
def _(t: Tables) -> DataFrame:
    return p.public(t.embeddings)


@query("p2_ieq", "SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) = 'building'")
def _(t: Tables) -> DataFrame:
    return t.customer.where(p.ieq("c_mktsegment", "Building")).select("c_custkey", "c_name")


@query("p3_where_all", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def _(t: Tables) -> DataFrame:
    return p.where_all(t.orders, F.col("o_totalprice") > 200000, None, o_orderstatus="F", o_orderpriority=None).select("o_orderkey")


@query("p4_non_blank", "SELECT lang, count(*) AS n FROM documents WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY lang")
def _(t: Tables) -> DataFrame:
    return t.documents.where(p.non_blank("text")).groupBy("lang").agg(F.count("*").alias("n"))


@query("p5_in_bbox", f"SELECT c_custkey FROM {placed_sql('customer', 'c_custkey')} WHERE (lon BETWEEN -20 AND 40 AND lat BETWEEN 30 AND 70) OR (lon BETWEEN 100 AND 150 AND lat BETWEEN -40 AND 0)")
def _(t: Tables) -> DataFrame:
    boxes = [p.parse_bbox("-20,30,40,70"), p.parse_bbox("100,-40,150,0")]
    return t.placed(t.customer, "c_custkey").where(p.in_bbox("lon", "lat", boxes)).select("c_custkey")


@query("p6_text_match", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def _(t: Tables) -> DataFrame:
    return t.documents.where(p.text_match("License", ["text", "source"])).select("doc_id")


@query("p7_in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(t: Tables) -> DataFrame:
    some = p.in_list(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"])
    inside = p.in_list(some, "o_custkey", t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey"))
    return p.in_list(inside, "o_custkey", t.customer.where("c_acctbal < 0").select("c_custkey"), negate=True).select("o_orderkey")


@query("p8_get", "SELECT p_partkey, p_name FROM part WHERE p_partkey = 77")
def _(t: Tables) -> DataFrame:
    return p.get(t.part, 77, "p_partkey").select("p_partkey", "p_name")


@query("p9_lookup_nodes", "WITH v AS (SELECT 0 AS o, 'nation' AS entity_type, n_nationkey AS id, n_name AS label FROM nation UNION ALL SELECT 1, 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 2, 'customer', c_custkey, c_name FROM customer), w AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_quantity = 50) SELECT w.id, arg_min(entity_type, o) AS entity_type FROM w JOIN v USING (id) GROUP BY w.id")
def _(t: Tables) -> DataFrame:
    parts = [("nation", t.nation, "n_nationkey"), ("supplier", t.supplier, "s_suppkey"), ("customer", t.customer, "c_custkey")]
    vertices = j.union_as({n: df.select(F.col(k).cast("long").alias("id"), F.lit(i).alias("o")) for i, (n, df, k) in enumerate(parts)}, "entity_type")
    ids = t.lineitem.where("l_quantity = 50").select(F.col("l_suppkey").alias("id")).distinct()
    return a.pick_first(vertices.join(ids, "id", "left_semi"), "id", [F.col("o")]).select("id", "entity_type")


@query("p10_only_flagged", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def _(t: Tables) -> DataFrame:
    return p.only_flagged(t.customer.withColumn("flag", F.col("c_acctbal") > 5000), "flag").select("c_custkey")


@query("j1_expand", "SELECT l_partkey, s_suppkey AS id, s_name, sum(l_quantity) AS strength FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    edges = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("strength"))
    return j.expand(edges, t.supplier.select(F.col("s_suppkey").alias("id"), "s_name"), "l_partkey", "l_suppkey", "s_name", ["strength"])


@query("j2_lookup_left", "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def _(t: Tables) -> DataFrame:
    return j.lookup_left(t.customer, "c_nationkey", t.nation.where("n_regionkey < 3"), "n_nationkey", {"nation": "n_name"}).select("c_custkey", "nation")


@query("j3_role_join", "SELECT o_orderkey, l_linenumber, cn.n_name AS importer_n_name, sn.n_name AS exporter_n_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation cn ON cn.n_nationkey = c_nationkey LEFT JOIN nation sn ON sn.n_nationkey = s_nationkey")
def _(t: Tables) -> DataFrame:
    routes = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    routes = routes.select("o_orderkey", "l_linenumber", "c_nationkey", "s_nationkey")
    return j.role_join(routes, {"c_nationkey": "importer", "s_nationkey": "exporter"}, t.nation, "n_nationkey", ["n_name"]).select("o_orderkey", "l_linenumber", "importer_n_name", "exporter_n_name")


@query("j4_peers", "WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT x.l_suppkey AS seed, y.l_suppkey AS peer, count(*) AS shared FROM e x JOIN e y USING (l_partkey) WHERE x.l_suppkey <> y.l_suppkey GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return j.shared_counts(t.lineitem, "l_suppkey", "l_partkey")


@query("j6_domain_join", f"WITH x AS (SELECT page_id, {DOMAIN_SQL} AS d FROM pages) SELECT DISTINCT a.page_id AS a_id, b.page_id AS b_id FROM x a JOIN x b ON a.d = b.d AND a.d <> '' WHERE a.page_id % 2 = 0 AND b.page_id % 2 = 1")
def _(t: Tables) -> DataFrame:
    # two sides of one table stand in for shops and roasters
    sides = [t.pages.where(f"page_id % 2 = {k}").select(F.col("page_id").alias("id"), F.col("url").alias("website")) for k in (0, 1)]
    return j.domain_join(*sides)


@query("j7_compose", "SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(t: Tables) -> DataFrame:
    return j.compose(t.orders.select("o_custkey", F.col("o_orderkey").alias("order")), t.lineitem.select(F.col("l_orderkey").alias("order"), "l_partkey"), "o_custkey", "order", "l_partkey")


@query("j8_ijoin", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON lower(p_brand) = lower('BRAND#' || (s_suppkey % 30))")
def _(t: Tables) -> DataFrame:
    brands = t.supplier.select("s_suppkey", F.expr("concat('BRAND#', s_suppkey % 30)").alias("brand"))
    return j.ijoin(t.part.select("p_partkey", "p_brand"), brands, "p_brand", "brand").select("p_partkey", "s_suppkey")


@query("j9_has_match", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS has_match FROM customer")
def _(t: Tables) -> DataFrame:
    return j.has_match(t.customer, "c_custkey", t.orders.where("o_totalprice > 400000"), "o_custkey").select("c_custkey", "has_match")


@query("j10_missing_from", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(t: Tables) -> DataFrame:
    return j.missing_from(t.customer, t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("j11_map_lookup", "SELECT event_id, CASE lower(event_type) WHEN 'view' THEN 'look' WHEN 'purchase' THEN 'buy' ELSE event_type END AS kind FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", j.map_lookup("event_type", {"View": "look", "purchase": "buy"}, F.col("event_type")).alias("kind"))


RULES = [("r1", ["brand#1", "Brand#2", "brand#1"], 20), ("r2", ["Brand#2", "Brand#3"], None), ("r3", [], 5), ("r4", ["Brand#25"], 49)]
RULES_SQL = "(VALUES ('r1', 'brand#1', 20), ('r1', 'brand#2', 20), ('r2', 'brand#2', NULL), ('r2', 'brand#3', NULL), ('r4', 'brand#25', 49)) r(rule_id, s, low)"


def rules(t: Tables) -> tuple[DataFrame, DataFrame]:
    entities = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("species"), F.when(F.col("p_size") != 13, F.col("p_size")).alias("altitude_max"))
    return t.values(RULES, "id string, species array<string>, min_altitude int"), entities


@query("j12_rule_join", f"SELECT rule_id, p_partkey AS entity_id FROM part JOIN {RULES_SQL} ON lower(p_brand) = s WHERE low IS NULL OR (p_size <> 13 AND p_size >= low)")
def _(t: Tables) -> DataFrame:
    return j.rule_join(*rules(t))


@query("j13_mention_join", r"WITH n AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_size < 10), d AS (SELECT p_partkey, p_name || ', ' || p_type || '; ' || p_brand AS text FROM part) SELECT DISTINCT p_partkey AS doc_id, name AS entity_id FROM d JOIN n ON length(name) >= 4 AND name <> 'bolt' AND regexp_matches(lower(text), '\b' || lower(name) || '\b')")
def _(t: Tables) -> DataFrame:
    docs = t.part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(", "), "p_type", F.lit("; "), "p_brand").alias("text"))
    names = t.part.select(F.explode(F.split("p_name", " ")).alias("name")).union(t.part.where("p_size < 10").select("p_name")).distinct().select(F.col("name").alias("id"), "name")
    return j.mention_join(docs, names, min_length=4, stop=["bolt"])


@query("j15_update_from", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal, s_name FROM supplier")
def _(t: Tables) -> DataFrame:
    patch = t.supplier.where("s_acctbal < 0").select("s_suppkey", F.lit(0.0).alias("s_acctbal"))
    return j.update_from(t.supplier, patch, "s_suppkey", ["s_acctbal"]).select("s_suppkey", "s_acctbal", "s_name")


@query("j16_attach_names", "SELECT event_id, coalesce(s_name, c_name) AS name FROM events LEFT JOIN supplier ON event_type = 'view' AND s_suppkey = user_id LEFT JOIN customer ON event_type <> 'view' AND c_custkey = user_id * 20")
def _(t: Tables) -> DataFrame:
    activity = t.events.select("event_id", F.when(F.col("event_type") == "view", "supplier").otherwise("customer").alias("entity_type"), F.when(F.col("event_type") == "view", F.col("user_id")).otherwise(F.col("user_id") * 20).alias("entity_id"))
    vertices = j.union_as({"supplier": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label")), "customer": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))}, "entity_type")
    return j.attach_names(activity, vertices).select("event_id", "name")


@query("j17_resolve_name", "WITH d AS (SELECT p_partkey, lower(p_brand) AS n, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_size > 10, p_partkey) AS r FROM part) SELECT event_id, p_partkey AS id FROM events LEFT JOIN d ON n = lower('BRAND#' || (user_id % 40)) AND r = 1")
def _(t: Tables) -> DataFrame:
    names = t.events.select("event_id", F.expr("concat('BRAND#', user_id % 40)").alias("name"))
    dim = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.when(F.col("p_size") > 10, 1).alias("parent_id"))
    return j.resolve_name(names, dim).select("event_id", "id")


@query("a1_count_children", "SELECT n_nationkey AS id, n_name AS name, count(c_custkey) AS n FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON c_nationkey = n_nationkey WHERE contains(lower(n_name), '1') GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return a.count_children(t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), t.customer.where("c_acctbal > 9000"), "c_nationkey", search="1")


@query("a2_summary", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_totalprice > 100000) AS large FROM orders")
def _(t: Tables) -> DataFrame:
    return a.summary(t.orders, finished=F.col("o_orderstatus") == "F", large=F.col("o_totalprice") > 100000)


@query("a3_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_mktsegment", "c_nationkey").distinct()


OVERLAP_SQL = "WITH p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS n FROM lineitem), o AS (SELECT s_suppkey AS s, s_nationkey AS n FROM supplier), u AS (SELECT x.s AS seed, y.s AS peer, 'part' AS label, count(*) AS shared FROM p x JOIN p y USING (n) WHERE x.s <> y.s GROUP BY ALL UNION ALL SELECT x.s, y.s, 'nation', count(*) FROM o x JOIN o y USING (n) WHERE x.s <> y.s GROUP BY ALL)"


def supplier_edges(t: Tables) -> dict:
    return {"part": [(t.lineitem, "l_suppkey", "l_partkey")], "nation": [(t.supplier, "s_suppkey", "s_nationkey")]}


@query("a4_overlap", OVERLAP_SQL + " SELECT * FROM u")
def _(t: Tables) -> DataFrame:
    return a.overlap(supplier_edges(t)).select("seed", "peer", "label", "shared")


@query("a5_norm_by_max", "SELECT c_custkey, round(CASE WHEN max(c_acctbal) OVER w > 0 THEN c_acctbal / max(c_acctbal) OVER w ELSE 0 END, 6) AS norm FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def _(t: Tables) -> DataFrame:
    return a.norm_by_max(t.customer, "c_nationkey", "c_acctbal").select("c_custkey", F.round("norm", 6).alias("norm"))


@query("a7_modal", "WITH s AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY ALL) SELECT user_id, event_type AS modal FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) = 1")
def _(t: Tables) -> DataFrame:
    return a.modal(t.events, "user_id", "event_type", "event_id")


@query("a8_mode2", "WITH c AS (SELECT c_mktsegment AS k, n_regionkey AS o, n_name AS i, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), g AS (SELECT k, o, sum(n) AS t FROM c GROUP BY k, o), r AS (SELECT k, o FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC, o) = 1) SELECT k AS c_mktsegment, o AS n_regionkey, i AS n_name FROM c JOIN r USING (k, o) QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, i) = 1")
def _(t: Tables) -> DataFrame:
    return a.mode2(t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")), "c_mktsegment", "n_regionkey", "n_name")


@query("a9_first_by", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def _(t: Tables) -> DataFrame:
    return a.first_by(t.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("a10_last_by", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(t: Tables) -> DataFrame:
    return a.last_by(t.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("a11_count_by", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    return a.count_by(t.events, "event_type")


@query("a12_group_by_country", "SELECT coalesce(r_name, 'Other') AS country, sum(n) AS total, count(*) AS members, min(n_name) AS first FROM (SELECT n_name, n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 4) ON r_regionkey = n_regionkey GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    counts = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")).join(t.nation, "n_nationkey").join(t.region.where("r_regionkey < 4"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    rows = counts.select(F.col("n_name").alias("name"), F.concat(F.col("n_name"), F.lit(", "), F.coalesce("r_name", F.lit(""))).alias("location"), "n")
    return a.group_by_country(rows).select("country", "total", "members", F.col("items")[0]["name"].alias("first"))


@query("a13_tree_counts", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_type)")
def _(t: Tables) -> DataFrame:
    return a.tree_counts(t.part, "p_brand", "p_type")


@query("a14_nest", "SELECT coalesce(c_mktsegment, 'Other') AS category, coalesce(n_name, 'Other') AS subcategory, count(*) AS n, min(c_custkey) AS first FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    df = j.lookup_left(t.customer, "c_nationkey", t.nation.where("n_regionkey < 3"), "n_nationkey", {"nation": "n_name"})
    tree = a.nest(df, "c_mktsegment", "nation", F.struct("c_custkey"))
    return tree.select("category", F.explode("children").alias("subcategory", "rows")).select("category", "subcategory", F.size("rows").cast("long").alias("n"), F.col("rows")[0]["c_custkey"].alias("first"))


@query("a16_from_price", "WITH v AS (SELECT l_orderkey, CASE WHEN l_discount > 0.03 THEN l_extendedprice ELSE 0 END AS price, CAST(l_quantity AS INT) AS grams FROM lineitem) SELECT l_orderkey, min(price) FILTER (price > 0) AS price, CASE WHEN count(*) FILTER (price > 0) > 0 THEN arg_min(grams, price) FILTER (price > 0) ELSE min(grams) FILTER (grams > 0) END AS grams FROM v GROUP BY l_orderkey")
def _(t: Tables) -> DataFrame:
    v = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.when(F.col("l_discount") > 0.03, F.col("l_extendedprice")).otherwise(0.0).alias("price"), F.col("l_quantity").cast("int").alias("grams"))).alias("v"))
    return v.select("l_orderkey", a.from_price("v").alias("f")).select("l_orderkey", "f.price", "f.grams")


@query("a17_assert_counts", "SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS n_a, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_b, (SELECT count(*) FROM orders) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS equal UNION ALL SELECT 'nation', 25, 25, true")
def _(t: Tables) -> DataFrame:
    return a.assert_counts({"orders": t.orders, "nation": t.nation}, {"orders": t.lineitem.select("l_orderkey").distinct(), "nation": t.nation})


@query("w1_topk_per_group", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_totalprice >= 50000 QUALIFY rank <= 3")
def _(t: Tables) -> DataFrame:
    return a.topk_per_group(t.orders, "o_custkey", "o_totalprice", 3, 50000, "o_orderkey").select("o_custkey", "o_orderkey", "rank")


@query("w2_latest_by", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) = 1")
def _(t: Tables) -> DataFrame:
    return a.latest_by(t.events, "user_id", "value", "event_id").select("user_id", "event_id")


@query("w3_prefer", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R'), l_linenumber, l_partkey) = 1")
def _(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.struct("l_linenumber", "l_partkey").alias("at"))
    return a.prefer(df, ["l_orderkey"], F.col("l_returnflag") == "R", "at").select("l_orderkey", "l_linenumber", "l_partkey")


@query("w4_canonical_owner", "WITH o AS (SELECT p_name AS k, arg_min(p_partkey, (p_size, p_partkey)) AS id FROM part WHERE p_size <= 5 GROUP BY k), n AS (SELECT p_name AS k, min(p_partkey) AS id FROM part WHERE p_size > 5 GROUP BY k) SELECT coalesce(o.k, n.k) AS p_name, coalesce(o.id, n.id) AS id FROM o FULL JOIN n USING (k)")
def _(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    return a.canonical_owner(parts.where("p_size > 5").withColumn("at", F.col("id")), parts.where("p_size <= 5").withColumn("at", F.col("p_size")), "p_name", "at")


@query("w5_pick_first", "SELECT p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_size > 25, p_partkey) = 1")
def _(t: Tables) -> DataFrame:
    return a.pick_first(t.part, "p_name", [F.col("p_size") > 25, F.col("p_partkey")]).select("p_name", "p_partkey")


@query("o1_page", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 50 OFFSET 100")
def _(t: Tables) -> DataFrame:
    return p.page(t.part.select("p_partkey", "p_name"), [F.col("p_name")], 50, 100, "p_partkey")


@query("o2_shortest_first", "SELECT n_nationkey, n_name FROM nation ORDER BY length(n_name), n_nationkey")
def _(t: Tables) -> DataFrame:
    return p.shortest_first(t.nation.select("n_nationkey", "n_name"), "n_name", "n_nationkey")


@query("o3_order_mixed", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, n_name")
def _(t: Tables) -> DataFrame:
    counts = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))
    return p.order_mixed(counts, [("n", True), ("n_name", False)])


@query("o4_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t: Tables) -> DataFrame:
    return p.top_k(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 25, "o_orderkey")


@query("o5_capped_union", "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) SELECT event_type, event_id FROM (SELECT * FROM r WHERE k <= 8) ORDER BY event_type, k LIMIT 36")
def _(t: Tables) -> DataFrame:
    return p.capped_union(t.events, "event_type", [F.desc("value"), F.col("event_id")], 36, 5, "event_type").select("event_type", "event_id")


@query("u1_union_distinct", "SELECT o_custkey AS id FROM orders UNION SELECT user_id FROM events")
def _(t: Tables) -> DataFrame:
    return j.union_distinct(t.orders.select(F.col("o_custkey").alias("id")), t.events.select(F.col("user_id").alias("id")))


@query("u2_union_as", "SELECT s_suppkey AS id, s_name AS label, NULL AS score, 'supplier' AS source FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, 'customer' FROM customer")
def _(t: Tables) -> DataFrame:
    return j.union_as({"supplier": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit(None).cast("double").alias("score")), "customer": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_acctbal").alias("score"))})


@query("u3_merge_candidates", "WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS similarity FROM orders WHERE o_totalprice > 300000 GROUP BY k), b AS (SELECT user_id AS k, count(*) AS shared FROM events GROUP BY k) SELECT k, coalesce(similarity, 0) AS similarity, coalesce(shared, 0) AS shared FROM a FULL JOIN b USING (k)")
def _(t: Tables) -> DataFrame:
    near = t.orders.where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("similarity"))
    return j.merge_candidates(near, t.events.groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("shared")), ["k"])


@query("u4_difference", "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def _(t: Tables) -> DataFrame:
    return j.difference(t.orders.select(F.col("o_custkey").alias("k")), t.events.select(F.col("user_id").alias("k")), "k")


@query("u5_merge_edges", "SELECT src_id, dst_id, edge_type FROM (SELECT l_partkey AS src_id, l_suppkey AS dst_id, 'made_by' AS edge_type FROM lineitem WHERE l_quantity > 25 UNION SELECT l_partkey, l_suppkey, 'made_by' FROM lineitem WHERE l_discount > 0.05)")
def _(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.col("l_partkey").alias("src_id"), F.col("l_suppkey").alias("dst_id"), F.lit("made_by").alias("edge_type"), "l_quantity", "l_discount")
    large, cheap = edges.where("l_quantity > 25"), edges.where("l_discount > 0.05")
    return j.merge_edges(*(df.drop("l_quantity", "l_discount") for df in (large, cheap)))
