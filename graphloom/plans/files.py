"""Queries of sources, sinks, streams and the loading jobs: each writes a given table in the form a source reads, and reads it back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import scratch_dir
from ..operators import aggregates, extract, jobs, joins, merge
from ..sources import readers, sinks
from ..streaming import streams
from .scalar import NS
from .tables import Tables, placed_sql, query


def folder(t: Tables, label: str) -> str:
    return scratch_dir(t.spark, label)


def text(c: str) -> Column:
    return F.col(c).cast("string")


def named(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), text(key))


@query("s1_csv_union", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ', \"x\"' END AS segment, CAST(NULL AS VARCHAR) AS absent FROM customer")
def _(t: Tables) -> DataFrame:
    at = folder(t, "csv")
    rows = t.customer.select("c_custkey", "c_name", F.concat("c_mktsegment", F.lit(', "x"')).alias("segment"))
    rows.where("c_custkey % 2 = 0").write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{at}/a")
    rows.where("c_custkey % 2 = 1").drop("segment").write.option("header", True).csv(f"{at}/b")
    return readers.read_csv_union(t.spark, [f"{at}/a", f"{at}/none", f"{at}/b"], {"c_custkey": "id", "c_name": "name", "segment": "segment", "other": "absent"})


@query("s2_json_doc", "SELECT s_suppkey, s_name, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(t: Tables) -> DataFrame:
    # a document for each nation, with its suppliers in an array
    at = folder(t, "documents")
    items = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_nationkey", F.struct("s_suppkey", "s_name", F.col("n_name").alias("nation")).alias("item"))
    items.groupBy("n_nationkey").agg(F.collect_list("item").alias("suppliers")).write.partitionBy("n_nationkey").json(at)
    return readers.read_json_doc(t.spark, at, "suppliers array<struct<s_suppkey:long,s_name:string,nation:string>>", "suppliers")


@query("s3_flatten_tree", "SELECT r_name AS path, CAST(NULL AS VARCHAR) AS parent_path, 1 AS depth, r_name AS category, CAST(NULL AS VARCHAR) AS subcategory FROM region UNION ALL SELECT r_name || '/' || n_name, r_name, 2, r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_name || '/' || n_name || '/' || s_name, r_name || '/' || n_name, 3, r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def _(t: Tables) -> DataFrame:
    leaves = t.supplier.groupBy("s_nationkey").agg(F.collect_list(F.struct(F.col("s_name").alias("name"))).alias("children"))
    nations = t.nation.join(leaves, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("name"), "children")).alias("children"))
    roots = t.region.join(nations, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("r_name").alias("name"), "children")
    return readers.flatten_tree(roots).select("path", "parent_path", "depth", "category", "subcategory")


def log(t: Tables) -> str:
    """A scrape log of parts by brand, with a marker for each brand and a line cut short."""
    at = folder(t, "scrape-log")
    products = t.part.select(F.concat(F.lit("https://"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit(".example.com")).alias("site"), F.col("p_brand").alias("roaster"), F.concat_ws(" ", "p_name", text("p_partkey")).alias("title"), F.col("p_retailprice").alias("price"))
    sinks.write_scrape_log(products, at, products.select("site").distinct().withColumn("status", F.lit("ok")))
    t.nation.where("n_nationkey < 3").select(F.lit('{"site": "https://cut.example.com", "product": {"ti').alias("value")).write.mode("append").text(at)
    return at


SITE_SQL = "'https://' || lower(replace(p_brand, '#', '')) || '.example.com'"


@query("s4_scrape_log", f"SELECT {SITE_SQL} AS site, p_brand AS roaster, p_name || ' ' || p_partkey AS title, p_retailprice AS price FROM part")
def _(t: Tables) -> DataFrame:
    return readers.read_scrape_log(t.spark, log(t)).select("site", "roaster", "title", "price")


@query("s10_scrape_sink", f"SELECT {SITE_SQL} AS site, count(*) AS products, 1 AS markers FROM part GROUP BY site")
def _(t: Tables) -> DataFrame:
    lines = t.spark.read.schema("site string, product struct<title:string>, _site_done string").option("mode", "DROPMALFORMED").json(log(t))
    site = F.coalesce("_site_done", "site")
    return lines.groupBy(site.alias("site")).agg(F.count("product.title").alias("products"), F.count_if(F.col("_site_done").isNotNull()).cast("int").alias("markers"))


@query("s5_scan_places", f"SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, round(lon, 3) AS longitude, c_mktsegment AS city, CASE WHEN c_custkey % 3 = 0 THEN 'https://a.example' END AS website FROM {placed_sql('customer', 'c_custkey')} WHERE c_custkey % 11 <> 0 AND c_custkey % 10 >= 5 AND c_mktsegment IN ('BUILDING', 'FURNITURE') AND (lon BETWEEN -60 AND 60 AND lat BETWEEN -40 AND 40 OR lon BETWEEN 100 AND 150 AND lat BETWEEN 0 AND 80)")
def _(t: Tables) -> DataFrame:
    at = folder(t, "places")
    c = t.placed(t.customer, "c_custkey")
    places = c.select(
        text("c_custkey").alias("id"), F.struct(F.when(F.col("c_custkey") % 11 != 0, F.col("c_name")).alias("primary")).alias("names"), F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin")).alias("bbox"), F.struct(F.col("c_mktsegment").alias("primary")).alias("categories"),
        (F.col("c_custkey") % 10 / 10).alias("confidence"), F.array(F.struct(F.col("c_name").alias("freeform"), F.col("c_mktsegment").alias("locality"), text("c_nationkey").alias("country"))).alias("addresses"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("https://a.example"))).alias("websites"),
    )
    places.write.parquet(at)
    found = readers.scan_places(readers.read_places(t.spark, at), [(-60.0, -40.0, 60.0, 40.0), (100.0, 0.0, 150.0, 80.0)], ["BUILDING", "FURNITURE"], 0.5)
    return found.select("id", "name", F.round("longitude", 3).alias("longitude"), "city", "website")


@query("s6_list", "SELECT c_mktsegment || ' ' || c_custkey AS value FROM customer WHERE c_custkey % 3 <> 0")
def _(t: Tables) -> DataFrame:
    at = folder(t, "list")
    line = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("  "), F.concat_ws(" ", "c_mktsegment", text("c_custkey")), F.when(F.col("c_custkey") % 3 == 1, " # known").otherwise(""))).when(F.col("c_custkey") % 2 == 0, "# left out").otherwise("   ")
    t.customer.select(line.alias("value")).write.text(at)
    return readers.read_list(t.spark, at)


@query("s6_pairs", "SELECT c_mktsegment || ' ' || c_custkey AS city, CASE c_nationkey % 2 WHEN 0 THEN 'AA' ELSE 'BB' END AS country FROM customer")
def _(t: Tables) -> DataFrame:
    at = folder(t, "pairs")
    t.customer.select(F.concat(F.concat_ws(" ", "c_mktsegment", text("c_custkey")), F.when(F.col("c_nationkey") % 2 == 0, ", aa").otherwise(" ,BB # sure")).alias("value")).write.text(at)
    return readers.read_pairs(t.spark, at)


@query("s7_centroids", f"SELECT s_name AS country, round(lat, 6) AS lat, round(lon, 6) AS lon, CAST(s_nationkey AS VARCHAR) AS iso FROM {placed_sql('supplier', 's_suppkey')}")
def _(t: Tables) -> DataFrame:
    at = folder(t, "centroids")
    t.placed(t.supplier, "s_suppkey").select(F.col("s_name").alias("country"), "lat", "lon", text("s_nationkey").alias("iso")).write.json(at)
    return readers.load_centroids(t.spark, at).select("country", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "iso")


def triple_lines(t: Tables) -> DataFrame:
    """Triples of parts: type, label, size; types 0 to 4 of brands are classes themselves."""
    s = F.concat(F.lit("<http://x/p"), text("p_partkey"), F.lit("> "))
    kind = F.concat(F.lit("<http://x/"), F.lower("p_type"), F.lit(">"))
    line = lambda df, p, o: df.select(F.concat(s, F.lit(f"<{p}> "), o, F.lit(" .")).alias("value"))
    lines = [
        line(t.part, "rdf:type", kind),
        line(t.part, "rdfs:label", F.concat(F.lit('"'), F.col("p_name"), F.lit('"@en'))),
        line(t.part, "size", F.concat(F.lit('"'), text("p_size"), F.lit('"^^<xsd:int>'))),
        t.part.where("p_size > 20").select(F.concat(kind, F.lit(" <rdf:type> <owl:Class> .")).alias("value")),
        t.part.select(F.concat(F.lit("# part "), text("p_partkey")).alias("value")),
        # escapes, a graph of its own and a comment behind the statement
        t.part.select(F.concat(s, F.lit(r'<note> "say \"'), F.col("p_name"), F.lit(r'\" caf\u00E9 \uD83D\uDE00\U0001F600\\n\n" <http://x/notes> . # note ')).alias("value")),
        t.part.where("p_size > 40").select(F.concat(F.lit("broken "), text("p_partkey")).alias("value")),
    ]
    at = folder(t, "triples")
    reduce(DataFrame.unionByName, lines).write.text(at)
    return t.spark.read.text(at)


def triples(t: Tables) -> DataFrame:
    return readers.load_triples(triple_lines(t))


TRIPLES_SQL = (
    "tr AS (SELECT 'http://x/p' || p_partkey AS subject, 'rdf:type' AS predicate, 'http://x/' || lower(p_type) AS object, 'iri' AS kind, NULL AS datatype, NULL AS lang FROM part"
    " UNION SELECT 'http://x/p' || p_partkey, 'rdfs:label', p_name, 'literal', NULL, 'en' FROM part UNION SELECT 'http://x/p' || p_partkey, 'size', CAST(p_size AS VARCHAR), 'literal', 'xsd:int', NULL FROM part"
    " UNION SELECT 'http://x/' || lower(p_type), 'rdf:type', 'owl:Class', 'iri', NULL, NULL FROM part WHERE p_size > 20"
    " UNION SELECT 'http://x/p' || p_partkey, 'note', 'say \"' || p_name || '\" café ' || chr(128512) || chr(128512) || chr(92) || 'n' || chr(10), 'literal', NULL, NULL FROM part)"
)


@query("s8_triples", f"WITH {TRIPLES_SQL} SELECT subject, predicate, object, kind, datatype, lang FROM tr")
def _(t: Tables) -> DataFrame:
    return triples(t).select("subject", "predicate", "object", "kind", "datatype", "lang")


@query("s8_graphs_and_rejects", "SELECT 'http://x/notes' AS kind, count(DISTINCT p_partkey) AS n FROM part UNION ALL SELECT 'rejected', count(*) FROM part WHERE p_size > 40")
def _(t: Tables) -> DataFrame:
    lines = triple_lines(t)
    named_graphs = readers.load_triples(lines).where("graph <> 'default'").groupBy(F.col("graph").alias("kind")).agg(F.count("*").alias("n"))
    return named_graphs.unionByName(readers.rejected_triples(lines).agg(F.lit("rejected").alias("kind"), F.count("*").alias("n")))


@query("j18_match_triples", f"WITH {TRIPLES_SQL} SELECT DISTINCT subject, object FROM tr WHERE predicate = 'rdf:type' AND object IN (SELECT subject FROM tr WHERE predicate = 'rdf:type' AND object = 'owl:Class')")
def _(t: Tables) -> DataFrame:
    return joins.match_triples(triples(t))


@query("a15_triple_stats", f"WITH {TRIPLES_SQL} SELECT predicate, object, count(DISTINCT subject) AS subjects FROM tr GROUP BY predicate, object")
def _(t: Tables) -> DataFrame:
    return aggregates.triple_stats(triples(t))


@query("s9_write_table", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE o_orderstatus END AS status FROM orders WHERE o_custkey % 2 = 0")
def _(t: Tables) -> DataFrame:
    # a table rebuilt from itself
    at = folder(t, "table")
    first = sinks.write_table(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderstatus").alias("status")), at)
    sinks.write_table(first.where("o_custkey % 2 = 0").withColumn("status", F.when(F.col("o_totalprice") > 100000, "large").otherwise(F.col("status"))), at)
    return t.spark.read.parquet(at).select("o_orderkey", "status")


@query("f13_chain_flags", "WITH n AS (SELECT p_partkey AS id, p_name AS n FROM part) SELECT id, n LIKE 'small widget' OR n LIKE 'small widget %' AS allowed, split_part(n, ' ', 1) IN ('small', 'cold', 'old') AND NOT (n LIKE 'small widget' OR n LIKE 'small widget %') AS blocked FROM n")
def _(t: Tables) -> DataFrame:
    return merge.chain_flags(t.part.select(F.col("p_partkey").alias("id"), F.initcap("p_name").alias("name")), ["Small Widget"], ["SMALL", "Cold", "old"])


@query("f33_format_refs", "SELECT o_orderkey, string_agg('part ' || l_partkey || CASE WHEN l_quantity > 10 THEN ': flag=' || l_returnflag || CASE WHEN l_linestatus = 'O' THEN ', status=O' ELSE '' END WHEN l_linestatus = 'O' THEN ': status=O' ELSE '' END, '; ' ORDER BY l_linenumber, l_partkey, CASE WHEN l_quantity > 10 THEN l_returnflag END NULLS FIRST, CASE WHEN l_linestatus = 'O' THEN 'O' ELSE '' END) AS refs FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <> 2 GROUP BY o_orderkey")
def _(t: Tables) -> DataFrame:
    ref = F.struct("l_linenumber", "l_partkey", F.when(F.col("l_linenumber") != 2, named("part ", "l_partkey")).alias("name"), F.when(F.col("l_quantity") > 10, F.col("l_returnflag")).alias("flag"), F.when(F.col("l_linestatus") == "O", "O").otherwise("").alias("status"))
    refs = t.lineitem.join(t.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.array_sort(F.collect_list(ref)).alias("refs"))
    return refs.select("o_orderkey", extract.format_refs("refs", "name", ["flag", "status"]).alias("refs")).where("refs is not null")


@query("f26_normalise_catalog", "SELECT p_name || ' ' || p_partkey AS title, p_brand AS roaster, 'https://shop.example/products/p' || p_partkey AS url, p_retailprice AS price, CASE WHEN p_size % 2 = 0 THEN 'light' END AS roast_level FROM part")
def _(t: Tables) -> DataFrame:
    product = F.struct(
        F.concat_ws(" ", "p_name", text("p_partkey")).alias("title"), named("p", "p_partkey").alias("handle"), F.lit("<p>Sweet</p>").alias("body_html"), F.col("p_brand").alias("vendor"), F.lit("Coffee").alias("product_type"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.lit(" Light "))).otherwise(F.array().cast("array<string>")).alias("tags"), F.array(F.struct(F.col("p_retailprice").cast("string").alias("price"), F.lit(250).alias("grams"))).alias("variants"),
    )
    raw = t.part.select(F.lit("https://shop.example").alias("site"), F.to_json(F.struct(F.array(product).alias("products"))).alias("payload"))
    return extract.normalise_catalog(raw, "shopify").select("title", "roaster", "url", "price", "roast_level")


@query("e9_distribution", "SELECT 'country' AS kind, n_name AS name, CAST(NULL AS VARCHAR) AS other FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT DISTINCT 'country', 'Land ' || (c_nationkey % 9), NULL FROM customer UNION ALL SELECT 'importer', c_name, CASE WHEN c_nationkey % 2 = 0 THEN 'NATION_' || c_nationkey END FROM customer UNION ALL SELECT DISTINCT 'unresolved', lower('NATION_' || c_nationkey), NULL FROM customer WHERE c_nationkey % 2 = 1 UNION ALL SELECT 'route', s_name, 'NATION_' || s_nationkey FROM supplier WHERE s_nationkey % 2 = 0")
def _(t: Tables) -> DataFrame:
    countries = t.nation.where("n_nationkey % 2 = 0").select(named("c", "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    importers = t.customer.select(F.col("c_name").alias("name"), named("nation_", "c_nationkey").alias("country"))
    routes = t.supplier.where("s_nationkey % 2 = 0").select(named("Nation_", "s_nationkey").alias("exporter"), F.lit("Nation_0").alias("importer"), "s_name")
    wanted = t.customer.select(F.concat(F.lit("Land "), (F.col("c_nationkey") % 9).cast("string")).alias("name"))
    out = jobs.load_distribution(importers, routes, wanted, countries, NS)
    ids = out["countries"].select("id", F.col("name").alias("other"))
    rows = lambda kind, df, name, other: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), (F.col(other) if other else F.lit(None).cast("string")).alias("other"))
    placed = out["importers"].drop("id").join(ids.withColumnRenamed("id", "country_id"), "country_id", "left")
    routed = out["routes"].drop("id").join(ids.withColumnRenamed("id", "exporter_id"), "exporter_id")
    return reduce(DataFrame.unionByName, [rows("country", out["countries"], "name", None), rows("importer", placed, "name", "other"), rows("unresolved", out["unresolved"], "name", None), rows("route", routed, "s_name", "other")])


@query("e10_describe", "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE lower(p_type) WHEN 'economy' THEN 'cheap' WHEN 'large' THEN 'wide' ELSE p_name END AS description FROM part UNION ALL SELECT DISTINCT 'missing ' || p_type, NULL FROM part WHERE lower(p_type) NOT IN ('economy', 'large')")
def _(t: Tables) -> DataFrame:
    methods = t.part.select(text("p_partkey").alias("id"), F.col("p_type").alias("category"), F.col("p_name").alias("description"))
    filled, missing = jobs.describe_by_category(methods, {"Economy": "cheap", "LARGE": "wide"})
    return filled.select("id", "description").unionByName(missing.select(F.concat(F.lit("missing "), F.col("category")).alias("id"), F.lit(None).cast("string").alias("description")))


@query("e11_geocode_countries", f"SELECT c_custkey AS id, round(CASE WHEN c_custkey % 4 = 0 THEN 1.5 WHEN c_custkey % 4 = 3 THEN (SELECT lat FROM {placed_sql('nation', 'n_nationkey')} WHERE n_nationkey = 4) ELSE lat END, 3) AS lat, c_custkey % 4 <> 0 AND n_nationkey IS NULL AND c_custkey % 4 <> 3 AS unplaced FROM customer LEFT JOIN {placed_sql('nation', 'n_nationkey')} ON n_nationkey = c_nationkey AND n_nationkey % 5 > 0")
def _(t: Tables) -> DataFrame:
    given = lambda v: F.when(F.col("c_custkey") % 4 == 0, F.lit(v))
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 3, " Fourth Land").otherwise(named("Nation_", "c_nationkey")).alias("name"), given(1.5).alias("lat"), given(2.5).alias("lon"))
    centroids = t.placed(t.nation, "n_nationkey").where("n_nationkey % 5 > 0").select(F.col("n_name").alias("country"), "lat", "lon", text("n_nationkey").alias("iso"))
    filled, lost = jobs.geocode_countries(rows, centroids, {"fourth land": "NATION_4"})
    return filled.join(lost.select("id", F.lit(True).alias("_lost")), "id", "left").select("id", F.round("lat", 3).alias("lat"), F.coalesce("_lost", F.lit(False)).alias("unplaced"))


@query("e12_geocode_regions", f"SELECT c_custkey AS id, round(CASE WHEN c_custkey % 4 = 0 THEN 1.5 WHEN c_custkey % 3 > 0 THEN lat END, 3) AS lat, c_custkey % 4 <> 0 AND c_custkey % 3 = 0 AS unplaced FROM customer JOIN {placed_sql('nation', 'n_nationkey')} ON n_nationkey = c_nationkey")
def _(t: Tables) -> DataFrame:
    given = lambda v: F.when(F.col("c_custkey") % 4 == 0, F.lit(v))
    iso = F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("N"), text("c_nationkey")))
    country = F.when(F.col("c_custkey") % 3 == 0, "Nowhere").otherwise(named("Nation_", "c_nationkey"))
    rows = t.customer.select(F.col("c_custkey").alias("id"), named("R", "c_nationkey").alias("name"), country.alias("country"), iso.alias("iso"), given(1.5).alias("lat"), given(2.5).alias("lon"))
    n = t.placed(t.nation, "n_nationkey")
    key = lambda start: F.concat(start, F.lit("|r"), text("n_nationkey"), F.lit(", nation_"), text("n_nationkey"))
    table = n.select(key(F.concat(F.lit("n"), text("n_nationkey"))).alias("key"), "lat", "lon").unionByName(n.select(key(F.lit("*")).alias("key"), "lat", "lon")).unionByName(n.select(F.concat(F.lit("*|r"), text("n_nationkey"), F.lit(", nowhere")).alias("key"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon")))
    filled, lost = jobs.geocode_regions(rows, table)
    return filled.join(lost.select("id", F.lit(True).alias("_lost")), "id", "left").select("id", F.round("lat", 3).alias("lat"), F.coalesce("_lost", F.lit(False)).alias("unplaced"))


@query("e14_load_catalog", "SELECT p_name AS name, max(p_partkey) AS at, arg_max(p_brand, p_partkey) AS brand FROM part GROUP BY p_name")
def _(t: Tables) -> DataFrame:
    return jobs.load_catalog(t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("at"), F.col("p_brand").alias("brand")), NS, "variety").select("name", "at", "brand")


@query("t1_stream_scrape_log", "SELECT DISTINCT p_name || ' ' || p_partkey AS title, p_brand AS roaster, p_retailprice AS price FROM part")
def _(t: Tables) -> DataFrame:
    """Two runs over a growing log, with the product loader as the load; the second run also gets its batch again, as after a crash."""
    at, state, target = folder(t, "scrape-log"), folder(t, "stream-state"), folder(t, "streamed")
    schema = "title string, roaster string, price double"

    def load(products: DataFrame) -> DataFrame:
        records = products.withColumn("at", F.monotonically_increasing_id())
        out = jobs.load_products(records, t.values([], "id string, name string, created_at long"), extract.ProductRules(title_never=()))
        roasters = out["roasters"].select(F.col("id").alias("roaster_id"), F.col("name").alias("roaster"))
        return out["products"].join(roasters, "roaster_id").select(F.col("name").alias("title"), "roaster", "price")

    brand = F.concat(F.lit("https://"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit(".example.com"))
    products = t.part.select(brand.alias("site"), F.col("p_brand").alias("roaster"), F.concat_ws(" ", "p_name", text("p_partkey")).alias("title"), F.col("p_retailprice").alias("price"), "p_partkey")
    for half in (0, 1):
        sinks.write_scrape_log(products.where(F.col("p_partkey") % 2 == half).drop("p_partkey"), at, products.select("site").distinct().withColumn("status", F.lit("ok")))
        streams.stream_scrape_log(t.spark, at, state, target, load).awaitTermination()
    ledger = sinks.Ledger(t.spark, target)
    ledger.add(ledger.finished()[-1], t.values([("again", "again", 0.0)], schema))
    return ledger.read(schema, ["title"]).drop("batch")


@query("t2_stream_favourites", "WITH l AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS entity_id FROM events), r AS (SELECT user_id, entity_id, max((ts, event_id)) AS gone FROM l WHERE event_type = 'error' GROUP BY ALL) SELECT l.user_id, l.entity_id, arg_min(event_id, (ts, event_id)) AS event_id FROM l LEFT JOIN r USING (user_id, entity_id) WHERE event_type IN ('view', 'click') AND (gone IS NULL OR (ts, event_id) > gone) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    # later events come first, and each part after a restart of the stream
    at, out, state = folder(t, "events"), folder(t, "changes"), folder(t, "favourites-state")
    action = F.when(F.col("event_type").isin("view", "click"), "add").when(F.col("event_type") == "error", "remove").otherwise("other")
    log_rows = t.events.select("event_id", "ts", "user_id", F.lit("page").alias("entity_type"), F.get_json_object("props", "$.k").cast("long").alias("entity_id"), action.alias("action"))
    for part in (2, 0, 1):
        log_rows.where(F.col("event_id") % 3 == part).write.mode("append").parquet(at)
        source = t.spark.readStream.schema(log_rows.schema).parquet(at)
        writer = streams.stream_favourites(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        writer.trigger(availableNow=True).start().awaitTermination()
    return streams.favourites_of(t.spark.read.parquet(out)).select("user_id", "entity_id", "event_id")
