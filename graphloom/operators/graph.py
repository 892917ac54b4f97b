"""Graph building and graph queries.

Edges have src_id, src_type, dst_id, dst_type, edge_type, weight and effect; vertices have id, entity_type and label.
Traversals run for all seeds or pairs at once, one join per level, and write each level to shared storage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import edge_id, join_domain
from ..functions.scratch import materialised
from ..functions.vectors import similarity_join
from .joins import beside, compose, mention_join, resolve_name, rule_join, site_pairs, sites, unrepeated

EDGE = "src_id string, src_type string, dst_id string, dst_type string, edge_type string, weight double, effect string"


def typed_edges(df: DataFrame, edge_type: str, src: str, src_type: str, dst: str, dst_type: str, weight: str | None = None, effect: str | None = None) -> DataFrame:
    """Edges of one type in the common shape; null ends are skipped; of repeats the one of greatest weight, then effect, stays."""
    ends = df.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(
        F.col(src).cast("string").alias("src_id"), F.lit(src_type).alias("src_type"), F.col(dst).cast("string").alias("dst_id"), F.lit(dst_type).alias("dst_type"), F.lit(edge_type).alias("edge_type"),
        (F.col(weight).cast("double") if weight else F.lit(None).cast("double")).alias("weight"), (F.col(effect) if effect else F.lit(None).cast("string")).alias("effect"),
    )
    if weight is None and effect is None:
        return ends.dropDuplicates(["src_id", "dst_id"])
    one = ends.groupBy("src_id", "src_type", "dst_id", "dst_type", "edge_type").agg(F.max(F.struct("weight", "effect")).alias("_e"))
    return one.select("src_id", "src_type", "dst_id", "dst_type", "edge_type", "_e.weight", "_e.effect")


# The edge types of the knowledge graph, and how an end's entity type and id column are called where not after it.
EDGE_TYPES = (
    "country_region", "region_farm", "variety_flavor", "country_variety", "region_variety", "farm_variety", "variety_processing", "processing_flavor", "roast_variety", "product_variety",
    "product_region", "product_country", "product_flavor", "product_roast", "roaster_product", "shop_roaster", "shop_product", "shop_variety", "product_farm", "shop_farm",
)
ENTITY_OF = {"roast": "roast_profile"}
ID_OF = {"processing": "method_id", "roast": "profile_id"}


def catalog_edges(tables: Mapping[str, DataFrame], types: Sequence[str] = EDGE_TYPES) -> DataFrame:
    """The unified graph: edges of all types whose table (edges_<type>, or <type>) is there, in the common shape.

    A type names its two ends; their id columns are <end>_id but for ID_OF. A weight or effect column is taken along. Each table
    is scanned for these columns alone.
    """
    parts = []
    for kind in types:
        df = tables.get(f"edges_{kind}", tables.get(kind))
        if df is not None:
            a, b = kind.split("_", 1)
            parts.append(typed_edges(df, kind, ID_OF.get(a, f"{a}_id"), ENTITY_OF.get(a, a), ID_OF.get(b, f"{b}_id"), ENTITY_OF.get(b, b), *(c if c in df.columns else None for c in ("weight", "effect"))))
    if not parts:
        raise ValueError("no table of a known edge type")
    return reduce(DataFrame.unionByName, parts)


def edges_from_fk(children: DataFrame, parent: str, child: str, prefix: str) -> DataFrame:
    """(id, parent, child) of every child with a parent."""
    return children.where(F.col(parent).isNotNull()).select(edge_id(prefix, parent, child).alias("id"), parent, child)


def edges_from_similarity(a: DataFrame, b: DataFrame, a_id: str, b_id: str, vec: str, k: int = 5, threshold: float = 0.4) -> DataFrame:
    """(a_id, b_id, strength): the k nearest above a threshold."""
    return similarity_join(a, b, a_id, b_id, vec, threshold, k).withColumnRenamed("similarity", "strength")


def edges_from_cooccurrence(samples: DataFrame, levels: Mapping[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """Per edge type, the distinct pairs of two columns that both have a value."""
    return {t: samples.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b).distinct() for t, (a, b) in levels.items()}


def edges_from_mentions(docs: DataFrame, kinds: Mapping[str, dict]) -> DataFrame:
    """(edge_type, doc_id, entity_id) of several kinds of entity; kinds: edge type -> names and options of mention_join."""
    return reduce(lambda a, b: a.unionByName(b), (mention_join(docs, **options).withColumn("edge_type", F.lit(t)) for t, options in kinds.items()))


def edges_from_chain(shops: DataFrame, roasters: DataFrame, roaster_product: DataFrame, product_edges: Mapping[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """shop_roaster by domain, shop_product through it, and a shop edge for every kind of product edge.

    All shops of a domain have the same products and what these lead to, so that is found once for the domain and only then told of each
    shop; a shop of one domain has no edge twice.
    """
    a, b = materialised(sites(shops, "id", "website", join_domain, "a_id"), "shops"), materialised(sites(roasters, "id", "website", join_domain, "b_id"), "roasters")
    here = b.join(a.select("_d").distinct(), "_d", "left_semi").select("_d", F.col("b_id").alias("roaster_id"))
    products = materialised(compose(here, roaster_product, "_d", "roaster_id", "product_id"), "products")
    led = {"shop_product": (products, "product_id")} | {t: (compose(products, df, "_d", "product_id", to), to) for t, (df, to) in product_edges.items()}
    told = lambda df, to: unrepeated(beside(a.withColumnRenamed("a_id", "shop_id"), df, "_d"), "shop_id", to, F.col("a_id_many"))
    shop_roaster = site_pairs(a, b).select(F.col("a_id").alias("shop_id"), F.col("b_id").alias("roaster_id"))
    return {"shop_roaster": shop_roaster} | {t: told(df, to) for t, (df, to) in led.items()}


def edges_from_rules(rules: DataFrame, entities: DataFrame, prefix: str) -> DataFrame:
    found = rule_join(rules, entities)
    return found.select(edge_id(prefix, "rule_id", "entity_id").alias("id"), "rule_id", "entity_id")


def edges_from_curation(relations: DataFrame, methods: DataFrame, flavors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (method_id, flavor_id, effect), and the names that no flavour has. Relations: category, enhances[], diminishes[]."""
    named = relations.select("category", F.explode(F.array(F.struct(F.lit("enhances").alias("effect"), F.col("enhances").alias("names")), F.struct(F.lit("diminishes").alias("effect"), F.col("diminishes").alias("names")))).alias("r"))
    named = named.select("category", F.col("r.effect").alias("effect"), F.explode("r.names").alias("name"))
    resolved = resolve_name(named, flavors)
    known = resolved.where("id is not null").select(F.lower("category").alias("category"), "effect", F.col("id").alias("flavor_id"))
    edges = known.join(methods.select(F.col("id").alias("method_id"), F.lower("category").alias("category")), "category")
    return edges.select("method_id", "flavor_id", "effect").distinct(), resolved.where("id is null").select("name").distinct()


def graph_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"))


def adjacency(edges: DataFrame, vertices: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """(node, other, src_id, dst_id, edge_type): every edge from both its ends, if both exist."""
    kept = edges if types is None else edges.where(F.col("edge_type").isin(list(types)))
    known = vertices.select("id").distinct()
    kept = kept.select("src_id", "dst_id", "edge_type").distinct().join(known.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(known.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    there = F.struct(F.col("src_id").alias("node"), F.col("dst_id").alias("other"))
    back = F.struct(F.col("dst_id").alias("node"), F.col("src_id").alias("other"))
    ends = F.when(F.col("src_id") == F.col("dst_id"), F.array(there)).otherwise(F.array(there, back))
    return kept.select(F.inline(ends), "src_id", "dst_id", "edge_type")


def reach(seeds: DataFrame, links: DataFrame, max_depth: int) -> DataFrame:
    """(seed, node, depth) of all nodes within ``max_depth`` links (node, other) of each seed (seed).

    Links go both ways, so what is next to a level is in that level, the one before or the next: a step is compared with
    the last two levels alone.
    """
    visited = materialised(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct(), "reach")
    frontier = recent = visited
    for depth in range(1, max_depth + 1):
        step = frontier.select("seed", "node").join(links.select("node", "other"), "node").select("seed", F.col("other").alias("node")).distinct()
        fresh = materialised(step.join(recent.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if depth < max_depth and fresh.isEmpty():
            break
        visited, recent, frontier = visited.unionByName(fresh), frontier.unionByName(fresh), fresh
    return visited


def traverse(seeds: DataFrame, edges: DataFrame, vertices: DataFrame, max_depth: int = 2, types: Sequence[str] | None = None, max_nodes: int | None = 1000, max_edges: int | None = 5000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (seed, id, entity_type, label, depth), edges (seed, src_id, dst_id, edge_type) and, per seed, whether a budget cut them.

    Nodes are all within max_depth; edges all that touch a node nearer than that. Over a budget the first in order of depth and id stay.
    """
    links = materialised(adjacency(edges, vertices, types), "adjacency")
    found = reach(seeds, materialised(links.select("node", "other").distinct(), "links"), max_depth)
    touched = found.where(F.col("depth") < max_depth).join(links, "node").groupBy("seed", "src_id", "dst_id", "edge_type").agg(F.min("depth").alias("depth"))
    cut = seeds.select("seed").distinct().withColumn("truncated", F.lit(False))
    if max_nodes is not None:
        order = Window.partitionBy("seed").orderBy("depth", "node")
        ranked = found.withColumn("_r", F.row_number().over(order))
        over = ranked.groupBy("seed").agg((F.max("_r") > max_nodes).alias("_o"))
        found = ranked.where(F.col("_r") <= max_nodes).drop("_r")
        ends = found.select("seed", "node")
        touched = touched.join(ends.withColumnRenamed("node", "src_id"), ["seed", "src_id"], "left_semi").join(ends.withColumnRenamed("node", "dst_id"), ["seed", "dst_id"], "left_semi")
        cut = cut.join(over, "seed", "left").select("seed", (F.col("truncated") | F.coalesce("_o", F.lit(False))).alias("truncated"))
    if max_edges is not None:
        order = Window.partitionBy("seed").orderBy("depth", "src_id", "dst_id", "edge_type")
        ranked = touched.withColumn("_r", F.row_number().over(order))
        over = ranked.groupBy("seed").agg((F.max("_r") > max_edges).alias("_o"))
        touched = ranked.where(F.col("_r") <= max_edges).drop("_r")
        cut = cut.join(over, "seed", "left").select("seed", (F.col("truncated") | F.coalesce("_o", F.lit(False))).alias("truncated"))
    nodes = found.join(vertices.select(F.col("id").alias("node"), "entity_type", "label"), "node").select("seed", F.col("node").alias("id"), "entity_type", "label", "depth")
    return nodes, touched.select("seed", "src_id", "dst_id", "edge_type"), cut


def numbered(vertices: DataFrame) -> DataFrame:
    """(id, n) of the distinct ids, with numbers in the order of the ids."""
    return materialised(vertices.select("id").where("id is not null").distinct().orderBy("id").withColumn("n", F.monotonically_increasing_id()), "numbers")


def shortest_path(pairs: DataFrame, edges: DataFrame, vertices: DataFrame, max_depth: int = 6, types: Sequence[str] | None = None, max_visited: int | None = None) -> DataFrame:
    """(start, end, path, weight) of pairs (start, end) that are joined by at most ``max_depth`` edges; of equal paths the one through lesser ids wins.

    Both ends grow level by level until they meet, for all pairs at once; each pair grows the side whose newest level is smaller. Nodes
    and pairs are numbers here. A level holds each node once with its parent, so rows do not grow with the depth; the path is read
    back from the edge where the sides met, one join for each level. From the start a node's parent is the one whose own path is least,
    by its rank; towards the end it is the least next node; so the path is the least of all shortest ones wherever the sides meet.
    A step is compared with the last two levels alone, as links go both ways. With ``max_visited`` a pair whose two sides hold more
    nodes than that is given up: it has a row with a null path and ``truncated`` true.
    """
    spark, numbers = pairs.sparkSession, numbered(vertices)
    as_number = lambda df, c, to: df.join(numbers.select(F.col("id").alias(c), F.col("n").alias(to)), c)
    wanted = as_number(as_number(pairs.select("start", "end").distinct(), "start", "a"), "end", "z")
    wanted = materialised(wanted.withColumn("pair", F.monotonically_increasing_id()), "pairs")
    links = materialised(as_number(as_number(adjacency(edges, vertices, types).select("node", "other").distinct(), "node", "n1"), "other", "n2").select(F.col("n1").alias("node"), F.col("n2").alias("other")), "adjacency")
    key = ["pair", "node"]
    sides = ("start", "end")
    # levels[side][d]: pair, node, parent, rank (of the path from the start, within its level)
    first = {side: wanted.select("pair", F.col(c).alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("rank")) for side, c in zip(sides, "az", strict=True)}
    levels = {side: [materialised(df, f"level-{side}")] for side, df in first.items()}
    # for each open pair: depth and size of either side's newest level, and all nodes held
    state = materialised(wanted.where("a <> z").select("pair", F.lit(0).alias("d_start"), F.lit(0).alias("d_end"), F.lit(1).cast("long").alias("n_start"), F.lit(1).cast("long").alias("n_end"), F.lit(2).cast("long").alias("held")), "open")
    met = wanted.where("a = z").select("pair", F.lit(0).alias("weight"), F.col("a").alias("left"), F.lit(None).cast("long").alias("right"), F.lit(0).alias("d_left"), F.lit(0).alias("d_right"))
    given_up: list[DataFrame] = []

    def newest(side: str, of: DataFrame, back: int = 0) -> DataFrame:
        """The rows of each pair's newest level of a side, or the one before."""
        parts = [df.withColumn("_d", F.lit(d + back)) for d, df in enumerate(levels[side])]
        rows = reduce(DataFrame.unionByName, parts)
        return rows.join(of.select("pair", F.col(f"d_{side}").alias("_d")), ["pair", "_d"]).drop("_d")

    for weight in range(1, max_depth + 1):
        if max_visited is not None:
            given_up.append(materialised(state.where(F.col("held") > max_visited).select("pair"), "given-up"))
            state = state.where(F.col("held") <= max_visited)
        grows = {"start": state.where("n_start <= n_end"), "end": state.where("n_start > n_end")}
        steps = {side: newest(side, of).select("pair", "node", "rank").join(links, "node") for side, of in grows.items()}
        # an edge from one newest level to the other: the path from the start to its left node is least, then its right node
        forth = steps["start"].select("pair", F.col("rank"), F.col("node").alias("left"), F.col("other").alias("right")).join(newest("end", grows["start"]).select("pair", F.col("node").alias("right")), ["pair", "right"])
        back = steps["end"].select("pair", F.col("other").alias("left"), F.col("node").alias("right")).join(newest("start", grows["end"]).select("pair", F.col("node").alias("left"), "rank"), ["pair", "left"])
        best = forth.unionByName(back).groupBy("pair").agg(F.min(F.struct("rank", "left", "right")).alias("_e"))
        found = materialised(best.join(state, "pair").select("pair", F.lit(weight).alias("weight"), "_e.left", "_e.right", F.col("d_start").alias("d_left"), F.col("d_end").alias("d_right")), "met")
        met = met.unionByName(found)
        if weight == max_depth:
            break
        state = materialised(state.join(found.select("pair"), "pair", "left_anti"), "open")
        if state.isEmpty():
            break
        fresh = {}
        for side in sides:
            own = state.where("n_start <= n_end" if side == "start" else "n_start > n_end")
            parent = F.min(F.struct("rank", F.col("node").alias("parent"))).alias("_p") if side == "start" else F.min(F.struct(F.col("node").alias("parent"))).alias("_p")
            step = newest(side, own).select("pair", "node", "rank").join(links, "node").groupBy("pair", F.col("other").alias("_o")).agg(parent).withColumnRenamed("_o", "node")
            seen = newest(side, own).select(*key).unionByName(newest(side, own, 1).select(*key))
            step = step.join(seen, key, "left_anti").join(own.select("pair", (F.col(f"d_{side}") + 1).alias("_d")), "pair")
            if side == "start":
                # of one level the paths have their order from the parent's and the node
                order = Window.partitionBy("pair").orderBy("_p.rank", "node")
                step = step.withColumn("rank", F.when(F.col("_d") == 1, F.col("node")).otherwise(F.row_number().over(order).cast("long")))
            else:
                step = step.withColumn("rank", F.lit(0).cast("long"))
            fresh[side] = materialised(step.select("pair", "node", F.col("_p.parent").alias("parent"), "rank", "_d"), f"level-{side}")
            depths = range(1, weight + 1)
            for d in depths:
                rows = fresh[side].where(F.col("_d") == d).drop("_d")
                if d < len(levels[side]):
                    levels[side][d] = levels[side][d].unionByName(rows)
                else:
                    levels[side].append(rows)
        grown = reduce(DataFrame.unionByName, (df.groupBy("pair").agg(F.count("*").alias("_n")).withColumn("_side", F.lit(side)) for side, df in fresh.items()))
        # a side that has no new node can't meet the other: its pair has no row here and is closed
        turned = state.join(grown, "pair")
        at = lambda side: F.col("_side") == side
        state = materialised(
            turned.select("pair", *((F.col(f"d_{x}") + at(x).cast("int")).alias(f"d_{x}") for x in sides), *(F.when(at(x), F.col("_n")).otherwise(F.col(f"n_{x}")).alias(f"n_{x}") for x in sides), (F.col("held") + F.col("_n")).alias("held")),
            "open",
        )
        if state.isEmpty():
            break

    # the nodes of each path by their place, read back from where the sides met
    met = materialised(met, "met")
    places = [met.select("pair", F.col("d_left").alias("at"), F.col("left").alias("node")), met.where("right is not null").select("pair", (F.col("d_left") + 1).alias("at"), F.col("right").alias("node"))]
    for side, c, way in (("start", "left", -1), ("end", "right", 1)):
        begun = met.select("pair", F.col(c).alias("node"), F.col(f"d_{c}").alias("d"), (F.col("d_left") + int(way > 0)).alias("at")).where("node is not null")
        up = begun.limit(0)
        for d in range(len(levels[side]) - 1, 0, -1):
            here = begun.where(F.col("d") == d).unionByName(up)
            up = here.join(levels[side][d].select(*key, "parent"), key).select("pair", F.col("parent").alias("node"), F.lit(d - 1).alias("d"), (F.col("at") + way).alias("at"))
            places.append(up.select("pair", "at", "node"))
    named = reduce(DataFrame.unionByName, places).join(numbers.select(F.col("n").alias("node"), "id"), "node")
    whole = named.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("_p")).select("pair", F.col("_p.id").alias("path"))
    done = wanted.select("pair", "start", "end").join(whole, "pair").join(met.select("pair", "weight"), "pair").select("start", "end", "path", "weight")
    if max_visited is None:
        return done
    lost = reduce(DataFrame.unionByName, given_up) if given_up else spark.createDataFrame([], "pair long")
    lost = wanted.join(lost, "pair", "left_semi").select("start", "end", F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("int").alias("weight"), F.lit(True).alias("truncated"))
    return done.withColumn("truncated", F.lit(False)).unionByName(lost)


def path_rows(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, end, step, src_id, dst_id, edge_type): the edges of each path in their own direction; of parallel ones the least type."""
    steps = paths.where("weight > 0").select("start", "end", F.posexplode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] as a, path[i] as b))")).alias("step", "s"))
    both = edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), "src_id", "dst_id", "edge_type").unionByName(edges.select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"), "src_id", "dst_id", "edge_type"))
    found = steps.select("start", "end", "step", "s.a", "s.b").join(both, ["a", "b"])
    return found.groupBy("start", "end", "step").agg(F.min(F.struct("edge_type", "src_id", "dst_id")).alias("e")).select("start", "end", "step", "e.src_id", "e.dst_id", "e.edge_type")


def induced(nodes: DataFrame, edges: DataFrame, n: int, pinned: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The first n nodes by depth and id, plus a pinned one, and the edges between them."""
    kept = nodes.orderBy("depth", "id").limit(n)
    if pinned is not None:
        kept = kept.unionByName(nodes.where(F.col("id") == pinned)).dropDuplicates(["id"])
    ends = kept.select("id")
    inside = edges.join(ends.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ends.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    return kept, inside.select(*edges.columns)
