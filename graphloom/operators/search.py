"""Search and recommendation."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import embed_text
from ..functions.predicates import text_match
from ..functions.scratch import materialised
from ..functions.vectors import centroid, cosine, similarity_join
from .aggregates import labelled, norm_by_max, overlap, topk_per_group
from .joins import by_blocks, meetings, member_blocks, merge_candidates

#: Peers by similarity that count for a hybrid score.
POOL = 50


def text_search(sources: Sequence[tuple[str, DataFrame]], query: str, limit: int = 20, types: Sequence[str] | None = None, where: Mapping[str, Column] | None = None) -> DataFrame:
    """(entity_type, id, label) of each source's rows whose label or description has the text, shortest labels first, in source order.

    Sources have id, label and description; ``where`` adds a predicate to a source. Each gives max(5, ceil(limit / sources)) rows at most.
    """
    chosen = [(n, df) for n, df in sources if types is None or n in types]
    per = max(5, -(-limit // max(1, len(chosen))))
    parts = []
    for at, (name, df) in enumerate(chosen):
        hits = df.where(text_match(query, ["label", "description"]))
        hits = hits.where(where[name]) if where and name in where else hits
        parts.append(hits.orderBy(F.length("label"), "id").limit(per).select(F.lit(at).alias("_at"), F.lit(name).alias("entity_type"), F.col("id").cast("string").alias("id"), "label"))
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy("_at", F.length("label"), "id").limit(limit).drop("_at")


def semantic_search(sources: Sequence[tuple[str, DataFrame]], vector: Sequence[float], limit: int = 20, types: Sequence[str] | None = None, where: Mapping[str, Column] | None = None) -> DataFrame:
    """(entity_type, id, label, score) nearest to a vector; each source is capped, then all are ranked together."""
    chosen = [(n, df) for n, df in sources if types is None or n in types]
    per = max(5, -(-limit // max(1, len(chosen))))
    query = F.array(*(F.lit(float(x)) for x in vector))
    parts = []
    for name, df in chosen:
        rows = df.where(F.col("embedding").isNotNull())
        rows = rows.where(where[name]) if where and name in where else rows
        scored = rows.select(F.lit(name).alias("entity_type"), F.col("id").cast("string").alias("id"), "label", cosine(F.col("embedding"), query).alias("score"))
        parts.append(scored.where("score is not null").orderBy(F.desc("score"), "id").limit(per))
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy(F.desc("score"), "entity_type", "id").limit(limit)


def counted(n: Column, noun: Column) -> Column:
    """'1 region', '3 regions', '3 countries'."""
    many = F.when(noun.endswith("y"), F.concat(F.regexp_replace(noun, "y$", ""), F.lit("ies"))).otherwise(F.concat(noun, F.lit("s")))
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, noun).otherwise(many))


def reason(counts: Column, cap: int = 3) -> Column:
    """'Shares 2 flavor notes, 1 region': counts is an array of structs (label, shared), shown most shared first, of equal ones in the array's order; null if empty."""
    placed = F.transform(counts, lambda c, at: F.struct((-c["shared"]).alias("n"), at.alias("at"), c["label"].alias("label")))
    ordered = F.slice(F.array_sort(F.filter(placed, lambda c: c["n"] < 0)), 1, cap)
    parts = F.transform(ordered, lambda c: counted(-c["n"], c["label"]))
    return F.when(F.size(ordered) > 0, F.concat(F.lit("Shares "), F.array_join(parts, ", ")))


def similar(items: DataFrame, edges: Mapping[str, Sequence[tuple[DataFrame, str, str]]], limit: int = 10, weight: float = 0.5, seeds: DataFrame | None = None, visible: Column | None = None) -> DataFrame:
    """(seed, id, label, score, reason) of the best peers of every seed, or of the given ones (id).

    score = cosine + weight * shared / most shared; a seed without a vector ranks by shared / most shared alone. Only the 50 nearest
    by cosine have one; others come in by shared neighbours alone. ``visible`` is a predicate on peers: hidden ones take none of the 50
    places and are no result, but count for the most shared, and may be seeds. Labels of edges are told in the order of ``edges``
    where equally many are shared. Items have a long id, label and embedding.
    """
    peers = items if visible is None else items.where(visible)
    seed_items = items if seeds is None else items.join(seeds.select("id"), "id", "left_semi")
    near = similarity_join(seed_items, peers, "id", "id", "embedding", None, POOL, exclude_self=True).select(F.col("a_id").alias("seed"), F.col("b_id").alias("peer"), "similarity")
    led = items.select(F.col("id").alias("seed"), F.when(cosine("embedding", "embedding").isNotNull(), weight).otherwise(1.0).alias("_weight"))
    scored = _scored_pairs(items, peers, edges, near, led, limit) if seeds is None else _scored(items, edges, seeds, near, led)
    named = scored.join(peers.select(F.col("id").alias("peer"), "label"), "peer")
    best = topk_per_group(named, "seed", "score", limit, key="peer")
    none = F.array().cast("array<struct<at:int,label:string,shared:bigint>>")
    return best.select("seed", F.col("peer").alias("id"), "label", "score", reason(F.coalesce("counts", none)).alias("reason"))


def _score() -> Column:
    return F.round(F.col("similarity") + F.col("_weight") * F.col("norm"), 6)


def _scored(items: DataFrame, edges: Mapping, seeds: DataFrame, near: DataFrame, led: DataFrame) -> DataFrame:
    """(seed, peer, counts, score, ...) of the candidates of a few seeds."""
    shared = overlap(edges, seeds).join(items.select(F.col("id").alias("seed")), "seed", "left_semi")
    position = F.create_map(*(F.lit(v) for pair in ((label, at) for at, label in enumerate(edges)) for v in pair))
    told = F.array_sort(F.collect_list(F.struct(position[F.col("label")].alias("at"), "label", "shared")))
    totals = shared.groupBy("seed", "peer").agg(F.sum("shared").alias("shared"), told.alias("counts"))
    merged = merge_candidates(near, totals, ["seed", "peer"])
    return norm_by_max(merged, "seed", "shared", "norm").join(led, "seed").withColumn("score", _score())


def _scored_pairs(items: DataFrame, peers: DataFrame, edges: Mapping, near: DataFrame, led: DataFrame, limit: int) -> DataFrame:
    """(seed, peer, counts, score) of all near pairs, and of those by shared neighbours alone of each seed's ``limit`` best.

    Every pair that shares something is counted where its members' blocks meet, and the near pairs go to the same tasks; there the
    most shared of each seed are found first, then its candidates, of which all but the best are dropped before any shuffle.
    """
    rows = labelled(edges)
    known = rows.select("member").unionByName(items.select(F.col("id").alias("member"))).distinct()
    flag = lambda df, to: df.select(F.col("id").alias("member"), F.lit(1).alias(to)).distinct()
    flagged = known.join(flag(items, "_item"), "member", "left").join(flag(peers, "_shown"), "member", "left")
    members = member_blocks(flagged)
    # a member is a number in the order of the ids; its last two bits tell whether it is a seed, and a visible item
    key = (F.col("_n") * 4 + F.coalesce("_item", F.lit(0)) * 2 + F.coalesce("_shown", F.lit(0))).alias("_k")
    members = materialised(members.select("member", "_g", key), "numbered")
    met = meetings(rows.join(members, "member").select("at", "neighbour", F.col("_k").alias("member"), "_g"), ["at", "neighbour"])
    of = lambda c, k, g: members.select(F.col("member").alias(c), F.col("_k").alias(k), F.col("_g").alias(g))
    placed = near.join(of("seed", "_s", "_gs"), "seed").join(of("peer", "_p", "_gp"), "peer")
    # a near pair is a meeting of one member with another, whose cosine belongs to one direction
    turned = F.col("_s") > F.col("_p")
    close = placed.select(
        F.least("_gs", "_gp").alias("_i"), F.greatest("_gs", "_gp").alias("_j"), F.when(turned, -2).otherwise(-1).alias("at"), F.array("_s", "_p").alias("_a"), F.array(F.greatest("_s", "_p")).alias("_b"), "similarity"
    )
    # within a block a list has both members, as pairs are of one list there
    close = close.withColumn("_a", F.when(F.col("_i") < F.col("_j"), F.array(F.array_min("_a"))).otherwise(F.col("_a"))).withColumn("_b", F.when(F.col("_i") < F.col("_j"), F.col("_b")))
    met = materialised(met.withColumn("similarity", F.lit(None).cast("double")).unionByName(close), "meetings")
    counts = [F.count_if(F.col("at") == at).alias(f"_c{at}") for at in range(len(edges))]
    pairs = by_blocks(met).groupBy("_i", "_j", "a", "b").agg(*counts, F.max(F.when(F.col("at") == -1, F.col("similarity"))).alias("_forth"), F.max(F.when(F.col("at") == -2, F.col("similarity"))).alias("_back"))
    shared = reduce(lambda x, y: x + y, (F.col(f"_c{at}") for at in range(len(edges))))
    each = [c.alias(f"_c{at}") for at, c in ((at, F.col(f"_c{at}")) for at in range(len(edges)))]
    way = lambda s, p, sim: F.struct(F.col(s).alias("_s"), F.col(p).alias("_p"), F.col(sim).alias("_sim"), shared.alias("shared"), *each)
    both = pairs.select(F.inline(F.array(way("a", "b", "_forth"), way("b", "a", "_back")))).where("shared > 0 or _sim is not null").where("_s & 2 = 2")
    top = both.groupBy("_s").agg(F.max("shared").alias("_top"))
    ranked = top.join(members.select(F.col("_k").alias("_s"), F.col("member").alias("seed")), "_s").join(led, "seed")
    ranked = materialised(ranked, "most-shared")
    found = both.where("_p & 1 = 1").join(ranked, "_s").withColumn("similarity", F.coalesce("_sim", F.lit(0.0)))
    found = found.withColumn("norm", F.when(F.col("_top") > 0, F.col("shared") / F.col("_top")).otherwise(0.0)).withColumn("score", _score())
    best = topk_per_group(found.select("seed", "_p", "score", *(f"_c{at}" for at in range(len(edges)))), "seed", "score", limit, key="_p").drop("rank")
    told = F.array(*(F.struct(F.lit(at).alias("at"), F.lit(label).alias("label"), F.col(f"_c{at}").alias("shared")) for at, label in enumerate(edges)))
    named = best.join(members.select(F.col("_k").alias("_p"), F.col("member").alias("peer")), "_p")
    return named.select("seed", "peer", "score", F.filter(told, lambda c: c["shared"] > 0).alias("counts"))


def for_user(activity: DataFrame, items: DataFrame, limit: int = 10, noun: str = "item", visible: Column | None = None) -> DataFrame:
    """(user_id, id, label, score, reason): items nearest to the mean of what each user saved, which are left out themselves.

    ``visible`` is a predicate on what is recommended; hidden saved items count for the mean and for the number told.
    """
    shown = items if visible is None else items.where(visible)
    saved = activity.select("user_id", F.col("entity_id").alias("id")).distinct()
    taste = centroid(saved.join(items.select("id", "embedding"), "id"), "user_id", "embedding").where("centroid is not null")
    saves = saved.groupBy("user_id").agg(F.count("*").alias("n"), F.collect_list("id").alias("saved"))
    near = similarity_join(taste.withColumnRenamed("centroid", "embedding").join(saves, "user_id"), shown, "user_id", "id", "embedding", None, limit, skip="saved")
    fresh = near.select(F.col("a_id").alias("user_id"), F.col("b_id").alias("id"), F.round("similarity", 6).alias("score"))
    best = topk_per_group(fresh, "user_id", "score", limit).join(shown.select("id", "label"), "id").join(saves.select("user_id", "n"), "user_id")
    text = F.concat(F.lit("Based on "), counted(F.col("n"), F.lit(noun)), F.lit(" you saved"))
    return best.select("user_id", "id", "label", "score", text.alias("reason"))


class HashEmbedder:
    """A deterministic stand-in for an embedding model: signed word hashes, scaled to length one."""

    def __init__(self, size: int = 8) -> None:
        self.size = size

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out


def embed_missing(df: DataFrame, embedder: Callable[[list[str]], list[list[float]]], size: int, key: str = "id", name: str = "name", description: str = "description") -> DataFrame:
    """Fill null embeddings; those that are there are kept. A wrong length is an error."""
    kind = dict(df.dtypes)[key]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = embedder(batch["_text"].tolist())
            if any(len(v) != size for v in vectors):
                raise ValueError(f"the embedder must give {size} numbers")
            yield pd.DataFrame({key: batch[key], "_new": vectors})

    todo = df.where(F.col("embedding").isNull()).select(key, embed_text(name, description).alias("_text"))
    made = todo.mapInPandas(fill, f"{key} {kind}, _new array<float>")
    return df.join(made, key, "left").withColumn("embedding", F.coalesce("embedding", "_new")).select(*df.columns)


def embed_tables(tables: Mapping[str, DataFrame], embedder: Callable, size: int, targets: Sequence[str] | None = None, opt_in: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Backfill the chosen tables, by default all that are not opt-in; an unknown target is an error."""
    if unknown := set(targets or ()) - set(tables):
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    chosen = [t for t in tables if t in targets] if targets is not None else [t for t in tables if t not in opt_in]
    return {t: embed_missing(df, embedder, size) if t in chosen else df for t, df in tables.items()}


cloudpickle.register_pickle_by_value(sys.modules[__name__])
