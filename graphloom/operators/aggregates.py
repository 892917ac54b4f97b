"""Aggregations (A1-A17) and windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import dedupe_key, location_city, location_country
from ..functions.predicates import text_match
from .joins import member_edges, shared_counts


def count_children(parents: DataFrame, children: DataFrame, foreign: str, search: str | None = None, by_name: bool = False) -> DataFrame:
    """(id, name, n) with zero for childless parents; by count or by name, optionally of names containing a text."""
    counts = children.where(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias("id")).agg(F.count("*").alias("n"))
    wanted = parents.select("id", "name") if search is None else parents.select("id", "name").where(text_match(search, ["name"]))
    out = wanted.join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.orderBy("name", "id") if by_name else out.orderBy(F.desc("n"), "name", "id")


def summary(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: total, and how many rows meet each condition."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in conditions.items()))


def overlap(edges: Mapping[str, Sequence[tuple[DataFrame, str, str]]], seeds: DataFrame | None = None) -> DataFrame:
    """(seed, peer, label, shared): neighbours shared through all edge tables of a label; seeds (id) narrows the seeds.

    Joining on the neighbour is quadratic in a hub's degree by nature: each pair it connects is counted, where its members' blocks
    meet, or with ``seeds`` by a partial aggregate right after the join.
    """
    parts = []
    for label, tables in edges.items():
        df, self_col, nbr_col = tables[0] if len(tables) == 1 else (labelled({label: tables}), "member", "neighbour")
        if seeds is None:
            counts = shared_counts(df, self_col, nbr_col)
        else:
            e = member_edges(df, self_col, nbr_col)
            mine = e.withColumnRenamed("member", "seed").join(seeds.select(F.col("id").alias("seed")), "seed", "left_semi")
            counts = mine.join(e.withColumnRenamed("member", "peer"), "neighbour").where("seed <> peer").groupBy("seed", "peer").agg(F.count("*").alias("shared"))
        parts.append(counts.select("seed", "peer", F.lit(label).alias("label"), "shared"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def labelled(edges: Mapping[str, Sequence[tuple[DataFrame, str, str]]]) -> DataFrame:
    """(at, neighbour, member) of all edge tables: the label's place, and the neighbour as text that tells the tables of a label apart."""
    parts = []
    for at, tables in enumerate(edges.values()):
        for i, (df, self_col, nbr_col) in enumerate(tables):
            parts.append(df.select(F.lit(at).alias("at"), F.concat(F.lit(f"{i}:"), F.col(nbr_col).cast("string")).alias("neighbour"), F.col(self_col).alias("member")))
    return reduce(lambda a, b: a.unionByName(b), parts).where("member is not null and neighbour is not null")


def norm_by_max(df: DataFrame, group: str, value: str, out: str = "norm") -> DataFrame:
    """Value over the group's maximum, 0 if that is none. Two aggregates and a join, so no group needs one task."""
    top = df.groupBy(group).agg(F.max(value).alias("_top"))
    return df.join(top, group, "left").withColumn(out, F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(0.0)).drop("_top")


def modal(df: DataFrame, group: str, col: str, order: str, out: str = "modal") -> DataFrame:
    """Commonest value per group under a folded key, in its commonest spelling; ties go to what was seen first."""
    spelled = df.where(F.trim(F.col(col)) != "").groupBy(group, F.trim(F.col(col)).alias("_raw")).agg(F.count("*").alias("_n"), F.min(order).alias("_at"))
    folded = spelled.withColumn("_key", dedupe_key("_raw")).groupBy(group, "_key").agg(F.sum("_n").alias("_total"), F.min("_at").alias("_first"), F.min(F.struct(-F.col("_n"), "_at", "_raw")).alias("_best"))
    return folded.groupBy(group).agg(F.min(F.struct(-F.col("_total"), "_first", F.col("_best._raw").alias("raw"))).alias("_b")).select(group, F.col("_b.raw").alias(out))


def mode2(df: DataFrame, key: str, outer: str, inner: str) -> DataFrame:
    """Commonest outer value per key, and the commonest inner value within it; ties go to the lesser value."""
    counts = df.where(F.col(key).isNotNull() & F.col(outer).isNotNull()).groupBy(key, outer, inner).agg(F.count("*").alias("_n"))
    outers = counts.groupBy(key, outer).agg(F.sum("_n").alias("_o"), F.min(F.when(F.col(inner).isNotNull(), F.struct(-F.col("_n"), F.col(inner).alias("v")))).alias("_i"))
    best = outers.groupBy(key).agg(F.min(F.struct(-F.col("_o"), F.col(outer).alias("o"), F.col("_i.v").alias("i"))).alias("_b"))
    return best.select(key, F.col("_b.o").alias(outer), F.col("_b.i").alias(inner))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key, as one aggregate with partial results."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def group_by_country(df: DataFrame, location: str = "location", value: str = "n", by_name: bool = False) -> DataFrame:
    """(country, total, members, items): members by name within the country that ends a location; 'Other' comes last."""
    rows = df.select(location_country(location).alias("country"), "name", location_city(location).alias("city"), F.col(value).alias("n"))
    out = rows.groupBy("country").agg(F.sum("n").alias("total"), F.count("*").alias("members"), F.sort_array(F.collect_list(F.struct("name", "city", "n"))).alias("items"))
    keys = [F.col("country")] if by_name else [F.desc("total"), F.col("country")]
    return out.orderBy(F.col("country") == "Other", *keys)


def tree_counts(df: DataFrame, *levels: str) -> DataFrame:
    """Counts rolled up from the leaves to the root."""
    return df.rollup(*levels).agg(F.count("*").alias("n"))


def nest(df: DataFrame, category: str, subcategory: str, row: Column, other: str = "Other") -> DataFrame:
    """(category, children: map of subcategory to its rows); missing names read 'Other'."""
    named = df.select(F.coalesce(category, F.lit(other)).alias("category"), F.coalesce(subcategory, F.lit(other)).alias("subcategory"), row.alias("row"))
    leaves = named.groupBy("category", "subcategory").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return leaves.groupBy("category").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("subcategory", "rows")))).alias("children"))


def triple_stats(triples: DataFrame) -> DataFrame:
    """Distinct subjects of every predicate and object."""
    return triples.groupBy("predicate", "object").agg(F.countDistinct("subject").alias("subjects"))


def from_price(variants: Column | str) -> Column:
    """Struct (price, grams) of the cheapest priced variant; without prices, the least weight. Variants are structs of price and grams."""
    v = F.col(variants) if isinstance(variants, str) else variants
    grams = lambda x: F.when(x["grams"] > 0, x["grams"])
    priced = F.array_min(F.transform(F.filter(v, lambda x: x["price"] > 0), lambda x, i: F.struct(x["price"].alias("price"), i.alias("i"), grams(x).alias("grams"))))
    light = F.array_min(F.transform(F.filter(v, lambda x: x["grams"] > 0), lambda x: x["grams"]))
    return F.struct(priced["price"].alias("price"), F.when(priced.isNotNull(), priced["grams"]).otherwise(light).alias("grams"))


def assert_counts(a: Mapping[str, DataFrame], b: Mapping[str, DataFrame]) -> DataFrame:
    """(name, n_a, n_b, equal) of the tables of two sets."""
    sizes = lambda tables, out: reduce(lambda x, y: x.unionByName(y), (df.agg(F.count("*").alias(out)).withColumn("name", F.lit(n)) for n, df in tables.items()))
    return sizes(a, "n_a").join(sizes(b, "n_b"), "name", "full_outer").select("name", "n_a", "n_b", F.col("n_a").eqNullSafe(F.col("n_b")).alias("equal"))


def topk_per_group(df: DataFrame, part: str, score: str, k: int, threshold: float | None = None, key: str = "id") -> DataFrame:
    """The k best rows of each group; Spark prunes groups before the shuffle (WindowGroupLimit)."""
    kept = df if threshold is None else df.where(F.col(score) >= threshold)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(part).orderBy(F.desc(score), key))).where(F.col("rank") <= k)


def latest_by(df: DataFrame, key: str, confidence: str, tie: str) -> DataFrame:
    """The row of highest confidence per key."""
    return last_by(df, [key], [confidence, tie])


def prefer(df: DataFrame, keys: Sequence[str], worse: Column, order: str) -> DataFrame:
    """One row per key: one that is not ``worse`` if there is any, else the first."""
    return first_by(df, keys, [worse.cast("int"), order])


def canonical_owner(new: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """(key, id): the oldest existing row owns its key; a new key belongs to the first new row that has it."""
    old = existing.groupBy(key).agg(F.min_by("id", F.struct(order, "id")).alias("old_id"))
    fresh = new.groupBy(key).agg(F.min_by("id", F.struct(order, "id")).alias("new_id"))
    return fresh.join(old, key, "full_outer").select(key, F.coalesce("old_id", "new_id").alias("id"))


def pick_first(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
