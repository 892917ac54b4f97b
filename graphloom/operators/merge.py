"""Keeping enrichment while sources change (E1, E2, E4, E5, E8, E15), scoring (E6) and pruning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import chain_domain, fold_name, location_country, lookup
from ..functions.predicates import non_blank
from .aggregates import latest_by
from .joins import has_match

# Weights of the signals and thresholds of the score.
WEIGHTS = {"curated": 0.6, "description": 0.3, "in_house": 0.2, "rating": 0.2, "website": 0.1}
RATING_THRESHOLD = 4.0
FLAG_THRESHOLD = 0.2


def upsert(base: DataFrame, source: DataFrame, owned: Sequence[str], key: str = "id", confidence: str | None = None, created: str | None = None, now: Column | None = None) -> DataFrame:
    """Refresh source-owned columns, keep the rest of known rows, add new rows with nulls there, and keep rows outside the source."""
    fresh = source if confidence is None else latest_by(source, key, confidence, owned[0])
    side = fresh.select(key, *(F.col(c).alias(f"_new_{c}") for c in owned), F.lit(True).alias("_hit"))
    joined = base.withColumn("_old", F.lit(True)).join(side, key, "full_outer")

    def column(c: str) -> Column:
        if c == key:
            return F.col(c)
        if c in owned:
            return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        if c == created and now is not None:
            return F.when(F.col("_old"), F.col(c)).otherwise(now).alias(c)
        return F.col(c)

    return joined.select(*(column(c) for c in base.columns))


def rebuild(old: DataFrame, new: DataFrame, enriched: Sequence[str], key: str = "id") -> DataFrame:
    """The new rows with the enrichment that old rows of the same key have, and all old rows that the rebuild lacks."""
    side = old.select(key, *(F.col(c).alias(f"_old_{c}") for c in enriched))
    carried = new.join(side, key, "left").select(*(F.coalesce(F.col(f"_old_{c}"), F.col(c)).alias(c) if c in enriched else F.col(c) for c in new.columns))
    return carried.unionByName(old.join(new.select(key), key, "left_anti").select(*new.columns))


def surviving_edges(edges: DataFrame, parents: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Edges whose ends all still exist; parents: edge column -> (table, key)."""
    return reduce(lambda e, p: e.join(p[1][0].select(F.col(p[1][1]).alias(p[0])).distinct(), p[0], "left_semi"), parents.items(), edges)


def fill_blank(df: DataFrame, target: str, *sources: Column, overwrite: bool = False) -> DataFrame:
    """Fill a blank column from the first source that has a value; overwrite takes sources before the column."""
    own = F.when(non_blank(target), F.col(target))
    return df.withColumn(target, F.coalesce(*sources, own) if overwrite else F.coalesce(own, *sources))


def fill_locations(roasters: DataFrame, curated: DataFrame, shops: DataFrame, overwrite: bool = False) -> DataFrame:
    """Locations by curated name first, then from the commonest place of the shops on the roaster's host; adds status."""
    from .aggregates import mode2

    places = mode2(shops.select(chain_domain("website").alias("_host"), "country", "city").where("_host <> ''"), "_host", "country", "city")
    derived = places.select("_host", F.concat_ws(", ", "city", "country").alias("_derived"))
    known = roasters.withColumn("_host", chain_domain("website")).join(curated.select("name", F.col("location").alias("_curated")), "name", "left").join(derived, "_host", "left")
    had = non_blank("location")
    out = fill_blank(known.withColumn("_had", had), "location", F.col("_curated"), F.col("_derived"), overwrite=overwrite)
    found = F.coalesce("_curated", "_derived").isNotNull()
    status = F.when(F.col("_had") & (F.lit(not overwrite) | ~found), "already set").when(found, "updated").otherwise("unmatched")
    return out.withColumn("status", status).select(*roasters.columns, "status")


def fill_currency(products: DataFrame, roasters: DataFrame, by_country: Mapping[str, str]) -> DataFrame:
    """Currency of priced products without one, from the country that ends their roaster's location."""
    side = roasters.select(F.col("id").alias("roaster_id"), lookup(location_country("location"), by_country).alias("_c"))
    joined = products.join(side, "roaster_id", "left")
    return joined.withColumn("currency", F.when(F.col("currency").isNull() & F.col("price").isNotNull(), F.col("_c")).otherwise(F.col("currency"))).select(*products.columns)


def word_prefixes(c: Column) -> Column:
    words = F.split(c, " ")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))


def chain_flags(df: DataFrame, allow: Sequence[str], block: Sequence[str], name: str = "name", key: str = "id") -> DataFrame:
    """(id, allowed, blocked): the folded name equals a chain's or starts with it and a space; allowed names are never blocked.

    A name's word prefixes are joined to the chains by equality.
    """
    spark = df.sparkSession
    chains = spark.createDataFrame([(n, True) for n in allow] + [(n, False) for n in block], "chain string, good boolean").select(fold_name("chain").alias("_p"), "good").where("_p <> ''").distinct()
    folded = df.select(key, fold_name(name).alias("_n"))
    prefixes = folded.select(key, F.explode(word_prefixes(F.col("_n"))).alias("_p"))
    found = prefixes.join(chains, "_p").groupBy(key).agg(F.max("good").alias("allowed"), F.max(~F.col("good")).alias("bad"))
    out = df.select(key).distinct().join(found, key, "left")
    allowed = F.coalesce("allowed", F.lit(False))
    return out.select(key, allowed.alias("allowed"), (F.coalesce("bad", F.lit(False)) & ~allowed).alias("blocked"))


def host_in(site: Column | str, hosts: Sequence[str], suffix: bool = False) -> Column:
    """The site's host is one of these, or with ``suffix`` a subdomain of one."""
    host = chain_domain(site)
    if not suffix:
        return host.isin(list(hosts))
    return reduce(lambda a, b: a | b, ((host == h) | host.endswith("." + h) for h in hosts), F.lit(False))


def score_flag(shops: DataFrame, shop_roaster: DataFrame, allow: Sequence[str] = (), block: Sequence[str] = (), block_hosts: Sequence[str] = (), social_hosts: Sequence[str] = ()) -> DataFrame:
    """Add specialty_score and is_specialty: allowed chains 1, blocked ones 0, else the capped sum of signals."""
    marked = has_match(shops, "id", shop_roaster, "shop_id", "_curated").join(chain_flags(shops, allow, block), "id")
    blocked = F.col("blocked") | host_in("website", block_hosts)
    signals = [
        (F.col("_curated"), "curated"),
        (F.col("description").isNotNull() & ~host_in("website", social_hosts, suffix=True), "description"),
        (F.coalesce("roasts_in_house", F.lit(False)), "in_house"),
        (F.coalesce(F.col("rating") >= RATING_THRESHOLD, F.lit(False)), "rating"),
        (F.coalesce(non_blank("website"), F.lit(False)), "website"),
    ]
    total = reduce(lambda a, b: a + b, (F.when(c, F.lit(WEIGHTS[n])).otherwise(0.0) for c, n in signals))
    score = F.when(F.col("allowed"), 1.0).when(blocked, 0.0).otherwise(F.least(F.lit(1.0), total))
    scored = marked.withColumn("specialty_score", score).withColumn("is_specialty", F.col("allowed") | (~blocked & (F.col("specialty_score") >= FLAG_THRESHOLD)))
    return scored.select(*shops.columns, "specialty_score", "is_specialty")


def work_list(items: DataFrame, log: DataFrame, key: str, terminal: Sequence[str], limit: int | None = None, allow: Sequence[str] = (), block: Sequence[str] = (), block_hosts: Sequence[str] = ()) -> DataFrame:
    """Items without any terminal outcome in the log, in order of key; other outcomes are tried again.

    With ``block`` or ``block_hosts`` items (name, website) of blocked chains, by name or host, are left out before the limit; ``allow``
    names chains that stay whatever their name starts with.
    """
    done = log.where(F.col("status").isin(list(terminal))).select(key).distinct()
    out = items.join(done, key, "left_anti")
    if block:
        out = out.join(chain_flags(out, allow, block, key=key).where("blocked").select(key), key, "left_anti")
    if block_hosts:
        out = out.where(~F.coalesce(host_in("website", block_hosts), F.lit(False)))
    out = out.orderBy(key)
    return out if limit is None else out.limit(limit)


def newest_first(rows: DataFrame, *ties: str, created: str = "created_at") -> DataFrame:
    """Rows with the newest first; those of one time in order of ``ties``."""
    return rows.orderBy(F.desc_nulls_last(created), *ties)


def activity_state(log: DataFrame, vertices: DataFrame, score_range: tuple[float, float] = (0.0, 100.0)) -> tuple[DataFrame, DataFrame]:
    """Favourites and notes after an activity log (event_id, ts, user_id, action, entity_type, entity_id, note_id, score, notes).

    'add' counts once per user and entity, until a 'remove'; each note has the latest value of every field; scores out of range
    and entities that are gone are left out.
    """
    live = log.join(vertices.select("entity_type", F.col("id").alias("entity_id")).distinct(), ["entity_type", "entity_id"], "left_semi")
    at = F.struct("ts", "event_id")
    marks = live.where(F.col("action").isin("add", "remove"))
    # the first add after the last remove
    removed = marks.where("action = 'remove'").groupBy("user_id", "entity_type", "entity_id").agg(F.max(at).alias("_gone"))
    kept = marks.where("action = 'add'").join(removed, ["user_id", "entity_type", "entity_id"], "left").where(F.col("_gone").isNull() | (at > F.col("_gone")))
    favourites = kept.groupBy("user_id", "entity_type", "entity_id").agg(F.min(at).alias("_a")).select("user_id", "entity_type", "entity_id", F.col("_a.ts").alias("created_at"), F.col("_a.event_id").alias("event_id"))
    valid = live.where(F.col("action") == "note").where(F.col("score").isNull() | F.col("score").between(*score_range))
    notes = valid.groupBy("note_id").agg(
        F.min_by("user_id", at).alias("user_id"), F.min_by("entity_id", at).alias("entity_id"),
        F.max_by("score", F.when(F.col("score").isNotNull(), at)).alias("score"), F.max_by("notes", F.when(F.col("notes").isNotNull(), at)).alias("notes"),
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
    )
    return favourites, notes


def export_pruned(tables: Mapping[str, DataFrame], root: str, keep: Column, children: Mapping[str, str], key: str = "id") -> dict[str, DataFrame]:
    """All tables with only the wanted rows of ``root`` and the child rows that refer to them or to nothing; ``sinks.export_tables`` writes them.

    children: table -> its foreign key to root. It is an error if nothing of root is left.
    """
    kept = tables[root].where(keep)
    if kept.isEmpty():
        raise ValueError(f"no row of {root} would be left")
    out = dict(tables) | {root: kept}
    for name, foreign in children.items():
        df = tables[name]
        hit = df.join(kept.select(F.col(key).alias(foreign)), foreign, "left_semi").select(*df.columns)
        out[name] = hit.unionByName(df.where(F.col(foreign).isNull()))
    return out
