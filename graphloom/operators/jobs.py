"""Composed jobs (E3, E7, E9-E14): plain functions from tables to tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import resolve_country
from ..functions.keys import canon_name, category_of, chain_domain, currency_for, dedupe_key, lookup, null_tokens, parse_int, site_host, uuid5
from ..functions.predicates import non_blank
from .aggregates import canonical_owner, first_by, last_by, modal
from .extract import ProductRules, classify
from .joins import difference, update_from

NAMESPACE = uuid.UUID("6f0f8f52-0a53-5d0c-9b55-1b6f3c6b7a10")


def load_samples(raw: DataFrame, varieties: DataFrame, namespace: uuid.UUID = NAMESPACE, synonyms: Mapping[str, str] | None = None, ignored: Sequence[str] = ("other",), methods: Mapping[str, str] | None = None, order: str = "at") -> dict[str, DataFrame]:
    """Countries, regions, farms, methods and their edges to varieties from samples (country, region, farm, altitude, process, variety), all text.

    Rows without a country are skipped; the first row of a key in the column ``order`` gives its attributes; a farm's key includes its region.
    """
    s = raw.select(*(null_tokens(c).alias(c) for c in ("country", "region", "farm", "process", "variety")), parse_int("altitude").alias("altitude"), F.col(order).alias("_at")).where("country is not null")
    spelled = dedupe_key("variety")
    named = F.coalesce(lookup(spelled, {k.lower(): v.lower() for k, v in (synonyms or {}).items()}), spelled)
    s = s.withColumn("_v", F.when(~named.isin([i.lower() for i in ignored]), named))
    s = s.join(varieties.select(F.col("id").alias("variety_id"), dedupe_key("name").alias("_v")), "_v", "left")
    s = s.withColumn("country_id", uuid5(namespace, F.lit("country"), "country")).withColumn("region_id", F.when(F.col("region").isNotNull(), uuid5(namespace, F.lit("region"), "country", "region")))
    s = s.withColumn("farm_id", F.when(F.col("farm").isNotNull(), uuid5(namespace, F.lit("farm"), "country", "region", "farm"))).withColumn("method_id", F.when(F.col("process").isNotNull(), uuid5(namespace, F.lit("method"), "process")))
    first = lambda key, *cols: first_by(s.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), *cols, "_at"), ["id"], ["_at"]).drop("_at")
    pairs = lambda a, b: s.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b).distinct()
    return {
        "countries": first("country_id", F.col("country").alias("name")),
        "regions": first("region_id", F.col("region").alias("name"), "country_id"),
        "farms": first("farm_id", F.col("farm").alias("name"), "region_id", "altitude"),
        "methods": first("method_id", F.col("process").alias("name"), category_of("process", methods or {}).alias("category")),
        "country_variety": pairs("country_id", "variety_id"),
        "region_variety": pairs("region_id", "variety_id"),
        "farm_variety": pairs("farm_id", "variety_id"),
        "variety_processing": pairs("variety_id", "method_id"),
        "unmatched": s.where("_v is not null and variety_id is null").groupBy(F.col("_v").alias("variety")).agg(F.count("*").alias("n")),
    }


def select_candidates(shops: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Flagged or roasting shops with a website on a host that no known roaster has, one per host (the first)."""
    hosts = shops.where(F.coalesce("is_specialty", F.lit(False)) | F.coalesce("roasts_in_house", F.lit(False))).where(non_blank("website")).withColumn("host", site_host("website")).where("host is not null")
    fresh = hosts.join(known.select(site_host("website").alias("host")).where("host is not null").distinct(), "host", "left_anti")
    return first_by(fresh.select(key, "name", "website", "host"), ["host"], [key])


def load_distribution(importers: DataFrame, routes: DataFrame, wanted: DataFrame, countries: DataFrame, namespace: uuid.UUID = NAMESPACE) -> dict[str, DataFrame]:
    """Countries with the missing ones added once, importers and routes with their ids, and names that did not resolve."""
    have = countries.select(F.lower("name").alias("_n"))
    missing = wanted.select("name", F.lower("name").alias("_n")).where("_n <> ''").dropDuplicates(["_n"]).join(have, "_n", "left_anti").select(uuid5(namespace, F.lit("country"), "name").alias("id"), "name")
    everything = countries.unionByName(missing, allowMissingColumns=True)
    ids = everything.select(F.lower("name").alias("_n"), F.col("id").alias("_id"))
    side = lambda df, col, out: df.withColumn("_n", F.lower(F.col(col))).join(ids, "_n", "left").withColumnRenamed("_id", out).drop("_n")
    placed = side(importers, "country", "country_id").withColumn("id", uuid5(namespace, F.lit("importer"), "name"))
    routed = side(side(routes, "exporter", "exporter_id"), "importer", "importer_id").where("exporter_id is not null and importer_id is not null").withColumn("id", uuid5(namespace, F.lit("route"), "exporter", "importer"))
    names = importers.select(F.col("country").alias("name")).union(routes.select("exporter")).union(routes.select("importer")).where("name is not null")
    return {"countries": everything, "importers": placed, "routes": routed, "unresolved": difference(names.select(F.lower("name").alias("name")), everything.select(F.lower("name").alias("name")), "name")}


def describe_by_category(methods: DataFrame, texts: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Methods with their category's description where there is one, and the categories that have none."""
    found = lookup(F.lower("category"), {k.lower(): v for k, v in texts.items()})
    patch = methods.select("id", found.alias("description")).where("description is not null")
    return update_from(methods, patch, "id", ["description"]), methods.where(found.isNull() & F.col("category").isNotNull()).select("category").distinct()


def geocode_countries(countries: DataFrame, centroids: DataFrame, aliases: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Coordinates for countries without, and the names that could not be placed."""
    todo = countries.where("lat is null or lon is null")
    placed = resolve_country(todo.drop("lat", "lon"), "name", centroids.select("country", "lat", "lon", "iso"), dict(aliases))
    return update_from(countries, placed.where("lat is not null").select("id", "lat", "lon"), "id", ["lat", "lon"]), placed.where("lat is null").select("id", "name")


def geocode_regions(regions: DataFrame, table: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Coordinates from a table (key, lat, lon) keyed by iso (or '*'), '|' and 'name, country' in lower case; entries without coordinates count as unresolved."""
    todo = regions.where("lat is null or lon is null")
    todo = todo if limit is None else todo.orderBy("id").limit(limit)
    key = F.concat(F.coalesce(F.lower("iso"), F.lit("*")), F.lit("|"), F.lower(F.concat_ws(", ", "name", "country")))
    placed = todo.drop("lat", "lon").withColumn("key", key).join(table.select("key", "lat", "lon").dropDuplicates(["key"]), "key", "left")
    return update_from(regions, placed.where("lat is not null").select("id", "lat", "lon"), "id", ["lat", "lon"]), placed.where("lat is null").select("id", "name")


def load_products(records: DataFrame, roasters: DataFrame, rules: ProductRules = ProductRules(), overrides: Mapping[str, str] | None = None, aliases: Mapping[str, str] | None = None, namespace: uuid.UUID = NAMESPACE) -> dict[str, DataFrame]:
    """Products, roasters (old and new) and counts from scraped records (with ``at``, their order).

    A roaster's name is the site's override, else its commonest vendor, else its domain, then an alias of that. Its id is that of the
    oldest roaster of the same canonical name; a new one keeps its first name's id and shows its last name.
    """
    coffee = records.where(classify("title", "product_type", "tags", rules))
    rows = coffee.where(non_blank("title")).withColumn("title", F.trim("title")).withColumn("_domain", chain_domain("site"))
    vendors = modal(coffee.withColumn("_site", F.coalesce("site", F.lit(""))), "_site", "roaster", "at", "_vendor")
    rows = rows.withColumn("_site", F.coalesce("site", F.lit(""))).join(vendors, "_site", "left")
    name = F.coalesce(lookup(F.col("_domain"), overrides or {}), "_vendor", "_domain")
    rows = rows.withColumn("_name", name).withColumn("_name", F.coalesce(lookup(dedupe_key("_name"), {k.lower(): v for k, v in (aliases or {}).items()}), "_name")).withColumn("_canon", canon_name("_name"))
    fresh = rows.select(uuid5(namespace, F.lit("roaster"), "_name").alias("id"), "_canon", "at")
    owners = canonical_owner(fresh, roasters.select("id", canon_name("name").alias("_canon"), F.col("created_at").alias("at")), "_canon", "at").withColumnRenamed("id", "roaster_id")
    rows = rows.join(owners, "_canon")
    products = last_by(
        rows.select(uuid5(namespace, F.lit("product"), "site", "title").alias("id"), F.col("title").alias("name"), "roaster_id", "roast_level", "process", "is_blend", "price", currency_for("currency", "site", "price").alias("currency"), "net_weight_grams", "url", "description", "at"),
        ["id"], ["at"],
    ).drop("at")
    new = last_by(rows.select(F.col("roaster_id").alias("id"), F.col("_name").alias("name"), F.col("site").alias("website"), "at"), ["id"], ["at"]).drop("at")
    merged = roasters.unionByName(new.join(roasters.select("id"), "id", "left_anti"), allowMissingColumns=True)
    counts = records.agg(F.count("*").alias("records"), F.count_if(~classify("title", "product_type", "tags", rules)).alias("dropped"))
    return {"products": products, "roasters": merged, "counts": counts}


def load_catalog(items: DataFrame, namespace: uuid.UUID, kind: str, name: str = "name", order: str = "at") -> DataFrame:
    """Catalog rows with deterministic ids, one per name (the last in the column ``order``)."""
    minted = items.where(non_blank(name)).withColumn("_at", F.col(order)).withColumn("id", uuid5(namespace, F.lit(kind), name))
    return last_by(minted, ["id"], ["_at"]).drop("_at").select("id", *items.columns)
