"""Joins (J1-J13, J15-J18) and set operations.

Nothing is broadcast by hand here: dimension sides are left to Spark, which broadcasts what it has measured to be small
and splits skewed partitions of sort-merge joins otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import join_domain, lookup, text
from ..functions.predicates import non_blank
from ..functions.scratch import materialised


def expand(edges: DataFrame, vertices: DataFrame, by: str, to: str, label: str, keep: Sequence[str] = ()) -> DataFrame:
    """(by, id, label, *keep) of the vertices at the ``to`` end of each edge."""
    ends = vertices.select(F.col("id"), F.col(label))
    return edges.select(by, F.col(to).alias("id"), *keep).join(ends, "id").select(by, "id", label, *keep)


def lookup_left(df: DataFrame, key: str, dim: DataFrame, dim_key: str, columns: Mapping[str, str]) -> DataFrame:
    """Add columns of a dimension; rows without a match keep nulls. columns: new name -> dimension column."""
    right = dim.select(F.col(dim_key).alias(key), *(F.col(c).alias(n) for n, c in columns.items()))
    return df.join(right, key, "left")


def role_join(df: DataFrame, roles: Mapping[str, str], dim: DataFrame, dim_key: str, columns: Sequence[str], how: str = "left") -> DataFrame:
    """Join one dimension once for each role; roles: foreign key column -> prefix of the new columns."""
    for key, prefix in roles.items():
        df = df.join(dim.select(F.col(dim_key).alias(key), *(F.col(c).alias(f"{prefix}_{c}") for c in columns)), key, how)
    return df


#: Members of a neighbour that meet in one task; a neighbour of more is split into blocks of that size, which meet pair by pair.
MEMBERS = 1000


def member_pairs(edges: DataFrame) -> DataFrame:
    """(neighbour, seed, peer) of edges (member, neighbour) without repeats: each pair of members of a neighbour once, seed < peer.

    A neighbour of d members gives d * d / 2 pairs. Those of more than ``MEMBERS`` are cut into blocks by a hash of the member, and the
    blocks are joined pair by pair, so that no key has more than a block of rows on either side.
    """
    degree = edges.groupBy("neighbour").agg(F.count("*").alias("_d")).where(F.col("_d") > MEMBERS)
    blocks = F.coalesce(F.ceil(F.col("_d") / MEMBERS), F.lit(1)).cast("int")
    cut = edges.join(degree.select("neighbour", blocks.alias("_blocks")), "neighbour", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    cut = cut.withColumn("_own", F.pmod(F.xxhash64("member", F.lit(17)), F.col("_blocks")).cast("int"))
    # of blocks i <= j a member of i stands to the left, one of j to the right
    left = cut.select("neighbour", F.col("member").alias("_a"), F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_blocks") - 1)).alias("_j"))
    right = cut.select("neighbour", F.col("member").alias("_b"), F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_i"), F.col("_own").alias("_j"))
    met = left.join(right, ["neighbour", "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col("_a") < F.col("_b")))
    return met.select("neighbour", F.least("_a", "_b").alias("seed"), F.greatest("_a", "_b").alias("peer"))


def member_edges(df: DataFrame, self_col: str, nbr_col: str) -> DataFrame:
    """Distinct (member, neighbour) with both ends."""
    return df.select(F.col(self_col).alias("member"), F.col(nbr_col).alias("neighbour")).where("member is not null and neighbour is not null").distinct()


def peers(edges: DataFrame, self_col: str, nbr_col: str) -> DataFrame:
    """(seed, peer, neighbour): pairs that share a neighbour. Each pair is joined once, heavy neighbours in blocks, and then mirrored."""
    return mirrored(member_pairs(member_edges(edges, self_col, nbr_col)), "neighbour")


#: Pairs that a task counts.
COUNTED = 1_000_000


def member_blocks(members: DataFrame) -> DataFrame:
    """(member, ..., _n, _g) of distinct members (member, ...): their number in the order of the members, and the block of at most ``MEMBERS`` they are in."""
    numbers = materialised(members.orderBy("member").withColumn("_n", F.monotonically_increasing_id()), "members")
    return numbers.withColumn("_g", F.expr(f"_n div {MEMBERS}"))


def meetings(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(_i, _j, *keys but the neighbour, _a, _b) of edges (*keys, member, _g), where ``keys`` end in the neighbour: its members of block _i and of block _j > _i; for _i = _j _b is null.

    A list holds no more than a block, so a neighbour of many members is many rows here.
    """
    lists = placed.repartition(*keys).groupBy(*keys, "_g").agg(F.collect_set("member").alias("_m"))
    left, right = lists.select(*keys, F.col("_g").alias("_i"), F.col("_m").alias("_a")), lists.select(*keys, F.col("_g").alias("_j"), F.col("_m").alias("_b"))
    found = left.join(right, list(keys)).where("_i < _j or (_i = _j and size(_a) > 1)")
    return found.select("_i", "_j", *keys[:-1], "_a", F.when(F.col("_i") < F.col("_j"), F.col("_b")).alias("_b"))


def by_blocks(met: DataFrame) -> DataFrame:
    """Meetings by pairs of blocks, in as many tasks as their pairs ask for, with each pair (a, b) of theirs, a < b, in a row of its own."""
    pairs = met.groupBy("_i", "_j").agg(F.sum(F.size("_a").cast("long") * F.size(F.coalesce("_b", "_a"))).alias("_p"))
    total = pairs.agg(F.sum(F.least(F.col("_p"), F.lit(MEMBERS * MEMBERS)))).first()[0] or 0
    dealt = met.repartition(max(_parallel(met), min(5 * TASKS, -(-total // COUNTED))), "_i", "_j")
    rest = [c for c in met.columns if c not in ("_a", "_b")]
    return dealt.select(*rest, F.explode("_a").alias("a"), F.coalesce("_b", "_a").alias("_b")).select(*rest, "a", F.explode("_b").alias("b")).where("_i < _j or a < b")


def shared_counts(edges: DataFrame, self_col: str, nbr_col: str) -> DataFrame:
    """(seed, peer, shared) in both directions: how many neighbours two members share.

    Members are cut into blocks in their order. Each neighbour's members of two blocks go to the task of these blocks, which counts all
    their pairs; so lists of members are shuffled, but no pair is, and members with close ids that share neighbours meet in few tasks.
    """
    known = edges.select(F.col(self_col).alias("member"), F.col(nbr_col).alias("neighbour")).where("member is not null and neighbour is not null")
    placed = known.join(member_blocks(known.select("member").distinct()).drop("_n"), "member")
    met = materialised(meetings(placed, ["neighbour"]), "meetings")
    counts = by_blocks(met).groupBy("_i", "_j", "a", "b").agg(F.count("*").alias("shared"))
    return mirrored(counts.select(F.col("a").alias("seed"), F.col("b").alias("peer"), "shared"), "shared")


def mirrored(pairs: DataFrame, *columns: str) -> DataFrame:
    """Pairs (seed, peer, ...) in both directions."""
    both = F.array(F.struct("seed", "peer"), F.struct(F.col("peer").alias("seed"), F.col("seed").alias("peer")))
    return pairs.select(F.inline(both), *columns)


#: Rows of a key that meet in one step on either side; pairs that a task makes, and tasks at most.
BLOCK, TASK_PAIRS, TASKS = 1000, 8_000_000, 4096


def beside(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every row of one side beside every row of the other with its key: an equality join for few keys of many rows.

    A key with more than ``BLOCK`` rows is cut into blocks by a hash of the row on either side, which meet pair by pair, so no key needs a
    task of its own; and tasks are as many as the pairs ask for, which are far more bytes than what goes in. The other columns' names differ.
    """
    size = lambda df, to: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(to))
    sizes = materialised(size(left, "_l").join(size(right, "_r"), key), "sizes")
    tasks = max(1, min(TASKS, -(-(sizes.agg(F.sum(F.col("_l") * F.col("_r"))).first()[0] or 0) // TASK_PAIRS)))
    cuts = sizes.select(key, F.ceil(F.col("_l") / BLOCK).cast("int").alias("_is"), F.ceil(F.col("_r") / BLOCK).cast("int").alias("_js"))
    hashed = lambda df: [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    own = lambda df, count: F.pmod(F.xxhash64(*hashed(df), F.lit(17)), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    dealt = lambda df, i, j: df.join(cuts, key).select(*df.columns, i.alias("_i"), j.alias("_j")).repartition(max(tasks, _parallel(df)), key, "_i", "_j")
    return dealt(left, own(left, "_is"), every("_js")).join(dealt(right, every("_is"), own(right, "_js")), [key, "_i", "_j"]).drop("_i", "_j")


def _parallel(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sites(df: DataFrame, id_col: str, site: str, domain, to: str) -> DataFrame:
    """Distinct (to, _d, <to>_many): the domains of each id, and whether it has several; blanks have none."""
    named = df.where(non_blank(site)).select(F.col(id_col).alias(to), domain(F.col(site)).alias("_d")).where(non_blank("_d"))
    many = named.groupBy(to).agg((F.min("_d") != F.max("_d")).alias("_m"))
    # a null id finds no row here and counts as one of several domains
    return named.distinct().join(many, to, "left").select(to, "_d", F.coalesce("_m", F.lit(True)).alias(f"{to}_many"))


def domain_join(a: DataFrame, b: DataFrame, a_id: str = "id", b_id: str = "id", site: str = "website", domain=join_domain) -> DataFrame:
    """Distinct (a_id, b_id) whose sites have one domain; blanks match nothing.

    A pair can be found twice only if both its ids have several domains, so only such pairs are compared with each other.
    """
    return site_pairs(sites(a, a_id, site, domain, "a_id"), sites(b, b_id, site, domain, "b_id"))


def site_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    return unrepeated(beside(left, right, "_d"), "a_id", "b_id", F.col("a_id_many") & F.col("b_id_many"))


def unrepeated(pairs: DataFrame, a: str, b: str, many) -> DataFrame:
    """Distinct (a, b) of pairs of which only those with ``many`` may be there twice."""
    return pairs.where(~many).select(a, b).unionByName(pairs.where(many).select(a, b).distinct())


def compose(first: DataFrame, second: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Distinct (a, c) with an edge a-b in one table and b-c in the other."""
    return first.select(a, b).distinct().join(second.select(b, c).distinct(), b).select(a, c).distinct()


def ijoin(a: DataFrame, b: DataFrame, a_col: str, b_col: str) -> DataFrame:
    """Case-insensitive equality join; names that many rows have are joined in blocks."""
    return beside(a.withColumn("_k", F.lower(F.col(a_col))), b.withColumn("_k", F.lower(F.col(b_col))), "_k").drop("_k")


def has_match(df: DataFrame, key: str, edges: DataFrame, edge_key: str, out: str = "has_match") -> DataFrame:
    """Mark rows with at least one edge."""
    keys = edges.select(F.col(edge_key).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(out, F.lit(True))
    return df.join(keys, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def missing_from(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key is nowhere in b; nulls in b hide nothing."""
    return a.join(b.select(key).distinct(), key, "left_anti")


def map_lookup(c: Column | str, values: Mapping[str, str], default: Column | None = None, fold: bool = True) -> Column:
    """Dictionary value; unmatched values become the default, or null."""
    key = F.lower(F.trim(text(c))) if fold else text(c)
    found = lookup(key, {(k.lower() if fold else k): v for k, v in values.items()})
    return found if default is None else F.coalesce(found, default)


def rule_join(rules: DataFrame, entities: DataFrame) -> DataFrame:
    """(rule_id, entity_id): species in the rule's list, and altitude_max at least its min_altitude where it has one."""
    wanted = rules.select(F.col("id").alias("rule_id"), "min_altitude", F.explode("species").alias("_s")).withColumn("_s", F.lower("_s")).dropDuplicates(["rule_id", "_s"])
    have = entities.select(F.col("id").alias("entity_id"), F.lower("species").alias("_s"), "altitude_max")
    high = F.col("min_altitude").isNull() | (F.col("altitude_max") >= F.col("min_altitude"))
    return wanted.join(have, "_s").where(high).select("rule_id", "entity_id")


def words_of(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(c), r"(?U)\W+"), lambda w: w != "")


def mention_join(docs: DataFrame, names: DataFrame, doc_text: str = "text", min_length: int = 4, stop: Sequence[str] = (), aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Distinct (doc_id, entity_id) where the text contains the entity's name between word boundaries.

    Texts become rows of single words, of which only words of some name stay, with their places. A name is looked up by its rarest
    word; where that stands, its other words are looked up at their places beside it. So rows follow the words of the texts, however
    long a name is, and a frequent word costs no join of its own. Aliases add names: each key inside a name is replaced by its other spellings.
    """
    wanted = names.where(F.length("name") >= min_length).where(~F.lower("name").isin(list(stop)) if stop else F.lit(True))
    spelled = [F.lower(F.col("name"))]
    for word, others in (aliases or {}).items():
        spelled += [F.replace(F.lower(F.col("name")), F.lit(word), F.lit(o)) for o in others]
    each = wanted.select(F.col("id").alias("entity_id"), F.explode(F.array_distinct(F.array(*spelled))).alias("_n")).distinct()
    each = each.select("entity_id", "_n", words_of(F.col("_n")).alias("_w")).where(F.size("_w") > 0)
    each = each.select("entity_id", "_n", F.size("_w").alias("_k"), F.posexplode("_w").alias("_at", "_word"))
    each = materialised(each, "names")
    texts = docs.where(F.col(doc_text).isNotNull()).select(F.col("id").alias("doc_id"), F.lower(F.col(doc_text)).alias("_t"))
    places = texts.select("doc_id", F.posexplode(words_of(F.col("_t"))).alias("_pos", "_word")).join(each.select("_word").distinct(), "_word", "left_semi")
    places = materialised(places, "words")

    seen = places.groupBy("_word").agg(F.count("*").alias("_often"))
    rarest = each.join(seen, "_word").groupBy("entity_id", "_n", "_k").agg(F.min(F.struct("_often", "_at", "_word")).alias("_r"), F.count("*").alias("_known")).where("_known = _k")
    rarest = rarest.select("entity_id", "_n", "_k", F.col("_r._at").alias("_at"), F.col("_r._word").alias("_word"))
    begun = places.join(rarest, "_word").select("doc_id", "entity_id", "_n", "_k", (F.col("_pos") - F.col("_at")).alias("_from"))
    single = begun.where("_k = 1").select("doc_id", "entity_id", "_n")
    # the name's words at their places from there
    sought = begun.where("_k > 1 and _from >= 0").join(each.select("entity_id", "_n", "_at", "_word"), ["entity_id", "_n"])
    sought = sought.select("doc_id", "entity_id", "_n", "_k", "_from", (F.col("_from") + F.col("_at")).alias("_pos"), "_word")
    # a repeated id of docs may hold a place twice
    whole = sought.join(places.distinct(), ["doc_id", "_pos", "_word"]).groupBy("doc_id", "entity_id", "_n", "_k", "_from").agg(F.countDistinct("_pos").alias("_met")).where("_met = _k")
    found = single.unionByName(whole.select("doc_id", "entity_id", "_n")).withColumn("_plain", F.col("_n") == F.concat_ws(" ", words_of(F.col("_n"))))
    # names with other signs inside are checked against the text itself
    signs = found.where("not _plain").join(texts, "doc_id").where(F.expr(r"_t rlike concat('(?U)(^|\\W)', regexp_replace(_n, '([^\\w\\s])', '\\\\$1'), '(\\W|$)')"))
    return found.where("_plain").select("doc_id", "entity_id").union(signs.select("doc_id", "entity_id")).distinct()


def update_from(base: DataFrame, patch: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Overwrite columns where the patch has the key, with its nulls too; other rows and columns stay."""
    side = patch.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
    joined = base.join(side, key, "left")
    return joined.select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def attach_names(activity: DataFrame, vertices: DataFrame) -> DataFrame:
    """Add the name of (entity_type, entity_id); null if the entity is gone."""
    side = vertices.select("entity_type", F.col("id").alias("entity_id"), F.col("label").alias("name"))
    return activity.join(side, ["entity_type", "entity_id"], "left")


def resolve_name(names: DataFrame, dim: DataFrame, name: str = "name", parent: str = "parent_id") -> DataFrame:
    """Add the id of each name; of equal names a top-level row wins, then the least id."""
    best = Window.partitionBy("_n").orderBy(F.col(parent).isNotNull(), "id")
    side = dim.select(F.lower(F.col(name)).alias("_n"), "id", parent).withColumn("_r", F.row_number().over(best)).where("_r = 1").select("_n", "id")
    return names.withColumn("_n", F.lower(F.col(name))).join(side, "_n", "left").drop("_n")


def match_triples(triples: DataFrame, type_predicate: str = "rdf:type", meta: str = "owl:Class") -> DataFrame:
    """Subjects whose type is itself declared a class."""
    types = triples.where(F.col("predicate") == type_predicate)
    classes = types.where(F.col("object") == meta).select(F.col("subject").alias("object")).distinct()
    return types.join(classes, "object", "left_semi").select("subject", "object").distinct()


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()


def union_as(frames: Mapping[str, DataFrame], source: str = "source") -> DataFrame:
    """All frames one below the other, with the name of each."""
    parts = [f.withColumn(source, F.lit(n)) for n, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_candidates(embedded: DataFrame, overlapping: DataFrame, keys: Sequence[str], score: str = "similarity", count: str = "shared") -> DataFrame:
    """Candidates of either side; a missing score or count is 0."""
    joined = embedded.join(overlapping, list(keys), "full_outer")
    return joined.withColumn(score, F.coalesce(score, F.lit(0.0))).withColumn(count, F.coalesce(count, F.lit(0).cast("long")))


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of a that b lacks."""
    return a.select(key).where(F.col(key).isNotNull()).distinct().join(b.select(key), key, "left_anti")


def merge_edges(*frames: DataFrame) -> DataFrame:
    """One edge per source, target and type."""
    return reduce(lambda a, b: a.unionByName(b), frames).dropDuplicates(["src_id", "dst_id", "edge_type"])
