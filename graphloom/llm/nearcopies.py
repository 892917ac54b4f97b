"""Groups of near copies: SimHash signatures and, for what these miss, a prefix filter, both decided by exact Jaccard similarity of word-shingle sets.

First come the close copies: SimHash fingerprints of the same shingles within ``MAX_BITS`` of each other, found by their deletion
variants (``simhash.near_links``). Their sets are compared, and those near enough are linked. SimHash misses most pairs close to the
wanted similarity, so a prefix filter finds all others.

In any fixed order of shingles, two sets of similarity ``p / q`` or more share one of their first n - ceil(p n / q) + 1
shingles (prefix filter). So each set is indexed by these, and an equality join finds every pair. The order puts shingles
that are frequent in a sample last, which keeps the groups of a key small; a poor sample costs time, never a pair.

Four filters then shrink the groups, none of which can lose a link: a group breaks where sizes in sorted order leave a gap;
groups with the same members are one; groups whose members are all linked already by SimHash go; and the symmetric difference of two sets is at least the number of bits in which
their parity bitmaps differ. For what is left, the sets themselves are compared.

Groups of more than ``GROUP`` sets are cut into blocks, each pair of blocks being a group of its own.

Nulls, ties and odd rows: documents without words are copies of each other. Rows without an id are in no group. Rows that
repeat an id with other texts are joined through that id's smallest component. A text of any length is taken whole. An empty table
gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, chunks_by_size, ship_by_value, stored
from .simhash import CHUNK_BYTES, GROUP, components, first_of_groups, majority, near_links, shingle_hashes

#: Documents whose shingles tell which are frequent, and how many of these are sent to the tasks. Both only set the order.
SAMPLE_DOCS = 40_000
FREQUENT = 300_000
LEAST_BITS = 512
#: Bits in which fingerprints of candidates differ at most.
MAX_BITS = 3


def shingle_set(text: bytes | None, n_words: int) -> np.ndarray:
    """The distinct shingle hashes in rising order; a document without words has one of its own kind."""
    return _distinct(shingle_hashes(text or b"", n_words))


def _distinct(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes or [0], dtype=np.uint64))


def prefix_length(n: int, p: int, q: int) -> int:
    return n + (-p * n // q) + 1


def bitmap(shingles: np.ndarray) -> bytes:
    """Bit b is the parity of the number of shingles that are b modulo the bitmap's length, a power of two."""
    m = max(LEAST_BITS, 1 << int(2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _all_shingles(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in byte_texts(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, n_words).view(np.int64))], names=["shingle"])

    return run


def _frequent(docs: DataFrame, text_col: str, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, rising, that several documents of a sample have, and in how many they are."""
    parts = max(1, docs.count() // SAMPLE_DOCS)
    sample = docs.where(F.pmod(F.xxhash64(text_col), F.lit(parts)) == 0).select(text_col)
    seen = sample.mapInArrow(_all_shingles(n_words), "shingle long").groupBy("shingle").count().where("count > 1")
    top = seen.orderBy(F.desc("count"), "shingle").limit(FREQUENT).toArrow()
    shingles = top.column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], top.column(1).to_numpy()[order]


def _described(n_words: int, p: int, q: int, frequent: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in byte_texts(batch.column(1))]
            prints, sizes, maps, prefixes, fps = [], [], [], [], np.zeros(len(texts), dtype=np.uint64)
            for a, z in chunks_by_size([len(t) + 100 for t in texts], CHUNK_BYTES):
                lists = [shingle_hashes(t, n_words) for t in texts[a:z]]
                counted = np.array([len(x) for x in lists])
                hashes = np.fromiter((h for x in lists for h in x), dtype=np.uint64, count=int(counted.sum()))
                fps[a:z] = majority(hashes, np.repeat(np.arange(z - a), counted), z - a)
                for s in map(_distinct, lists):
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sizes.append(len(s))
                    maps.append(bitmap(s))
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        s = s[np.argsort(np.where(frequent[at] == s, counts[at], 0), kind="stable")]
                    prefixes.append(s[: prefix_length(len(s), p, q)].view(np.int64))
            columns = [pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=["doc_id", "print", "n", "bits", "prefix", "fp0"])

    return run


def _sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, n_words).tobytes() for t in byte_texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["node", "print", "set"])

    return run


def _runs(p: int, q: int):
    """Of rows (key, n, node) in this order: those that share their key with another node and are not cut off by a gap of sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, name = None, False, 0  # the row before, whether it is in a run of several, and the run's name

        for batch in batches:
            key, n, node = (batch.column(k).to_numpy().astype(np.int64) for k in range(3))
            if not len(key):
                continue
            if last is not None:
                key, n, node = np.r_[last[0], key], np.r_[last[1], n], np.r_[last[2], node]
            same = (key[1:] == key[:-1]) & (q * n[:-1] >= p * n[1:])
            start = np.r_[True, ~same]
            # a run is named by its key and the size it starts at; the first may go on from the batch before
            first = np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
            size = np.where(first == 0, name if last is not None else n[0], n[first])
            keep = np.r_[held, same] | np.r_[same, False]
            keep[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(size[keep]), pa.array(node[keep])], names=["key", "size", "node"])
            held = bool(np.r_[held, same][-1])
            last, name = (key[-1:], n[-1:], node[-1:]), int(size[-1])
        if last is not None and held:
            yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array([name], pa.int64()), pa.array(last[2])], names=["key", "size", "node"])

    return run


def _by_group(work: Callable[[list], list], names: list[str]):
    """``work`` on the rows (grp, ...) of each group, which come sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list = []

        def done(groups: list[list]) -> pa.RecordBatch:
            found = [x for g in groups for x in work(g)]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                groups: list[list] = []
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 4096).columns), strict=True):
                    if rest and rest[0][0] != row[0]:
                        groups.append(rest)
                        rest = []
                    rest.append(row)
                if groups:
                    yield done(groups)
        if rest:
            yield done([rest])

    return run


def _maybe_near(p: int, q: int):
    """(name, node) of the sets that the bitmaps leave a partner, split where none of one part can be near any of another."""

    def work(rows: list) -> list:
        if len(rows) < 2:
            return []
        n = np.array([r[2] for r in rows], dtype=np.int64)
        part = np.arange(len(rows))
        widths = np.array([len(r[3]) for r in rows])
        for width in np.unique(widths):
            # sizes differ by a quarter at most, so bitmaps by a factor of two
            own, wide = np.flatnonzero(widths == width), np.flatnonzero(widths == 2 * width)
            at = np.r_[own, wide]
            bits = np.frombuffer(b"".join(rows[i][3] for i in own), dtype=np.uint64).reshape(len(own), -1)
            if len(wide):
                folded = np.frombuffer(b"".join(rows[i][3] for i in wide), dtype=np.uint64).reshape(len(wide), 2, -1)
                bits = np.r_[bits, folded[:, 0] ^ folded[:, 1]]
            for k in range(len(own)):
                others = np.arange(k + 1, len(at))
                others = others[part[at[others]] != part[at[k]]]
                if not len(others):
                    continue
                total, a, b = n[at[k]] + n[at[others]], np.minimum(n[at[k]], n[at[others]]), np.maximum(n[at[k]], n[at[others]])
                near = (np.bitwise_count(bits[others] ^ bits[k]).sum(axis=1, dtype=np.int64) * (q + p) <= total * (q - p)) & (q * a >= p * b)
                if near.any():
                    met = np.unique(np.r_[part[at[k]], part[at[others[near]]]])
                    part[np.isin(part, met)] = met[0]
        size = np.bincount(part, minlength=len(rows))
        grp = rows[0][0].to_bytes(8, "little", signed=True)
        return [(xxhash.xxh64_intdigest(grp, int(x)) - (1 << 63), r[1]) for x, r in zip(part, rows, strict=True) if size[x] > 1]

    return work


def _links(p: int, q: int):
    """Links (a < b) that connect all near sets of a group."""

    def work(rows: list) -> list:
        parent = {r[1]: r[1] for r in rows}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sets = [np.frombuffer(r[2], dtype=np.uint64) for r in rows]
        out = []
        for i in range(len(rows)):
            for k in range(i + 1, len(rows)):
                a, b = rows[i][1], rows[k][1]
                least, most = sorted((len(sets[i]), len(sets[k])))
                if q * least < p * most or root(a) == root(b):
                    continue
                common = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if q * common >= p * (least + most - common):
                    parent[root(b)] = root(a)
                    out.append((min(a, b), max(a, b)))
        return out

    return work


def _once(members: DataFrame, linked: DataFrame) -> DataFrame:
    """Of groups (grp, node) with the same nodes only one, and none whose nodes are of one component of ``linked`` (node, component)."""
    part = F.coalesce("component", "node")
    signs = members.join(linked, "node", "left").groupBy("grp").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"), F.min(part).alias("least"), F.max(part).alias("most"))
    one = stored(signs.where("least < most").groupBy("n", "x", "y").agg(F.min("grp").alias("grp")).select("grp"), "groups-once")
    return members.join(one, "grp", "left_semi")


def _cut(members: DataFrame) -> DataFrame:
    """Groups (grp, node) of more than ``GROUP`` nodes as pairs of blocks."""
    big = members.groupBy("grp").count().where(F.col("count") > GROUP).select("grp", F.ceil(F.col("count") / (GROUP // 2)).cast("int").alias("cuts"))
    cut = members.join(big, "grp", "left").withColumn("mine", F.expr("cast(pmod(xxhash64(node), coalesce(cuts, 1)) as int)"))
    other = F.explode(F.expr("sequence(0, coalesce(cuts, 1) - 1)"))
    cut = cut.select("grp", "node", "mine", "cuts", other.alias("other"))
    return cut.select(F.when(F.col("cuts").isNull(), F.col("grp")).otherwise(F.xxhash64("grp", F.least("mine", "other"), F.greatest("mine", "other"))).alias("grp"), "node")


def _alike(sets: DataFrame) -> DataFrame:
    """Groups (grp, node) of sets by SimHash: of one fingerprint, or around one whose fingerprint is within ``MAX_BITS``."""
    marked = stored(sets.groupBy("fp0").agg(F.min("node").alias("node")), "fingerprints")
    same = sets.join(marked.withColumnRenamed("node", "a"), "fp0").where("a <> node").select("a", F.col("node").alias("b"))
    pairs = stored(near_links(marked, 1, MAX_BITS).union(same).distinct(), "simhash-pairs")
    return pairs.select(F.col("a").alias("grp"), F.col("b").alias("node")).union(pairs.select("a", "a")).distinct()


def _near_pairs(members: DataFrame, texts: DataFrame, nodes: DataFrame, n_words: int, p: int, q: int) -> DataFrame:
    """Links between the sets of groups (grp, node) that are near by exact comparison."""
    wanted = stored(members.select("node").distinct().join(nodes, "node"), "wanted")
    # the sets of what is left are made again from the texts, which costs less than keeping all
    again = texts.join(wanted.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    full = again.mapInArrow(_sets(n_words), "node long, print binary, set binary").join(wanted, ["node", "print"], "left_semi").distinct()
    compared = members.join(stored(full, "sets"), "node").select("grp", "node", "set").repartition("grp").sortWithinPartitions("grp", "node")
    return stored(compared.mapInArrow(_by_group(_links(p, q), ["a", "b"]), "a long, b long").distinct(), "links")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over pairs of ``similarity`` (a fraction) or more, of every row."""
    p, q = similarity
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, print binary, n int, bits binary, prefix array<long>, fp0 long"
    rows = stored(texts.mapInArrow(_described(n_words, p, q, *_frequent(texts, "text", n_words)), schema), "shingle-prefixes")
    known = rows.where("doc_id is not null")
    nodes = stored(known.groupBy("print").agg(F.min("doc_id").alias("node")), "nodes")
    # one row for each distinct set; an id with several texts has several
    sets = known.join(nodes, (known["print"] == nodes["print"]) & (known["doc_id"] == nodes["node"]), "left_semi").withColumnRenamed("doc_id", "node")
    close = _near_pairs(_cut(_alike(sets.select("node", "fp0"))), texts, nodes, n_words, p, q)
    linked = components(close)
    keyed = sets.select(F.explode("prefix").alias("key"), F.col("n").cast("long").alias("n"), "node")
    runs = keyed.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(_runs(p, q), "key long, size long, node long")
    held = stored(runs.select(F.xxhash64("key", "size").alias("grp"), "node").distinct(), "shared-prefixes")
    mapped = _cut(_once(held, linked)).join(sets.select("node", "n", "bits"), "node").select("grp", "node", "n", "bits")
    near = mapped.repartition("grp").sortWithinPartitions("grp", "node").mapInArrow(_by_group(_maybe_near(p, q), ["grp", "node"]), "grp long, node long")
    near = stored(_once(stored(near.distinct(), "maybe-near"), linked), "maybe-near-once")
    links = close.union(_near_pairs(near, texts, nodes, n_words, p, q))
    # an id with several texts has several nodes; they are linked through the id
    placed = known.select("doc_id", "print").join(nodes, "print")
    twins = placed.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b")
    found = components(links.union(twins).distinct())
    settled = nodes.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))
    return rows.select("doc_id", "print").join(settled, "print", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The document of smallest id of every group, and all without an id, with all their columns; of rows that repeat an id, which are one group, that of least hash stays."""
    return first_of_groups(docs, near_copies(docs, id_col, text_col, **options), id_col)


ship_by_value(__name__)
