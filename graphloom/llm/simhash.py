"""SimHash near-duplicate groups by deletion-variant signatures.

A fingerprint has one or more blocks of 64 bits, a block being the bitwise majority of
its shingles' hashes. Two fingerprints that differ in at most 3 bits of a block agree in
one of its two 32-bit segments up to a single bit. So each segment is indexed 32 times,
once with each bit struck out, and an equality join on these variants finds every pair;
Hamming distance then decides. Documents with one fingerprint are one node from the start,
and of the links of a key only those that join two parts are kept, so copies never
multiply into pairs.

Keys held by more than ``GROUP`` nodes are cut into blocks, and each pair of blocks
is compared in a group of its own: every pair is still seen, by tasks of bounded size.

Nulls, ties and odd rows: a document without words has fingerprint zero and is linked
like any other. Rows without an id get their own component, null. Rows that repeat an id
with other texts are joined through that id's smallest component. A text of any length is taken whole. An empty table gives no
rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_texts, chunks_by_size, mix64, ship_by_value, stored

CHUNK_BYTES = 1 << 21
GROUP = 1024
#: Ids of duplicates (8 bytes each) that are broadcast at most.
BROADCAST_IDS = 2_000_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, n_words: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``n_words`` lower-cased words, or of all words if there are fewer."""
    words = text.translate(LOWER).split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= n_words:
        return [digest(joined, 42)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]].tolist()
    return [digest(joined[a:z], 42) for a, z in zip(starts, (ends[n_words - 1 :] - 1).tolist(), strict=False)]


def majority(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document, the bits set in over half of its hashes."""
    sizes = np.bincount(doc, minlength=n_docs)
    parts = hashes.view(np.uint8).reshape(-1, 8)
    bits = np.empty((n_docs, 8, 8), dtype=np.uint8)
    for j in range(8):
        seen = np.bincount(doc * 256 + parts[:, j], minlength=n_docs * 256).reshape(n_docs, 256)
        bits[:, j] = 2 * (seen @ _BITS) > sizes[:, None]
    return np.packbits(bits.reshape(n_docs, 64), axis=1, bitorder="little").reshape(-1).view(np.uint64)


def _fingerprints(n_words: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in byte_texts(batch.column(1))]
            out = np.zeros((len(texts), blocks), dtype=np.uint64)
            for a, z in chunks_by_size([len(t) + 100 for t in texts], CHUNK_BYTES):
                lists = [shingle_hashes(t, n_words) for t in texts[a:z]]
                sizes = np.array([len(x) for x in lists])
                hashes = np.fromiter((h for x in lists for h in x), dtype=np.uint64, count=int(sizes.sum()))
                doc = np.repeat(np.arange(z - a), sizes)
                for k in range(blocks):
                    out[a:z, k] = majority(hashes, doc, z - a)
                    hashes = mix64(hashes + np.uint64(k + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(out[:, k].view(np.int64)) for k in range(blocks))], names=["doc_id", *(f"fp{k}" for k in range(blocks))])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 3, blocks: int = 1) -> DataFrame:
    """doc_id and fp0, fp1 ... (64 bits each, as signed longs) of every row."""
    schema = ", ".join(["doc_id long", *(f"fp{k} long" for k in range(blocks))])
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_fingerprints(n_words, blocks), schema)


def _held_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key comes up more than once."""
    key, node = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    held = False  # the carried row follows one with its key
    for batch in batches:
        key, node = np.r_[key, batch.column(0).to_numpy()], np.r_[node, batch.column(1).to_numpy()]
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        keep = np.r_[held, same] | np.r_[same, False]
        keep[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep])], names=["key", "node"])
        held = bool(np.r_[held, same][-1])
        key, node = key[-1:], node[-1:]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], names=["key", "node"])


def _links(blocks: int, max_bits: int):
    """Compare the rows of each group, which come sorted; return a link only where it joins two parts that this task has not joined yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def compared(rows: list[np.ndarray]) -> pa.RecordBatch:
            group, node, fp = rows[0], rows[1], [r.view(np.uint64) for r in rows[2:]]
            left, right, d = [], [], 1
            while d < len(group) and len(i := np.flatnonzero(group[d:] == group[:-d])):
                i = i[sum(np.bitwise_count(f[i] ^ f[i + d]).astype(np.int64) for f in fp) <= max_bits]
                for x, y in zip(node[i].tolist(), node[i + d].tolist(), strict=True):
                    x_root, y_root = root(x), root(y)
                    if x_root != y_root:
                        parent[max(x_root, y_root)] = min(x_root, y_root)
                        left.append(min(x, y))
                        right.append(max(x, y))
                d += 1
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

        rest = None
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(2 + blocks)]
            rows = cols if rest is None else [np.r_[a, b] for a, b in zip(rest, cols, strict=True)]
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            rest = [r[last:] for r in rows]
            if last:
                yield compared([r[:last] for r in rows])
        if rest is not None:
            yield compared(rest)

    return run


def _variant_key(blocks: int) -> Column:
    """Of variant v: block v / 64, its segment v / 32 % 2, and the bit v % 32 that is struck out."""
    word = F.element_at(F.array(*(f"fp{k}" for k in range(blocks))), (F.floor(F.col("v") / 64) + 1).cast("int"))
    half = F.when(F.col("v") % 64 < 32, word.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(word, 32))
    struck = half.bitwiseAND(F.expr("~shiftleft(1L, cast(v % 32 as int))"))
    return F.shiftleft(F.col("v").cast("long"), 32).bitwiseOR(struck)


def near_links(nodes: DataFrame, blocks: int, max_bits: int) -> DataFrame:
    """Links (a < b) that connect all nodes (node, fp0 ...) within ``max_bits`` of each other that share a variant."""
    fps = [f"fp{k}" for k in range(blocks)]
    keyed = nodes.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(64 * blocks - 1)))).select(_variant_key(blocks).alias("key"), "node")
    held = stored(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_held_twice, "key long, node long"), "shared-variants")
    big = held.groupBy("key").count().where(F.col("count") > GROUP).select("key", F.ceil(F.col("count") / (GROUP // 2)).cast("int").alias("cuts"))
    cut = held.join(big, "key", "left").withColumn("mine", F.expr("cast(pmod(xxhash64(node), coalesce(cuts, 1)) as int)"))
    other = F.explode(F.expr("sequence(0, coalesce(cuts, 1) - 1)"))
    cut = cut.select("key", "node", "mine", other.alias("other")).select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("grp"), "node")
    rows = cut.join(nodes, "node").select("grp", "node", *fps).repartition("grp").sortWithinPartitions("grp", "node")
    return stored(rows.mapInArrow(_links(blocks, max_bits), "a long, b long").distinct(), "links")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and component (the least node it can reach) of every node that has a link.

    Each round takes the least label among neighbours and then the label's label, so paths
    shorten at least by half; labels are written to the shared scratch space every round.
    """
    both = stored(links.select(F.col("a").alias("node"), F.col("b").alias("peer")).union(links.select("b", "a")).distinct(), "adjacency")
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("peer")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "peer"), "peer").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        fresh = stored(step.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")), "labels")
        labels = fresh.select("node", "label")
        if fresh.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 3, blocks: int = 1, max_bits: int = 3) -> DataFrame:
    """doc_id, fp0 ... and component_id, the smallest doc_id reachable over links, of every row."""
    prints = stored(fingerprints(docs, id_col, text_col, n_words, blocks), "fingerprints")
    fps = [f"fp{k}" for k in range(blocks)]
    known = prints.where("doc_id is not null")
    nodes = stored(known.groupBy(*fps).agg(F.min("doc_id").alias("node")), "nodes")
    # an id with several texts has several nodes; they are linked through the id
    twins = known.join(nodes, fps).groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b")
    found = components(near_links(nodes, blocks, max_bits).union(twins).distinct())
    settled = nodes.join(found, "node", "left").select(*fps, F.coalesce("component", "node").alias("component_id"))
    return prints.join(settled, fps, "left").select("doc_id", *fps, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The document of smallest id of every group, and all without an id, with all their columns; of rows that repeat an id, which are one group, that of least hash stays."""
    return first_of_groups(docs, near_duplicates(docs, id_col, text_col, **options), id_col)


def first_of_groups(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``keep_first`` by given groups (doc_id, component_id)."""
    found = stored(groups.select("doc_id", "component_id"), "groups")
    gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), "duplicates")
    # few enough ids are sent to the texts; more meet them in a shuffle
    small = gone.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if small else gone, id_col, "left_anti").select(*docs.columns)
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = kept.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min_by(row, F.xxhash64(row)).alias("_row")).select("_row.*")
    return one.unionByName(kept.where(F.col(id_col).isNull()))


ship_by_value(__name__)
