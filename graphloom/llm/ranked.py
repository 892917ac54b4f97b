"""Ranked lexical search by bit-sliced Bloom signatures.

Every document is written once as its terms with their frequencies. From these come signatures: a bit set of each pair (term,
level) whose level the term's frequency reaches. Documents of like size form blocks, whose signatures are stored by slices: one
bit of all documents side by side. For a term the slices of its hashes, taken together, are a row of documents that may have it
at that level; false ones only overestimate. Weighted sums of these rows, for all queries of a block at once, are upper bounds of
the scores. The ten highest bounds of a query are scored exactly and give a threshold; a second pass over the slices takes all
documents whose bound is not below it, and these are scored exactly from their stored frequencies.

Of documents with equal text only the best ``top`` of a block of signatures go on: they score alike, so others cannot be among
the first ``top``. Queries are written in blocks of bounded size which tasks read in turn; nothing of them passes through the driver.

Nulls, ties and odd rows: a null text has no terms; documents without terms count nowhere and are never found, and queries
without terms find nothing. Equal scores go by ascending doc_id, null ids last; rows that repeat an id are ranked as rows of
their own. A repeated item_id makes two queries, each with its own ranks. Texts of any length are used whole, and a term's
repeats in a query count. An empty table of either kind gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, mix64, scratch_dir, ship_by_value, stored

#: ASCII letters in lower case, digits and all bytes of other characters as they are; the rest separates terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Frequencies that have a bit of their own.
LEVELS = np.array([1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 256, 512, 1024, 4096, 16384], dtype=np.int64)
#: Bits of a signature for each of its pairs, and how many of them a pair sets.
BITS, HASHES = 12, 3
#: Documents of a block at most, and bytes of its slices.
BLOCK_DOCS, BLOCK_BYTES = 1024, 16 << 20
#: Queries and terms of queries of a block on average.
BLOCK_QUERIES, BLOCK_TERMS = 2048, 1 << 17
#: Rows of terms, or of pairs of query and term, that are taken at a time.
CHUNK = 1024
#: Candidates' rows are broadcast up to this number, at 30 bytes or so each; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
TEXT_BYTES = 1 << 20
#: Documents that are sorted by size, to form blocks, at a time.
SORTED_DOCS = 8192


def term_counts(text: bytes) -> Counter:
    found: Counter = Counter()
    text = text.translate(TERM_BYTES)
    at = 0
    while at < len(text):
        cut = text.find(b" ", at + TEXT_BYTES) if len(text) - at > TEXT_BYTES else -1
        cut = len(text) if cut < 0 else cut
        found.update(text[at:cut].split())
        at = cut
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, alike, n, terms, tfs): the terms in one string, a line each, and their frequencies as 32-bit integers. Two values for each document are less to move than a list of texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            counts = [term_counts(text) if text else Counter() for text in byte_texts(part.column(2))]
            terms = pa.array([b"\n".join(c) for c in counts], pa.binary()).cast(pa.string())
            tfs = pa.array([np.fromiter(c.values(), dtype="<i4", count=len(c)).tobytes() for c in counts], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([sum(c.values()) for c in counts], pa.int64()), terms, tfs], names=["id", "alike", "n", "terms", "tfs"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (q, term, repeats) of queries (q, text)."""
    for batch in batches:
        for q, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
            counts = term_counts(text or b"")
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["q", "term", "repeats"])


def counted_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, alike, n, terms, tfs) of the documents that have terms; ``row`` numbers them, ``alike`` is a hash of the text."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("alike"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_counted, "id long, alike long, n long, terms string, tfs binary").where("n > 0")
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "terms")


def term_hash(term: bytes) -> int:
    """What Spark's xxhash64 gives a string, without its sign."""
    return xxhash.xxh64_intdigest(term, 42)


def places(hashes: np.ndarray, level: np.ndarray | int, width: int) -> list[np.ndarray]:
    """The bits that pairs of a term's hash and a level set in a signature of that width."""
    x = mix64(hashes + (np.atleast_1d(level).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    steps = np.arange(HASHES, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return [(mix64(x + step) % np.uint64(width)).astype(np.int64) for step in steps]


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, end to end."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def slices(hashes: np.ndarray, tfs: np.ndarray, sizes: np.ndarray) -> tuple[int, np.ndarray]:
    """Width and slices (width, documents / 8) of documents whose terms' hashes and frequencies lie end to end."""
    reached = np.searchsorted(LEVELS, tfs, side="right")
    docs = np.repeat(np.arange(len(sizes)), sizes)
    width = max(64, BITS * int(np.bincount(docs, reached, minlength=len(sizes)).max()))
    bits = np.zeros((width, -(-len(sizes) // 8)), dtype=np.uint8)
    docs = np.repeat(docs, reached)
    for place in places(np.repeat(hashes, reached), _ranges(reached), width):
        np.bitwise_or.at(bits, (place, docs >> 3), (128 >> (docs & 7)).astype(np.uint8))
    return width, bits


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of signatures, from rows (row, id, alike, n, terms, tfs)."""
    names = ["rows", "ids", "alike", "n", "width", "bits"]
    for batch in batches:
        for begin in range(0, batch.num_rows, SORTED_DOCS):
            part = batch.slice(begin, SORTED_DOCS)
            # documents of like size go together
            tfs = [np.frombuffer(t, dtype="<i4") for t in part.column(5).to_pylist()]
            pairs = np.array([int(np.searchsorted(LEVELS, t, side="right").sum()) for t in tfs])
            terms, order, at = byte_texts(part.column(4)), np.argsort(pairs, kind="stable"), 0
            while at < len(order):
                z = min(at + BLOCK_DOCS, len(order))
                while z - at > 8 and BITS * int(pairs[order[z - 1]]) * (z - at) > 8 * BLOCK_BYTES:
                    z = at + (z - at) // 2
                own = order[at:z]
                hashes = np.array([term_hash(t) for d in own.tolist() for t in terms[d].split(b"\n")], dtype=np.uint64)
                width, bits = slices(hashes, np.concatenate([tfs[d] for d in own.tolist()]).astype(np.int64), np.array([len(tfs[d]) for d in own.tolist()]))
                lists = [pa.array([part.column(k).take(pa.array(own)).to_pylist()], pa.list_(pa.int64())) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([width], pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=names)
                at = z


class Queries:
    """A block of queries: its distinct terms, and the pairs of a query and a term in chunks of terms."""

    def __init__(self, table: pa.Table) -> None:
        self.q = table.column("q").to_numpy()
        self.theta = table.column("theta").to_numpy() if "theta" in table.column_names else None
        self.theta_id = table.column("theta_id").to_numpy() if "theta" in table.column_names else None
        terms = table.column("terms").combine_chunks()
        of = np.repeat(np.arange(len(self.q)), terms.value_lengths().to_numpy())
        fields = terms.flatten()
        self.hashes, term = np.unique(fields.field("h").to_numpy().view(np.uint64), return_inverse=True)
        order = np.lexsort((of, term // CHUNK))
        self.of, self.term, self.weight = of[order], term[order], fields.field("weight").to_numpy()[order]
        self.cuts = np.searchsorted(self.term // CHUNK, np.arange(-(-len(self.hashes) // CHUNK) + 1))

    def bounds(self, width: int, bits: np.ndarray, n: np.ndarray, total: int, length: int) -> np.ndarray:
        """Upper bounds (queries, documents) of the scores of a block of documents."""
        m = 25 + (75 * n * total) // length
        tops = np.minimum(np.r_[0, LEVELS[1:] - 1, LEVELS[-1] << 40][:, None], n)
        tops = (1_000_000_000 * tops) // (1000 * tops + 8 * m)  # by levels reached, the most that a term can give
        tops[0] = 0
        out, column = np.zeros((len(self.q), len(n)), dtype=np.int64), np.arange(len(n))
        for k, (a, z) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            hashes = self.hashes[k * CHUNK : (k + 1) * CHUNK]
            reached = np.zeros((len(hashes), len(n)), dtype=np.uint8)
            alive, held = np.arange(len(hashes)), None
            for level in range(len(LEVELS)):
                at = places(hashes[alive], level, width)
                hit = bits[at[0]] & bits[at[1]] & bits[at[2]]
                if held is not None:
                    hit &= held
                some = hit.any(axis=1)
                alive, held = alive[some], hit[some]
                if not len(alive):
                    break
                reached[alive] += np.unpackbits(held, axis=1, count=len(n))
            most = tops[reached, column]
            for b in range(a, z, CHUNK):
                own = slice(b, min(b + CHUNK, z))
                of = self.of[own]
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                out[of[starts]] += np.add.reduceat(most[self.term[own] - k * CHUNK] * self.weight[own][:, None], starts, axis=0)
        return out


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]]:
    """rows, ids (null: the largest number), alike, n, width and slices of each block of signatures."""
    for i in range(batch.num_rows):
        rows, alike, n = (batch.column(k)[i].values.to_numpy() for k in (0, 2, 3))
        ids = batch.column(1)[i].values.fill_null(LAST).to_numpy()
        yield rows, ids, alike, n, batch.column(4)[i].as_py(), np.frombuffer(batch.column(5)[i].as_buffer(), dtype=np.uint8).reshape(batch.column(4)[i].as_py(), -1)


#: Stands for a null id, as the last of all.
LAST = (1 << 63) - 1


def _loader(uri: str):
    held: dict = {}

    def load(block: int) -> Queries:
        if block not in held:
            held.clear()
            store, path = fs.FileSystem.from_uri(uri)
            held[block] = Queries(pq.read_table(f"{path}/block={block}", filesystem=store, partitioning=None))
        return held[block]

    return load


def _highest(uri: str, blocks: list[int], total: int, length: int, top: int):
    """(block, q, row, bound): of each query, the rows of the highest bounds in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = _loader(uri)
        for batch in batches:
            for block in blocks:
                queries = load(block)
                best, at = np.zeros((len(queries.q), 0), dtype=np.int64), np.zeros((len(queries.q), 0), dtype=np.int64)
                for rows, _, _, n, width, bits in _blocks(batch):
                    found = queries.bounds(width, bits, n, total, length)
                    best, at = np.hstack([best, found]), np.hstack([at, np.broadcast_to(rows, found.shape)])
                    if best.shape[1] > top:
                        keep = np.argpartition(best, -top, axis=1)[:, -top:]
                        best, at = np.take_along_axis(best, keep, axis=1), np.take_along_axis(at, keep, axis=1)
                i, j = np.nonzero(best)
                yield _found(block, queries.q[i], at[i, j], best[i, j])

    return run


def _possible(uri: str, blocks: list[int], total: int, length: int, top: int):
    """(block, q, row, bound): all rows that their bound doesn't exclude; of equal texts in a block of signatures the first ``top``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = _loader(uri)
        for batch in batches:
            for block in blocks:
                queries = load(block)
                for rows, ids, alike, n, width, bits in _blocks(batch):
                    found = queries.bounds(width, bits, n, total, length)
                    theta = queries.theta[:, None]
                    i, j = np.nonzero((found > theta) | (found == theta) & (found > 0) & (ids[None, :] <= queries.theta_id[:, None]))
                    order = np.lexsort((rows[j], ids[j], alike[j], i))
                    i, j = i[order], j[order]
                    new = np.r_[True, (i[1:] != i[:-1]) | (alike[j[1:]] != alike[j[:-1]])][: len(i)]
                    place = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
                    i, j = i[place < top], j[place < top]
                    yield _found(block, queries.q[i], rows[j], found[i, j])

    return run


def _found(block: int, q: np.ndarray, row: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), block, dtype=np.int32)), pa.array(q), pa.array(row), pa.array(bound)], names=["block", "q", "row", "bound"])


def _scored(uri: str, total: int, length: int):
    """(q, id, row, score) from rows (block, qs, row, id, n, terms, tfs)."""

    def read(block: int) -> dict[int, list[tuple[str, int]]]:
        store, path = fs.FileSystem.from_uri(uri)
        table = pq.read_table(f"{path}/block={block}", columns=["q", "terms"], filesystem=store, partitioning=None).to_pylist()
        return {r["q"]: [(t["term"], t["weight"]) for t in r["terms"]] for r in table}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, dict] = (-1, {})
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                block, qs, row, doc_id, n, terms, tfs = (batch.column(k)[i].as_py() for k in range(7))
                held = held if held[0] == block else (block, read(block))
                have, m = dict(zip(terms.split("\n"), np.frombuffer(tfs, dtype="<i4").tolist(), strict=True)), 25 + (75 * n * total) // length
                for q in qs:
                    score = sum(w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m)) for t, w in held[1][q] if (tf := have.get(t)))
                    if score:
                        out.append((q, doc_id, row, score))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["q", "id", "row", "score"])

    return run


def _exact(found: DataFrame, docs: DataFrame, uri: str, total: int, length: int) -> DataFrame:
    """Exact scores of pairs of a query and a row."""
    asked = found.groupBy("block", "row").agg(F.collect_list("q").alias("qs"))
    asked = stored(asked, "asked")
    asked = F.broadcast(asked) if found.count() <= BROADCAST_ROWS else asked
    rows = docs.join(asked, "row").select("block", "qs", "row", "id", "n", "terms", "tfs").sortWithinPartitions("block")
    return rows.mapInArrow(_scored(uri, total, length), "q long, id long, row long, score long")


def _best(scores: DataFrame, top: int, *order: Column) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``top`` documents of highest score above 0 for each item, by integer BM25.

    A term's weight w is floor(1000 * ln((2 N + 2) / (2 df + 1))), a document's m is 25 + 75 n N div L, and its score the sum of
    w * (10**9 tf div (1000 tf + 8 m)) over the item's terms with repeats; N counts documents with terms, L all terms of these.
    """
    spark = docs.sparkSession
    kind = items.select(F.col(item_col)).schema[0].dataType.simpleString()
    counted = counted_rows(docs, id_col, text_col)
    asked = stored(items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).withColumn("q", F.monotonically_increasing_id()), "asked")
    pairs = stored(asked.select("q", "text").mapInArrow(_asked, "q long, term string, repeats long"), "asked-terms")
    total, length = counted.agg(F.count("*"), F.sum("n")).first()
    n_items, n_terms = pairs.agg(F.countDistinct("q"), F.count("*")).first()
    if not total or not n_items:
        return spark.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} long, score long")

    # each partition counts its own terms first, so frequent ones shuffle once for each
    frequency = counted.select(F.explode(F.split("terms", "\n")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * total + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = pairs.join(frequency, "term").withColumn("weight", weight * F.col("repeats")).where("weight > 0")
    terms = F.collect_list(F.struct("term", F.xxhash64("term").alias("h"), "weight")).alias("terms")
    blocks = max(1, -(-n_items // BLOCK_QUERIES), -(-n_terms // BLOCK_TERMS))
    queries = stored(weighted.groupBy("q").agg(terms).withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")), "queries")
    there = [r.block for r in queries.select("block").distinct().orderBy("block").collect()]

    def dealt(rows: DataFrame, label: str) -> str:
        uri = scratch_dir(spark, label)
        rows.repartition(blocks, "block").write.partitionBy("block").parquet(uri)
        return uri

    signed = counted.select("row", "id", "alike", "n", "terms", "tfs").mapInArrow(_signed, "rows array<long>, ids array<long>, alike array<long>, n array<long>, width long, bits binary")
    signed = stored(signed, "slices")
    plain, of = dealt(queries, "queries-blocks"), "block int, q long, row long, bound long"
    highest = signed.mapInArrow(_highest(plain, there, total, length, top), of)
    order = (F.desc("score"), F.col("id").isNull(), F.col("id"), F.col("row"))
    tried = _exact(stored(_best(highest, top, F.desc("bound"), F.col("row")), "tried"), counted, plain, total, length)
    last = _best(tried, top, *order).where(F.col("rank") == top).select("q", F.col("score").alias("theta"), F.coalesce("id", F.lit(LAST)).alias("theta_id"))
    known = queries.join(last, "q", "left").fillna({"theta": 0, "theta_id": LAST})
    possible = signed.mapInArrow(_possible(dealt(known, "queries-thresholds"), there, total, length, top), of)
    best = _best(_exact(stored(possible, "possible"), counted, plain, total, length), top, *order)
    return best.join(asked.select("q", F.col("item").alias(item_col)), "q").select(item_col, "rank", F.col("id").alias(id_col), "score")


ship_by_value(__name__)
