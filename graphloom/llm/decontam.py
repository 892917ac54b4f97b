"""Benchmark decontamination with suffix arrays over the training texts.

Each chunk of documents is a training shard. Words that no benchmark item has cannot be in a
match, so a shard keeps only its runs of benchmark words that are long enough, and sorts their
suffixes by prefix doubling. Every test suffix is binary-searched by its first ``window`` words;
the range found gives all occurrences, and occurrences that follow each other in both texts make
up the longest verbatim match. No row is shuffled. The benchmark is the stated query set: it is
taken in blocks of bounded size, which tasks build and write to the shared scratch space once and every task reads in turn,
so the documents are read once and a task holds one block. An item stays whole, so one above that size is a block of its own size.

Nulls, ties and odd rows: a null text or item has no words; an item without words matches nothing,
and one without an id is left out. Rows of documents are judged one by one, so repeated ids and null
ids give a row each. Items that share an id count once. Of an item's matches of equal length the first is named, in order of the texts of one id. A text of
any length is one part of a shard; however often a document and an item repeat one window, what is held grows with
the item alone. An empty table gives no rows, an empty benchmark no hits. Further columns pass through ``clean``.
"""

from __future__ import annotations

import pickle
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, chunks_by_size, scratch_dir, ship_by_value

#: Bytes of benchmark text that a task searches for at a time.
BLOCK_BYTES = 8 << 20
#: Bytes of documents that make up one shard.
SHARD_BYTES = 8 << 20
#: Letters and digits stay, A-Z in lower case; other ASCII separates words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_SPANS = "array<struct<start:long,stop:long>>"
_MATCHES = "array<struct<item_id:string,length:long,doc_word:long,item_word:long>>"


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``ids`` in the order of their first ``depth`` items at least, by prefix doubling."""
    rank, size = ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while size < depth:
        ahead = np.zeros_like(rank)
        ahead[:-size] = rank[size:] + 1
        pair = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(pair, kind="stable")
        in_order = pair[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.r_[0, in_order[1:] != in_order[:-1]])
        size *= 2
    return order


def _keys(rows: np.ndarray, depth: int) -> np.ndarray:
    """Rows of ids as byte strings of one length that compare as the rows do."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * depth}").reshape(-1)


class TestSuffixes:
    """One block of the benchmark: its vocabulary and distinct windows, with the items and places that have them."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.window, self.vocabulary, self.items = window, {}, sorted({i for i, _ in items})
        number = {i: n for n, i in enumerate(self.items)}
        where = defaultdict(list)
        owner, first = [], []  # of each place, the item and where its text starts; a place of no text parts the texts
        for item_id, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split_words(text))
            width, start = min(window, len(ids)), len(owner) + 1
            for p in range(len(ids) - width + 1 if ids else 0):
                where[ids[p : p + width]].append(start + p)
            owner += [number[item_id]] * (len(ids) + 1)
            first += [start] * (len(ids) + 1)
        windows = sorted(where)
        self.width = np.array([len(w) for w in windows], dtype=np.int64)
        self.shortest = int(self.width.min()) if windows else 0
        low, high = np.zeros((len(windows), window), dtype=np.int64), np.full((len(windows), window), 0xFFFFFFFF)
        for k, w in enumerate(windows):
            low[k, : len(w)] = high[k, : len(w)] = w
        self.low, self.high = _keys(low, window), _keys(high, window)
        self.first = np.r_[0, np.cumsum([len(where[w]) for w in windows])].astype(np.int64)
        self.places = np.array([x for w in windows for x in where[w]], dtype=np.int64)
        self.owner, self.start = np.array([*owner, 0], dtype=np.int64), np.array([*first, 0], dtype=np.int64)

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows found in a shard's word ids (0: no benchmark word) and where they start."""
        known = ids > 0
        edges = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
        long = edges[1::2] - edges[::2] >= self.shortest
        starts, stops = edges[::2][long], edges[1::2][long]
        if not len(starts):
            return (np.zeros(0, dtype=np.int64),) * 2
        sizes = stops - starts + 1  # with the 0 that ends each run
        place = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        runs = np.append(ids, 0)[place]
        order = suffix_array(runs, self.window)
        padded = np.r_[runs, np.zeros(self.window, dtype=runs.dtype)]
        keys = _keys(padded[order[:, None] + np.arange(self.window)], self.window)
        low, high = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        found = np.flatnonzero(high > low)
        many = (high - low)[found]
        window = np.repeat(found, many)
        at = np.arange(int(many.sum())) + np.repeat(low[found] - (np.cumsum(many) - many), many)
        return window, place[order[at]]


class LongestMatches:
    """The longest verbatim match of every document with every item of a block.

    Windows found one word further on in both texts lengthen a run; only the runs that end at the word before are held, a
    number for each place of the block.
    """

    def __init__(self, tests: TestSuffixes) -> None:
        self.tests = tests
        self.seen = np.full(len(tests.owner), -2, dtype=np.int64)  # where in the shard a place was last matched
        self.run = np.zeros(len(tests.owner), dtype=np.int64)
        self.best = np.zeros(len(tests.items), dtype=np.int64)

    def find(self, at: np.ndarray, window: np.ndarray, doc: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, dict]]:
        """(document, match) for windows that start at rising words of the shard."""
        t, best, words = self.tests, self.best, {}
        last = None
        for pos, w, d in zip(at.tolist(), window.tolist(), doc.tolist(), strict=True):
            if d != last:
                yield from self.done(last, words, first)
                last, words = d, {}
            place = t.places[t.first[w] : t.first[w + 1]]
            run = np.where(self.seen[place - 1] == pos - 1, self.run[place - 1], 0) + 1
            self.seen[place], self.run[place] = pos, run
            item, length = t.owner[place], run + t.width[w] - 1
            longer = np.flatnonzero(length > best[item])
            if len(longer):
                order = longer[np.lexsort((-place[longer], length[longer]))]  # of one item the last one stays
                best[item[order]] = length[order]
                for k in order.tolist():
                    words[int(item[k])] = (pos - int(run[k]) + 1, int(place[k] - run[k] + 1 - t.start[place[k]]))
        yield from self.done(last, words, first)

    def done(self, doc: int | None, words: dict[int, tuple[int, int]], first: np.ndarray) -> Iterator[tuple[int, dict]]:
        for item in sorted(words):
            pos, place = words[item]
            yield doc, {"item_id": self.tests.items[item], "length": int(self.best[item]), "doc_word": pos - int(first[doc]), "item_word": place}
            self.best[item] = 0


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [{"start": a, "stop": z} for a, z in out]


def _search(tests: TestSuffixes, docs: list[list[bytes]], spans: list[list], matches: list[list]) -> None:
    """Add what one block finds in one shard."""
    get = tests.vocabulary.get
    sizes = np.array([len(d) + 1 for d in docs], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    ids = np.zeros(int(sizes.sum()), dtype=np.int64)
    for f, d in zip(first.tolist(), docs, strict=True):
        ids[f : f + len(d)] = np.fromiter(map(get, d, repeat(0)), dtype=np.int64, count=len(d))
    window, at = tests.occurrences(ids)
    if not len(at):
        return
    change = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + tests.width[window], -1)
    edges = np.flatnonzero(np.diff(np.r_[False, np.cumsum(change)[:-1] > 0, False].astype(np.int8)))
    for a, z, d in zip(edges[::2].tolist(), edges[1::2].tolist(), (np.searchsorted(first, edges[::2], "right") - 1).tolist(), strict=True):
        spans[d].append((a - int(first[d]), z - int(first[d])))
    order = np.argsort(at, kind="stable")
    at, window = at[order], window[order]
    for d, match in LongestMatches(tests).find(at, window, np.searchsorted(first, at, "right") - 1, first):
        matches[d].append(match)


def _scan(uri: str, blocks: int):
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    match = pa.list_(pa.struct([("item_id", pa.string()), ("length", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(uri)
        there = [b for b in range(blocks) if store.get_file_info(f"{path}/{b}").type == fs.FileType.File]  # a block may have got no item
        held, tests = -1, None
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for a, z in chunks_by_size([n + 100 for n in lengths], SHARD_BYTES):
                part = batch.slice(a, z - a)
                docs = [split_words(t) for t in byte_texts(part.column("text"))]
                spans: list[list] = [[] for _ in docs]
                matches: list[list] = [[] for _ in docs]
                for b in there:
                    if b != held:
                        with store.open_input_stream(f"{path}/{b}") as f:
                            held, tests = b, pickle.loads(f.read())
                    _search(tests, docs, spans, matches)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([len(d) for d in docs], pa.int64()), pa.array([_merged(s) for s in spans], span), pa.array(matches, match)], names=["row", "n_words", "spans", "matches"])

    return run


def _index(uri: str, window: int):
    """Write the suffixes of a block of items, under a temporary name first, as a task may run twice."""

    def run(table: pa.Table) -> pa.Table:
        store, path = fs.FileSystem.from_uri(uri)
        block, temporary = table.column("block")[0].as_py(), f"{path}/{uuid.uuid4().hex}"
        rows = sorted(zip(table.column("item_id").to_pylist(), (t or b"" for t in byte_texts(table.column("text"))), strict=True))
        with store.open_output_stream(temporary) as f:
            f.write(cloudpickle.dumps(TestSuffixes(rows, window)))
        store.move(temporary, f"{path}/{block}")
        return pa.table({"block": pa.array([block], pa.int32())})

    return run


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """Per document: row (all its columns), n_words, spans (word ranges hit, end exclusive) and matches (each item's longest verbatim match and where it is)."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    uri = scratch_dir(docs.sparkSession, "test-suffixes")
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    made = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(_index(uri, window), "block int")
    made.write.format("noop").mode("overwrite").save()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    schema = docs.select(row, F.lit(0).cast("long").alias("n_words"), F.array().cast(_SPANS).alias("spans"), F.array().cast(_MATCHES).alias("matches")).schema
    return docs.select(row, F.col(text_col).alias("text")).mapInArrow(_scan(uri, blocks), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans and matches of every document."""
    items = F.array_sort(F.array_distinct(F.col("matches.item_id")))
    return scan(docs, benchmark, **options).select(
        F.col("row").getField(id_col).alias("doc_id"),
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
        "matches",
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no benchmark item touches, with all their columns."""
    return scan(docs, benchmark, **options).where(F.size("spans") == 0).select("row.*")


ship_by_value(__name__)
