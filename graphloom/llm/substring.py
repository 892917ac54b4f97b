"""Substring deduplication with suffix automata.

A window is ``window`` consecutive words of one document. A word goes if a window
that covers it also occurs in a document with a smaller id.

The reference of a corpus against itself is the whole corpus, so its automata
cannot be broadcast: neither their number nor their size has a bound. They are
laid out instead so that each one meets just the texts that can match it:

1. Every window names one anchor, the word n-gram of least hash inside it. Equal
   windows name equal anchors, so a window can only recur where its anchor does.
   About one word in thirteen is an anchor; only their hashes are shuffled.
2. An anchor found in two documents or more belongs to the smallest of them, its
   owner. Runs of windows with one owner travel to it as text; the owner's own
   runs are the reference shard (a block of bounded length of one document).
   A shard with many visitors is copied for every few hundred of them.
3. Each shard becomes a suffix automaton; visitors stream through it, and their
   matching statistics give the maximal spans of at least ``window`` words.
4. Windows that share an anchor with their owner but differ from it may still
   recur in another visitor. They alone are compared by 128-bit hash.

Nothing is capped: every candidate is streamed, and what the automata leave open is
settled by step 4.

Nulls, ties and odd rows: a null or blank text has no words. A document without an
id is returned unchanged and is no source for others. Rows that repeat an id are
each judged against smaller ids only, so of texts that tie the one of least id keeps its words, and rows of one id leave
each other alone. A text of any length is judged whole, in blocks of its own runs. A table without rows gives none. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, chunks_by_size, mix64, ship_by_value, stored

CHUNK_BYTES = 1 << 21
#: Words of one document that make up one reference shard.
SHARD_WORDS = 4096
#: Visitors that share one copy of a shard.
VISITORS = 256


class SuffixAutomaton:
    """The automaton of all substrings of some word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            known = nxt[last].get(w)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            fresh_needed = known is None
            cur = -1
            if fresh_needed:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
            else:
                p = last
            if p >= 0:
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    target = q
                else:
                    target = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = target
                    while p >= 0 and nxt[p].get(w) == q:
                        nxt[p][w] = target
                        p = link[p]
                if fresh_needed:
                    link[cur] = target
                else:
                    cur = target
            last = cur

    def matching_statistics(self, words) -> list[int]:
        """For each word, the length of the longest match that ends with it."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for w in words:
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(w)
            if to is None:
                state = size = 0
            else:
                state = to
                size += 1
            out.append(size)
        return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE_BYTE, _BASE_WORD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[start:end], in 64-bit arithmetic with an odd base."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, len(values)), dtype=np.uint64, out=sums[1:])
    inverse = _powers(pow(base, -1, 1 << 64), len(values) + 1)
    return (sums[ends] - sums[starts]) * inverse[starts]


def word_hashes(joined: bytes) -> np.ndarray:
    """Hashes of the words of a byte string in which one space stands between words."""
    b = np.frombuffer(joined, dtype=np.uint8)
    gaps = np.flatnonzero(b == 32)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(b)]
    return mix64(_rolling(mix64(b.astype(np.uint64) + np.uint64(257)), starts, ends, _BASE_BYTE) + (ends - starts).astype(np.uint64))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value in each window of ``width`` values."""
    v, i, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        right = v[step:] < v[: len(v) - step]
        i = np.where(right, i[step:], i[: len(i) - step])
        v = np.where(right, v[step:], v[: len(v) - step])
        span += step
    return i


def window_anchors(joined: bytes, counts: list[int], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of documents joined by a space: document, first word, anchor's word and anchor's hash; words count from their document's start."""
    n, sizes = sum(counts), np.array(counts)
    if n < window:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
    at = np.arange(n - gram + 1)
    grams = mix64(_rolling(word_hashes(joined), at, at + gram, _BASE_WORD))
    where = sliding_argmin(grams, window - gram + 1)
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(where)]
    start = np.arange(len(where)) - first[doc]
    inside = start + window <= sizes[doc]
    where, doc, start = where[inside], doc[inside], start[inside]
    return doc, start, where - first[doc], grams[where]


def _survey(window: int, gram: int):
    """Per document: its words, the digest of its unchanged text, and its distinct anchors with their first places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            split = [(t or b"").split() for t in byte_texts(batch.column(1))]
            texts = [b" ".join(w) for w in split]
            counts = [len(w) for w in split]
            digests = [hashlib.sha256(t).hexdigest() for t in texts]
            del split
            lengths = np.zeros(len(ids), dtype=np.int64)
            hashes, places = [], []
            for a, z in chunks_by_size([len(t) for t in texts], CHUNK_BYTES):
                own = [i for i in range(a, z) if counts[i] >= window]
                if not own:
                    continue
                doc, _, place, h = window_anchors(b" ".join(texts[i] for i in own), [counts[i] for i in own], window, gram)
                fresh = np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]
                doc, place, h = doc[fresh], place[fresh], h[fresh]
                order = np.lexsort((place, h, doc))
                doc, place, h = doc[order], place[order], h[order]
                fresh = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
                doc, place, h = doc[fresh], place[fresh], h[fresh]
                lengths[np.array(own)] = np.bincount(doc, minlength=len(own))
                hashes.append(h.view(np.int64))
                places.append(place.astype(np.int32))
            offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
            flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=kind))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(keys, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(offsets, flat(hashes, np.int64)),
                    pa.ListArray.from_arrays(offsets, flat(places, np.int32)),
                ],
                names=["doc_id", "text_key", "n_words", "kept_sha256", "anchors", "places"],
            )

    return run


def _runs(window: int, gram: int):
    """Cut documents with shared anchors into runs of windows that have one owner and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("owner", "shard", "doc_id", "text_key", "start", "text")}
            shared = batch.column("shared")
            for row, text in enumerate(byte_texts(batch.column("text"))):
                words = text.split()
                doc_id, text_key = batch.column("doc_id")[row].as_py(), batch.column("text_key")[row].as_py()
                entry = shared[row].values
                anchor = entry.field("anchor").to_numpy().view(np.uint64)
                owner, shard = entry.field("owner").to_numpy(), entry.field("shard").to_numpy()
                order = np.argsort(anchor)
                anchor, owner, shard = anchor[order], owner[order], shard[order]
                _, start, _, h = window_anchors(b" ".join(words), [len(words)], window, gram)
                slot = np.minimum(np.searchsorted(anchor, h), len(anchor) - 1)
                keep = anchor[slot] == h
                start, slot = start[keep], slot[keep]
                if not len(start):
                    continue
                o, s = owner[slot], shard[slot]
                cut = np.flatnonzero(np.r_[True, (start[1:] != start[:-1] + 1) | (o[1:] != o[:-1]) | (s[1:] != s[:-1])])
                for a, z in zip(cut, np.r_[cut[1:], len(start)], strict=True):
                    out["owner"].append(int(o[a]))
                    out["shard"].append(int(s[a]))
                    out["doc_id"].append(doc_id)
                    out["text_key"].append(text_key)
                    out["start"].append(int(start[a]))
                    out["text"].append(b" ".join(words[start[a] : start[z - 1] + window]))
            kinds = {"owner": pa.int64(), "shard": pa.int64(), "doc_id": pa.int64(), "text_key": pa.int64(), "start": pa.int64(), "text": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], kinds[k]) for k in kinds], names=list(kinds))

    return run


def _match(window: int):
    """Stream visitors through the automaton of their shard; the rows of a shard come sorted, its reference first."""
    kinds = {"doc_id": pa.int64(), "text_key": pa.int64(), "start": pa.int64(), "stop": pa.int64(), "h1": pa.int64(), "h2": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton, had_reference = None, SuffixAutomaton(), False
        for batch in batches:
            out: dict[str, list] = {k: [] for k in kinds}
            for owner, shard, part, visitor, doc_id, text_key, start, text in zip(*(batch.column(k).to_pylist() for k in ("owner", "shard", "part", "visitor", "doc_id", "text_key", "start", "text")), strict=True):
                if (owner, shard, part) != key:
                    key, automaton = (owner, shard, part), SuffixAutomaton()
                words = text.split()
                if not visitor:
                    automaton.add(words)
                    continue
                sizes = np.array(automaton.matching_statistics(words))[window - 1 :] >= window
                edges = np.flatnonzero(np.diff(np.r_[False, sizes, False].astype(np.int8)))
                for a, z in zip(edges[::2], edges[1::2], strict=True):  # windows a to z - 1 match
                    for k, v in zip(kinds, (doc_id, text_key, start + int(a), start + int(z) - 1 + window, None, None), strict=True):
                        out[k].append(v)
                open_ = np.flatnonzero(~sizes)
                if len(open_):
                    ends = np.cumsum([len(w) + 1 for w in words])
                    begins = np.r_[0, ends[:-1]]
                    for p in open_.tolist():
                        h = xxhash.xxh3_128_intdigest(text[begins[p] : ends[p + window - 1] - 1])
                        for k, v in zip(kinds, (doc_id, text_key, start + p, start + p + window, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], kinds[k]) for k in kinds], names=list(kinds))

    return run


def _covered(spans, n: int) -> np.ndarray:
    change = np.zeros(n + 1, dtype=np.int64)
    for s in spans or ():
        change[s["start"]] += 1
        change[min(s["stop"], n)] -= 1
    return np.cumsum(change)[:n] > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the words under each document's spans."""
    for batch in batches:
        rows = []
        for text, spans in zip(byte_texts(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            words = text.split()
            gone = _covered(spans, len(words))
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).tolist()
            rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": z} for a, z in zip(edges[::2], edges[1::2], strict=True)], kept.decode()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), span, pa.string()), strict=True))],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"],
        )


_SPANS = "array<struct<start:long,stop:long>>"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int | None = None) -> DataFrame:
    """Find the words that repeat passages of documents with smaller ids.

    Returns a row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one
    space), spans (removed word ranges, end exclusive) and kept_text (null where nothing was removed: the text
    then stands as it is).
    """
    gram = gram or max(1, window // 2)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    base = stored(texts.mapInArrow(_survey(window, gram), "doc_id long, text_key long, n_words long, kept_sha256 string, anchors array<long>, places array<int>"), "anchors")

    anchors = base.where("doc_id is not null").select("doc_id", F.explode(F.arrays_zip("anchors", "places")).alias("a")).select("doc_id", F.col("a.anchors").alias("anchor"), F.col("a.places").alias("place"))
    owners = anchors.groupBy("anchor").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.min_by("place", "doc_id").alias("place")).where("last > owner").select("anchor", "owner", F.floor(F.col("place") / SHARD_WORDS).alias("shard"))
    shared = anchors.select("doc_id", "anchor").join(owners, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "owner", "shard")).alias("shared"))
    suspects = stored(texts.where("doc_id is not null and text is not null").join(shared, "doc_id"), "suspects")

    runs = stored(suspects.select("doc_id", "text_key", "text", "shared").mapInArrow(_runs(window, gram), "owner long, shard long, doc_id long, text_key long, start long, text binary"), "runs")
    visitors, references = runs.where("doc_id <> owner"), runs.where("doc_id = owner")
    copies = visitors.groupBy("owner", "shard").agg(F.ceil(F.count("*") / VISITORS).alias("copies"))
    routed = visitors.join(copies, ["owner", "shard"]).select("owner", "shard", F.expr("pmod(xxhash64(doc_id, start), copies)").alias("part"), F.lit(True).alias("visitor"), "doc_id", "text_key", "start", "text")
    routed = routed.unionByName(references.join(copies, ["owner", "shard"]).select("owner", "shard", F.explode(F.expr("sequence(0L, copies - 1)")).alias("part"), F.lit(False).alias("visitor"), "doc_id", "text_key", "start", "text"))
    routed = routed.repartition("owner", "shard", "part").sortWithinPartitions("owner", "shard", "part", "visitor")
    matched = stored(routed.mapInArrow(_match(window), "doc_id long, text_key long, start long, stop long, h1 long, h2 long"), "matches")

    open_ = matched.where("h1 is not null")
    first = open_.groupBy("h1", "h2").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("last > source").drop("last")
    spans = matched.where("h1 is null").select("doc_id", "text_key", "start", "stop").unionByName(open_.join(first, ["h1", "h2"]).where("doc_id > source").select("doc_id", "text_key", "start", "stop"))
    spans = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    changed = suspects.select("doc_id", "text_key", "text").join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    changed = changed.mapInArrow(_cut, f"doc_id long, n_words long, n_removed long, kept_sha256 string, spans {_SPANS}, kept_text string")
    unchanged = base.join(suspects.select("doc_id", "text_key").distinct(), ["doc_id", "text_key"], "left_anti")
    unchanged = unchanged.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.array().cast(_SPANS).alias("spans"), F.lit(None).cast("string").alias("kept_text"))
    return unchanged.unionByName(changed)


ship_by_value(__name__)
