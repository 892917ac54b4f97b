"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds lengths over capacity / (k + 1) up to capacity / k, so any k
pieces of that class fit into a sequence. A document is cut into whole sequences first; what is left goes whole into its
class. Each worker keeps one open bin per class and closes it at its k-th piece; no worker needs to know of another.

The room that k pieces leave is filled, as documents may be cut freely: closed bins wait, ``WAITING`` of them at most, for
what is left of a document that had to be cut anyway, then for a document that fits their room whole, and at last one document
is poured over many of them. What stays at the end of a worker's input is laid end to end in sequences whose lengths are
powers of two. So no sequence has padding, and few documents are cut.

Memory of a worker is bounded by bytes: remembered words, texts taken at a time, and rows sent back.

Nulls, ties and odd rows: a null text is an empty document, of the end token alone. Rows are packed one by one, so repeated
and null ids are separate documents, and ties cannot arise. A text of any length is encoded whole and cut. An empty table gives
no rows. Further columns are ignored.
"""

from __future__ import annotations

import gc
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, islice
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_texts, chunks_by_size, has_marks, ship_by_value

#: Bytes of words and their ids that one worker remembers.
REMEMBERED_BYTES = 64 << 20
#: What the tables hold for each word beside its letters and ids.
WORD_BYTES = 160
CHUNK_BYTES = 1 << 20
#: Tokens of pieces that are sent back at a time.
SENT_TOKENS = 1 << 18
#: Closed bins that wait for a filling; from half of it on, documents that fit whole are put into them.
WAITING = 32


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes | None) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Token ids of texts, found word by word.

    The vocabulary's splitting never joins what white space separates, so each word is encoded once and remembered.
    It lower-cases and splits at changes between letters, digits and signs, so a run of letters is one unit of the merges.
    """

    def __init__(self, vocabulary: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(vocabulary), end_id
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.numbers[None] = 0  # the end of a document
        self.first, self.flat, self.used = np.array([0, 1], dtype=np.int32), np.zeros(1 << 16, dtype=np.uint32), 1
        self.flat[0] = self.end_id
        self.held = 0

    def units(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words; plain letters, with a full stop or comma or without, go to the merges at once, all else through the whole tokenizer."""
        merge, out, rest = self.tokenizer.model.tokenize, [], []
        signs = {c: [t.id for t in merge(c.decode())] for c in (b".", b",")}
        for word in words:
            if word[:-1].isalpha() and word.isascii():
                word = word.lower()
            text = word.decode()
            if word.isalpha() and word.islower():
                out.append([t.id for t in merge(text)])
            elif (sign := signs.get(word[-1:])) and word[:-1].isalpha() and word.islower():
                out.append([t.id for t in merge(text[:-1])] + sign)
            elif _one_unit(text):
                out.append([t.id for t in merge(text.lower().encode().decode("latin-1").translate(_BYTE_LETTERS))])
            else:
                rest.append((len(out), text))
                out.append([])
        for (k, _), e in zip(rest, self.tokenizer.encode_batch_fast([text for _, text in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def learn(self, fresh: list[bytes]) -> None:
        lists = self.units(fresh)
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=total)
        self.first = np.r_[self.first, (self.used + np.cumsum(sizes)).astype(np.int32)]
        self.used += total
        self.held += sum(map(len, fresh)) + WORD_BYTES * len(fresh) + 4 * total

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with the end id, and how many each text has."""
        if self.held > REMEMBERED_BYTES:
            self.forget()
        known = len(self.numbers)
        words: list[bytes | None] = []
        n_words = []
        for t in texts:
            # the vocabulary lower-cases, but for its special tokens, whose text in capitals is ordinary, and after letters were composed with their marks
            own = (t if b"<|" in t or has_marks(t) else t.translate(LOWER)).split()
            own.append(None)
            words += own
            n_words.append(len(own))
        index = np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32, count=len(words))
        if len(self.numbers) > known:
            self.learn(list(islice(self.numbers, known, None)))
        start = self.first[index]
        sizes = self.first[index + 1] - start
        stops = np.cumsum(sizes, dtype=np.int32)
        take = np.repeat(start - (stops - sizes), sizes)
        take += np.arange(len(take), dtype=np.int32)
        per_doc = np.add.reduceat(sizes.astype(np.int64), np.cumsum([0, *n_words[:-1]])) if texts else np.zeros(0, dtype=np.int64)
        return self.flat[take], per_doc


def _one_unit(word: str) -> bool:
    """Letters of the Latin blocks, which stay single letters when lower-cased and composed."""
    return word.isalpha() and max(word) < "\u0250" and word.lower().isalpha()


class Piece(NamedTuple):
    doc_id: int | None
    doc_tokens: int
    start: int
    ids: np.ndarray

    def split(self, n: int) -> tuple[Piece, Piece | None]:
        rest = Piece(self.doc_id, self.doc_tokens, self.start + n, self.ids[n:]) if n < len(self.ids) else None
        return Piece(self.doc_id, self.doc_tokens, self.start, self.ids[:n]), rest


class HarmonicBins:
    """The open bins of one worker."""

    def __init__(self, capacity: int, first_id: int, with_ids: bool) -> None:
        self.capacity, self.next_id, self.with_ids = capacity, first_id, with_ids
        self.open: dict[int, list[Piece]] = {}
        self.waiting: list[tuple[int, list[Piece]]] = []  # room and pieces, by rising room
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.tokens = 0

    def close(self, pieces: list[Piece]) -> None:
        """A row for each piece of a sequence."""
        offset, total = 0, sum(len(p.ids) for p in pieces)
        for p in pieces:
            n = len(p.ids)
            self.rows.append((p.doc_id, p.start, n, zlib.crc32(p.ids), p.doc_tokens, self.next_id, offset, total))
            if self.with_ids:
                self.ids.append(p.ids)
            offset += n
        self.tokens += total
        self.next_id += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        capacity, n, start = self.capacity, len(ids), 0
        while n - start >= capacity:
            self.close([Piece(doc_id, n, start, ids[start : start + capacity])])
            start += capacity
        if start == n:
            return
        piece: Piece | None = Piece(doc_id, n, start, ids[start:].copy())
        if self.waiting and (start or len(self.waiting) >= WAITING or 2 * len(self.waiting) >= WAITING and self.waiting[-1][0] >= n):
            piece = self.pour(piece)
        if piece:
            self.place(piece)

    def place(self, piece: Piece) -> None:
        """Put a piece into the bin of its class; close that with its k-th."""
        k = self.capacity // len(piece.ids)
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            del self.open[k]
            self.wait(self.capacity - sum(len(p.ids) for p in held), held)

    def wait(self, room: int, pieces: list[Piece]) -> None:
        if room:
            insort(self.waiting, (room, pieces), key=itemgetter(0))
        else:
            self.close(pieces)

    def pour(self, piece: Piece) -> Piece | None:
        """Fill the least room that takes the piece whole, or else the widest ones in turn; return what is left."""
        rest: Piece | None = piece
        while rest and self.waiting:
            at = bisect_left(self.waiting, len(rest.ids), key=itemgetter(0))
            room, pieces = self.waiting.pop(min(at, len(self.waiting) - 1))
            part, rest = rest.split(room)
            self.wait(room - len(part.ids), [*pieces, part])
        return rest

    def finish(self) -> Iterator[None]:
        """Put what is in open bins into the room that takes it best, the largest first; pour the emptiest sequences over the others and lay the last one out in sequences of a power of two."""
        left = sorted((p for held in self.open.values() for p in held), key=lambda p: -len(p.ids))
        self.open = {}
        for p in left:
            if self.waiting and self.waiting[-1][0] >= len(p.ids):
                self.pour(p)
            else:
                self.wait(self.capacity - len(p.ids), [p])
        left = []
        while self.waiting:
            for p in self.waiting.pop()[1]:
                rest = self.pour(p)
                left += [rest] if rest else []
            if self.tokens:
                yield
        total, room, pieces = sum(len(p.ids) for p in left), 0, []
        for p in left:
            rest: Piece | None = p
            while rest:
                room = room or 1 << (min(total, self.capacity).bit_length() - 1)
                part, rest = rest.split(room)
                pieces.append(part)
                room, total = room - len(part.ids), total - len(part.ids)
                if not room:
                    self.close(pieces)
                    pieces = []
                    yield

    def sent(self) -> pa.RecordBatch:
        """The rows so far."""
        columns = list(zip(*self.rows, strict=True)) or [[]] * 8
        out = [pa.array(c, pa.int64()) for c in columns]
        if self.with_ids:
            stops = np.cumsum([0, *map(len, self.ids)], dtype=np.int32)
            flat = np.concatenate(self.ids or [np.zeros(0, dtype=np.uint32)]).view(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(stops), pa.array(flat)))
        self.clear()
        return pa.RecordBatch.from_arrays(out, names=NAMES[: len(out)])


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "ids"]


def _pack(vocabulary: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, end_id)
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 40, with_ids)
        collecting = gc.isenabled()
        gc.disable()  # words and ids form no cycles, and there are many
        try:
            for batch in batches:
                lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
                for a, z in chunks_by_size([n + 100 for n in lengths], CHUNK_BYTES):
                    part = batch.slice(a, z - a)
                    tokens, sizes = encoder.encode([t or b"" for t in byte_texts(part.column(1))])
                    stop = 0
                    for doc_id, size in zip(part.column(0).to_pylist(), sizes.tolist(), strict=True):
                        bins.add(doc_id, tokens[stop : stop + size])
                        stop += size
                        if bins.tokens >= SENT_TOKENS:
                            yield bins.sent()
            for _ in bins.finish():
                if bins.tokens >= SENT_TOKENS:
                    yield bins.sent()
            yield bins.sent()
        finally:
            if collecting:
                gc.enable()

    return run


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length and, if asked for, its ids.

    ``capacity`` must be a power of two. Each partition packs its own rows; a sequence never spans two.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_pack(vocabulary, capacity, end_id, with_ids), schema)


ship_by_value(__name__)
