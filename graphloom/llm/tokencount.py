"""Token counts of texts by the whole-token shortcut.

Offline, on the driver, every string of the vocabulary that ends a word is encoded alone; those that give their own token and
no other are proven whole. In the tasks a text is cut at white space, which the vocabulary drops; a word that is a proven
string counts one at once, any other is normalised and split into pre-tokens by the library's own rules, of which the proven
ones count one and only the rest goes through the merges. What a word gave is remembered, within a bound of bytes.

Nulls, ties and odd rows: a null text counts as empty and has no bytes and no tokens. Rows are counted one by one, so repeated
and null ids are separate rows and ties cannot arise. A text of any length is counted whole, in pieces that end at white space.
Words that hold a special string are encoded by the library as they stand. An empty table gives no rows. Further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_texts, chunks_by_size, has_marks, ship_by_value

#: The table of proven strings goes to every task; larger vocabularies than this are refused.
MOST_STRINGS = 1 << 20
#: Bytes of words that one worker remembers, what a table entry takes beside its letters, and bytes of texts and of one piece taken at a time.
REMEMBERED_BYTES, ENTRY_BYTES, CHUNK_BYTES = 48 << 20, 120, 1 << 20
#: A count holds tokens in its low bits and pre-tokens that were counted directly above them.
DIRECT = 1 << 40
#: Where bytes.split() cuts.
SPACES = b" \t\n\r\x0b\x0c"


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, as letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def whole_tokens(vocabulary: str) -> dict[bytes, str]:
    """Strings of the vocabulary that encode alone as their one token: UTF-8 bytes -> the vocabulary's spelling without its end mark."""
    from tokenizers import Tokenizer

    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if len(model["vocab"]) > MOST_STRINGS:
        raise ValueError(f"the vocabulary has more than {MOST_STRINGS} strings")
    end, letters, tried = model.get("end_of_word_suffix") or "", byte_of_letter(), []
    for spelled, number in model["vocab"].items():
        if spelled.endswith(end) and len(spelled) > len(end):
            plain = spelled[: len(spelled) - len(end)]
            try:
                tried.append((bytes(letters[c] for c in plain).decode(), plain, number))
            except (KeyError, UnicodeDecodeError):
                continue  # no text of its own
    encoded = Tokenizer.from_file(vocabulary).encode_batch([text for text, _, _ in tried], add_special_tokens=False)
    return {text.encode(): plain for (text, plain, number), e in zip(tried, encoded, strict=True) if e.ids == [number]}


def require_words(vocabulary: str) -> None:
    """An error unless the vocabulary drops white space, lower-cases, and has no special string with a space."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    spaced = all(ids(f"q{chr(s)}z{chr(s)}") == ids("q") + ids("z") for s in SPACES)
    folded = all(ids(chr(c)) == ids(chr(c + 32)) for c in range(65, 91))
    if not (spaced and folded) or any(c.isspace() for t in tokenizer.get_added_tokens_decoder().values() for c in t.content):
        raise ValueError("the vocabulary must drop white space and lower-case letters")


class WordCounts(dict):
    """Word -> its count, filled as words are asked for."""

    def __init__(self, vocabulary: str, whole: dict[bytes, str]) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.whole = Tokenizer.from_file(vocabulary), whole
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.spelled = frozenset(whole.values())
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.update(dict.fromkeys(self.whole, DIRECT + 1))
        self.held = 0

    def __missing__(self, word: bytes) -> int:
        found = self.count(word)
        if self.held < REMEMBERED_BYTES:
            self[word] = found
            self.held += len(word) + ENTRY_BYTES
        return found

    def count(self, word: bytes) -> int:
        text = word.decode()
        if any(s in word for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        merge, total = self.tokenizer.model.tokenize, 0
        for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text)):
            total += DIRECT + 1 if piece in self.spelled else len(merge(piece))
        return total

    def text(self, text: bytes) -> int:
        """The count of a text. Letters are lower-cased in one go where no mark could join with them, and no special string can come of it."""
        total = 0
        for part in parts(text):
            if not has_marks(part):
                low = part.translate(LOWER)
                part = part if any(s in low for s in self.special) else low
            total += sum(map(self.__getitem__, part.split()))
        return total


def parts(text: bytes) -> Iterator[bytes]:
    """Pieces of a long text that end at white space."""
    at = 0
    while len(text) - at > CHUNK_BYTES:
        cut = at + CHUNK_BYTES
        while cut < len(text) and text[cut] not in SPACES:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _counted(vocabulary: str, whole: dict[bytes, str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(vocabulary, whole)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0)
            found: list[int] = []
            for a, z in chunks_by_size([n + 100 for n in lengths.to_pylist()], CHUNK_BYTES):
                if counts.held >= REMEMBERED_BYTES:
                    counts.forget()
                found += [counts.text(t) if t else 0 for t in byte_texts(batch.column(1).slice(a, z - a))]
            columns = [batch.column(0), pc.cast(lengths, pa.int64()), pa.array([n % DIRECT for n in found], pa.int64()), pa.array([n // DIRECT for n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_tokens", "n_whole"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, n_whole) of every row: its UTF-8 bytes, its tokens, whether these are more than ``limit``, and how many were counted without a merge.

    ``vocabulary`` is a tokenizers file that all executors can read, of the kind that drops white space and lower-cases.
    """
    require_words(vocabulary)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_counted(vocabulary, whole_tokens(vocabulary)), f"id {kind}, n_bytes long, n_tokens long, n_whole long")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_whole")


ship_by_value(__name__)
