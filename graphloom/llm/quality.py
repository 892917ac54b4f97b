"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``MEASURES`` are SQL expressions over a text's words, lines and symbols; ``RULES`` gives each ratio of
them a range. Both are compiled into one projection: a text is split once, measured, and judged.

Nulls, ties and odd rows: a null or blank text has no words and fails the base rule. Rows are judged one by one, so
repeated and null ids need no care; further columns pass through ``keep``, whatever their names.
A text of any length is judged whole. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\\x20\\x09-\\x0D]"
SYMBOLS = r"[#*$%&|<>]"
REPEAT_WINDOW = 8

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and a to in is it that was for on are as with his they at be this from or by an not "
    "le la les de du des un une et est en que qui dans sur pour pas au "
    "der die das und ein eine ist mit den von im zu auf für nicht dem "
    "el los las y lo del se por con una como su al es más"
).split()

#: name: (numerator, denominator, least, most); a text is kept if each ratio lies in its range.
RULES: dict[str, tuple[str, str, float, float]] = {
    "word_length": ("word_chars", "n_words", 2.0, 15.0),
    "symbols_per_word": ("n_symbols", "n_words", 0.0, 0.1),
    "loud_per_word": ("n_loud", "n_words", 0.0, 0.3),
    "stop_words": ("n_stop", "n_words", 0.04, 0.7),
    "duplicate_lines": ("n_dup_lines", "n_lines", 0.0, 0.5),
    "words_per_line": ("n_words", "n_lines", 2.0, 1e9),
}


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeated_words(words: str) -> str:
    """Words covered by windows that come up twice or more, by hashing, sorting and merging the windows' places."""
    pairs = "zip_with({x}, slice({x}, {k}, size({x})), (a, b) -> xxhash64(a, b))"
    hashed = _let(f"transform({words}, x -> xxhash64(x))", "h1", _let(pairs.format(x="h1", k=2), "h2", _let(pairs.format(x="h2", k=3), "h4", f"slice({pairs.format(x='h4', k=5)}, 1, size({words}) - {REPEAT_WINDOW - 1})")))
    twice = "sort_array(array_distinct(flatten(filter(zip_with(t, slice(t, 2, size(t)), (a, b) -> if(a.h = b.h, array(a.i, b.i), null)), x -> x is not null))))"
    covered = f"aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least({REPEAT_WINDOW}, b - a)), 0L, (s, x) -> s + x)"
    merged = _let("sort_array(transform(h8, (h, i) -> struct(h, i)))", "t", _let(twice, "p", covered))
    found = _let(hashed, "h8", f"case when size(array_distinct(h8)) = size(h8) then 0L else {merged} end")
    return f"case when size({words}) < {REPEAT_WINDOW} then 0L else {found} end"


def measures(text: str) -> str:
    """SQL of a struct with all measures of a text expression."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    out = {
        "n_words": "cast(size(w) as bigint)",
        "word_chars": "aggregate(w, 0L, (s, x) -> s + length(x))",
        "n_symbols": f"cast(length(v) - length(regexp_replace(v, '{SYMBOLS}', '')) as bigint)",
        "n_dup_lines": "cast(size(l) - size(array_distinct(l)) as bigint)",
        "n_repeat_words": _repeated_words("w"),
        "n_lines": "cast(size(l) as bigint)",
        "n_stop": f"cast(size(filter(w, x -> lower(x) in ({stop}))) as bigint)",
        "n_loud": "cast(length(v) - length(regexp_replace(v, '[!?]', '')) as bigint)",
    }
    fields = ", ".join(f"'{k}', {v}" for k, v in out.items())
    lines = f"filter(split(v, '\\\\n'), x -> x rlike '{SPACE.replace('[', '[^', 1)}')"
    words = f"filter(split(v, '{SPACE}+'), x -> x <> '')"
    return _let(f"coalesce({text}, '')", "v", _let(words, "w", _let(lines, "l", f"named_struct({fields})")))


def verdict(measured: str, rules: dict[str, tuple[str, str, float, float]]) -> Column:
    """True if every rule's ratio is in range; a ratio over nothing is in range."""
    m = lambda name: F.col(f"{measured}.{name}")
    tests = [(m(a) >= lo * m(b)) & (m(a) <= hi * m(b)) for a, b, lo, hi in rules.values()]
    return reduce(lambda x, y: x & y, tests, F.lit(True))


def base_failed(measured: str) -> Column:
    m = lambda name: F.col(f"{measured}.{name}")
    return (m("n_words") < 20) | (100 * m("n_repeat_words") > 30 * m("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict | None = None) -> DataFrame:
    """id, all measures, base_failed and kept of every document."""
    rules = RULES if rules is None else rules
    measured = docs.select(F.col(id_col).alias("doc_id"), F.expr(measures(f"`{text_col}`")).alias("m"))
    return measured.select("doc_id", "m.*", base_failed("m").alias("base_failed"), (~base_failed("m") & verdict("m", rules)).alias("kept"))


def keep(docs: DataFrame, text_col: str = "text", rules: dict | None = None) -> DataFrame:
    """The documents that pass, with all their columns."""
    rules = RULES if rules is None else rules
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.expr(measures(f"`{text_col}`")).alias("m"))
    return packed.where(~base_failed("m") & verdict("m", rules)).select("row.*")
