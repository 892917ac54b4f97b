"""Line deduplication with a log-template tree, in DataFrame operations only.

The tree has a fixed depth: a line descends by its number of tokens and then by its leading tokens; tokens with digits or an at
sign are variable fields from the start. Of a leaf's lines the most frequent token of each place makes up its template. A
line belongs to it if ``min_fixed`` per cent of its fixed tokens agree, the other places being variable fields; a line that does
not is a template of its own. A leaf of many kinds of lines thus loses none of them, however large it grows.

A template recurs if documents of ``min_docs`` different families have it, and these are ``min_share`` per cent of the different
texts that have it. A family is a text with its copies and near copies, so copies of one document do not make its lines
recur; they are left to document-level deduplication. Two texts are of one family if they agree in two of four passages:
the five words from the first occurrence of the long word that comes first in one of four random orders. All lines
of recurring templates are dropped, short ones and those inside a block of them too.

Nulls, ties and odd rows: a null text has no lines and stays null. Lines without a fixed token, as of numbers alone, are never
dropped. Of tokens that are equally frequent the greatest stands for its place. Rows that repeat an id and text behave
alike, and a null id is a value like others. A text of any length is taken whole. An empty table gives no rows. Further columns pass
through ``clean``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SPACE = r"[\\x20\\x09-\\x0D]"
#: Stands for a variable field.
FIELD = "<*>"
#: Letters of a long word, orders of long words, and words of a passage.
LONG, ORDERS, PASSAGE = 8, 4, 5


def _bound(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with a name for ``value``, which is so evaluated once and not copied between operators."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def parsed_lines(docs: DataFrame, depth: int) -> DataFrame:
    """Per document (key, text): key, links (what it shares with the others of its family) and lines: place i, leaf, masked line and number of fixed tokens."""
    tokens = f"transform(l, x -> filter(split(x, '{SPACE}+'), t -> t <> ''))"
    # the texts of a family agree in passages; the md5 sum of a long word gives its places in the orders
    marked = f"transform(array_distinct(filter(t, x -> length(x) >= {LONG})), x -> concat(md5(x), x))"
    first = [f"array_min(transform(w, x -> substr(x, {8 * k + 1})))" if k else "array_min(w)" for k in range(ORDERS)]
    passage = [f"xxhash64(array_join(slice(t, cast(array_position(t, substr({x}, {33 - 8 * k})) as int), {PASSAGE}), ' '))" for k, x in enumerate(first)]
    pairs = ", ".join(f"xxhash64('{a} {b}', p[{a}], p[{b}])" for a, b in combinations(range(ORDERS), 2))
    links = _bound("t", "flatten(tokens)", _bound("w", marked, f"if(size(w) > 0, {_bound('p', f'array({", ".join(passage)})', f'array({pairs})')}, null)"))
    masked = f"if(get(l, i) rlike '[0-9@]', transform(x, t -> if(t rlike '[0-9@]', '{FIELD}', t)), x)"
    row = f"struct(i, unhex(md5(concat_ws(' ', size(t), slice(t, 1, {depth})))) as leaf, concat_ws(' ', t) as masked, size(array_remove(t, '{FIELD}')) as fixed)"
    parsed = f"filter(transform(tokens, (x, i) -> {_bound('t', masked, row)}), x -> x.fixed > 0)"
    both = _bound("l", "split(text, '\\n')", _bound("tokens", tokens, f"struct({links} as links, {parsed} as lines)"))
    return docs.where("text is not null").select("key", F.expr(both).alias("x")).select("key", "x.*")


def families(parsed: DataFrame) -> DataFrame:
    """hash and family of the texts that share a link with a text of smaller hash."""
    each = parsed.where("links is not null").groupBy("key.hash").agg(F.first("links").alias("links")).select("hash", F.explode("links").alias("link"))
    each = stored(each, "links")
    # what is joined to is written first: Spark then knows its size, and broadcasts it or splits hot keys
    shared = stored(each.groupBy("link").agg(F.min("hash").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "shared-links")
    return each.join(shared, "link").groupBy("hash").agg(F.min("least").alias("family")).where("family < hash")


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, min_docs: int = 10, min_share: int = 5, min_fixed: int = 60) -> DataFrame:
    """key (id and text hash of a document) and dropped: the places of its lines that belong to recurring templates."""
    parsed = stored(parsed_lines(docs.select(_key(id_col, text_col), F.col(text_col).alias("text")), depth), "lines")
    lines = parsed.select("key", F.explode("lines").alias("x")).select("key", "x.*")

    # a template's lines share a leaf, so only leaves with enough lines need a closer look
    hot = stored(lines.groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"), "hot-leaves")
    lines = stored(lines.join(hot, "leaf", "left_semi"), "hot-lines")
    places = lines.groupBy("leaf", "masked").count().select("leaf", "count", F.posexplode(F.split("masked", " ")).alias("place", "token"))
    seen = places.groupBy("leaf", "place", "token").agg(F.sum("count").alias("n"))
    usual = seen.groupBy("leaf", "place").agg(F.max(F.struct(F.when(F.col("token") != FIELD, F.col("n")).otherwise(0).alias("n"), F.when(F.col("token") != FIELD, F.col("token")).otherwise("").alias("token"))).getField("token").alias("token"))
    usual = stored(usual.groupBy("leaf").agg(F.expr("transform(array_sort(collect_list(struct(place, token))), x -> x.token)").alias("usual")), "templates")
    agree = F.size(F.filter(F.zip_with(F.split("masked", " "), "usual", lambda x, y: x == y), lambda same: same))
    general = 100 * agree >= min_fixed * F.col("fixed")
    lines = lines.join(usual, "leaf").select("key", "i", F.when(general, F.col("leaf")).otherwise(F.expr("unhex(md5(concat(hex(leaf), masked)))")).alias("template"))
    texts = lines.select("template", "key.hash").distinct().join(stored(families(parsed), "families"), "hash", "left")
    seen = texts.groupBy("template", F.coalesce("family", "hash").alias("family")).count().groupBy("template").agg(F.count("*").alias("families"), F.sum("count").alias("texts"))
    recurring = seen.where((F.col("families") >= min_docs) & (100 * F.col("families") >= min_share * F.col("texts"))).select("template")
    return lines.join(stored(recurring, "recurring"), "template", "left_semi").groupBy("key").agg(F.collect_set("i").alias("dropped"))


def _cut(docs: DataFrame, id_col: str, text_col: str, options: dict) -> DataFrame:
    """row (all columns) and dropped, the places of the lines that go, of every document."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _key(id_col, text_col))
    found = recurring_lines(docs, id_col, text_col, **options)
    return rows.join(found, rows["key"].eqNullSafe(found["key"]), "left").select("row", "dropped")


def _key(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).alias("id"), F.unhex(F.md5(text_col)).alias("hash")).alias("key")


def _text(text_col: str) -> Column:
    """What is left of the text. The lines are bound to a name, or they would be split anew for each that stays."""
    kept = "transform(array_except(sequence(0, size(l) - 1), dropped), i -> get(l, i))"
    left = F.expr(f"array_join(element_at(transform(array(split(row.`{text_col}`, '\\n')), l -> {kept}), 1), '\n')")
    return F.when(F.col("dropped").isNull(), F.col("row").getField(text_col)).otherwise(left)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and text (what is left) of every document."""
    text = F.col("row").getField(text_col)
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)
    n_dropped = F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped"))
    return _cut(docs, id_col, text_col, options).select(F.col("row").getField(id_col).alias("doc_id"), n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), _text(text_col).alias("text"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without their recurring lines, with all their columns; those with no word left are dropped."""
    cut = _cut(docs, id_col, text_col, options)
    text = _text(text_col)
    columns = [text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return cut.where(F.col("dropped").isNull() | text.rlike("[^\\x20\\x09-\\x0D]")).select(*columns)
