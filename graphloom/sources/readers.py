"""Sources (S1-S8, S14): always with a schema, text first and cast later."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import lookup
from ..functions.predicates import in_bbox


def read_csv_union(spark: SparkSession, paths: Sequence[str], rename: Mapping[str, str]) -> DataFrame:
    """Rows of all files with the renamed columns as text; absent columns are null, absent files skipped; rename: source -> new name."""
    frames = []
    for path in paths:
        try:
            df = spark.read.option("header", True).option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        have = set(df.columns)
        frames.append(df.select(*((F.col(f"`{s}`") if s in have else F.lit(None)).cast("string").alias(n) for s, n in rename.items())))
    if not frames:
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in rename.values()]))
    return reduce(lambda a, b: a.unionByName(b), frames)


def read_json_doc(spark: SparkSession, path: str, schema: str | T.StructType, field: str) -> DataFrame:
    """Items of one array of a nested JSON document, as columns."""
    item = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode(field).alias("item"))
    return item.select("item.*") if isinstance(item.schema["item"].dataType, T.StructType) else item


def flatten_tree(df: DataFrame, children: str = "children", max_depth: int = 3, name: str = "name") -> DataFrame:
    """Parent-pointer rows of nested arrays: path, parent_path, depth, name, category (depth 1), subcategory (depth 2) and the node's other fields.

    df has a row per root; each level is exploded from the one above.
    """
    fields = [c for c in df.columns if c not in (children, name)]
    node = lambda struct: [F.col(f"{struct}.{c}").alias(c) if struct else F.col(c) for c in fields]
    level = df.select(F.col(name).alias("path"), F.lit(None).cast("string").alias("parent_path"), F.lit(1).alias("depth"), F.col(name).alias("name"), F.col(name).alias("category"), F.lit(None).cast("string").alias("subcategory"), *node(""), F.col(children).alias("_kids"))
    levels = []
    for depth in range(1, max_depth + 1):
        levels.append(level.drop("_kids"))
        kids = level.schema["_kids"].dataType if "_kids" in level.columns else None
        if depth == max_depth or not isinstance(kids, T.ArrayType) or not isinstance(kids.elementType, T.StructType):
            break
        below = {f.name for f in kids.elementType.fields}
        rows = level.select(F.col("path").alias("parent_path"), "category", "subcategory", F.explode("_kids").alias("k"))
        fallback = dict(df.dtypes)
        level = rows.select(
            F.concat_ws("/", "parent_path", F.col(f"k.{name}")).alias("path"), "parent_path", F.lit(depth + 1).alias("depth"), F.col(f"k.{name}").alias("name"), "category",
            (F.col(f"k.{name}") if depth == 1 else F.col("subcategory")).alias("subcategory"),
            *((F.col(f"k.{c}") if c in below else F.lit(None).cast(fallback[c])).alias(c) for c in fields),
            *([F.col(f"k.{children}").alias("_kids")] if children in below else []),
        )
    return reduce(lambda a, b: a.unionByName(b), levels)


PRODUCT = "struct<roaster:string,title:string,url:string,description:string,tags:array<string>,product_type:string,channel:string,price:double,currency:string,net_weight_grams:int,roast_level:string,process:string,is_blend:boolean,source:string>"
SCRAPE_LOG = f"site string, product {PRODUCT}, _site_done string, status string"


def scraped(log: DataFrame) -> DataFrame:
    """Products of log records, with their site; markers go."""
    return log.where(F.col("product").isNotNull()).select("site", "product.*")


def read_scrape_log(spark: SparkSession, path: str) -> DataFrame:
    """Products of all JSON-lines files below a folder; truncated lines and markers are dropped."""
    return scraped(spark.read.schema(SCRAPE_LOG).option("mode", "DROPMALFORMED").json(path))


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_places(places: DataFrame, boxes: Sequence[tuple[float, float, float, float]], categories: Sequence[str], min_confidence: float) -> DataFrame:
    """Named places of some categories inside any of the boxes; first address and website. The filters reach the Parquet scan."""
    kept = places.where(in_bbox("bbox.xmin", "bbox.ymin", boxes) & F.col("categories.primary").isin(list(categories)) & (F.col("confidence") >= min_confidence) & F.col("names.primary").isNotNull())
    first = F.get("addresses", F.lit(0))
    return kept.select(
        "id", F.col("names.primary").alias("name"), F.col("bbox.xmin").alias("longitude"), F.col("bbox.ymin").alias("latitude"),
        first["freeform"].alias("address"), first["locality"].alias("city"), first["country"].alias("country"), F.get("websites", F.lit(0)).alias("website"), "confidence",
    )


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file without comments and blanks."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(line.alias("value")).where("value <> ''")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(city, country) of 'City,CC' lines; any other line is an error."""
    lines = read_list(spark, path)
    good = F.col("value").rlike("^[^,]*[^,\\s][^,]*,\\s*[A-Za-z]{2}\\s*$")
    checked = F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a 'City,CC' line: "), F.col("value"))))
    parts = lines.select(F.split(checked, ",").alias("p"))
    return parts.select(F.trim(F.col("p")[0]).alias("city"), F.upper(F.trim(F.col("p")[1])).alias("country"))


def load_centroids(spark: SparkSession, path: str) -> DataFrame:
    """(country, lat, lon, iso) of a JSON-lines table of countries."""
    return spark.read.schema("country string, lat double, lon double, iso string").json(path)


# The terms of an N-Triples or N-Quads line. A code unit is written \\uXXXX (surrogates in pairs) or \\UXXXXXXXX.
HEX = "[0-9A-Fa-f]"
UCHAR = rf"\\u(?:[0-9A-CE-Fa-ce-f]{HEX}{{3}}|[Dd][0-7]{HEX}{{2}}|[Dd][89ABab]{HEX}{{2}}\\u[Dd][C-Fc-f]{HEX}{{2}})|\\U(?:0010{HEX}{{4}}|000[1-9A-Fa-f]{HEX}{{4}}|0000(?:[0-9A-CE-Fa-ce-f]{HEX}{{3}}|[Dd][0-7]{HEX}{{2}}))"
IRI_SIGN, TEXT_SIGN = r"""[^\x00-\x20<>"{}|^`\\]""", r"""[^"\\\r\n]"""
# repeats are possessive, so that long terms need no stack
IRI = rf"<{IRI_SIGN}*+(?:(?:{UCHAR}){IRI_SIGN}*+)*+>"
BNODE = r"""_:[^\s<>".]+(?:\.+[^\s<>".]+)*"""
LITERAL = rf"""\"{TEXT_SIGN}*+(?:(?:\\[tbnrf"'\\]|{UCHAR}){TEXT_SIGN}*+)*+\"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^{IRI})?"""
STATEMENT = rf"^\s*({IRI}|{BNODE})\s*({IRI})\s*({IRI}|{BNODE}|{LITERAL})\s*({IRI}|{BNODE})?\s*\.\s*(?:#.*)?$"
NO_STATEMENT = r"^\s*(?:#.*)?$"
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescaped(c: Column) -> Column:
    """Text with its escapes resolved. Runs of code units are decoded together, so surrogate pairs give their character."""
    pieces = F.regexp_extract_all(c, F.lit(rf"(?:\\u{HEX}{{4}})+|\\U{HEX}{{8}}|(?s:\\.)|[^\\]+"), F.lit(0))

    def plain(p: Column) -> Column:
        units = F.decode(F.unhex(F.replace(p, F.lit("\\u"), F.lit(""))), "UTF-16BE")
        point = F.decode(F.unhex(F.substring(p, 3, 8)), "UTF-32")
        return F.when(p.startswith("\\u"), units).when(p.startswith("\\U"), point).when(p.startswith("\\"), lookup(F.substring(p, 2, 1), ESCAPES)).otherwise(p)

    return F.when(c.contains("\\"), F.array_join(F.transform(pieces, plain), "")).otherwise(c)


def load_triples(lines: DataFrame, graph: str = "default", value: str = "value") -> DataFrame:
    """subject, predicate, object, kind (iri, bnode, literal), datatype, lang and graph of N-Triples and N-Quads lines, escapes resolved.

    A line's own graph comes before the given one. Blank nodes keep their '_:'. Blank lines and comments say nothing; of all other
    lines ``rejected_triples`` tells those that are no statement.
    """
    raw = lines.where(F.col(value).rlike(STATEMENT)).select(*(F.regexp_extract(value, STATEMENT, k).alias(n) for k, n in ((1, "s"), (2, "p"), (3, "o"), (4, "g"))))
    node = lambda c: F.when(F.col(c).startswith("<"), unescaped(F.expr(f"substring({c}, 2, length({c}) - 2)"))).otherwise(F.col(c))
    kind = F.when(F.col("o").startswith('"'), "literal").when(F.col("o").startswith("_:"), "bnode").otherwise("iri")
    # what stands behind a literal has no quotes
    suffix = F.substring_index("o", '"', -1)
    literal = unescaped(F.expr("""substring(o, 2, length(o) - length(substring_index(o, '"', -1)) - 2)"""))
    return raw.select(
        node("s").alias("subject"), node("p").alias("predicate"), F.when(kind == "literal", literal).otherwise(node("o")).alias("object"), kind.alias("kind"),
        F.when((kind == "literal") & suffix.startswith("^^"), unescaped(F.regexp_extract(suffix, r"^\^\^<(.*)>$", 1))).alias("datatype"), F.when((kind == "literal") & suffix.startswith("@"), F.substr(suffix, F.lit(2))).alias("lang"),
        F.when(F.col("g") != "", node("g")).otherwise(F.lit(graph)).alias("graph"),
    ).distinct()


def rejected_triples(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines that are neither a statement nor blank nor a comment."""
    return lines.where(~F.col(value).rlike(STATEMENT) & ~F.col(value).rlike(NO_STATEMENT)).select(value)


def read_activity(spark: SparkSession, path: str | None = None, **jdbc: str) -> DataFrame:
    """User activity from Parquet, or over JDBC by the reader's own options."""
    return spark.read.parquet(path) if path is not None else spark.read.format("jdbc").options(**jdbc).load()
