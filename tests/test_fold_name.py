"""The whole-table fold query against Python's unicodedata."""

import hashlib
import re
import unicodedata

from graphloom.plans import registry
from pyspark.sql import functions as F


def folded(text):
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower().replace("'", "")
    return re.sub("[^a-z0-9]+", " ", plain).strip()


def test_fold_name_takes_all_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where(F.col("text").isNotNull()).collect()
    want = {r.doc_id: hashlib.md5(folded(r.text).encode()).hexdigest() for r in docs}
    got = {r.doc_id: r.k for r in registry.QUERIES["f12_fold_name_all"](spark, tiny).where("k is not null").collect()}
    assert got == want
    assert sum(not r.text.isascii() for r in docs) > 20
