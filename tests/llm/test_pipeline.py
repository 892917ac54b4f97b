"""The corpus pipeline against brute-force versions of its stages."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from graphloom.llm import simhash
from graphloom.llm.common import read_table
from graphloom.llm.queries import vocabulary_path
from graphloom.llm.simhash import keep_first

from .test_more_ops import WORD, brute_lines
from .test_nearcopies import all_pairs, groups
from .test_text_ops import brute_hits


def test_pipeline(spark, tiny):
    from tokenizers import Tokenizer

    got = corpus_pipeline.run(spark, tiny).collect()
    docs = read_table(spark, tiny, "documents")
    rows = [(r.doc_id, r.text) for r in corpus_pipeline.quality_rules(spark, docs, tiny).collect()]
    rows = [(i, t) for i, _, n, t in brute_lines(rows) if not n or WORD.search(t)]
    group = groups([i for i, _ in rows], all_pairs(rows))
    assert any(g != i for i, g in group.items())
    rows = [(i, t) for i, t in rows if group[i] == i]
    items = [(r.item_id, r.text) for r in read_table(spark, tiny, "benchmark").collect()]
    hit = {i for i, _, n, *_ in brute_hits(rows, items, 10) if n}
    rows = [(i, t) for i, t in rows if i not in hit]
    t = Tokenizer.from_file(vocabulary_path())
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.ids))
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in pieces.items()} == {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in rows}
    assert 20 < len(rows) < docs.count()


def test_stages_keep_columns_and_take_odd_rows(spark, tiny):
    docs = read_table(spark, tiny, "documents")
    odd = spark.createDataFrame([(None, "no id " * 30, None, None, None), (7, None, "en", "s", 3), (7, "", "en", "s", 0)], docs.schema)
    for df in (docs.limit(0), odd, docs.unionByName(odd)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, tiny)
            assert out.columns == docs.columns and out.count() <= df.count(), name
        packed = corpus_pipeline.STAGES[-1][1](spark, df, tiny)
        assert packed.where("start = 0").count() == df.count()


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_keep_first(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BROADCAST_IDS", limit)
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text), (2, text), (3, text.replace("w150 ", "x ")), (4, "other words " * 5), (4, "other words " * 5), (None, text), (None, text), (5, text[::-1])]
    df = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, node string")
    kept = keep_first(df, blocks=4, max_bits=27)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, 4: 1, 5: 1, None: 2})
