"""Near copies against the exact Jaccard similarity of all pairs."""

import random

import corpus_pipeline
import pytest
from graphloom.llm import nearcopies, simhash
from graphloom.llm.common import LOWER, read_table


def shingles(text, n=5):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def all_pairs(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    return {(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if a != b and 5 * len(x & y) >= 4 * len(x | y)}


def groups(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def edited(rng, words, edits):
    words = list(words)
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def planted():
    """Texts and copies with so many words changed that their similarity lies around 0.8; some short, some chained, some with a shared passage."""
    rng, rows = random.Random(7), []
    common = " ".join(f"c{k}" for k in range(40))
    for k in range(60):
        words = [f"{rng.choice('abc')}{rng.randrange(2000)}" for _ in range(rng.choice([6, 12, 40, 120, 400, 1500]))]
        rows += [" ".join(words), edited(rng, words, max(1, len(words) // 50)), edited(rng, words, len(words) // 45), common + " " + edited(rng, words, len(words) // 40)]
    rows += ["", None, "One two", "one TWO", "one two three"]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("group", [1024, 4])
def test_near_copies(spark, monkeypatch, group):
    monkeypatch.setattr(nearcopies, "GROUP", group)
    rows = planted()
    pairs = all_pairs(rows)
    assert len(pairs) > 60
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(df).collect()}
    assert got == groups([i for i, _ in rows], pairs)


def test_pipeline_stage_keeps_one_of_each_group(spark, tiny):
    rows = planted()
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], read_table(spark, tiny, "documents").schema)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, tiny).collect()}
    assert got == {i for i, g in groups([i for i, _ in rows], all_pairs(rows)).items() if i == g}


def test_simhash_finds_the_close_copies(spark, monkeypatch):
    """Pairs within three bits of a SimHash of their shingles are candidates; what is not similar enough is not linked, and all else is left to the prefix filter."""
    seen, near_pairs = [], nearcopies._near_pairs
    monkeypatch.setattr(nearcopies, "_near_pairs", lambda members, *rest: (seen.append((members, out := near_pairs(members, *rest))), out)[1])
    rng = random.Random(3)
    rows = planted()
    for k in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(600)]
        rows += [(1000 + 2 * k, " ".join(words)), (1001 + 2 * k, edited(rng, words, 1))]
    rows += [(2000, "a b c d e f"), (2001, "a b c d e f f")]
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    pairs = all_pairs(rows)
    assert got == groups([i for i, _ in rows], pairs)
    prints = {r.doc_id: r.fp0 % 2**64 for r in simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), n_words=5).collect()}
    sets = {i: shingles(t) for i, t in rows}  # texts of one set are one node
    close = {(a, b) for a, b in pairs if (prints[a] ^ prints[b]).bit_count() <= 3 and sets[a] != sets[b]}
    joined = groups([i for i, _ in rows], {(r.a, r.b) for r in seen[0][1].collect()})
    assert len(seen) == 2 and len(close) > 10 and all(joined[a] == joined[b] for a, b in close)
    # no group of the prefix filter is wholly of what SimHash has linked
    members = {}
    for r in seen[1][0].collect():
        members.setdefault(r.grp, set()).add(joined[r.node])
    assert members and min(map(len, members.values())) > 1


def test_odd_ids(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text), (2, text), (3, text.replace("w150 ", "x ")), (4, "other words " * 5), (4, "quite another text"), (5, "quite another text"), (None, text), (None, text)]
    kept = nearcopies.keep_first(spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, node string"))
    assert kept.columns == ["doc_id", "text", "node"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, None, None]
