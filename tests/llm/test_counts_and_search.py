"""Token counts against the library, whitening against plain numpy, ranked search against a plain ranking."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from graphloom.llm import queries, ranked, tokencount, whitening
from graphloom.llm.common import read_table
from tokenizers import Tokenizer

VOCABULARY = queries.vocabulary_path()
TEXTS = [
    None, "", " \n\t ", "Hello, World! don't I'LL we've 'S 'vE", "<|endoftext|>x <|startoftext|> a<|endoftext|>b <|ENDOFTEXT|> <|", "J̌ H̱x T̈ W̊ Y̊ İ İ K ǅ",
    "é É ẞ ΣΣ Σ", "a b c　d\x1ce\x85f​g", "你好 世界 123 1½ ٣", "\U0001f600\U0001f600 a\U0001f600", "word " * 500_000, "x" * 70_000, "a\x00b�", "it's 42nd ST. e-mail@example.com http://x.y/z?q=1",
]


def test_token_counts_equal_the_library(spark, tiny):
    plain = Tokenizer.from_file(VOCABULARY)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again 3")] + [(r.doc_id, r.text) for r in read_table(spark, tiny, "documents").collect()]
    df = spark.createDataFrame([(i, t, 7, "clash") for i, t in rows], "doc_id long, text string, n_tokens int, id string").repartition(5)
    found = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(df, VOCABULARY).collect())
    sizes = [len(e.ids) for e in plain.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert found == Counter((i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, sizes, strict=True))


def test_proven_strings_and_empty_table(spark):
    whole, plain = tokencount.whole_tokens(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    assert len(whole) > 20_000 and all(len(plain.encode(w.decode(), add_special_tokens=False).ids) == 1 for w in whole)
    assert tokencount.count_tokens(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0
    r = tokencount.count_tokens(spark.createDataFrame([("k", "the the qzqzqz")], "name string, body string"), VOCABULARY, 2, "name", "body").first()
    assert (r.name, r.n_whole, r.over_limit) == ("k", 2, True)
    with pytest.raises(ValueError):
        tokencount.require_words(queries.vocabulary_path("byte_bpe_50k.json"))


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED_BYTES", 1000)
    counts = tokencount.WordCounts(VOCABULARY, tokencount.whole_tokens(VOCABULARY))
    n = len(counts)
    text = " ".join(f"zq{i}x" for i in range(500))
    assert counts.text(text.encode()) % tokencount.DIRECT == len(Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids)
    assert len(counts) < n + 20


def brute_whiten(rows, k=16, counted=False, d=None):
    kept = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    lengths = Counter(len(v) for _, v in kept)
    d = max(lengths, key=lambda n: (lengths[n], n)) if lengths else 0
    x = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in kept if len(v) == d]
    many = Counter(v for _, v in x)
    fit = sorted(many)
    w = [many[v] if counted else 1 for v in fit]
    n = sum(w)
    sums = [sum(a * v[j] for a, v in zip(w, fit, strict=True)) for j in range(d)]
    centred = np.array([[(n * v[j] - sums[j]) / n for j in range(d)] for v in fit])
    cov = (centred * np.array(w)[:, None]).T @ centred / n if n else np.zeros((d, d))
    return x, n, sums, cov


def vectors(n=60, d=7):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=d) * np.arange(1, d + 1)]) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(400)] + [(5, rows[7][1]), (None, rows[8][1]), (6, None), (8, []), (9, [1.0] * (d + 1))]
    return rows + [(11, [float("nan")] + [1.0] * (d - 1)), (12, [float("inf")] + [1.0] * (d - 1)), (13, [None] + [1.0] * (d - 1))]


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_equals_numpy(spark, monkeypatch, weights):
    monkeypatch.setattr(whitening, "LEAST", 100)
    rows = vectors()
    df = spark.createDataFrame([(i, v, "clash", 3) for i, v in rows], "vec_id long, embedding array<float>, x string, n int").repartition(6)
    x, n, sums, cov = brute_whiten(rows, counted=weights == "count")
    found = whitening.whiten(df, components=5, weights=weights).collect()
    values, base = np.linalg.eigh(cov)
    of = defaultdict(list)
    for i, v in x:
        of[i].append(v)
    assert len(found) == 5 * len(x) and {r.n for r in found} == {n}
    assert Counter((r.vec_id, r.deviation) for r in found if r.component == 1) == Counter((i, sum((n * v[j] - sums[j]) ** 2 for j in range(len(v)))) for i, v in x)
    for r in found:
        e, u = values[-r.component], base[:, -r.component]
        want = [abs(float(np.array([(n * a - s) / n for a, s in zip(v, sums, strict=True)]) @ u) / e**0.5) for v in of[r.vec_id]]
        assert min(abs(abs(r.whitened) - a) for a in want) < 1e-9 and abs(r.explained - e / np.trace(cov)) < 1e-9 and r.identity_error < 1e-9


def test_whitening_of_whole_table(spark, tiny):
    found = queries.op12_whitening(spark, tiny).toPandas()
    assert len(found) == 16 * read_table(spark, tiny, "embeddings").count() and found.identity_error.max() < 1e-9
    z = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    if found.n.iloc[0] == len(z):
        assert np.abs(z.T @ z / len(z) - np.eye(16)).max() < 1e-9


def test_whitening_of_odd_tables(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert make([]) == [] and make([(1, None), (2, [float("nan")])]) == []
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])] == [(1, 0, None, 0.0)] * 4
    huge = make([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.5, 0.5])])
    assert len(huge) == 6 and {r.n for r in huge} == {3} and all(r.deviation is None or r.deviation >= 0 for r in huge)


def test_packed_rows_round_trip():
    rows = np.array([[0, -1, 127], [-128, 5, 6], [128, 0, 0], [-(1 << 31), 0, 1], [1 << 31, 0, 1], [whitening.MOST, -whitening.MOST, 0]])
    keys = whitening.pack_rows(rows)
    assert [k[0] for k in keys] == [1, 1, 2, 4, 8, 8] and (whitening.unpack_rows(keys, 3) == rows).all()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, top=10):
    split = lambda t: TERM.findall((t or "").translate(FOLD))
    have = [(i, Counter(split(t))) for i, t in docs]
    have = [(i, c) for i, c in have if c]
    total, length = len(have), sum(sum(c.values()) for _, c in have)
    df = Counter(t for _, c in have for t in c)
    out = Counter()
    for item, text in items:
        asked, scores = Counter(split(text)), []
        for i, c in have:
            m = 25 + (75 * sum(c.values()) * total) // length
            score = sum(k * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in asked.items() if t in c)
            scores += [(-score, i is None, i or 0, i)] if score else []
        for rank, (score, _, _, i) in enumerate(sorted(scores)[:top], 1):
            out[item, rank, i, -score] += 1
    return out


def rows_of(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def odd_search():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)] + ["Über", "über", "naïve", "東京", "42", "A", "a"]
    text = lambda n: " ".join(rng.choice(words, n, p=None))
    docs = [(i, text(int(rng.integers(1, 200)))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(150)] + [(2000 + i, docs[6][1] + f" tail{i}") for i in range(80)]
    docs += [(3, None), (4, ""), (5, "--- ..."), (None, docs[7][1]), (None, docs[7][1]), (9, docs[8][1]), (9, docs[8][1]), (5000, "w1 " * 40_000 + "w2")]
    items = [(i, text(20)) for i in range(25)] + [(90, docs[5][1]), (91, docs[6][1]), (92, None), (93, "?!"), (94, "unheard-of zzz"), (95, "w1 w1 w1"), (95, "w2"), (None, "W3 ÜBER"), (96, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, small):
    if small:  # many blocks of each kind, and signatures that err often
        for name, value in {"BLOCK_DOCS": 16, "BLOCK_QUERIES": 4, "CHUNK": 7, "BITS": 2, "BROADCAST_ROWS": 0}.items():
            monkeypatch.setattr(ranked, name, value)
    docs, items = odd_search()
    left = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, row int, terms string").repartition(5)
    right = spark.createDataFrame([(i, t, 2, "y") for i, t in items], "item_id long, text string, q int, score string")
    assert rows_of(ranked.search(left, right)) == brute_search(docs, items)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(7, "b")], "item_id long, text string")
    assert ranked.search(docs.limit(0), items).collect() == [] and ranked.search(docs, items.limit(0)).collect() == []
    assert rows_of(ranked.search(docs, items)) == brute_search([(1, "a b")], [(7, "b")])


def test_bounds_are_never_below_scores():
    rng = np.random.default_rng(1)
    sizes, hashes = rng.integers(1, 60, 50), None
    hashes, tfs = rng.integers(1, 400, sizes.sum()).astype(np.uint64), rng.geometric(0.2, sizes.sum())
    width, bits = ranked.slices(hashes, tfs, sizes)
    docs = np.repeat(np.arange(50), sizes)
    for level, least in enumerate(ranked.LEVELS):
        at = ranked.places(hashes, level, width)
        hit = np.unpackbits(bits[at[0]] & bits[at[1]] & bits[at[2]], axis=1)[np.arange(len(docs)), docs]
        assert hit[tfs >= least].all()
