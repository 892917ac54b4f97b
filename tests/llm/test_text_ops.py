"""Substring dedup, SimHash, decontamination, packing and sharding against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from graphloom.llm import decontam, packing, queries, sharding, simhash, substring
from graphloom.llm.common import read_table
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOREM = [f"w{i}" for i in range(400)]
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, " ".join(LOREM[:120])),
    (5, "x " + " ".join(LOREM[20:110]) + " y"),
    (6, " ".join(LOREM[:120])),
    (7, "same " * 300),
    (8, "same " * 120 + "other " * 60),
    (9, " ".join(LOREM[60:115]) + " z " + " ".join(LOREM[:49])),
    (10, "q " + " ".join(LOREM[20:75]) + " r"),
    (11, "p " + " ".join(LOREM[19:72]) + " r"),
    (11, " ".join(LOREM[300:380])),
    (None, " ".join(LOREM[:120])),
    (12, " ".join(LOREM * 60)),
]


def documents(spark, tiny):
    rows = [(r.doc_id, r.text) for r in read_table(spark, tiny, "documents").collect()]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "noise", "clash") for i, t in rows], "doc_id long, text string, owner string, spans string").repartition(5)


def brute_repeats(rows, window):
    least = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if i is not None:
                least[k] = min(least.get(k, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and least[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [50, 8])
def test_substring(spark, tiny, window):
    rows = documents(spark, tiny) + [((1000 + i) if i is not None else None, t) for i, t in ODD]
    got = substring.remove_repeats(frame(spark, rows), window=window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_repeats(rows, window)
    for r in got:
        assert r.n_removed == sum(s["stop"] - s["start"] for s in r.spans)


def test_automaton():
    rng = np.random.default_rng(1)
    for _ in range(60):
        texts = [rng.integers(0, 3, rng.integers(0, 12)).tolist() for _ in range(3)]
        a = substring.SuffixAutomaton()
        for t in texts:
            a.add(t)
        query = rng.integers(0, 3, 15).tolist()
        subs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [max([0, *(n for n in range(1, e + 2) if tuple(query[e + 1 - n : e + 1]) in subs)]) for e in range(len(query))]
        assert a.matching_statistics(query) == want


def brute_print(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits):
    parent = {i: i for i, _ in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, f) in enumerate(prints):
        for j, g in prints[:a]:
            if (f ^ g).bit_count() <= bits and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in parent}


def test_simhash(spark, tiny, monkeypatch):
    rows = [r for r in documents(spark, tiny) if r[0] < 120] + [(1000 + i, t) for i, t in ODD if i and i != 11] + [(2000 + i, f"{' '.join(LOREM[:200])} tail{i}") for i in range(40)]
    prints = [(i, brute_print(t)) for i, t in rows]
    want = brute_components(prints, 3)
    for size in (1024, 8):
        monkeypatch.setattr(simhash, "GROUP", size)
        got = simhash.near_duplicates(frame(spark, [*rows, (None, "a b c")])).collect()
        assert {(r.doc_id, r.fp0 % (1 << 64), r.component_id) for r in got if r.doc_id is not None} == {(i, f, want[i]) for i, f in prints}
        assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert len(set(want.values())) < len(want) - 40


def test_deletion_variants_find_all(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 1 << 63, 20)]
    near = [x ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for x in base]
    vals = [x - (1 << 64) if x >> 63 else x for x in base + near]
    links = simhash.near_links(spark.createDataFrame(list(enumerate(vals)), "node long, fp0 long"), 1, 3)
    assert {(r.a, r.b) for r in links.collect()} == {(i, i + 20) for i in range(20)}


DOC_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items, window):
    low = lambda t: DOC_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    where = defaultdict(set)
    for i, t in items:
        w = low(t)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            where[tuple(w[p : p + n])].add(i)
    widths = {len(k) for k in where}
    out = []
    for i, t in docs:
        w = low(t)
        hit, found = [False] * len(w), set()
        for n in widths:
            for p in range(len(w) - n + 1):
                if k := where.get(tuple(w[p : p + n])):
                    found |= k
                    hit[p : p + n] = [True] * n
        ids = sorted(map(str, found))
        out.append((i, len(w), sum(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


def test_decontamination(spark, tiny, monkeypatch):
    items = [(r.item_id, r.text) for r in read_table(spark, tiny, "benchmark").collect()]
    items += [(9001, "Tiny-item, three"), (9002, None), (9003, " ".join(LOREM[30:70])), (9004, " ".join(LOREM[50:61])), (9003, "dup id text"), (9005, "same " * 14), (9006, "")]
    docs = documents(spark, tiny) + ODD + [(77, "A TINY item; three B"), (78, "dup id text dup id text")]
    want = brute_hits(docs, items, 10)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 4000):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        got = decontam.contamination(frame(spark, docs), bench).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == want
    four = {m["item_id"]: m["length"] for r in got if r.doc_id == 4 for m in r.matches}
    assert four == {"9003": 40, "9004": 11}
    kept = decontam.clean(frame(spark, docs), bench)
    assert kept.columns == ["doc_id", "text", "owner", "spans"] and kept.count() == sum(not w[5] for w in want)
    assert decontam.contamination(frame(spark, docs).limit(0), bench).count() == 0
    assert not decontam.contamination(frame(spark, docs), bench.limit(0)).where("contaminated").count()


def test_longest_matches_of_windows_that_repeat():
    """Against a table of all pairs of places; what is held does not grow with their number."""
    rng = np.random.default_rng(4)
    items = [("a", b"x " * 14), ("b", b" ".join(b"uv"[i : i + 1] for i in rng.integers(0, 2, 60))), ("c", b"u v"), ("a", b"v " * 11)]
    tests = decontam.TestSuffixes(items, 4)
    docs = [[b"xuv"[i : i + 1] for i in rng.integers(0, 3, 80)] for _ in range(6)] + [[b"x"] * 40, [b"u", b"v"] * 20]
    spans, matches = [[] for _ in docs], [[] for _ in docs]
    decontam._search(tests, docs, spans, matches)
    for d, own in zip(docs, matches):
        want = {}
        for name, text in items:
            t = text.split()
            run = {}
            for p in range(len(d)):
                fresh = {}
                for q in range(len(t)):
                    if d[p] == t[q]:
                        n = fresh[q] = run.get(q - 1, 0) + 1
                        if n >= min(4, len(t)) and n > want.get(name, (0,))[0]:
                            want[name] = (n, p - n + 1)
                run = fresh
        assert {m["item_id"]: m["length"] for m in own} == {k: v[0] for k, v in want.items()}
        for m in own:
            assert any(d[m["doc_word"] :][: m["length"]] == t.split()[m["item_word"] :][: m["length"]] for k, t in items if k == m["item_id"])


def test_decontamination_of_a_long_repeat_takes_little_memory():
    import subprocess
    import sys

    code = """
import resource
from graphloom.llm import decontam
tests = decontam.TestSuffixes([("a", b"same " * 2000)], 10)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
spans, matches = [[]], [[]]
decontam._search(tests, [[b"same"] * 20000], spans, matches)
assert matches[0][0]["length"] == 2000 and spans[0] == [(0, 20000)]
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_packing(spark, tiny):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path())
    docs = documents(spark, tiny) + [(5000 + k, x) for k, (_, x) in enumerate(ODD)] + [(6000, "Ünïcode spaces and <|endoftext|> İstanbul ΣΑΣ é don't 12345")]
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in docs}
    got = packing.pack(frame(spark, docs), queries.vocabulary_path()).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids == own and r.length == len(own) > 0
        assert r.ids_crc32 == zlib.crc32(np.array(own, dtype="<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_length))
    for i in ids:
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(ids[i])
    for s in sequences.values():
        at = 0
        for offset, length, total in sorted(s):
            assert offset == at
            at += length
        assert at == total and at <= 2048 and at & (at - 1) == 0
    assert sum(sum(x[1] for x in s) == 2048 for s in sequences.values()) > 0.9 * sum(map(len, ids.values())) / 2048 - 8
    # documents that fit a sequence stay whole, but for those that fill what others leave
    fit = [i for i in ids if len(ids[i]) <= 2048]
    assert sum(len(pieces[i]) > 1 for i in fit) < 0.1 * len(fit)
    assert packing.pack(frame(spark, docs).limit(0), queries.vocabulary_path()).count() == 0


@pytest.mark.parametrize("with_ids", [True, False])
def test_harmonic_bins(with_ids):
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 9, int(n)).astype(np.uint32) for n in np.r_[rng.integers(1, 90, 400), rng.integers(1, 1500, 150), 5000, 2048, 1, 4096]]
    bins = packing.HarmonicBins(2048, 7 << 40, with_ids)
    sent, most = [], 0
    for i, ids in enumerate(docs):
        bins.add(i, ids)
        assert all(len(held) < k and all(2048 // (k + 1) < len(p.ids) <= 2048 // k for p in held) for k, held in bins.open.items())
        most = max(most, len(bins.waiting))
        sent.append(bins.sent())
    for _ in bins.finish():
        sent.append(bins.sent())
    rows = [r for b in sent for r in b.to_pylist()]
    assert most <= packing.WAITING and sum(r["length"] for r in rows) == sum(map(len, docs))
    for i, ids in enumerate(docs):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]]
        if with_ids:
            assert [x for r in own for x in r["ids"]] == ids.tolist()
    assert all(r["sequence_length"].bit_count() == 1 for r in rows)


def test_encoder_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 50_000)
    encoder, whole = packing.Encoder(queries.vocabulary_path(), 1), packing.Encoder(queries.vocabulary_path(), 1)
    for k in range(60):
        text = " ".join(f"word{k * 100 + i}x" for i in range(150)).encode()
        assert encoder.encode([text])[0].tolist() == whole.tokenizer.encode(text.decode(), add_special_tokens=False).ids + [1]
        assert encoder.held < 120_000


def test_empty_tables(spark):
    none = frame(spark, ODD).limit(0)
    assert substring.remove_repeats(none, window=50).count() == 0
    assert simhash.near_duplicates(none, n_words=3, blocks=1, max_bits=3).count() == 0


def test_encoder_of_capitals_with_marks():
    encoder = packing.Encoder(queries.vocabulary_path(), 1)
    for text in ("J\u030c H\u0331x T\u0308 W\u030a Y\u030a I\u0307 A\u030a", "DER Fluß, Straße. ÉCOLE Ecole, ecole.", "<|ENDOFTEXT|> <|endoftext|> Word, WORD. A. b", "plain ASCII Words, and END."):
        assert encoder.encode([text.encode()])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_sharding(spark, tiny):
    docs = documents(spark, tiny) + [(7000 + i, "hot text " * 40) for i in range(150)] + [(None, None), (None, "a"), (9000, None)]
    got = sharding.kd_shards(frame(spark, docs), 8).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for i, t in docs), key=str)
    size, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[r.text_crc32].add(r.shard)
    assert set(size) == set(range(8))
    assert max(size.values()) - min(size.values()) <= 3 * max(r.size for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(h) > 1 for h in homes.values()) <= 4
    assert sharding.kd_shards(frame(spark, docs).limit(0), 8).count() == 0


def plain_kd(rows, dimensions, first, count, out):
    """The same tree by plain recursion: rows are (key, size, coordinates by name)."""
    if not rows:
        return
    if count == 1:
        out.update({key: first for key, _, _ in rows})
        return
    n_left = count // 2
    by = max(dimensions, key=lambda d: max(r[2][d] for r in rows) - min(r[2][d] for r in rows))
    goal = total = sum(r[1] for r in rows) * n_left / count
    inside, cuts = rows, []
    for at in (by, "tie_text", "tie_id", None):
        if at is None or len(inside) == 1 and cuts or (at == "tie_id" and sum(r[1] for r in inside) <= sharding.SLACK * total):
            cuts[-1][1] += 2 * goal >= sum(r[1] for r in inside)  # all rows of the last value go to the nearer side
            break
        values = sorted({r[2][at] for r in inside})
        for v in values:
            own = [r for r in inside if r[2][at] == v]
            if goal < sum(r[1] for r in own) or v == values[-1]:
                break
            goal -= sum(r[1] for r in own)
        inside = own
        cuts.append([at, v])

    def left(c):
        for at, v in cuts:
            if c[at] != v:
                return c[at] < v
        return False

    plain_kd([r for r in rows if left(r[2])], dimensions, first, n_left, out)
    plain_kd([r for r in rows if not left(r[2])], dimensions, first + n_left, count - n_left, out)


def test_kd_tree_equals_plain_recursion(spark):
    rng = np.random.default_rng(8)
    for shards, values in ((8, 1 << 24), (5, 6), (11, 300)):
        rows = [(i, int(rng.integers(16, 4000)), *(int(v) for v in rng.integers(0, values, 3)), int(rng.integers(0, 40)), int(rng.integers(0, 1 << 24))) for i in range(600)]
        names = ["a", "b", "c", "tie_text", "tie_id"]
        df = spark.createDataFrame(rows, "key long, size long, a int, b int, c int, tie_text int, tie_id int")
        out = {}
        plain_kd([(r[0], r[1], dict(zip(names, r[2:], strict=True))) for r in rows], ["a", "b", "c"], 0, shards, out)
        got = {r.key: r.shard for r in sharding.kd_assign(df, ["a", "b", "c"], shards).collect()}
        assert got == out and set(got.values()) == set(range(shards))


def test_sharding_by_language_and_source(spark):
    rng = np.random.default_rng(4)
    langs, sources = ["en", "de", "fr", None], [f"s{i}" for i in range(9)] + [None]
    rows = [(i, " ".join(rng.choice(LOREM, int(rng.integers(5, 300)))), langs[int(rng.choice(4, p=[0.5, 0.3, 0.15, 0.05]))], str(rng.choice(sources)) if i % 7 else None) for i in range(1500)]
    rows += [(5000 + i, rows[i % 50][1], "zz", "other") for i in range(200)] + [(None, None, None, None), (8000, "", "", ""), (8001, None, "en", "s1")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, size string").repartition(6)
    got = sharding.kd_shards(frame, 8).collect()
    size, langs_of, homes = defaultdict(int), defaultdict(set), defaultdict(set)
    lang = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 1500}
    for r in got:
        size[r.shard] += r.size
        if r.doc_id in lang:
            langs_of[r.shard].add(lang[r.doc_id])
        if r.text_crc32:
            homes[r.text_crc32].add(r.shard)
    assert len(got) == len(rows) and set(size) == set(range(8))
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in got)
    # copies with another language and source stay with the text they copy
    assert sum(len(h) > 1 for h in homes.values()) <= 4
    # equal metadata, or none at all, leave length and script to decide
    same = sharding.kd_shards(frame.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string")}), 4).collect()
    assert len(same) == len(rows) and {r.shard for r in same} == set(range(4))
    weights = sharding._ranked_names(spark.createDataFrame([("a", 50), ("b", 30), (None, 20)], "d string, size long"), ["d"])
    assert sorted(r.d for r in weights.collect()) == [int(x * sharding.TOP) for x in (0.25, 0.65, 0.9)]
