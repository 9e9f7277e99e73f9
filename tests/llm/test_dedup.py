"""Near-duplicates, repeated passages and embeddings against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorusframe.llm import embedding_dedup, minhash, nearest, substrings
from chorusframe.llm.common import Scratch
from chorusframe.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS)


def words(rng, n, vocab=2000):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def sets(texts, k):
    out = []
    for i, t in texts:
        w = (t or "").encode().lower().split()
        out.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    return out


def brute_components(texts, k, pct):
    s = sets(texts, k)
    parent = {n: n for n in range(len(s))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            if s[a][1] and s[b][1]:
                n = len(s[a][1] & s[b][1])
                if 100 * n >= pct * (len(s[a][1]) + len(s[b][1]) - n):
                    parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(s):
        least[find(n)] = min(least.get(find(n), i), i)
    return sorted((i, len(x), least[find(n)] if x else i) for n, (i, x) in enumerate(s))


@pytest.fixture(scope="module")
def family():
    rng = random.Random(4)
    texts, base = [], words(rng, 150)
    for i in range(60):  # a family of copies with a few words changed, and its like
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        texts.append((100 - i, " ".join(w)))
    texts += [(200 + i, " ".join(words(rng, rng.randrange(1, 80)))) for i in range(60)]
    texts += [(300, texts[70][1]), (301, texts[70][1].upper()), (302, "a b"), (303, " A\tB "), (304, "a"), (305, ""), (306, None), (307, "  "), (308, "a b c")]
    texts.append((309, " ".join(words(rng, 20000, 50))))
    return texts


@pytest.mark.parametrize(("k", "pct"), [(3, 85), (5, 80)])
def test_components_match_brute_force(spark, family, k, pct, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)  # so that the family spans blocks
    monkeypatch.setattr(minhash, "TASK_SHINGLES", 600)  # and its meetings several tasks
    got = minhash.near_duplicates(docs(spark, family).repartition(3), k, pct)
    rows = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect())
    assert rows == brute_components(family, k, pct)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


@pytest.mark.parametrize("dense", [0, 10**9])
def test_pairs_are_decided_on_full_sets(dense, monkeypatch):
    monkeypatch.setattr(minhash, "DENSE", dense)  # by looking up, or by products
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    own = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 20_000), replace=False), rng.integers(0, 2**63, 9, dtype=np.uint64)])) for _ in range(20)]
    own.append(own[3])
    pairs = [(i, j) for i in range(21) for j in range(i + 1, 21) if (i, j) != (2, 5)]
    a, b = np.array(pairs).T
    sizes = np.array([len(x) for x in own])
    both = [len(np.intersect1d(own[i], own[j])) for i, j in pairs]
    assert minhash._intersections(own, sizes, a, b).tolist() == both
    want = [100 * n >= 60 * (sizes[i] + sizes[j] - n) for n, (i, j) in zip(both, pairs, strict=True)]
    assert minhash._linked(own, a, b, 60).tolist() == want and 0 < sum(want) < len(want)


def test_dedup_keeps_one_of_each_and_repeated_rows(spark, family):
    rows = docs(spark, [*family, (None, "n1 n2 n3 n4 n5 n6"), (100, family[0][1])])
    kept = minhash.deduplicate(rows)
    assert kept.columns == rows.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {c for _, n, c in brute_components(family, 5, 80)}
    assert set(ids) == want | {None} and len(ids) == len(set(ids))


def test_empty_tables(spark):
    none = docs(spark, [(0, "a")]).where(F.lit(False))
    assert minhash.near_duplicates(none).count() == 0
    assert substrings.repeated_passages(none).count() == 0
    vec = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert embedding_dedup.near_duplicates(vec).count() == 0
    assert nearest.search(vec, vec).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5000, 5000)]
    tmp = Scratch(spark)
    got = {r["node"]: r["root"] for r in components(spark, spark.createDataFrame(edges, "a bigint, b bigint"), tmp).collect()}
    assert got == {i: 0 for i in range(101)} | {1000 + i: 1000 for i in range(60)}


def brute_passages(texts, w):
    tokens = [(i, (t or "").encode().split()) for i, t in texts]
    seen = collections.Counter(tuple(x[j : j + w]) for _, x in tokens for j in range(len(x) - w + 1))
    out = []
    for i, x in tokens:
        gone = [False] * len(x)
        for j in range(len(x) - w + 1):
            if seen[tuple(x[j : j + w])] > 1:
                gone[j : j + w] = [True] * w
        left = [t for t, g in zip(x, gone, strict=True) if not g]
        out.append((i, len(x), len(x) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=str)


def test_passages_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "P_BYTES", 4096)
    monkeypatch.setattr(substrings, "R_BYTES", 8192)
    rng = random.Random(7)
    shared = [words(rng, n) for n in (34, 35, 36, 60, 200)]
    texts = []
    for i in range(60):
        w = words(rng, rng.randrange(0, 120))
        for p in rng.sample(shared, rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[rng.randrange(3) : len(p) - rng.randrange(3)]
        texts.append((i, "\n ".join(w)))
    texts += [(90, "x " * 100), (91, None), (92, ""), (93, texts[5][1]), (94, texts[5][1]), (94, texts[5][1])]
    got = substrings.repeated_passages(docs(spark, texts).repartition(5), 35)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()), key=str) == brute_passages(texts, 35)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_cover_has_every_difference():
    c, v = substrings.COVER, substrings.PERIOD
    assert {(a - b) % v for a in c for b in c} == set(range(v))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 32))
    rows = [(i, (base[i % 40] + rng.standard_normal(32) * rng.choice([0.05, 0.2, 0.4])).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(30)] + [(500, None), (501, [0.0] * 32), (502, [float("nan")] + [1.0] * 31), (503, [None] + [1.0] * 31), (504, [float("inf")] + [1.0] * 31), (505, []), (506, [1.0, 0.0])]
    return rows


def usable(vectors):
    return [(i, np.array(v, float)) for i, v in vectors if v and len(v) == 32 and all(x is not None and np.isfinite(x) for x in v) and any(v)]


def test_embedding_links_match_brute_force(spark, vectors, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    good = usable(vectors)
    m = np.stack([v for _, v in good])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    ids = np.array([i for i, _ in good])
    comp = ids.copy()
    while True:
        new = np.array([min([comp[a], *comp[link[a]]]) for a in range(len(ids))])
        if (new == comp).all():
            break
        comp = new
    want = {int(i): (int(link[a].sum()), int(comp[a]), bool(i == comp[a])) for a, i in enumerate(ids)}
    want |= {i: (0, i, True) for i, _ in vectors if i not in want}
    assert got == want


def test_search_matches_brute_force(spark, vectors, monkeypatch):
    monkeypatch.setattr(nearest, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 8)
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    got = collections.defaultdict(list)
    for r in nearest.search(df.where("vec_id % 10 = 0"), df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    good = usable(vectors)
    for q, v in good:
        if q % 10 == 0:
            s = sorted(((-float(v @ c / np.linalg.norm(v) / np.linalg.norm(c)), i) for i, c in good if i != q))[:5]
            assert [x for _, x in got[q]] == pytest.approx([-a for a, _ in s], abs=1e-12)
            assert len(set(i for i, _ in got[q]) & {i for _, i in s}) >= 4 or s[0][0] == s[4][0]
