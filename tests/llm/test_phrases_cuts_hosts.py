"""Fill-in-the-middle, collocations and host rules against plain Python."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorusframe.llm import collocations, fim, host_rules

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = ", `n` string, `form` string, `host` string, `phrase` string, `a.b` string"  # names that the operators use themselves


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 0, "x", "x", "x", "x", "x") for i, t, lang, src in rows], DOCS + ODD)


# fill-in-the-middle


def plain_cut(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def test_cuts_match_brute_force_and_restore(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab é😀\n<P>SḾ") for _ in range(rng.randint(0, 60))), None, None) for i in range(400)]
    rows += [(400, None, "en", "s"), (401, "", "en", "s"), (None, "null id", None, None), (7, "again", None, None), (7, "again", None, None)]
    rows += [(402, "x<M>y", None, None), (403, "<P", None, None), (404, "<S<S><", None, None), (405, "é😀 ab\r\n" * 30_000, None, None)]
    docs = frame(spark, rows)
    out = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(str((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in out) == sorted(str((i, *plain_cut(i, t))) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["back"]) for r in out) == sorted((str(i), t or "") for i, t, *_ in rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_long_texts_are_matched_in_blocks(monkeypatch):
    import regex

    monkeypatch.setattr(fim, "BLOCK", 7)
    for unit, text in ((fim.CODE_POINT, "aé😀\n" * 9), (fim.GRAPHEME, "éa" * 20), (fim.WORD_AND_SPACE, "ab  cd e\n" * 8)):
        assert fim.unit_ends(regex.compile(unit), text) == regex.fullmatch(unit, text).ends(1)
    assert fim.unit_ends(regex.compile("(a)*"), "a" * 20 + "b") is None


def test_a_text_of_more_units_than_the_library_holds_at_once():
    import regex

    ends = fim.unit_ends(regex.compile(fim.CODE_POINT), "abcé" * 2_250_000)
    assert ends == list(range(1, 9_000_001))


def test_other_units(spark):
    text = "one two  three\nfour "
    docs = frame(spark, [(i, text, None, None) for i in range(60)] + [(100, " \n", None, None)])
    for r in fim.fill_in_middle(docs, unit=fim.WORD_AND_SPACE).collect():
        if r["doc_id"] == 100:
            assert (r["n"], r["form"], r["output"]) == (None, "plain", " \n")
            continue
        assert r["n"] == 4
        if r["form"] != "plain":
            assert {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= {0, 3, 7, 14, 20}
    for bad in ("(a?)*", "a*", "(a)+", "((a)b)*"):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, unit=bad)


# collocations


def plain_counts(rows):
    f, n = collections.Counter(), collections.Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    return f, n


def plain_collocations(rows, least, top):
    f, n = plain_counts(rows)
    found = collections.defaultdict(list)
    often = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    for (lang, p), a in often.items():
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(t == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for (t, q), b in often.items())
        if not inside:
            found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, all_ in found.items() for i, (s, a, p, x, y) in enumerate(sorted(all_)[:top]))


def some_texts(seed, n, vocabulary):
    rng = random.Random(seed)
    fixed = ["new york city hall", "ad hoc", "a b c d e"]
    word = lambda: rng.choice(fixed) if rng.random() < 0.2 else rng.choice(vocabulary)
    return ["".join(word() + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "\r", "\x0b", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


VOCABULARY = ["The", "of", "é", "É", "und", "x y", "<", "\x00", "#1", "日本", "ad", "hoc", "a"]


def test_collocations_match_brute_force(spark):
    texts = some_texts(5, 300, VOCABULARY)
    rows = [(i, t, ("en", "de", None, "und", "")[i % 5], "s") for i, t in enumerate(texts)]
    rows += [(900, None, "en", None), (901, "", "en", None), (902, "only here", "xx", None), (903, "go go go go " * 4000, "fr", None), (None, "x y " * 40, "fr", None), (None, "x y " * 40, "fr", None)]
    docs = frame(spark, rows)
    for least, top in ((30, 2000), (8, 20)):
        got = sorted(tuple(r) for r in collocations.collocations(docs, min_count=least, top=top).collect())
        assert got == plain_collocations(rows, least, top)
    assert collocations.collocations(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("burst", "capacity", "step"), [(2, 20, 5), (1, 1, 1), (100, 10_000, 64)])
def test_spilled_runs_add_up_and_are_sorted(monkeypatch, burst, capacity, step):
    for name, v in (("BURST", burst), ("CAPACITY", capacity), ("STEP", step)):
        monkeypatch.setattr(collocations, name, v)
    texts = some_texts(6, 40, VOCABULARY)
    for lengths in ((1,), (2,), (3, 4)):
        task, got = collocations.Counts(None, None, lengths), collections.Counter()
        batches = [b for t in texts for b in task.add(b"en", t.encode())] + list(task.spill(0))
        assert capacity == 10_000 or len(batches) > 10
        for b in batches:
            phrases = [tuple(p.split(" ")) for p in b.column("phrase").to_pylist()]
            for first in {p[0] for p in phrases}:
                run = [tuple(w.encode() for w in p) for p in phrases if p[0] == first]
                assert run == sorted(run)
            got.update(dict(zip(phrases, b.column("n").to_pylist(), strict=True)))
        f, _ = plain_counts([(0, t, "en", None) for t in texts])
        assert got == {p: a for (_, p), a in f.items() if len(p) in lengths}


def test_filters_never_reject_what_they_hold():
    h = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    bits = np.zeros(1 << 10, np.uint64)
    for at in collocations.Filter.places(h[:2000], 1 << 16):
        np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    found = collocations.Filter(bits).has(h)
    assert found[:2000].all() and found[2000:].mean() < 0.02


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3 * 10**18 + 1
    rows = [("en", "a b", big), ("en", "a", big + 1), ("en", "b", big + 4), ("en", "a b c", big - 7), ("en", "c", big), ("en", "b c", big - 5)]
    got = {r["phrase"]: r["score"] for r in collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, n bigint")).collect()}
    assert got == {"a b": 2000000 * big // (2 * big + 5), "b c": 2000000 * (big - 5) // (2 * big + 4), "a b c": 2000000 * (big - 7) // max(2 * big - 4, 2 * big)}


# host rules


def plain_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    again = sum(any(tri[tuple(w[j : j + 3])] > 1 for j in range(max(i - 2, 0), i + 1) if j + 3 <= len(w)) for i in range(len(w)))
    seen, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, again, len(seen) + dup


def plain_hosts(rows):
    from types import SimpleNamespace as S

    tests = {"few_words": lambda c: c.w < 50, "repeats": lambda c: 100 * c.r > 50 * c.w, "symbols": lambda c: 10 * c.s > c.w, "word_length": lambda c: c.ch > 12 * c.w or c.ch < 2 * c.w, "lines": lambda c: 2 * c.d > c.n}
    each = [(h, S(**dict(zip(("w", "ch", "s", "d", "r", "n"), plain_rules(t), strict=True)))) for _, t, _, h in rows]
    by = collections.defaultdict(list)
    for h, c in each:
        if h is not None:
            by[h].append(c)
    bad = set()
    for test in tests.values():
        k, n = {h: sum(map(test, c)) for h, c in by.items()}, {h: len(c) for h, c in by.items()}
        all_n, hosts = sum(n.values()), len(n)
        m = sum(k.values()) / all_n
        rho = 0.0
        whole = all_n - sum(x * x for x in n.values()) / all_n - (hosts - 1)
        if 0 < m < 1 and whole > 0:
            rho = (sum(n[h] * (k[h] / n[h] - m) ** 2 for h in n) / (m * (1 - m)) - (hosts - 1)) / whole
        strength = 1 / min(max(rho, 1e-6), 0.999) - 1
        bad |= {h for h in n if (rate := (k[h] + m * strength) / (n[h] + strength)) > 0.5 and rate > 2 * m}
    return bad, sorted(str((i, *plain_rules(t)[:5], base, h in bad, not (base or h in bad))) for (i, t, _, h), (_, c) in zip(rows, each, strict=True) for base in [tests["few_words"](c) or tests["repeats"](c)])


def test_host_rules_match_brute_force(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "héllo", "of", "in"]) + str(rng.randint(0, 99)) for _ in range(80))
    junk = lambda: rng.choice(["a b c " * 40, "short", "# $ x " * 30 + good(), "same line\n" * 30 + good(), "\n \n"])
    rows = [(i, good() if rng.random() < 0.9 else junk(), "en", f"h{i % 7}") for i in range(300)]
    rows += [(1000 + i, good() if i % 10 == 0 else "* # " + "%& |<> " * 20 + good(), "en", "bad") for i in range(60)]
    rows += [(2000 + i, good() if i % 2 else junk(), "en", None) for i in range(10)] + [(3000 + i, junk(), "en", f"one{i}") for i in range(3)]
    rows += [(5000, None, None, "h1"), (5001, "", None, "h1"), (5002, "x " * 50_000, None, "h1"), (None, good(), None, "h2"), (7, good(), None, "h2"), (7, good(), None, "h2")]
    docs = frame(spark, rows)
    bad, expected = plain_hosts(rows)
    assert "bad" in bad and not bad & {f"h{i}" for i in range(7)}
    out = host_rules.host_rules(docs)
    got = out.select("doc_id", *host_rules.COUNTS[:5], "base_failed", "host_rejected", "kept").collect()
    assert sorted(str(tuple(r)) for r in got) == expected
    clean = host_rules.kept_documents(docs.where("doc_id IS NOT NULL AND doc_id <> 7"))
    assert clean.columns == docs.columns and clean.where("source = 'bad'").count() == 0 and clean.count() == sum(r["kept"] for r in got if r["doc_id"] not in (None, 7))
    assert host_rules.host_rules(docs.limit(0)).count() == 0


def test_one_host_is_never_rejected(spark):
    docs = frame(spark, [(i, "few words" if i % 4 else "w " + " ".join(f"w{k}" for k in range(70)), "en", "only") for i in range(40)])
    assert host_rules.host_rules(docs).where("host_rejected").count() == 0
