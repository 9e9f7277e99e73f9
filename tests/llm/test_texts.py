"""PII, quality, mixing, packing, archives and URL rules against plain Python."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorusframe.llm import mixing, packing, pii, quality, url_filter, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP, CARD, PHONE = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), m.end(), 2) for m in CARD.finditer(t) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(t) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_patterns_on_random_text():
    rng = random.Random(3)
    for _ in range(20000):
        t = "".join(rng.choice("ab1.@-+ 2()%é@.4") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t), t


@pytest.mark.parametrize("unit", ["a", "1", "1.", "a@", "+1", "1 ", "256.", "(at)", "a.", "+1(", "é1"])
def test_long_runs_are_linear(unit):
    def seconds(n):
        text, best = unit * (n // len(unit)), 9e9
        for _ in range(2):
            t = time.perf_counter()
            base, more = pii.candidates(text)
            for s in base + more:
                pii.traits(text, *s)
            best = min(best, time.perf_counter() - t)
        return best

    few, many = seconds(60_000), seconds(240_000)
    assert many < 2 and (many < 0.1 or many < 9 * few), (few, many)


def test_spans_stay_and_cards_in_failing_runs_are_added(spark):
    card = "4111111111111111"
    rows = [(i, f"call +1 (555) 555-01{i % 90 + 10} or card {card} now", "en", "s", 0) for i in range(40)]
    rows += [(100, f"x {card} {card} y", "en", "s", 0), (101, None, "en", "s", 0), (102, "", "en", "s", 0)]
    got = {r["doc_id"]: r for r in pii.find_spans(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t, *_ in rows:
        assert [(s["start"], s["end"], s["kind"]) for s in got[i]["base"]] == plain_spans(t or "")
        assert {tuple(s) for s in got[i]["base"]} <= {tuple(s) for s in got[i]["spans"]}
    assert [(s["start"], s["end"]) for s in got[100]["spans"]] == [(2, 18), (19, 35)]


def brute_spans(texts, share, at_least):
    """The whole operator on plain Python objects: every span a row of its own, nothing counted by pattern."""
    base, more = [], []
    for t in texts:
        b = plain_spans(t)
        taken, extra = list(b), []
        for name, pattern in pii._LOOSE:
            for m in pattern.finditer(t):
                if all(m.end() <= x or m.start() >= y for x, y, _ in taken):
                    extra.append((m.start(), m.end(), pii.KINDS.index(name)))
                    taken.append(extra[-1])
        base.append(b)
        more.append(sorted(extra))
    seen = [(k, *pii.traits(t, x, y, k)) for t, b in zip(texts, base, strict=True) for x, y, k in b]
    whole = collections.Counter(k for k, *_ in seen)
    entries = {e for e, n in collections.Counter((k, e) for k, e, *_ in seen).items() if n >= max(share * whole[e[0]], pii.FEW)}
    front = collections.Counter((k, w) for k, _, words, _ in seen for w in set(words))
    listed = {(k, w) for (k, w), n in front.items() if n >= max(share * whole[k], pii.FEW) and n / whole[k] >= pii.LIFT * sum(front[(j, w)] for j in whole if j != k) / max(len(seen) - whole[k], 1)}
    code = lambda t, x: pii.votes(x[2], *pii.traits(t, *x), (entries, listed))
    rows = [pii._unpacked(code(t, x)) for t, b, m in zip(texts, base, more, strict=True) for x in b + m]
    p = [min(max(0.5 + 0.4 * sum(v - 1 for v in vote) / 5, 0.05), 0.95) for _, vote, _ in rows]
    for _ in range(50):
        new = list(p)
        for k in range(4):
            mine = [i for i, r in enumerate(rows) if r[0] == k]
            yes, no = sum(p[i] for i in mine), sum(1 - p[i] for i in mine)
            chance = {}
            for j in range(5):
                for v in range(3):
                    chance[1, j, v] = (sum(p[i] for i in mine if rows[i][1][j] == v) + 1) / (yes + 3)
                    chance[0, j, v] = (sum(1 - p[i] for i in mine if rows[i][1][j] == v) + 1) / (no + 3)
            for i in mine:
                a, b = (yes + 1) / (len(mine) + 2), (no + 1) / (len(mine) + 2)
                for j, v in enumerate(rows[i][1]):
                    a, b = a * chance[1, j, v], b * chance[0, j, v]
                new[i] = a / (a + b)
        p = new
    x = np.zeros((len(rows), 4 + 15 + 16 + 4 + 16))
    for i, (k, vote, shape) in enumerate(rows):
        x[i, [k, *(4 + 3 * j + v for j, v in enumerate(vote)), 19 + shape // 64, 35 + shape // 16 % 4, 39 + shape % 16]] = 1
    w = np.zeros(x.shape[1])
    for _ in range(100):
        q = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x / len(x) + 1e-3 * np.eye(len(w)), x.T @ (q - p) / len(x) + 1e-3 * w)
    q, at, out = 1 / (1 + np.exp(-x @ w)), 0, []
    for b, m in zip(base, more, strict=True):
        at += len(b)
        out.append(sorted(b + [s for i, s in enumerate(m) if q[at + i] >= at_least], key=lambda s: (s[0], s[2])))
        at += len(m)
    return base, out


def planted(rng, n=400):
    """Texts with personal data that only the looser patterns find (returned as spans), and with numbers that look like it."""
    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return d + next(c for c in "0123456789" if pii.luhn(d + c))

    texts, want = [], []
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    for i in range(n):
        kind = i % 8
        if kind == 0:
            t, s = f"please call ({rng.randint(201, 989)}) {rng.randint(201, 989)}-{digits(4)} today", 12
        elif kind == 1:
            t, s = f"our phone {rng.randint(201, 989)}-{rng.randint(201, 989)}-{digits(4)} rings", 10
        elif kind == 2:
            t, s = f"credit card {card()} {card()} given", 12
        elif kind == 3:
            t, s = f"contact ann{i % 50} (at) example{i % 3} (dot) com soon", 8
        elif kind == 4:
            t, s = f"write to ann{i % 50}@example{i % 3}.com or call +1 {rng.randint(201, 989)} {rng.randint(201, 989)} {digits(4)}, card {card()}, login 93.184.{rng.randint(1, 255)}.{rng.randint(1, 255)} now", None
        elif kind == 5:
            t, s = f"order {digits(16)} section id {digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}", None
        elif kind == 6:
            t, s = f'token="000-000-0000" isbn {digits(3)}.{digits(3)}.{digits(4)}x', None
        else:
            t, s = f"version {rng.randint(300, 999)}.{rng.randint(300, 999)}.{rng.randint(300, 999)}.{rng.randint(300, 999)} released", None
        texts.append(t)
        want.append(s)
    return texts, want


def test_added_spans_match_brute_force_and_are_right(spark):
    texts, want = planted(random.Random(8))
    texts += ["", "no data here", "x" * 50]
    want += [None] * 3
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(9999, None, "en", "s", 0)], DOCS).repartition(5)
    got = {r["doc_id"]: r for r in pii.find_spans(docs).collect()}
    base, spans = brute_spans(texts, pii.SHARE, pii.ACCEPT)
    right = wrong = missed = 0
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i]["base"]] == base[i] == plain_spans(t)
        assert [tuple(s) for s in got[i]["spans"]] == spans[i], t
        added = [tuple(s) for s in got[i]["spans"] if tuple(s) not in base[i]]
        hit = want[i] is not None and any(s[0] == want[i] for s in added)
        right, wrong, missed = right + hit, wrong + (want[i] is None) * len(added), missed + (want[i] is not None and not hit)
    assert got[9999]["base"] == got[9999]["spans"] == []
    assert right / (right + missed) > 0.9 and right / (right + wrong) > 0.9, (right, wrong, missed)
    assert pii.find_spans(docs.where("doc_id < 0")).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.de, now", "en", "s", 0), (2, None, "en", "s", 0)], DOCS)
    assert [r["text"] for r in pii.redact(df).orderBy("doc_id").collect()] == ["mail [EMAIL], now", None]
    assert pii.redact(df.where("doc_id > 5")).count() == 0


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(0)
    counts, truth = collections.Counter(), collections.defaultdict(list)
    for _ in range(4000):
        y = rng.random() < 0.4
        v = [(1 if y else -1) if rng.random() < a else (-1 if y else 1) for a in (0.95, 0.9, 0.85, 0.55, 0.9)]
        code = 1
        for x in v:
            code = code * 3 + x + 1
        counts[code * pii.SHAPES] += 1
        truth[code * pii.SHAPES].append(y)
    p = pii.fit(counts)
    right = sum(sum(y == (p[c] >= 0.5) for y in ys) for c, ys in truth.items())
    assert right / 4000 > 0.97


def test_quality_held_out_accuracy(spark):
    rng = random.Random(5)
    good = lambda: " ".join("".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 9))) for _ in range(80)) + "."
    bad = lambda: " ".join("".join(rng.choice("ABCDE#$%!") for _ in range(5)) for _ in range(80))
    rows = [(i, good() if i % 3 else bad(), "en", "s", 0) for i in range(300)] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, "a b", "en", "s", 0)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) / len(held) > 0.97
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.quality(docs, flipped).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"]) for r in got)
    alone = {r["score"] for r in quality.quality(docs, labels.where("quality = 1")).collect()}
    assert len(alone) == 1 and alone.pop() > 0.98
    assert quality.quality(docs.where("doc_id > 9999"), labels).count() == 0


def test_registered_scores_match_a_plain_discriminant(spark):
    """op5 over the whole table against a discriminant that is fitted and evaluated row by row, without cached factors."""
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] in (0, 1)}
    x = {i: np.array(quality.statistics(t)) for i, t in docs.items()}
    learn = {k: np.array([x[i] for i, y in labels.items() if y == k and i in x and zlib.crc32(str(i).encode()) % 3 != 1]) for k in (0, 1)}
    d, total = len(quality.FEATURES), sum(map(len, learn.values()))
    pooled = sum(np.cov(m.T, bias=True) * len(m) for m in learn.values()) / total
    law = {}
    for k, m in learn.items():
        lean = quality.POOLED + (1 - quality.POOLED) * d / (d + len(m))
        cov = (1 - lean) * np.cov(m.T, bias=True) + lean * pooled
        cov = (1 - quality.DIAGONAL) * cov + quality.DIAGONAL * np.diag(np.diag(cov)) + quality.RIDGE * np.eye(d)
        law[k] = m.mean(axis=0), cov, np.log(len(m) / total)

    def density(v, k):
        mean, cov, prior = law[k]
        return prior - 0.5 * (np.linalg.slogdet(cov)[1] + (v - mean) @ np.linalg.solve(cov, v - mean))

    got = quality.op5(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        z = density(x[r["doc_id"]], 1) - density(x[r["doc_id"]], 0)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -700, 700))), abs=1e-6)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5)


def brute_taken(rows, weights, block_words, seed=7, total=1.5, most=2.0):
    """``source, size, hash`` of each document -> its taken words: whole passes, then blocks in permuted order until the target."""
    sizes = collections.Counter()
    for source, size, _ in rows:
        sizes[source] += size
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    aim = dict.fromkeys(names, 0.0)
    left, free = total * sum(sizes.values()), [s for s in names if sizes[s]]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    while free:
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        for s in over or free:
            aim[s] = most * sizes[s] if over else share[s]
        left -= sum(aim[s] for s in over)
        free = [s for s in free if s not in over] if over else []
    out = [0] * len(rows)
    for k, s in enumerate(names):
        mine = [i for i, r in enumerate(rows) if r[0] == s]
        n, blocks = sizes[s], max(1, -(-sizes[s] // block_words))
        passes = int(aim[s] // n) if n else 0
        room = int(aim[s]) - passes * n
        step, shift = mixing._odd_step(blocks, seed), seed * (k + 1) % blocks
        order = collections.defaultdict(list)
        for i in mine:
            order[(rows[i][2][1] % blocks * step + shift) % blocks].append(i)
        for rank in sorted(order):
            for i in sorted(order[rank], key=lambda i: (rows[i][2][0], rows[i][2][2])):
                size = rows[i][1]
                part = max(0, min(size, room))
                room -= size
                if part < size <= mixing.TOLERANCE * aim[s]:
                    part = size if 2 * part >= size else 0
                out[i] = passes * size + part
    return out, aim, sizes


def hashed(spark, docs):
    """``source, size, (hash, block hash, doc_id)`` of each document, sizes counted by Python."""
    h = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(7))
    found = docs.select("doc_id", "source", "text", h.alias("h"), F.xxhash64(h, F.lit(1)).alias("b")).collect()
    return [(r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), (r["h"], r["b"], r["doc_id"])) for r in found]


@pytest.mark.parametrize("block_words", [mixing.BLOCK_WORDS, 3000])
def test_registered_mix_matches_brute_force(spark, block_words):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = hashed(spark, docs)
    taken, aim, sizes = brute_taken(rows, (5, 2, 1), block_words)
    got = (mixing.op1(spark, "/root/testdata/sf0.001") if block_words == mixing.BLOCK_WORDS else mixing.mix_plan(docs, block_words=block_words)).collect()
    got = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for (source, size, (_, _, i)), t in zip(rows, taken, strict=True):
        r = got[i]
        assert (r["size"], r["source_size"], r["taken"]) == (size, sizes[source], t)
        assert r["target"] == pytest.approx(aim[source])


def test_targets_are_shared_again():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450, 2) == [200, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.targets([10, 1000], [5, 2], 1515, 2) == [20, 1495]
    assert mixing.targets([0, 10], [5, 2], 15, 2) == [0, 15]


def test_tree_meets_quotas_exactly():
    quotas, shards = [40, 7, 0, 123], 11
    source = np.repeat(np.arange(4), quotas)
    unit = np.concatenate([np.arange(q) for q in quotas])
    got = mixing.shard_of(source, unit, quotas, shards, 3)
    total = np.bincount(got, minlength=shards)
    assert total.sum() == 170 and total.max() - total.min() <= 1
    some = np.random.default_rng(0).permutation(170)[:50]  # any subset finds the same shards
    assert (mixing.shard_of(source[some], unit[some], quotas, shards, 3) == got[some]).all()


def test_mix_takes_its_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(60))), "en", None if i % 7 == 0 else f"s{i % 5}", 0) for i in range(400)] + [(1, "dup dup", "en", "s1", 0), (2, None, "en", "s1", 0), (3, "x " * 5000, "en", "s2", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    plan = mixing.mix_plan(docs, block_words=200, shard_blocks=4).collect()
    assert len(plan) == len(rows)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in plan:
        assert r["taken"] <= 2 * r["size"]
        b = by[r["source"]]
        b[0] += r["size"]
        b[1] += r["taken"]
        b[2] = r["target"]
    assert all(abs(k - t) <= max(1, mixing.TOLERANCE * t / 2) for _, k, t in by.values())
    assert sum(0 < p["words"] < r["size"] for r in plan for p in r["placements"]) == sum(0 < p["words"] < r["size"] and r["size"] > mixing.TOLERANCE * r["target"] for r in plan for p in r["placements"])
    want = mixing.targets([by[s][0] for s in (*sorted(x for x in by if x), None)], [5, 2, 1, 5, 2, 1], 1.5 * sum(b[0] for b in by.values()), 2)
    assert [by[s][2] for s in (*sorted(x for x in by if x), None)] == pytest.approx(want)
    mixed = mixing.mix(docs, block_words=200, shard_blocks=4)
    assert mixed.drop("_shard", "_order").columns == docs.columns
    with pytest.raises(ValueError, match="shard_col"):
        mixing.mix(docs.withColumn("_shard", F.lit(1)))
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r["taken"] for r in plan)
    assert sorted(mixed.collect(), key=str) == sorted(mixing.mix(docs.repartition(7), block_words=200, shard_blocks=4).collect(), key=str)
    assert mixing.mix_plan(docs.where("doc_id > 9999")).count() == 0


def test_packing_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "Übung", "déjà vu", "x" * 30, "12 345", "\n\n"]) for _ in range(rng.randrange(300))), "en", None if i % 9 == 0 else f"s{i % 4}", 0) for i in range(120)]
    rows += [(500, None, "en", "s0", 0), (501, "", "en", "s0", 0), (502, "a<|endoftext|>b", "en", "s1", 0), (7, rows[7][1], "en", "s3", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    slow = packing.tokenizer("byte_bpe_50k.json").slow
    pieces = packing.pack(docs).collect()
    ids = collections.Counter()
    for i, t, *_ in rows:
        ids[(i, np.array([*slow.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())] += 1
    seqs, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert zlib.crc32(bytes(p["ids"])) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append(p)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    for i, parts in by_doc.items():
        if i != 7:  # repeated rows
            whole = b"".join(bytes(p["ids"]) for p in sorted(parts, key=lambda p: p["start"]))
            assert ids[(i, whole)] == 1 and all(p["doc_tokens"] * 4 == len(whole) for p in parts)
    assert sum(p["length"] for p in pieces) == sum(len(b) // 4 * n for (_, b), n in ids.items())
    assert packing.pack(docs.where("doc_id > 9999")).count() == 0


def round_robin(sizes, weights, length):
    """Every token in the order of service, by counters that are kept round by round."""
    whole = sum(w for n, w in zip(sizes, weights, strict=True) if n and w)
    quantum = [max(1, length * 2**20 * w // whole) if n and w else 0 for n, w in zip(sizes, weights, strict=True)]
    counter, gone, out = [0] * len(sizes), [0] * len(sizes), []
    while any(q and g < n for q, g, n in zip(quantum, gone, sizes, strict=True)):
        for j, q in enumerate(quantum):
            counter[j] += q
            while counter[j] >= 2**20 and gone[j] < sizes[j]:
                out.append((j, gone[j]))
                counter[j] -= 2**20
                gone[j] += 1
    return out + [(j, k) for j, q in enumerate(quantum) if not q for k in range(sizes[j])]


@pytest.mark.parametrize(
    ("sizes", "weights"), [([6000, 3000, 900, 70], [3, 2, 1, 0]), ([5, 0, 1000, 3, 7], [5, 4, 1000, 3, 7]), ([1, 1, 1], [1, 1, 1]), ([3000, 2, 40, 9], [1, 1000, 1, 1]), ([9, 40, 200], [0, 1, 3]), ([50] * 90, list(range(90)))]
)
def test_schedule_is_deficit_round_robin(sizes, weights):
    plan = packing.Schedule(sizes, weights, 64)
    order = round_robin(sizes, weights, 64)
    count = [0] * len(sizes)
    want = [list(count)]
    for j, _ in order:
        count[j] += 1
        want.append(list(count))
    assert count == list(sizes)
    assert plan.given(range(plan.total + 1)).tolist() == want
    for w in range(plan.windows):
        a, b = want[plan.edge(w)], want[plan.edge(w + 1)]
        assert [plan.window(w, j) for j in range(len(sizes))] == [(a[j], b[j], sum(b[:j]) - sum(a[:j])) for j in range(len(sizes))]
    ends = [plan.edge(w + 1) for w in range(plan.windows)]
    for at, (j, k) in enumerate(order):
        assert plan.find(j, k) == next(w for w, e in enumerate(ends) if at < e)


def test_schedule_keeps_proportions():
    plan = packing.Schedule([6000, 3000, 900, 70], [3, 2, 1, 0], 64)
    for w in range(1, 60):  # while all three have tokens, a window is off by the fractions of the sources before
        assert all(abs(plan.window(w, j)[0] - 64 * w * x / 6) <= 3 for j, x in enumerate((3, 2, 1)))
    huge = packing.Schedule([10**13, 10**12, 5], [5, 2, 1], 2048)
    assert huge.given([10**12]).sum() == 10**12 and huge.find(0, 10**13 - 1) < huge.windows
    many = packing.Schedule([1 + i % 3000 for i in range(120_000)], [1 + i % 7 for i in range(120_000)], 2048)
    assert int(many.given([1000 * 2048]).sum()) == 1000 * 2048


@pytest.mark.parametrize("text", [" " * 2_000_000, "\t" * 2_000_000, "a" * 2_000_000, "x" + " \n" * 600_000 + "b", "and so " * 100_000 + " " * 1_100_000 + "the end " * 50_000, "word Wort 12 it's  two\n" * 60_000])
def test_long_texts_have_the_ids_of_tokenizers(text):
    t = packing.tokenizer("byte_bpe_50k.json")
    assert t.encode(text) == t.slow.encode(text, add_special_tokens=False).ids


def test_long_white_space_is_packed_and_target_weights_hold(spark):
    rows = [(1, " " * 1_200_000, "en", "a", 0), (2, "one two three " * 4000, "en", "b", 0), (3, "vier fünf " * 3000, "en", "c", 0)]
    pieces = packing.pack(spark.createDataFrame(rows, DOCS), weights=(5, 2, 1)).collect()
    assert sum(p["length"] for p in pieces if p["doc_id"] == 1) == 1_200_001
    first = collections.Counter()
    for p in pieces:
        if p["sequence_id"] < 5:
            first[p["doc_id"]] += p["length"]
    assert all(abs(first[i] - 5 * 2048 * w / 8) <= 3 for i, w in ((1, 5), (2, 2), (3, 1)))


def test_archives_round_trip(spark, tmp_path):
    big = "é" * 600 + "\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(1, "http://a/ b", big), (2, None, big), (9, "http://a", big), (3, "x", "tiny"), (4, "x", "tiny"), (5, "y", None), (None, "n", big), (6, "z", "q" * 1000), (9, "http://a", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = warc.archive_pages(pages, f"file://{tmp_path}/a").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["record_type"] == ("revisit" if r["record_id"] in (1, 2, None) else "response")
        assert r["refers_to"] == (9 if r["record_type"] == "revisit" else None)
    text = {1: big, 2: big, 9: big, 3: "tiny", 4: "tiny", 5: "", None: big, 6: "q" * 1000}
    for r in got:
        b = text[r["record_id"]].encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), hashlib.sha1(b).hexdigest())
    full = warc.replay(warc.read_warc(spark, f"file://{tmp_path}/a")).collect()
    assert all(bytes(r["payload"]) == text[r["record_id"]].encode() for r in full)
    warc.write_warc(warc.with_digests(pages, "page_id", "url", "html").withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("bigint")), f"file://{tmp_path}/raw")
    warc.deduplicate_archives(spark, f"file://{tmp_path}/raw", f"file://{tmp_path}/b")
    assert sorted((str(r["record_id"]), r["record_type"]) for r in warc.read_warc(spark, f"file://{tmp_path}/b").collect()) == sorted((str(r["record_id"]), r["record_type"]) for r in got)
    assert warc.archive_pages(pages.where("page_id > 99"), f"file://{tmp_path}/none").count() == 0


def test_large_records_have_archives_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    rows = [(i, f"http://h/{i}", ("ab" * (100_000 if i % 10 == 0 else 20)) + str(i % 25)) for i in range(60)] + [(99, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    got = {r["record_id"]: r for r in warc.archive_pages(pages, f"file://{tmp_path}/a").collect()}
    last = {t: i for i, _, t in rows if len(t) >= 1000}
    for i, _, t in rows:
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(t), hashlib.sha1(t.encode()).hexdigest())
        assert got[i]["refers_to"] == (last[t] if last.get(t, i) != i else None)
    files = [f for f in tmp_path.glob("a/*/part-*")]
    assert len(files) > 10
    for f in files:
        held = [r["payload_bytes"] for r in warc.parse_warc(f.read_bytes()) if r["record_type"] == "response"]
        assert len(held) <= 7 and (sum(held) <= 1 << 20 or len(held) == 1)
    text = b"".join(__import__("gzip").decompress(f.read_bytes()) for f in files)
    assert b"WARC-Refers-To-Target-URI: http://h/" in text and b"WARC-Refers-To-Date: " in text


def test_clashing_and_further_columns(spark):
    """Every operator leaves columns alone whatever they are called."""
    names = ["_key", "_words", "_shard", "_order", "_x", "_rest", "_salt", "_original", "_id", "_payload", "key", "row", "words", "size", "source_size", "block", "a.b", "base", "n", "id", "r"]
    text = lambda i: f"call +1 555 555 01{i % 7}{i % 9} or write a{i % 5}@b.com, it is number {i % 40} of the list we keep here"
    docs = spark.createDataFrame([(i, text(i), "en", "s", 0, *(f"{n}{i}" for n in names)) for i in range(60)], DOCS + "".join(f", `{n}` string" for n in names))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    from chorusframe.llm import minhash, substrings

    for out in (minhash.deduplicate(docs), pii.redact(docs), quality.keep_good(docs, labels), mixing.mix(docs, shard_col="__shard", order_col="__order").drop("__shard", "__order")):
        assert out.schema.names == docs.schema.names
        for r in out.collect():
            assert all(r[n] == f"{n}{r['doc_id']}" for n in names)
    assert pii.find_spans(docs).count() == minhash.near_duplicates(docs).count() == substrings.repeated_passages(docs).count() == quality.quality(docs, labels).count() == mixing.mix_plan(docs).count() == 60
    assert packing.pack(docs).select("doc_id").distinct().count() == 60
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://h/p").alias("url"), F.col("text").alias("html"), *(F.col(f"`{n}`") for n in names))
    assert url_filter.judge(pages).count() == 60
    records = warc.with_digests(pages, "page_id", "url", "html")
    records = records.join(pages.select(F.col("page_id").alias("record_id"), *(F.col(f"`{n}`") for n in names)), "record_id")
    assert all(r[n] == f"{n}{r['record_id']}" for r in warc.resolve_revisits(records, 10).collect() for n in names)


def test_rules_and_hosts(spark):
    rows = [
        (1, "http://A.example.com/en/7x?q#f", "example.com/en/7", "allow"), (2, "https://x.com/en/", "com/en/", "block"), (3, "http://xcom/en/", None, None), (4, "//a.net/de/8", None, None),
        (5, "http://m.example.net/de/81", "example.net/de/8", "block"), (6, "http://example.net/de/1", "net/de/", "allow"), (7, None, None, None), (8, "ftp://org/es/", "org/es/", "block"), (9, "http://h?/en/", None, None), (10, "a://b://c/d", None, None),
    ]
    pages = spark.createDataFrame([(r[0], r[1], None) for r in rows], "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    for i, url, rule, verdict in rows:
        assert got[i]["rule"] == rule and (verdict is None or got[i]["verdict"] == verdict)
    assert (got[1]["host"], got[1]["path"]) == ("a.example.com", "/en/7x") and (got[4]["host"], got[4]["path"]) == ("", "") and (got[9]["host"], got[9]["path"]) == ("h", "") and got[10]["host"] == "b:"
    assert url_filter.judge(pages.where("page_id > 99")).count() == 0


def plain_verdicts(pages, rules, rounds=400):
    """The operator by dense matrices: (host, path, rule, verdict, trust, distrust) of each page, and how many edges there are."""
    rows = []
    for _, url, _ in pages:
        m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[2]), m[3]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rows.append((host, path, *(max(fit)[1:] if fit else (None, None))))
    links = collections.Counter()
    for (host, *_), (_, _, html) in zip(rows, pages, strict=True):
        found = [re.sub(r":[0-9]*$", "", x.split("//")[-1].rsplit("@", 1)[-1]) for x in re.findall(r"""(?i)(?:href|src|action|data|cite|srcset)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^/?#"'\s>\\]+)""", html or "")]
        base = re.search(r"""(?i)<base\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)""", html or "")
        if base:
            found += [base[1]] * len(re.findall(r"""(?i)(?:href|src|action)\s*=\s*["']?\s*(?![a-z][a-z0-9+.-]*:|//|#)[^"'\s>]""", html))
        found += re.findall(r"(?<=[A-Za-z0-9._%+-])@([A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8})", html or "")
        links.update((host, x.lower()) for x in found if host and x and x.lower() != host)
    mine = {r[0] for r in rows if r[0]}
    hosts = sorted(mine | {x for e in links for x in e})
    at = {h: i for i, h in enumerate(hosts)}
    w = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in links.items():
        w[at[a], at[b]] = n
    out = w / np.maximum(w.sum(1, keepdims=True), 1)
    back = out.T / np.maximum(out.T.sum(1, keepdims=True), 1e-300)
    by = collections.defaultdict(list)
    for h, _, _, v in rows:
        by[h].append(v)
    score = []
    for kind, move in (("allow", out), ("block", back)):
        other = "block" if kind == "allow" else "allow"
        s = np.array([max(by[h].count(kind) - by[h].count(other), 0) / len(by[h]) if h in mine else 0.0 for h in hosts])
        x = s = s / (s.sum() or 1)
        for _ in range(rounds):
            x = 0.85 * move.T @ x
            x += (s.sum() - x.sum()) * s  # the teleport, and what hosts without edges held
        score.append(x)
    trust, distrust = score
    least = url_filter.EVIDENCE / max(len(mine), 1)
    final = []
    for host, path, rule, verdict in rows:
        t, d = (trust[at[host]], distrust[at[host]]) if host else (0.0, 0.0)
        final.append((host, path, rule, verdict or ("block" if d >= least and d > url_filter.THRESHOLD * t else "allow"), t, d))
    return final, len(links)


def test_patterns_are_linear_in_the_page(spark):
    units = ["// ", "<base ", "<base href ", "//href='", "a@", "@a.", "//href=a", "src=//a", "<base href=//a ", "href=x:"]

    def seconds(n):
        pages = ["// <base @" + u * (n // len(u)) + "x" for u in units] + ["//href=" + " " * n + "x", "//href='" + " " * n + "x"]
        df = spark.createDataFrame([(i, "http://a.b/", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string").cache()
        df.count()
        t = time.perf_counter()
        df.agg(*(F.sum(F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0)))) for p in (url_filter._LINK, url_filter._RELATIVE, url_filter._BASE, url_filter._MAIL))).collect()
        return time.perf_counter() - t

    seconds(1000)
    few, many = seconds(100_000), seconds(400_000)
    assert many < 5 and many < 8 * few + 1, (few, many)


def test_hosts_below_one_suffix_are_judged_apart(spark):
    pages = [(i, f"http://good{i}.co.uk/", None) for i in range(3)] + [(9, "http://bad.co.uk/x", '<a href="http://friend.co.uk/">')] + [(10, "http://fan.co.uk/", '<a href="http://bad.co.uk/">')]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string"), (("block", "bad.co.uk", "/"),)).collect()}
    assert got == {0: "allow", 1: "allow", 2: "allow", 9: "block", 10: "block"}


def test_unfinished_scores_are_an_error(spark):
    tmp = url_filter.Scratch(spark)
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, share double")
    with pytest.raises(RuntimeError, match="after 5 rounds"):
        url_filter.propagate(edges, spark.createDataFrame([("a", "trust", 1.0)], "host string, kind string, seed double"), tmp, rounds=5)


def test_propagation_matches_dense_iteration(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SALT_EDGES", 2)
    rng = np.random.default_rng(1)
    hosts = [f"h{i}.org" for i in range(11)] + ["a.b.h3.org"]
    forms = ['<a href="http://{}/x">', "<img src=//{}/y.png>", "<form action='https://u@{}:81/'>", "write to x@{} now", '<base href="http://{}/"><a href="z"><a href=y>']
    links = [(hosts[int(rng.integers(12))], hosts[int(rng.integers(12))]) for _ in range(60)]
    pages = [(i, f"http://{a}/p", forms[i % 5].format(b)) for i, (a, b) in enumerate(links)]
    pages += [(100 + i, f"http://{hosts[k]}/bad/", "") for k in (0, 1) for i in range(20 * k, 20 * k + 20)] + [(200 + i, f"http://{hosts[2]}/good/", "") for i in range(30)]
    pages += [(300, "http://h1.org/p", '<a href="http://dead.end.net/">'), (301, None, None)]
    rules = (("block", "org", "/bad/"), ("allow", "org", "/good/"))
    got = url_filter.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string"), rules, tolerance=1e-9)
    want, _ = plain_verdicts(pages, rules)
    want = {p[0]: w for p, w in zip(pages, want, strict=True)}
    for r in got.collect():
        host, path, rule, verdict, trust, distrust = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)
        assert (r["trust"], r["distrust"]) == (pytest.approx(trust, abs=1e-7), pytest.approx(distrust, abs=1e-7))


def test_registered_query_matches_dense_propagation(spark):
    sf = "/root/testdata/sf0.1"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    want, edges = plain_verdicts(pages, url_filter.RULES)
    bar = url_filter.EVIDENCE / len({w[0] for w in want})
    got = {r["page_id"]: r for r in url_filter.op6(spark, sf).collect()}
    assert edges > 20 and len(got) == len(pages)
    for (i, *_), (host, path, rule, verdict, trust, distrust) in zip(pages, want, strict=True):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert (r["trust"], r["distrust"]) == (pytest.approx(trust, abs=2e-3), pytest.approx(distrust, abs=2e-3))
        if rule or min(abs(distrust - bar), abs(distrust - trust)) > 4e-3:
            assert r["verdict"] == verdict


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_file_gives_the_ids_of_its_own_library(name):
    t, rng = packing.tokenizer(name), random.Random(6)
    assert (t.fast is None) == name.startswith("word")
    for _ in range(300):
        text = "".join(rng.choice("abcXYZ 09'é\n\t<|>.漢́") for _ in range(rng.randrange(80)))
        assert t.encode(text) == t.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, {"model": {"vocab": {"a": 0, "b": 1, "c": 2, "bc": 3, "ab": 4}, "merges": ["a b", "b c"]}}])
def test_only_plain_files_take_the_fast_path(change):
    own = {"model": {"vocab": {"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4}, "merges": [["a", "b"], "b c"]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "added_tokens": []}
    assert packing.plain(own) and not packing.plain(own | change)
