"""Phrases whose words keep together, counted in tries with hash containers at their leaves (HAT-tries).

Counting goes by length, and each pass counts only phrases whose parts can reach ``min_count``: words, then pairs of
frequent words, then phrases of three and more words whose pairs are all frequent.  What is frequent is passed on as a bit
table of bounded size (a Bloom filter): it never rejects a frequent part, and phrases let through by mistake are
counted exactly like the others and fall below ``min_count``.

A task numbers the words that it meets and holds its counts in a trie over these numbers.  A node starts as one hash
container of suffixes; a container of more than BURST suffixes bursts into children by the next word.  Beyond CAPACITY
counts a task spills its largest subtrees, each as a run sorted by words, into Spark's shuffle, where a partition
gets all runs of a prefix (the first two words) and adds them up.
"""

from __future__ import annotations

import re
from collections import _count_elements
from collections.abc import Iterator
from itertools import chain
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_column, in_slices, mix, parts, word_hashes

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BORDER = re.compile(rb"[.,;:!?\n-\r]+")
#: Bits of a word's number in a task; a container of more suffixes bursts; counts that a task holds; words counted at once; counts of an Arrow batch of runs; bits of the largest filter.
ID_BITS, BURST, CAPACITY, STEP, RUN, MAX_BITS = 21, 4096, 1_000_000, 500_000, 1 << 18, 1 << 28
_MASK = (1 << ID_BITS) - 1
_SEED = np.uint64(0x9E3779B97F4A7C15)
_RUN = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


class Filter:
    """Bits of what is frequent, two for each 64-bit hash."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, np.uint64(len(bits) * 64)

    @staticmethod
    def places(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        return h % np.uint64(size), mix(h ^ _SEED) % np.uint64(size)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in self.places(h, int(self.size)):
            found &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _SEED + b)


class Trie:
    """Counts of phrases, given as the first word's number and the packed numbers (plus one) of the words after it."""

    def __init__(self):
        self.root: dict[int, dict | Burst] = {}
        self.leaf: dict[int, int] = {}
        self.counts: dict[int, int] = {}
        self.size = 0

    def add(self, first: np.ndarray, rest: np.ndarray, words: int) -> None:
        """Phrases of ``words`` words; ``rest`` packs their other words, the second in the highest bits."""
        if words == 1:  # nothing follows: the root itself is the container
            was = len(self.leaf)
            _count_elements(self.leaf, first.tolist())
            self.size += len(self.leaf) - was
            return
        rest = rest << (ID_BITS * (4 - words))
        order = np.argsort(first, kind="stable")
        first, rest = first[order], rest[order]
        starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]][: len(first)])
        keys, root, counts = rest.tolist(), self.root, self.counts
        for f, i, j in zip(first[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
            node = root.get(f)
            if node is None:
                node = root[f] = {}
            if type(node) is Burst:
                more = node.add(rest[i:j])
            else:
                more = -len(node)
                _count_elements(node, keys[i:j])
                more += len(node)
                if len(node) > BURST:
                    root[f] = Burst(node)
            counts[f] = counts.get(f, 0) + more
            self.size += more

    def pop_largest(self, leave: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Take out whole subtrees, the largest first, until ``leave`` counts remain: first words, packed other words and counts of many subtrees at a time."""
        if self.size > leave and self.leaf:
            held, self.leaf = self.leaf, {}
            self.size -= len(held)
            yield np.fromiter(held, np.int64, len(held)), np.zeros(len(held), np.int64), np.fromiter(held.values(), np.int64, len(held))
        firsts, sizes, held = [], [], []

        def taken() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = sum(sizes)
            return np.repeat(firsts, sizes), np.fromiter(chain.from_iterable(held), np.int64, n), np.fromiter(chain.from_iterable(map(dict.values, held)), np.int64, n)

        for f in sorted(self.counts, key=self.counts.get, reverse=True):
            if self.size <= leave:
                break
            node = self.root.pop(f)
            firsts.append(f)
            sizes.append(self.counts.pop(f))
            held += node.children.values() if type(node) is Burst else (node,)
            self.size -= sizes[-1]
            if sum(sizes[-64:]) >= RUN or len(sizes) % 64 == 0 and sum(sizes) >= RUN:
                yield taken()
                firsts, sizes, held = [], [], []
        if firsts:
            yield taken()


class Burst:
    """An inner node: a container for each next word."""

    def __init__(self, container: dict[int, int]):
        self.children: dict[int, dict] = {}
        for k, n in container.items():
            self.children.setdefault(k >> 2 * ID_BITS, {})[k] = n

    def add(self, keys: np.ndarray) -> int:
        keys = np.sort(keys)
        lead = keys >> 2 * ID_BITS
        cuts, more = np.flatnonzero(np.diff(lead)) + 1, 0
        for at, some in zip(lead[np.r_[0, cuts]].tolist(), np.split(keys, cuts), strict=True):
            held = self.children.setdefault(at, {})
            more -= len(held)
            _count_elements(held, some.tolist())
            more += len(held)
        return more


class Counts:
    """A task's trie, its words and its spills."""

    def __init__(self, known: Filter | None, pairs: Filter | None, lengths: tuple[int, ...]):
        self.filter, self.pairs, self.lengths = known, pairs, lengths
        self.start()

    def start(self) -> None:
        self.trie, self.numbers, self.known = Trie(), {}, 0
        self.words, self.langs, self.hashes = [], [], np.empty(0, np.uint64)

    def add(self, lang: bytes, text: bytes) -> Iterator[pa.RecordBatch]:
        """Count a text; yields the runs that had to be spilled meanwhile."""
        words = BORDER.sub(b" . ", text.translate(LOWER)).split()
        for start in range(0, len(words), STEP):
            self._count(lang, words[start : start + STEP + max(self.lengths) - 1])
            if self.trie.size > CAPACITY:
                yield from self.spill(CAPACITY // 2)
            if self.known > _MASK - 2 * STEP:  # numbers stay below 2**21
                yield from self.spill(0)
                self.start()

    def _meet(self, lang: bytes, numbers: dict[bytes, int], fresh: list[bytes]) -> None:
        """Number the words that this task meets for the first time."""
        if self.filter is not None:
            h = word_hashes([lang + b"\0" + w for w in fresh])
            has = self.filter.has(h)
            numbers.update((w, -1) for w, x in zip(fresh, has.tolist(), strict=True) if not x)
            fresh = [w for w, x in zip(fresh, has.tolist(), strict=True) if x]
            self.hashes = np.concatenate([self.hashes, h[has]])
        numbers.update(zip(fresh, range(len(self.words), len(self.words) + len(fresh)), strict=True))
        self.words += fresh
        self.langs += [lang] * len(fresh)
        self.known = sum(map(len, self.numbers.values()))

    def _count(self, lang: bytes, words: list[bytes]) -> None:
        """Phrases that begin in the first STEP words."""
        numbers = self.numbers.setdefault(lang, {b".": -1})  # -1: borders and words that the filter hasn't
        self._meet(lang, numbers, [w for w in set(words) if w not in numbers])
        ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        ok = ids >= 0
        two = ok[:-1] & ok[1:]
        if self.pairs is not None:
            at = np.flatnonzero(two)
            two[at] = self.pairs.has(pair_hash(self.hashes[ids[at]], self.hashes[ids[at + 1]]))
        for m in self.lengths:
            run = ok.copy() if m == 1 else two[: max(len(two) - m + 2, 0)].copy()
            for k in range(1, m - 1):
                run &= two[k : k + len(run)]
            at = np.flatnonzero(run[:STEP])
            if len(at):
                rest = np.zeros(len(at), np.int64)
                for k in range(1, m):
                    rest = rest << ID_BITS | ids[at + k] + 1
                self.trie.add(ids[at], rest, m)

    def spill(self, leave: int) -> Iterator[pa.RecordBatch]:
        """Sorted runs of the largest subtrees."""
        if self.trie.size <= leave:
            return
        names = pa.array(self.words, pa.binary())
        rank = np.empty(len(names), np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        names, tongues = names.cast(pa.string()), pa.array(self.langs, pa.binary()).cast(pa.string())
        for trees in self.trie.pop_largest(leave):
            yield self._run(names, tongues, rank, *trees)

    def _run(self, names: pa.Array, tongues: pa.Array, rank: np.ndarray, f: np.ndarray, k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        ids = [f, *((k >> ID_BITS * s & _MASK) - 1 for s in (2, 1, 0)[: max(self.lengths) - 1])]  # -1: no word
        order = np.lexsort([*(np.where(x < 0, -1, rank[x]) for x in ids[:0:-1]), rank[f], f])
        ids = [x[order] for x in ids]
        words = [names.take(pa.array(x, pa.int64(), mask=x < 0)) for x in ids]
        phrase = pc.binary_join_element_wise(*words, " ", null_handling="skip") if len(words) > 1 else words[0]
        return pa.RecordBatch.from_arrays([tongues.take(pa.array(ids[0])), phrase, pa.array(n[order])], schema=_RUN)


def runs(texts: DataFrame, lengths: tuple[int, ...], known=None, pairs=None) -> DataFrame:
    """``lang, phrase, n``: the tasks' sorted runs over ``texts(lang, text)``; filters are broadcast variables."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Counts(known and Filter(known.value), pairs and Filter(pairs.value), lengths)
        for batch in in_slices(it):
            by: dict[bytes, list[bytes]] = {}
            for lang, text in zip(byte_column(batch.column("lang")), byte_column(batch.column("text")), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, some in by.items():
                yield from task.add(lang, b" . ".join(some))
        yield from task.spill(0)

    return texts.mapInArrow(count, "lang string, phrase string, n bigint")


def merged(spilled: DataFrame, least: int) -> DataFrame:
    """Runs of a prefix meet in one partition and are added up there; one shuffle."""
    prefix = F.substring_index("phrase", " ", 2)
    whole = spilled.repartition(F.col("lang"), prefix).groupBy("lang", prefix.alias("prefix"), "phrase").agg(F.sum("n").alias("n"))
    return whole.where(F.col("n") >= least).select("lang", "phrase", "n")


def frequent_bits(frequent: DataFrame, words: int, n: int):
    """A broadcast bit table of the hashes of ``frequent`` words or pairs: 16 bits for each of ``n`` at most, MAX_BITS in all."""
    size = min(MAX_BITS, 1 << max(10, ceil(log2(16 * n + 1))))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            langs, phrases = byte_column(batch.column("lang")), byte_column(batch.column("phrase"))
            each = [p.split(b" ") for p in phrases]
            h = [word_hashes([t + b"\0" + w[k] for t, w in zip(langs, each, strict=True)]) for k in range(words)]
            at = np.concatenate(Filter.places(h[0] if words == 1 else pair_hash(*h), size))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["at", "bit"])

    found = frequent.mapInArrow(place, "at bigint, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # MAX_BITS / 64 rows at most
    bits = np.zeros(size // 64, np.int64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(bits.view(np.uint64))


def _whole(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def scored(counts: DataFrame) -> DataFrame:
    """Each phrase of two or more words with ``a, l, r, score`` of its lowest-scoring cut; counts has every part."""
    word = F.split("phrase", " ")
    cuts = counts.where(F.contains("phrase", F.lit(" "))).select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size(word) - 1)).alias("k"))
    first, rest = F.array_join(F.slice(word, F.lit(1), F.col("k")), " "), F.array_join(F.slice(word, F.col("k") + 1, F.size(word)), " ")
    cuts = cuts.withColumn("first", first).withColumn("rest", rest)
    of = lambda part, n: counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr("CAST(2000000 AS decimal(7,0)) * CAST(a AS decimal(20,0)) DIV (CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def absorbed(counts: DataFrame) -> DataFrame:
    """``lang, phrase, longest``: the largest count among longer phrases that hold a phrase's words side by side."""
    word = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size(word) - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size(word) - m + 1), lambda i: F.array_join(F.slice(word, i, m), " "))))
    return counts.where(F.size(word) > 2).select("lang", F.explode(spans).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longest"))


def collocations(docs: DataFrame, min_count: int = 30, max_words: int = 4, top: int = 2000, absorb_percent: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``max_words`` (at most 4) words.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs.  A phrase
    that occurs ``min_count`` times within pieces scores floor(2000000 a / (l + r)) at its lowest cut, ties to the earliest; it is
    dropped where a longer one holds it and occurs in ``absorb_percent`` of its places.  Order: score, a, phrase in bytes.
    Null texts are empty, a null lang is ``und`` (and joins rows that say ``und``), repeated rows count each, an empty table and
    languages without such phrases give no rows; further columns are ignored, whatever their names.
    """
    if not 2 <= max_words <= 4:
        raise ValueError("max_words is 2, 3 or 4")
    tmp = Scratch(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    every = merged(runs(texts, (1,)), 1)
    # all words of a language, as a row without phrase
    words = tmp.write(every.groupBy("lang", F.when(F.col("n") >= min_count, F.col("phrase")).alias("phrase")).agg(F.sum("n").alias("n")))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n_all"))
    counts = words.where(F.col("phrase").isNotNull())
    held, known = [], None
    try:
        known = frequent_bits(counts, 1, counts.count())
        held.append(known)
        pairs = tmp.write(merged(runs(texts, (2,), known), min_count))
        counts = counts.union(pairs)
        if max_words > 2:
            both = frequent_bits(pairs, 2, pairs.count())
            held.append(both)
            counts = counts.union(tmp.write(merged(runs(texts, tuple(range(3, max_words + 1)), known, both), min_count)))
        left = scored(counts).join(absorbed(counts), ["lang", "phrase"], "left")
        left = left.where(F.col("longest").isNull() | (F.lit(100) * _whole("longest") < F.lit(absorb_percent) * _whole("a"))).drop("longest")
        order = (F.desc("score"), F.desc("a"), "phrase")
        salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(parts(docs.sparkSession))))  # a language's phrases are first ranked in many tasks
        some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
        out = ranked.join(sizes, "lang").select("lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", F.col("n_all").alias("n"), "score")
        return tmp.write(out, keep=True)
    finally:
        for b in held:
            b.unpersist()
        tmp.drop()


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, unnest([array_to_string(ws[i:i + m], ' ') FOR m IN range(0, least(4, len(ws) - i + 1))]) AS phrase FROM i),
t AS (SELECT lang, count(*) AS n FROM i GROUP BY lang),
f AS (SELECT lang, phrase, string_split(phrase, ' ') AS ws, count(*) AS a FROM g GROUP BY lang, phrase HAVING count(*) >= 30),
k AS (SELECT lang, phrase, ws, a, unnest(range(1, len(ws))) AS k FROM f),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, CAST(2000000 * CAST(k.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.ws[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.ws[k.k + 1:len(k.ws)], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM s),
o AS (SELECT lang, a, unnest(flatten([[array_to_string(ws[j:j + m - 1], ' ') FOR j IN range(1, len(ws) - m + 2)] FOR m IN range(2, len(ws))])) AS phrase FROM f WHERE len(ws) > 2),
e AS (SELECT lang, phrase, max(a) AS longest FROM o GROUP BY lang, phrase),
q AS (SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN e ON e.lang = b.lang AND e.phrase = b.phrase WHERE nth = 1 AND (longest IS NULL OR 100 * CAST(longest AS HUGEINT) < 80 * CAST(b.a AS HUGEINT)))
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN t ON t.lang = q.lang WHERE rank <= 2000
"""
