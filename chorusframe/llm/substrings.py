"""Removal of passages that occur more than once, found through difference-cover anchors.

COVER is a set of residues modulo PERIOD such that every residue is a difference of two of its members.  Two
equal windows at positions i and j therefore have an offset d < PERIOD with i + d and j + d both at cover
positions, so runs of WINDOW - PERIOD + 1 words hashed at cover positions only (5 of 21) are enough to bring
any two equal windows together.  A run that occurs twice nominates the windows around it; the nominated
windows are extended to their full length and compared by 128-bit keys.

Texts are dealt to partitions ``p`` of a bucketed table once.  Each pass reads that table in place and
sends only packed keys: one entry for a key and partition, so that a passage which a third of all documents
share costs one entry a partition.  The reply is one bit a key.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_column, in_slices, runs_of, text_key, word_hashes

PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Bytes of text in a partition p and its share of an exchange group r.
P_BYTES, R_BYTES = 2 << 20, 8 << 20
_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_PACK = "r int, p bigint, level int, keys binary, many binary"
_PACKED = pa.schema([("r", pa.int32()), ("p", pa.int64()), ("level", pa.int32()), ("keys", pa.binary()), ("many", pa.binary())])


def _combined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a task once, and how often it came again."""
    seen: dict[bytes, list[int]] = {}
    names = ["p", "key", "text", "n"]
    for batch in in_slices(it):
        keys, ps = batch.column("key").to_pylist(), batch.column("p").to_pylist()
        fresh = []
        for i, k in enumerate(keys):
            if k in seen:
                seen[k][1] += 1
            else:
                seen[k] = [ps[i], 0]
                fresh.append(i)
        out = batch.take(pa.array(fresh, pa.int64()))
        yield pa.RecordBatch.from_arrays([out.column("p"), out.column("key"), out.column("text"), pa.array([1] * len(fresh), pa.int64())], names=names)
    again = [(p, k, n) for k, (p, n) in seen.items() if n]
    for at in range(0, len(again), 10000):
        p, k, n = zip(*again[at : at + 10000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(k, pa.binary()), pa.nulls(len(p), pa.string()), pa.array(n, pa.int64())], names=names)


class _Part:
    """The texts of a partition p: keys, counts, words."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.cover = window, np.zeros(PERIOD, bool)
        self.cover[list(COVER)] = True
        self.count: dict[bytes, int] = {}
        text: dict[bytes, bytes] = {}
        for k, t, n, null in zip(table["key"].to_pylist(), byte_column(table["text"].combine_chunks()), table["n"].to_pylist(), table["text"].is_null().to_pylist(), strict=True):
            self.count[k] = self.count.get(k, 0) + n
            if not null:
                text[k] = t
        self.keys = sorted(text)
        self.words = [text.pop(k).split() for k in self.keys]
        self.hashes = [word_hashes(w) if len(w) >= window else None for w in self.words]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
        """Sorted distinct anchor keys, whether each comes again here, and for each long text its anchor positions."""
        run, at, found = self.window - PERIOD + 1, [], []
        for i, h in enumerate(self.hashes):
            if h is not None:
                pos = np.flatnonzero(self.cover[np.arange(len(h) - run + 1) % PERIOD])
                at.append((i, pos))
                found.append(runs_of(h, run, _B1)[pos])
        flat = np.concatenate(found) if found else np.empty(0, np.uint64)
        self.flat = flat
        keys, count = np.unique(flat, return_counts=True)
        return keys, count > 1, at

    def nominated(self, dup: np.ndarray, keys: np.ndarray, at: list[tuple[int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
        """For each long text, the starts of the windows that hold an anchor which occurs twice."""
        hit = dup[np.searchsorted(keys, self.flat)] if len(keys) else np.empty(0, bool)
        out, done = [], 0
        for i, pos in at:
            mine = pos[hit[done : done + len(pos)]]
            done += len(pos)
            if len(mine):
                starts = len(self.hashes[i]) - self.window + 1
                edge = np.zeros(starts + 1, np.int32)
                lo, hi = np.maximum(mine - PERIOD + 1, 0), np.minimum(mine + 1, starts)
                np.add.at(edge, np.minimum(lo, starts), 1)
                np.add.at(edge, hi, -1)
                pick = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                if len(pick):
                    out.append((i, pick))
        return out

    def windows(self, picked: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct 128-bit window keys, whether each comes again here, and each picked window's place among them."""
        one = [runs_of(self.hashes[i], self.window, _B1)[pick] for i, pick in picked]
        two = [runs_of(self.hashes[i], self.window, _B2)[pick] for i, pick in picked]
        if not one:
            return np.empty((0, 2), np.uint64), np.empty(0, bool), np.empty(0, np.int64)
        a, b = np.concatenate(one), np.concatenate(two)
        order = np.lexsort((b, a))
        sa, sb = a[order], b[order]
        new = np.r_[True, (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])]
        place = np.empty(len(a), np.int64)
        place[order] = np.cumsum(new) - 1
        keys = np.stack([sa[new], sb[new]], axis=1)
        return keys, np.bincount(place, minlength=len(keys)) > 1, place


def _pack(p: int, level: int, keys: np.ndarray, many: np.ndarray, groups: int) -> pa.Table:
    """The keys, split by exchange group."""
    group = ((keys if keys.ndim == 1 else keys[:, 0]) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    rows = [x for x in np.split(order, cuts) if len(x)]
    return pa.table(
        [[int(group[x[0]]) for x in rows], [p] * len(rows), [level] * len(rows), [keys[x].tobytes() for x in rows], [np.packbits(many[x]).tobytes() for x in rows]],
        schema=_PACKED,
    )


def _answered(replies: pa.Table, level: int, keys: np.ndarray, many: np.ndarray, groups: int) -> np.ndarray:
    """Which keys occur twice anywhere, from the replies to what _pack sent."""
    group = ((keys if keys.ndim == 1 else keys[:, 0]) % np.uint64(groups)).astype(np.int64)
    out = many.copy()
    rows = {r: b for r, b, at in zip(replies["r"].to_pylist(), replies["many"].to_pylist(), replies["level"].to_pylist(), strict=True) if at == level}
    order = np.argsort(group, kind="stable")
    for x in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(x):
            out[x] = np.unpackbits(np.frombuffer(rows[int(group[x[0]])], np.uint8), count=len(x)).astype(bool)
    return out


def _meet(table: pa.Table) -> pa.Table:
    """One exchange group: mark in each partition's list the keys that another list has, or that came twice there."""
    level = table["level"][0].as_py()
    lists = [np.frombuffer(x, np.uint64).reshape(-1, 1 if level == 1 else 2) for x in table["keys"].to_pylist()]
    many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)).astype(bool) for m, k in zip(table["many"].to_pylist(), lists, strict=True)]
    flat, twice = np.concatenate(lists), np.concatenate(many)
    order = np.lexsort(flat.T[::-1])
    s = flat[order]
    new = np.r_[True, (s[1:] != s[:-1]).any(axis=1)]
    place = np.cumsum(new) - 1
    again = (np.bincount(place) > 1) | (np.bincount(place, twice[order]) > 0)
    dup = np.empty(len(flat), bool)
    dup[order] = again[place]
    cut = np.cumsum([len(x) for x in lists])[:-1]
    empty = pa.array([b""] * len(lists), pa.binary())
    return pa.table([table["r"], table["p"], table["level"], empty, [np.packbits(x).tobytes() for x in np.split(dup, cut)]], schema=_PACKED)


def repeated_passages(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256`` and, ``with_text``, ``kept``.

    A word goes if a window of ``window`` words that covers it also starts anywhere else in the table, in
    the same document included; windows are judged on the input.  ``kept`` has the remaining words, joined
    by one space.  Documents of fewer words lose none; a null text has no words; rows that repeat a doc_id
    count as documents of their own, so both lose all windows of a common text.  An empty table gives no
    rows; further columns are ignored.
    """
    if window < PERIOD + 4:
        raise ValueError(f"window must be at least {PERIOD + 4} words")
    spark = docs.sparkSession
    tmp = Scratch(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_key(F.col(text_col)).alias("key"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_p, n_r = max(1, ceil(total / P_BYTES)), max(1, ceil(total / R_BYTES))
    buckets = max(1, ceil(n_p / 8))
    name = f"passages_{uuid.uuid4().hex}"
    dealt = base.select(F.pmod(F.xxhash64("key"), F.lit(n_p)).alias("p"), "key", "text").mapInArrow(_combined, "p bigint, key binary, text string, n bigint")
    dealt.repartition(buckets, "p").write.bucketBy(buckets, "p").option("path", tmp.path()).saveAsTable(name)  # in the shared folder, not the warehouse
    table = spark.table(name)

    def first(key: tuple, t: pa.Table) -> pa.Table:
        keys, many, _ = _Part(t, window).anchors()
        return _pack(key[0].as_py(), 1, keys, many, n_r)

    def second(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        part = _Part(t, window)
        keys, many, at = part.anchors()
        picked = part.nominated(_answered(replies, 1, keys, many, n_r), keys, at)
        keys, many, _ = part.windows(picked)
        return _pack(key[0].as_py(), 2, keys, many, n_r)

    def third(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        part = _Part(t, window)
        keys, many, at = part.anchors()
        picked = part.nominated(_answered(replies, 1, keys, many, n_r), keys, at)
        keys, many, place = part.windows(picked)
        dup = _answered(replies, 2, keys, many, n_r)[place]
        gone, done = {}, 0
        for i, pick in picked:
            starts = pick[dup[done : done + len(pick)]]
            done += len(pick)
            edge = np.zeros(len(part.words[i]) + 1, np.int32)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            gone[i] = np.cumsum(edge[:-1]) > 0
        n, removed, text = [], [], []
        for i, w in enumerate(part.words):
            n.append(len(w))
            if part.count[part.keys[i]] > 1 and len(w) >= window:
                left = []
            else:
                left = [x for x, g in zip(w, gone[i], strict=True) if not g] if i in gone else w
            removed.append(len(w) - len(left))
            text.append(b" ".join(left))
        sha = [hashlib.sha256(x).hexdigest() for x in text]
        return pa.table({"key": pa.array(part.keys, pa.binary()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(text if with_text else [None] * len(n), pa.binary()).cast(pa.string())})

    try:
        one = tmp.write(table.groupBy("p").applyInArrow(first, _PACK).groupBy("r").applyInArrow(_meet, _PACK))
        two = table.groupBy("p").cogroup(one.groupBy("p")).applyInArrow(second, _PACK)
        two = tmp.write(two.groupBy("r").applyInArrow(_meet, _PACK))
        done = table.groupBy("p").cogroup(one.union(two).groupBy("p")).applyInArrow(third, "key binary, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
        done = tmp.write(done, keep=True)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        tmp.drop()
    return base.select("doc_id", "key").join(done if with_text else done.drop("kept"), "key").drop("key")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=35, with_text=False)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
h AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN md5(array_to_string(ws[i:i + 34], ' ')) END AS h FROM i),
m AS (SELECT h FROM h WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
c AS (SELECT doc_id, i, word, count(m.h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone FROM h LEFT JOIN m USING (h)),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
