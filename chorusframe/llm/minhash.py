"""MinHash near-duplicate detection with tensored banding.

Two small collections of ``tables`` half-keys (each of ``rows`` minhashes) are computed per document, and
every pair (one half-key of each collection) keys a table: tables**2 tables from 2 * tables * rows minhash
values.  A pair of similarity s is missed with probability below 2 * (1 - s**rows)**tables; the defaults
give 2e-5 at s = 0.85 and 3e-4 at 0.8.

Tables only nominate: a link is made where the full shingle sets reach the threshold, and components are closed over
such links alone.  Where buckets are larger than a block, a few rounds come first in which each of their documents is
compared with one other, a leader of one of its buckets in another component; a round joins most copies of a hot group
at one comparison a document, and the rounds end when few are joined.  Then pairs of different components that share a bucket are left: there, sketches (a byte of each minhash) meet in
blocks and clear the pairs whose estimated similarity is too far below the threshold, and only the rows of the
others fetch their texts.  A pair that shares several buckets counts in its first table only, and links leave a block
as a spanning forest, so neither buckets nor components are ever expanded into rows of pairs.  Documents with the same
text are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_column, in_slices, mix, runs_of, text_key, word_hashes
from .components import components
from .meetings import Undecided, block_pairs, decided, forest, meetings

ROWS, TABLES = 3, 12
#: Documents in a block; shingles that a task gets; rounds with leaders, which end when fewer than one comparison in FEW links.
BLOCK, TASK_SHINGLES, ROUNDS, FEW = 1024, 1_000_000, 6, 5
#: Operations of a matrix product that cost as much as looking up one shingle.
DENSE = 1000
#: Standard deviations below the threshold at which a sketch clears a pair.
SPREAD = 6.0
#: Keys of nominated texts that are broadcast to pick the texts (16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 2_000_000
_BASE = 0x9E3779B97F4A7C15


def shingles(text: bytes, k: int) -> np.ndarray:
    """The sorted distinct keys of a text's k-word shingles: A-Z lowered, words between ASCII white space;
    a text of fewer words has its whole sequence as one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(runs_of(word_hashes(words), min(k, len(words)), _BASE) + np.uint64(min(k, len(words))))


def half_keys(s: np.ndarray, seeds: np.ndarray, tables: int) -> tuple[np.ndarray, bytes]:
    """2 * tables keys, each from its own minhash values of the set ``s``, and a byte of each of these values."""
    low = None
    for at in range(0, len(s), 4096):  # bounds the memory that a very long document takes
        m = mix((s[at : at + 4096, None] ^ seeds[None, :]) * np.uint64(0xD6E8FEB86659FD93)).min(axis=0)
        low = m if low is None else np.minimum(low, m)
    sketch = (low & np.uint64(255)).astype(np.uint8).tobytes()
    low = low.reshape(2 * tables, -1)
    key = np.zeros(len(low), np.uint64)
    for j in range(low.shape[1]):
        key = mix(key * np.uint64(_BASE) + low[:, j])
    return key, sketch


def _signed(seq: Iterator[pa.RecordBatch], k: int, rows: int, tables: int) -> Iterator[pa.RecordBatch]:
    seeds = np.random.default_rng(20).integers(0, 2**63, 2 * tables * rows, dtype=np.uint64)
    for batch in in_slices(seq):
        n, sketch, u, v = [], [], [], []
        for text in byte_column(batch.column(0)):
            s = shingles(text, k)
            n.append(len(s))
            keys, low = half_keys(s, seeds, tables) if len(s) else (np.empty(0, np.uint64), b"")
            keys = keys.view(np.int64)
            sketch.append(low)
            u.append(keys[:tables])
            v.append(keys[tables:])
        rest = [batch.column(i) for i in range(1, batch.num_columns)]
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.array(n, pa.int64()), pa.array(sketch, pa.binary()), pa.array(u, kind), pa.array(v, kind)],
            names=[*batch.schema.names[1:], "n_shingles", "sketch", "u", "v"],
        )


def _intersections(sets: list[np.ndarray], sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of the pairs (a, b), sorted by a, of sets that are not empty.

    Each set is looked up in its partners'; where so many pairs are asked for that a product of the sets' 0-1 rows over the
    shingles that two of them share costs less, that decides.
    """
    work = int(sizes[b].sum())
    if work > 4 * sizes.sum():
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        width, n = int(shared.sum()), len(sets)
        if n * n * width < DENSE * work:
            keep = shared[code]
            cols, who = (np.cumsum(shared) - 1)[code[keep]], owner[keep]
            order = np.argsort(cols, kind="stable")
            cols, who = cols[order], who[order]
            inter = np.zeros((n, n))
            for at in range(0, width, 8192):
                here = slice(*np.searchsorted(cols, [at, at + 8192]))
                m = np.zeros((n, min(8192, width - at)), np.float32)
                m[who[here], cols[here] - at] = 1
                inter += m @ m.T
            return inter[a, b]
    out = np.empty(len(a))
    cuts = (np.flatnonzero(np.diff(a)) + 1).tolist()
    for lo, hi in zip([0, *cuts], [*cuts, len(a)], strict=True):
        one, others = sets[a[lo]], b[lo:hi]
        flat = np.concatenate([sets[j] for j in others])
        hit = one[np.searchsorted(one, flat) % len(one)] == flat
        out[lo:hi] = np.add.reduceat(hit, np.cumsum([0, *sizes[others][:-1]]), dtype=np.int64)
    return out


def _linked(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, pct: int) -> np.ndarray:
    """Which of the pairs (a, b), sorted by a, have 100 * intersection >= pct * union."""
    if not len(a):
        return np.zeros(0, bool)
    sizes = np.array([len(x) for x in sets])
    inter = _intersections(sets, sizes, a, b)
    return 100 * inter >= pct * (sizes[a] + sizes[b] - inter)


def _starred(t: pa.Table, k: int, pct: int) -> pa.Table:
    """Of each leader (side 0) and those that meet it (side 1): linked roots ``a, b``."""
    t = t.sort_by([("meeting", "ascending"), ("side", "ascending")])
    cuts = (np.flatnonzero(np.diff(t["meeting"].to_numpy())) + 1).tolist()
    a, b = [], []
    for lo, hi in zip([0, *cuts], [*cuts, t.num_rows], strict=True):
        part = t.slice(lo, hi - lo)
        sets, root = [shingles(x, k) for x in byte_column(part["text"].combine_chunks())], part["root"].to_pylist()
        others = np.arange(1, len(sets))
        for i in np.flatnonzero(_linked(sets, np.zeros(len(others), np.int64), others, pct)):
            a.append(root[0])
            b.append(root[i + 1])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def least_matches(rows: int, pct: int) -> int:
    """Equal sketch bytes of ``rows`` below which a pair is taken to be below the threshold."""
    s = pct / 100
    return int(rows * s - SPREAD * (rows * s * (1 - s)) ** 0.5)


def _undecided(t: pa.Table, tables: int, least: int, most: int) -> pa.Table:
    """Within each bucket's block pair: the rows of the pairs of different components that sketches do not clear and no earlier table has.

    Pairs of rows with many shingles are cut into several meetings, each of about ``most`` shingles.
    """
    t = t.sort_by([("bucket", "ascending"), ("x", "ascending"), ("y", "ascending")])
    out = Undecided(t["task"][0].as_py())
    sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
    half = np.frombuffer(b"".join(t["half"].to_pylist()), "<i8").reshape(t.num_rows, 2, tables)
    _, root = np.unique(np.frombuffer(b"".join(t["root"].to_pylist()), "V16"), return_inverse=True)
    side, x, y, one, two, size = (t[c].to_numpy() for c in ("side", "x", "y", "i", "j", "size"))
    for at in meetings(t, "bucket"):
        maybe = root[at, None] != root[None, at]
        if x[at.start] != y[at.start]:
            maybe &= side[at, None] != side[None, at]
        a, b = np.nonzero(np.triu(maybe, 1))
        for k in range(0, len(a), 65536):
            i, j = a[k : k + 65536] + at.start, b[k : k + 65536] + at.start
            good = (sketch[i] == sketch[j]).sum(axis=1) >= least
            same = half[i] == half[j]
            maybe[i - at.start, j - at.start] = good & (same[:, 0].argmax(axis=1) == one[at.start]) & (same[:, 1].argmax(axis=1) == two[at.start])
        a, b = np.nonzero(np.triu(maybe, 1))
        tile = np.cumsum(size[at]) * 2 // most
        pair = tile[a] * (tile[-1] + 1) + tile[b]
        for p in np.unique(pair):
            out.add(t["key"].slice(at.start, at.stop - at.start), a[pair == p], b[pair == p])
    return out.table()


def _verified(t: pa.Table, k: int, pct: int) -> pa.Table:
    """Of the undecided pairs: linked roots ``a, b`` as a forest of each meeting."""
    a, b = [], []
    for part, i, j in decided(t):
        sets, root = [shingles(x, k) for x in byte_column(part["text"].combine_chunks())], part["root"].to_pylist()
        good = _linked(sets, i, j, pct)
        for x, y in forest(np.stack([i[good], j[good]], axis=1), len(sets)):
            a.append(root[x])
            b.append(root[y])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _as_bytes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        half = [np.array(x, "<i8").tobytes() for x in b.column("uv").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("sketch"), pa.array(half, pa.binary())], names=["key", "sketch", "half"])


def _closed(spark: SparkSession, found: DataFrame | None, links: DataFrame, tmp: Scratch) -> DataFrame:
    """``node, root`` after the components ``found`` so far are joined by links between their roots."""
    more = components(spark, links, tmp)
    if found is None:
        return more
    more = more.select(F.col("node").alias("was"), F.col("root").alias("now"))
    moved = found.join(more, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))
    single = more.join(found, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("root"))
    return tmp.write(moved.union(single))


def _roots(keys: DataFrame, found: DataFrame | None) -> DataFrame:
    """``key, root`` of every nominated class."""
    if found is None:
        return keys.withColumn("root", F.col("key"))
    return keys.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def _apart(tabled: DataFrame, roots: DataFrame, tmp: Scratch) -> DataFrame:
    """The rows of buckets that hold more than one component, with their ``root``."""
    rows = tabled.join(roots, "key")
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    return tmp.write(rows.join(mixed, "bucket", "left_semi"))


def _shared(df: DataFrame, *key: str) -> DataFrame:
    """The rows of ``df`` whose key is not theirs alone; counts are combined before the shuffle."""
    many = df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.join(many, list(key), "left_semi")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = ROWS, tables: int = TABLES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept, _key``.

    component_id is the smallest doc_id that links reach, itself included; kept marks the document that
    stays of each component.  A null text and one without words have an empty set and link with nothing:
    such a document is its own component.  Rows that repeat a doc_id are judged by their texts; where the
    kept doc_id occurs twice in a component, both rows are marked.  Null doc_ids rank last, and a
    component that has no other gets a null component_id and is kept.  An empty table gives no rows;
    further columns are ignored.  ``_key`` names the text (see common.text_key).
    """
    spark = docs.sparkSession
    tmp = Scratch(spark)
    base = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_key(F.col(text_col)).alias("key"), F.col(id_col).alias("doc_id"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    signed = base.mapInArrow(
        lambda it: _signed(it, shingle, rows, tables), f"key binary, doc_id {id_type}, n_shingles bigint, sketch binary, u array<bigint>, v array<bigint>"
    )
    signed = tmp.write(signed)
    narrow = signed.select("key", "doc_id", "n_shingles")

    classes = tmp.write(signed.where("n_shingles > 0").groupBy("key").agg(F.first("sketch").alias("sketch"), F.first("u").alias("u"), F.first("v").alias("v")))
    # A table can be shared only where both of its half-keys are: only those are paired up.
    u = _shared(classes.select("key", F.posexplode("u").alias("i", "u")), "i", "u")
    v = _shared(classes.select("key", F.posexplode("v").alias("j", "v")), "j", "v")
    tabled = tmp.write(u.join(v, "key").select("key", "i", "j", F.xxhash64("i", "j", "u", "v").alias("bucket")))
    tabled = tmp.write(_shared(tabled, "bucket"))

    sizes = tmp.write(tabled.select("key").distinct().join(narrow.groupBy("key").agg(F.first("n_shingles").alias("size")), "key"))
    wanted, few = sizes.select("key"), sizes.count() <= BROADCAST_KEYS
    # Copies are combined before the shuffle.
    texts = base.join(F.broadcast(wanted) if few else wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    texts = tmp.write(texts)

    keys, found = sizes.select("key"), None
    hot = tmp.write(tabled.join(tabled.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("bucket"), "bucket", "left_semi").withColumn("root", F.col("key")))
    for turn in range(ROUNDS):
        if hot.isEmpty():
            break
        # Each class meets, of its buckets' leaders that are of another component, the first in an order that changes by round.
        leader = hot.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("o"), F.col("key").alias("hub"), F.col("root").alias("base"))).alias("l"))
        stars = hot.join(leader, "bucket").where("root <> l.base").groupBy("key", "root").agg(F.min("l").alias("l")).select("key", "root", "l.hub", "l.base")
        stars = tmp.write(stars.join(sizes, "key"))
        count = tmp.write(stars.groupBy("hub", "base").agg(F.ceil(F.count("*") / BLOCK).alias("chunks")))  # a table of its own, so that a join with a hot hub can be split
        done = stars.agg(F.count("*").alias("n"), F.sum("size").alias("all")).first()
        if not done["n"]:
            break
        tasks = ceil(done["all"] / TASK_SHINGLES) + 1
        arms = stars.join(count, ["hub", "base"]).select("hub", F.pmod(F.xxhash64("key"), "chunks").alias("chunk"), F.lit(1).alias("side"), "root", "key")
        hubs = count.select("hub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), F.col("base").alias("root"), F.col("hub").alias("key"))
        met = arms.union(hubs).withColumn("meeting", F.xxhash64("hub", "chunk")).withColumn("task", F.pmod("meeting", F.lit(tasks)))
        met = met.select("task", "meeting", "side", "root", "key").join(texts, "key")
        links = tmp.write(met.groupBy("task").applyInArrow(lambda t: _starred(t, shingle, percent), "a binary, b binary"))
        n = links.count()
        if n:
            found = _closed(spark, found, links, tmp)
            hot = _apart(hot.drop("root"), _roots(keys, found), tmp)
        if n * FEW < done["n"]:
            break

    # What still shares a bucket and is of different components.
    apart = _apart(tabled, _roots(keys, found), tmp)
    least, most = least_matches(2 * tables * rows, percent), TASK_SHINGLES
    half = classes.select("key", "sketch", F.concat("u", "v").alias("uv"))
    half = half.mapInArrow(_as_bytes, "key binary, sketch binary, half binary")
    met = block_pairs(tmp.write(apart.join(sizes, "key").join(half, "key")), "bucket", BLOCK, tmp)
    undecided = tmp.write(met.groupBy("task").applyInArrow(lambda t: _undecided(t, tables, least, most), Undecided.SCHEMA))
    # Meetings are dealt anew to tasks of about TASK_SHINGLES.
    met = tmp.write(undecided.join(tmp.write(apart.select("key", "root").distinct().join(sizes, "key")), "key"))
    tasks = ceil((met.agg(F.sum("size")).first()[0] or 0) / TASK_SHINGLES) + 1
    met = met.withColumn("meeting", F.xxhash64("task", "meeting")).withColumn("task", F.pmod("meeting", F.lit(tasks))).join(texts, "key")
    links = tmp.write(met.groupBy("task").applyInArrow(lambda t: _verified(t, shingle, percent), "a binary, b binary"))
    found = _closed(spark, found, links, tmp)

    linked = narrow.groupBy("key").agg(F.min("doc_id").alias("least")).join(found.withColumnRenamed("node", "key"), "key", "left")
    linked = linked.withColumn("root", F.coalesce("root", "key"))
    linked = tmp.write(linked)
    least = tmp.write(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    answer = tmp.write(linked.join(least, "root").select("key", "component_id"))
    empty = F.col("n_shingles") == 0
    out = narrow.join(answer, "key").select(
        "doc_id",
        "n_shingles",
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("key").alias("_key"),
    )
    out = tmp.write(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), keep=True)
    tmp.drop()
    return out


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with the columns of ``docs``: one of each near-duplicate component.

    Of rows that repeat the kept doc_id with the same text, one stays.  Documents without words stay.
    """
    text, key = options.get("text_col", "text"), options.get("id_col", "doc_id")
    kept = near_duplicates(docs, **options).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("_key").alias("kept_key"), (F.col("n_shingles") > 0).alias("words")).distinct()
    mine = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_key(F.col(text)).alias("key"), F.col(key).alias("id"))
    out = mine.join(kept, (F.col("key") == F.col("kept_key")) & F.col("id").eqNullSafe(F.col("kept_id"))).select("row", "key", "id", "words")
    return out.where("words").dropDuplicates(["id", "key"]).union(out.where("NOT words")).select("row.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, shingle=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.y FROM r JOIN l ON r.seen = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""
