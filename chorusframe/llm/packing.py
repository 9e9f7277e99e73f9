"""Mixture-controlled packing: deficit round-robin over the sources' token queues fills every window.

In each round a source's counter grows by its quantum, its weight's share of a window's tokens.  In turn, every
source gives the whole tokens of its counter and carries the fraction, its deficit, to the next round; a source that
has run out is passed over.  Windows are cut from this stream of turns every ``length`` tokens: where a round's whole
tokens leave a window short, the next round goes on filling it, and a turn that a window's end cuts goes on in the next
window.  Counters after any round have a closed form, so a window's quotas follow from its number (see Schedule): tasks
need no common state, deficits cross windows and partitions, and no window is filled twice.

Each document is tokenised once.  Its place in its source's queue is a sum over earlier tasks plus the tokens
before it in its own task; only those sums (a row for each task and source) are shuffled.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, in_slices

LENGTH, END = 2048, 1
#: Sources the driver may hold (a row each); more is an error.
MAX_SOURCES = 100_000
_tokenizers: dict[str, "ByteTokenizer"] = {}


def plain(spec: dict) -> bool:
    """Whether a file of ``tokenizers`` is byte-level BPE with the common split pattern and merges in the vocabulary's order, and nothing else."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or spec.get("truncation") or spec.get("padding"):
        return False
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    if any(x.get(k) for x in spec.get("added_tokens") or [] for k in ("lstrip", "rstrip", "single_word", "normalized")):
        return False
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    special = {x["content"] for x in spec.get("added_tokens") or []}
    made = sum(1 for k in model["vocab"] if len(k) > 1 and k not in special)
    return merged == sorted(merged) and len(set(merged)) == len(merged) == made and (not merged or merged[0] >= 0)


class ByteTokenizer:
    """Ids of a byte-level BPE file of the ``tokenizers`` library, as its ``encode(text, add_special_tokens=False)`` gives them.

    Ordinary text goes through ``tiktoken`` with the file's own vocabulary as ranks, which gives the same ids
    several times faster.  Text with a special token's string, or with a run of white space so long that
    ``tiktoken`` would run out of stack, goes through ``tokenizers``.  Long texts are encoded in parts of about
    PART characters, cut before a space between two letters: no token crosses such a place.

    That holds for files that split and merge as ``plain`` asks.  Any other file of ``tokenizers`` (normalisers, word ends,
    other patterns, merges out of the vocabulary's order) encodes every text whole with ``tokenizers`` itself.
    """

    PART, RUN = 1 << 18, 100_000
    _CUT, _RUN = re.compile(r"[A-Za-z](?= [A-Za-z])"), re.compile(r"(?<!\s)\s{100000}")

    def __init__(self, path: str):
        import json

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        self.fast, self.most = None, max(self.slow.get_vocab(with_added_tokens=True).values(), default=0)
        if not plain(spec):
            return
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items()}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > self.PART:
            cut = self._CUT.search(text, at + self.PART)
            if cut is None:
                break
            yield text[at : cut.end()]
            at = cut.end()
        yield text[at:]

    def encode(self, text: str) -> list[int]:
        if self.fast is None:
            return self.slow.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        for part in self.parts(text):
            if any(s in part for s in self.special) or len(part) >= self.RUN and self._RUN.search(part):
                out += self.slow.encode(part, add_special_tokens=False).ids
            else:
                out += self.fast.encode_ordinary(part)
        return out


def tokenizer(path: str) -> ByteTokenizer:
    """One for each Python worker.  A name without a slash is a file of public_tokenizers."""
    if path not in _tokenizers:
        import public_tokenizers

        _tokenizers[path] = ByteTokenizer(path if "/" in path else public_tokenizers.path(path))
    return _tokenizers[path]


def _tokens(it: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    """``doc_id, source, text`` -> ``doc_id, source, task, before, n, ids``; ids are little-endian, two bytes each where every id fits, else four."""
    from pyspark import TaskContext

    task, t, used = TaskContext.get().partitionId(), tokenizer(path), {}
    width = "<u2" if max(t.most, end) < 1 << 16 else "<u4"
    for batch in in_slices(it):
        before, n, ids = [], [], []
        for text, source in zip(batch.column("text"), batch.column("source").to_pylist(), strict=True):
            own = np.array([*t.encode(text.as_py() or ""), end], width)
            before.append(used.get(source, 0))
            used[source] = before[-1] + len(own)
            n.append(len(own))
            ids.append(own.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), pa.array([task] * len(n), pa.int64()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
            names=["doc_id", "source", "task", "before", "n", "ids"],
        )


class Schedule:
    """Which tokens of which source make up each sequence: deficit round-robin, each token a packet.

    Counters are kept in units of 1 / UNIT token.  After r rounds source j has given min(size, r * quantum // UNIT)
    tokens; r * quantum % UNIT units are its deficit.  Sources of weight 0 come after all others, one by one.
    """

    UNIT, BITS = 1 << 20, 20

    def __init__(self, sizes: Sequence[int], weights: Sequence[int], length: int = LENGTH):
        self.sizes, self.length, self.total = np.array(sizes, np.int64), length, sum(sizes)
        paid = [n > 0 and w > 0 for n, w in zip(sizes, weights, strict=True)]
        whole = sum(w for w, p in zip(weights, paid, strict=True) if p)
        self.quantum = np.array([max(1, int(length * self.UNIT * w // whole)) if p else 0 for w, p in zip(weights, paid, strict=True)], np.int64)
        # The round in which each source gives its last token.
        last = [-(-int(n) * self.UNIT // int(q)) if q else 0 for n, q in zip(sizes, self.quantum, strict=True)]
        if max(last, default=0) >= 1 << 62 or length > 1 << 22:
            raise ValueError("a source's weight is too small for its size, or the windows are too long")
        self.last, self.rounds = np.array(last, np.int64), max(last, default=0)
        self.paid_total = int(self.sizes[self.quantum > 0].sum())
        full, rest = divmod(self.total, length)
        self.full, self.tail = full, [full * length]
        for bit in reversed(range(rest.bit_length())):  # the rest fills sequences whose lengths are powers of two
            if rest >> bit & 1:
                self.tail.append(self.tail[-1] + (1 << bit))
        self.windows = full + len(self.tail) - 1
        self.block, self.blocks = max(1, min(256, (1 << 16) // max(len(sizes), 1))), {}

    def edge(self, window: int) -> int:
        return window * self.length if window <= self.full else self.tail[window - self.full]

    def after(self, rounds: np.ndarray) -> np.ndarray:
        """How many tokens each source with a weight (last axis) has given after so many rounds."""
        r = np.minimum(np.asarray(rounds, np.int64)[..., None], self.last)
        return np.minimum(self.sizes, (r >> self.BITS) * self.quantum + ((r & self.UNIT - 1) * self.quantum >> self.BITS))

    def given(self, at: np.ndarray) -> np.ndarray:
        """How many tokens each source (second axis) has given when ``at`` (first axis) are served."""
        at = np.asarray(at, np.int64)
        free = np.where(self.quantum == 0, self.sizes, 0)
        out = self.after(np.full(len(at), self.rounds)) + np.clip((at - self.paid_total)[:, None] - (np.cumsum(free) - free), 0, free)
        some = np.flatnonzero(at < self.paid_total)
        if len(some):
            at = at[some]
            low, high = at // self.length, np.full(len(at), self.rounds)  # a round gives at most a window's tokens
            while (high - low > 1).any():
                mid = (low + high) // 2
                less = self.after(mid).sum(axis=1) <= at
                low, high = np.where(less, mid, low), np.where(less, high, mid)
            done = self.after(low)
            turn = self.after(low + 1) - done
            out[some] = done + np.clip((at - done.sum(axis=1))[:, None] - (np.cumsum(turn, axis=1) - turn), 0, turn)
        return out

    def window(self, w: int, j: int) -> tuple[int, int, int]:
        """Window w's first and end place in the queue of source j, and its offset.  Many windows are worked out at once: others will be asked for."""
        block, i = divmod(w, self.block)
        if block not in self.blocks:
            if len(self.blocks) * self.block * len(self.sizes) > 1 << 22:  # every source may be at a window of its own
                self.blocks.clear()
            edges = [self.edge(x) for x in range(block * self.block, min((block + 1) * self.block, self.windows) + 1)]
            g = self.given(edges)
            part = g[1:] - g[:-1]
            self.blocks[block] = g, np.cumsum(part, axis=1) - part
        g, offset = self.blocks[block]
        return int(g[i, j]), int(g[i + 1, j]), int(offset[i, j])

    def find(self, j: int, place: int) -> int:
        """The window that token ``place`` of source j is in, from the number of tokens served before it."""
        if self.quantum[j]:
            turn = -(-(place + 1) * self.UNIT // int(self.quantum[j]))
            done, then = self.after(turn - 1), self.after(turn)
            before = int(done.sum()) + int((then - done)[:j].sum()) + place - int(done[j])
        else:
            before = self.paid_total + int(self.sizes[:j][self.quantum[:j] == 0].sum()) + place
        if before < self.tail[0]:
            return before // self.length
        return self.full + bisect.bisect_right(self.tail, before) - 1


def _pieces(it: Iterator[pa.RecordBatch], sources: list[str | None], plan: Schedule, with_ids: bool) -> Iterator[pa.RecordBatch]:
    index = {s: j for j, s in enumerate(sources)}
    here: dict[int, tuple[int, int, int, int, int]] = {}  # source -> window, its first and end place in the queue, offsets

    def window(j: int, w: int) -> tuple[int, int, int, int]:
        return w, *plan.window(w, j)

    for batch in in_slices(it, 1 << 20):
        rows, out = batch.to_pydict(), {k: [] for k in ("doc", "start", "length", "crc", "n", "seq", "offset", "ids")}
        for i, (source, place, n) in enumerate(zip(rows["source"], rows["place"], rows["n"], strict=True)):
            j, data = index[source], np.frombuffer(rows["ids"][i], f"<u{len(rows['ids'][i]) // n}").astype("<u4").tobytes()
            w = here.get(j)
            if w is None or not w[1] <= place < w[2]:
                w = window(j, w[0] + 1) if w is not None and w[2] == place else None
                if w is None or not w[1] <= place < w[2]:
                    w = window(j, plan.find(j, place))
            done = 0
            while done < n:
                if w[2] <= place + done:
                    w = window(j, w[0] + 1)
                if w[2] <= place + done:
                    w = window(j, plan.find(j, place + done))
                take = min(n - done, w[2] - place - done)
                piece = data[4 * done : 4 * (done + take)]
                out["doc"].append(i)
                out["start"].append(done)
                out["length"].append(take)
                out["crc"].append(zlib.crc32(piece))
                out["n"].append(n)
                out["seq"].append(w[0])
                out["offset"].append(w[3] + place + done - w[1])
                out["ids"].append(piece if with_ids else None)
                done += take
            here[j] = w
        for at in range(0, len(out["doc"]), 20000):
            cut = {k: v[at : at + 20000] for k, v in out.items()}
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(cut["doc"], pa.int64())), *(pa.array(cut[k], pa.int64()) for k in ("start", "length", "crc", "n", "seq", "offset")), pa.array(cut["ids"], pa.binary())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )


def running_before(df: DataFrame, key: str, order: str, value: str, chunk: int = 1024) -> DataFrame:
    """``value`` summed over the rows of the same key with a smaller ``order``, in two levels so that no task gets all rows of a key."""
    block = F.floor(F.col(order) / chunk)
    inner = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_block", block)
    blocks = rows.groupBy(key, "_block").agg(F.sum(value).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(outer), F.lit(0)))
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0))).alias("r")
    blocks = blocks.select(F.col(key).alias("_key"), F.col("_block").alias("_b"), "_base")
    on = F.col(f"r.{key}").eqNullSafe(F.col("_key")) & (F.col("r._block") == F.col("_b"))
    return rows.join(blocks, on).select("r.*", (F.col("_in") + F.col("_base")).alias("before")).drop("_block", "_in")


def pack(
    docs: DataFrame, weights: dict[str | None, int] | tuple[int, ...] | None = None, path: str = "byte_bpe_50k.json", length: int = LENGTH, end: int = END, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, ``with_ids``, ``ids``
    (little-endian uint32).

    Sequences hold ``length`` tokens without gaps; the last ``total % length`` tokens fill shorter ones whose
    lengths are powers of two, so nothing is padded.  ``weights`` are the target proportions: whole numbers by
    source (a source not named weighs 0 and comes after the others), or numbers that sources by code point, null
    last, take in turn.  By default each source weighs its tokens, which keeps the proportions of a table that
    has its mix already.  A null text is
    empty and gives the end id alone; null is a source of its own; rows that repeat a doc_id are packed each;
    an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    tokens = tmp.write(base.mapInArrow(lambda it: _tokens(it, path, end), f"doc_id {id_type}, source string, task bigint, before bigint, n bigint, ids binary"), keep=True)
    sums = tmp.write(tokens.groupBy("source", "task").agg(F.sum("n").alias("n")))
    totals = sums.groupBy("source").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    names, sizes = [r.source for r in totals], [r.n for r in totals]
    if weights is None:
        shares = sizes
    elif isinstance(weights, dict):
        shares = [weights.get(s, 0) for s in names]
    else:
        shares = [weights[i % len(weights)] for i in range(len(names))]
    plan = Schedule(sizes, shares, length)
    offsets = tmp.write(running_before(sums, "source", "task", "n").select(F.col("source").alias("_source"), F.col("task").alias("_task"), F.col("before").alias("_base")), keep=True)
    placed = tokens.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("task") == F.col("_task")))
    placed = placed.select("doc_id", "source", (F.col("before") + F.col("_base")).alias("place"), "n", "ids")
    tmp.drop()
    out = placed.mapInArrow(
        lambda it: _pieces(it, names, plan, with_ids), f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    )
    return out if with_ids else out.drop("ids")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), weights=(5, 2, 1), with_ids=False)
