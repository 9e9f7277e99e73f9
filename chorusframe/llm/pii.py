"""Personal data by weak supervision.

Base patterns give spans that always stay.  Looser patterns give further candidates, such as a card inside a
digit run that fails as a whole.  Labelers of three kinds vote on every span: patterns and checksums, gazetteers and
context words.  Gazetteers and context words are read off the whole corpus: an entry (a mail domain, a card
prefix, a calling code, a network; a word in front of a span) belongs to its kind's list if it holds at least
SHARE of the kind's base spans and FEW of them, so a list has at most 1 / SHARE entries (context words: NEAR times that) however
large the corpus is.  Expectation-maximisation over the vote patterns of the whole corpus estimates how reliable
each labeler is, and a logistic span classifier over votes, span shape, separators and the word in front is trained
on the resulting probabilities.  Both work on the counts of distinct patterns, of which there are at most
len(KINDS) * 3**LABELERS * SHAPES, whatever the corpus size.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Scratch, in_slices

KINDS = ("email", "ip", "card", "phone")
LABELERS, FORMS, SEPARATORS, FRONTS = 5, 16, 4, 16
SHAPES = FORMS * SEPARATORS * FRONTS
ACCEPT = 0.8
#: An entry's least share of its kind's base spans, and their least number; words in front of a span that count; how much more often than before other kinds.
SHARE, FEW, NEAR, LIFT = 1 / 2000, 5, 4, 2.0

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
# Looser candidates.
_LOOSE = (
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}|3[0-9]{3}([ -]?)[0-9]{6}\2[0-9]{5})(?![0-9])")),
    ("phone", re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|(?<![0-9])[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]{1,63}){1,8}")),
)
_HINT = re.compile(r"[0-9][ )(.-]?[0-9]|[(\[]at[)\]]")
# Words that speak for a kind in any corpus, and those that speak against all; the corpus adds its own.
_PRIVATE = ("0.", "10.", "127.", "192.168.", "255.")
_CONTEXT = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "address", "server", "host", "login", "client"),
    "card": ("card", "visa", "mastercard", "karte", "tarjeta", "carte", "payment", "credit"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "telefon", "contact"),
}
_AGAINST = ("version", "token", "license", "release", "isbn", "order", "section", "chapter", "id")
_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[^A-Za-z0-9]+")
Lists = tuple[frozenset, frozenset]  # (kind, entry) and (kind, word)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The base pattern, led by its @ signs, so that a long run of letters costs no more than its length."""
    end, at = 0, text.find("@")
    while at >= 0:
        left = text[end:at]
        local = len(left) - len(left.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if local else None
        if found:
            yield at - local, found.end()
            end = found.end()
        else:
            end = max(end, at + 1)  # what stands before this @ can begin no match
        at = text.find("@", max(end, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Four parts at a time of each dotted run of numbers, from its left."""
    for m in _DOTTED.finditer(text):
        part, at = m.group().split("."), m.start()
        for k in range(0, len(part) - 3, 4):
            four = part[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind number)`` of the base patterns, by start, then kind."""
    out = [(a, b, 0) for a, b in _emails(text)]
    out += [(a, b, 1) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def further_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Looser candidates that overlap neither a base span nor one another."""
    taken: list[tuple[int, int]] = []  # disjoint, by start
    for start, end in sorted((a, b) for a, b, _ in base):
        if taken and start < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(end, taken[-1][1]))
        else:
            taken.append((start, end))
    out = []
    for name, pattern in _LOOSE:
        for m in pattern.finditer(text):
            at = bisect.bisect_left(taken, (m.end(), -1))  # the last one that begins before this one's end
            if not at or taken[at - 1][1] <= m.start():
                out.append((m.start(), m.end(), KINDS.index(name)))
                taken.insert(at, (m.start(), m.end()))
    return sorted(out)


def entry(span: str, kind: int) -> str:
    """What a span would be listed under: mail domain, network, first six digits of a card, calling code with area."""
    if kind == 0:
        at = re.split(r"@| ?[(\[]at[)\]] ?", span, maxsplit=1)[-1]
        return ".".join(x for x in re.split(r"\.| ?[(\[]dot[)\]] ?", at.lower()) if x)
    if kind == 1:
        return ".".join(p.lstrip("0") or "0" for p in span.split(".")[:2])
    digits = _NOT_DIGIT.sub("", span)
    if kind == 2:
        return digits[:6]
    return next(x for x in _SPLIT.split(span) if x)[:4] if span[0] == "+" else digits[:3]


def in_front(text: str, start: int) -> list[str]:
    """The last NEAR words among the 48 characters before a span, lower-cased."""
    return _WORD.findall(text[max(0, start - 48) : start].lower())[-NEAR:]


def traits(text: str, start: int, end: int, kind: int) -> tuple[str, list[str], int]:
    """A span's entry, the words in front of it, and what it shows by itself: form, checksum, border and gazetteer votes, shape."""
    name, span = KINDS[kind], text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    known = 0
    # Strict form.
    if name == "email":
        form = 1 if "@" in span else -1 if len(span) > 100 else 0
        check = 1 if 0 < len(re.split(r"@| ?[(\[]", span, maxsplit=1)[0]) <= 64 and ".." not in span else -1
    elif name == "ip":
        part = span.split(".")
        form = 1 if all(len(p) <= 3 and (p == "0" or p[0] != "0") for p in part) else -1
        check = 1 if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in part) else -1
        known = -1 if span.startswith(_PRIVATE) else 0
    elif name == "card":
        form = 1 if len(digits) in (15, 16) else 0
        check = 1 if luhn(digits) else -1
    else:
        form = 1 if span[0] == "+" or span[0] == "(" else 0
        check = 1 if 10 <= len(digits) <= 15 and len(set(digits)) > 2 else -1
    edge = text[start - 1 : start] + text[end : end + 1]
    border = -1 if any(c.isalnum() or c in "\"'=_" for c in edge) else 1 if not edge.strip() else 0
    shape = min(len(digits) // 5, 3) * 4 + min(sum(not c.isalnum() for c in span), 3)
    between = set(span[1:]) & {" ", "-", "."}
    separator = 0 if not between else 1 if between == {" "} else 2 if between == {"-"} else 3
    words = in_front(text, start)
    front = 0 if not words else 1 + zlib.crc32(words[-1].encode()) % (FRONTS - 1)
    own = 0
    for v in (form, check, known, border):
        own = own * 3 + v + 1
    return entry(span, kind), words, own * SHAPES + (shape * SEPARATORS + separator) * FRONTS + front


def votes(kind: int, entry: str, words: list[str], own: int, lists: Lists) -> int:
    """The pattern of a span as one number: kind, five votes (against, none, for) and shape."""
    own, shape = divmod(own, SHAPES)
    form, check, known, border = own // 27, own // 9 % 3, own // 3 % 3, own % 3
    if known == 1 and (kind, entry) in lists[0]:
        known = 2
    context = 2 if any(w in _CONTEXT[KINDS[kind]] or (kind, w) in lists[1] for w in words) else 0 if any(w in _AGAINST for w in words) else 1
    code = kind
    for v in (form, check, known, context, border):
        code = code * 3 + v
    return code * SHAPES + shape


def _unpacked(code: int) -> tuple[int, list[int], int]:
    code, shape = divmod(code, SHAPES)
    v = []
    for _ in range(LABELERS):
        code, x = divmod(code, 3)
        v.append(x)
    return code, v[::-1], shape


def fit(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """Pattern -> probability of personal data, from how often each pattern occurs.

    EM: a class prior for each kind and each labeler's chances of its three votes given the class, smoothed,
    from a start at the mean vote.  Then logistic regression of the posteriors on kind, votes, form, separators and the word in front.
    """
    if not counts:
        return {}
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    kind, vote, shape = map(np.array, zip(*map(_unpacked, codes), strict=True))
    hot = np.eye(3)[vote]  # pattern, labeler, vote
    p = np.clip(0.5 + 0.4 * (vote - 1).mean(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        new = p.copy()
        for k in range(len(KINDS)):
            at = kind == k
            if not at.any():
                continue
            like = []
            for q in (p[at], 1 - p[at]):
                w = n[at] * q
                chance = (np.einsum("i,ilv->lv", w, hot[at]) + 1) / (w.sum() + 3)
                like.append(np.log((w.sum() + 1) / (n[at].sum() + 2)) + np.einsum("ilv,lv->i", hot[at], np.log(chance)))
            new[at] = 1 / (1 + np.exp(np.clip(like[1] - like[0], -50, 50)))
        p = new
    form, separator, front = shape // (SEPARATORS * FRONTS), shape // FRONTS % SEPARATORS, shape % FRONTS
    x = np.concatenate([np.eye(len(KINDS))[kind], hot.reshape(len(codes), -1), np.eye(FORMS)[form], np.eye(SEPARATORS)[separator], np.eye(FRONTS)[front]], axis=1)
    w, weight = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(100):  # Newton steps, ridge 1e-3
        s = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (weight * (s - p)) + 1e-3 * w
        hess = (x * (weight * s * (1 - s))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return {c: float(v) for c, v in zip(codes, 1 / (1 + np.exp(-np.clip(x @ w, -50, 50))), strict=True)}


_OWN = [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("entry", pa.string()), ("words", pa.list_(pa.string())), ("own", pa.int32())]
_FOUND = "array<struct<start:int,end:int,kind:int,entry:string,words:array<string>,own:int>>"


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    return base, further_spans(text, base) if _HINT.search(text) else []


def _structs(rows: list[list[tuple]], fields: list) -> pa.Array:
    return pa.array([[dict(zip((n for n, _ in fields), s, strict=True)) for s in row] for row in rows], pa.list_(pa.struct(fields)))


def _found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, text`` -> ``doc_id, base, more``: the candidates and their traits."""
    for batch in in_slices(it):
        base, more = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            for out, some in zip((base, more), candidates(text), strict=True):
                out.append([(*s, *traits(text, *s)) for s in some])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _structs(base, _OWN), _structs(more, _OWN)], names=["doc_id", "base", "more"])


def lists(found: DataFrame, share: float = SHARE, lift: float = LIFT) -> Lists:
    """Gazetteers and context words of all base spans, as sets of (kind, entry) and (kind, word).

    An entry is listed if it holds ``share`` of its kind's base spans, FEW at least; a word, if it stands in front of as many of them
    and ``lift`` times as often as in front of other kinds' base spans.  So there are at most 1 / share entries
    and NEAR / share words a kind, and only they come to the driver.
    """
    spans = found.select(F.explode("base").alias("s")).select("s.kind", "s.entry", F.array_distinct("s.words").alias("words"))
    whole = {r["kind"]: r["n"] for r in spans.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not whole:
        return frozenset(), frozenset()
    least = F.coalesce(*(F.when(F.col("kind") == k, F.lit(float(max(n * share, FEW)))) for k, n in whole.items()))
    entries = spans.groupBy("kind", "entry").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("kind", "entry").collect()
    by = spans.select("kind", F.explode("words").alias("word")).groupBy("word").agg(*(F.count_if(F.col("kind") == k).alias(f"n{k}") for k in whole))
    often = [F.col(f"n{k}") >= max(n * share, FEW) for k, n in whole.items()]
    some = by.where(functools.reduce(lambda a, b: a | b, often)).collect()
    words, total = [], sum(whole.values())
    for r in some:
        every = sum(r[f"n{k}"] for k in whole)
        for k, n in whole.items():
            if r[f"n{k}"] >= max(n * share, FEW) and r[f"n{k}"] / n >= lift * (every - r[f"n{k}"]) / max(total - n, 1):
                words.append((k, r["word"]))
    return frozenset((r["kind"], r["entry"]) for r in entries), frozenset(words)


def _patterns(known: Lists):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        for batch in it:
            for row in (*batch.column("base"), *batch.column("more")):
                for s in row.as_py():
                    code = votes(s["kind"], s["entry"], s["words"], s["own"], known)
                    count[code] = count.get(code, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int32()), pa.array(list(count.values()), pa.int64())], names=["pattern", "n"])

    return run


def train(found: DataFrame, at_least: float = ACCEPT) -> tuple[Lists, frozenset[int]]:
    """The lists and the patterns of further spans that the trained classifier accepts.  The driver gets bounded counts only."""
    known = lists(found)
    count = found.mapInArrow(_patterns(known), "pattern int, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return known, frozenset(c for c, p in fit({r["pattern"]: r["n"] for r in count}).items() if p >= at_least)


def find_spans(docs: DataFrame, at_least: float = ACCEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, base, spans``, arrays of ``(start, end, kind)`` in code points, end exclusive.

    ``base`` has the spans of the base patterns; ``spans`` has those and the accepted further ones, which overlap
    neither.  A null text is empty; rows that repeat a doc_id are searched each; an empty table gives no
    rows; further columns are ignored.
    """
    tmp = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = tmp.write(rows.mapInArrow(_found, f"doc_id {kind}, base {_FOUND}, more {_FOUND}"), keep=True)
    known, good = train(found, at_least)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            base, spans = [], []
            for b, m in zip(batch.column("base"), batch.column("more"), strict=True):
                b = [(s["start"], s["end"], s["kind"]) for s in b.as_py()]
                more = [(s["start"], s["end"], s["kind"]) for s in m.as_py() if votes(s["kind"], s["entry"], s["words"], s["own"], known) in good]
                base.append(b)
                spans.append(sorted(b + more, key=lambda s: (s[0], s[2])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _structs(base, _OWN[:3]), _structs(spans, _OWN[:3])], names=["doc_id", "base", "spans"])

    spans = "array<struct<start:int,end:int,kind:int>>"
    return found.mapInArrow(run, f"doc_id {kind}, base {spans}, spans {spans}")


def accepted_spans(text: str, known: Lists, good: frozenset[int]) -> list[tuple[int, int, int]]:
    """The base spans with the accepted further ones, by start, then kind."""
    base, more = candidates(text)
    return sorted(base + [s for s in more if votes(s[2], *traits(text, *s), known) in good], key=lambda s: (s[0], s[2]))


def masker(known: Lists, good: frozenset[int]) -> Callable[[str], str]:
    def mask(text: str) -> str:
        out, at = [], 0
        for start, end, kind in accepted_spans(text, known, good):
            if start >= at:
                out += [text[at:start], f"[{KINDS[kind].upper()}]"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    return mask


def redact(docs: DataFrame, at_least: float = ACCEPT, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; null texts stay null, other columns as they are."""
    tmp = Scratch(docs.sparkSession)
    rows = docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_found, f"doc_id int, base {_FOUND}, more {_FOUND}")
    known, good = train(tmp.write(rows.where("size(base) + size(more) > 0")), at_least)
    tmp.drop()
    place = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = masker(known, good)
        for batch in in_slices(it):
            text = pa.array([None if t.as_py() is None else mask(t.as_py()) for t in batch.column(place)], pa.string())
            yield pa.RecordBatch.from_arrays([text if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    plain = [f"c{i}" for i in range(len(docs.columns))]  # mapInArrow can't take names with dots
    schema = StructType([StructField(c, f.dataType) for c, f in zip(plain, docs.schema.fields, strict=True)])
    return docs.toDF(*plain).mapInArrow(run, schema).toDF(*docs.columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    name = F.array(*(F.lit(k) for k in KINDS))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *(count(k) for k in range(len(KINDS))), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
