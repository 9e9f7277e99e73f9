"""Fill-in-the-middle: a text is cut in three and written so that its middle comes last.

A text is matched once as (unit)* by the regex library, which keeps every repetition of the group.  The group's
ends are the offsets of all units: their number is n, and both cuts are looked up among them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_slices

#: Units that a text can be cut between; any other pattern that never matches the empty text can be given.
CODE_POINT, GRAPHEME, WORD_AND_SPACE = r"(?s:(.))*", r"(\X)*", r"(\s*+\S++(?:\s++$)?+)*"
MARKS = ("<P>", "<S>", "<M>")
#: Units of one match.  The library keeps some 200 bytes for each while it matches; texts of more units are matched in blocks, each from where the last ended.
BLOCK = 1_000_000


def unit_ends(pattern, text: str) -> list[int] | None:
    """Where each unit ends, or None where units don't make up the whole text."""
    if len(text) <= BLOCK:
        found = pattern.fullmatch(text)
        return found.ends(1) if found else None
    few, ends = _blocks(pattern.pattern), []
    while not ends or ends[-1] < len(text):
        found = few.match(text, ends[-1] if ends else 0)
        if not found or not found.group():
            return None
        ends += found.ends(1)
    return ends


def _blocks(pattern: str):
    import regex

    return regex.compile(f"{pattern[:-1]}{{0,{BLOCK}}}")


def draws(seed: int, doc_id: object) -> list[int]:
    """Four numbers below 2**32 from the seed and the id; a null id is the empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def fill_in_middle(
    docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, unit: str = CODE_POINT, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``n`` counts the text's units.  The prefix ends after the smaller and the middle after the larger of two draws
    from 0 to n; ``psm`` is prefix, suffix, middle, ``spm`` suffix, prefix, middle, each behind its mark.  ``plain`` keeps
    the text: empty and null texts, those that hold a mark, ``plain_percent`` of the others, and texts that are not made up
    of whole units (null ``n``).  Lengths are in code points, null for plain.  Draws depend on seed and id alone, so rows that
    repeat an id are cut by the same draws; a null id draws as the empty string.  Texts of more than BLOCK units are
    matched in blocks.  An empty table gives no rows; further columns are ignored, whatever their names.
    """
    import regex

    if not unit.endswith("*") or regex.fullmatch(unit[:-1], "") or regex.compile(unit).groups != 1:
        raise ValueError("unit is a pattern (...)* of one group, and what it repeats never matches the empty text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    pre, suf, mid = marks

    def cut(pattern, doc_id: object, text: str) -> tuple:
        ends = unit_ends(pattern, text)
        n = None if ends is None else len(ends)
        h1, h2, h3, h4 = draws(seed, doc_id)
        if not n or h3 % 100 >= 100 - plain_percent or any(m in text for m in marks):
            return n, "plain", None, None, text
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (ends[k - 1] if k else 0 for k in (low, high))
        if h4 % 100 < spm_percent:
            return n, "spm", a, b - a, f"{suf}{text[b:]}{pre}{text[:a]}{mid}{text[a:b]}"
        return n, "psm", a, b - a, f"{pre}{text[:a]}{suf}{text[b:]}{mid}{text[a:b]}"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pattern = regex.compile(unit)
        for batch in in_slices(it):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            cuts = list(zip(*(cut(pattern, i, t or "") for i, t in zip(ids, texts, strict=True)), strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, cuts, kinds)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from: its parts, split at the marks, in their first order."""
    pre, suf, mid = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        one = F.substring_index(output, second, 1)
        two = F.substring_index(output, mid, 1)
        return F.substr(one, F.lit(len(first) + 1)), F.substr(two, F.char_length(one) + len(second) + 1), F.substr(output, F.char_length(two) + len(mid) + 1)

    p, s, m = parts(pre, suf)
    psm = F.concat(p, m, s)
    s, p, m = parts(suf, pre)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(p, m, s)).otherwise(output)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
