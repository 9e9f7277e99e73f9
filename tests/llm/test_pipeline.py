"""The registered queries, the pipeline, and what it must leave alone."""

import collections
import random
import sys
import zlib
from pathlib import Path
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from chorusframe.llm import common, minhash, mixing, packing, pii, quality
from chorusframe.llm import queries as llm

sys.path.insert(0, str(Path(__file__).parent))
from test_dedup import brute_components  # noqa: E402
from test_texts import DOCS, brute_spans, brute_taken, hashed  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = llm.queries()[name](spark, SF)
    rel = con.sql(llm.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in sorted(rel.columns)]
    near = lambda v: round(v, 9) if isinstance(v, float) else v
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted((str([near(r[c]) for c in sorted(df.columns)]) for r in df.collect())) == sorted(str([near(r[i]) for i in at]) for r in rel.fetchall())


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names, counts = [n for n, _ in corpus_pipeline.STAGES], []
    assert names == ["quality", "near_dedup", "pii", "mixing", "packing"]
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, SF)
        if name != "packing":
            assert out.columns == docs.columns
        frame = spark.createDataFrame(out.collect(), out.schema)
        counts.append(frame.count())
    score = quality.quality(docs, labels)
    good = score.where("predicted = 1").select("doc_id")
    assert counts[0] == good.count()
    first = docs.join(good, "doc_id")
    kept = minhash.near_duplicates(first).where("kept")
    assert counts[1] == kept.count() == counts[2]
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    clean = [r for r in score.collect() if known.get(r["doc_id"]) == 1]
    assert sum(r["predicted"] for r in clean) / len(clean) > 0.97
    sizes = collections.Counter()
    for r in frame.collect():
        sizes[r["sequence_id"]] += r["length"]
    assert all(n == packing.LENGTH or n & (n - 1) == 0 for n in sizes.values())


def test_run_matches_brute_force(spark, tmp_path):
    """run() on a small fixture against plain Python: each stage recomputed from its predecessor's plain rows."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    junk = lambda: " ".join("".join(rng.choice("ABC#$%!") for _ in range(5)) for _ in range(60))
    texts = [junk() if i % 5 == 0 else prose(rng.randint(30, 160)) for i in range(120)]
    for i in range(20):  # exact and near copies
        a = 5 * i + 1
        texts.append(texts[a] if i % 2 else " ".join([*texts[a].split()[:-1], "changed."]))
    texts += [f"{prose(20)} write to ann{i % 4}@example{i % 3}.com or call +1 212 555 0{100 + i} now {prose(20)}" for i in range(20)] + ["", None]
    rows = [(i, t, "en", "abc"[i % 3] if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(not (i < 120 and i % 5 == 0)), 0) for i in range(140)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    # Quality: the classes' laws from the labelled rows that may be learnt from.
    x = {i: np.array(quality.statistics((t or "").encode())) for i, t, *_ in rows}
    learn = [np.array([x[i] for i, y, _ in labels if y == k and zlib.crc32(str(i).encode()) % 3 != 1]) for k in (0, 1)]
    model = quality.Discriminant.fit(np.array([float(len(m)) for m in learn]), np.array([m.sum(axis=0) for m in learn]), np.array([m.T @ m for m in learn]))
    good = [r for r in rows if model.score(x[r[0]][None])[0] >= 0.5]
    assert 100 < len(good) < len(rows)
    # Near-duplicates: components by plain shingle sets.
    least = {i: c for i, _, c in brute_components([(r[0], r[1]) for r in good], 5, 80)}
    kept = [r for r in good if least[r[0]] == r[0]]
    assert len(good) - len(kept) >= 10
    # Personal data: plain spans, by start, the first where they overlap.
    _, spans = brute_spans([r[1] or "" for r in kept], pii.SHARE, pii.ACCEPT)
    clean = []
    for (i, t, lang, source, n), found in zip(kept, spans, strict=True):
        out, at = [], 0
        for a, b, k in found:
            if a >= at:
                out += [(t or "")[at:a], f"[{pii.KINDS[k].upper()}]"]
            at = max(at, b)
        clean.append((i, t if t is None else "".join([*out, t[at:]]), lang, source, n))
    assert sum("[EMAIL]" in (r[1] or "") and "[PHONE]" in r[1] for r in clean) >= 15
    # Mixing: how many words of each document, whole copies first.
    frame = spark.createDataFrame(clean, DOCS)
    sized = hashed(spark, frame)
    taken, _, _ = brute_taken(sized, (5, 2, 1), mixing.BLOCK_WORDS)
    want = collections.Counter()
    slow = packing.tokenizer("byte_bpe_50k.json").slow
    by_id = {r[0]: r[1] for r in clean}
    ids = lambda t: (*slow.encode(t, add_special_tokens=False).ids, 1)
    for (_, size, (_, _, i)), words in zip(sized, taken, strict=True):
        for _ in range(words // size if size else 0):
            want[i, ids(by_id[i])] += 1
        if size and words % size:
            want[i, ids(" ".join(by_id[i].split()[: words % size]))] += 1
    # Packing: every token of every copy once, sequences full or of a power of two.
    cells, whole = collections.Counter(), collections.Counter()
    for p in got:
        part = np.frombuffer(bytes(p["ids"]), "<u4")
        assert zlib.crc32(bytes(p["ids"])) == p["ids_crc32"] and len(part) == p["length"]
        cells.update((p["doc_id"], p["start"] + k, p["doc_tokens"], int(v)) for k, v in enumerate(part))
    for (i, tokens), n in want.items():
        whole.update({(i, k, len(tokens), v): n for k, v in enumerate(tokens)})
    assert cells == whole
    length = collections.Counter()
    for p in got:
        length[p["sequence_id"]] += p["length"]
    assert all(n == packing.LENGTH or n & (n - 1) == 0 for n in length.values())


def test_stages_of_an_empty_table(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://h:7077", "local-cluster[2,1,512]", "yarn"):
        spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master))
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(spark)


def test_release_removes_what_results_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "_kept", {})
    frame = common.Scratch(spark).write(spark.range(3), keep=True)
    path = common._kept[spark.sparkContext.applicationId][0]
    assert frame.count() == 3 and Path(path.removeprefix("file://")).exists()
    common.release(spark)
    assert not Path(path.removeprefix("file://")).exists()


def test_entry_has_the_fourteen_queries():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
