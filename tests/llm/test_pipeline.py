"""The corpus pipeline on small tables of its own: nulls, repeats, empty tables, clashing names."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shoebox.llm import quality, queries

from .test_text_operators import DOCS, edited, has_data, prose, word_list

NAMES = ["quality_classifier", "near_dedup", "substring_dedup", "benchmark_decontamination", "packing"]


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES and corpus_pipeline.ORACLE_SQL is None


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of documents (with given extra columns), labels and benchmark."""

    def write(docs, labels=(), items=(), **extra):
        d = spark.createDataFrame(docs, DOCS)
        for name, value in extra.items():
            d = d.withColumn(name, value)
        d.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def staged(spark, sf):
    """What each stage returns, one upon the other."""
    docs, out = queries.table(spark, sf, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, sf), name)
        out[name] = docs
    return out


def corpus(r):
    """Documents, labels and items: clean prose, junk, copies, a shared passage, benchmark passages, null and repeated ids."""
    clean = [prose(r.randrange(80, 200), r) for _ in range(60)]
    junk = [" | ".join(w.upper() + "$$$" for w in prose(60, r).split()) for _ in range(30)]
    passage, item = prose(70, r), prose(30, r)
    texts = clean + junk + [clean[0], edited(clean[1], 1, r), f"{prose(60, r)} {passage} {prose(60, r)}", f"{prose(60, r)} {passage} {prose(60, r)}", f"{prose(60, r)} {item} {prose(50, r)}", f"{prose(60, r)} {edited(item, 2, r)} {prose(50, r)}"]
    docs = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    n = len(texts)
    docs += [(None, prose(90, r), None, None, None), (None, None, "en", "s", 0), (n, "", "en", "s", 0), (n + 1, None, None, None, None), (5, clean[5], "en", "s", len(clean[5])), (n + 2, f"{prose(40, r)} {item}", "en", "s", 1)]
    labels = [(k, int(k < 60), 0) for k in range(90)] + [(None, 1, 1), (3, 1, 0), (n + 50, 0, 0)]
    return docs, labels, [(1, item), (1, item), (2, None), (3, "")], passage


def test_each_stage_does_its_part(spark, tables):
    docs, labels, items, passage = corpus(random.Random(3))
    sf = tables(docs, labels, items, kept=F.lit("mine"), label=F.lit(1), repeats=F.lit(2.0), sequence_id=F.lit("x"))
    got = staged(spark, sf)
    columns = queries.table(spark, sf, "documents").columns
    for name in NAMES[:-1]:
        assert got[name].columns == columns
    rows = {name: got[name].collect() for name in NAMES}
    model = quality.fit(queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels"))
    good = [s >= quality.THRESHOLD for s in model.score(quality.statistics(__import__("pyarrow").array([d[1] for d in docs])))]
    first = sorted((d[0] is None, d[0] or 0, d[1] or "") for d, g in zip(docs, good, strict=True) if g)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in rows["quality_classifier"]) == first
    ids = {name: [r["doc_id"] for r in rows[name]] for name in NAMES[:-1]}
    assert len([k for k in ids["quality_classifier"] if k is not None and 60 <= k < 90]) == 0 and set(range(60)) <= set(ids["quality_classifier"])
    # of copies, near copies and repeated rows one stays, rows without an id all do
    near = ids["near_dedup"]
    assert set(ids["quality_classifier"]) - set(near) == {90, 91} and near.count(5) == 1 and near.count(None) == ids["quality_classifier"].count(None)
    cut = {r["doc_id"]: r["text"] for r in rows["substring_dedup"] if r["doc_id"] is not None}
    assert passage in cut[92] and passage not in cut[93] and len(cut[93]) > 300 and all(cut[k] == docs[k][1] for k in range(60) if k in cut)
    assert all(r["n_chars"] == len(r["text"]) for r in rows["substring_dedup"] if r["text"])
    assert not any((r["text"] or "").strip() == "" for r in rows["substring_dedup"])
    # the first place of a benchmark passage is in a document that goes; what was cut elsewhere is gone
    left = {r["doc_id"] for r in rows["benchmark_decontamination"]}
    assert not left & {94, 95} and set(range(60)) <= left
    item = word_list(items[0][1])
    for r in rows["benchmark_decontamination"]:
        words = word_list(r["text"])
        assert not any(words[k : k + len(item)] == item for k in range(len(words)))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len(tok.encode(r["text"], add_special_tokens=False).ids) + 1) for r in rows["benchmark_decontamination"])
    total = {}
    for r in rows["packing"]:
        key = r["doc_id"] if r["doc_id"] is not None else -1
        total[key] = total.get(key, 0) + r["length"]
    sums = {}
    for k, n in want:
        sums[k] = sums.get(k, 0) + n
    assert total == sums


def test_run_is_the_stages(spark, tables):
    docs, labels, items, _ = corpus(random.Random(4))
    sf = tables(docs, labels, items)
    cells = lambda d: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in d.collect())
    pieces = lambda rows: {(k, t) for k, _, _, _, t in rows}
    assert pieces(cells(corpus_pipeline.run(spark, sf))) == pieces(cells(staged(spark, sf)["packing"]))


@pytest.mark.parametrize("docs", [[], [(1, None, None, None, None)], [(1, "a b c", "en", "s", 5)] * 3])
def test_small_tables(spark, tables, docs):
    sf = tables(docs)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert len(rows) == (1 if len(docs) == 3 else 0)
    for r in rows:
        assert r["doc_tokens"] == r["length"] and r["ids_crc32"] > zlib.crc32(b"") - 1


@has_data
def test_kept_and_dropped_on_the_test_tables(spark):
    sf = "/root/testdata/sf0.001"
    labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, sf, "labels").collect()}
    got = staged(spark, sf)
    n = [got[name].count() for name in NAMES[:-1]]
    assert n == sorted(n, reverse=True)
    kept = {r["doc_id"] for r in got["quality_classifier"].collect()}
    assert sum(k in kept for k, q in labels.items() if q) > 0.95 * sum(labels.values())
