"""The pipeline's stages on a fixture, each against what it must do."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from rampwise.llm import bpe
from rampwise.llm.common import read, ship
from rampwise.session import scratch_path

PROSE = "the of and to in that is for it with as was on are this be by or at not an from"


def test_stages(spark, data):
    ship(spark)
    bench = read(spark, data, "benchmark").where("item_id = 0").first()["text"]
    own = [(1, f"{PROSE} mail a.b@c.example now"), (2, f"{PROSE} mail a.b@c.example now"), (3, "%%% 123 ### 456 &&&"), (4, None), (5, f"{PROSE} {bench}"),
           (6, "in the is not of it and that was for on to by this are with be an from at or as"), (7, "is as it in or an to of"), (7, "is as it in or an to of")]
    docs = read(spark, data, "documents").unionByName(spark.createDataFrame([(10**6 + i, t, "en", "src0", len(t or "")) for i, t in own], read(spark, data, "documents").schema))
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r["doc_id"] - 10**6: r for r in docs.where("doc_id >= 1000000").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    language, copies, clean, private, encoded = kept
    assert set(language) == {1, 2, 5, 6, 7} and set(copies) == {1, 5, 6, 7} and set(clean) == {1, 6, 7}
    assert docs.where("doc_id = 1000007").count() == 1
    assert private[1]["text"] == f"{PROSE} mail [EMAIL] now" and private[1]["n_chars"] == len(private[1]["text"]) and private[6]["text"] == clean[6]["text"]
    assert encoded[6]["n_tokens"] == len(bpe.coder(bpe.TOKENIZER).tokenizer.encode(clean[6]["text"], add_special_tokens=False).ids)


def test_run_keeps_no_contaminated_or_near_copies(spark, data):
    out = corpus_pipeline.run(spark, data)
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < read(spark, data, "documents").count()
    bench = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r["text"].lower()) for r in read(spark, data, "benchmark").collect()]
    windows = {tuple(w[i: i + 10]) for w in bench for i in range(len(w) - 9)}
    for r in read(spark, data, "documents").where(F.col("doc_id").isin(ids)).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        assert not any(tuple(w[i: i + 10]) in windows for i in range(len(w) - 9))


def test_empty_documents(spark, data):
    docs = read(spark, data, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert docs.count() == 0
