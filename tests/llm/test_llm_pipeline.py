"""The pipeline's stages on a small corpus, and its queries on the small tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basalt.llm import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages_keep_columns_and_only_drop(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.count() > 0.7 * docs.count()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0), FOLDER).count() == 0, name


def test_stages_judge_rows_not_ids(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("lang is not null").limit(60)
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").filter("length(text) > 60").first()["text"]
    prose = [r["text"] for r in docs.filter("length(text) between 200 and 2000").limit(3).collect()]
    odd = [(None, item), (7, item), (7, prose[0]), (7, prose[0]), (None, prose[1]), (None, prose[1]), (7, prose[2]), (None, None), (None, ""), (None, "zz " * 30_000)]
    extra = spark.createDataFrame([(i, t, "en", "odd", 1, k, "x", -1) for k, (i, t) in enumerate(odd)], "doc_id long, text string, lang string, source string, n_chars int, kept int, _text string, n_lines int")
    stages = dict(corpus_pipeline.STAGES)
    left = lambda df: sorted(r["kept"] for r in df.collect())
    assert left(stages["decontaminated"](spark, extra, FOLDER)) == [2, 3, 4, 5, 6, 7, 8, 9]
    once = stages["near_duplicates"](spark, extra, FOLDER)
    assert once.columns == extra.columns and {r["text"] for r in once.collect()} == {t for _, t in odd}
    assert len([r for r in once.collect() if r["text"] in prose]) == 3 and len([r for r in once.collect() if r["text"] == item]) == 1
    assert left(stages["lines"](spark, extra, FOLDER)) == list(range(10)) and stages["lines"](spark, extra, FOLDER).columns == extra.columns
    both = docs.select(*docs.columns, F.lit(0).alias("kept"), F.lit("x").alias("_text"), F.lit(1).alias("n_lines")).unionByName(extra.withColumn("n_chars", F.col("n_chars").cast("long")))
    told = stages["language"](spark, both, FOLDER)
    assert told.columns == both.columns and told.filter("text is null or text = ''").count() == 0
    packed = stages["packed"](spark, extra, FOLDER)
    assert packed.filter("start = 0").count() == len(odd)
    assert packed.groupBy().sum("length").first()[0] == packed.filter("start = 0").groupBy().sum("doc_tokens").first()[0]


COLUMNS = {
    "op1_chat_formatting": ("conversations", "conv_id turn role role_out action inserted appended rendered place"),
    "op2_packing": (None, "doc_id start length ids_crc32 doc_tokens sequence_id offset"),
    "op3_sharding": ("documents", "doc_id size text_crc32 law shard slot grown_shard"),
    "op4_secret_scan": ("documents", "doc_id n_assign n_access n_hex base_sha256 spans"),
    "op5_language_id": ("documents", "doc_id held_out lang_pred score"),
    "op6_exact_dedup": ("documents", "doc_id keep_id group_size kept text_sha256"),
    "op7_minhash_near_dedup": ("documents", "doc_id n_shingles component_id kept"),
    "op8_decontamination": ("documents", "doc_id contaminated items cover"),
    "op9_toxicity": ("documents", "doc_id held_out score predicted"),
    "op10_line_dedup": ("documents", "doc_id n_lines n_dropped text_sha256"),
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    table, columns = COLUMNS[name]
    out = registry.QUERIES[name](spark, FOLDER).toPandas()
    assert set(columns.split()) <= set(out.columns)
    if table:
        assert len(out) == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    if name in registry.ORACLES:
        duck = duckdb.connect()
        duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{FOLDER}/documents.parquet')")
        want = duck.sql(registry.ORACLES[name]).df()
        assert sorted(map(tuple, out[sorted(out.columns)].to_numpy().tolist())) == sorted(map(tuple, want[sorted(want.columns)].to_numpy().tolist()))


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.filter("start = 0").count() > 0.6 * docs.count()
