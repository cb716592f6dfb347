"""From raw documents to packed sequences: STAGES, each on all that its predecessor kept, and run() over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import decontamination, language_id, line_dedup, near_dedup, packing
from basalt.llm.workspace import Workspace, with_ids

#: Put before the names of a table's own columns while an operator adds its results, so that no name clashes.
OWN = "_own_"
#: No stage but line dedup is expressible in SQL; the stages are tested against brute force and invariants.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty; the rejected go, and with them null texts and texts without a letter.

    The columns are those that came, whatever their names. Rows with a null or repeated doc_id are judged by their own text;
    a null id is not learnt from. Ties go to the first language by name. An empty table, or one without a labelled row, leaves none.
    """
    model = language_id.train(docs)
    out = language_id.identify(spark, docs.withColumnsRenamed({c: f"{OWN}{c}" for c in docs.columns}).withColumn("text", F.col(f"{OWN}text")), model)
    return out.filter("accepted").select(*(F.col(f"{OWN}{c}").alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their boilerplate lines; n_chars follows the text where the table has it. One with nothing else goes.

    Null and empty texts stay as they are. Repeated rows lose the same lines. Rows are told by their text, not their doc_id.
    """
    out = line_dedup.drop_lines(spark, docs.withColumnsRenamed({c: f"{OWN}{c}" for c in docs.columns if c != "text"}))
    cut = F.col("n_dropped") > 0
    out = out.filter(~(cut & (F.trim(F.translate("text", "\n", "")) == ""))).withColumnsRenamed({f"{OWN}{c}": c for c in docs.columns if c not in ("n_dropped", "n_lines")})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"{OWN}{c}").alias(c) if c in ("n_dropped", "n_lines") else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id, a null one last.

    Rows get a number that is written with them, so repeated doc_ids and null ones are rows like any other: of rows that are
    equal altogether one stays. Texts without words are in no group and stay, each of them.
    """
    work, row = Workspace(spark), f"{OWN}row"
    rows = work.save(docs.withColumn(row, F.monotonically_increasing_id()))
    gone = work.save(near_dedup.near_duplicates(spark, rows, row).filter("not kept").select(row))
    return with_ids(rows, gone, "left_anti", row).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Each row is judged by its own text, whatever its doc_id; null and empty texts stay."""
    return decontamination.without_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents in sequences: one row per piece. A null or empty text is its closing id; rows with a null or repeated doc_id are documents of their own."""
    return packing.pack(spark, docs, packing.tokenizer_path(), ids_too=True, memo_units=150_000)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each result is written to the shared folder and read again."""
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.save(docs)
    return docs
