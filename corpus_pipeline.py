"""Documents to packed sequences in five stages, each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bagminhash, exact, line_crf, suffix
from assayer.llm.queries import line_model, packed
from assayer.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are mostly content, decided row by row from the text.

    Null and empty texts fail the base rules and go. Null and repeated ids and repeated rows are judged by their own texts;
    all columns stay as they are. An empty table stays empty.
    """
    model = line_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(line_crf.kept_text(model)("text"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case, null as empty) the row of the largest id; null ids are the smallest.

    Of rows that repeat id and text one stays, with its own other columns. An empty table stays empty.
    """
    return exact.exact_dedup(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row of the smallest id, null last.

    Texts without words are near only to equal ones. Different texts of one id, or of null ids, are judged each by its own
    class, so none goes for another's sake. An empty table stays empty.
    """
    return bagminhash.near_dedup(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a smaller id also has; ``n_chars`` follows the text.

    A row is met by its id and its text, so rows that repeat an id keep their own texts; null ids and null or empty texts lose
    nothing. No row goes, an empty table stays empty, and other columns stay as they are.
    """
    id_, key, new = (exact.unused(docs, n) for n in ("__id", "__key", "__text"))
    spans = suffix.repeated_spans(docs).filter("size(starts) > 0").select(
        F.col("doc_id").alias(id_), F.col("key").alias(key), suffix.kept_text("kept").alias(new)).dropDuplicates([id_, key])
    changed = docs.join(spans, (F.col("doc_id") == F.col(id_)) & (bagminhash.text_key("text") == F.col(key)), "left")
    text = F.coalesce(new, "text")
    return changed.select(*[
        text.alias(c) if c == "text" else F.coalesce(F.char_length(new).cast("long"), c).alias(c) if c == "n_chars" else F.col(c)
        for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences.

    A null or empty text is a document of one token; null and repeated ids stay as they are; an empty table gives no pieces.
    """
    return packed(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("repeated_passages", repeated_passages), ("packing", packing)]

#: The first stage's verdict is a trained model's, near duplicates and packing depend on hashes and workers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each result is written under ``spark.checkpoint.dir`` and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
