"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import alignment, bagminhash, bpe, exact, html_blocks, line_crf, mixing, ordinal, packing, spelling, suffix, toxicity, warc
from assayer.llm.hashing import held_out, labelled_sample
from assayer.llm.shared import stored
from assayer.session import scratch_path

PACK_TOKENS = "byte_bpe_50k.json"
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc_captures(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.page_records(pages), path)
    records = warc.read_archives(spark, path)
    # sizes and digests are taken where a record is read, so that no payload is shuffled; the joins read the records
    # several times, the archives are unpacked and parsed once
    records = stored(records.withColumns({
        "payload": F.struct(F.octet_length("payload").cast("long").alias("bytes"), warc.payload_digest(F.col("payload")).alias("digest")),
        "block": F.when(~F.col("record_type").isin(*warc.ANCHORS), F.col("block"))}), "warc-records")
    captures = warc.assemble(records).filter("part = 0")
    told = captures.select(
        "capture_id", "record_type", "refers_to", "payload.bytes", "payload.digest",
        warc.warc_field(F.col("metadata")[0]["block"], "page-id").cast(pages.schema["page_id"].dataType).alias("page_id"),
        "target_uri", F.size("requests").cast("long").alias("n_requests"))
    # a revisit takes size, digest and page of the response that it names
    source = (told.filter("record_type = 'response'").groupBy(F.col("capture_id").alias("refers_to"))
              .agg(F.max("bytes").alias("source_bytes"), F.max("digest").alias("source_digest"), F.max("page_id").alias("source_page")))
    revisit = told.filter("record_type = 'revisit'").join(source, "refers_to")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "n_requests"]
    return told.filter("record_type = 'response'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type",
        F.lit(None).cast(pages.schema["page_id"].dataType).alias("refers_to"), "target_uri", "n_requests").union(
        revisit.select("page_id", "source_bytes", "source_digest", "record_type", "source_page", "target_uri", "n_requests")).toDF(*columns)


_OP1_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, encode(coalesce(html, '')) AS raw, coalesce(url, '') AS target_uri FROM pages
), d AS (
  SELECT page_id, target_uri, octet_length(raw) AS payload_bytes, sha1(body) AS hexed, body FROM p
), f AS (
  SELECT body, min(page_id) AS first_page FROM d GROUP BY body
)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(d.hexed, 1 + 10 * CAST(i // 8 AS INTEGER), 10) AS BIGINT) >> CAST(5 * (7 - i % 8) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN d.page_id = f.first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id = f.first_page THEN NULL ELSE f.first_page END AS refers_to,
  d.target_uri, CAST(1 AS BIGINT) AS n_requests
FROM d JOIN f USING (body)
"""


def op2_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(_table(spark, folder, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """Pieces with the digest columns of their ids."""
    pieces = packing.harmonic_pack(docs, public_tokenizers.path(PACK_TOKENS))
    return pieces.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("length"),
                         F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def line_model(docs: DataFrame, labels: DataFrame) -> line_crf.LineCRF:
    """The field learned from a bounded sample of graded documents."""
    grade = F.when(F.col("quality").isin(0, 1), F.col("quality"))
    return line_crf.weak_crf(labelled_sample(docs, labels, grade, {0: 400, 1: 400}, most_chars=20_000))


def op3_line_labels(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return line_crf.line_labels(docs, line_model(docs, _table(spark, folder, "labels")))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    toxic = F.when(F.col("toxic").isin(0, 1), F.col("toxic"))
    sample = labelled_sample(docs, labels, toxic, {0: 4000, 1: 1500}, most_chars=20_000)
    scored = toxicity.toxicity(docs, toxicity.fit(sample))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN
    ids = bpe.encode(_table(spark, folder, "documents"), path, pattern)
    return bpe.decode(ids, path, pattern).select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_exact_groups(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(_table(spark, folder, "documents")).withColumnRenamed("digest", "text_sha256")


_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP6_SQL = f"""
WITH n AS (SELECT doc_id, {_NORM} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""


def op7_bagminhash(spark: SparkSession, folder: str) -> DataFrame:
    return bagminhash.near_duplicates(_table(spark, folder, "documents"))


def op8_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Grades: 0 bad, 1 good but toxic, 2 good; P(grade >= 1) decides."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(
        (F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    model = ordinal.fit(labelled_sample(docs, labels, grade, {0: 800, 1: 800, 2: 800}, most_chars=20_000), grades=3)
    return ordinal.grade(docs, model, tail=1).select("doc_id", held_out().alias("held_out"), "expected_grade",
                                                     "tail_probability", "selected")


def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = html_blocks.extract(_table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    spans = suffix.repeated_spans(_table(spark, folder, "documents"))
    return spans.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                        F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(_table(spark, folder, "documents")))


def op12_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return alignment.align_tokens(docs, public_tokenizers.path(PACK_TOKENS), public_tokenizers.path(PIECES))


QUERIES = {f.__name__: f for f in (
    op1_warc_captures, op2_harmonic_packing, op3_line_labels, op4_toxicity, op5_bpe_round_trip, op6_exact_groups, op7_bagminhash,
    op8_ordinal_quality, op9_main_text, op10_repeated_passages, op11_spelling_variants, op12_mixing, op13_token_alignment)}
ORACLES = {"op1_warc_captures": _OP1_SQL, "op6_exact_groups": _OP6_SQL}

