"""Sinks: JSON lines, summaries, CSV sheets, report texts, versioned snapshots."""

from __future__ import annotations

import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.text_format import fixed
from assayer.sources.readers import SEPARATOR, escaped

# ---- fixed values: lines of a case report ------------------------------------------------
BAR, RULE = "=" * 70, "─" * 70
NONE, NO_REPORT = "（無）", "（無報告）"
# ---- end of fixed values --------------------------------------------------------------------

REPORTS_PER_FILE = 10_000  # a compressed file is read by one task


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def json_object(members: Column, df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per file of the members (texts ``"key": value``) of a partition, one a line, in the native form."""
    def framed(batches):
        first = True
        for batch in batches:
            texts = batch.column("value").to_pylist()
            lines = [("{" if first else ",") + texts[0], *["," + t for t in texts[1:]]] if texts else []
            first = first and not texts
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["{}" if first else "}"], pa.string())], names=["value"])

    df.select(members.alias("value")).filter("value IS NOT NULL").mapInArrow(framed, "value string").write.mode(mode).text(path)


def summary_json(df: DataFrame, key: str, path: str, mode: str = "errorifexists") -> None:
    """One nested document per key: the columns that share a prefix before ``__`` become one struct."""
    df.select(key, *nested(df, [c for c in df.columns if c != key])).write.mode(mode).json(path)


def nested(df: DataFrame, columns: list[str]) -> list[Column]:
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(c.split("__")[0], []).append(c)
    return [F.struct(*[F.col(c).alias(c.split("__", 1)[1]) for c in cs]).alias(g) if "__" in cs[0] else F.col(cs[0]).alias(g)
            for g, cs in groups.items()]


def score_sheet(samples: DataFrame, rubric_keys: list[str], path: str, mode: str = "errorifexists") -> None:
    """Sample list with one blank score per question, as CSV with a header."""
    blank = samples.select("*", F.explode(F.array(*[F.lit(q) for q in rubric_keys])).alias("q_key")).withColumn(
        "score", F.lit(None).cast("string"))
    blank.write.mode(mode).csv(path, header=True)


def text_lines(df: DataFrame, line: str, path: str, mode: str = "errorifexists") -> None:
    df.select(F.col(line).alias("value")).write.mode(mode).text(path)


def case_report(body: str = "report_text", segments: str | None = None) -> Column:
    """Text of one case. Columns read: ``case_id, ground_truth, predicted, confidence, method, rationale,
    causal_chain, escalation_score, pre, post, articles, elements, rlegal, rcons, rcost, total_turns,
    conflict_type, is_convergent, low_confidence, conflicting, insufficient`` and the segments array."""
    def joined(c: str, mark: str) -> Column:
        return F.when(F.size(c) > 0, F.array_join(c, mark)).otherwise(NONE)

    def section(title) -> list[Column]:
        return [F.lit(RULE), F.concat(F.lit("  "), title if isinstance(title, Column) else F.lit(title)), F.lit(RULE), F.lit("")]

    def field(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"  {label}："), value)
    mark = F.when(F.col("ground_truth") == F.col("predicted"), "✓").otherwise("✗")
    blank = F.lit("")
    lines = [F.lit(BAR), F.concat(F.lit("  鑑定報告："), F.col("case_id").cast("string")), F.lit(BAR), blank,
             field("正確答案", F.col("ground_truth")), field("模型判定", F.concat_ws("  ", "predicted", mark)),
             field("信心程度", F.concat(fixed(F.col("confidence") * 100, 2), F.lit("%"))), field("報告生成", F.col("method")), blank,
             *section(F.concat(F.lit("一、鑑定報告（"), F.col("method"), F.lit("）"))), F.coalesce(F.col(body), F.lit(NO_REPORT)), blank,
             *section("一-b、行為摘要"), F.coalesce("rationale", F.lit(NONE)), blank,
             *section("二、行為分析"), field("因果鏈", F.col("causal_chain")), field("升溫分數", fixed(F.col("escalation_score"), 2)),
             field("事前指標", joined("pre", "; ")), field("事後指標", joined("post", "; ")), blank,
             *section("三、法律適用"), field("適用法條", joined("articles", ", ")), field("構成要件", joined("elements", ", ")),
             field("Rlegal", fixed(F.col("rlegal"), 3)), blank,
             *section("四、系統指標"), field("Rcons", fixed(F.col("rcons"), 3)), field("Rcost", fixed(F.col("rcost"), 3)),
             field("對話輪次", F.col("total_turns").cast("string")), field("衝突類型", F.col("conflict_type")),
             field("是否收斂", F.initcap(F.col("is_convergent").cast("string"))), blank, *section("五、不確定性與限制")]
    notes = []
    for column, label in (("low_confidence", "低信心項目"), ("conflicting", "衝突證據"), ("insufficient", "證據不足")):
        listed = F.concat(F.lit(f"  【{label}】\n"), F.array_join(F.transform(column, lambda x: F.concat(F.lit("    - "), x)), "\n"))
        notes.append(F.when(F.size(column) > 0, listed).otherwise(f"  【{label}】{NONE}"))
    tail = []
    if segments is not None:
        rows = F.array_join(F.transform(segments, appendix_line), "\n")
        head = "\n".join(["", RULE, "  附錄：時序標註（Ground Truth）", RULE, "", ""])
        tail.append(F.when(F.size(segments) > 0, F.concat(F.lit(head), rows)))
    every = F.array(*lines, *notes, *tail, blank, F.lit(BAR))
    return F.array_join(F.filter(every, lambda x: x.isNotNull()), "\n")


def appendix_line(s: Column) -> Column:
    return F.concat(F.lit("  ["), fixed(s["start_s"], 1), F.lit("s – "), fixed(s["end_s"], 1), F.lit("s] "), s["description"])


def write_reports(df: DataFrame, text: str, path: str, by: str = "run_id", mode: str = "errorifexists") -> None:
    """Report texts in one directory per run, many per file, divided by the separator; compressed, as most lines are the same in all."""
    df.select(by, escaped(F.col(text)).alias("value")).write.mode(mode).partitionBy(by).option("lineSep", SEPARATOR).option(
        "compression", "gzip").option("maxRecordsPerFile", REPORTS_PER_FILE).text(path)


# ---- snapshots -------------------------------------------------------------------------------

def write_snapshot(df: DataFrame, base: str) -> int:
    """A new version next to the old ones.

    The rows go to a folder of this attempt alone; only when its job has committed, a file with the next free number
    that names the folder is created. Creating fails if another writer took the number, which then tries the next
    one, so no committed version is ever written over.
    """
    spark = df.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{folder}")
    jvm = spark.sparkContext._jvm
    version = (latest_version(spark, base) or 0) + 1
    while True:
        mark = jvm.org.apache.hadoop.fs.Path(f"{base}/versions/{version:09d}")
        fs = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        try:
            out = fs.create(mark, False)
        except Py4JJavaError:
            if not fs.exists(mark):
                raise
            version += 1
            continue
        out.write(folder.encode())
        out.close()
        return version


def latest_version(spark: SparkSession, base: str) -> int | None:
    """Highest published version (the listing holds one short name per version, and only the largest comes back)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{base}/versions")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    marks = fs.listStatus(root)
    return max((int(m.getPath().getName()) for m in marks), default=None)


def read_snapshot(spark: SparkSession, base: str) -> DataFrame:
    version = latest_version(spark, base)
    if version is None:
        raise FileNotFoundError(base)
    folder = spark.read.text(f"{base}/versions/{version:09d}").first()[0]
    return spark.read.parquet(f"{base}/{folder}")
