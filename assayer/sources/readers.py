"""Readers for the native file shapes. Every reader gives a typed DataFrame.

A file may hold one document (the native shape) or many: JSON documents one
per line, texts divided by a separator character. The second form lets Spark
split large files; the parsing is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer import schemas
from assayer.functions import text as X
from assayer.session import path_exists
from assayer.sources import json_members

# ---- fixed values -----------------------------------------------------------------
LAW_NAME, OTHER = "中華民國刑法", "Other"
TITLE_MARK = "^(?:標題：|題目：|Title:)[ \\t\\f\\r]*"
REPORT_BODY = "(?s)一、[^\\n]*鑑定報告[^\\n]*\\n─+\\n\\n(.+?)(?=─+\\n\\s*一-b|=+\\s*$|\\z)"
REPORT_TRUTH, REPORT_PREDICTED = "正確答案：([\\w.-]+)", "模型判定：([\\w.-]+)"
REPORT_ID = "鑑定報告：(\\S+)"
LAW_CHAPTER = "<div class=\"col-no\">([^<]*章[^<條]*)</div>"
LAW_ARTICLE = "<a name=\"([0-9]+(?:-[0-9]+)?)\">[^<]*</a>\\s*</div>\\s*<div class=\"col-data\">(.*?)</div>\\s*(?:</div>|$)"
CUE_DIRECT = "直接證據"
# ---- end of fixed values ------------------------------------------------------------

SEPARATOR = "\f"
MARK = "\x1a"


def escaped(text: Column) -> Column:
    """A text without the separator, for files of many texts: the mark becomes mark 1, the separator mark 2."""
    return F.replace(F.replace(text, F.lit(MARK), F.lit(MARK + "1")), F.lit(SEPARATOR), F.lit(MARK + "2"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(MARK + "2"), F.lit(SEPARATOR)), F.lit(MARK + "1"), F.lit(MARK))


def annotation_pieces(intervals: DataFrame, size: int = 4096) -> DataFrame:
    """Segments packed to annotation rows: parallel arrays per video and block of segment ids.

    A block bounds the arrays, so one long video becomes many rows.
    """
    block = F.floor(F.col("seg_idx") / size)
    packed = intervals.groupBy("video_id", block.alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct("seg_idx", "start_s", "end_s", "description"))).alias("s"))
    return packed.select(
        "video_id", "piece", F.col("s.seg_idx").alias("ids"),
        F.transform("s", lambda x: F.array(x["start_s"], x["end_s"])).alias("timestamps"),
        F.col("s.description").alias("sentences"))


def documents(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """``value, path`` with one row per document; bytes that are no UTF-8 are replaced."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "value string, path string")
    reader = spark.read.option("recursiveFileLookup", "true")
    df = reader.text(path, wholetext=True) if separator is None else reader.text(path, lineSep=separator)
    text = F.make_valid_utf8("value")
    return once(df, {"value": unescaped(text) if separator == SEPARATOR else text, "path": F.col("_metadata.file_path")})


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """A projection that is worked out once a row, however often and in whatever filters its columns are used: a generator of one
    row, which the optimiser does not merge with what stands above it."""
    return df.select(F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _json_documents(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    return documents(spark, path, "\n" if lines else None)


def _json_records(spark: SparkSession, path: str, kind: str, lines: bool) -> DataFrame:
    """Records of arrays; their strings may be longer than the 20 000 000 characters that Spark's parser takes unasked."""
    d = _json_documents(spark, path, lines)
    return d.select(F.inline(F.from_json("value", f"array<{kind}>", {"maxStringLen": str(2**31 - 1)})))


def file_stem(path: Column | str = "path") -> Column:
    return F.regexp_extract(path, "([^/]+?)(?:\\.[^./]*)?$", 1)


def parent(path: Column | str = "path") -> Column:
    """Name of the directory that holds the file; ``key=name`` directories give the name."""
    return F.url_decode(F.regexp_extract(path, "/(?:[^/=]+=)?([^/]+)/[^/]+$", 1))


def annotations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Objects keyed by video id: ``video_id, duration, timestamps, sentences``.

    With ``lines`` every line is an object. The native form, one object a file, is cut into its members by many tasks; a member that
    cannot be read, as the last one of a file that breaks off, is left out (``annotation_faults`` counts them).
    """
    kind = f"map<string,{schemas.ANNOTATION}>"
    if lines:
        parsed = F.from_json("value", kind)
        return _json_documents(spark, path, lines).select(F.explode(parsed).alias("video_id", "a")).select("video_id", "a.*")
    return _members(spark, path, kind).select(F.explode("m").alias("video_id", "a")).filter("a IS NOT NULL").select("video_id", "a.*")


def _members(spark: SparkSession, path: str, kind: str) -> DataFrame:
    found = json_members.members(spark, path)
    return found.withColumn("m", F.when(F.col("complete"), F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), kind)))


def annotation_faults(spark: SparkSession, path: str) -> DataFrame:
    """Members per file, and how many of them are no annotation or break off."""
    m = _members(spark, path, f"map<string,{schemas.ANNOTATION}>")
    good = F.coalesce(F.exists(F.map_values("m"), lambda a: a.isNotNull()), F.lit(False))
    return m.groupBy("path").agg(F.count(F.lit(1)).alias("members"), F.count_if(~good).alias("faults"))


def statutes(spark: SparkSession, path: str, article_classes: DataFrame, lines: bool = False) -> DataFrame:
    """Arrays of article records; a missing class comes from the article number, else ``Other``."""
    rows = _json_records(spark, path, schemas.STATUTE, lines)
    mapped = F.broadcast(article_classes.withColumnRenamed("class", "__class"))  # fixed article list
    return rows.join(mapped, "article_id", "left").select(
        "article_id", F.coalesce("law_name", F.lit(LAW_NAME)).alias("law_name"), F.coalesce("chapter", F.lit("")).alias("chapter"),
        F.coalesce("crime_category", "__class", F.lit(OTHER)).alias("crime_category"), F.coalesce("content", F.lit("")).alias("content"))


def keyed_statutes(statutes_: DataFrame, order: str) -> DataFrame:
    """One row per article id, the last record of the order."""
    return statutes_.groupBy("article_id").agg(F.max_by(F.struct(
        *[c for c in statutes_.columns if c != "article_id"]), order).alias("s")).select("article_id", "s.*")


def statute_text(spark: SparkSession, path: str, law_name: str = LAW_NAME, separator: str | None = None) -> DataFrame:
    """Full-code texts cut to articles."""
    return X.statute_articles(documents(spark, path, separator), "value", law_name).select(
        "article_id", "law_name", "content")


def judgments(spark: SparkSession, path: str, types=None, lines: bool = False) -> DataFrame:
    """Arrays of judgment records cut to sections."""
    rows = _json_records(spark, path, schemas.JUDGMENT, lines)
    cut = X.sections(rows.withColumnRenamed("content", "whole"), "whole", types)
    return cut.select(F.coalesce("case_id", F.lit("unknown")).alias("case_id"), "crime_category", "section_no", "type", "content")


def judgment_texts(spark: SparkSession, path: str, separator: str | None = None, **patterns) -> DataFrame:
    """Texts in one directory per class; rows with neither facts nor reasoning are dropped."""
    d = documents(spark, path, separator).withColumns({"crime_category": parent(), "source_file": file_stem()})
    j = X.judgment_fields(d, "value", "source_file", **patterns)
    return j.filter((F.col("facts") != "") | (F.col("legal_reasoning") != "")).drop("value", "path")


def essays(spark: SparkSession, texts: str | None = None, json: str | None = None, separator: str | None = None,
           lines: bool = False, missing: str | None = "") -> DataFrame:
    """Essays: a text whose first line is the title, or JSON records with title and content.

    Texts divided by a separator are read as they were written, their line ends too. ``missing`` stands for a title or
    content that a record lacks.
    """
    parts = []
    if texts is not None:
        t = X.strip(F.col("value"))
        t = F.regexp_replace(t, "\\r\\n", "\n") if separator is None else t
        parts.append(documents(spark, texts, separator).select(
            F.lit("text").alias("source"), F.trim(F.regexp_replace(F.substring_index(t, "\n", 1), TITLE_MARK, ""), F.lit(X.SPACES)).alias("title"),
            F.when(F.contains(t, F.lit("\n")), X.strip(F.regexp_replace(t, "^[^\\n]*\\n", ""))).otherwise("").alias("content")))
    if json is not None:
        rows = _json_records(spark, json, schemas.ESSAY, lines)
        parts.append(rows.select(F.coalesce("source", F.lit("json")).alias("source"), F.coalesce("title", F.lit(missing)).alias("title"),
                                 F.coalesce("content", F.lit(missing)).alias("content")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reports(spark: SparkSession, path: str, separator: str | None = None, keep_empty: bool = False) -> DataFrame:
    """Case reports: id, truth, prediction and body. The heading of the body may name a model."""
    d = documents(spark, path, separator)
    inner = F.regexp_extract("value", REPORT_ID, 1)

    def field(pattern: str) -> Column:
        found = F.regexp_extract("value", pattern, 1)
        return F.when(found == "", "Unknown").otherwise(found)
    r = once(d, {
        "report_id": file_stem() if separator is None else inner, "run_id": parent(),
        "ground_truth": field(REPORT_TRUTH), "predicted": field(REPORT_PREDICTED),
        "body": X.strip(F.regexp_extract("value", REPORT_BODY, 1))}).filter(F.col("report_id") != "")
    return r if keep_empty else r.filter(F.col("body") != "")


def run_stats(spark: SparkSession, paths: dict[str, str] | str, lines: bool = False) -> DataFrame:
    """Stat records of many runs under one schema; what a run lacks is NULL, what cannot be read is left out.

    ``paths`` is a folder with one directory per run, or label -> path.
    """
    if isinstance(paths, dict):
        out = None
        for label, path in paths.items():
            part = run_stats(spark, path, lines).withColumn("run_id", F.lit(label))
            out = part if out is None else out.unionByName(part)
        return out
    d = _json_documents(spark, paths, lines)
    as_list = F.from_json("value", f"array<{schemas.CASE}>")
    return d.select(parent().alias("run_id"), F.inline(as_list)).filter(F.col("video_id").isNotNull())


def judge_scores(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested judge results to rows ``item_id, model, judge, q_key, norm``; the old key name is accepted."""
    d = _json_documents(spark, path, lines)
    items = d.select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("item"))
    scores = items.select(F.element_at("item", F.lit("video_id")).alias("item_id"), F.explode(F.map_filter(
        "item", lambda k, _: k.rlike("_(scores|judged_by)$"))).alias("key", "result"))
    judged = scores.select("item_id", F.regexp_replace("key", "_(scores|judged_by)$", "").alias("model"),
                           F.explode(F.from_json("result", f"map<string,{schemas.JUDGE_RESULT}>")).alias("judge", "r"))
    return judged.select("item_id", "model", "judge", F.explode("r.q_norm").alias("q_key", "norm"))


def human_scores(spark: SparkSession, path: str, rubric: DataFrame, item_max: DataFrame | None = None, default_max: int = 4) -> DataFrame:
    """Human sheet normalised by the question's maximum; a dynamic one comes from the item, else the default."""
    csv = spark.read.csv(path, header=True, schema=schemas.HUMAN)
    j = csv.join(F.broadcast(rubric), "q_key")  # seven questions
    if item_max is not None:
        j = j.join(item_max.select("video_id", "q2_max"), "video_id", "left")
        top = F.coalesce("max_score", "q2_max", F.lit(default_max))
    else:
        top = F.coalesce("max_score", F.lit(default_max))
    return j.filter(F.col("score").isNotNull()).select("video_id", "model", "q_key", "score", top.alias("max_score"),
                                                       (F.col("score") / top).alias("norm"))


def priors(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Class priors of each run; ``_`` keys and values that are no numbers are dropped."""
    d = _json_documents(spark, path, lines)
    pairs = d.select(parent().alias("run_id"), F.explode(F.from_json("value", "map<string,string>")).alias("class", "v"))
    return pairs.filter(~F.col("class").startswith("_")).select("run_id", "class", F.col("v").try_cast("double").alias("bias")).filter(
        F.col("bias").isNotNull())


def cues(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Cue mapping in rows ``class, articles, cue_no, cue, element, evidence_type``; ``_`` keys are dropped."""
    d = _json_documents(spark, path, lines)
    raw = d.select(F.explode(F.map_filter(F.from_json("value", "map<string,string>"), lambda k, _: ~k.startswith("_"))).alias("class", "v"))
    parsed = raw.select("class", F.from_json("v", schemas.CUES).alias("c"))
    return parsed.select("class", F.col("c.applicable_articles").alias("articles"), F.posexplode("c.visual_mappings").alias("cue_no", "m")).select(
        "class", "articles", "cue_no", F.col("m.visual_cue").alias("cue"), F.col("m.legal_element").alias("element"), F.col("m.evidence_type").alias("evidence_type"))


def split_lists(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``Class/Name.mp4`` per split file or directory."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("path"))
    return lines.filter(F.contains("line", F.lit("/"))).select(
        F.substring_index("line", "/", 1).alias("class"), F.regexp_replace(F.substring_index("line", "/", -1), "\\.mp4$", "").alias("item"),
        parent().alias("split"))


def html_items(df: DataFrame, html: str, header: str, item: str, targets: list[str] | None = None) -> DataFrame:
    """Items of a page in order with the last header before them.

    ``header`` has one group (its text), ``item`` two (id, text). The page is cut
    at its headers, so the header of an item is that of its piece: no window.
    """
    mark = X.MARK
    no_group = header.replace("([", "(?:[", 1) if "([" in header else header.replace("(", "(?:", 1)
    pieces = F.split(F.regexp_replace(F.col(html), f"(?s)({no_group})", mark + "$1"), mark)
    piece = df.select("*", F.posexplode(pieces).alias("piece_no", "piece")).withColumn(
        "header", F.regexp_extract("piece", f"(?s)^{header}", 1))
    pattern = F.lit(f"(?s){item}")
    found = piece.select("*", F.posexplode(F.arrays_zip(
        F.regexp_extract_all("piece", pattern, F.lit(1)).alias("id"), F.regexp_extract_all("piece", pattern, F.lit(2)).alias("text"))).alias("item_no", "i"))
    rows = found.select(*[c for c in df.columns if c != html], "piece_no", "item_no", "header", F.col("i.id").alias("item_id"),
                        X.strip(F.regexp_replace("i.text", "<[^>]+>", "")).alias("content"))
    return rows if targets is None else rows.filter(F.col("item_id").isin(targets))


def law_pages(df: DataFrame, html: str, article_classes: DataFrame) -> DataFrame:
    """Articles of saved statute pages with their chapter; only articles that have a class."""
    rows = html_items(df, html, LAW_CHAPTER, LAW_ARTICLE).filter(F.col("content") != "")
    return rows.join(F.broadcast(article_classes), rows["item_id"] == article_classes["article_id"]).select(  # fixed list
        F.col("item_id").alias("article_id"), F.col("header").alias("chapter"), "class",
        F.concat(F.lit("第 "), F.col("item_id"), F.lit(" 條　"), F.col("content")).alias("content"))


# ---- texts built from the cue mapping -------------------------------------------------------

def cue_lines(cue_rows: DataFrame, normal: str = "Normal", max_articles: int = 2, max_cues: int = 3) -> DataFrame:
    """One definition line per class, and the line of the normal class with the first direct cue of every other."""
    direct = F.sort_array(F.collect_list(F.when(F.col("evidence_type") == CUE_DIRECT, F.struct("cue_no", "cue"))))  # a class's own short list
    per = cue_rows.groupBy("class").agg(F.first("articles").alias("articles"), direct.alias("d"))
    line = F.concat(F.lit("- "), F.col("class"), F.lit("（"), F.array_join(F.slice("articles", 1, max_articles), "／"), F.lit("）："),
                    F.array_join(F.slice(F.col("d.cue"), 1, max_cues), "；"))
    own = per.select("class", line.alias("line"))
    first = per.filter(F.size("d") > 0).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
        F.col("class").alias("class"), F.col("d")[0]["cue"].alias("cue")))), lambda x: F.concat(x["class"], F.lit(": "), x["cue"])), "；").alias("bits"))
    none = first.select(F.lit(normal).alias("class"), F.concat(
        F.lit(f"- {normal}: Clearly ordinary scene with NO suspicious behavior. **Do NOT pick Normal if you see ANY of** — "),
        F.col("bits"), F.lit(".")).alias("line"))
    return own.unionByName(none)


def priming_lines(predictions: DataFrame, cue_rows: DataFrame, top: int = 3, min_confidence: float = 0.5, max_cues: int = 2) -> DataFrame:
    """Hint lines for the most likely classes of a case, if the first is likely enough.

    ``predictions`` rows: ``case_id, ranked array<struct<class, p>>`` in falling order.
    """
    direct = F.sort_array(F.collect_list(F.when(F.col("evidence_type") == CUE_DIRECT, F.struct("cue_no", "cue"))))
    per = cue_rows.groupBy("class").agg(F.slice(direct, 1, max_cues).alias("d"))
    from assayer.operators.text_format import fixed
    wanted = predictions.filter(F.get("ranked", F.lit(0))["p"] >= min_confidence).select(
        "case_id", F.posexplode(F.slice("ranked", 1, top)).alias("rank", "r")).select("case_id", "rank", F.col("r.class").alias("class"), F.col("r.p").alias("p"))
    j = wanted.join(F.broadcast(per), "class", "left")  # one row per class
    hint = F.when(F.size("d") > 0, F.array_join(F.col("d.cue"), "；")).otherwise("(no cue data)")
    return j.select("case_id", "rank", F.concat(F.lit("  • "), F.col("class"), F.lit(" (prior="), fixed(F.col("p"), 2), F.lit("): look for — "), hint).alias("line"))
