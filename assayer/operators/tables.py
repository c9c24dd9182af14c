"""Comparison tables of runs and the texts made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators import metrics as M
from assayer.operators import thresholds as T
from assayer.operators.text_format import fixed

METRICS = ["accuracy", "macro_f1", "auroc", "min_ndcf_5_1", "min_ndcf_10_1", "mean_turns", "mean_rcons", "mean_rlegal", "ece"]
# ---- fixed values: column heads of the published tables -------------------------------
MARKDOWN = [("run_id", "variant"), ("n", "n"), ("accuracy", "acc"), ("macro_f1", "macro-F1"), ("auroc", "AUROC"),
            ("min_ndcf_5_1", "NDCF(5:1)"), ("min_ndcf_10_1", "NDCF(10:1)"), ("mean_turns", "turns"),
            ("mean_rcons", "Rcons"), ("mean_rlegal", "Rlegal_GT"), ("ece", "ECE")]
LATEX = [("run_id", "Variant", "l"), ("accuracy", "Acc", "r"), ("macro_f1", "F1", "r"), ("auroc", "AUROC", "r"),
         ("min_ndcf_5_1", "NDCF$_{5:1}$", "r"), ("mean_rlegal", "$R_{legal}^{GT}$", "r"), ("ece", "ECE", "r")]
MISSING = "—"
# texts of the expanded query and of the template report
ANY_ELEMENTS, ANY_ARTICLES = "相關犯罪構成要件", "相關法條"
QUERY_TEXT = "本案涉及{}類型犯罪。{} 依據{}，構成要件包括：{}。依現行刑事法律，行為人須具備上述要件方構成本罪。"
FACTS_TEXT = "一、事實認定\n本案經影片行為分析，判定犯罪類別為{}，信心程度{}。"
RATIONALE_TEXT = "行為分析摘要：{}"
LAW_HEAD, LAW_TEXT = "\n二、法律適用", "本案可能適用{}。"
END_HEAD, END_TEXT = "\n三、初步結論", "綜合以上分析，本案涉及{}類型犯罪之可能性為{}%。"
QUOTED_LAWS, QUOTED_LENGTH = 3, 200
# ---- end of fixed values ----------------------------------------------------------------


def ablation_table(cases: DataFrame, normal: str = "Normal") -> DataFrame:
    """One row per run; a metric that cannot be computed is NULL.

    Four aggregations of the cases (means, class counts, confidence bins, score
    histogram), each small after its map-side part, are joined on the run.
    """
    means = cases.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(M.correct().cast("double")).alias("accuracy"),
        *[F.avg(c).alias(f"mean_{a}") for a, c in (("turns", "total_turns"), ("rcons", "rcons"), ("rlegal", "rlegal"))])
    f1 = M.macro_f1(cases).select("run_id", "macro_f1")
    scored = T.labelled(cases, "score", normal)
    area = T.area_and_costs(scored, ["run_id"], [(5.0, 1.0), (10.0, 1.0)]).filter("n_pos > 0 AND n_neg > 0").select(
        "run_id", "auroc", F.col("best_0.ndcf").alias("min_ndcf_5_1"), F.col("best_1.ndcf").alias("min_ndcf_10_1"))
    ece = M.calibration_error(cases)
    out = means.join(f1, "run_id", "left").join(area, "run_id", "left").join(ece, "run_id", "left")
    return out.select("run_id", "n", *METRICS)


def ablation_delta(table: DataFrame, baseline: str) -> DataFrame:
    """Each metric less that of the baseline run; a missing metric counts as 0."""
    base = table.filter(F.col("run_id") == baseline).select(
        F.lit(0).alias("__one"), *[F.coalesce(m, F.lit(0.0)).alias(f"__{m}") for m in METRICS])  # one row
    return table.withColumn("__one", F.lit(0)).join(F.broadcast(base), "__one").select(
        "run_id", *[(F.coalesce(m, F.lit(0.0)) - F.col(f"__{m}")).alias(f"d_{m}") for m in METRICS])


def _cell(df: DataFrame, name: str, digits: int = 3) -> Column:
    if df.schema[name].dataType.typeName() == "double":
        return F.coalesce(fixed(F.col(name), digits), F.lit(MISSING))
    return F.coalesce(F.col(name).cast("string"), F.lit(MISSING))


def markdown_rows(table: DataFrame) -> DataFrame:
    """Lines of the Markdown table: head (0), rule (1), then one line per run in order."""
    cells = [_cell(table, c) for c, _ in MARKDOWN]
    body = table.select(F.lit(2).alias("part"), F.col("run_id").alias("key"), F.concat(
        F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |")).alias("line"))
    head = "| " + " | ".join(h for _, h in MARKDOWN) + " |"
    rule = "|" + "|".join(["---"] * len(MARKDOWN)) + "|"
    return _with_lines(body, [(0, head), (1, rule)])


def latex_rows(table: DataFrame) -> DataFrame:
    cells = [F.replace(_cell(table, c), F.lit("_"), F.lit("\\_")) for c, _, _ in LATEX]
    body = table.select(F.lit(2).alias("part"), F.col("run_id").alias("key"), F.concat(
        F.array_join(F.array(*cells), " & "), F.lit(" \\\\")).alias("line"))
    spec = "".join(a for _, _, a in LATEX)
    head = " & ".join(h for _, h, _ in LATEX) + " \\\\"
    return _with_lines(body, [(0, f"\\begin{{tabular}}{{{spec}}}\n\\toprule\n{head}\n\\midrule"),
                              (3, "\\bottomrule\n\\end{tabular}")])


def _with_lines(body: DataFrame, extra: list[tuple[int, str]]) -> DataFrame:
    lines = F.array(*[F.struct(F.lit(p).alias("part"), F.lit("").alias("key"), F.lit(t).alias("line")) for p, t in extra])
    one = body.sparkSession.range(1).select(F.inline(lines))
    return body.unionByName(one)


def filled(template: str, *values: Column) -> Column:
    """``template`` with a column for each ``{}``."""
    first, *rest = template.split("{}")
    return F.concat(F.lit(first), *[x for v, text in zip(values, rest, strict=True) for x in (v, F.lit(text))])


def expanded_query(df: DataFrame, text: str, column: str) -> Column:
    """A short passage that names the class, its statutes and elements around the query text.

    Needs ``elements`` and ``articles`` from the class lists.
    """
    def listed(c: str, otherwise: str) -> Column:
        return F.when(F.size(c) > 0, F.array_join(c, "、")).otherwise(otherwise)
    return filled(QUERY_TEXT, F.col(column), F.col(text), listed("articles", ANY_ARTICLES), listed("elements", ANY_ELEMENTS))


def fallback_report(df: DataFrame, label: str, confidence: str, rationale: str, laws: str, quoted: int = QUOTED_LAWS,
                    length: int = QUOTED_LENGTH) -> Column:
    """Template report from class, statutes and the first statute texts (``laws`` array of struct id, text)."""
    law_lines = F.transform(F.slice(F.col(laws), 1, quoted), lambda x: F.concat(x["id"], F.lit("："), F.substring(x["text"], 1, length)))
    parts = F.array(
        filled(FACTS_TEXT, F.col(label), fixed(F.col(confidence), 2)),
        F.when(F.length(rationale) > 0, filled(RATIONALE_TEXT, F.col(rationale))),
        F.lit(LAW_HEAD),
        F.when(F.size("articles") > 0, filled(LAW_TEXT, F.array_join("articles", "、"))),
        F.when(F.size(law_lines) > 0, F.array_join(law_lines, "\n")),
        F.lit(END_HEAD),
        filled(END_TEXT, F.col(label), fixed(F.col(confidence) * 100, 0)))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n")
