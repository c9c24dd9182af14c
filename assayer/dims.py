"""Fixed dimensions: classes, statutes, elements, rubric, prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.session import values_frame

# ---- fixed values: must equal the data model's published lists -------------
# (class, kind, hint group, reward group, severity, weight group, label group)
CLASSES = [
    ("Normal", "normal", "violence", "normal", None, "default", ""),
    ("Robbery", "crime", "violence", "property", "HIGH", "property", "暴力 / 人身傷害"),
    ("RoadAccidents", "non_crime", "public_safety", "public_safety", "LOW_ACCIDENT", "default", "公共安全"),
    ("Stealing", "crime", "property", "property", "LOW_PLANNED", "property", "財產犯罪"),
    ("Burglary", "crime", "property", "property", "MEDIUM", "property", "財產犯罪"),
    ("Abuse", "crime", "violence", "violence", "MEDIUM", "default", "暴力 / 人身傷害"),
    ("Assault", "crime", "violence", "violence", "HIGH", "violent", "暴力 / 人身傷害"),
    ("Vandalism", "crime", "property", "public_safety", "MEDIUM", "public_safety", "財產犯罪"),
    ("Arrest", "non_crime", "violence", "law_enforcement", "MEDIUM", "default", "暴力 / 人身傷害"),
    ("Fighting", "crime", "violence", "violence", "MEDIUM", "violent", "暴力 / 人身傷害"),
    ("Arson", "crime", "public_safety", "public_safety", "MEDIUM", "public_safety", "公共安全"),
    ("Explosion", "non_crime", "public_safety", "public_safety", "MEDIUM", "public_safety", "公共安全"),
    ("Shoplifting", "crime", "property", "property", "LOW_PLANNED", "property", "財產犯罪"),
    ("Shooting", "crime", "violence", "violence", "HIGH", "violent", "暴力 / 人身傷害"),
]
WEIGHTS = {  # weight group -> w1 accuracy, w2 consistency, w3 legal, w4 cost
    "violent": (0.45, 0.20, 0.25, 0.10),
    "property": (0.25, 0.20, 0.45, 0.10),
    "public_safety": (0.30, 0.25, 0.35, 0.10),
    "default": (0.35, 0.20, 0.35, 0.10),
}
REWARD_WEIGHTS = (0.4, 0.3, 0.2, 0.1)
ARTICLES = {
    "Fighting": ["刑法第277條傷害罪", "刑法第281條加重傷害罪"],
    "Assault": ["刑法第277條傷害罪", "刑法第278條重傷罪"],
    "Shooting": ["刑法第271條殺人罪", "刑法第185-1條公共危險罪"],
    "Robbery": ["刑法第328條強盜罪", "刑法第330條加重強盜罪"],
    "Abuse": ["刑法第277條傷害罪", "家庭暴力防治法第2條"],
    "Arrest": ["刑法第304條強制罪", "刑法第302條妨害自由罪"],
    "Stealing": ["刑法第320條竊盜罪", "刑法第321條加重竊盜罪"],
    "Shoplifting": ["刑法第320條竊盜罪"],
    "Burglary": ["刑法第321條加重竊盜罪（侵入建築物）"],
    "Vandalism": ["刑法第354條毀損罪"],
    "Arson": ["刑法第173條放火罪", "刑法第174條放火建築物罪"],
    "Explosion": ["刑法第185-1條公共危險罪", "刑法第184條爆炸罪"],
    "RoadAccidents": ["刑法第276條過失致死罪", "刑法第185-3條不能安全駕駛罪"],
}
ELEMENTS = {
    "Assault": ["故意", "傷害行為", "傷害結果", "因果關係", "違法性"],
    "Fighting": ["互毆事實", "傷害故意", "雙方積極攻擊"],
    "Shooting": ["使用槍械或凶器", "殺傷意圖", "危害公共安全"],
    "Robbery": ["不法所有意圖", "強暴或脅迫手段", "取得財物", "因果關係"],
    "Stealing": ["不法所有意圖", "竊取行為", "他人動產", "秘密竊取"],
    "Shoplifting": ["不法所有意圖", "竊取行為", "他人動產"],
    "Burglary": ["侵入建築物", "不法所有意圖", "竊取行為"],
    "Vandalism": ["故意", "毀損行為", "他人財物", "毀損結果"],
    "Arson": ["故意", "放火行為", "燒燬建築物或財物"],
    "Explosion": ["故意或過失", "爆炸行為", "公共危險"],
    "RoadAccidents": ["過失", "違規行為", "傷亡結果", "因果關係"],
    "Abuse": ["故意", "傷害或遺棄行為", "被害人身分（家庭成員）"],
    "Arrest": ["強制行為", "妨害自由", "被害人意願"],
}
# article number -> class, by the source that uses it
ARTICLE_CLASS = {
    "statutes": {
        "271": "Shooting", "272": "Shooting", "277": "Assault", "278": "Assault", "281": "Assault",
        "325": "Robbery", "328": "Robbery", "329": "Robbery", "330": "Robbery",
        "320": "Stealing", "321": "Stealing", "354": "Vandalism", "150": "Fighting",
        "185-3": "RoadAccidents", "276": "RoadAccidents", "173": "Arson", "174": "Arson",
        "184": "Explosion", "185-1": "Explosion", "304": "Arrest",
    },
    "judgments": {
        "271": "Shooting", "272": "Shooting", "277": "Assault", "278": "Assault", "279": "Assault",
        "284": "Assault", "294": "Abuse", "295": "Abuse", "302": "Arrest", "304": "Arrest",
        "306": "Burglary", "307": "Burglary", "320": "Stealing", "321": "Stealing",
        "325": "Robbery", "326": "Robbery", "328": "Robbery", "329": "Robbery",
        "354": "Vandalism", "150": "Fighting", "173": "Arson", "174": "Arson",
        "178": "Explosion", "183": "RoadAccidents", "185-3": "RoadAccidents",
    },
}
LEGAL_TERMS = [
    "傷害", "殺人", "竊盜", "搶奪", "強盜", "毀損", "放火", "爆炸", "強制", "逮捕", "重傷", "施強暴",
    "脅迫", "遺棄", "拘禁", "侵入住宅", "竊取", "勒贖", "縱火", "故意", "過失", "意圖", "不法所有意圖",
    "殺傷意圖", "直接故意", "間接故意", "因果關係", "違法性", "有責性", "構成要件", "傷害行為", "傷害結果",
    "竊取行為", "毀損行為", "放火行為", "強暴", "互毆", "秘密竊取", "正當防衛", "緊急避難", "阻卻違法",
    "公共危險", "妨害自由", "妨害秩序", "有期徒刑", "無期徒刑", "拘役", "罰金", "未遂", "既遂", "加重", "減輕",
]
NEGATIONS = ["不該當", "不構成", "不成立", "未該當", "未構成", "無法滿足", "無法成立", "未具備", "欠缺",
             "不具有", "不具備"]
GLOBAL_NEGATIONS = ["不構成", "不成立", "不該當", "無法適用"]
GLOBAL_SCOPES = ["罪", "案", "件"]
RUBRIC = [  # NULL = set per item by the cited statutes
    ("q1_legal_relevance", 3), ("q2_element_coverage", None), ("q3_evidence_traceability", 3),
    ("q4_causal_chain", 4), ("q5_uncertainty_marking", 3), ("q6_judicial_language", 3),
    ("q7_scenario_fidelity", 3),
]
PRICES = [("claude", 3.0, 15.0), ("gemini", 0.15, 0.60), ("openai", 2.50, 10.0)]
COST_RATIOS = [(1.0, 1.0), (2.0, 1.0), (5.0, 1.0), (10.0, 1.0)]
# ---- end of fixed values ----------------------------------------------------

CLASS_COLUMNS = ["class", "kind", "hint_group", "reward_group", "severity", "weight_group", "label_group"]


def class_rows(alias: dict[str, str] | None = None) -> list[tuple]:
    """Class rows, or those of other labels that stand for a class (``alias``)."""
    if alias is None:
        return CLASSES
    by_name = {row[0]: row for row in CLASSES}
    return [(name, *by_name[target][1:]) for name, target in alias.items()]


def classes(spark: SparkSession, alias: dict[str, str] | None = None) -> DataFrame:
    """One row per class with its groups and the four evaluation weights."""
    rows = [row + WEIGHTS[row[5]] for row in class_rows(alias)]
    return values_frame(spark, rows, CLASS_COLUMNS + ["w1", "w2", "w3", "w4"])


def class_articles(spark: SparkSession, alias: dict[str, str] | None = None) -> DataFrame:
    """``class, elements, articles`` with one row per class that has any."""
    names = alias or {c: c for c in ARTICLES}
    rows = [(n, "|".join(ELEMENTS.get(t, [])), "|".join(ARTICLES.get(t, []))) for n, t in names.items()]
    flat = values_frame(spark, rows, ["class", "elements", "articles"])
    none = F.array().cast("array<string>")
    return flat.select("class", *[
        F.when(F.col(c) == "", none).otherwise(F.split(c, "\\|")).alias(c) for c in ("elements", "articles")
    ]).filter((F.size("elements") > 0) | (F.size("articles") > 0))


def article_classes(spark: SparkSession, source: str = "statutes") -> DataFrame:
    rows = list(ARTICLE_CLASS[source].items())
    return values_frame(spark, rows, ["article_id", "class"])


def rubric(spark: SparkSession) -> DataFrame:
    return values_frame(spark, RUBRIC, ["q_key", "max_score"])


def prices(spark: SparkSession) -> DataFrame:
    return values_frame(spark, PRICES, ["backend", "input_price", "output_price"])
