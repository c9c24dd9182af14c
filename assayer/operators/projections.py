"""Column rules of single cases: flags, gates, rewards, bands and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.dims import REWARD_WEIGHTS

# ---- fixed values ---------------------------------------------------------------
EMOTIONS = ["angry", "disgust", "fear", "happy", "sad", "surprise", "neutral"]
TENSE_EMOTIONS = ["angry", "fear", "disgust"]
PRE_NOTES = {
    "violence": "人員間肢體距離縮短，存在對峙跡象",
    "property": "嫌疑人有環境偵察行為，鎖定目標物",
    "public_safety": "場景出現可疑物品或車輛異常移動",
}
POST_NOTES = [  # classes -> note
    (["Assault", "Fighting", "Shooting", "Robbery"], "受害者出現防禦性姿態或倒地行為"),
    (["Stealing", "Shoplifting", "Burglary"], "嫌疑人快速離開現場，攜帶隱匿物品"),
    (["Arson", "Explosion"], "現場出現煙霧或人員逃散"),
]
POST_SCATTER, POST_NONE = "事後現場人員快速散離", "事後行為正常，需進一步觀察"
SCENE_RISK = {"outdoor_street": "medium", "outdoor_parking": "high", "indoor_store": "medium",
              "indoor_office": "low", "vehicle": "high", "unknown": "medium"}
LIGHT_NOTES = [(0.3, "嚴重光線不足，視覺證據可信度低"), (0.6, "光線不佳，部分細節可能失真")]
LIGHT_GOOD = "光線條件良好"
ICC_BANDS = [(0.5, "poor (< 0.5)"), (0.75, "moderate (0.5–0.75)"), (0.9, "good (0.75–0.9)")]
ICC_TOP = "excellent (≥ 0.9)"
STARS = [(0.001, "***"), (0.01, "**"), (0.05, "*")]
DARK, BRIGHT, IDEAL = 50.0, 200.0, 120.0
# ---- end of fixed values ----------------------------------------------------------


def below(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first step the value lies under."""
    out = None
    for limit, label in steps:
        out = F.when(value < limit, label) if out is None else out.when(value < limit, label)
    return F.when(value.isNull(), F.lit("N/A")).otherwise(out.otherwise(otherwise))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def class_from_id(identifier: str) -> Column:
    """Leading letters before a digit; ``Normal`` for normal or unreadable ids."""
    name = F.regexp_extract(identifier, "^([A-Za-z]+)[0-9]+", 1)
    return F.when(F.col(identifier).startswith("Normal") | (name == ""), "Normal").otherwise(name)


def with_class_flags(cases: DataFrame, classes: DataFrame, normal: str = "Normal") -> DataFrame:
    kinds = F.broadcast(classes.select("class", "kind"))  # fixed list
    c = cases.join(kinds.withColumnsRenamed({"class": "ground_truth", "kind": "gt_kind"}), "ground_truth", "left")
    c = c.join(kinds.withColumnsRenamed({"class": "predicted", "kind": "pred_kind"}), "predicted", "left")
    gt, pred = F.coalesce("gt_kind", F.lit("none")), F.coalesce("pred_kind", F.lit("none"))
    return c.withColumns({
        "gt_is_crime": gt == "crime", "gt_is_non_crime": gt == "non_crime",
        "pred_is_crime": pred == "crime", "pred_is_non_crime": pred == "non_crime",
        "is_non_crime_anomaly": pred == "non_crime",
        "is_anomaly_gt": F.col("ground_truth") != normal, "is_anomaly_pred": F.col("predicted") != normal,
        "anomaly_correct": (F.col("ground_truth") != normal) == (F.col("predicted") != normal),
    }).drop("gt_kind", "pred_kind")


def with_class_dims(df: DataFrame, classes: DataFrame, column: str) -> DataFrame:
    """Groups, severity and weights of the class in ``column``; defaults for unknown classes."""
    dim = F.broadcast(classes.withColumnRenamed("class", column))
    j = df.join(dim, column, "left")
    return j.withColumns({
        "hint_group": F.coalesce("hint_group", F.lit("violence")),
        "reward_group": F.coalesce("reward_group", F.lit("unknown")),
        "severity": F.coalesce("severity", F.lit("MEDIUM")),
        "weight_group": F.coalesce("weight_group", F.lit("default")),
        "label_group": F.coalesce("label_group", F.lit("")),
        "w1": F.coalesce("w1", F.lit(0.35)), "w2": F.coalesce("w2", F.lit(0.20)),
        "w3": F.coalesce("w3", F.lit(0.35)), "w4": F.coalesce("w4", F.lit(0.10)),
    })


def with_defaults(df: DataFrame, numbers: list[str], labels: dict[str, str]) -> DataFrame:
    return df.withColumns({**{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers},
                           **{c: F.coalesce(F.col(c), F.lit(v)) for c, v in labels.items()}})


def gate(df: DataFrame, tau: float | None, normal: str = "Normal") -> DataFrame:
    """Below the threshold the class becomes normal; no threshold switches the gate off."""
    gated = F.lit(False) if tau is None else F.coalesce(F.col("score") < tau, F.lit(False))
    return df.withColumns({"gated": gated, "gated_class": F.when(gated, normal).otherwise(F.col("predicted"))})


def ensemble(v: Column, conf_v: Column, m: Column, conf_m: Column, normal: str = "Normal") -> Column:
    """Second opinion wins only if it is sure, the first is not, and its weighted vote is larger."""
    contested = (conf_v < 0.7) & (m != v) & (conf_m > 0.55) & ~m.isin(normal, "")
    return F.when(contested & (0.3 * conf_m > 0.7 * conf_v), m).otherwise(v)


def revote(gated: Column, used: Column, v: Column, conf: Column, conflict: Column, consensus: Column,
           normal: str = "Normal") -> Column:
    hard = (conflict == "HARD") & (conf < 0.6) & (consensus != v) & (consensus != normal)
    return (F.when(gated, normal).when(used & hard, consensus).when(used, v).otherwise(consensus))


def route(kind: Column) -> dict[str, Column]:
    """Which path a case takes and what the short path sets."""
    short = kind == "non_crime"
    return {
        "path": F.when(kind == "crime", "legal").when(short, "descriptive").otherwise("template"),
        "rcons_out": F.when(short, F.lit(1.0)).otherwise(F.col("rcons")),
        "rlegal_out": F.when(short, F.lit(0.0)).otherwise(F.col("rlegal")),
        "conflict_out": F.when(short, "NONE").otherwise(F.col("conflict_type")),
    }


def cost_step(turns: Column, severity: Column, low: int = 4) -> Column:
    """0 up to ``low``, linear to the upper limit (10 for high severity, else 8), then 1."""
    high = F.when(severity == "HIGH", 10).otherwise(8)
    return (F.when(turns <= low, F.lit(0.0)).when(high <= low, F.lit(1.0))
            .when(turns <= high, (turns - low) / (high - low)).otherwise(F.lit(1.0)))


def cost_log(turns: Column) -> Column:
    return F.ln(F.greatest(F.lit(1), turns))


def accuracy_tier(pred: Column, truth: Column, pred_group: Column, truth_group: Column) -> Column:
    return (F.when(pred == truth, F.lit(1.0))
            .when((pred_group == truth_group) & (pred_group != "normal"), F.lit(0.5)).otherwise(F.lit(0.0)))


def reward(acc: Column, cons: Column, legal: Column, cost: Column, weights=REWARD_WEIGHTS) -> Column:
    w1, w2, w3, w4 = [w if isinstance(w, Column) else F.lit(w) for w in weights]
    return w1 * acc + w2 * cons + w3 * legal - w4 * cost


def shifted_weights(env_confidence: Column) -> tuple[Column, Column, Column, Column]:
    """A weak environment moves weight from cost to consistency."""
    weak = F.coalesce(env_confidence < 0.4, F.lit(False))
    return (F.col("w1"), F.when(weak, F.least(F.col("w2") + 0.05, F.lit(0.30))).otherwise(F.col("w2")), F.col("w3"),
            F.when(weak, F.greatest(F.col("w4") - 0.05, F.lit(0.05))).otherwise(F.col("w4")))


def icc_band(value: Column) -> Column:
    return below(value, ICC_BANDS, ICC_TOP)


def stars(p: Column) -> Column:
    return below(p, STARS, "")


def light_note(value: Column) -> Column:
    return below(value, LIGHT_NOTES, LIGHT_GOOD)


def scene_risk(scene: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SCENE_RISK.items() for x in pair])
    return F.coalesce(table[scene], F.lit("medium"))


def escalation_label(value: Column, middle: float = 0.7, high: float = 0.7) -> Column:
    return F.when(value > high, "高度升溫").when(value > middle, "中度升溫").otherwise("低度升溫")


def pre_indicators(group: Column, emotion: Column) -> Column:
    tense = F.when(emotion.isin(*TENSE_EMOTIONS),
                   F.concat(F.lit("偵測到事前情緒："), emotion, F.lit("（可能的衝突前兆）")))
    notes = [F.when(group == g, F.lit(t)) for g, t in PRE_NOTES.items()]
    return F.filter(F.array(tense, *notes), lambda x: x.isNotNull())


def post_indicators(label: Column, escalation: Column, alias: dict[str, str] | None = None) -> Column:
    def names(classes):
        return classes if alias is None else [a for a, c in alias.items() if c in classes]
    notes = [F.when(escalation > 0.6, F.lit(POST_SCATTER))]
    notes += [F.when(label.isin(*names(c)), F.lit(t)) for c, t in POST_NOTES if names(c)]
    found = F.filter(F.array(*notes), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit(POST_NONE))).otherwise(found)


def illumination(mean_l: Column) -> Column:
    score = (F.when(mean_l < DARK, mean_l / DARK * 0.4)
             .when(mean_l > BRIGHT, F.greatest(F.lit(0.0), 1.0 - (mean_l - BRIGHT) / 55.0 * 0.4))
             .otherwise(1.0 - F.abs(mean_l - IDEAL) / IDEAL * 0.3))
    return F.when(mean_l.isNull(), F.lit(0.5)).otherwise(clip(score, 0.0, 1.0))


def credibility(light: Column, occlusion: Column) -> Column:
    return clip(0.6 * light + 0.4 * (1.0 - occlusion), 0.0, 1.0)


def segment_structs(timestamps: Column, sentences: Column, fps: float = 25.0) -> Column:
    """Zip spans and sentences to segments; frames are cut, not rounded."""
    pairs = F.arrays_zip(timestamps.alias("span"), sentences.alias("text"))
    return F.transform(pairs, lambda p: F.struct(
        p["span"][0].alias("start_s"), p["span"][1].alias("end_s"), p["text"].alias("description"),
        (p["span"][0] * fps).cast("int").alias("start_frame"), (p["span"][1] * fps).cast("int").alias("end_frame")))
