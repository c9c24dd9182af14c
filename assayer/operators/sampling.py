"""Caps, strata, thresholds and frame picks, in an explicit order."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators import prefix


def cap_per_class(df: DataFrame, label: str, order: str, n: int, n_classes: int, normal: str = "Normal",
                  n_normal: int = 0) -> DataFrame:
    """At most ceil(n / classes) rows per class in order, normal rows under their own cap, then n anomalies.

    The caps are the sample's definition; ``row_number <= cap`` keeps cap rows
    per class on the map side.
    """
    cap = max(1, ceil(n / n_classes))

    def first(rows: DataFrame, limit: int) -> DataFrame:
        w = Window.partitionBy(label).orderBy(order)
        return rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= limit).drop("__rn")
    anomalies = first(df.filter(F.col(label) != normal), cap).orderBy(order).limit(n)
    return anomalies.unionByName(first(df.filter(F.col(label) == normal), max(n_normal, 0)))


def backfill(df: DataFrame, label: str, key: str, priority: str, order: str, n: int) -> DataFrame:
    """Up to n rows per class, taken from the sources by priority; a key counts once."""
    once = df.groupBy(label, key).agg(F.min(F.struct(priority, order)).alias("__best"))
    w = Window.partitionBy(label).orderBy("__best")
    return (once.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
            .select(label, key, F.col("__best")[priority].alias(priority), F.col("__best")[order].alias(order)))


def stratified(df: DataFrame, stratum: str, key: str, k: int, seed: int = 42, common: DataFrame | None = None) -> DataFrame:
    """k rows per stratum in the order of a seeded hash: the same rows on every run and engine.

    With ``common`` only keys that this second source also has are drawn.
    """
    if common is not None:
        df = df.join(common.select(key).distinct(), key, "left_semi")
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def suggest_thresholds(cases: DataFrame, keys: list[str], order: str, hard: float = 0.85, soft: float = 0.70) -> DataFrame:
    """Highest-confidence cut after which the accuracy so far reaches a target, with a minimum of rows."""
    right = F.coalesce(F.col("ground_truth") == F.col("predicted"), F.lit(False)).cast("long")
    known = cases.filter(F.col("confidence").isNotNull())
    falling = 1.0 - F.col("confidence")
    r = prefix.running_totals(known, keys, prefix.tie_levels(falling, order),
                              [F.col("confidence").desc(), F.col(order)], {"i": F.lit(1).cast("long"), "hits": right})
    n = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    j = r.join(n, keys).withColumn("acc", F.col("hits") / F.col("i"))

    def cut(target: float, part: int) -> Column:
        ok = (F.col("acc") >= target) & (F.col("i") >= F.greatest(F.lit(3), F.floor(F.col("n") / part)))
        return F.min_by(F.when(ok, F.col("confidence")), F.when(ok, F.col("i")))
    return j.groupBy(*keys).agg(F.first("n").alias("n"), cut(hard, 4).alias("hard"), cut(soft, 3).alias("soft"))


def first_crossing(snippets: DataFrame, limit: float = 0.5, frames_per_snippet: int = 30) -> DataFrame:
    """First snippet over the limit per video and its first frame; NULL if none is."""
    s = snippets.groupBy("video_id").agg(F.min(F.when(F.col("score") > limit, F.col("idx"))).alias("first_idx"))
    return s.withColumn("frame", F.col("first_idx") * frames_per_snippet)


def group_advantage(df: DataFrame, group: str, value: str) -> DataFrame:
    """(value - mean) / (population deviation + 1e-8) in a group; the group's moments are joined back."""
    moments = df.groupBy(group).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__std"))
    return df.join(moments, group).withColumn(
        "advantage", (F.col(value) - F.col("__mean")) / (F.col("__std") + 1e-8)).drop("__mean", "__std")


def transitions(snippets: DataFrame) -> DataFrame:
    """State, action, reward, next state and end mark of neighbouring snippets."""
    s = prefix.following(snippets, ["video_id"], prefix.block_of("idx", 4096), ["idx"], {"next_score": "score", "next_idx": "idx"})
    last = snippets.groupBy("video_id").agg(F.max("idx").alias("__last"))
    flagged = F.col("score") > 0.5
    return s.filter(F.col("next_idx").isNotNull()).join(last, "video_id").select(
        "video_id", "idx", F.col("score").alias("state"), flagged.cast("int").alias("action"),
        F.when(flagged, F.col("score")).otherwise(1 - F.col("score")).alias("reward"),
        F.col("next_score").alias("next_state"), (F.col("next_idx") == F.col("__last")).alias("done"))


def env_summary(snippets: DataFrame) -> DataFrame:
    """Anomaly share, mean light, mean credibility and what the environment adds to the scores."""
    light = snippets.groupBy("video_id").agg(F.avg("illumination").alias("light"))
    j = snippets.join(light, "video_id")
    cred = F.least(F.greatest(0.6 * F.col("light") + 0.4 * (1 - F.col("occlusion")), F.lit(0.0)), F.lit(1.0))
    s = j.withColumn("cred", cred).groupBy("video_id").agg(
        F.avg((F.col("score") > 0.5).cast("double")).alias("anomaly_ratio"), F.first("light").alias("illumination"),
        F.avg("cred").alias("credibility"), (F.avg("score") - F.avg(F.col("score") * F.col("cred"))).alias("raw"))
    return s.select("video_id", "anomaly_ratio", "illumination", "credibility",
                    F.least(F.greatest(F.col("raw"), F.lit(0.0)), F.lit(1.0)).alias("contribution"))


# ---- positions in a sequence ------------------------------------------------------------

def snippet_positions(rows: DataFrame, snippets: int = 32, per_clip: int = 4) -> DataFrame:
    """Which rows (zero-based ``pos``) of a video a clip takes: buckets of n // snippets rows.

    Rows after the last full bucket are left out, a short bucket repeats its last row.
    """
    n = rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    size = F.greatest(F.lit(1), F.floor(F.col("n") / snippets))
    s = n.withColumn("size", size).withColumn("snippet", F.explode(F.sequence(F.lit(0), F.lit(snippets - 1))))
    s = s.withColumn("start", F.col("snippet") * F.col("size")).filter(F.col("start") < F.col("n"))
    have = F.least(F.col("start") + F.col("size"), F.col("n")) - F.col("start")
    padded = F.greatest(have, F.lit(per_clip))
    s = s.select("video_id", "snippet", "start", have.alias("have"), padded.alias("padded"),
                 F.explode(F.sequence(F.lit(0), F.lit(per_clip - 1))).alias("slot"))
    step = F.floor(F.col("slot") * (F.col("padded") - 1) / (per_clip - 1)) if per_clip > 1 else F.lit(0)
    return s.select("video_id", "snippet", "slot", (F.col("start") + F.least(step, F.col("have") - 1)).cast("long").alias("pos"))


def uniform_positions(totals: DataFrame, total: str, n: int) -> DataFrame:
    """int(i * total / n) for i < n."""
    return totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn(
        "pos", F.floor(F.col("i") * F.col(total) / n).cast("long"))


def spread_positions(totals: DataFrame, total: str, k: int) -> DataFrame:
    """round(i * (total - 1) / (picks - 1)), ends included, without repeats."""
    picks = F.least(F.lit(k), F.col(total))
    pos = F.transform(F.sequence(F.lit(0).cast("long"), picks - 1), lambda i: F.when(picks > 1, F.bround(
        i * (F.col(total) - 1) / (picks - 1), 0)).otherwise(F.lit(0.0)).cast("long"))
    return totals.filter(F.col(total) > 0).select("*", F.explode(F.array_sort(F.array_distinct(pos))).alias("pos"))


# ---- covered frames -----------------------------------------------------------------------

def cover(intervals: DataFrame, total_frames: int, fps: float) -> DataFrame:
    """Union of the intervals per video as disjoint frame ranges ``start_frame, end_frame`` (inclusive).

    Starts and ends become +1 and -1 at their frame and are summed per frame, so
    a video keeps at most one row per frame whatever its number of intervals;
    the running depth over these rows shows where a range opens and closes.
    """
    lo = F.greatest(F.floor(F.col("start_s") * fps), F.lit(0)).cast("long")
    hi = F.least(F.floor(F.col("end_s") * fps) + 1, F.lit(total_frames)).cast("long")
    edges = intervals.select("video_id", lo.alias("lo"), hi.alias("hi")).filter("lo < hi").select("video_id", F.inline(F.array(
        F.struct(F.col("lo").alias("frame"), F.lit(1).alias("step")), F.struct(F.col("hi").alias("frame"), F.lit(-1).alias("step")))))
    steps = edges.groupBy("video_id", "frame").agg(F.sum("step").alias("step")).filter("step <> 0")
    depth = prefix.running_totals(steps, ["video_id"], [prefix.block_of("frame", 16384)], ["frame"], {"depth": F.col("step")})
    turns = depth.filter((F.col("depth") == 0) | (F.col("depth") - F.col("step") == 0))  # opens and closes, in turn
    ends = prefix.following(turns, ["video_id"], prefix.block_of("frame", 16384), ["frame"], {"close": "frame"})
    return ends.filter("depth > 0").select("video_id", F.col("frame").alias("start_frame"), (F.col("close") - 1).alias("end_frame"))


def _pieces(covered: DataFrame) -> DataFrame:
    """Ranges with the number of covered frames before them and in all."""
    length = F.col("end_frame") - F.col("start_frame") + 1
    run = prefix.running_totals(covered, ["video_id"], [prefix.block_of("start_frame", 16384)], ["start_frame"], {"upto": length})
    total = covered.groupBy("video_id").agg(F.sum(length).alias("n_covered"))
    return run.join(total, "video_id").withColumn("before", F.col("upto") - length)


def covered_picks(covered: DataFrame, n: int) -> DataFrame:
    """Frames int(i * covered / n) of the sorted covered frames, i < n; all of them where there are fewer.

    Each range finds the wanted positions that fall into it, so no frame list is formed.
    """
    p = _pieces(covered)
    want = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("n_covered") / n))
    inside = F.filter(want, lambda j: (j >= F.col("before")) & (j < F.col("upto")))
    some = F.transform(inside, lambda j: F.col("start_frame") + j - F.col("before"))
    every = F.sequence(F.col("start_frame"), F.col("end_frame"))
    picks = F.when(F.col("n_covered") >= n, some).otherwise(F.when(F.col("n_covered") < n, every))
    return p.select("video_id", F.explode(picks).alias("frame"))


def _first_frames(picks: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("frame")
    return (picks.select("video_id", F.col("frame").cast("long").alias("frame")).distinct()
            .withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn"))


def guided_picks(videos: DataFrame, intervals: DataFrame, total_frames: int, fps: float, n: int) -> DataFrame:
    """70 % of n frames from the covered ones, the rest uniform; uniform only for a video without coverage."""
    n_event = int(n * 0.7)
    n_context = n - n_event
    covered = cover(intervals, total_frames, fps)
    totals = videos.select("video_id", F.lit(total_frames).alias("total")).distinct()
    bare = totals.join(covered.select("video_id").distinct(), "video_id", "left_anti")
    seen = totals.join(covered.select("video_id").distinct(), "video_id", "left_semi")
    picks = covered_picks(covered, n_event).unionByName(
        uniform_positions(seen, "total", n_context).select("video_id", F.col("pos").alias("frame"))).unionByName(
        uniform_positions(bare, "total", n).select("video_id", F.col("pos").alias("frame")))
    return _first_frames(picks, n)


def mixed_picks(snippets: DataFrame, intervals: DataFrame, total_frames: int, fps: float, n: int = 8) -> DataFrame:
    """Half from the most anomalous snippets, a quarter covered, the rest uniform."""
    n_top, n_cover = n // 2, n // 4
    n_context = n - n_top - n_cover
    counts = snippets.groupBy("video_id").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("video_id").orderBy(F.col("score").desc(), "idx")
    top = snippets.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n_top).join(counts, "video_id")
    per = F.greatest(F.lit(1), F.floor(F.lit(total_frames) / F.col("__n")))
    mids = top.select("video_id", F.least(F.col("idx") * per + F.floor(per / 2), F.lit(total_frames - 1)).alias("frame"))
    context = uniform_positions(counts.select("video_id", F.lit(total_frames).alias("total")), "total", n_context)
    ours = cover(intervals, total_frames, fps).join(counts, "video_id", "left_semi")
    sampled = covered_picks_repeated(ours, n_cover)
    return _first_frames(mids.unionByName(sampled).unionByName(context.select("video_id", F.col("pos").alias("frame"))), n)


def covered_picks_repeated(covered: DataFrame, n: int) -> DataFrame:
    """As :func:`covered_picks`, but short coverage repeats frames instead of giving all of them."""
    p = _pieces(covered)
    want = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("n_covered") / n))
    inside = F.filter(want, lambda j: (j >= F.col("before")) & (j < F.col("upto")))
    return p.select("video_id", F.explode(F.transform(inside, lambda j: F.col("start_frame") + j - F.col("before"))).alias("frame"))


def key_frames(snippets: DataFrame, total_frames: int, top: int = 3, n: int = 8) -> DataFrame:
    """First frames of the top snippets, filled up with every (total // 5)-th frame."""
    counts = snippets.groupBy("video_id").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("video_id").orderBy(F.col("score").desc(), "idx")
    best = snippets.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= top).join(counts, "video_id")
    starts = best.select("video_id", (F.col("idx") * F.floor(F.lit(total_frames) / F.col("__n"))).alias("frame"), F.lit(0).alias("p"))
    step = max(1, total_frames // 5)
    fill = list(range(0, total_frames, step))
    fills = counts.select("video_id", F.explode(F.array(*[F.lit(f).cast("long") for f in fill])).alias("frame"), F.lit(1).alias("p"))
    once = starts.unionByName(fills).groupBy("video_id", "frame").agg(F.min("p").alias("p"))
    rank = Window.partitionBy("video_id").orderBy("p", "frame")
    return once.withColumn("__rn", F.row_number().over(rank)).filter(F.col("__rn") <= n).select("video_id", "frame")
