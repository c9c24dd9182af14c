"""Citations of statutes in reports and the legal score built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.dims import GLOBAL_NEGATIONS, GLOBAL_SCOPES, NEGATIONS

# ---- fixed values -------------------------------------------------------------------
CITED = "第\\s*([0-9]+(?:\\s*-\\s*[A-Za-z0-9]+)?)\\s*條"
CITED_CHINESE = "第\\s*([〇零一二三四五六七八九十百千]+)\\s*條"
SCORED = "第\\s*([0-9]+(?:-[0-9]+)?)\\s*條"
DIGITS = {"〇": 0, "零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
NUMERAL = "^(?=.)(?:[一二三四五六七八九]?千)?[〇零]*(?:[一二三四五六七八九]?百)?[〇零]*(?:[一二三四五六七八九]?十)?[〇零]*[一二三四五六七八九]?$"
WINDOW = 160
DEFAULT_ELEMENTS = 4
# ---- end of fixed values ----------------------------------------------------------------


def _value(table: dict[str, int], s: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), s)


def chinese_number(s: Column) -> Column:
    """Value of a Chinese numeral up to thousands; NULL where it is not one.

    The sum of all pairs of a digit (one, if it is missing) and a unit, and of a last digit without unit.
    """
    pairs = F.regexp_extract_all(s, F.lit("[一二三四五六七八九]?[千百十]"), F.lit(0))
    total = F.aggregate(pairs, F.lit(0), lambda acc, p: acc + F.coalesce(
        _value(DIGITS, F.substring(p, 1, 1)), F.lit(1)) * _value(UNITS, F.right(p, F.lit(1))))
    return F.when(s.rlike(NUMERAL), total + F.coalesce(_value(DIGITS, F.regexp_extract(s, "[一二三四五六七八九]$", 0)), F.lit(0)))


def cited_articles(text: Column) -> Column:
    """Distinct article ids: Arabic numbers without blanks, then Chinese numerals as numbers."""
    arabic = F.transform(F.regexp_extract_all(text, F.lit(CITED), F.lit(1)), lambda x: F.regexp_replace(x, "\\s+", ""))
    chinese = F.transform(F.regexp_extract_all(text, F.lit(CITED_CHINESE), F.lit(1)),
                          lambda x: chinese_number(x).cast("string"))
    return F.array_distinct(F.concat(arabic, F.filter(chinese, lambda x: x.isNotNull())))


def infer_class(df: DataFrame, key: str, articles: Column, mapping: DataFrame, other: str = "Other") -> DataFrame:
    """Class of the first cited article that has one."""
    cited = df.select(key, F.posexplode(F.array_distinct(articles)).alias("pos", "article_id"))
    hits = cited.join(F.broadcast(mapping), "article_id").groupBy(key).agg(  # fixed article list
        F.min_by("class", "pos").alias("class"))
    return df.select(key).join(hits, key, "left").select(key, F.coalesce("class", F.lit(other)).alias("class"))


def join_citations(df: DataFrame, key: str, text: str, statutes: DataFrame) -> DataFrame:
    """One row per report and cited article that the statutes know."""
    cited = df.select(key, F.explode(cited_articles(F.col(text))).alias("article_id"))
    return cited.join(statutes, "article_id")


def with_class_articles(df: DataFrame, expected: DataFrame, column: str) -> DataFrame:
    """Expected articles and elements of the class in ``column`` and the articles of other classes.

    ``expected`` rows: ``class, article_nos array, elements array`` (one per class).
    """
    every = expected.agg(F.array_distinct(F.flatten(F.collect_list("article_nos"))).alias("all_nos")).withColumn(
        "__one", F.lit(0))  # the whole statute list of a fixed class list
    dim = expected.withColumn("__one", F.lit(0)).join(F.broadcast(every), "__one").select(
        F.col("class").alias(column), "article_nos", "elements",
        F.array_except("all_nos", "article_nos").alias("other_nos"))
    everyone = every.select("__one", F.col("all_nos").alias("__all"))
    j = df.join(F.broadcast(dim), column, "left").withColumn("__one", F.lit(0)).join(F.broadcast(everyone), "__one")
    empty = F.array().cast("array<string>")
    return j.withColumns({
        "article_nos": F.coalesce("article_nos", empty), "elements": F.coalesce("elements", empty),
        "other_nos": F.coalesce("other_nos", "__all")}).drop("__one", "__all")


def article_overlap(text: Column) -> dict[str, Column]:
    """Cited articles, those expected, and those of other classes (needs :func:`with_class_articles`)."""
    cited = F.array_distinct(F.regexp_extract_all(text, F.lit(SCORED), F.lit(1)))
    return {"cited": cited, "hits": F.array_intersect(cited, "article_nos"), "strays": F.array_intersect(cited, "other_nos")}


def element_covered(text: Column, element: Column, window: int = WINDOW) -> Column:
    """Some occurrence of the element has no negation in itself and the characters after it.

    The text is split at the element. What follows occurrence i is the rest of
    the pieces joined by the element again, so recurring elements stay in view;
    every element has a character, so ``window + 1`` pieces are always enough.
    """
    parts = F.split(text, F.concat(F.lit("\\Q"), element, F.lit("\\E")), -1)
    negation = "|".join(NEGATIONS)

    def positive(i: Column) -> Column:
        after = F.substring(F.call_function("array_join", F.slice(parts, i + 1, window + 1), element), 1, window)
        return ~F.concat(element, after).rlike(negation)
    return F.when(F.size(parts) > 1, F.exists(F.sequence(F.lit(1), F.size(parts) - 1), positive)).otherwise(F.lit(False))


def legal_score(df: DataFrame, text: str, expected: DataFrame, column: str) -> DataFrame:
    """0.4 article F1 + 0.3 element coverage + 0.3 focus, rounded to 3 places."""
    body = F.col(text)
    d = with_class_articles(df, expected, column).withColumns(article_overlap(body))
    hits, cited, wanted = F.size("hits"), F.size("cited"), F.size("article_nos")
    p, r = hits / cited, hits / wanted
    tier1 = F.when((cited > 0) & (wanted > 0) & (hits > 0), 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    covered = F.size(F.filter("elements", lambda e: element_covered(body, e)))
    negated = "(" + "|".join(GLOBAL_NEGATIONS) + ")本[" + "".join(GLOBAL_SCOPES) + "]|本[" + "".join(
        GLOBAL_SCOPES) + "](" + "|".join(GLOBAL_NEGATIONS) + ")"
    tier2 = F.when(F.size("elements") > 0, covered / F.size("elements") * F.when(body.rlike(negated), 0.3).otherwise(1.0)
                   ).otherwise(F.lit(0.0))
    tier3 = F.greatest(F.lit(0.0), 1 - F.size("strays") / 3)
    return d.withColumns({"tier1": tier1, "tier2": tier2, "tier3": tier3}).withColumn(
        "rlegal", F.round(0.4 * F.col("tier1") + 0.3 * F.col("tier2") + 0.3 * F.col("tier3"), 3))


def dynamic_max(df: DataFrame, key: str, text: str, statutes: DataFrame, default: int = DEFAULT_ELEMENTS) -> DataFrame:
    """Largest element count of the cited statutes of a report, else the default."""
    counts = statutes.select("article_id", F.size("elements").alias("n_elements")).filter("n_elements > 0")
    found = join_citations(df, key, text, counts).groupBy(key).agg(F.max("n_elements").alias("q2_max"))
    return df.select(key).join(found, key, "left").select(key, F.coalesce("q2_max", F.lit(default)).alias("q2_max"))
