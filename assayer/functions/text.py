"""Text columns: tokens, sections, spans, chunks, labels, JSON rescue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------
ARTICLE = "第[\\s　]*([0-9]+(?:-[0-9]+)?)[\\s　]*條"
SECTION_TYPES = [
    ("facts", "事\\s*實|犯罪事實|案情概要"),
    ("legal_reasoning", "理\\s*由|法律理由|論罪科刑"),
    ("verdict", "主\\s*文|判決主文"),
]
# longer header words first where one holds another, as a scan from the left finds them
HEADERS = "事\\s*實|犯罪事實|案情概要|理\\s*由|法律理由|論罪科刑|主\\s*文|判決主文"
CATEGORY = "category:\\s*(\\w+)"
LEADING, YES, NO = "^\\s*['\"`]*\\s*(yes|no)\\b", "\\byes\\b", "\\bno\\b"
JUDGMENT_SPANS = {  # field -> start patterns, end patterns, cap
    "facts": (["犯\\s*罪\\s*事\\s*實", "事\\s*實\\s*及\\s*理\\s*由", "一[、，]\\s*事\\s*實"],
              ["理\\s*由", "論\\s*罪\\s*科\\s*刑", "二[、，]"], 1500),
    "legal_reasoning": (["理\\s*由", "論\\s*罪\\s*科\\s*刑\\s*之\\s*理\\s*由", "二[、，]\\s*理\\s*由"],
                        ["據\\s*上\\s*論\\s*斷", "主\\s*文", "三[、，]"], 1500),
    "verdict": (["主\\s*文"], ["事\\s*實", "理\\s*由"], 500),
}
CASE_ID = "((?:最高法院|臺灣高等法院|高等法院|地方法院)[^\\n]{0,20}(?:[0-9]{2,3})年[^\\n]{0,10}第[0-9]+號)"
COURT = "(最高法院|臺灣高等法院(?:臺[中南東]分院)?|臺灣[^，\\n]{2,6}(?:地方)?法院)"
UNKNOWN_COURT = "未知法院"
OPEN_END = 2000
CHAPTER_LINE = "^[第一二三四五六七八九十章節篇\\s]+$"
# ---- end of fixed values ----------------------------------------------------------------

MARK = "\u0001"
#: White space that the SQL of the queries knows as such, and the space separators of Unicode.
WHITE = " \t\n\f\r"
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def words(text: Column) -> Column:
    """Lower-case runs of letters; Han letters are left to :func:`han_grams`."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}&&[^\\p{IsHan}]]+"), F.lit(0))


def han_grams(text: Column) -> Column:
    """Single characters and pairs of neighbours of each run of Han letters."""
    runs = F.regexp_extract_all(text, F.lit("\\p{IsHan}+"), F.lit(0))
    grams = F.transform(runs, lambda r: F.concat(
        F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, F.lit(1))),
        F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
         .otherwise(F.array().cast("array<string>"))))
    return F.when(text.rlike("\\p{IsHan}"), F.flatten(grams)).otherwise(F.array().cast("array<string>"))


def article_numbers(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("條")), F.regexp_extract_all(text, F.lit(ARTICLE), F.lit(1))).otherwise(
        F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Words, Han grams and article numbers as one token list."""
    return F.concat(words(text), han_grams(text), article_numbers(text))


def sections(df: DataFrame, text: str, types: list[tuple[str, str]] | None = None, headers: str | None = None,
             min_chars: int = 50, fallback: int = 1000) -> DataFrame:
    """Text cut at every section header; rows are ``section_no, type, content``.

    Headers are marked by one left-to-right pass, then the text is split at the
    marks. Short sections are dropped; a text without any section gives its
    first characters as type ``full``.
    """
    types = types or SECTION_TYPES
    headers = headers or "|".join(p for _, p in types)
    pieces = F.split(F.regexp_replace(F.col(text), f"({headers})", MARK + "$1"), MARK)
    def typed(piece: Column) -> Column:
        head = F.regexp_extract(piece, f"^(?:{headers})", 0)
        out = None
        for label, pattern in types:
            out = F.when(head.rlike(pattern), label) if out is None else out.when(head.rlike(pattern), label)
        return out
    cut = F.filter(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p, i: F.struct(
        (i + 1).alias("section_no"), typed(p).alias("type"), F.trim(p).alias("content"))),
        lambda s: F.length(s["content"]) >= min_chars)
    whole = F.array(F.struct(F.lit(0).alias("section_no"), F.lit("full").alias("type"),
                             F.substring(text, 1, fallback).alias("content")))
    rows = F.when(F.size(cut) > 0, cut).when(F.length(text) > 0, whole)
    return df.select("*", F.inline(rows))


def _first_of(options: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = None
    for cond, value in options:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise)


def with_between(df: DataFrame, text: str, spans: dict[str, tuple[list[str], list[str]]], open_end: int = OPEN_END) -> DataFrame:
    """Columns with the text from the first matching start pattern to the first matching end pattern after it.

    Patterns are tried in order; without an end the next characters are taken;
    without a start the result is empty. The two steps are two projections, so
    the text after the start is found once and not once per end pattern.
    """
    t = F.col(text)
    after = df.withColumns({f"__after_{f}": _first_of(
        [(t.rlike(p), F.regexp_extract(t, f"(?s)^.*?(?:{p})(.*)$", 1)) for p in starts], F.lit("")) for f, (starts, _) in spans.items()})
    upto = after.withColumns({f"__upto_{f}": _first_of(
        [(F.col(f"__after_{f}").rlike(p), F.regexp_extract(f"__after_{f}", f"(?s)^(.*?)(?:{p})", 1)) for p in ends],
        F.substring(f"__after_{f}", 1, open_end)) for f, (_, ends) in spans.items()})
    return upto.withColumns({f: F.regexp_replace(strip(F.col(f"__upto_{f}")), "^[：:]\\s*", "") for f in spans}).drop(
        *[f"__after_{f}" for f in spans], *[f"__upto_{f}" for f in spans])


def strip(text: Column) -> Column:
    """Trim of every white space, line ends included."""
    return F.trim(text, F.lit(WHITE))


def judgment_fields(df: DataFrame, text: str, name: str, spans: dict | None = None, case_id: str = CASE_ID,
                    court: str = COURT, whole: int = 3000, half_cap: int = 1500) -> DataFrame:
    """Fields of one judgment: id, court, spans, and halves where neither main span is found."""
    spans = spans or JUDGMENT_SPANS
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "\\r\\n", "\n"), " {2,}", " ")
    d = df.withColumn("__t", clean)
    t = F.col("__t")
    d = with_between(d, "__t", {f"__{f}": (s, e) for f, (s, e, _) in spans.items()})
    missing = (F.col("__facts") == "") & (F.col("__legal_reasoning") == "")
    mid = F.floor(F.length(t) / 2).cast("int")
    halves = {"facts": F.substring(F.substring(t, F.lit(1), mid), 1, half_cap),
              "legal_reasoning": F.substring(F.substring(t, mid + 1, F.length(t)), 1, half_cap)}
    found_id, found_court = F.regexp_extract(t, case_id, 1), F.regexp_extract(F.substring(t, 1, 500), court, 1)
    cut = {f: F.substring(f"__{f}", 1, cap) for f, (_, _, cap) in spans.items()}
    fields = {f: F.when(missing, halves[f]).otherwise(c) if f in halves else c for f, c in cut.items()}
    return d.withColumns({
        "case_id": F.when(found_id != "", found_id).otherwise(F.col(name)),
        "court": F.when(found_court != "", found_court).otherwise(F.lit(UNKNOWN_COURT)),
        **fields, "content": F.substring(t, 1, whole),
    }).drop("__t", *[f"__{f}" for f in spans])


def statute_articles(df: DataFrame, text: str, law_name: str = "中華民國刑法") -> DataFrame:
    """Articles of a full code: header line, then the lines up to the next article number."""
    pieces = F.split(F.regexp_replace(F.col(text), f"({ARTICLE.replace('([', '(?:[', 1)})", MARK + "$1"), MARK)
    piece = df.select("*", F.posexplode(pieces).alias("article_pos", "__piece"))
    head = "^" + ARTICLE + "[\\s　]*(?:（[^）]*）)?[\\s　]*\\n"
    one = piece.filter(F.col("__piece").rlike(head)).select(
        *df.columns, "article_pos", F.regexp_extract("__piece", head, 1).alias("article_id"),
        strip(F.regexp_replace("__piece", head, "")).alias("__body"))
    lines = F.filter(F.split("__body", "\\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(CHAPTER_LINE))
    content = F.concat(F.lit("第"), F.col("article_id"), F.lit("條\n"), F.array_join(lines, "\n"))
    return (one.withColumn("content", content).filter(F.length(strip(F.col("content"))) >= 10)
            .withColumn("law_name", F.lit(law_name)).drop("__body"))


def paragraphs(df: DataFrame, text: str, min_chars: int = 80) -> DataFrame:
    """Paragraphs between blank lines with their own citations, else those of the document."""
    own = article_numbers_strict("paragraph")
    split = df.select("*", article_numbers_strict(text).alias("__all"),
                      F.posexplode(F.split(F.col(text), "\\n{2,}")).alias("paragraph_idx", "paragraph"))
    kept = split.withColumn("paragraph", strip(F.col("paragraph"))).filter(F.length("paragraph") >= min_chars)
    return kept.withColumn("articles", F.array_distinct(
        F.when(F.size(own) > 0, own).otherwise(F.col("__all")))).drop("__all")


def article_numbers_strict(text: str) -> Column:
    """Numbers cited as ``刑法第N條`` without blanks."""
    return F.regexp_extract_all(F.col(text), F.lit("刑法第([0-9]+(?:-[0-9]+)?)條"), F.lit(1))


def chunks(df: DataFrame, text: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """Fixed windows that overlap; the last one ends with the text."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1)).cast("int")
    return df.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no")).withColumn(
        "chunk", F.substring(F.col(text), F.col("chunk_no") * step + 1, F.lit(size)))


def keywords(text: Column, terms: list[str]) -> Column:
    """Dictionary terms the text holds, sorted."""
    return F.filter(F.array(*[F.lit(t) for t in sorted(set(terms))]), lambda t: F.contains(text, t))


def label(response: Column, labels: list[str], normal: str = "Normal") -> Column:
    """Class named after ``CATEGORY:``, else the first listed class in the text, else normal."""
    low = F.lower(response)
    named = F.regexp_extract(low, CATEGORY, 1)
    options = F.array(*[F.lit(x) for x in labels])
    exact = F.filter(options, lambda x: F.lower(x) == named)
    inside = F.filter(options, lambda x: F.contains(low, F.lower(x)))
    return F.coalesce(F.get(exact, F.lit(0)), F.get(inside, F.lit(0)), F.lit(normal))


def yes_no(response: Column) -> Column:
    """A leading yes or no decides, else the more frequent word; a tie is no."""
    low = F.trim(F.lower(F.coalesce(response, F.lit(""))))
    lead = F.regexp_extract(low, LEADING, 1)
    return F.when(lead != "", lead == "yes").otherwise(
        F.regexp_count(low, F.lit(YES)) > F.regexp_count(low, F.lit(NO)))


def two_stage(first: Column, second: Column, labels: list[str], fallback: str, normal: str = "Normal") -> Column:
    """No anomaly in stage one is normal; an unreadable stage two is the fallback class."""
    named = label(second, [x for x in labels if x != normal], normal="")
    return F.when(~yes_no(first), normal).when(named == "", fallback).otherwise(named)


def without_thoughts(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?s)<think>.*?</think>", ""))


def matched_ratio(text: Column) -> dict[str, Column]:
    """Fields of ``ELEMENTS_MATCHED: a/b`` and ``REASON:`` lines."""
    pattern = "(?i)ELEMENTS_MATCHED:\\s*([0-9]+)\\s*/\\s*([0-9]+)"
    a, b = F.regexp_extract(text, pattern, 1).try_cast("int"), F.regexp_extract(text, pattern, 2).try_cast("int")
    return {"matched": a, "total": b, "ratio": a / F.greatest(b, F.lit(1)),
            "reason": F.trim(F.regexp_extract(text, "(?i)REASON:\\s*([^\\n]*)", 1))}


def salvage_json(text: Column) -> Column:
    """Object of a response: all of it, else a fenced block, else first brace to last, else NULL."""
    def parse(candidate: Column) -> Column:
        # from_json on text that is no object gives NULL under PERMISSIVE only as an empty map; ask for a brace first
        trimmed = F.trim(candidate)
        return F.when(trimmed.rlike("(?s)^\\s*\\{.*\\}\\s*$"), F.from_json(trimmed, "map<string,string>"))
    fenced = F.regexp_extract(text, "(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```", 1)
    braces = F.regexp_extract(text, "(?s)(\\{.*\\})", 1)
    return F.coalesce(parse(text), parse(fenced), parse(braces))


def clamped_score(parsed: Column, key: Column, top: Column) -> Column:
    """Whole score of a question in 0..max; the midpoint where it is missing or no number."""
    middle = F.floor((top + 1) / 2)
    value = F.element_at(parsed, key).try_cast("double").try_cast("bigint")
    return F.when(value.isNull(), middle).otherwise(F.greatest(F.lit(0), F.least(value, top)))


def judge_key(models: DataFrame, column: str = "judge_model") -> DataFrame:
    """Short key per judge: the family, or ``family_token`` for all as soon as two share a family."""
    m = F.lower(F.col(column))
    short = (F.when(F.contains(m, F.lit("claude")), "claude").when(F.contains(m, F.lit("gemini")), "gemini")
             .when(F.contains(m, F.lit("gpt")) | F.contains(m, F.lit("openai")), "openai")
             .otherwise(F.substring_index(m, "-", 1)))
    d = models.select(column).distinct().withColumn("short", short)
    # one row: how many judges and how many families there are
    state = d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("short").alias("families")).select(
        F.lit(0).alias("__one"), (F.col("n") == F.col("families")).alias("unique"))
    second = F.get(F.split(m, "-"), F.lit(1))
    token = F.when(second.isNotNull(), F.concat_ws("_", F.substring_index(m, "-", 1), second)).otherwise(
        F.substring_index(m, "-", 1))
    return (d.withColumn("__one", F.lit(0)).join(F.broadcast(state), "__one")
            .select(column, "short", F.when(F.col("unique"), F.col("short")).otherwise(token).alias("judge_key")))
