"""Ordered passes that stay parallel inside one hot key.

A plain window puts a whole key into one task. Here the caller names one or
more *levels*: columns that rise with the wanted order (a minute for a time
stamp, a cell of a score, a block of an id). Rows are shuffled by key and
level, a window runs inside each cell, and the totals of the earlier cells
come from a summary with one row per cell. The summary is made with map-side
aggregation, so a key that holds a third of all rows is spread over as many
tasks as it has cells. NULL keys are a group of their own; NULL levels and NULL
order values come first. No row is lost or added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.session import materialise


def minute_of(ts: str = "ts") -> Column:
    """Minutes since 1970 for a time stamp without time zone."""
    day = F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return (day * 24 + F.hour(ts)) * 60 + F.minute(ts)


def cell_of(value: str | Column, low: float = 0.0, high: float = 1.0, cells: int = 1024) -> Column:
    """Index of an equal-width cell; values outside go to the first or last cell."""
    c = F.col(value) if isinstance(value, str) else value
    raw = F.floor((c - low) / (high - low) * cells)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(cells - 1)).cast("long")


def block_of(identifier: str | Column, size: int = 65536) -> Column:
    """Block number of an integer id."""
    c = F.col(identifier) if isinstance(identifier, str) else identifier
    return F.floor(c / size).cast("long")


def id_levels(identifier: str, size: int = 65536) -> list[Column]:
    """Coarse and fine blocks of an id: a whole table in order has a summary of a few thousand coarse blocks."""
    return [block_of(identifier, size * 4096), block_of(identifier, size)]


def value_levels(value: str | Column, low: float = 0.0, high: float = 1.0) -> list[Column]:
    """Coarse and fine cells for distinct values of a known range."""
    return [cell_of(value, low, high, 1024), cell_of(value, low, high, 1 << 20)]


def tie_levels(value: str | Column, identifier: str, low: float = 0.0, high: float = 1.0) -> list[Column]:
    """Cells, then the value, then blocks of ids inside one value: equal values in any number stay spread."""
    c = F.col(value) if isinstance(value, str) else value
    return value_levels(c, low, high) + [c, block_of(identifier)]


def _as_columns(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _default(kind: T.DataType) -> Column:
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    return F.lit(0).cast(kind)


def _lowest(kind: T.DataType) -> Column:
    """A value before which none comes. The NULL level shares its cell with it; inside a cell the order puts NULL first."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.lit(float("-inf")).cast(kind)
    if isinstance(kind, T.DecimalType):
        return F.lit("-" + "9" * (kind.precision - kind.scale) + ".").cast(kind)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("0001-01-01").cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}.get(type(kind))
    return F.lit(-2 ** (bits - 1) if bits else "").cast(kind)


def _safe(df: DataFrame, columns: list[str], prefix: str) -> tuple[DataFrame, list[str]]:
    """Two plain stand-ins for each key column, so that joins and windows treat NULL as a value: the value or a default, and
    whether it is NULL."""
    names = [f"{prefix}{i}{part}" for i in range(len(columns)) for part in ("", "n")]
    kinds = [df.schema[c].dataType for c in columns]
    stand_ins = [x for c, kind in zip(columns, kinds) for x in (F.coalesce(F.col(c), _default(kind)), F.col(c).isNull())]
    return df.select("*", *[x.alias(n) for x, n in zip(stand_ins, names)]), names


def _cells(df: DataFrame, keys: list[str], levels: list[Column]) -> tuple[DataFrame, list[str], list[str]]:
    raw, names = ([f"__{kind}{i}" for i in range(len(levels))] for kind in ("raw", "level"))
    cells = df.select("*", *[c.alias(n) for c, n in zip(levels, raw)])
    kinds = [cells.schema[n].dataType for n in raw]
    cells = cells.select("*", *[F.coalesce(F.col(r), _lowest(kind)).alias(n) for r, n, kind in zip(raw, names, kinds)]).drop(*raw)
    cells, groups = _safe(cells, keys, "__key")
    return cells, groups, names


def _window(keys: list[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy()


def _offsets(summary: DataFrame, keys: list[str], levels: list[str], sums: list[str]) -> DataFrame:
    """Exclusive running totals per cell, one level at a time (coarse to fine)."""
    parents = keys + levels[:-1]
    before = _window(parents).orderBy(levels[-1]).rowsBetween(Window.unboundedPreceding, -1)
    inner = summary.select(
        *parents, levels[-1],
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"__before_{s}") for s in sums],
    )
    if len(levels) == 1:
        return inner
    upper = summary.groupBy(*parents).agg(*[F.sum(s).alias(s) for s in sums])
    upper = _offsets(upper, keys, levels[:-1], sums)
    upper = upper.withColumnsRenamed({f"__before_{s}": f"__above_{s}" for s in sums})
    joined = inner.join(upper, parents)
    return joined.select(
        *parents, levels[-1],
        *[(F.col(f"__before_{s}") + F.col(f"__above_{s}")).alias(f"__before_{s}") for s in sums],
    )


def running_totals(df: DataFrame, keys: list[str], levels: list[Column], order: list,
                   measures: dict[str, Column]) -> DataFrame:
    """Inclusive running totals of ``measures`` inside ``keys`` in level, then ``order`` order."""
    cells, groups, names = _cells(df, keys, levels)
    sums = [f"__m_{m}" for m in measures]
    cells = cells.select("*", *[c.alias(s) for c, s in zip(measures.values(), sums)])
    path = groups + names
    # a NULL measure adds nothing, as in a window sum
    summary = cells.groupBy(*path).agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sums])
    offsets = _offsets(summary, groups, names, sums)
    upto = Window.partitionBy(*path).orderBy(*_as_columns(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = cells.select(*df.columns, *path, *[F.sum(s).over(upto).alias(s) for s in sums])
    return local.join(offsets, path).select(
        *[local[c] for c in df.columns],
        *[(F.col(s) + F.col(f"__before_{s}")).alias(m) for m, s in zip(measures, sums)],
    )


def row_numbers(df: DataFrame, keys: list[str], levels: list[Column], order: list,
                name: str = "rn") -> DataFrame:
    """``row_number`` from 1 over ``keys`` in level, then ``order`` order."""
    return running_totals(df, keys, levels, order, {name: F.lit(1).cast("long")})


def _neighbour(df: DataFrame, keys: list[str], level: Column, order: list,
               columns: dict[str, str], forward: bool) -> DataFrame:
    cells, groups, (name,) = _cells(df, keys, [level])
    path = groups + [name]
    sort = _as_columns(order)
    local = Window.partitionBy(*path).orderBy(*sort)
    shift, edge = (F.lead, F.min_by) if forward else (F.lag, F.max_by)
    position = F.struct(*sort)
    across = _window(groups).orderBy(name)
    summary = cells.groupBy(*path).agg(
        edge(F.struct(*[F.col(c).alias(o) for o, c in columns.items()]), position).alias("__edge"))
    carried = summary.select(*path, shift("__edge").over(across).alias("__carry"))
    near = cells.select(
        *df.columns, *path,
        shift(F.struct(*[F.col(c).alias(o) for o, c in columns.items()])).over(local).alias("__near"))
    return near.join(carried, path).select(
        *[near[c] for c in df.columns],
        *[F.coalesce(F.col("__near"), F.col("__carry"))[o].alias(o) for o in columns],
    )


def previous(df: DataFrame, keys: list[str], level: Column, order: list,
             columns: dict[str, str]) -> DataFrame:
    """``lag`` by one row inside ``keys``; ``columns`` maps new name to source column."""
    return _neighbour(df, keys, level, order, columns, forward=False)


def following(df: DataFrame, keys: list[str], level: Column, order: list,
              columns: dict[str, str]) -> DataFrame:
    """``lead`` by one row inside ``keys``."""
    return _neighbour(df, keys, level, order, columns, forward=True)


def range_ranks(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """``df`` with the rank from 1 of each of ``columns`` inside ``keys``: ``rank_0``, ``rank_1``, ... in the order of (value, ``order``),
    and ``mean_0``, ... where equal values share the mean of their ranks. NULL is a value, the first.

    All columns are sorted at once by one range partitioning of (keys, column, value, order), which cuts hot keys and hot ties
    alike. A row's place in its partition and a table with one row per partition and key give its rank.
    """
    kinds = {c: df.schema[c].dataType for c in columns}
    value = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("value")) for i, c in enumerate(kinds)]))
    long = df.withColumn("__row", F.monotonically_increasing_id()).select("__row", *df.columns, value.alias("__v")).select(
        "__row", *df.columns, F.col("__v.column").alias("__column"), F.col("__v.value").alias("__value"))
    long, names = _safe(long, [*keys, "__value"], "__key")
    path = [*names[:2 * len(keys)], "__column"]
    by = [*path, "__value", order]
    placed = materialise(long.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "ranks")
    # the upper bits are the partition's, the lower ones the place in it
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__place", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    cells = placed.groupBy("__part", *path).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*path).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("__part", *path, "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    ranked = placed.join(cells, ["__part", *path]).withColumn("__rank", F.col("__place") - F.col("__first") + F.col("__before") + 1)
    ties = [*path, *names[2 * len(keys):]]
    shared = ranked.groupBy(*ties).agg(F.avg("__rank").alias("__mean"))
    ranked = ranked.join(shared, ties)
    wide = [F.max(F.when(F.col("__column") == i, F.col(source))).alias(f"{name}_{i}")
            for i in range(len(columns)) for name, source in (("rank", "__rank"), ("mean", "__mean"))]
    return ranked.groupBy("__row").agg(*[F.first(c).alias(c) for c in df.columns], *wide).drop("__row")


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values per key with their count (map-side combined)."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
              .agg(F.count(F.lit(1)).alias("n_value")))


def order_statistics(df: DataFrame, keys: list[str], value: str, levels: list[Column],
                     indexes: dict[str, Column]) -> DataFrame:
    """Values at zero-based sorted positions; ``indexes`` are expressions of ``n``.

    Works on the distinct values only, so equal values never meet in one task.
    At least one key is needed; use a constant column for a whole table.
    """
    counts = value_counts(df, keys, value)
    ranked = running_totals(counts, keys, levels, [value], {"upto": F.col("n_value")})
    totals = counts.groupBy(*keys).agg(F.sum("n_value").alias("n"))
    ranked, names = _safe(ranked, keys, "__key")
    totals, _ = _safe(totals, keys, "__key")
    joined = ranked.join(totals.drop(*keys), names)
    picks = [
        F.min(F.when(F.col("upto") > ix, F.col(value))).alias(name)
        for name, ix in indexes.items()
    ]
    return joined.groupBy(*keys).agg(F.first("n").alias("n"), *picks)
