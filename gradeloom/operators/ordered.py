"""Running values, positions and exact ranks over an order too large for one task.

A window without (or with a hot) partition key sorts the whole group in one task.  Here the
rows are range-partitioned on group and order, so that a group of any size is cut into
slices; the slice totals give every slice its starting value, and the window then runs
inside slices only.  Where the order is one of named columns, ascending, the slices are cut at
keys drawn from the rows, so that a row's slice depends on its key alone: totals and rows may be made in
passes of their own, and rows are shuffled once.  Any other order goes through range-partitioned rows, which are
checkpointed, because slice numbers must not change between the two uses.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.session import checkpointed, pinned

_SLICE = "_slice"
#: Keys drawn for each slice, and pieces of a slice: more pieces than tasks even out what hashing deals a task.
DRAWN, PIECES = 5, 4


def sliced(df: DataFrame, by: list[str], order: list[Column], slices: int | None = None) -> DataFrame:
    """Rows with a slice number that rises with (by, order)."""
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(n, *[F.col(c) for c in by], *order).withColumn(_SLICE, F.spark_partition_id()))


#: Types of values that ``_sql`` writes.
_PLAIN = {str, bytes, bytearray, bool, int, float, Decimal, type(None)}


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _sql(value: object) -> str:
    """A value as SQL, to be cast to its type."""
    if value is None or isinstance(value, bool):
        return "NULL" if value is None else str(value).lower()
    if isinstance(value, str):
        return f"X'{value.encode().hex()}'"
    return f"X'{value.hex()}'" if isinstance(value, (bytes, bytearray)) else f"'{value}'"


def _marks(df: DataFrame, keys: list[str], n: int) -> Column | None:
    """Sorted keys that cut the rows into at most ``n`` slices, from the keys of least hash; NULL for no cut."""
    drawn = df.select(*keys).orderBy(F.xxhash64(*keys)).limit(DRAWN * n)
    found = drawn.agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("k")).first()["k"]
    cuts = found[DRAWN // 2::max(len(found) // n, 1)][1:n] if len(found) > n else found[1:]
    if not cuts:
        return None
    kinds = {c: df.schema[c].dataType for c in keys}
    if {type(x) for row in cuts for x in row} <= _PLAIN:  # as one text: a call to the JVM for each value takes seconds
        named = lambda row: ", ".join(f"'{_quoted(c)}', CAST({_sql(row[c])} AS {kinds[c].simpleString()})" for c in keys)
        return F.sort_array(F.expr("array(" + ", ".join(f"named_struct({named(row)})" for row in cuts) + ")"))
    return F.sort_array(F.array(*[F.struct(*[F.lit(row[c]).cast(kinds[c]).alias(c) for c in keys]) for row in cuts]))


def _cut(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows with a slice number that rises with ``keys`` and depends on nothing else: how many marks are at or below the key."""
    marks = _marks(df, keys, n)
    if marks is None:
        return df.withColumn(_SLICE, F.lit(0))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])  # binary search
    key = pinned(df, df.columns, _key=F.struct(*keys))
    at = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.try_element_at(marks, at + step) <= F.col("_key"), at + step).otherwise(at))
    return key.withColumn(_SLICE, at).drop("_key")


def _scan(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column], fold, slices: int | None) -> DataFrame:
    """Add ``fold`` (sum or min) of each value up to each row.  ``df`` is read three times: for the marks, the totals of the slices, the rows.

    What comes before a slice is a row of its own ahead of the slice's rows, so that nothing is joined.
    """
    n = PIECES * (slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    temps = {f"_v_{name}": value for name, value in values.items()}
    rows = _cut(df.withColumns(temps), [*by, *order], n).withColumn("_at", F.lit(1))
    before = Window.partitionBy(*by).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, _SLICE).agg(*[fold(t).alias(t) for t in temps])
    starts = totals.select(*by, _SLICE, *[fold(t).over(before).alias(t) for t in temps], F.lit(0).alias("_at"))
    inside = Window.partitionBy(*by, _SLICE).orderBy("_at", *order).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(starts, allowMissingColumns=True)
    return both.withColumns({name: fold(f"_v_{name}").over(inside) for name in values}).where("_at = 1").drop(_SLICE, "_at", *temps)


def _named(order: list) -> bool:
    return all(isinstance(c, str) for c in order)


def running_total(df: DataFrame, by: list[str], order: list[Column] | list[str], values: dict[str, Column],
                  slices: int | None = None) -> DataFrame:
    """Add running sums (``{name: value}``) within ``by`` along ``order``.

    ``order`` should end in a unique column: rows that tie on all of it share a slice.  Names order upwards,
    NULL first; they take one shuffle, but ``df`` must give the same rows each time it is read.
    """
    if _named(order):
        return _scan(df, by, order, values, F.sum, slices)
    temps = {f"_v_{name}": value for name, value in values.items()}
    rows = sliced(df.withColumns(temps), by, order, slices)
    totals = rows.groupBy(*by, _SLICE).agg(*[F.sum(t).alias(f"_t{t}") for t in temps])
    before = Window.partitionBy(*by).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, _SLICE, *[F.coalesce(F.sum(f"_t{t}").over(before), F.lit(0)).alias(f"_o{t}") for t in temps])
    inside = Window.partitionBy(*by, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _join_slices(rows, offsets, by)
    out = joined.withColumns({name: F.col(f"_o_v_{name}") + F.sum(f"_v_{name}").over(inside) for name in values})
    return out.drop(_SLICE, *temps, *[f"_o{t}" for t in temps])


def _join_slices(rows: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    right = offsets.withColumnsRenamed({**{c: f"_k_{c}" for c in by}, _SLICE: "_k_slice"})
    on = rows[_SLICE] == right["_k_slice"]
    for c in by:
        on = on & rows[c].eqNullSafe(right[f"_k_{c}"])
    return rows.join(right, on).drop("_k_slice", *[f"_k_{c}" for c in by])


def running_least(df: DataFrame, by: list[str], order: list[Column] | list[str], value: Column, name: str, slices: int | None = None) -> DataFrame:
    """Add the least ``value`` (of any type that has an order, such as a struct) up to each row within ``by`` along ``order``.

    The prefix scan of ``running_total`` with a minimum: each slice's least value goes to all later
    slices of its group, so a group of any size is worked on in as many tasks as it has slices.
    NULL values are passed over.  ``order`` is that of ``running_total``.
    """
    if _named(order):
        return _scan(df, by, order, {name: value}, F.min, slices)
    rows = sliced(df.withColumn("_v", value), by, order, slices)
    totals = rows.groupBy(*by, _SLICE).agg(F.min("_v").alias("_t"))
    before = Window.partitionBy(*by).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, _SLICE, F.min("_t").over(before).alias("_o"))
    inside = Window.partitionBy(*by, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _join_slices(rows, offsets, by).withColumn(name, F.least("_o", F.min("_v").over(inside))).drop(_SLICE, "_v", "_o")


def position(df: DataFrame, by: list[str], order: list[Column] | list[str], name: str = "pos", slices: int | None = None) -> DataFrame:
    """Add the 0-based position within ``by`` along ``order``."""
    return running_total(df, by, order, {name: F.lit(1).cast("long")}, slices).withColumn(name, F.col(name) - 1)


def nearest_rank(df: DataFrame, column: str, points: dict[str, Column], by: list[str],
                 slices: int | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """Exact ranked values: for each ``{name: rank}`` the value at that 0-based rank of its group.

    A rank is an expression over the group size ``n``.  The rows are read once: they are first
    counted per distinct value, with the additive aggregates in ``also`` (``{name: sum or
    count}``), and everything else comes from those counts.  NULL values have no rank but
    count in ``also``.
    """
    if not by:
        return nearest_rank(df.withColumn("_all", F.lit(0)), column, points, ["_all"], slices, also).drop("_all")
    extra = also or {}
    counted = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(name) for name, c in extra.items()])
    present = counted.where(F.col(column).isNotNull()) if not extra else counted
    size = F.when(F.col(column).isNotNull(), F.col("_n")).otherwise(F.lit(0))
    upto = running_total(present.withColumn("_n", size), by, [F.col(column)], {"_upto": F.col("_n")}, slices)  # counts are a shuffle, not to be read three times
    totals = upto.groupBy(*by).agg(F.sum("_n").alias("n"), *[F.sum(name).alias(name) for name in extra])
    rows = upto.drop(*extra).join(totals, by)
    holds = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
    return rows.groupBy(*by).agg(
        F.max("n").alias("n"), *[F.max(name).alias(name) for name in extra],
        *[F.max(F.when(holds(rank), F.col(column))).alias(name) for name, rank in points.items()])


def median_ranks() -> dict[str, Column]:
    """Ranks of the two middle values; their mean is the median."""
    n = F.col("n")
    return {"_low": F.floor((n - 1) / 2), "_high": F.floor(n / 2)}


def range_ranks() -> dict[str, Column]:
    """Ranks of the ends and of the two middle values."""
    return {"min": F.lit(0), "max": F.col("n") - 1, **median_ranks()}


def exact_median(df: DataFrame, column: str, by: list[str], name: str = "median", slices: int | None = None) -> DataFrame:
    ranked = nearest_rank(df, column, median_ranks(), by, slices)
    return ranked.withColumn(name, (F.col("_low") + F.col("_high")) / 2).drop("_low", "_high")
