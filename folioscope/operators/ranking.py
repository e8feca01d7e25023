"""Ordered statistics that stay parallel when one key holds a large share of the rows.

A plain window would sort a whole key in one task. These operators cut the order (key, value, tie) into ranges
that Spark's range exchange samples from the rows themselves, so a hot key, a dense stretch of values and many equal
values are spread over as many tasks as they fill, whatever the values' unit. Ranges are ordered, so what lies before a
range is a running sum over one row per key and range. A recomputed range exchange may cut elsewhere, so
the ranges are written before they are read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.session import cut_lineage

SALTS = 16


def _join_null_safe(rows: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on equal columns in which NULL equals NULL; the rows' own columns stay."""
    side = side.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = [rows[c].eqNullSafe(side[f"_on_{c}"]) for c in on]
    return rows.join(side, same).drop(*[f"_on_{c}" for c in on])


def _ranges(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows sorted within ordered ranges of (keys, order), with their place ``_at``: range << 33 | row."""
    by = [*map(F.col, keys), *order]
    return cut_lineage(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))


def _range_of(at: str = "_at") -> Column:
    return F.shiftright(at, 33).cast("int")


def _offsets(per_range: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Sum of ``measure`` over a key's ranges before each range: one row per key and range."""
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return per_range.withColumn("_offset", F.coalesce(F.sum(measure).over(before), F.lit(0).cast("bigint"))).drop(measure)


def rank_descending(df: DataFrame, keys: list[str], value: str, tie: str, rank: str = "rank") -> DataFrame:
    """Row number within ``keys`` by ``value`` descending, then ``tie`` ascending.

    Rows without a value rank last; rows without a key are a group of their own. A key's rows are consecutive in every
    range, so a row's number is its distance from the key's first row there, plus the key's rows in earlier ranges.
    """
    rows = _ranges(df, keys, [F.desc_nulls_last(value), F.asc(tie)]).withColumn("_range", _range_of())
    per_range = rows.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    offsets = _offsets(per_range, keys, "_n")
    return (
        _join_null_safe(rows, offsets, [*keys, "_range"])
        .withColumn(rank, F.col("_at") - F.col("_first") + F.col("_offset") + 1)
        .drop("_at", "_range", "_first", "_offset")
    )


def _running_sum(points: DataFrame, keys: list[str], order: list[Column], measure: str, out: str) -> DataFrame:
    """``points`` with the sum of ``measure`` over their key's points up to each one in the order."""
    ranged = _ranges(points, keys, order).withColumn("_range", _range_of())
    offsets = _offsets(ranged.groupBy(*keys, "_range").agg(F.sum(measure).alias("_n")), keys, "_n")
    inside = Window.partitionBy(*keys, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        _join_null_safe(ranged.withColumn("_run", F.sum(measure).over(inside)), offsets, [*keys, "_range"])
        .withColumn(out, F.col("_run") + F.col("_offset"))
        .drop("_at", "_range", "_run", "_offset")
    )


def sum_at_or_above(facts: DataFrame, bars: DataFrame, key: str, value: str, bar: str) -> DataFrame:
    """For every distinct (key, bar): the sum of ``value`` over the key's rows with value >= bar.

    Facts are pre-aggregated per (key, value); bars join them as extra points on the same axis,
    so the cost follows rows + bars instead of their product within a key. Rows and bars without a key
    or a value have no place on the axis.
    """
    points = (
        facts.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
        .select(F.col(key).alias("_key"), F.col(value).alias("_axis"))
        .groupBy("_key", "_axis")
        .agg(F.sum("_axis").alias("_sum"))
        .withColumn("_is_bar", F.lit(0))
    )
    wanted = (
        bars.filter(F.col(key).isNotNull() & F.col(bar).isNotNull())
        .select(F.col(key).alias("_key"), F.col(bar).alias("_axis"))
        .distinct()
        .select("_key", "_axis", F.lit(0).cast("bigint").alias("_sum"), F.lit(1).alias("_is_bar"))
    )
    summed = _running_sum(points.unionByName(wanted), ["_key"], [F.desc("_axis"), F.asc("_is_bar")], "_sum", "_total")
    return summed.filter("_is_bar = 1").select(
        F.col("_key").alias(key), F.col("_axis").alias(bar), F.col("_total").alias("total_at_or_above")
    )


def sum_after(facts: DataFrame, starts: DataFrame, key: str, on: str, value: str, start: str) -> DataFrame:
    """For every distinct (key, start date): the sum of ``value`` over rows dated strictly later, 0 without any.

    Facts are pre-aggregated per (key, day), so a key never has more points than the calendar
    has days, plus the distinct start days asked for.
    """
    days = (
        facts.filter(F.col(on).isNotNull())
        .groupBy(F.col(key).alias("_key"), F.col(on).alias("_at"))
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_is_start", F.lit(0))
    )
    wanted = (
        starts.filter(F.col(start).isNotNull())
        .select(F.col(key).alias("_key"), F.col(start).alias("_at"))
        .distinct()
        .select("_key", "_at", F.lit(None).cast("bigint").alias("_sum"), F.lit(1).alias("_is_start"))
    )
    later = (
        Window.partitionBy("_key")
        .orderBy(F.desc("_at"), F.desc("_is_start"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        days.unionByName(wanted)
        .withColumn("_run", F.sum("_sum").over(later))
        .filter(F.col("_is_start") == 1)
        .select(F.col("_key").alias(key), F.col("_at").alias(start), F.coalesce("_run", F.lit(0)).alias("total_after"))
    )


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """Exact interpolated median per key of a BIGINT column, plus the row count ``n``.

    A mergeable quantile sketch gives each key a narrow bracket that must contain the middle
    ranks; the second pass counts what lies below it and orders only the values inside it. Rows
    meet their bracket under a salt taken from the value, so a hot key is spread over SALTS tasks;
    the values inside are ordered in ranges.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    brackets = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.percentile_approx("_v", [0.495, 0.505], 2000).alias("_b"),
    )
    salted = brackets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    inside = (F.col("_v") >= F.col("_b")[0]) & (F.col("_v") <= F.col("_b")[1])
    # One aggregation serves both counts: everything below the bracket collapses into NULL.
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))
    counted = (
        _join_null_safe(spread, salted, [*keys, "_salt"])
        .filter(F.col("_v") <= F.col("_b")[1])
        .groupBy(*keys, F.when(inside, F.col("_v")).alias("_v"))
        .agg(F.count("*").alias("_c"), F.first("n").alias("n"))
    )
    placed = _running_sum(counted, keys, [F.asc_nulls_first("_v")], "_c", "_hi").withColumn("_lo", F.col("_hi") - F.col("_c"))
    # Zero-based middle ranks; they coincide for odd n.
    lower, upper = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col("_v")))

    return placed.groupBy(*keys).agg(
        F.first("n").alias("n"),
        ((at(lower).cast("double") + at(upper).cast("double")) / 2).alias(out),
    )


def top_two_gap(df: DataFrame, keys: list[str], value: str, tie: str, out: str = "gap") -> DataFrame:
    """Largest minus second largest by row: ties give 0, a single row gives its own value.

    Filtering a row number lets Spark keep only two rows per key and task before the shuffle.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(value), F.asc(tie))
    top = df.select(*keys, value, tie).withColumn("_rn", F.row_number().over(order)).filter("_rn <= 2")
    first = F.max(F.when(F.col("_rn") == 1, F.col(value)))
    second = F.max(F.when(F.col("_rn") == 2, F.col(value)))
    return top.groupBy(*keys).agg((first - F.coalesce(second, F.lit(0))).alias(out))
