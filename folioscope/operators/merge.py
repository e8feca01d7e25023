"""Keyed merges, canonical spellings, catalogs and data-quality checks."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.functions.text import blank_to_null
from folioscope.operators.extract import SAME_VALUE_RUPEES
from folioscope.operators.lookup import left_lookup
from folioscope.session import cut_lineage


def latest_per_key(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Keyed upsert, last one wins: an aggregate with map-side combine, not a window."""
    row = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.col(seq)).alias("_row")).select("_row.*")


def first_per_key(df: DataFrame, key: Column, seq: str) -> DataFrame:
    row = F.struct(*df.columns)
    return df.groupBy(key.alias("_key")).agg(F.min_by(row, F.col(seq)).alias("_row")).select("_row.*")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """Abort the load when a key repeats."""
    repeated = [r[0] for r in duplicate_keys(df, key).limit(5).collect()]
    if repeated:
        raise ValueError(f"duplicate {key}: {repeated}")
    return df


def catalog(df: DataFrame, name: str, order: str | None = None) -> DataFrame:
    """Distinct non-missing values, one spelling per case-insensitive key (the first one)."""
    value = blank_to_null(name)
    return (
        df.filter(value.isNotNull())
        .groupBy(F.lower(name).alias("_key"))
        .agg(F.min_by(F.col(name), F.struct(F.col(order or name), F.col(name))).alias(name))
        .drop("_key")
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def match_letters(letters: DataFrame, works: DataFrame) -> DataFrame:
    """Every letter with the work of its package, if any; unmatched letters stay."""
    by_package = first_per_key(
        works.filter(F.col("package_no").isNotNull()).select("package_no", "doc_id", "project_name"),
        F.lower("package_no"),
        "doc_id",
    ).select(
        F.lower("package_no").alias("_pkg"),
        F.col("doc_id").alias("matched_project_doc_id"),
        F.col("project_name").alias("matched_project_name"),
    )
    return _looked_up(letters, F.lower("package_no"), by_package, "_pkg")


def _looked_up(df: DataFrame, key: Column, side: DataFrame, side_key: str) -> DataFrame:
    """Left join on a text key; rows without one spread by their contents."""
    keyed = df.withColumns({"_row": F.xxhash64(*df.columns), side_key: key})
    return left_lookup(keyed, side, [side_key], spread="_row").drop("_row", side_key)


def flag_references(works: DataFrame, matched_letters: DataFrame, seq: str = "doc_id") -> DataFrame:
    """Works with has_reference_letter and the last matching letter's id."""
    last = (
        matched_letters.filter(F.col("matched_project_doc_id").isNotNull())
        .groupBy(F.col("matched_project_doc_id").alias("_work"))
        .agg(F.max_by("doc_id", seq).alias("ref_letter_doc_id"))
    )
    base = works.drop("has_reference_letter", "ref_letter_doc_id")
    return (
        base.join(last, base["doc_id"] == last["_work"], "left")
        .withColumn("has_reference_letter", F.col("_work").isNotNull())
        .drop("_work")
    )


def without_reference(works: DataFrame, letters: DataFrame, key: str) -> DataFrame:
    """Absence: start from the portfolio and remove what a letter covers."""
    return works.join(letters.select(key), key, "left_anti")


def engineer_keys(engineers: DataFrame) -> DataFrame:
    """One id per case-insensitive name; the smallest id decides between namesakes."""
    return (
        engineers.filter(blank_to_null("name").isNotNull())
        .groupBy(F.lower("name").alias("name_key"))
        .agg(F.min("emp_id").alias("emp_id"))
    )


def backfill_lead_ids(works: DataFrame, engineers: DataFrame) -> DataFrame:
    """Fill lead_engineer_id by name. One row per name on the right, so works never fan out."""
    ids = engineer_keys(engineers).withColumnRenamed("emp_id", "lead_engineer_id")
    return _looked_up(works.drop("lead_engineer_id"), F.lower("lead_engineer"), ids, "name_key")


def canonical_spellings(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """lower(name) -> canonical spelling over several tables: (key, canonical).

    Earlier tables win, and inside a table the alphabetically first spelling, except that a
    spelling in capitals only gives way to any other.
    """
    spellings = None
    for rank, (df, name) in enumerate(tables):
        part = (
            df.select(F.col(name).alias("spelling"))
            .filter(blank_to_null("spelling").isNotNull())
            .distinct()
            .withColumn("source_rank", F.lit(rank))
        )
        spellings = part if spellings is None else spellings.unionByName(part)
    s = F.col("spelling")
    all_caps = (s == F.upper(s)) & (s != F.lower(s))
    return spellings.groupBy(F.lower(s).alias("key")).agg(
        F.min_by(s, F.struct(all_caps.alias("caps"), "source_rank", "spelling")).alias("canonical")
    )


def apply_canonical(df: DataFrame, name: str, spellings: DataFrame) -> DataFrame:
    columns = df.columns
    joined = _looked_up(df, F.lower(name), spellings.withColumnRenamed("key", "_key"), "_key")
    return joined.withColumn(name, F.coalesce("canonical", name)).select(*columns)


# --- several records of one work -----------------------------------------------------------------

CHUNK_ROWS = 4096
FAN_IN = 64
CELL_BUCKETS = 65_536


def merge_records(records: DataFrame, key: str = "package_no", seq: str = "seq", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One record per key: the most complete one, its value and blank client taken from the rest.

    In order of completeness (then ``seq``), each further record replaces the current value when
    it is positive, different and less than SAME_VALUE_RUPEES away. ``seq`` must be a unique
    integer. Keys of up to ``chunk_rows`` records are folded as they are. Of longer keys, only values that
    lie in one run with the first record's, each less than that far from the next, can ever become current; the
    other records are left out. The fold is sequential, but the effect of a run of records on any value is a
    set of intervals, and such effects compose: records are folded in chunks of at most ``chunk_rows``, then the chunks'
    effects in groups of FAN_IN, until one effect per key is left. That one grows with the distinct values of the run.
    Records without a key are one group, which keeps its first record's value.
    """
    order = F.struct((-F.col("completeness")).alias("o"), F.col(seq).alias("s"))
    row = F.struct(*records.columns)
    client = blank_to_null("client_name")
    primary = records.groupBy(F.col(key).alias("_key")).agg(
        F.min_by(row, order).alias("_row"),
        F.min_by(client, F.when(client.isNotNull(), order)).alias("_client"),
        F.count("*").alias("_n"),
    )
    rest = records.filter(F.col("value_inr") > 0).select(
        F.col(key).alias("_key"),
        (-F.col("completeness")).cast("bigint").alias("_o"),
        F.col(seq).cast("bigint").alias("_s"),
        F.col("value_inr").cast("bigint").alias("_v"),
    )
    primary = cut_lineage(primary)
    starts = primary.filter("_row.value_inr is not null").select("_key", F.col("_row.value_inr").cast("bigint").alias("_start"), "_n")
    values = _fold_short(rest, starts.filter(F.col("_n").between(2, chunk_rows)))
    long = starts.filter(F.col("_n") > chunk_rows)
    if not long.isEmpty():
        values = values.union(_fold_long(rest, long, chunk_rows))
    fields = [c for c in records.columns if c not in ("value_inr", "client_name")]
    return primary.join(values, "_key", "left").select(
        *[F.col(f"_row.{c}").alias(c) for c in fields],
        F.coalesce(blank_to_null("_row.client_name"), "_client").alias("client_name"),
        F.coalesce("_value", "_row.value_inr").alias("value_inr"),
    )


def _fold_short(rest: DataFrame, starts: DataFrame) -> DataFrame:
    """(_key, _value) of keys with few records, folded in their order."""
    def step(current: Column, r: Column) -> Column:
        return F.when(F.abs(r["_v"] - current) < SAME_VALUE_RUPEES, r["_v"]).otherwise(current)

    listed = rest.join(starts.select("_key", "_start"), "_key").groupBy("_key").agg(
        F.first("_start").alias("_start"), F.array_sort(F.collect_list(F.struct("_o", "_s", "_v"))).alias("_rows")
    )
    return listed.select("_key", F.aggregate("_rows", F.col("_start"), step).alias("_value"))


def _fold_long(rest: DataFrame, starts: DataFrame, chunk_rows: int) -> DataFrame:
    """(_key, _value) of keys with many records, folded through the effects of chunks."""
    near = cut_lineage(_within_reach(rest, starts.select("_key", F.col("_start").alias("_v"))))
    met = _compose_all(near, chunk_rows).join(starts.select("_key", "_start"), "_key")
    hit = F.filter("_steps", lambda p: (p["lo"] <= F.col("_start")) & (F.col("_start") <= p["hi"]))
    return met.select("_key", F.coalesce(F.try_element_at(hit, F.lit(1))["to"], "_start").alias("_value"))


def _within_reach(rest: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows of ``rest`` that one run of values joins with their key's start: (_key, _v).

    Values are put in buckets of SAME_VALUE_RUPEES, so neighbours of a run are in the same or in
    adjacent buckets. Runs of buckets are found inside cells of CELL_BUCKETS, and only those that
    touch a cell's edge are joined across cells.
    """
    bucket = F.floor(F.col("_v") / SAME_VALUE_RUPEES).cast("bigint")
    cell = F.floor(F.col("_b") / CELL_BUCKETS).cast("bigint")
    buckets = rest.select("_key", "_v").union(starts).select("_key", bucket.alias("_b")).distinct()

    def joined(runs: DataFrame, *by: str) -> DataFrame:
        """Adjacent (_lo, _hi) runs of a key become one."""
        order = Window.partitionBy("_key", *by).orderBy("_lo")
        begins = F.coalesce((F.col("_lo") > F.lag("_hi").over(order) + 1).cast("int"), F.lit(1))
        numbered = runs.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(order))
        return numbered.groupBy("_key", *by, "_run").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).select("_key", "_lo", "_hi")

    runs = cut_lineage(joined(buckets.select("_key", cell.alias("_cell"), F.col("_b").alias("_lo"), F.col("_b").alias("_hi")), "_cell"))
    at_edge = (F.pmod("_lo", F.lit(CELL_BUCKETS)) == 0) | (F.pmod(F.col("_hi") + 1, F.lit(CELL_BUCKETS)) == 0)
    runs = runs.filter(~at_edge).union(joined(runs.filter(at_edge)))
    reach = runs.join(starts.select("_key", bucket.alias("_b")), "_key").filter(F.col("_b").between(F.col("_lo"), F.col("_hi")))
    # One run a key; a hot key's rows can be split over several tasks.
    reach = cut_lineage(reach.select("_key", "_lo", "_hi"))
    return rest.join(reach, "_key").filter(bucket.between(F.col("_lo"), F.col("_hi"))).select(*rest.columns)


class Effect:
    """What a run of records does to any value: disjoint intervals (lo, hi, to) in order; others stay as they are."""

    def __init__(self, lo: Iterable[int] = (), hi: Iterable[int] = (), to: Iterable[int] = ()) -> None:
        self.lo, self.hi, self.to = list(lo), list(hi), list(to)

    def of(self, value: int) -> int:
        at = bisect_right(self.lo, value) - 1
        return self.to[at] if at >= 0 and value <= self.hi[at] else value

    def assign(self, lo: int, hi: int, to: int) -> None:
        """Map [lo, hi] to ``to``, whatever was there before."""
        first, last = bisect_left(self.hi, lo), bisect_right(self.lo, hi)  # the intervals that overlap
        put = [(lo, hi, to)]
        if first < last:
            if self.lo[first] < lo:
                put.insert(0, (self.lo[first], lo - 1, self.to[first]))
            if self.hi[last - 1] > hi:
                put.append((hi + 1, self.hi[last - 1], self.to[last - 1]))
        for held, new in zip((self.lo, self.hi, self.to), zip(*put), strict=True):
            held[first:last] = new

    def after(self, first: Effect) -> Effect:
        """The effect of ``first`` and then this one."""
        out = Effect(self.lo, self.hi, self.to)
        for lo, hi, to in zip(first.lo, first.hi, [self.of(t) for t in first.to], strict=True):
            out.assign(lo, hi, to)
        return out.joined()

    def joined(self) -> Effect:
        """Touching intervals with one target become one."""
        out = Effect()
        for lo, hi, to in zip(self.lo, self.hi, self.to, strict=True):
            if out.to and out.to[-1] == to and out.hi[-1] + 1 == lo:
                out.hi[-1] = hi
            else:
                out.lo.append(lo), out.hi.append(hi), out.to.append(to)
        return out


def _effect_of(values: Iterable[int], reach: int) -> Effect:
    """The effect of values in their order, built from the last one back: what a value leads to is known by then."""
    out = Effect()
    for v in reversed(list(values)):
        out.assign(v - reach, v + reach, out.of(v))
    return out.joined()


STEPS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("to", pa.int64())]))


def _compose_all(rest: DataFrame, chunk_rows: int) -> DataFrame:
    """(_key, _o, _s, _v) -> (_key, _steps): the composed effect of a key's records in order."""
    reach = SAME_VALUE_RUPEES - 1
    names = ["_key", "_o", "_c"]
    schema = f"_key {dict(rest.dtypes)['_key']}, _o bigint, _c bigint, _steps array<struct<lo:bigint,hi:bigint,to:bigint>>"

    def one(table: pa.Table, effect: Effect) -> pa.Table:
        steps = [{"lo": lo, "hi": hi, "to": to} for lo, hi, to in zip(effect.lo, effect.hi, effect.to, strict=True)]
        head = table.select(names).slice(0, 1)
        return head.append_column("_steps", pa.array([steps], STEPS))

    def records(table: pa.Table) -> pa.Table:
        return one(table, _effect_of(table.sort_by("_s").column("_v").to_pylist(), reach))

    def effects(table: pa.Table) -> pa.Table:
        whole = Effect()
        for steps in table.sort_by("_at").column("_steps").to_pylist():
            whole = Effect(*zip(*[(p["lo"], p["hi"], p["to"]) for p in steps])).after(whole)
        return one(table, whole)

    def up(level: DataFrame, at: str, chunk: Column, o: Column) -> DataFrame:
        return level.select("_key", o.cast("bigint").alias("_o"), chunk.cast("bigint").alias("_c"), F.col(at).alias("_at"), "_steps")

    # Chunks are cut on the unique sequence number, which bounds them whatever the key is.
    chunks = rest.withColumn("_c", F.floor(F.col("_s") / chunk_rows).cast("bigint"))
    level = cut_lineage(chunks.groupBy(*names).applyInArrow(records, schema))
    span = level.agg(F.max("_c") - F.min("_c")).first()[0] or 0
    while span > 0:
        level = cut_lineage(up(level, "_c", F.floor(F.col("_c") / FAN_IN), F.col("_o")).groupBy(*names).applyInArrow(effects, schema))
        span = level.agg(F.max("_c") - F.min("_c")).first()[0] or 0
    whole = up(level, "_o", F.lit(0), F.lit(0)).groupBy(*names).applyInArrow(effects, schema)
    return whole.select("_key", "_steps")
