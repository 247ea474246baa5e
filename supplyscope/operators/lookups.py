"""Lookups: code tables, scalar-subquery lookups with a defined first row, uniqueness
guards, effective-dated people, and a left join that stays splittable under skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.functions.oracle import ends_after, valid_on


def lookup_values(fnd: DataFrame, lookup_type: str, language: str = "PTB") -> DataFrame:
    """``fnd_lookup_values`` rows of one type and language: ``(lookup_code, meaning)``.

    Kept as rows (no dedupe): the reports join this as a plain outer join, so
    duplicate codes multiply rows exactly as they would in the source SQL.
    """
    return (fnd.where((F.col("lookup_type") == lookup_type) & (F.col("language") == language))
               .select("lookup_code", "meaning"))


def first_row(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key with a defined choice among duplicates (the scalar-subquery
    ``ROWNUM = 1`` of the source, made deterministic): the smallest ``values`` tuple.

    ``min(struct(...))`` is an ordinary aggregate with a map-side partial step,
    so a key holding a large share of the rows is reduced before the shuffle.
    """
    keys, values = list(keys), list(values)
    if len(values) == 1:
        return df.groupBy(*keys).agg(F.min(values[0]).alias(values[0]))
    agg = df.groupBy(*keys).agg(F.min(F.struct(*values)).alias("_first"))
    return agg.select(*keys, *[F.col("_first")[v].alias(v) for v in values])


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts.

    The source reports raise ORA-01427 when a scalar lookup finds two rows; an
    empty result here is the same guarantee, checked as a distributed aggregate.
    """
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
              .where(F.col("n_rows") > 1))


def assert_empty(report: DataFrame, what: str) -> None:
    """Raise if a guard report has rows (runs one job; at most five rows reach the driver)."""
    bad = report.limit(5).collect()
    if bad:
        raise ValueError(f"{what}, e.g. {[r.asDict() for r in bad]}")


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "lookup") -> None:
    """Strict mode of ``require_unique``: raise if any key repeats."""
    assert_empty(require_unique(df, keys), f"{what}: keys {list(keys)} are not unique")


def effective_rows(people: DataFrame, as_of, mode: str = "closed",
                   start: str = "effective_start_date", end: str = "effective_end_date") -> DataFrame:
    """Rows of an effective-dated table that count on ``as_of``.

    ``closed``: ``TRUNC(as_of) BETWEEN TRUNC(start) AND TRUNC(end)``.
    ``end_only``: ``end > as_of`` — rows that start later still count.
    """
    if mode == "closed":
        return people.where(valid_on(start, end, as_of))
    if mode == "end_only":
        return people.where(ends_after(end, as_of))
    raise ValueError(f"unknown effective-date mode {mode!r}")


def person_names(people: DataFrame, as_of, mode: str = "closed") -> DataFrame:
    """``(person_id, last_name)``: one name per person among rows valid on ``as_of``."""
    return first_row(effective_rows(people, as_of, mode), ["person_id"], ["last_name"])


NULL_PARTS = 1024  # a fixed number: rows without a key are dealt to so many hash values


def spread_nulls(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
                 spread: Sequence[str] | None = None) -> DataFrame:
    """``left JOIN right USING (on)`` (left outer or anti) whose rows with a NULL key do not meet in one task.

    A NULL key matches nothing, but all rows that have one hash alike and are sent to
    the same partition.  Here the join has one more key: 0 where the keys are set (both
    sides) and a number hashed from ``spread`` (columns of ``left``, all by default) where one is NULL.  Such
    rows are dealt over all partitions, still match nothing, and the result is the same.
    No side is evaluated twice, as it would be if NULL rows were set aside and unioned back.
    """
    on = list(on)
    unset = F.lit(False)
    for k in on:
        unset = unset | F.col(k).isNull()
    dealt = F.pmod(F.xxhash64(*(spread or left.columns)), F.lit(NULL_PARTS)) + 1
    salted = left.withColumn("_spread", F.when(unset, dealt).otherwise(F.lit(0).cast("long")))
    # not the literal 0, which the optimiser would turn into a filter and drop from the keys
    zero = F.pmod(F.xxhash64(*on), F.lit(1))
    return salted.join(right.withColumn("_spread", zero), [*on, "_spread"], how).drop("_spread")


def with_missing(right: DataFrame, missing: DataFrame, on: Sequence[str]) -> DataFrame:
    """``right`` and one row of NULLs for each key of ``missing`` (keys that ``right`` lacks)."""
    extra = [f for f in right.schema.fields if f.name not in on]
    return right.unionByName(missing.select(*on, *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra]))


def left_join_split(left: DataFrame, right: DataFrame, on: Sequence[str],
                    right_keys: DataFrame | None = None, left_keys: DataFrame | None = None) -> DataFrame:
    """``left LEFT JOIN right USING (on)`` written so both sides stay splittable.

    For a left outer join adaptive execution may only split the left side of a
    skewed partition.  When the *right* side fans out (many rows per key: all
    invoice lines of one invoice), the same result is the inner join (splittable
    on both sides) with the right side completed by a row of NULLs for each key of
    ``left`` that it lacks.  Those keys come from an anti join of the keys alone, so
    neither side's rows are moved twice.  Left rows with a NULL key match nothing and
    are added without a join; the filter that sets them apart reaches the scans.

    ``right_keys``, ``left_keys``: cheap relations with the key values present in
    ``right`` (exactly) and in ``left`` (at least), for example the scans they were
    built from.  The anti join then reads only those key columns, reduced by a
    map-side distinct, instead of evaluating ``right`` or ``left`` a second time.
    """
    on = list(on)
    known = F.lit(True)
    for k in on:
        known = known & F.col(k).isNotNull()
    own, held = ((keys if keys is not None else side).select(*on).where(known).distinct() for keys, side in ((left_keys, left), (right_keys, right)))
    matched = left.join(with_missing(right, own.join(held, on, "left_anti"), on), on, "inner")
    extra = [f for f in right.schema.fields if f.name not in on]
    unkeyed = left.where(~known).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra])
    return matched.unionByName(unkeyed)


HOT_ROWS = 1_000_000  # rows of one key above which a join must be able to split them


def hot_keys(rows: DataFrame, on: str) -> list:
    """Values of ``on`` that hold over ``HOT_ROWS`` rows (a count with a map-side partial step; at most one value in so many rows reaches the driver)."""
    counted = rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS)
    return [r[on] for r in counted.select(on).collect()]


def left_join_hot(left: DataFrame, right: DataFrame, on: str, hot: Sequence) -> DataFrame:
    """``left LEFT JOIN right USING (on)`` in which the keys ``hot``, all of them present in ``right``, are joined apart.

    For them the left join is an inner join, which adaptive execution may split on both sides; of the others it may
    split the left side, and their right side is small by the count (see ``hot_keys``).  Unlike
    ``left_join_split`` no key has to be completed, so nothing is moved but the two sides.  Left rows without
    a key are added without a join."""
    key = F.col(on)
    extra = [f for f in right.schema.fields if f.name != on]
    unkeyed = left.where(key.isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra])
    keyed = left.where(key.isNotNull())
    if not hot:
        return keyed.join(right, on, "left").unionByName(unkeyed)
    own, others = key.isin(*hot), ~key.isin(*hot)
    return (keyed.where(others).join(right.where(others), on, "left").unionByName(keyed.where(own).join(right.where(own), on, "inner"))
            .unionByName(unkeyed))
