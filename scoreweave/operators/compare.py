"""Table comparison: key sets, linkage, per-field differences, control totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ID
from ..functions.guards import require_unique_key


def _side_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key on each side; each side combines before the one shuffle, so a
    key holding a third of the rows is a single partial row per task."""
    sides = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return sides.groupBy(*keys).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))


def key_mismatch(left: DataFrame, right: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Unmatched rows of a full outer join: ``left_only``, ``right_only``, total."""
    per_key = _side_counts(left, right, keys or [ID])
    left_only = F.coalesce(F.sum(F.when(F.col("n_right") == 0, F.col("n_left"))), F.lit(0))
    right_only = F.coalesce(F.sum(F.when(F.col("n_left") == 0, F.col("n_right"))), F.lit(0))
    return per_key.agg(
        left_only.cast("long").alias("left_only"), right_only.cast("long").alias("right_only")
    ).withColumn("key_mismatch", F.col("left_only") + F.col("right_only"))


def linkage(parents: DataFrame, children: DataFrame, id_col: str = ID) -> DataFrame:
    """Parents with and without a child, orphan child rows, child rows."""
    per_key = _side_counts(parents, children, [id_col])
    p, c = F.col("n_left"), F.col("n_right")

    def total(value: Column, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, value)), F.lit(0)).cast("long")

    return per_key.agg(
        total(p, c > 0).alias("parents_with_child"),
        total(p, c == 0).alias("parents_without_child"),
        total(c, p == 0).alias("orphan_children"),
        total(c, F.lit(True)).alias("children"),
    )


def field_mismatch_rows(
    left: DataFrame, right: DataFrame, fields: list[str], keys: list[str] | None = None
) -> DataFrame:
    """Rows with equal (unique) keys where any paired field differs, NULL-safe."""
    keys = keys or [ID]
    joined = left.select(*keys, *fields).alias("a").join(
        right.select(*keys, *fields).alias("b"), keys, "inner"
    )
    differs = reduce(
        lambda x, y: x | y, (~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in fields)
    )
    return joined.agg(F.count_if(differs).alias("field_mismatch"))


def per_field_compare(
    left: DataFrame, right: DataFrame, fields: list[str], keys: list[str] | None = None
) -> DataFrame:
    """Per field: compared rows, mismatches, keys missing on either side."""
    keys = keys or [ID]
    a = left.select(*keys, *fields, F.lit(True).alias("here")).alias("a")
    b = right.select(*keys, *fields, F.lit(True).alias("here")).alias("b")
    joined = a.join(b, keys, "full_outer")
    in_left, in_right = F.col("a.here").isNotNull(), F.col("b.here").isNotNull()
    both = in_left & in_right
    row = joined.agg(
        F.count_if(both).alias("compared"),
        F.count_if(~in_right).alias("missing_right"),
        F.count_if(~in_left).alias("missing_left"),
        *[
            F.count_if(both & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias(f"m_{f}")
            for f in fields
        ],
    )
    entries = [
        F.struct(
            F.lit(f).alias("field"),
            F.col("compared"),
            F.col(f"m_{f}").alias("mismatches"),
            F.col("missing_left"),
            F.col("missing_right"),
        )
        for f in fields
    ]
    return row.select(F.inline(F.array(*entries)))


def ids_only_in(left: DataFrame, right: DataFrame, id_col: str = ID) -> DataFrame:
    return left.select(id_col).join(right.select(id_col), id_col, "left_anti")


def same_id_set(left: DataFrame, right: DataFrame, id_col: str = ID) -> bool:
    row = key_mismatch(left, right, [id_col]).first()
    return row["key_mismatch"] == 0


def missing_counts(df: DataFrame, fields: list[str], table: str = "table") -> DataFrame:
    """NULL count per field in one scan, one row per field."""
    row = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in fields])
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(table).alias("table_name"), F.lit(f).alias("field"), F.col(f).alias("missing"))
                    for f in fields
                ]
            )
        )
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def control_totals(df: DataFrame, fields: list[str], special: dict[str, float] | None = None) -> DataFrame:
    """Per column: exact decimal sum, non-integer values, special codes, NULLs."""
    special = special or {}
    aggregates = []
    for f in fields:
        x = F.col(f)
        aggregates += [
            F.sum(x.cast("decimal(28,6)")).alias(f"{f}__total"),
            F.count_if(x.cast("double") % 1 != 0).alias(f"{f}__non_integer"),
            (F.count_if(x == special[f]) if f in special else F.lit(0).cast("long")).alias(f"{f}__special"),
            F.count_if(x.isNull()).alias(f"{f}__missing"),
        ]
    entries = [
        F.struct(
            F.lit(f).alias("field"),
            F.col(f"{f}__total").cast("double").alias("total"),
            *[F.col(f"{f}__{c}").alias(c) for c in ("non_integer", "special", "missing")],
        )
        for f in fields
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*entries)))


def compare_totals(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join two control-total reports on the column name (one row per column)."""
    measures = ("total", "non_integer", "special", "missing")
    joined = left.alias("a").join(right.alias("b"), "field", "full_outer")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{m}").eqNullSafe(F.col(f"b.{m}")) for m in measures))
    return joined.select("field", same.alias("same"))


def content_checksum(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Order-independent checksum: row count and sum of row hashes."""
    columns = columns or df.columns
    return df.agg(
        F.count("*").alias("rows"),
        F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("checksum"),
    )


def _tagged(name: str) -> Column:
    """Field with a null tag and a length prefix, so no two rows share an encoding."""
    text = F.col(name).cast("string")
    return F.when(text.isNull(), F.lit("N")).otherwise(
        F.concat(F.lit("V"), F.octet_length(text).cast("string"), F.lit(":"), text)
    )


def content_fingerprint(
    df: DataFrame, key: str, columns: list[str], table: str, block: int = 4096
) -> DataFrame:
    """SHA-256 over key-ordered, length-prefixed rows as a tree of digests.

    Rows are hashed, row digests are hashed per fixed key block and the block
    digests level by level, ``block`` children at a time. A block covers ``block``
    consecutive integer keys and keys are checked to be unique first, so no level
    gathers an unbounded list.
    """
    require_unique_key(df, [key])
    present = F.when(F.col(key).isNotNull(), F.col(key)).otherwise(
        F.raise_error(F.lit("fingerprint key must be present"))
    )
    level = df.select(
        present.cast("long").alias("position"),
        F.sha2(F.concat(*[_tagged(c) for c in columns]), 256).alias("digest"),
    )
    span = level.agg(F.min("position").alias("low"), F.max("position").alias("high")).first()
    header = f"table-fingerprint-tree v1|{table}|" + "".join(f"{len(c.encode())}:{c}" for c in columns)
    if span["low"] is None:
        return df.sparkSession.range(1).select(
            F.lit(table).alias("table_name"), F.sha2(F.lit(header), 256).alias("fingerprint")
        )
    low, width = span["low"], span["high"] - span["low"] + 1
    level = level.select((F.col("position") - low).alias("position"), "digest")
    while True:
        level = (
            level.groupBy(F.floor(F.col("position") / block).alias("position"))
            .agg(F.array_sort(F.collect_list(F.struct("position", "digest"))).alias("children"))
            .select(
                "position",
                F.sha2(F.concat_ws(",", F.transform("children", lambda c: c["digest"])), 256).alias("digest"),
            )
        )
        width = -(-width // block)
        if width <= 1:
            break
    return level.select(
        F.lit(table).alias("table_name"),
        F.sha2(F.concat(F.lit(header + "|"), F.col("digest")), 256).alias("fingerprint"),
    )


def reconciliation(
    application: DataFrame,
    bureau: DataFrame,
    aggregate: DataFrame,
    wide: DataFrame,
    paired: list[str],
    counts: dict[str, tuple[int, int]] | None = None,
    id_col: str = ID,
) -> DataFrame:
    """One row per invariant: ``(check_name, expected, actual, ok)``.

    ``counts`` adds pairs the caller already knows, such as read and stored rows.
    """
    def entry(df: DataFrame, name: str, expected: Column, actual: Column) -> DataFrame:
        return df.agg(
            expected.cast("long").alias("expected"), actual.cast("long").alias("actual")
        ).select(F.lit(name).alias("check_name"), "expected", "actual")

    rows, none = F.count("*"), F.max(F.lit(0))
    checks = [
        entry(bureau, "aggregate_rows", F.count_distinct(id_col), none),
        entry(aggregate, "aggregate_rows", none, rows),
        entry(application, "wide_rows", rows, none),
        entry(wide, "wide_rows", none, rows),
        entry(key_mismatch(application, wide, [id_col]), "key_sets", none, F.sum("key_mismatch")),
        entry(
            field_mismatch_rows(application, wide, paired, [id_col]),
            "paired_fields",
            none,
            F.sum("field_mismatch"),
        ),
    ]
    for name, (expected, actual) in (counts or {}).items():
        checks.append(
            application.sparkSession.range(1).select(
                F.lit(name).alias("check_name"),
                F.lit(int(expected)).cast("long").alias("expected"),
                F.lit(int(actual)).cast("long").alias("actual"),
            )
        )
    report = (
        reduce(lambda a, b: a.unionByName(b), checks)
        .groupBy("check_name")
        .agg(
            F.sum(F.coalesce("expected", F.lit(0))).alias("expected"),
            F.sum(F.coalesce("actual", F.lit(0))).alias("actual"),
        )
    )
    return report.withColumn("ok", F.col("expected") == F.col("actual"))
