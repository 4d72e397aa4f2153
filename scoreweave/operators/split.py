"""Hash-ordered splits and samples.

Every id gets a fixed pseudo-random key ``md5(seed:id)``; partitions are ranges of
that key inside each label class. The range ends come from bucket counts plus a rank
inside the few boundary buckets, so the assignment itself is one projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import guards
from ..functions.columns import ID, TARGET

# Hash prefix length in hex digits: 4,096 equal buckets per class and level.
PREFIX = 3
# A boundary bucket above this many rows is cut by further digits before ranking.
RANK_LIMIT = 1_000_000


def hash_key(id_col: Column | str, seed: int) -> Column:
    """``md5(seed:id):id`` - hash order, and unique because the id is part of it."""
    x = (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")
    return F.concat(F.md5(F.concat_ws(":", F.lit(str(seed)), x)), F.lit(":"), x)


def class_quotas(total: int, counts: dict, wanted: int) -> dict:
    """Largest-remainder share of ``wanted`` rows per class."""
    exact = {c: wanted * n / total for c, n in counts.items()}
    quota = {c: math.floor(x) for c, x in exact.items()}
    rest = wanted - sum(quota.values())
    order = sorted(counts, key=lambda c: (-(exact[c] - quota[c]), c))
    for c in order[:rest]:
        quota[c] += 1
    return quota


def _counts(keyed: DataFrame, digits: int) -> dict:
    """Rows per class and hash prefix, in prefix order."""
    rows = keyed.groupBy("c", F.substring("h", 1, digits).alias("b")).agg(F.count("*").alias("n")).collect()
    found: dict = {}
    for r in sorted(rows, key=lambda r: (r["c"], r["b"])):
        found.setdefault(r["c"], {})[r["b"]] = r["n"]
    return found


def _keyed(df: DataFrame, seed: int, id_col: str, class_col: str | None) -> DataFrame:
    label = guards.binary_label(class_col) if class_col else F.lit(0)
    return df.select(label.alias("c"), hash_key(id_col, seed).alias("h"))


def bucket_counts(df: DataFrame, seed: int, id_col: str = ID, class_col: str | None = None) -> dict:
    """Rows per class and hash bucket: at most 4,096 numbers per class, whatever the data."""
    return _counts(_keyed(df, seed, id_col, class_col), PREFIX)


def _locate(counts: dict, wanted: list[tuple]) -> list[tuple]:
    """(class, k, prefix, rows before, rows inside) of the bucket holding each rank."""
    spots = []
    for c, k, start in wanted:
        before = start
        for b, n in counts[c].items():
            if before < k <= before + n:
                spots.append((c, k, b, before, n))
                break
            before += n
    return spots


def hash_cuts(
    df: DataFrame,
    counts: dict,
    wanted: dict,
    seed: int,
    id_col: str = ID,
    class_col: str | None = None,
    rank_limit: int = RANK_LIMIT,
) -> dict:
    """Key of the k-th row in hash order, per class and k (1-based).

    The bucket holding each rank is known from the counts. Buckets that are still
    large are counted again by longer prefixes; only rows of small ones are ranked.
    """
    keyed = _keyed(df, seed, id_col, class_col)
    spots = _locate(counts, [(c, k, 0) for c, ks in wanted.items() for k in ks if k > 0])
    digits = PREFIX

    def members(spots: list[tuple], digits: int) -> DataFrame:
        # One membership test, so the hash is computed once per row.
        parts = sorted({f"{c}{b}" for c, _, b, _, _ in spots})
        return keyed.filter(F.concat(F.col("c").cast("string"), F.substring("h", 1, digits)).isin(parts))

    done: list[tuple] = []
    while large := [x for x in spots if x[4] > rank_limit]:
        done += [(x, digits) for x in spots if x[4] <= rank_limit]
        inside = members(large, digits)
        digits += PREFIX
        deeper = _counts(inside, digits)
        spots = [
            spot
            for c, k, b, before, _ in large
            for spot in _locate({c: {p: n for p, n in deeper[c].items() if p.startswith(b)}}, [(c, k, before)])
        ]
    done += [(x, digits) for x in spots]
    cuts = {}
    for level in sorted({d for _, d in done}):
        here = [x for x, d in done if d == level]
        bucket = F.substring("h", 1, level)
        order = Window.partitionBy("c", bucket).orderBy("h")
        ranked = members(here, level).select("c", bucket.alias("b"), "h", F.row_number().over(order).alias("rank"))
        hit = " OR ".join(f"(c = {c} AND b = '{b}' AND rank = {k - before})" for c, k, b, before, _ in here)
        found = {(r["c"], r["b"], r["rank"]): r["h"] for r in ranked.filter(hit).collect()}
        cuts.update({(c, k): found[c, b, k - before] for c, k, b, before, _ in here})
    return cuts


def _range_name(key: Column, label: Column, ends: list[dict], names: list[str]) -> Column:
    """Name of the key range a row falls into; the key is computed once per row."""
    passed = F.lit(1)
    for end in ends:
        cut = F.lit("")
        for c, value in end.items():
            cut = F.when(label == c, F.lit(value)).otherwise(cut)
        passed = passed + (key > cut).cast("int")
    return F.element_at(F.array(*[F.lit(n) for n in names]), passed)


def _fractions(valid_size: float, test_size: float) -> None:
    for x in (valid_size, test_size):
        if isinstance(x, bool) or not isinstance(x, (int, float)) or not 0 < x < 1:
            raise ValueError("split sizes must lie strictly between 0 and 1")
    if valid_size + test_size >= 1:
        raise ValueError("the training part must keep a positive share")


def _buckets(df: DataFrame, target: str, id_col: str, seed: int) -> tuple[dict, dict]:
    """Bucket counts plus class totals; both label classes must be there."""
    buckets = bucket_counts(df, seed, id_col, target)
    counts = {c: sum(b.values()) for c, b in buckets.items()}
    if set(counts) != {0, 1}:
        raise ValueError("a stratified split needs both label classes")
    return buckets, counts


def stratified_split(
    df: DataFrame,
    target: str = TARGET,
    id_col: str = ID,
    valid_size: float = 0.2,
    test_size: float = 0.2,
    seed: int = 42,
    validate: bool = True,
) -> DataFrame:
    """Add ``partition`` (train / valid / test); row order plays no part.

    Test takes ``ceil(test * n)`` rows, valid ``ceil`` of its share of the rest;
    each part takes its classes by largest remainder.
    """
    _fractions(valid_size, test_size)
    if isinstance(seed, bool) or not isinstance(seed, int) or not 0 <= seed < 2**32:
        raise ValueError("seed must be a whole number in [0, 2**32)")
    if validate:
        guards.require_integer_id(df, id_col)
        guards.require_unique_key(df, [id_col])
    buckets, counts = _buckets(df, target, id_col, seed)
    total = sum(counts.values())
    n_test = math.ceil(test_size * total)
    test = class_quotas(total, counts, n_test)
    left = {c: counts[c] - test[c] for c in counts}
    rest = total - n_test
    # Rounding guards ceil against a share that is a whole number up to float noise.
    n_valid = math.ceil(round(valid_size / (1.0 - test_size) * rest, 9))
    valid = class_quotas(rest, left, n_valid)
    if any(q[c] < 1 for q in (test, valid) for c in counts) or any(left[c] - valid[c] < 1 for c in counts):
        raise ValueError("every part must hold both classes")

    cuts = hash_cuts(df, buckets, {c: [test[c], test[c] + valid[c]] for c in counts}, seed, id_col, target)
    ends = [{c: cuts[c, test[c]] for c in counts}, {c: cuts[c, test[c] + valid[c]] for c in counts}]
    part = _range_name(hash_key(id_col, seed), F.col(target), ends, ["test", "valid", "train"])
    return df.withColumn("partition", part)


def membership(split: DataFrame, id_col: str = ID) -> DataFrame:
    return split.select(id_col, "partition")


def stratified_halves(
    df: DataFrame, second_share: float = 0.5, seed: int = 42, target: str = TARGET, id_col: str = ID
) -> DataFrame:
    """Split one part into ``calibration`` and ``selection``."""
    _fractions(second_share / 2, second_share / 2)
    buckets, counts = _buckets(df, target, id_col, seed)
    total = sum(counts.values())
    second = class_quotas(total, counts, math.ceil(second_share * total))
    cuts = hash_cuts(df, buckets, {c: [second[c]] for c in counts}, seed, id_col, target)
    end = {c: cuts[c, second[c]] for c in counts if second[c]}
    part = _range_name(hash_key(id_col, seed), F.col(target), [end], ["selection", "calibration"])
    return df.withColumn("inner_partition", part)


def split_quality(split: DataFrame, target: str = TARGET) -> DataFrame:
    return split.groupBy("partition").agg(
        F.count("*").alias("n_rows"), F.sum(target).cast("long").alias("n_bad"), F.avg(target).alias("bad_rate")
    )


def partition_check(split: DataFrame, source: DataFrame, id_col: str = ID) -> DataFrame:
    """Ids in more than one part, ids lost, ids invented (all must be 0)."""
    sides = split.select(id_col, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        source.select(id_col, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    per_id = sides.groupBy(id_col).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return per_id.agg(
        F.count_if(F.col("a") > 1).alias("overlapping"),
        F.count_if((F.col("a") == 0) & (F.col("b") > 0)).alias("lost"),
        F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("invented"),
    )


def first_per_group(df: DataFrame, n: int, group: str = "partition", id_col: str = ID) -> DataFrame:
    """First ``n`` ids of every group.

    A grouped bound on the n-th smallest id is found from per-task candidates, so a
    group holding most rows is never sorted in one task.
    """
    salted = df.select(group, id_col, (F.abs(F.hash(id_col)) % 256).alias("salt"))
    local = Window.partitionBy(group, "salt").orderBy(id_col)
    candidates = salted.withColumn("rank", F.row_number().over(local)).filter(F.col("rank") <= n)
    final = Window.partitionBy(group).orderBy(id_col)
    keep = candidates.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= n)
    return df.join(keep.select(group, id_col), [group, id_col], "left_semi")


def seeded_sample(df: DataFrame, n: int, seed: int = 42, id_col: str = ID) -> DataFrame:
    """The ``n`` rows with the smallest hash keys; labels play no part."""
    key = hash_key(id_col, seed)
    if n <= 10_000:
        return df.orderBy(key).limit(n)
    cut = hash_cuts(df, bucket_counts(df, seed, id_col), {0: [n]}, seed, id_col)
    return df.filter(key <= cut[0, n]) if cut else df
