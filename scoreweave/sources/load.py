"""Contract-checked load of two text files into four versioned tables.

Each attempt writes to a folder of its own below ``v=<load_id>``; the success record names
it and is the commit point. Readers resolve the newest successful version, so a failed or
lost load leaves an unreferenced folder, never a half-visible table, and may be tried again.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import RAW_COLUMNS
from ..functions.guards import GateError, rule_violations
from ..operators import compare, wide
from . import files
from .contract import (
    CONTRACT_VERSION,
    CONTRACTS,
    SourceTable,
    read_header,
    read_text_columns,
    schema_problems,
    typed,
    violation_rules,
)

# Fields compared between the source and the model table, and fields whose gaps
# are counted.
PAIRED = ("target", "amt_income_total", "amt_credit", "days_birth", "ext_source_1", "code_gender")
MISSING_FIELDS = {
    "application_train": RAW_COLUMNS[:8],
    "bureau": ("credit_active", "days_credit", "amt_credit_sum", "amt_credit_sum_debt", "credit_day_overdue"),
}
AUDIT_SCHEMA = (
    "load_id string, location string, contract_version string, loaded_at timestamp, input_files string, headers string, "
    "counts string, linkage string, missing_values string, reconciliation string"
)


class LoadStageError(RuntimeError):
    """A refused load: what was being done and why it stopped there."""

    stage = property(lambda self: self.args[0])

    def __str__(self) -> str:
        return " refused: ".join(map(str, self.args))


@dataclass(frozen=True)
class Warehouse:
    """Folder layout of the versioned tables and the audit tables."""

    root: str

    def attempt(self, load_id: str) -> str:
        """A fresh folder for one attempt to load a version."""
        return f"{self.root}/v={load_id}/{uuid.uuid4().hex}"

    @property
    def loads(self) -> str:
        return f"{self.root}/audit/loads"

    @property
    def failures(self) -> str:
        return f"{self.root}/audit/failures"


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).limit(1)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def success_records(spark: SparkSession, warehouse: Warehouse) -> DataFrame:
    if not path_exists(spark, warehouse.loads):
        return spark.createDataFrame([], AUDIT_SCHEMA)
    return spark.read.schema(AUDIT_SCHEMA).parquet(warehouse.loads)


def current_load(spark: SparkSession, warehouse: Warehouse) -> str:
    row = success_records(spark, warehouse).orderBy(F.desc("loaded_at"), F.desc("load_id")).first()
    if row is None:
        raise GateError("no successful load yet")
    return row["load_id"]


def read_table(spark: SparkSession, warehouse: Warehouse, name: str, load_id: str | None = None) -> DataFrame:
    wanted = load_id or current_load(spark, warehouse)
    row = success_records(spark, warehouse).filter(F.col("load_id") == wanted).first()
    if row is None:
        raise GateError(f"load {wanted} did not succeed")
    return spark.read.parquet(f"{row['location']}/{name}")


def stage_file(spark: SparkSession, path: str, contract: SourceTable, target: str) -> dict:
    """Read text, check every row rule and write typed columns in one pass."""
    headers = read_header(spark, path)
    extra = contract.unloaded(headers)
    text = read_text_columns(spark, path, headers)
    malformed = {"malformed": F.col("_malformed").isNotNull()}
    # Each field is typed once and observed as one flag; the rules are told apart only after a broken row.
    values = {n: f"typed:{n}" for n in contract.names}
    rows = text.select(*contract.names, "_malformed", *[typed(n, t).alias(values[n]) for n, t in contract.types.items()])
    rules = {**violation_rules(contract, {n: F.col(v) for n, v in values.items()}), **malformed}
    flagged = rows.select(
        *[F.col(v).alias(n) for n, v in values.items()], reduce(lambda a, b: a | b, rules.values()).alias("typed:broken")
    )
    seen = Observation()
    watched = flagged.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("typed:broken").alias("broken"))
    try:
        watched.drop("typed:broken").write.parquet(target)
    except Exception as error:
        if "CSV header does not conform" in str(error):
            raise GateError(f"{contract.file_name}: a part file has another header") from error
        raise
    counts = seen.get
    if counts["broken"]:
        found = rule_violations(text, {**violation_rules(contract), **malformed})
        raise GateError(f"{contract.file_name}: rows breaking rules: { {n: c for n, c in found.items() if c} }")
    stored = spark.read.parquet(target)
    keys = (
        stored.groupBy(*contract.key)
        .agg(F.count("*").alias("n"))
        .agg(F.sum("n").alias("stored"), F.count_if(F.col("n") > 1).alias("duplicated"))
        .first()
    )
    if keys["duplicated"]:
        raise GateError(f"{contract.file_name}: {keys['duplicated']} duplicated keys")
    return {
        "read": counts["rows"], "stored": keys["stored"] or 0, "headers": headers, "columns": list(contract.names), "extra": extra,
    }


def error_class(error: BaseException) -> str | None:
    return error.getCondition() if isinstance(error, PySparkException) else None


def record_failure(spark: SparkSession, warehouse: Warehouse, load_id: str, stage: str, error: BaseException) -> None:
    """Stage, error type and error class only; messages may quote field values."""
    try:
        row = spark.createDataFrame(
            [(load_id, stage, type(error).__name__, error_class(error))],
            "load_id string, stage string, error_type string, error_code string",
        )
        row.withColumn("attempted_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(warehouse.failures)
    except Exception:  # noqa: BLE001 - the original failure must win
        pass


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def load_tables(
    spark: SparkSession, folder: str, warehouse: Warehouse, load_id: str, contracts=CONTRACTS
) -> dict:
    """Load, derive, reconcile and publish one version; returns the audit record."""
    if not isinstance(load_id, str) or not load_id.strip() or "/" in load_id:
        raise ValueError("load_id must be a plain non-blank name")
    application, bureau = contracts
    stage = "input"
    try:
        lost = files.missing_files(spark, folder, tuple(c.file_name for c in contracts))
        if lost:
            raise GateError(f"missing source files: {lost}")
        stage = "load_id"
        if not success_records(spark, warehouse).filter(F.col("load_id") == load_id).isEmpty():
            raise GateError(f"load {load_id} already succeeded")

        stage = "staging"
        folder_out = warehouse.attempt(load_id)
        # The files are independent: all are digested, read and written at the same time.
        with ThreadPoolExecutor(2 * len(contracts)) as pool:
            paths = {c.table: f"{folder}/{c.file_name}" for c in contracts}
            running = {c.table: pool.submit(stage_file, spark, paths[c.table], c, f"{folder_out}/{c.table}") for c in contracts}
            digesting = [pool.submit(lambda path: _rows(files.file_digests(spark, path)), path) for path in paths.values()]
            staged = {table: job.result() for table, job in running.items()}
            stage = "input"
            digests = [row for job in digesting for row in job.result()]
        stage = "derive"
        stored = {c.table: spark.read.parquet(f"{folder_out}/{c.table}") for c in contracts}
        wide.aggregate_children(stored[bureau.table]).write.parquet(f"{folder_out}/feat_bureau")
        aggregate = spark.read.parquet(f"{folder_out}/feat_bureau")
        wide.wide_table(stored[application.table], aggregate).write.parquet(f"{folder_out}/model_input")
        model_input = spark.read.parquet(f"{folder_out}/model_input")

        stage = "structure"
        tables = {**stored, "feat_bureau": aggregate, "model_input": model_input}
        problems = [p for name, df in tables.items() for p in schema_problems(df, name, contracts)]
        if problems:
            raise GateError(f"table structure: {problems}")

        stage = "reconcile"
        pairs = {f"{t}_rows": (s["read"], s["stored"]) for t, s in staged.items()}
        checks = {
            "report": compare.reconciliation(
                stored[application.table], stored[bureau.table], aggregate, model_input, list(PAIRED), pairs
            ),
            "linkage": compare.linkage(stored[application.table], stored[bureau.table]),
            "gaps": reduce(
                lambda a, b: a.unionByName(b),
                [compare.missing_counts(stored[t], list(fields), t) for t, fields in MISSING_FIELDS.items()],
            ),
        }
        with ThreadPoolExecutor(len(checks)) as pool:
            report, linkage, gaps = pool.map(_rows, checks.values())
        failed = [r for r in report if not r["ok"]]
        if failed:
            raise GateError(f"reconciliation: {failed}")
        record = {
            "load_id": load_id,
            "location": folder_out,
            "contract_version": CONTRACT_VERSION,
            "input_files": digests,
            "headers": {t: {k: s[k] for k in ("headers", "columns", "extra")} for t, s in staged.items()},
            "counts": {t: {k: s[k] for k in ("read", "stored")} for t, s in staged.items()},
            "linkage": linkage[0],
            "missing_values": gaps,
            "reconciliation": report,
        }
        stage = "record"
        row = (load_id, folder_out, CONTRACT_VERSION, *[json.dumps(record[k]) for k in list(record)[3:]])
        names = ", ".join(f"{k} string" for k in record)
        audit = spark.createDataFrame([row], names).withColumn("loaded_at", F.current_timestamp())
        order = [part.split()[0] for part in AUDIT_SCHEMA.split(", ")]
        audit.select(*order).coalesce(1).write.mode("append").parquet(warehouse.loads)
        return record
    except Exception as error:
        record_failure(spark, warehouse, load_id, stage, error)
        if isinstance(error, GateError):
            raise LoadStageError(stage, str(error)) from error
        raise
