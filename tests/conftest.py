import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from scoreweave.session import apply_settings

    session = (
        SparkSession.builder.master("local[8]")
        .appName("scoreweave-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    apply_settings(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw_model_table(spark):
    """900 labelled rows with two informative scores (fixed seed)."""
    import numpy as np

    from scoreweave.functions.columns import RAW_COLUMNS

    rng = np.random.default_rng(5)
    n = 900
    score, leverage = rng.uniform(0, 1, n), rng.uniform(0, 1, n)
    target = (rng.uniform(0, 1, n) < 1 / (1 + np.exp(-(1 - 5 * score + 3 * leverage)))).astype(int)
    income = rng.uniform(5e4, 2e5, n)
    columns = {
        "amt_income_total": income,
        "amt_credit": income * (0.5 + 2 * leverage),
        "amt_annuity": rng.uniform(5e3, 3e4, n),
        "days_birth": -rng.integers(7000, 25000, n).astype(float),
        "days_employed": -rng.integers(0, 14000, n).astype(float),
        "ext_source_1": score,
        "ext_source_2": np.clip(score + rng.normal(0, 0.1, n), 0, 1),
        "ext_source_3": rng.uniform(0, 1, n),
        "bureau_cnt": rng.integers(0, 10, n).astype(float),
        "bureau_debt_total": rng.uniform(0, 3e5, n),
    }
    rows = [
        (5000 + i, int(target[i]), *[float(columns[c][i]) for c in RAW_COLUMNS]) for i in range(n)
    ]
    schema = "sk_id_curr long, target int, " + ", ".join(f"{c} double" for c in RAW_COLUMNS)
    return spark.createDataFrame(rows, schema).cache()
