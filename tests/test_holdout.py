from pyspark.sql import functions as F

from scoreweave.plans import holdout


def test_reports_agree_with_each_other(spark, tmp_path, raw_model_table):
    folder = str(tmp_path / "reports")
    with holdout.holdout(raw_model_table, tree_options={"rounds": 2, "min_rows": 30}) as run:
        protocol = holdout.write_all(run, folder, 5)
        n_valid = run.valid.count()
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    assert protocol["test_part_read"] is False and n_valid == 180
    metrics = {r["model"]: r for r in read("metrics").collect()}
    assert set(metrics) == {"logistic", "trees", "constant"} and metrics["constant"]["auc"] == 0.5
    summary = {r["metric"]: r for r in read("bootstrap_summary").collect()}
    assert abs(summary["auc"]["base_value"] - metrics["logistic"]["auc"]) < 1e-12
    assert abs(summary["auc"]["challenger_value"] - metrics["trees"]["auc"]) < 1e-12
    bins = {r["model"]: r["n"] for r in read("calibration_bins").groupBy("model").agg(F.sum("n_samples").alias("n")).collect()}
    assert bins == {"logistic": 180, "trees": 180}
    assert read("feature_drift").count() == 35 and read("prediction_drift").count() == 2
    assert read("curves").filter("threshold = 1.0 AND approved_count <> 180").isEmpty()
    assert read("review_counts").filter("n_samples <> 180").isEmpty()
    assert read("reasons").filter("rank > 3 OR log_odds_contribution <= 0").isEmpty()
