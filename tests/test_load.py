import json

import pytest
from pyspark.sql import functions as F

from scoreweave.functions.guards import GateError
from scoreweave.operators import compare
from scoreweave.sources import contract, files, load, runs, tables

APPLICATION = """SK_ID_CURR,TARGET,NAME_CONTRACT_TYPE,CODE_GENDER,AMT_INCOME_TOTAL,AMT_CREDIT,AMT_ANNUITY,DAYS_BIRTH,DAYS_EMPLOYED,EXT_SOURCE_1,EXT_SOURCE_2,EXT_SOURCE_3,UNUSED
1,0,Cash loans,F,100000,200000,10000,-10000,-2000,0.7,0.6,0.5,x
2,1,Cash loans,M,50000,100000,5000,-12000,365243,,0.5,0.4,NA
3,0,Revolving loans,F,80000,150000,7000,-11000,-1500,0.6,,0.55,
"""
BUREAU = """SK_ID_BUREAU,SK_ID_CURR,CREDIT_ACTIVE,DAYS_CREDIT,AMT_CREDIT_SUM,AMT_CREDIT_SUM_DEBT,CREDIT_DAY_OVERDUE
101,1,Active,-10,100,40,5
102,1,Closed,-30,200,,0
103,3,,-5,,,
104,999,Active,-1,500,50,0
"""


def source(tmp_path, application=APPLICATION, bureau=BUREAU, name="in"):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "application_train.csv").write_text(application)
    (folder / "bureau.csv").write_text(bureau)
    return str(folder)


def test_load_publishes_four_tables(spark, tmp_path):
    house = load.Warehouse(str(tmp_path / "house"))
    record = load.load_tables(spark, source(tmp_path), house, "first")
    assert {r["sk_id_curr"] for r in load.read_table(spark, house, "feat_bureau").collect()} == {1, 3, 999}
    rows = {r["sk_id_curr"]: r for r in load.read_table(spark, house, "model_input").collect()}
    assert len(rows) == 3
    one, two, three = rows[1], rows[2], rows[3]
    assert (one["bureau_cnt"], float(one["bureau_credit_sum_total"]), float(one["bureau_debt_total"]), one["bureau_overdue_cnt"]) == (2, 300.0, 40.0, 1)
    assert (two["bureau_cnt"], two["bureau_credit_sum_total"]) == (0, None)
    assert (three["bureau_cnt"], three["bureau_credit_sum_total"], three["bureau_overdue_cnt"]) == (1, None, 0)
    assert record["linkage"] == {"parents_with_child": 2, "parents_without_child": 1, "orphan_children": 1, "children": 4}
    gaps = {r["field"]: r["missing"] for r in record["missing_values"] if r["table_name"] == "bureau"}
    assert gaps == {"credit_active": 1, "days_credit": 0, "amt_credit_sum": 1, "amt_credit_sum_debt": 2, "credit_day_overdue": 1}
    assert record["headers"]["application_train"]["extra"] == ["unused"]
    assert all(r["ok"] for r in record["reconciliation"])

    # A refresh becomes visible as a whole; the same id is refused and leaves data alone.
    second = source(tmp_path, APPLICATION.replace("\n3,0,", "\n4,0,"), name="next")
    load.load_tables(spark, second, house, "second")
    assert {r["sk_id_curr"] for r in load.read_table(spark, house, "model_input").collect()} == {1, 2, 4}
    with pytest.raises(load.LoadStageError):
        load.load_tables(spark, second, house, "second")
    assert load.success_records(spark, house).count() == 2


@pytest.mark.parametrize(
    "application, bureau, stage",
    [
        (APPLICATION.replace("AMT_CREDIT,", "AMT_LOAN,", 1), BUREAU, "staging"),
        (APPLICATION.replace("UNUSED", " sk_id_curr "), BUREAU, "staging"),
        (APPLICATION.replace(",150000,", ",a lot,"), BUREAU, "staging"),
        (APPLICATION + "3,0,Cash loans,F,1,1,1,-1,-1,,,,\n", BUREAU, "staging"),
        (APPLICATION.replace("\n2,1,", "\n2,3,"), BUREAU, "staging"),
        (APPLICATION, BUREAU.replace("104,999", "104,"), "staging"),
    ],
)
def test_load_failures_publish_nothing(spark, tmp_path, application, bureau, stage):
    house = load.Warehouse(str(tmp_path / "house"))
    load.load_tables(spark, source(tmp_path), house, "good")
    with pytest.raises(load.LoadStageError) as error:
        load.load_tables(spark, source(tmp_path, application, bureau, "bad"), house, "bad")
    assert error.value.stage == stage
    assert load.current_load(spark, house) == "good"
    failure = spark.read.parquet(house.failures).first()
    assert (failure["load_id"], failure["stage"]) == ("bad", stage)
    assert "a lot" not in json.dumps(failure.asDict(), default=str)


def test_missing_file_is_named(spark, tmp_path):
    folder = source(tmp_path)
    assert files.missing_files(spark, folder) == [
        "bureau_balance.csv", "previous_application.csv", "POS_CASH_balance.csv", "installments_payments.csv", "credit_card_balance.csv",
    ]
    with pytest.raises(FileNotFoundError):
        files.check_inventory(spark, folder)


def test_headers():
    assert contract.header_places([" A ", "b"]) == {"a": 0, "b": 1}
    for bad in (["a", "A "], ["a", " "]):
        with pytest.raises(GateError):
            contract.header_places(bad)
    with pytest.raises(ValueError):
        contract.SourceTable("f", "t", contract.T.StructType([contract.column("a", contract.T.LongType(), required=1)]))
    headers = [" AMT_NEW", *[n.upper() for n in reversed(contract.BUREAU.names)], "Other"]
    assert contract.BUREAU.unloaded(headers) == ["amt_new", "other"]
    with pytest.raises(GateError, match="days_credit"):
        contract.BUREAU.unloaded([h for h in headers if h != "DAYS_CREDIT"])
    wide = contract.BUREAU.retyped(sk_id_bureau=contract.T.LongType())
    assert (wide.key, wide.names) == (contract.BUREAU.key, contract.BUREAU.names)
    assert contract.families(wide.types)["sk_id_bureau"] == "integer" and contract.families(wide.types)["amt_credit_sum"] == "numeric"


def test_rules_of_a_contract():
    rules = contract.violation_rules(contract.APPLICATION)
    assert {"missing:sk_id_curr", "missing:target", "not_binary:target", "too_long:code_gender", "bad_value:amt_credit"} <= set(rules)
    assert "bad_value:code_gender" not in rules and "missing:amt_credit" not in rules
    assert contract.stored_tables()["model_input"]["bureau_cnt"] == "integer"


def test_digests_and_provenance(spark, tmp_path):
    import hashlib

    folder = source(tmp_path)
    digests = files.file_digests(spark, folder)
    found = {r["name"]: r["digest"] for r in digests.collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest().upper()
    for leaf in (2, files.LEAF_LINES):
        lines = [sha(x) for x in BUREAU.split("\n")[:-1]]
        leaves = [sha("".join(lines[i : i + leaf])) for i in range(0, len(lines), leaf)]
        want = "tree:" + sha(f"{len(BUREAU)}:" + "".join(leaves)).lower()
        got = {r["name"]: r["digest"] for r in files.file_digests(spark, folder, leaf).collect()}
        assert got["bureau.csv"] == want
    other = digests.withColumn("digest", F.when(F.col("name") == "bureau.csv", F.lit("x")).otherwise(F.col("digest")))
    verdicts = {r["name"]: r["verdict"] for r in files.provenance(digests, other).collect()}
    assert verdicts == {"bureau.csv": "different", "application_train.csv": "same"}
    files.require_frozen(digests, digests)
    with pytest.raises(GateError):
        files.require_frozen(other, digests)


def test_fingerprint_reacts_to_every_change(spark):
    df = spark.createDataFrame([(i * 37, None if i % 3 else f"v{i}") for i in range(500)], "k long, v string")
    mark = lambda d: compare.content_fingerprint(d, "k", ["k", "v"], "t", 16).first()["fingerprint"]
    assert mark(df) == mark(df.orderBy(F.desc("k")).repartition(5))
    assert mark(df) != mark(df.withColumn("v", F.coalesce("v", F.lit(""))))
    assert mark(df) != mark(df.filter("k > 0"))


def test_model_table_reader(spark, tmp_path, raw_model_table):
    path = str(tmp_path / "t.csv")
    raw_model_table.coalesce(1).write.option("header", True).csv(path)
    again = tables.load_model_table(spark, path)
    assert again.count() == 900 and dict(again.dtypes)["amt_credit"] == "double"
    raw_model_table.drop("amt_credit").write.parquet(str(tmp_path / "u"))
    with pytest.raises(GateError):
        tables.load_model_table(spark, str(tmp_path / "u"))
    raw_model_table.union(raw_model_table.limit(1)).write.parquet(str(tmp_path / "w"))
    with pytest.raises(GateError):
        tables.load_model_table(spark, str(tmp_path / "w"))


def test_reports_and_runs(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    tables.write_report(df, str(tmp_path / "r"), "csv")
    with pytest.raises(Exception, match="infinite"):
        tables.write_report(df.withColumn("x", F.lit(float("inf"))), str(tmp_path / "s"))
    assert tables.plain({"a": float("nan"), "b": [1.0]}) == {"a": None, "b": [1.0]}
    with pytest.raises(ValueError):
        tables.plain(float("inf"))
    path = str(tmp_path / "runs")
    with pytest.raises(FileNotFoundError):
        runs.load_runs(spark, path)
    runs.save_run(spark, path, "r1", "b1", "done", {"x": float("nan")})
    runs.save_run(spark, path, "r2", "b1", "done", {"x": 2})
    with pytest.raises(ValueError):
        runs.save_run(spark, path, "r1", "b9", "done", {})
    newest = runs.load_runs(spark, path, 1).first()
    assert (newest["run_id"], json.loads(newest["payload"])) == ("r2", {"x": 2})
    assert runs.append_opening(spark, str(tmp_path / "open"), "m", 1, "p") == 1
    assert runs.append_opening(spark, str(tmp_path / "open"), "m", 1, "p") == 2


def test_compare_operators(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "sk_id_curr long, x double")
    b = spark.createDataFrame([(2, None), (3, 4.0), (4, 1.0)], "sk_id_curr long, x double")
    assert tuple(compare.key_mismatch(a, b).first()) == (1, 1, 2)
    assert compare.field_mismatch_rows(a, b, ["x"]).first()[0] == 1
    assert tuple(compare.per_field_compare(a, b, ["x"]).first()) == ("x", 2, 1, 1, 1)
    assert not compare.same_id_set(a, b) and compare.same_id_set(a, a)
    assert contract.schema_problems(a, "feat_bureau")[0].endswith("missing")


@pytest.mark.parametrize("leaf", [1, 2, 4096])
def test_digest_depends_on_the_order_of_lines(spark, tmp_path, leaf):
    for name, text in (("a", "a\nb\n"), ("b", "b\na\n"), ("c", "a\nb")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f").write_text(text)
    found = [files.file_digests(spark, str(tmp_path / n), leaf).first()["digest"] for n in "abc"]
    assert len(set(found)) == 3


def test_digest_does_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "big").write_text("".join(f"line {i * i}\n" for i in range(20000)))
    once = files.file_digests(spark, str(tmp_path / "big")).first()["digest"]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        assert files.file_digests(spark, str(tmp_path / "big")).first()["digest"] == once
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_part_files_need_one_header(spark, tmp_path):
    folder = source(tmp_path)
    head, *rows = APPLICATION.splitlines(keepends=True)
    (tmp_path / "in" / "application_train.csv").unlink()
    (tmp_path / "in" / "application_train.csv").mkdir()
    parts = tmp_path / "in" / "application_train.csv"
    (parts / "part-0.csv").write_text(head + rows[0])
    (parts / "part-1.csv").write_text(head.replace("AMT_INCOME_TOTAL,AMT_CREDIT", "AMT_CREDIT,AMT_INCOME_TOTAL") + rows[1])
    house = load.Warehouse(str(tmp_path / "house"))
    with pytest.raises(load.LoadStageError) as error:
        load.load_tables(spark, folder, house, "one")
    assert error.value.stage == "staging" and "header" in str(error.value)
    (parts / "part-1.csv").write_text(head + rows[1] + rows[2])
    load.load_tables(spark, folder, house, "one")
    assert load.read_table(spark, house, "model_input").count() == 3


def test_doubled_quotes(spark, tmp_path):
    text = APPLICATION.replace("1,0,Cash loans", '1,0,"Cash ""x"", loans"')
    house = load.Warehouse(str(tmp_path / "house"))
    load.load_tables(spark, source(tmp_path, text), house, "one")
    names = {r["name_contract_type"] for r in load.read_table(spark, house, "application_train").collect()}
    assert names == {'Cash "x", loans', "Cash loans", "Revolving loans"}


def test_failed_load_can_be_repeated(spark, tmp_path):
    house = load.Warehouse(str(tmp_path / "house"))
    with pytest.raises(load.LoadStageError):
        load.load_tables(spark, source(tmp_path, APPLICATION.replace(",150000,", ",a lot,"), name="bad"), house, "one")
    load.load_tables(spark, source(tmp_path), house, "one")
    assert load.read_table(spark, house, "model_input", "one").count() == 3


def test_line_hashes_travel_as_runs(spark, tmp_path):
    import hashlib

    import pyarrow as pa

    # Two splits of one file and a split of another, over batches that cut the second one.
    hashes = [hashlib.sha256(str(i).encode()).digest() for i in range(6000)]
    rows = [(7, 0 if i < 500 else 900, h) for i, h in enumerate(hashes)] + [(8, 0, hashes[0])]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], ["file", "split", "hash"])
        for part in (rows[:700], rows[700:])
    ]
    runs = [r for b in files.line_runs(iter(batches)) for r in b.to_pylist()]
    assert [(r["file"], r["split"], r["first"], r["n"]) for r in runs] == [
        (7, 0, 0, 500), (7, 900, 0, 200), (7, 900, 200, 4096), (7, 900, 4296, 1204), (8, 0, 0, 1),
    ]
    assert b"".join(r["hashes"] for r in runs) == b"".join(r[2] for r in rows)

    # Many files of several leaves, some packed into one task, against the definition.
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest().upper()
    want = {}
    for i, n in enumerate((1, 4095, 4096, 4097, 9000)):
        lines = [f"line {i} {j}" for j in range(n)]
        (tmp_path / f"part-{i}").write_text("\n".join(lines) + "\n")
        marks = [sha(x) for x in lines]
        leaves = "".join(sha("".join(marks[k : k + 4096])) for k in range(0, n, 4096))
        want[f"part-{i}"] = "tree:" + sha(f"{(tmp_path / f'part-{i}').stat().st_size}:{leaves}").lower()
    assert {r["name"]: r["digest"] for r in files.file_digests(spark, str(tmp_path)).collect()} == want


def test_rules_are_told_apart_only_for_broken_files(spark, tmp_path, monkeypatch):
    counted = []
    plain = load.rule_violations
    monkeypatch.setattr(load, "rule_violations", lambda *args: counted.append(1) or plain(*args))
    house = load.Warehouse(str(tmp_path / "house"))
    load.load_tables(spark, source(tmp_path), house, "good")
    assert not counted
    bad = APPLICATION.replace(",150000,", ",a lot,").replace("\n1,0,", "\n1,,").replace("\n2,1,", "\n2,3,") + "4,0\n"
    with pytest.raises(load.LoadStageError) as error:
        load.load_tables(spark, source(tmp_path, bad, name="bad"), house, "bad")
    broken = {"bad_value:amt_credit": 1, "missing:target": 1, "not_binary:target": 1, "malformed": 1}
    assert str(broken) in str(error.value) and len(counted) == 1
