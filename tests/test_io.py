import json
from datetime import datetime, timezone

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from riskloom.functions import policy
from riskloom.functions.registry import ALL_FEATURES
from riskloom.operators import explore as ex
from riskloom.operators import features as ft
from riskloom.operators import frames as fr
from riskloom.operators import validate as va
from riskloom.plans import scoring, training
from riskloom.sources import decision_log as dl
from riskloom.sources import events as ev
from riskloom.sources import testviews as views
from riskloom.streaming import scorer

from conftest import DATA

NOW = datetime(2024, 3, 1, tzinfo=timezone.utc)
LOW = {r: {"t_warn": 0.05, "t_review": 0.2, "t_block": 0.5} for r in ("cold", "warm")}


def rows(df):
    return sorted(map(str, df.collect()))


def test_files_round_trip(spark, events, tmp_path):
    df = events(dict(label_is_fraud=True, label_typology="QR_SWAP"), dict(at=1, label_typology=None))
    for path in ev.write_events(df, str(tmp_path)):
        assert rows(ev.read_events(spark, path).select(*df.columns)) == rows(df)
    with pytest.raises(ValueError):
        ev.read_events(spark, "events.parquet")


@pytest.mark.parametrize("text, fraud", [("TRUE", True), ("1", True), ("y", True), (" Yes", True), ("no", False), ("", False)])
def test_csv_labels(spark, events, tmp_path, text, fraud):
    _, path = ev.write_events(events({}), str(tmp_path / "src"))
    raw = spark.read.option("header", True).csv(path).withColumn("label_is_fraud", F.lit(text)).withColumn("label_typology", F.lit(""))
    raw.write.option("header", True).csv(str(tmp_path / "x.csv"))
    r = ev.read_csv(spark, str(tmp_path / "x.csv")).first()
    assert r.label_is_fraud is fraud and r.label_typology is None


def test_validation(spark, events):
    body = json.loads(events({}).select(ev.encode()).first()[0])
    plain = {k: v for k, v in body.items() if not k.startswith("label_")}
    cases = {json.dumps(plain): None, json.dumps({**plain, "amount": "12.5"}): None, "nope": "not a JSON object",
             json.dumps(body): "unknown field: label_is_fraud, label_typology",
             json.dumps({**plain, "txn_type": "X"}): "bad value: txn_type", json.dumps({**plain, "amount": "x"}): "bad value: amount",
             json.dumps({k: v for k, v in plain.items() if k != "device_id"}): "missing field: device_id"}
    df = spark.createDataFrame([(c,) for c in cases], "event string")
    assert {r.event: r.reason for r in va.check_events(df, "event", labels=False).collect()} == cases
    good, bad = va.split_events(df)
    assert good.count() == 2 and bad.count() == 5


def test_json_safe(spark):
    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")], (float("-inf"), "a"))],
                               "d double, a array<double>, s struct<x: double, y: string>")
    r = fr.json_safe(df).first()
    assert r.d is None and r.a == [1.0, None] and r.s.x is None and r.s.y == "a"


def test_model_frame(spark):
    df = spark.createDataFrame([("hundred", True, 5), ("odd", None, 6)], "amount_roundness string, is_night boolean, extra int")
    out = fr.model_frame(df, ["is_night", "amount_roundness", "absent"])
    assert out.columns == ["is_night", "amount_roundness", "absent"]
    assert [tuple(r) for r in out.collect()] == [(1.0, 1.0, None), (None, None, None)]


def test_split_is_contiguous_in_time(spark):
    df = fr.split_by_day(views.txn(spark, DATA), None, (0, 19), (20, 24), (25, None))
    fr.assert_in_time(df)
    assert df.where("split IS NULL").count() == 0
    with pytest.raises(AssertionError):
        fr.assert_in_time(df.withColumn("split", F.when(F.crc32("txn_id") % 2 == 0, "train").otherwise(
            F.when(F.crc32("txn_id") % 3 == 0, "val").otherwise("test"))))


def test_training_guards(spark, events):
    df = events(dict(label_typology="MULE_OUTBOUND"), dict(label_typology=None), {})
    assert fr.for_training(df).count() == 2
    few = spark.createDataFrame([(True, True), (False, False)], "is_cold boolean, label_is_fraud boolean")
    with pytest.raises(ValueError):
        fr.require_positives(few)


def test_first_write_wins_and_nothing_is_changed(spark, tmp_path):
    log = dl.DecisionLog(spark, str(tmp_path / "log"))
    make = lambda *r: spark.createDataFrame(list(r), "txn_id string, scored_at timestamp, action string, source string")
    assert log.count("a") == 0
    log.append(make(("a", NOW, "ALLOW", "api"), ("b", NOW, "WARN", "api")))
    before = {r.period: (r.n, r.content) for r in log.fingerprint().collect()}
    log.append(make(("a", NOW.replace(day=9), "BLOCK", "worker"), ("c", NOW.replace(day=9), "WARN", "worker"),
                    ("c", NOW.replace(day=8), "ALLOW", "worker")))
    assert log.find("a").first().action == "ALLOW" and log.count("a") == 1 and log.find("c").first().action == "ALLOW"
    after = {r.period: (r.n, r.content) for r in log.fingerprint().collect()}
    assert all(after[p] == v for p, v in before.items())
    assert not hasattr(log, "update") and not hasattr(log, "delete")
    with pytest.raises(ValueError):
        log.append(make(("z", NOW, "ALLOW", "mail")))


@pytest.fixture(scope="module")
def fitted(spark):
    return training.fit(ft.point_in_time(views.txn(spark, DATA)), (0, 19), (20, 24), (25, None), trees=3, min_positives=1,
                        check_leaks=False)


def test_models_survive_saving(spark, fitted, tmp_path):
    from riskloom.operators import model as md
    fitted.models["warm"].save(str(tmp_path / "warm"), spark)
    again = md.RouteModel.load(str(tmp_path / "warm"), spark)
    test = fitted.rows.where("split = 'test'")
    cols = ("txn_id", "raw_score", "risk_score")
    assert rows(md.predict(again, test).select(*cols)) == rows(md.predict(fitted.models["warm"], test).select(*cols))


def test_rescoring_with_the_same_model_and_thresholds_is_identical(spark, fitted):
    out = scoring.decisions(fitted.rows, fitted.rows.where("split = 'test'"), fitted.models, LOW, "replay", NOW)
    again = scoring.rescore(out, fitted.models, LOW)
    assert again.where("new_action <> action OR abs(new_risk_score - risk_score) > 1e-12").count() == 0
    assert scoring.run_backtest(out, fitted.models, LOW).first().net_benefit_delta == 0
    snapshot = out.schema["feature_snapshot"].dataType.names
    assert snapshot == ALL_FEATURES
    assert out.where("action = 'ALLOW' AND size(reason_codes) > 0").count() == 0


def test_stream_equals_batch_with_broken_repeated_and_restarted_messages(spark, fitted, tmp_path):
    base, txns = str(tmp_path), views.txn(spark, DATA)
    batch = scoring.replay(txns, fitted.models, LOW, None, NOW)
    history, log = dl.EventHistory(spark, f"{base}/history", "month"), dl.DecisionLog(spark, f"{base}/log", "month")
    s = scorer.Scorer(history, log, fitted.models, LOW, f"{base}/dead", f"{base}/stats", now=lambda: NOW)

    def arrive():
        s.start(ev.stream_messages(spark, f"{base}/in"), f"{base}/ckpt", available_now=True).awaitTermination()

    cut = txns.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    ev.write_messages(txns.where(F.col("ts") <= cut), f"{base}/in")
    arrive()
    ev.write_messages(txns.where(F.col("ts") > cut), f"{base}/in")
    ev.write_messages(txns.where("txn_id like '%7'"), f"{base}/in")            # repeats of old and new rows
    spark.createDataFrame([("not-valid-json",)], "value string").write.mode("append").text(f"{base}/in")
    arrive()
    cols = ("txn_id", "is_cold", "action", "risk_tier", "raw_score", "risk_score", "feature_snapshot")
    assert rows(log.read().select(*cols)) == rows(batch.select(*cols))
    assert history.read().count() == txns.count()
    dead = scorer.read_dead_letters(spark, f"{base}/dead").collect()
    assert [(r.event, r.reason) for r in dead] == [("not-valid-json", "not a JSON object")]


def stream_parts(spark, fitted, base):
    return scorer.Scorer(dl.EventHistory(spark, f"{base}/h", "month"), dl.DecisionLog(spark, f"{base}/l", "month"), fitted.models, LOW,
                         f"{base}/dead", f"{base}/stats", now=lambda: NOW)


def test_one_poison_row_leaves_all_other_decisions(spark, fitted, tmp_path):
    txns = views.txn(spark, DATA)
    one = txns.agg(F.min("txn_id")).first()[0]
    bad = txns.withColumn("amount", F.when(F.col("txn_id") == one, 1e12).otherwise(F.col("amount")))
    s = stream_parts(spark, fitted, tmp_path)
    s.step(bad.select(ev.encode().alias("event")), 0)
    assert s.log.read().count() == s.history.read().count() == txns.count() - 1
    assert s.log.count(one) == 0
    dead = scorer.read_dead_letters(spark, s.dead_letters).collect()
    assert [(json.loads(r.event)["txn_id"], r.reason, r.retries) for r in dead] == [(one, "amount out of range", 0)]


def test_a_lost_write_fails_the_batch_and_its_repeat_is_whole(spark, fitted, tmp_path):
    s = stream_parts(spark, fitted, tmp_path)
    batch = views.txn(spark, DATA).select(ev.encode().alias("event"))
    append = s.history.append
    s.history.append = lambda rows: (_ for _ in ()).throw(OSError("disk"))
    with pytest.raises(OSError):
        s.step(batch, 7)
    assert scorer.read_dead_letters(spark, s.dead_letters).count() == 0
    s.history.append = append
    s.step(batch, 7)
    n = views.txn(spark, DATA).count()
    counts = spark.read.schema("action string, n long").json(s.stats)
    assert s.log.read().count() == s.history.read().count() == counts.agg(F.sum("n")).first()[0] == n


def test_a_first_batch_of_broken_messages_only(spark, fitted, tmp_path):
    s = stream_parts(spark, fitted, tmp_path)
    s.step(spark.createDataFrame([("nope",)], "event string"), 0)
    assert s.log.read() is None and s.history.read() is None
    good = views.txn(spark, DATA).where("txn_id like '%7'")
    s.step(good.select(ev.encode().alias("event")), 1)
    assert s.log.read().count() == good.count()


def test_errors_of_the_plan_reach_the_query(spark, events, tmp_path):
    s = scorer.Scorer(dl.EventHistory(spark, f"{tmp_path}/h"), dl.DecisionLog(spark, f"{tmp_path}/l"), {}, LOW, f"{tmp_path}/dead")
    with pytest.raises(KeyError):
        s.step(events({}).select(ev.encode().alias("event")), 4)
    assert scorer.read_dead_letters(spark, f"{tmp_path}/dead").count() == 0


def test_only_a_table_never_written_reads_as_absent(spark, tmp_path):
    log = dl.DecisionLog(spark, str(tmp_path / "log"))
    assert log.read() is None
    (tmp_path / "log").mkdir()
    assert log.read() is None               # the first append broke off
    (tmp_path / "log" / "_SUCCESS").touch()
    with pytest.raises(AnalysisException):  # written once, emptied since
        log.read()


def test_no_score_gives_no_action(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.9,), (0.0,)], "s double")
    got = df.select(policy.action(F.col("s"), F.lit(False), LOW)).collect()
    assert [r[0] for r in got] == [None, None, "BLOCK", "ALLOW"]


def test_over_sampling_and_split(spark):
    df = spark.createDataFrame([(i, "Y" if i % 5 == 0 else "N") for i in range(103)], "id long, y string")
    out = ex.oversample(df, "id", "y")
    assert {r.y: r["count"] for r in out.groupBy("y").count().collect()} == {"Y": 82, "N": 82}
    per = out.where("y = 'Y'").groupBy("id").count().agg(F.min("count"), F.max("count")).first()
    assert per[1] - per[0] <= 1
    split = ex.stratified_split(df, "id", "y")
    assert split.where("is_test AND y = 'Y'").count() == 4 and split.where("is_test AND y = 'N'").count() == 16
