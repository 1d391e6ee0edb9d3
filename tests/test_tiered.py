"""The tiered history against the whole history: same features, reading that does not grow with age."""

import os
import random
from datetime import datetime, timedelta, timezone
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from riskloom.functions.registry import ALL_FEATURES
from riskloom.operators import features as ft
from riskloom.plans import scoring
from riskloom.schema import EVENT
from riskloom.sources import decision_log as dl
from riskloom.sources import events as ev
from riskloom.sources.tiered import TieredHistory
from riskloom.streaming import scorer

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
DAY = 24 * 60


def rows(df):
    return sorted(map(str, df.collect()))


def made(n, days, seed, first=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        # some moments are shared, some parties are rare
        at = r.choice([r.randrange(days * DAY), r.randrange(days) * DAY])
        out.append(dict(txn_id=f"t{first + i:05d}", at=at, payer_vpa=f"u{min(r.randrange(12), r.randrange(40))}@b", payee_vpa=f"m{r.randrange(9)}@y",
                        device_id=f"d{r.randrange(10)}", amount=r.randrange(1, 9_000_000) / 1000, txn_type=r.choice(["P2P", "P2M"]),
                        initiation_mode=r.choice(["INTENT", "COLLECT_REQUEST"])))
    return out


def opened(df):
    """Bytes of the files that a frame reads, once pruned."""
    files = {x[0] for x in df.select(F.input_file_name()).distinct().collect()}
    return sum(os.path.getsize(unquote(urlparse(f).path)) for f in files if f)


def test_batches_read_flat_and_equal_the_whole_history(spark, events, tmp_path):
    all_rows = made(700, 240, 3)
    # rows that come after their moment, some of them before every kept snapshot
    late = {"t00011": 7, "t00042": 5, "t00043": 7}
    batch_of = lambda x: late.get(x["txn_id"], x["at"] // (30 * DAY))
    history = TieredHistory(spark, str(tmp_path), rows_per_bucket=3, grain="month")
    read, seen = [], []
    earliest = lambda xs: T0 + timedelta(minutes=min(x["at"] for x in xs))
    for k in range(8):
        now = [x for x in all_rows if batch_of(x) == k]
        for mine in ([x for x in now if x["txn_id"] not in late], [x for x in now if x["txn_id"] in late]):
            if not mine:
                continue
            part = events(*mine)
            seen += mine
            base = history.base_for(earliest(mine))
            if k in (5, 7):
                got = scoring.features_from(part, history, base)
                want = ft.point_in_time(events(*seen)).join(part.select("txn_id"), "txn_id", "left_semi")
                assert rows(got.select("txn_id", "is_cold", *ALL_FEATURES)) == rows(want.select("txn_id", "is_cold", *ALL_FEATURES))
            if len(mine) > 3 and base:
                read.append(opened(history.since(base)))
                few = part.limit(1).select("payer_vpa")
                assert opened(history.totals(base, "pairs", few)) <= opened(history.totals(base, "pairs"))
            history.append(part, base, f"b{k}")
            history.append(part, base, f"b{k}")                   # a repeat adds nothing
            history.roll_if_due(T0 + timedelta(minutes=max(x["at"] for x in mine)))
    assert history.read().count() == len(all_rows)
    assert len(history.bases()) >= 5 and len(read) >= 5
    # from the first snapshots to the last, what a batch opens stays level while the table grows
    assert max(read[3:]) < 1.4 * max(read[:3]) and max(read) < 0.5 * opened(history.read())


def test_totals_of_a_snapshot(spark, events, tmp_path):
    data = made(400, 100, 5)
    history = TieredHistory(spark, str(tmp_path), grain="month")
    history.append(events(*data))
    history.roll(T0 + timedelta(days=40))
    more = made(30, 20, 6, first=1000)
    history.append(events(*more))                              # late: before the snapshot that does not hold them
    base = history.roll(T0 + timedelta(days=70))
    with pytest.raises(ValueError):
        history.roll(T0 + timedelta(days=70))
    plain = events(*[x for x in data + more if x["at"] < 70 * DAY])
    us = F.unix_micros("ts")
    want = plain.groupBy("payee_vpa").agg(F.count("*").alias("n"), F.min(us).alias("first_us"), F.count_if(F.col("txn_type") == "P2M").alias("p2m"),
                                          F.countDistinct("payer_vpa").alias("payers"), F.sum(F.col("amount").cast("decimal(15,6)")).alias("total"))
    assert rows(history.totals(base, "payees").select(*want.columns)) == rows(want)
    for side, key in (("payers", ["payer_vpa"]), ("pairs", ["payer_vpa", "payee_vpa"]), ("owners", ["payer_vpa", "device_id"])):
        want = plain.groupBy(*key).agg(F.count("*").alias("n"), F.max(us).alias("last_us"))
        assert rows(history.totals(base, side).select(*want.columns)) == rows(want)


@pytest.fixture(scope="module")
def models(spark):
    from riskloom.plans import training
    from riskloom.sources import testviews as views
    from conftest import DATA
    return training.fit(ft.point_in_time(views.txn(spark, DATA)), (0, 19), (20, 24), (25, None), trees=3, min_positives=1, check_leaks=False).models


def test_scorer_over_a_tiered_history(spark, events, models, tmp_path):
    """Stream against batch over 120 days, with repeats and a batch that breaks off between the two tables."""
    low = {r: {"t_warn": 0.05, "t_review": 0.2, "t_block": 0.5} for r in ("cold", "warm")}
    data = made(250, 120, 9)
    s = scorer.Scorer(TieredHistory(spark, f"{tmp_path}/h", every_days=15, grain="month"), dl.DecisionLog(spark, f"{tmp_path}/l"), models, low,
                      f"{tmp_path}/dead", f"{tmp_path}/stats")
    message = lambda xs: events(*xs).select(ev.encode().alias("event"))
    for k in range(3):
        mine = [x for x in data if x["at"] // (40 * DAY) == k]
        again = [x for x in data if x["at"] // (40 * DAY) == k - 1][:20]
        if k == 2:
            append = s.history.append
            s.history.append = lambda *a: (_ for _ in ()).throw(OSError("disk"))
            with pytest.raises(OSError):
                s.step(message(mine + again), k)
            s.history.append = append
        s.step(message(mine + again), k)
    assert s.history.bases()
    want = scoring.replay(events(*data), models, low, None, T0)
    cols = ("txn_id", "is_cold", "action", "risk_tier", "raw_score", "risk_score", "feature_snapshot")
    assert rows(s.log.read().select(*cols)) == rows(want.select(*cols))
    assert rows(s.history.read().select(*EVENT.names)) == rows(events(*data))
    counts = spark.read.schema("action string, n long").json(s.stats).agg(F.sum("n")).first()[0]
    assert counts == len(data)
