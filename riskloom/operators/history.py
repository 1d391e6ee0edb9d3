"""The as-of history reads, one per question asked of a key's past.

Each works on every event (`probes=None`) or on a separate table of probes with
`txn_id`, `ts` and the key columns; probes read the history but are not in it.
`hot` names the keys that are split over time slices; by default it is measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .asof import HOUR, MONTH, Move, Track, flag_hot, hot_keys, running, settle
from .features import KEYS, payer_devices, payer_pairs, reads
from .hotmedian import split_median
from .median import sliding_median


def _rows(events: DataFrame, probes: DataFrame | None, key: str, pairs=False, owners=False,
          hot: dict | None = None, width: int = HOUR) -> tuple[DataFrame, str | None]:
    """History and probe rows, and the name of the key's hot flag if it has one."""
    columns = tuple(dict.fromkeys([key, *(["payer_vpa"] if pairs or owners else [])]))
    hot = hot_keys(events, columns) if hot is None else hot
    flags = {c: f"hot_{c}" for c in columns if hot.get(c)}
    rows = events.withColumn("us", C.micros("ts"))
    for c, flag in flags.items():
        rows = flag_hot(rows, c, hot[c], flag)
    payer = flags.get("payer_vpa")
    if pairs:
        rows = payer_pairs(settle(rows, payer), payer, width)
    if owners:
        rows = payer_devices(settle(rows, payer), payer, width)
    if probes is not None:
        asked = probes.withColumn("us", C.micros("ts")).withColumn("is_probe", F.lit(True))
        for c, flag in flags.items():
            if c in probes.columns:
                asked = flag_hot(asked, c, hot[c], flag)
        rows = rows.withColumn("is_probe", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    return settle(rows, flags.get(key)), flags.get(key)


def _answers(df: DataFrame, *cols) -> DataFrame:
    if "is_probe" in df.columns:
        df = df.where("is_probe")
    return df.select("txn_id", *cols)


def _read(events, probes, side, names, pairs=False, owners=False, hot=None, width=HOUR) -> DataFrame:
    rows, flag = _rows(events, probes, KEYS[side], pairs, owners, hot, width)
    return reads(rows, side, names, flag, width)


def _stats(events, probes, side, names, window, hot, width) -> DataFrame:
    n, s, q = (F.col(c) for c in names)
    key = KEYS[side]
    rows, flag = _rows(events, probes, key, hot=hot, width=width)
    df = reads(rows, side, list(names), flag, width)
    if flag:
        df = split_median(settle(df, flag), key, "amount", window, "median", flag, width)
    else:
        df = sliding_median(df, key, "amount", window, "median")
    return _answers(df, n.alias("n"), C.mean(s, n).alias("mean"), C.std(s, q, n).alias("std"), "median")


def payer_txn_count(events, probes=None, **kw):
    names = ["payer_n_1h", "payer_n_24h", "payer_n_30d", "payer_n"]
    return _answers(_read(events, probes, "payer", names, **kw), *names)


def payer_distinct_payees(events, probes=None, **kw):
    return _answers(_read(events, probes, "payer", ["payer_payees_24h"], pairs=True, **kw), "payer_payees_24h")


def payer_last_txn(events, probes=None, hot=None, width=HOUR):
    last = Track("last", "struct<us:bigint,txn_id:string,amount:double,payee_vpa:string>", "max")
    rows, flag = _rows(events, probes, "payer_vpa", hot=hot, width=width)
    real = ~F.col("is_probe") if probes is not None else None
    df = running(rows, ["payer_vpa"], [last],
                 [Move(0, {"last": F.struct("us", "txn_id", "amount", "payee_vpa")}, real)], flag, width)
    return _answers(df, F.timestamp_micros("last.us").alias("last_ts"), F.col("last.amount").alias("last_amount"),
                    F.col("last.payee_vpa").alias("last_payee"))


def payer_amount_stats(events, probes=None, hot=None, width=HOUR):
    return _stats(events, probes, "payer", ("payer_n_30d", "payer_sum_30d", "payer_sq_30d"), MONTH, hot, width)


def payer_hour_histogram(events, probes=None, hot=None, width=HOUR):
    """Counts per hour of day over 30 days, one column per hour."""
    tracks = [Track(f"h{k:02d}") for k in range(24)]
    hits = {t.name: F.when(F.hour("ts") == k, 1).otherwise(0) for k, t in enumerate(tracks)}
    rows, flag = _rows(events, probes, "payer_vpa", hot=hot, width=width)
    real = ~F.col("is_probe") if probes is not None else F.lit(True)
    df = running(rows, ["payer_vpa"], tracks,
                 [Move(0, hits, real), Move(MONTH, {k: -v for k, v in hits.items()}, real)], flag, width)
    return _answers(df, *[t.name for t in tracks])


def payer_new_payee_ratio(events, probes=None, **kw):
    df = _read(events, probes, "payer", ["payer_n_30d", "payer_new_30d"], pairs=True, **kw)
    return _answers(df, "payer_new_30d", "payer_n_30d")


def payer_collect_ratio(events, probes=None, **kw):
    names = ["payer_collect_30d", "payer_n_30d"]
    return _answers(_read(events, probes, "payer", names, **kw), *names)


def payee_txn_count(events, probes=None, **kw):
    return _answers(_read(events, probes, "payee", ["payee_n"], **kw), "payee_n")


def payee_first_seen(events, probes=None, **kw):
    df = _read(events, probes, "payee", ["payee_first_us"], **kw)
    return _answers(df, F.timestamp_micros("payee_first_us").alias("first_seen"))


def payee_distinct_payers(events, probes=None, **kw):
    names = ["payee_payers_1h", "payee_payers_24h", "payee_payers"]
    return _answers(_read(events, probes, "payee", names, pairs=True, **kw), *names)


def payee_amount_stats(events, probes=None, hot=None, width=HOUR):
    return _stats(events, probes, "payee", ("payee_n", "payee_sum", "payee_sq"), None, hot, width)


def payee_p2m(events, probes=None, **kw):
    """P2M rows and all rows of the payee; both NULL for an unseen payee."""
    df = _read(events, probes, "payee", ["payee_n", "payee_p2m"], **kw)
    seen = F.col("payee_n") > 0
    return _answers(df, F.when(seen, F.col("payee_p2m")).alias("p2m"), F.when(seen, F.col("payee_n")).alias("total"))


def pair_history(events, probes=None, key=("payer_vpa", "payee_vpa"), hot=None, width=HOUR):
    """Earlier rows of a key pair (`n`) and the time of the last one (`last_us`)."""
    rows, flag = _rows(events, probes, "payer_vpa", hot=hot, width=width)
    real = ~F.col("is_probe") if probes is not None else None
    return running(rows, list(key), [Track("n"), Track("last_us", "long", "max")],
                   [Move(0, {"n": F.lit(1), "last_us": F.col("us")}, real)], flag, width)


def pair_txn_count(events, probes=None, **kw):
    return _answers(pair_history(events, probes, **kw), "n")


def pair_last_txn_time(events, probes=None, **kw):
    return _answers(pair_history(events, probes, **kw), F.timestamp_micros("last_us").alias("last_ts"))


def device_distinct_payers(events, probes=None, **kw):
    return _answers(_read(events, probes, "device", ["device_payers_30d"], owners=True, **kw), "device_payers_30d")


def device_txn_count(events, probes=None, **kw):
    return _answers(_read(events, probes, "device", ["device_n_1h"], **kw), "device_n_1h")


def device_seen_for_payer(events, probes=None, **kw):
    df = pair_history(events, probes, ("payer_vpa", "device_id"), **kw)
    return _answers(df, (F.col("n") > 0).alias("seen"))


def max_rolling_payers(events, window=C.DAY, hot=None, width=HOUR) -> DataFrame:
    """Per payee, the most distinct payers in any trailing window, the window's
    last moment included."""
    rows, flag = _rows(events, None, "payee_vpa", pairs=True, hot=hot, width=width)
    gap = F.col("pair_gap_prev")
    ends = F.col("pair_gap_next").isNull() | (F.col("pair_gap_next") > window)
    starts = F.when(gap.isNull() | (gap > window), 1).otherwise(0)
    # changes that count at their own moment take effect one microsecond early
    df = running(rows, ["payee_vpa"], [Track("d")],
                 [Move(0, {}), Move(-1, {"d": starts}), Move(window, {"d": F.lit(-1)}, ends)], flag, width)
    return df.groupBy("payee_vpa").agg(F.max("d").alias("most_payers"))
