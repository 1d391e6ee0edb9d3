"""The 37 features of every event, each seeing only rows before the event.

Three exchanges in all: payer pairs, payer devices and payers share one, then
payees, then devices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.registry import ALL_FEATURES, BASE_FEATURES, MISSING
from ..session import dealt
from .asof import DAY, HOUR, MONTH, Move, Track, closes, flag_hot, hot_keys, neighbours, opens, running, settle
from .median import sliding_median
from .hotmedian import split_median

COLD_BELOW = 3      # payees with fewer earlier rows go to the cold model
PASS_THROUGH = ("txn_id", "ts", "payer_vpa", "payee_vpa", "amount", "label_is_fraud", "label_typology")


def first_per_txn(events: DataFrame) -> DataFrame:
    """One row per txn_id, the earliest; a map-side combined aggregate."""
    rest = F.struct(*[F.col(c) for c in events.columns])
    order = F.struct(F.col("ts"), F.xxhash64(*events.columns))
    return events.groupBy("txn_id").agg(F.min_by(rest, order).alias("e")).select("e.*")


def payer_pairs(rows: DataFrame, hot: str | None = None, width: int = HOUR) -> DataFrame:
    return neighbours(rows, ["payer_vpa", "payee_vpa"], "pair", hot, width)


def payer_devices(rows: DataFrame, hot: str | None = None, width: int = HOUR) -> DataFrame:
    return neighbours(rows, ["payer_vpa", "device_id"], "owner", hot, width)


# Reads of a payer's history: name -> (track, value per row, window).
def _payer_spec() -> dict[str, tuple[Track, Column, int | None]]:
    one = F.lit(1)
    hour = F.col("~hour")
    spec = {
        "payer_n_1h": (Track("payer_n_1h"), one, HOUR),
        "payer_n_24h": (Track("payer_n_24h"), one, DAY),
        "payer_n_30d": (Track("payer_n_30d"), one, MONTH),
        "payer_n": (Track("payer_n"), one, None),
        "payer_sum_30d": (Track("payer_sum_30d", C.TOTAL), C.exact("amount"), MONTH),
        "payer_sq_30d": (Track("payer_sq_30d", C.SQUARES), C.exact_square("amount"), MONTH),
        "payer_collect_30d": (Track("payer_collect_30d"),
                              F.when(F.col("initiation_mode") == "COLLECT_REQUEST", 1).otherwise(0), MONTH),
        "payer_new_30d": (Track("payer_new_30d"), F.when(F.col("pair_n") == 0, 1).otherwise(0), MONTH),
        "payer_last_us": (Track("payer_last_us", "long", "max"), F.col("us"), None),
    }
    for k in C.HALF_DAY:
        spec[f"payer_hour_{k}"] = (Track(f"payer_hour_{k}"), C.hour_sign(k, hour), MONTH)
    return spec


def _payee_spec():
    one = F.lit(1)
    return {
        "payee_n": (Track("payee_n"), one, None),
        "payee_first_us": (Track("payee_first_us", "long", "min"), F.col("us"), None),
        "payee_p2m": (Track("payee_p2m"), F.when(F.col("txn_type") == "P2M", 1).otherwise(0), None),
        "payee_sum": (Track("payee_sum", C.TOTAL), C.exact("amount"), None),
        "payee_sq": (Track("payee_sq", C.SQUARES), C.exact_square("amount"), None),
    }


def _device_spec():
    return {"device_n_1h": (Track("device_n_1h"), F.lit(1), HOUR)}


# Distinct counterparts: name -> (pair history that feeds it, window).
_DISTINCT = {
    "payer": {"payer_payees_24h": ("pair", DAY)},
    "payee": {"payee_payers_1h": ("pair", HOUR), "payee_payers_24h": ("pair", DAY), "payee_payers": ("pair", None)},
    "device": {"device_payers_30d": ("owner", MONTH)},
}
_SPECS = {"payer": _payer_spec, "payee": _payee_spec, "device": _device_spec}
KEYS = {"payer": "payer_vpa", "payee": "payee_vpa", "device": "device_id"}


def reads(rows: DataFrame, side: str, wanted: list[str] | None = None,
          hot: str | None = None, width: int = HOUR) -> DataFrame:
    """Add the as-of reads of one side (payer, payee or device) to `rows`.

    Rows flagged `is_probe` read the history without being part of it."""
    spec = {k: v for k, v in _SPECS[side]().items() if wanted is None or k in wanted}
    distinct = {k: v for k, v in _DISTINCT[side].items() if wanted is None or k in wanted}
    real = ~F.col("is_probe") if "is_probe" in rows.columns else F.lit(True)
    moves = {0: Move(0, {}, real if "is_probe" in rows.columns else None)}

    def move(after: int, counts: bool) -> Move:
        m = moves.setdefault(after, Move(after, {}, F.lit(False)))
        if counts:
            m.where = real
        return m

    tracks = []
    for name, (track, value, window) in spec.items():
        tracks.append(track)
        moves[0].changes[name] = value
        if window is not None:
            move(window, True).changes[name] = -value
    for name, (pair, window) in distinct.items():
        tracks.append(Track(name))
        # beyond the rows at hand a counterpart may be known from carried totals
        fresh = window is None and f"{pair}_fresh" in rows.columns
        moves[0].changes[name] = F.col(f"{pair}_fresh").cast("long") if fresh else opens(f"{pair}_gap_prev", window)
        if window is not None:
            m = move(window, False)
            ends = closes(f"{pair}_gap_next", window)
            m.changes[name] = F.when(ends, -1)
            m.where = m.where | (real & ends)
    if side == "payer":
        rows = rows.withColumn("~hour", F.hour("ts"))       # once per row, for all that count hours
    return running(rows, [KEYS[side]], tracks, list(moves.values()), hot, width).drop("~hour")


def payer_summary(rows: DataFrame) -> DataFrame:
    """Fold the payer's running sums into mean, deviation and hour gap."""
    n, hours = F.col("payer_n_30d"), [f"payer_hour_{k}" for k in C.HALF_DAY]
    return rows.select(
        *[c for c in rows.columns if c not in (*hours, "payer_sum_30d", "payer_sq_30d")],
        C.mean(F.col("payer_sum_30d"), n).alias("payer_mean_30d"),
        C.std(F.col("payer_sum_30d"), F.col("payer_sq_30d"), n).alias("payer_std_30d"),
        F.when(n > 0, C.hour_deviation(F.hour("ts"), [F.col(h) for h in hours])).alias("payer_hour_gap"))


def payee_summary(rows: DataFrame) -> DataFrame:
    n = F.col("payee_n")
    return rows.select(
        *[c for c in rows.columns if c not in ("payee_sum", "payee_sq")],
        C.mean(F.col("payee_sum"), n).alias("payee_mean"),
        C.std(F.col("payee_sum"), F.col("payee_sq"), n).alias("payee_std"))


def feature_columns(cold_below: int = COLD_BELOW) -> dict[str, Column]:
    """Each base feature from the as-of reads; NULL where it is missing."""
    c = F.col
    n30, seen, spread = c("payer_n_30d"), c("payee_n") > 0, c("payer_std_30d")
    since_first = (c("us") - c("payee_first_us")) / 3.6e9
    return {
        "amount_log": F.log1p("amount"),
        "hour_of_day": F.hour("ts"),
        "is_night": C.is_night("ts"),
        "day_of_week": F.weekday("ts"),
        "is_collect_request": c("initiation_mode") == "COLLECT_REQUEST",
        "is_p2p": c("txn_type") == "P2P",
        "amount_roundness": C.roundness("amount"),
        "payer_account_age_days": c("payer_account_age_days"),
        "amount_zscore_vs_payer_30d": F.when(
            (n30 >= 2) & (spread > 0), (c("amount") - c("payer_mean_30d")) / spread),
        "amount_ratio_to_payer_median": F.when(c("payer_median_30d") != 0, c("amount") / c("payer_median_30d")),
        "payer_txn_count_1h": c("payer_n_1h"),
        "payer_txn_count_24h": c("payer_n_24h"),
        "payer_txn_count_30d": n30,
        "payer_distinct_payees_24h": c("payer_payees_24h"),
        "seconds_since_payer_last_txn": (c("us") - c("payer_last_us")) / 1e6,
        "hour_deviation_from_payer_normal": c("payer_hour_gap"),
        "payer_new_payee_rate_30d": F.when(n30 > 0, c("payer_new_30d") / n30),
        "payer_collect_request_rate_30d": F.when(n30 > 0, c("payer_collect_30d") / n30),
        "is_first_ever_txn_by_payer": c("payer_n") == 0,
        "payee_age_hours_in_system": F.coalesce(since_first, F.lit(0.0)),
        "payee_total_txn_count": c("payee_n"),
        "payee_is_unseen": ~seen,
        "payee_handle_digit_ratio": C.digit_ratio("payee_vpa"),
        "payee_handle_entropy": C.entropy("payee_vpa"),
        "payee_handle_has_dictionary_name": C.has_name("payee_vpa"),
        "payee_distinct_payers_1h": F.when(seen, c("payee_payers_1h")),
        "payee_distinct_payers_24h": F.when(seen, c("payee_payers_24h")),
        "payee_distinct_payers_since_first_seen": F.when(seen, c("payee_payers")),
        "payee_fanin_velocity": F.when(seen, c("payee_payers") / F.greatest(F.lit(1.0), since_first)),
        "payee_amount_mean": c("payee_mean"),
        "payee_amount_std": F.when(c("payee_n") >= 2, c("payee_std")),
        "payee_p2m_ratio": F.when(c("payee_n") >= 2, c("payee_p2m") / c("payee_n")),
        "payer_payee_txn_count": c("pair_n"),
        "days_since_payer_last_paid_payee": (c("us") - c("pair_last_us")) / 8.64e10,
        "device_distinct_payers_30d": c("device_payers_30d"),
        "device_txn_count_1h": c("device_n_1h"),
        "is_new_device_for_payer": c("owner_n") == 0,
    }


def with_flags(base: dict[str, Column]) -> list[Column]:
    """All feature columns in contract order, gap-prone ones with their flag."""
    out = []
    for name in ALL_FEATURES:
        if name in base:
            out.append(base[name].alias(name))
        else:
            out.append(base[name.removesuffix(MISSING)].isNull().alias(name))
    return out


@dataclass(frozen=True)
class Carried:
    """Totals of everything before a moment that lies a full window before the rows to be read. `payers` and `payees` have
    a row per key asked for, `pairs` and `owners` one per pair of such a key."""
    payers: DataFrame
    payees: DataFrame
    pairs: DataFrame
    owners: DataFrame


def _add_pairs(rows: DataFrame, name: str, key: list[str], totals: DataFrame) -> DataFrame:
    """Add carried totals to what `neighbours` found. Gaps stay those among the rows at hand: windows end there."""
    old = totals.select(*key, F.col("n").alias("~old_n"), F.col("last_us").alias("~old_last"))
    return rows.join(old, key, "left").withColumns({
        f"{name}_fresh": F.col(f"{name}_gap_prev").isNull() & F.col("~old_n").isNull(),
        f"{name}_n": F.col(f"{name}_n") + F.coalesce("~old_n", F.lit(0)),
        f"{name}_last_us": F.greatest(f"{name}_last_us", "~old_last")}).drop("~old_n", "~old_last")


def _add_payers(rows: DataFrame, totals: DataFrame) -> DataFrame:
    old = totals.select("payer_vpa", F.col("n").alias("~n"), F.col("last_us").alias("~last"))
    return rows.join(old, "payer_vpa", "left").withColumns({
        "payer_n": F.col("payer_n") + F.coalesce("~n", F.lit(0)), "payer_last_us": F.greatest("payer_last_us", "~last")}).drop("~n", "~last")


def _add_payees(rows: DataFrame, totals: DataFrame) -> DataFrame:
    names = ("n", "p2m", "payers", "total", "squares")
    old = totals.select("payee_vpa", F.col("first_us").alias("~first_us"), *[F.col(c).alias(f"~{c}") for c in names])
    sums = {mine: (F.col(mine) + F.coalesce(F.col(f"~{c}"), F.lit(0))).cast(kind) for mine, c, kind in (
        ("payee_n", "n", "long"), ("payee_p2m", "p2m", "long"), ("payee_payers", "payers", "long"), ("payee_sum", "total", C.TOTAL),
        ("payee_sq", "squares", C.SQUARES))}
    rows = rows.join(old, "payee_vpa", "left").withColumns({**sums, "payee_first_us": F.least("payee_first_us", "~first_us")})
    return rows.drop("~first_us", *[f"~{c}" for c in names])


def histories(events: DataFrame, hot: dict[str, list] | None = None, width: int = HOUR,
              carried: Carried | None = None) -> DataFrame:
    """Every as-of read of every event. `hot` maps key columns to keys that are
    split into time slices; by default it is measured. With `carried`, reads of
    rows a full window after its moment count what lies before it as well."""
    total = events.count()
    hot = hot_keys(events, total=total) if hot is None else hot
    flags = {c: f"hot_{c}" for c, keys in hot.items() if keys}
    rows = events.withColumn("us", C.micros("ts"))
    for column, flag in flags.items():
        rows = flag_hot(rows, column, hot[column], flag)
    payer, payee, device = (flags.get(KEYS[s]) for s in ("payer", "payee", "device"))
    if not payer:
        rows = dealt(rows, total, "payer_vpa")
    rows = payer_pairs(settle(rows, payer), payer, width)
    if carried:
        rows = _add_pairs(rows, "pair", ["payer_vpa", "payee_vpa"], carried.pairs)
    rows = payer_devices(settle(rows, payer), payer, width)
    if carried:
        rows = _add_pairs(rows, "owner", ["payer_vpa", "device_id"], carried.owners)
    rows = payer_summary(reads(settle(rows, payer), "payer", hot=payer, width=width))
    if carried:
        rows = _add_payers(rows, carried.payers)
    if payer:
        rows = split_median(settle(rows, payer), "payer_vpa", "amount", MONTH, "payer_median_30d", payer, width)
    else:
        rows = sliding_median(rows, "payer_vpa", "amount", MONTH, "payer_median_30d")
    rows = settle(rows, payee) if payee else dealt(rows, total, "payee_vpa")
    rows = reads(rows, "payee", hot=payee, width=width)
    rows = payee_summary(_add_payees(rows, carried.payees) if carried else rows)
    rows = rows.drop("pair_gap_prev", "pair_gap_next")
    rows = settle(rows, device) if device else dealt(rows, total, "device_id")
    rows = reads(rows, "device", hot=device, width=width)
    return rows.drop(*flags.values())


def point_in_time(events: DataFrame, cold_below: int = COLD_BELOW, hot: dict[str, list] | None = None,
                  width: int = HOUR, only: str | None = None, carried: Carried | None = None) -> DataFrame:
    """txn_id, time, parties, amount, labels, `is_cold` and the 51 features; of
    the rows where the column `only` is true, if it is named.

    Row order does not matter: a row sees only rows with an earlier timestamp."""
    keep = [c for c in PASS_THROUGH if c in events.columns]
    rows = histories(events, hot, width, carried)
    return (rows.where(only) if only else rows).select(
        *keep, (F.col("payee_n") < cold_below).alias("is_cold"), *with_flags(feature_columns()))


def since(features: DataFrame, start) -> DataFrame:
    """The slice to score after a warm-up over everything before it."""
    return features.where(F.col("ts") >= F.lit(start))


def cold_flags(events: DataFrame, cold_below: int = COLD_BELOW, hot: dict[str, list] | None = None) -> DataFrame:
    hot = hot_keys(events, ("payee_vpa",)) if hot is None else hot
    rows, flag = events.withColumn("us", C.micros("ts")), None
    if hot.get("payee_vpa"):
        flag = "hot_payee_vpa"
        rows = settle(flag_hot(rows, "payee_vpa", hot["payee_vpa"], flag), flag)
    return reads(rows, "payee", ["payee_n"], flag).select("txn_id", (F.col("payee_n") < cold_below).alias("is_cold"))
