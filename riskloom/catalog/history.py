"""Registered history reads and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.registry import ALL_FEATURES, BASE, COLD_FEATURES, MISSING
from ..functions.columns import HANDLE_NAMES
from ..operators import features as feats
from ..operators.asof import hot_keys
from ..operators import history as h
from ..sources import testviews as views
from .shared import TIES, TXN, big, r, tidy

H1, D1, M1 = 3_600_000_000, 86_400_000_000, 2_592_000_000_000


def over(key: str, width: int | None = None) -> str:
    low = "UNBOUNDED" if width is None else str(width)
    return f"OVER (PARTITION BY {key} ORDER BY us RANGE BETWEEN {low} PRECEDING AND 1 PRECEDING)"


P, Y, DV = "payer_vpa", "payee_vpa", "device_id"
PAIR, OWN = "payer_vpa, payee_vpa", "payer_vpa, device_id"


def mean(w: str) -> str:
    return f"CAST(sum(x) {w} AS DOUBLE) / nullif(count(*) {w}, 0)"


def _sql(cols: str, source: str = TXN) -> str:
    return f"WITH {source} SELECT txn_id, {cols} FROM txn"


def stats(w: str, digits: int = 6) -> str:
    return (f"count(*) {w} AS n, {r(mean(w), digits)} AS mean, {r(f'stddev_pop(amount) {w}', digits)} AS std, "
            f"{r(f'quantile_cont(amount, 0.5) {w}', digits)} AS median")


READS = {
    "payer_txn_count": (h.payer_txn_count, ", ".join(
        f"count(*) {over(P, w)} AS {n}" for n, w in
        [("payer_n_1h", H1), ("payer_n_24h", D1), ("payer_n_30d", M1), ("payer_n", None)])),
    "payer_distinct_payees": (h.payer_distinct_payees,
                              f"count(DISTINCT payee_vpa) {over(P, D1)} AS payer_payees_24h"),
    "payer_amount_stats": (h.payer_amount_stats, stats(over(P, M1))),
    "payer_hour_histogram": (h.payer_hour_histogram, ", ".join(
        f"count(*) FILTER (WHERE hour(ts) = {k}) {over(P, M1)} AS h{k:02d}" for k in range(24))),
    "payer_collect_ratio": (h.payer_collect_ratio,
                            f"count(*) FILTER (WHERE initiation_mode = 'COLLECT_REQUEST') {over(P, M1)}"
                            f" AS payer_collect_30d, count(*) {over(P, M1)} AS payer_n_30d"),
    "payee_txn_count": (h.payee_txn_count, f"count(*) {over(Y)} AS payee_n"),
    "payee_first_seen": (h.payee_first_seen, f"min(ts) {over(Y)} AS first_seen"),
    "payee_distinct_payers": (h.payee_distinct_payers, ", ".join(
        f"count(DISTINCT payer_vpa) {over(Y, w)} AS {n}" for n, w in
        [("payee_payers_1h", H1), ("payee_payers_24h", D1), ("payee_payers", None)])),
    "payee_amount_stats": (h.payee_amount_stats, stats(over(Y))),
    "payee_p2m": (h.payee_p2m,
                  f"CASE WHEN count(*) {over(Y)} > 0 THEN count(*) FILTER (WHERE txn_type = 'P2M') {over(Y)} END"
                  f" AS p2m, nullif(count(*) {over(Y)}, 0) AS total"),
    "pair_txn_count": (h.pair_txn_count, f"count(*) {over(PAIR)} AS n"),
    "pair_last_txn_time": (h.pair_last_txn_time, f"max(ts) {over(PAIR)} AS last_ts"),
    "device_distinct_payers": (h.device_distinct_payers,
                               f"count(DISTINCT payer_vpa) {over(DV, M1)} AS device_payers_30d"),
    "device_txn_count": (h.device_txn_count, f"count(*) {over(DV, H1)} AS device_n_1h"),
    "device_seen_for_payer": (h.device_seen_for_payer, f"count(*) {over(OWN)} > 0 AS seen"),
}

NEW_PAYEE = f"""WITH {{source}}, flagged AS (
  SELECT *, us = min(us) OVER (PARTITION BY payer_vpa, payee_vpa) AS fresh FROM txn)
SELECT txn_id, count(*) FILTER (WHERE fresh) {over(P, M1)} AS payer_new_30d,
       count(*) {over(P, M1)} AS payer_n_30d FROM flagged"""

LAST_TXN = f"""WITH {{source}}, last AS (
  SELECT txn_id, max(struct_pack(us := us, txn_id := txn_id, ts := ts, amount := amount, payee_vpa := payee_vpa))
         {over(P)} AS l FROM txn)
SELECT txn_id, l.ts AS last_ts, {r('l.amount')} AS last_amount, l.payee_vpa AS last_payee FROM last"""

# Probes: the last moment of every day per key, asked of the history.
PROBES = """probes AS (
  SELECT DISTINCT concat({key}, '|', CAST(CAST(ts AS DATE) AS VARCHAR)) AS txn_id, {key},
         date_trunc('day', ts) + INTERVAL 1 DAY AS ts FROM txn)"""


def _probes(events, key):
    day = F.date_trunc("day", "ts")
    return (events.select(F.concat_ws("|", key, day.cast("date").cast("string")).alias("txn_id"), key,
                          (day + F.expr("INTERVAL 1 DAY")).alias("ts")).distinct())


def payer_probe(spark, d):
    ev = views.txn(spark, d)
    asked = _probes(ev, "payer_vpa")
    a = h.payer_amount_stats(ev, asked)
    b = h.payer_distinct_payees(ev, asked)
    return a.join(b, "txn_id")


PAYER_PROBE = f"""WITH {TXN}, {PROBES.format(key='payer_vpa')}
SELECT p.txn_id, count(t.txn_id) FILTER (WHERE t.ts >= p.ts - INTERVAL 30 DAY) AS n,
  {r("CAST(sum(t.x) FILTER (WHERE t.ts >= p.ts - INTERVAL 30 DAY) AS DOUBLE) / nullif(count(t.txn_id) FILTER (WHERE t.ts >= p.ts - INTERVAL 30 DAY), 0)")} AS mean,
  {r("stddev_pop(t.amount) FILTER (WHERE t.ts >= p.ts - INTERVAL 30 DAY)")} AS std,
  {r("quantile_cont(t.amount, 0.5) FILTER (WHERE t.ts >= p.ts - INTERVAL 30 DAY)")} AS median,
  count(DISTINCT t.payee_vpa) FILTER (WHERE t.ts >= p.ts - INTERVAL 1 DAY) AS payer_payees_24h
FROM probes p LEFT JOIN txn t ON t.payer_vpa = p.payer_vpa AND t.ts < p.ts GROUP BY p.txn_id"""


def payee_probe(spark, d):
    ev = views.txn(spark, d)
    asked = _probes(ev, "payee_vpa")
    return h.payee_distinct_payers(ev, asked).join(h.payee_first_seen(ev, asked), "txn_id")


PAYEE_PROBE = f"""WITH {TXN}, {PROBES.format(key='payee_vpa')}
SELECT p.txn_id, count(DISTINCT t.payer_vpa) FILTER (WHERE t.ts >= p.ts - INTERVAL 1 HOUR) AS payee_payers_1h,
  count(DISTINCT t.payer_vpa) FILTER (WHERE t.ts >= p.ts - INTERVAL 1 DAY) AS payee_payers_24h,
  count(DISTINCT t.payer_vpa) AS payee_payers, min(t.ts) AS first_seen
FROM probes p LEFT JOIN txn t ON t.payee_vpa = p.payee_vpa AND t.ts < p.ts GROUP BY p.txn_id"""

# --- features -----------------------------------------------------------------
_names = "|".join(HANDLE_NAMES)
_hours = [f"(count(*) FILTER (WHERE hour(ts) = {k}) {over(P, M1)} - count(*) FILTER (WHERE hour(ts) = {k + 12}) {over(P, M1)})"
          for k in range(12)]


def _circular(fn: str) -> str:
    import math
    f = {"sin": math.sin, "cos": math.cos}[fn]
    return " + ".join(["CAST(0 AS DOUBLE)"] + [f"h{k} * CAST('{f(2 * math.pi * k / 24)!r}' AS DOUBLE)" for k in range(12)])


KNOWN = f"""known AS (
  SELECT *, min(us) OVER (PARTITION BY payer_vpa, payee_vpa) AS pair_first,
    count(*) {over(P, H1)} AS p1, count(*) {over(P, D1)} AS p24, count(*) {over(P, M1)} AS p30, count(*) {over(P)} AS pall,
    count(DISTINCT payee_vpa) {over(P, D1)} AS pd24, max(us) {over(P)} AS plast,
    {mean(over(P, M1))} AS pmean, stddev_pop(amount) {over(P, M1)} AS pstd,
    quantile_cont(amount, 0.5) {over(P, M1)} AS pmed,
    count(*) FILTER (WHERE initiation_mode = 'COLLECT_REQUEST') {over(P, M1)} AS pcol,
    {', '.join(f'{e} AS h{k}' for k, e in enumerate(_hours))},
    count(*) {over(Y)} AS yn, min(us) {over(Y)} AS yfirst, count(DISTINCT payer_vpa) {over(Y, H1)} AS yd1,
    count(DISTINCT payer_vpa) {over(Y, D1)} AS yd24, count(DISTINCT payer_vpa) {over(Y)} AS yd,
    {mean(over(Y))} AS ymean, stddev_pop(amount) {over(Y)} AS ystd,
    count(*) FILTER (WHERE txn_type = 'P2M') {over(Y)} AS yp2m,
    count(*) {over(PAIR)} AS pairn, max(us) {over(PAIR)} AS pairlast, count(*) {over(OWN)} AS ownn,
    count(DISTINCT payer_vpa) {over(DV, M1)} AS dd30, count(*) {over(DV, H1)} AS dn1
  FROM txn),
handles AS (
  SELECT payee_vpa, any_value(local) AS local, -sum((n / total) * log2(n / total)) AS entropy FROM (
    SELECT payee_vpa, local, c, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY payee_vpa)::DOUBLE AS total
    FROM (SELECT DISTINCT payee_vpa, split_part(payee_vpa, '@', 1) AS local FROM txn) a,
         unnest(string_split(local, '')) AS u(c) GROUP BY 1, 2, 3) b GROUP BY 1),
wide AS (
  SELECT *, count(*) FILTER (WHERE us = pair_first) {over(P, M1)} AS pnew, {_circular('sin')} AS ss, {_circular('cos')} AS cc
  FROM known)"""

_gap = "abs(hour(ts) - hh)"
VALUES = {
    "amount_log": "ln(1 + amount)",
    "hour_of_day": big("hour(ts)"),
    "is_night": "hour(ts) >= 23 OR hour(ts) < 5",
    "day_of_week": big("isodow(ts) - 1"),
    "is_collect_request": "initiation_mode = 'COLLECT_REQUEST'",
    "is_p2p": "txn_type = 'P2P'",
    "amount_roundness": "CASE WHEN CAST(round_even(amount * 100, 0) AS BIGINT) % 100000 = 0 THEN 'thousand' "
                        "WHEN CAST(round_even(amount * 100, 0) AS BIGINT) % 10000 = 0 THEN 'hundred' ELSE 'neither' END",
    "payer_account_age_days": big("payer_account_age_days"),
    "amount_zscore_vs_payer_30d": "CASE WHEN p30 >= 2 AND pstd > 1e-9 * abs(pmean) THEN (amount - pmean) / pstd END",
    "amount_ratio_to_payer_median": "CASE WHEN pmed <> 0 THEN amount / pmed END",
    "payer_txn_count_1h": "p1", "payer_txn_count_24h": "p24", "payer_txn_count_30d": "p30",
    "payer_distinct_payees_24h": "pd24",
    "seconds_since_payer_last_txn": "(us - plast) / 1000000.0",
    "hour_deviation_from_payer_normal": f"CASE WHEN p30 > 0 THEN least({_gap}, 24 - {_gap}) END",
    "payer_new_payee_rate_30d": "CASE WHEN p30 > 0 THEN pnew::DOUBLE / p30 END",
    "payer_collect_request_rate_30d": "CASE WHEN p30 > 0 THEN pcol::DOUBLE / p30 END",
    "is_first_ever_txn_by_payer": "pall = 0",
    "payee_age_hours_in_system": "coalesce(age, 0.0)",
    "payee_total_txn_count": "yn", "payee_is_unseen": "yn = 0",
    "payee_handle_digit_ratio": "length(regexp_replace(local, '[^0-9]', '', 'g'))::DOUBLE / length(local)",
    "payee_handle_entropy": "entropy",
    "payee_handle_has_dictionary_name": f"regexp_matches(lower(local), '{_names}')",
    "payee_distinct_payers_1h": "CASE WHEN yn > 0 THEN yd1 END",
    "payee_distinct_payers_24h": "CASE WHEN yn > 0 THEN yd24 END",
    "payee_distinct_payers_since_first_seen": "CASE WHEN yn > 0 THEN yd END",
    "payee_fanin_velocity": "CASE WHEN yn > 0 THEN yd / greatest(1.0, age) END",
    "payee_amount_mean": "ymean",
    "payee_amount_std": "CASE WHEN yn >= 2 THEN ystd END",
    "payee_p2m_ratio": "CASE WHEN yn >= 2 THEN yp2m::DOUBLE / yn END",
    "payer_payee_txn_count": "pairn",
    "days_since_payer_last_paid_payee": "(us - pairlast) / 86400000000.0",
    "device_distinct_payers_30d": "dd30", "device_txn_count_1h": "dn1",
    "is_new_device_for_payer": "ownn = 0",
}
_FLOATS = {"amount_log", "amount_zscore_vs_payer_30d", "amount_ratio_to_payer_median", "seconds_since_payer_last_txn",
           "hour_deviation_from_payer_normal", "payer_new_payee_rate_30d", "payer_collect_request_rate_30d",
           "payee_age_hours_in_system", "payee_handle_digit_ratio", "payee_handle_entropy", "payee_fanin_velocity",
           "payee_amount_mean", "payee_amount_std", "payee_p2m_ratio", "days_since_payer_last_paid_payee"}


def _values(names: list[str], digits: int = 6) -> str:
    out = []
    for n in names:
        base = n.removesuffix(MISSING)
        e = VALUES[base]
        if n != base:
            out.append(f"({e}) IS NULL AS {n}")
        else:
            out.append(f"{r(e, digits) if n in _FLOATS else f'({e})'} AS {n}")
    return ", ".join(out)


def features_cte(source: str = TXN) -> str:
    """WITH-list ending in `feats`: unrounded reads plus everything VALUES needs."""
    return (f"{source}, {KNOWN}, feats AS (SELECT w.*, hd.local, hd.entropy, (us - yfirst) / 3600000000.0 AS age, "
            f"(atan2(ss, cc) / (2 * pi()) * 24 + 48) % 24 AS hh FROM wide w JOIN handles hd USING (payee_vpa))")


def features_sql(names: list[str], source: str = TXN, extra: str = "", digits: int = 6) -> str:
    return f"WITH {features_cte(source)} SELECT txn_id, {extra}{_values(names, digits)} FROM feats"


def _group(letter: str) -> list[str]:
    out = []
    for name, g, _, gaps in BASE:
        if g == letter:
            out += [name, name + MISSING] if gaps else [name]
    return out


def _features(names, view=views.txn, extra=(), digits=6):
    def run(spark, d):
        return tidy(feats.point_in_time(view(spark, d)).select("txn_id", *extra, *names), digits)
    return run


# The *_hot twins call a key hot from a thousandth of the rows on (at most 1,000 keys a column): on small tables all
# payers and devices and the busiest payees, so that split and plain keys are checked side by side.
FORCED_SHARE = 1e-3


def _forced(events):
    return hot_keys(events, min_rows=2, share=FORCED_SHARE)


def _hot_read(fn):
    def run(spark, d):
        events = views.txn(spark, d)
        return tidy(fn(events, hot=_forced(events)))
    return run


def hot_feature_table(spark, d):
    events = views.txn(spark, d)
    return tidy(feats.point_in_time(events, hot=_forced(events)).select("txn_id", "is_cold", *ALL_FEATURES))


def _register():
    q, s = {}, {}
    for name, (fn, cols) in READS.items():
        q[name] = lambda spark, d, fn=fn: tidy(fn(views.txn(spark, d)))
        s[name] = _sql(cols)
        if name in ("payer_txn_count", "payee_distinct_payers", "pair_last_txn_time",
                    "payer_distinct_payees", "device_distinct_payers", "device_seen_for_payer"):
            q[name + "_ties"] = lambda spark, d, fn=fn: tidy(fn(views.txn_ties(spark, d)))
            s[name + "_ties"] = _sql(cols, TIES)
        if name in ("payer_txn_count", "payee_distinct_payers", "payer_amount_stats", "device_distinct_payers"):
            q[name + "_hot"], s[name + "_hot"] = _hot_read(fn), s[name]
    # order totals are five-digit amounts: three decimals are what doubles carry through a deviation
    q["payer_amount_stats_ties"] = lambda spark, d: tidy(h.payer_amount_stats(views.txn_ties(spark, d)), 3)
    s["payer_amount_stats_ties"] = _sql(stats(over(P, M1), 3), TIES)
    for suffix, view, source in (("", views.txn, TXN), ("_ties", views.txn_ties, TIES)):
        q["payer_new_payee_ratio" + suffix] = lambda spark, d, v=view: h.payer_new_payee_ratio(v(spark, d))
        s["payer_new_payee_ratio" + suffix] = NEW_PAYEE.format(source=source)
        q["payer_last_txn" + suffix] = lambda spark, d, v=view: tidy(h.payer_last_txn(v(spark, d)))
        s["payer_last_txn" + suffix] = LAST_TXN.format(source=source)
    q["payer_history_probe"], s["payer_history_probe"] = lambda sp, d: tidy(payer_probe(sp, d)), PAYER_PROBE
    q["payee_history_probe"], s["payee_history_probe"] = lambda sp, d: tidy(payee_probe(sp, d)), PAYEE_PROBE
    groups = {"features_context": "A", "features_payer": "B", "features_payee_newness": "C",
              "features_payee_record": "D", "features_device": "E"}
    for name, g in groups.items():
        q[name], s[name] = _features(_group(g)), features_sql(_group(g))
    q["features_payer_ties"] = _features(_group("B"), views.txn_ties, digits=3)
    s["features_payer_ties"] = features_sql(_group("B"), TIES, digits=3)
    q["features_payee_record_ties"] = _features(_group("D"), views.txn_ties, digits=3)
    s["features_payee_record_ties"] = features_sql(_group("D"), TIES, digits=3)
    cold = "yn < 3 AS is_cold, "
    q["feature_table"] = _features(ALL_FEATURES, extra=("is_cold",))
    s["feature_table"] = features_sql(ALL_FEATURES, extra=cold)
    q["feature_table_hot"], s["feature_table_hot"] = hot_feature_table, s["feature_table"]
    q["cold_feature_subset"] = _features(COLD_FEATURES, extra=("is_cold",))
    s["cold_feature_subset"] = features_sql(COLD_FEATURES, extra=cold)
    q["cold_routing"] = lambda spark, d: feats.cold_flags(views.txn(spark, d))
    s["cold_routing"] = f"WITH {TXN} SELECT txn_id, count(*) {over(Y)} < 3 AS is_cold FROM txn"
    q["cold_routing_threshold"] = lambda spark, d: feats.cold_flags(views.txn(spark, d), 10)
    s["cold_routing_threshold"] = f"WITH {TXN} SELECT txn_id, count(*) {over(Y)} < 10 AS is_cold FROM txn"
    q["training_table"] = lambda spark, d: tidy(feats.point_in_time(views.txn(spark, d)).select(
        "txn_id", "ts", "amount", "label_is_fraud", "label_typology", "is_cold", "payee_fanin_velocity",
        "amount_zscore_vs_payer_30d", "payer_payee_txn_count"))
    s["training_table"] = features_sql(
        ["payee_fanin_velocity", "amount_zscore_vs_payer_30d", "payer_payee_txn_count"],
        extra=f"ts, {r('amount')} AS amount, label_is_fraud, label_typology, yn < 3 AS is_cold, ")
    warm = "2024-01-21 00:00:00"
    q["features_after_warm_up"] = lambda spark, d: tidy(feats.since(
        feats.point_in_time(views.txn(spark, d)), warm).select("txn_id", "is_cold", *_group("D")))
    s["features_after_warm_up"] = features_sql(_group("D"), extra=cold) + f" WHERE ts >= TIMESTAMP '{warm}'"
    return q, s


QUERIES, SQL = _register()
