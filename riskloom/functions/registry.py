"""The ordered feature contract: names, groups and which model may use them."""

from __future__ import annotations

# Fixed values: (feature, group, usable by the cold model, may be missing).
# The order is part of the contract with trained models.
BASE = [
    ("amount_log", "A", True, False),
    ("hour_of_day", "A", True, False),
    ("is_night", "A", True, False),
    ("day_of_week", "A", True, False),
    ("is_collect_request", "A", True, False),
    ("is_p2p", "A", True, False),
    ("amount_roundness", "A", True, False),
    ("payer_account_age_days", "A", True, False),
    ("amount_zscore_vs_payer_30d", "B", True, True),
    ("amount_ratio_to_payer_median", "B", True, True),
    ("payer_txn_count_1h", "B", True, False),
    ("payer_txn_count_24h", "B", True, False),
    ("payer_txn_count_30d", "B", True, False),
    ("payer_distinct_payees_24h", "B", True, False),
    ("seconds_since_payer_last_txn", "B", True, True),
    ("hour_deviation_from_payer_normal", "B", True, True),
    ("payer_new_payee_rate_30d", "B", True, True),
    ("payer_collect_request_rate_30d", "B", True, True),
    ("is_first_ever_txn_by_payer", "B", True, False),
    ("payee_age_hours_in_system", "C", True, False),
    ("payee_total_txn_count", "C", True, False),
    ("payee_is_unseen", "C", True, False),
    ("payee_handle_digit_ratio", "C", True, False),
    ("payee_handle_entropy", "C", True, False),
    ("payee_handle_has_dictionary_name", "C", True, False),
    ("payee_distinct_payers_1h", "D", False, True),
    ("payee_distinct_payers_24h", "D", False, True),
    ("payee_distinct_payers_since_first_seen", "D", False, True),
    ("payee_fanin_velocity", "D", False, True),
    ("payee_amount_mean", "D", False, True),
    ("payee_amount_std", "D", False, True),
    ("payee_p2m_ratio", "D", False, True),
    ("payer_payee_txn_count", "D", False, False),
    ("days_since_payer_last_paid_payee", "D", False, True),
    ("device_distinct_payers_30d", "E", True, False),
    ("device_txn_count_1h", "E", True, False),
    ("is_new_device_for_payer", "E", True, False),
]

MISSING = "_is_missing"
BASE_FEATURES = [name for name, *_ in BASE]
MAYBE_MISSING = [name for name, _, _, gaps in BASE if gaps]


def names(cold_safe: bool | None = None) -> list[str]:
    """Feature names in contract order, each gap-prone one followed by its flag."""
    out = []
    for name, _, safe, gaps in BASE:
        if cold_safe is None or safe == cold_safe:
            out += [name, name + MISSING] if gaps else [name]
    return out


ALL_FEATURES = names()
COLD_FEATURES = names(cold_safe=True)
WARM_ONLY_FEATURES = names(cold_safe=False)
CATEGORICAL = {"amount_roundness": ("neither", "hundred", "thousand")}
