"""Texts shown to an analyst for a feature that raised the score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import ALL_FEATURES, MISSING

# How each feature's value is put into words. %0 and %1 stand for
# the value with no or one decimal, %p for it as a percentage, %h for it in two digits.
FLAGS = {
    "is_night": ("Payment made outside this payer's usual hours", "Payment made during this payer's usual hours"),
    "is_collect_request": ("Initiated as a collect request", "Not initiated as a collect request"),
    "is_p2p": ("Person-to-person transfer", "Person-to-merchant payment"),
    "is_first_ever_txn_by_payer": ("This is this payer's first-ever transaction", "This payer has transacted before"),
    "payee_is_unseen": ("This payee has never been seen before", "This payee has a transaction history"),
    "payee_handle_has_dictionary_name": ("Payee handle contains a recognizable name",
                                         "Payee handle does not contain a recognizable name"),
    "is_new_device_for_payer": ("This device has not been used by this payer before",
                                "This device has been used by this payer before"),
}
PLAIN = {
    "amount_log": "Transaction amount is unusually high for this kind of payment",
    "payer_account_age_days": "Payer's account is %0 days old",
    "amount_zscore_vs_payer_30d": "Amount is %1 standard deviations from this payer's 30-day average",
    "amount_ratio_to_payer_median": "Amount is %0x this payer's typical payment",
    "payer_txn_count_1h": "%0 payments from this payer in the last hour",
    "payer_txn_count_24h": "%0 payments from this payer in the last 24 hours",
    "payer_txn_count_30d": "%0 payments from this payer in the last 30 days",
    "payer_distinct_payees_24h": "Paid %0 different payees in the last 24 hours",
    "hour_deviation_from_payer_normal": "Transaction hour is %1 hours from this payer's normal pattern",
    "payer_new_payee_rate_30d": "This payer pays new payees %p of the time",
    "payer_collect_request_rate_30d": "This payer uses collect requests %p of the time",
    "payee_age_hours_in_system": "Payee first seen %0 hours ago",
    "payee_total_txn_count": "Payee has %0 total transactions on record",
    "payee_distinct_payers_1h": "%0 different payers sent money to this payee in the last hour",
    "payee_distinct_payers_24h": "%0 different payers sent money to this payee in the last 24 hours",
    "payee_distinct_payers_since_first_seen": "%0 different payers have ever paid this payee",
    "payee_fanin_velocity": "This payee is receiving from %1 distinct payers per hour",
    "payee_amount_mean": "This payee's average received amount is Rs %0",
    "payee_amount_std": "This payee's received amounts vary by Rs %0 (std dev)",
    "payee_p2m_ratio": "%p of this payee's transactions are merchant-style payments",
    "days_since_payer_last_paid_payee": "%0 days since this payer last paid this payee",
    "device_distinct_payers_30d": "%0 different payers have used this device in the last 30 days",
    "device_txn_count_1h": "%0 transactions from this device in the last hour",
}
ROUND_AMOUNT = {
    "thousand": "Amount is an exact multiple of Rs 1,000 -- round amounts like this are more common in automated or "
                "structured transactions than ordinary spending",
    "hundred": "Amount is an exact multiple of Rs 100 -- a round amount, somewhat more common in automated or "
               "structured transactions than ordinary spending",
    "neither": "Amount is not a round number",
}
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
HOUR = "Transaction occurred at %h:00"
LATE_HOUR = "Transaction occurred at %h:00 -- a late-night hour with little legitimate activity for most payers"
DIGITS = "Payee handle is %p digits"
DIGIT_HEAVY = ("Payee handle is %p digits -- unusually digit-heavy handles are more common in auto-generated or "
               "disposable accounts")
RANDOM_HANDLE = "Payee handle's characters look more randomly generated than a typical name (score %1)"
NAME_HANDLE = "Payee handle's characters look name-like, not randomly generated (score %1)"
FIRST_PAIR = "First payment ever between this payer and payee"
PAIR_COUNT = "%0 prior payments between this payer and payee"
MINUTES = "%0 minutes since this payer's last payment"
NO_VALUE = "%s could not be reliably computed (insufficient history)"
NO_VALUE_SPECIAL = {"days_since_payer_last_paid_payee": "First-ever payment from this payer to this payee"}


def tenths(v: Column) -> Column:
    """`v` rounded to one decimal, half to even, on the exact value of the double: 0.35 lies a little below the middle
    of 0.3 and 0.4. 20 v - n is taken as (16 v - n) + 4 v, whose steps are exact near the middle n."""
    low = F.floor(v * 10).cast("double")
    middle = 2 * low + 1
    beyond = (v * 16 - middle) + v * 4
    up = (beyond > 0) | ((beyond == 0) & (low % 2 != 0))
    return F.when(up, low + 1).otherwise(low) / 10


def _fill(text: str, v: Column) -> Column:
    """The text with its value mark replaced."""
    marks = {"%0": F.format_string("%.0f", F.bround(v, 0)), "%1": F.format_string("%.1f", tenths(v)),
             "%h": F.format_string("%02d", v.cast("int")),
             "%p": F.concat(F.format_string("%.0f", F.bround(v * 100, 0)), F.lit("%"))}
    for mark, shown in marks.items():
        if mark in text:
            left, right = text.split(mark)
            return F.concat(F.lit(left), shown, F.lit(right))
    return F.lit(text)


def without_value(feature: str) -> str:
    return NO_VALUE_SPECIAL.get(feature) or NO_VALUE % feature.replace("_", " ").capitalize()


def message_for(feature: str, v: Column, category: Column) -> Column:
    """Text for one feature; `v` is its value as a number (true = 1)."""
    if feature.endswith(MISSING):
        return F.lit(without_value(feature.removesuffix(MISSING)))
    if feature in FLAGS:
        yes, no = FLAGS[feature]
        out = F.when(v != 0, yes).otherwise(no)
    elif feature in PLAIN:
        out = _fill(PLAIN[feature], v)
    elif feature == "hour_of_day":
        out = F.when(v < 5, _fill(LATE_HOUR, v)).otherwise(_fill(HOUR, v))
    elif feature == "day_of_week":
        out = F.concat(F.lit("Transaction occurred on "), F.array(*[F.lit(d) for d in WEEKDAYS])[(v % 7).cast("int")])
    elif feature == "amount_roundness":
        out = F.concat(F.lit("Amount pattern: "), category)
        for value, text in ROUND_AMOUNT.items():
            out = F.when(category == value, text).otherwise(out)
        return out
    elif feature == "seconds_since_payer_last_txn":
        out = _fill(MINUTES, v / 60)
    elif feature == "payee_handle_digit_ratio":
        out = F.when(v >= 0.5, _fill(DIGIT_HEAVY, v)).otherwise(_fill(DIGITS, v))
    elif feature == "payee_handle_entropy":
        out = F.when(v >= 3.5, _fill(RANDOM_HANDLE, v)).otherwise(_fill(NAME_HANDLE, v))
    elif feature == "payer_payee_txn_count":
        out = F.when(v == 0, FIRST_PAIR).otherwise(_fill(PAIR_COUNT, v))
    else:
        raise KeyError(feature)
    return F.when(v.isNull(), without_value(feature)).otherwise(out)


def message(feature: Column, v: Column, category: Column) -> Column:
    """Text by feature name, over a table of (feature, value) rows."""
    out = None
    for name in ALL_FEATURES:
        text = message_for(name, v, category)
        out = F.when(feature == name, text) if out is None else out.when(feature == name, text)
    return out
