"""Column expressions behind the features that need no history, and the rules
that turn as-of reads into feature values. SQL NULL stands for "missing"."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR
MONTH = 30 * DAY

# Given and family names looked for inside a payee handle.
HANDLE_NAMES = (
    "raj", "priya", "amit", "sneha", "vikram", "anita", "rahul", "pooja", "arjun", "neha",
    "suresh", "kavita", "manoj", "divya", "sanjay", "meera", "ravi", "shreya", "vijay", "anjali",
    "karan", "swati", "deepak", "nisha", "ajay", "ritu", "vinod", "priyanka", "sunil", "asha",
    "kumar", "sharma", "patel", "singh", "reddy", "gupta", "verma", "iyer", "nair", "rao",
    "mehta", "joshi", "shah", "desai", "chauhan", "malhotra", "pillai", "menon", "das", "bose",
    "rohit", "sana", "farhan", "zoya", "aditya", "ishita", "gaurav", "tanvi", "harsh", "simran",
)


def micros(ts) -> Column:
    return F.unix_micros(ts)


def is_night(ts) -> Column:
    return (F.hour(ts) >= 23) | (F.hour(ts) < 5)


def roundness(amount) -> Column:
    """Whether the amount is an exact multiple of 1,000 or of 100 rupees."""
    paise = F.bround(F.col(amount) * 100).cast("long")
    return (F.when(paise % 100_000 == 0, "thousand")
            .when(paise % 10_000 == 0, "hundred")
            .otherwise("neither"))


def handle(vpa) -> Column:
    return F.substring_index(vpa, "@", 1)


def digit_ratio(vpa) -> Column:
    local = handle(vpa)
    digits = F.length(F.regexp_replace(local, "[^0-9]", ""))
    return F.when(F.length(local) == 0, 0.0).otherwise(digits / F.length(local))


def entropy(vpa) -> Column:
    """Shannon entropy in bits of the handle's characters, as
    log2(L) - sum(n log2 n) / L over the distinct characters."""
    local = handle(vpa)
    size = F.length(local)
    letters = F.array_distinct(F.split(local, ""))
    weight = F.aggregate(
        letters, F.lit(0.0),
        lambda acc, c: acc + _n_log_n(size - F.length(F.replace(local, c))))
    return F.when(size == 0, 0.0).otherwise(F.log2(size.cast("double")) - weight / size)


def _n_log_n(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0)


def has_name(vpa) -> Column:
    return F.lower(handle(vpa)).rlike("|".join(HANDLE_NAMES))


# --- exact moments --------------------------------------------------------
# Sums of amounts run as decimals so that values which entered a sliding window
# leave it without a trace; doubles would keep rounding noise.
AMOUNT = "decimal(15,6)"
TOTAL = "decimal(22,6)"
SQUARES = "decimal(34,12)"


def exact(amount) -> Column:
    return F.col(amount).cast(AMOUNT)


def exact_square(amount) -> Column:
    return exact(amount) * exact(amount)


def mean(total: Column, n: Column) -> Column:
    return F.when(n > 0, total.cast("double") / n)


def std(total: Column, squares: Column, n: Column) -> Column:
    """Population standard deviation; below 1e-9 of the mean counts as 0.

    Squares are re-centred in decimals around the rounded mean, so nothing is
    lost where the deviation is small against the amounts."""
    total, count = total.cast(TOTAL), n.cast("decimal(12,0)")
    centre = (total / count).cast(AMOUNT)
    drift = total - count * centre
    around = squares - centre * (total + drift).cast(TOTAL)
    spread = around.cast("double") / n - F.pow(drift.cast("double") / n, F.lit(2.0))
    root = F.sqrt(F.greatest(spread, F.lit(0.0)))
    floor = 1e-9 * F.abs(centre.cast("double"))
    return F.when(n > 0, F.when(root < floor, 0.0).otherwise(root))


# --- circular mean of the hour of day --------------------------------------
# Hours twelve apart cancel exactly, so twelve signed counts carry the sum.
HALF_DAY = range(12)


def hour_sign(k: int, hour: Column) -> Column:
    return F.when(hour == k, 1).when(hour == k + 12, -1).otherwise(0).cast("long")


def circular_sums(counts: list[Column]) -> tuple[Column, Column]:
    sin = sum((c * math.sin(2 * math.pi * k / 24) for k, c in enumerate(counts)), F.lit(0.0))
    cos = sum((c * math.cos(2 * math.pi * k / 24) for k, c in enumerate(counts)), F.lit(0.0))
    return sin, cos


def hour_deviation(hour: Column, counts: list[Column]) -> Column:
    sin, cos = circular_sums(counts)
    usual = F.pmod(F.atan2(sin, cos) / (2 * math.pi) * 24, F.lit(24.0))
    gap = F.abs(hour - usual)
    return F.least(gap, 24 - gap)
