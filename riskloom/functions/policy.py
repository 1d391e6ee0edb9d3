"""Tiers, actions and their cost."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ACTIONS, RISK_TIERS

TIERS = ("t_warn", "t_review", "t_block")
# Cost in rupees of acting on a genuine payment.
FALSE_ALARM = {"ALLOW": 0.0, "WARN": 40.0, "REVIEW": 150.0, "BLOCK": 500.0}

Thresholds = dict[str, dict[str, float]]      # {"cold": {...}, "warm": {...}}


def _bound(thresholds: Thresholds, tier: str, is_cold: Column) -> Column:
    return F.when(is_cold, thresholds["cold"][tier]).otherwise(thresholds["warm"][tier])


def _step(score: Column, bounds: list[Column], labels) -> Column:
    """The label of the score's step; NULL where there is no score (NULL or NaN)."""
    return (F.when(score < bounds[0], labels[0]).when(score < bounds[1], labels[1])
            .when(score < bounds[2], labels[2]).when(score.isNotNull() & ~F.isnan(score.cast("double")), labels[3]))


def risk_tier(score: Column, is_cold: Column, thresholds: Thresholds) -> Column:
    return _step(score, [_bound(thresholds, t, is_cold) for t in TIERS], RISK_TIERS)


def action(score: Column, is_cold: Column, thresholds: Thresholds) -> Column:
    return _step(score, [_bound(thresholds, t, is_cold) for t in TIERS], ACTIONS)


def action_at(score: Column, warn: Column, review: Column, block: Column) -> Column:
    return _step(score, [warn, review, block], ACTIONS)


def action_of(tier: Column) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(t), F.lit(a)) for t, a in zip(RISK_TIERS, ACTIONS)))[tier]


def cost(action: Column, fraud: Column, amount: Column) -> Column:
    """Missed fraud costs its amount, caught fraud saves it, false alarms cost a fee."""
    out = F.when(fraud, F.when(action == "ALLOW", amount).otherwise(-amount))
    for name, fee in FALSE_ALARM.items():
        out = out.when(action == name, fee)
    return out
