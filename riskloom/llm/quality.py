"""Quality by weak supervision: rules vote good or bad or abstain, expectation-maximisation weighs them.

Everything is DataFrame work. One pass turns each text into counts and votes; the votes are folded to patterns (at most
three to the power of the number of rules), and each EM round is one aggregate over that small table: the expected
share of good documents and, for each rule, how often it votes each way on good and on bad documents. The posterior of a
document's pattern replaces a demand that all rules pass.

Repeated 8-word windows are found inside the row: word hashes are folded to window hashes by doubling, and only texts in
which a window hash occurs twice have them sorted.

Defined results: a NULL text has no words and fails the base check, as do empty and blank ones. Equal texts get equal
verdicts. With an empty table nothing is learnt and nothing returned. Columns of the input other than doc_id and text
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BLANKS = r"[ \t\n\x0B\f\r]+"
WINDOW = 8
#: Base check: fewest words, most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
ROUNDS, SETTLED, SMOOTH = 40, 1e-5, 0.5


def counts(docs: DataFrame) -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need besides."""
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select("doc_id", text.alias("text"), F.array_remove(F.split(text, BLANKS), "").alias("w"),
                    F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")).alias("lines"))
    b = a.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h1"))
    for size in (1, 2, 4):
        h = F.col(f"h{size}")
        b = b.withColumn(f"h{2 * size}", F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + size))))
    c = b.withColumn("h", F.slice(F.col(f"h{WINDOW}"), F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))))
    c = c.withColumn("again", F.size("h") > F.size(F.array_distinct("h")))
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    c = c.withColumn("sorted", F.when(F.col("again"), pairs))
    s = F.col("sorted")
    places = F.sort_array(F.transform(
        F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False))
                 | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))), lambda x: x["i"]))
    c = c.withColumn("places", places)
    p = F.col("places")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
                          F.lit(0), lambda acc, x: acc + x)
    n = F.col("n_words")
    return c.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?:…][\"'»”)]*[ \t\x0B\f\r]*\z"))).alias("n_ended"),
        F.size(F.array_distinct("h1")).alias("n_distinct"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count("text", F.lit(r"[0-9]")).alias("n_digits"),
        F.regexp_count("text", F.lit(r"[!?]")).alias("n_shouts"),
        F.regexp_count("text", F.lit(r"[.,;:!?]")).alias("n_marks"),
    ).withColumn("base_failed", (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n))


def _vote(value: Column, bad, good) -> Column:
    """1 bad, 2 good, 0 abstains; a missing value abstains."""
    return F.when(bad(value), 1).when(good(value), 2).otherwise(0)


def rules() -> dict[str, Column]:
    """Each rule looks at one trait; between its two limits it abstains."""
    per_word = {c: F.try_divide(F.col(c), F.col("n_words")) for c in ("n_symbols", "n_upper", "n_digits", "n_shouts", "n_repeat_words", "n_distinct")}
    length = F.try_divide(F.col("word_chars"), F.col("n_words"))
    return {
        "symbols": _vote(per_word["n_symbols"], lambda x: x > 0.1, lambda x: x < 0.02),
        "word_length": _vote(length, lambda x: (x < 3) | (x > 7), lambda x: x.between(4, 6)),
        "capitals": _vote(F.try_divide(F.col("n_upper"), F.col("word_chars")), lambda x: x > 0.3, lambda x: x < 0.08),
        "shouts": _vote(per_word["n_shouts"], lambda x: x > 0.2, lambda x: x < 0.05),
        "digits": _vote(F.try_divide(F.col("n_digits"), F.col("word_chars")), lambda x: x > 0.3, lambda x: x < 0.1),
        "line_ends": _vote(F.try_divide(F.col("n_ended"), F.col("n_lines")), lambda x: x < 0.3, lambda x: x > 0.8),
        "repeated_lines": _vote(F.try_divide(F.col("n_dup_lines"), F.col("n_lines")), lambda x: x > 0.3, lambda x: x < 0.05),
        "repeated_words": _vote(per_word["n_repeat_words"], lambda x: x > 0.2, lambda x: x < 0.05),
        # the share of distinct words falls with length, about as its root
        "variety": _vote(F.try_divide(F.col("n_distinct"), F.sqrt("n_words")), lambda x: x < 2.5, lambda x: x > 6),
        "sentences": _vote(F.try_divide(F.col("n_marks"), F.col("n_words")), lambda x: (x < 0.02) | (x > 1), lambda x: x.between(0.05, 0.4)),
    }


def _log_odds(names: list[str], prior: float, share: dict) -> Column:
    """Sum of the prior's log odds and each vote's log likelihood ratio."""
    total = F.lit(math.log(prior / (1 - prior)))
    for r in names:
        ratio = [math.log(share[r, v, 1] / share[r, v, 0]) for v in (0, 1, 2)]
        total = total + F.when(F.col(r) == 1, ratio[1]).when(F.col(r) == 2, ratio[2]).otherwise(ratio[0])
    return total


def learn(patterns: DataFrame, names: list[str]) -> tuple[float, dict] | None:
    """Prior of good documents and P(vote | class) of each rule, from vote patterns with their counts `n`.

    Starts from: documents with a bad vote are bad, others good; nine parts to one each."""
    clean = F.lit(True)
    for r in names:
        clean = clean & (F.col(r) != 1)
    good = F.when(clean, 0.9).otherwise(0.1)
    before = None
    for _ in range(ROUNDS):
        e = patterns.withColumn("good", good)
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("g")]
        for r in names:
            for v in (1, 2):
                hit = F.when(F.col(r) == v, F.col("n")).otherwise(0)
                sums += [F.sum(hit * F.col("good")).alias(f"{r}{v}g"), F.sum(hit).alias(f"{r}{v}n")]
        s = e.agg(*sums).first()
        if not s.n:
            return None
        of = {1: s.g, 0: s.n - s.g}
        prior = (s.g + SMOOTH) / (s.n + 2 * SMOOTH)
        share = {}
        for r in names:
            for y in (0, 1):
                votes = {v: s[f"{r}{v}g"] if y else s[f"{r}{v}n"] - s[f"{r}{v}g"] for v in (1, 2)}
                votes[0] = of[y] - votes[1] - votes[2]
                for v in (0, 1, 2):
                    share[r, v, y] = (max(votes[v], 0.0) + SMOOTH) / (max(of[y], 0.0) + 3 * SMOOTH)
        now = [prior, *share.values()]
        if before is not None and max(abs(a - b) for a, b in zip(now, before)) < SETTLED:
            break
        before = now
        good = 1 / (1 + F.exp(-_log_odds(names, prior, share)))
    return prior, share


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The counts of each document with base_failed, quality (posterior that it is good) and kept."""
    voted = rules()
    names = list(voted)
    seen = stored(counts(docs.select("doc_id", "text")).withColumns(voted), "votes")
    patterns = stored(seen.filter("not base_failed").groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    model = learn(patterns, names)
    quality = F.lit(0.5) if model is None else 1 / (1 + F.exp(-_log_odds(names, *model)))
    out = seen.withColumn("quality", quality)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
