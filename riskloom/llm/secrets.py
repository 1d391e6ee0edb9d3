"""Find secrets in texts, with a random forest that takes out false findings.

Candidates are runs of key characters with a digit among them, of any length. A text is split around them; each then is a
small row of its own, with the text beside it, and running sums over a text's rows give the places. So the work is
linear in the length of a text, and no row holds more than one candidate. Each gets its length, character transitions, the share of its
letters that are dictionary words, traits of its path and of the neighbouring words; a forest fitted on labelled findings
gives the probability that it is a secret. All of it is DataFrame and JVM work.

The dictionary is every word of letters with at least `WORD_SHARE` of the corpus's words (so at most 1/WORD_SHARE of
them). The forest is fitted on at most about `LABELLED_ROWS` labelled findings, drawn by hash.

Defined results: NULL and empty texts have no findings; a NULL path is an empty one. Rows alike in id and text give alike
findings. If labels are missing or all alike, the probability is their mean, or 0.5 without any. Only doc_id, text and
the path column are read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

LEAST, BESIDE = 8, 48
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
WORD_SHARE, LABELLED_ROWS = 1e-5, 20_000
TREES, DEPTH, SEED = 40, 6, 7
KEY_WORD = r"(?i)(pass(word|wd)?|token|secret|api|key|auth|credential|private|bearer)"
FEATURES = ["length", "distinct", "turns", "digits", "uppers", "hex_only", "dictionary", "longest_run", "path_depth",
            "path_test", "path_length", "assigned", "quoted", "key_before", "left_word", "right_word", "left_digits"]


def candidates(docs: DataFrame, path_col: str = "source") -> DataFrame:
    """doc_id, path, place (characters before it), found and the text on either side."""
    text = F.col("text")
    rows = docs.filter(text.rlike(CANDIDATE)).select(
        "doc_id", F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("hits"),
        F.split(text, CANDIDATE, -1).alias("between"))
    one = F.transform("hits", lambda x, k: F.struct(
        k.alias("k"), x.alias("found"), F.right(F.get("between", k), F.lit(BESIDE)).alias("left"),
        F.left(F.get("between", k + 1), F.lit(BESIDE)).alias("right"), F.length(F.get("between", k)).cast("long").alias("gap")))
    # numbered before the rows are taken apart: rows alike in all columns stay apart
    rows = rows.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "path", "row", F.inline(one))
    passed = F.sum(F.col("gap") + F.length("found")).over(W.partitionBy("row").orderBy("k").rowsBetween(W.unboundedPreceding, -1))
    return rows.select("doc_id", "path", "found", (F.coalesce(passed, F.lit(0)) + F.col("gap")).alias("place"), "left", "right")


def dictionary(docs: DataFrame) -> DataFrame:
    """word: lower-case letter words that make up at least WORD_SHARE of all words."""
    words = docs.select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word")).filter(F.length("word") >= 3)
    counted = stored(words.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n")), "word-counts")
    total = counted.agg(F.sum("n")).first()[0] or 0
    return counted.filter(F.col("n") >= max(2, WORD_SHARE * total)).select("word")


def _share(pattern: str) -> Column:
    return F.regexp_count("found", F.lit(pattern)) / F.length("found")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with one double column for each of FEATURES."""
    known = F.broadcast(words)                            # bounded by 1 / WORD_SHARE
    f = found.withColumns({
        "left_name": F.lower(F.regexp_extract("left", r"([\p{L}_]+)[^\p{L}]*$", 1)),
        "right_name": F.lower(F.regexp_extract("right", r"^[^\p{L}]*(\p{L}+)", 1)),
        "runs": F.transform(F.regexp_extract_all("found", F.lit("[A-Za-z]{3,}"), F.lit(0)), lambda x: F.lower(x))})
    for side in ("left", "right"):
        f = f.join(known.select(F.col("word").alias(f"{side}_name"), F.lit(1.0).alias(f"{side}_word")), f"{side}_name", "left")
    runs = (f.select(F.explode(F.array_distinct("runs")).alias("word"), "found").distinct().join(known, "word")
            .groupBy("found").agg(F.collect_set("word").alias("good")))
    f = f.join(runs, "found", "left")
    letters = F.aggregate("runs", F.lit(0), lambda a, x: a + F.length(x))
    covered = F.aggregate(F.filter("runs", lambda x: F.array_contains("good", x)), F.lit(0), lambda a, x: a + F.length(x))
    kind = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[+/_-])"
    return f.withColumns({
        "length": F.length("found").cast("double"), "distinct": F.size(F.array_distinct(F.split("found", ""))) / F.length("found"),
        "turns": _share(kind), "digits": _share("[0-9]"), "uppers": _share("[A-Z]"),
        "hex_only": F.col("found").rlike("^[0-9a-fA-F]+$").cast("double"),
        "dictionary": F.coalesce(F.try_divide(covered, letters), F.lit(0.0)),
        "longest_run": F.coalesce(F.array_max(F.transform("runs", lambda x: F.length(x))), F.lit(0)).cast("double"),
        "path_depth": F.regexp_count("path", F.lit("[/.]")).cast("double"), "path_test": F.col("path").rlike("(?i)test|mock|sample|example|fixture").cast("double"),
        "path_length": F.length("path").cast("double"),
        "assigned": F.col("left").rlike("[=:]\\s*[\"']?$").cast("double"), "quoted": F.col("left").rlike("[\"']$").cast("double"),
        "key_before": F.col("left_name").rlike(KEY_WORD).cast("double"), "left_digits": F.col("left").rlike("[0-9][^ ]{0,3} ?$").cast("double"),
    }).fillna(0.0, FEATURES).select("doc_id", "path", "place", "found", "left", *[F.col(c).cast("double").alias(c) for c in FEATURES])


def fit_and_score(rows: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """`rows` (features, and a label 0 or 1 where known) with `probability` of being a secret."""
    labelled = rows.filter(F.col(label).isNotNull())
    s = labelled.agg(F.count("*").alias("n"), F.avg(label).alias("m")).first()
    if not s.n or s.m in (0.0, 1.0):
        return rows.withColumn("probability", F.lit(0.5 if not s.n else float(s.m)))
    share = int(1_000_000 * min(1.0, LABELLED_ROWS / s.n))
    part = labelled.filter(F.pmod(F.xxhash64("doc_id", "place", "found"), F.lit(1_000_000)) < share)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="vector")
    sample = stored(part.select(*FEATURES, F.col(label).cast("double").alias(label)).orderBy(*FEATURES, label), "labelled")
    forest = RandomForestClassifier(featuresCol="vector", labelCol=label, numTrees=trees, maxDepth=depth, seed=SEED)
    model = forest.fit(vectors.transform(sample))
    out = model.transform(vectors.transform(rows))
    return out.withColumn("probability", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "prediction")


def scan(docs: DataFrame, label: Column, path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """Findings: doc_id, place, length, found, label, probability, is_secret. `label` says of a finding (columns
    doc_id, path, place, found, left) whether it is known to be a secret (1), to be none (0), or nothing (NULL)."""
    docs = docs.select("doc_id", "text", path_col).filter("text is not null")
    found = stored(candidates(docs, path_col), "candidates")
    rows = stored(features(found, dictionary(docs)).withColumn("label", label), "findings")
    scored = fit_and_score(rows)
    return scored.select("doc_id", "place", F.col("length").cast("long").alias("length"), "found", "label", "probability",
                         (F.col("probability") >= threshold).alias("is_secret"))


def known_findings() -> Column:
    """Labels for findings that a format settles: provider keys and values assigned to a credential name are secrets;
    plain numbers (cards, phones) are none. NULL for others. Documents of one fold in four have no labels."""
    train = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 != 2, F.lit(True))
    secret = F.col("found").rlike("^AKIA[0-9A-Z]{16}$") | F.col("left").rlike("(?i)(password|token|secret)\\s*[=:]\\s*[\"']?$")
    return F.when(train, F.when(secret, 1).when(F.col("found").rlike("^[0-9-]+$"), 0))
