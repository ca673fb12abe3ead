"""URL filters: rules by host suffix and path prefix, and boosted trees for the rest.

All in DataFrame functions: the lexical features are column expressions, suffix
statistics are a grouped table joined back, and the trees are pyspark.ml's.  The
trees learn from URLs that the rules decide, at most ``SAMPLE`` of them.  Hosts are
dealt to two halves by a hash: the statistics count the labels of one half, the trees
learn on the other, so no URL's label is among its own features.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debitage.iterate import materialise

SAMPLE = 20_000
TREES = 12
DEPTH = 4
#: Rules up to this number are column expressions; more are a table to join.
INLINE = 64
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lowered), path, and what follows; all empty without ``://``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(rest, r"(?s)^[^?#]*(.*)$", 1)
    return host, path, tail


def _fits(rule: str) -> Column:
    suffix, slash, prefix = rule.partition("/")
    host = (F.col("host") == suffix) | F.col("host").endswith("." + suffix)
    return host & F.col("path").startswith(slash + prefix)


def with_rules(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """urls (host, path, page_key) with ``rule`` and ``decided``: the longest rule that fits and its verdict."""
    order = sorted(dict(rules).items(), key=lambda r: (-len(r[0]), r[0]))
    if len(order) <= INLINE:
        rule, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
        for text, verdict in reversed(order):
            rule = F.when(_fits(text), F.lit(text)).otherwise(rule)
            decided = F.when(_fits(text), F.lit(verdict)).otherwise(decided)
        return urls.withColumn("rule", rule).withColumn("decided", decided)
    table = urls.sparkSession.createDataFrame(order, "rule string, decided string")
    table = table.select("rule", "decided", F.substring_index("rule", "/", 1).alias("suffix"), F.expr("substring(rule, instr(rule, '/'))").alias("prefix"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    asked = urls.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    best = asked.join(table, "suffix").where("startswith(path, prefix)").groupBy("host", "path").agg(F.max_by(F.struct("rule", "decided"), F.struct(F.length("rule"), F.col("rule"))).alias("r"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, "r.rule", "r.decided")


def _entropy(text: Column) -> Column:
    """Bits a character over letters, digits, hyphen and dot."""
    n = F.greatest(F.length(text), F.lit(1))
    parts = []
    for c in "abcdefghijklmnopqrstuvwxyz0123456789-.":
        p = (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / n
        parts.append(F.when(p > 0, -p * F.log2(p)).otherwise(0.0))
    return functools.reduce(operator.add, parts)


FEATURES = ("n_host", "n_path", "n_tail", "depth", "labels", "digits", "hyphens", "entropy", "params", "escapes", "last_digits", "suffix_rate", "head_rate")


def with_features(urls: DataFrame) -> DataFrame:
    """urls (host, path, tail) with the lexical features and the two suffixes that statistics are kept of."""
    whole = F.concat("host", "path", "tail")
    digits = F.length(F.regexp_replace(whole, "[^0-9]", ""))
    return urls.select(
        *urls.columns,
        F.length("host").cast("double").alias("n_host"),
        F.length("path").cast("double").alias("n_path"),
        F.length("tail").cast("double").alias("n_tail"),
        F.size(F.split("path", "/")).cast("double").alias("depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        (digits / F.greatest(F.length(whole), F.lit(1))).alias("digits"),
        (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        _entropy(F.col("host")).alias("entropy"),
        F.regexp_count("tail", F.lit("[&=]")).cast("double").alias("params"),
        F.regexp_count(whole, F.lit("%[0-9A-Fa-f]{2}")).cast("double").alias("escapes"),
        F.length(F.regexp_extract("path", "([0-9]*)/?(\\.[a-z]+)?$", 1)).cast("double").alias("last_digits"),
        F.substring_index("host", ".", -1).alias("suffix"),
        F.substring_index(F.substring("path", 2, 1_000_000_000), "/", 1).alias("head"),
    )


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of pages (page_id, url).

    ``verdict`` is the longest fitting rule's, else ``block`` where the trees' score is
    at least one half.  Null urls and urls without ``://`` have empty host and path and
    are scored like any other; without rule-decided URLs of both kinds the score is 0
    (allow).  Repeated rows and null page_ids keep their rows; an empty table gives an
    empty one; further columns are ignored.
    """
    url = F.col("url").cast("string")
    host, path, tail = split_url(url)
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), tail.alias("tail"))
    ruled = with_features(with_rules(urls, rules))
    known = ruled.where("decided is not null").withColumn("label", (F.col("decided") == "block").cast("double"))
    # two counts come back
    tally = known.agg(F.count("*").alias("n"), F.sum("label").alias("y")).first()
    n, y = tally["n"], tally["y"] or 0
    if not n or y in (0, n):
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("decided", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    prior = y / n
    half = F.pmod(F.xxhash64("host", F.lit("half")), F.lit(2))
    counted = known.where(half == 0)
    stats = lambda by, name: counted.groupBy(by).agg(((F.sum("label") + 10 * prior) / (F.count("*") + 10)).alias(name))
    full = ruled.join(stats("suffix", "suffix_rate"), "suffix", "left").join(stats("head", "head_rate"), "head", "left").fillna({"suffix_rate": prior, "head_rate": prior})
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(full)
    # by row, so that a URL on many rows is drawn as often as others
    chance = F.pmod(F.xxhash64("host", "path", "tail", F.monotonically_increasing_id()), F.lit(1 << 40)) / float(1 << 40)
    train = vectors.where("decided is not null").where(chance < 2 * sample / n).select("features", (F.col("decided") == "block").cast("double").alias("label"), half.alias("half"))
    train = materialise(train)  # at most about 2 * sample short rows, which each round of the trees reads
    other = train.where("half = 1")
    both = other.agg(F.min("label"), F.max("label")).first()
    if both[0] == both[1]:  # few hosts: one half alone can't teach both verdicts
        other = train
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=32, seed=11).fit(other.drop("half"))
    score = vector_to_array("probability")[1]
    return model.transform(vectors).select("page_id", "host", "path", "rule", F.coalesce("decided", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
