"""Allow or block pages by their URLs: rules first, then a model of host and path.

Everything here is DataFrame functions; the driver holds the model, one number a bucket.
"""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strandline.plans.storage import stored

#: Buckets of n-gram hashes, and so the size of the model.
BUCKETS = 4096
GRAM = 4
#: Rows of the labelled table that the model is fitted on, at most.
LABELLED = 2000
ROUNDS = 20
_STEP = 8.0
_MOMENTUM = 0.8
_SHRINK = 1e-4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, its A-Z as a-z: from behind the first ``://`` to the first of ``/?#``. Path: from
    there to the first of ``?#``. Both are empty for null and where ``://`` is missing."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest of ``rules``, such as ``example.org/es/``, that fits; null if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's. Of two of one
    length the first in code point order wins. A short list is meant: each rule is an expression.
    """
    fits = []
    for rule in sorted(set(rules), key=lambda rule: (-len(rule), rule)):
        name, slash, rest = rule.partition("/")
        own = (host == name) | F.endswith(host, F.lit(f".{name}"))
        fits.append(F.when(own & F.startswith(path, F.lit(slash + rest)), F.lit(rule)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def _buckets(host: Column, path: Column) -> Column:
    """Hashes of the character n-grams of host and path, each n-gram as often as it is there."""

    def grams(text: Column, seed: str) -> Column:
        text = F.concat(F.lit("^"), text, F.lit("$"))
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (GRAM - 1)))
        return F.transform(
            places,
            lambda i: F.pmod(
                F.xxhash64(F.lit(seed), F.substring(text, i, F.lit(GRAM))), F.lit(BUCKETS)
            ).cast("int"),
        )

    return F.concat(grams(host, "host"), grams(path, "path"))


def _margin(buckets: Column, model: Sequence[float]) -> Column:
    """The model's log-odds of being allowed; the last number of ``model`` is for all URLs."""
    numbers = ",".join(f"{x:.9g}" for x in model)
    weights = F.split(F.lit(numbers), ",").cast("array<double>")
    total = F.aggregate(
        buckets, F.lit(0.0), lambda total, bucket: total + F.element_at(weights, bucket + 1)
    )
    return total / F.sqrt(F.size(buckets).cast("double")) + F.lit(float(model[-1]))


def train(labelled: DataFrame, rounds: int = ROUNDS) -> list[float]:
    """Weights of a logistic regression on ``labelled``: ``host``, ``path``, ``allowed``.

    Gradient steps with momentum over all rows; a round sums the rows' shares by bucket, and
    ``BUCKETS`` numbers reach the driver. Rows without a label are passed over. Without rows of
    both kinds all weights are 0, that is, everything is allowed.
    """
    rows = labelled.filter("allowed is not null").select(
        F.col("allowed").cast("double").alias("y"), _buckets(F.col("host"), F.col("path")).alias("b")
    )
    rows = stored(rows, "urls")
    model, speed = [0.0] * (BUCKETS + 1), [0.0] * (BUCKETS + 1)
    count, kinds = rows.agg(F.count("*"), F.count_distinct("y")).first()
    if kinds < 2:
        return model
    for _ in range(rounds):
        ahead = [w + _MOMENTUM * v for w, v in zip(model, speed)]
        chance = 1.0 / (1.0 + F.exp(-_margin(F.col("b"), ahead)))
        missed = rows.select("b", (F.col("y") - chance).alias("r"))
        shares = missed.select(
            F.explode(F.concat("b", F.array(F.lit(BUCKETS)))).alias("bucket"),
            "r",
            (F.col("r") / F.sqrt(F.size("b").cast("double"))).alias("share"),
        )
        part = F.when(F.col("bucket") == BUCKETS, F.col("r")).otherwise(F.col("share"))
        slope = dict(shares.groupBy("bucket").agg(F.sum(part)).collect())
        for i, weight in enumerate(ahead):
            change = round(slope.get(i, 0.0) / count, 12) - _SHRINK * weight
            speed[i] = _MOMENTUM * speed[i] + _STEP * change * (1 if i < BUCKETS else 1 / _STEP)
            model[i] += speed[i]
    return model


def judged(
    pages: DataFrame,
    allow: Sequence[str],
    block: Sequence[str],
    labelled_rows: int = LABELLED,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` for every row of ``pages``.

    The verdict is ``allow`` or ``block``: that of the longest rule that fits, else the model's.
    The model is a logistic regression on hashed character n-grams of host and path. It is fitted
    on a small table of labelled URLs: up to ``labelled_rows`` different ones that a rule fits,
    the first by hash. ``score`` is its chance of ``allow``; 0.5 and more is allowed, so without
    labelled rows of both kinds everything without a rule is.

    A null URL, and one without ``://``, has an empty host and path. A null ``page_id`` is
    returned as it is; repeated rows are each judged. Other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = fitting_rule(F.col("host"), F.col("path"), (*allow, *block))
    urls = urls.withColumn("rule", rule)
    allowed = F.col("rule").isin(list(allow))
    known = (
        urls.filter("rule is not null")
        .groupBy("host", "path")
        .agg(F.first("rule").alias("rule"))
        .select("host", "path", allowed.alias("allowed"))
        .orderBy(F.xxhash64("host", "path"), "host", "path")
        .limit(labelled_rows)
    )
    margin = _margin(_buckets(F.col("host"), F.col("path")), train(known, rounds))
    chance = 1.0 / (1.0 + F.exp(-margin))
    by_rule = F.when(F.col("rule").isNotNull(), allowed)
    return urls.withColumn("score", chance).withColumn(
        "verdict", F.when(F.coalesce(by_rule, F.col("score") >= 0.5), "allow").otherwise("block")
    )
