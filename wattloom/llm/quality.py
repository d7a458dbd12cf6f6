"""Quality classifier with hierarchical empirical-Bayes site posteriors (operator 10).

Evidence of three kinds is added as log odds:

* a document classifier: logistic regression on a few dozen surface features, fitted on a bounded sample of the
  labelled rows (``MAX_LABELLED``) and applied to every document;
* the posterior of the document's host (``source``) and of its path (``source`` + ``lang``). Both come from labelled
  counts by grouped aggregation: the global rate is the prior of the hosts, each host's posterior the prior of its
  paths, and the strength of each prior is estimated from the spread between groups (method of moments), so sparse
  sites shrink to their parent.

Nulls: a null text counts as empty, null source or lang as one group of their own ("" key). Empty texts get the
features of an empty text. Repeated rows each get their score. Without labels of both classes the classifier is
neutral and every document is kept. A label row with null quality or doc_id is ignored; of several labels of a document
the best counts, and of rows that share a labelled id the classifier sees one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shielded, short_batches, sized, trim

#: Bound of the labelled rows that the document classifier is fitted on.
MAX_LABELLED = 20_000
#: A document stays if its combined probability of quality is at least this.
KEEP_AT = 0.5
#: Site evidence may move the log odds by this much at most: it is shared by all documents of a site and not independent
#: of the documents' own evidence, which it has to correct and not to replace.
SITE_LIMIT = 1.5

_MARKS = b"|#$%&*!@^~<>{}[]=+_/\\"


def features(text: str | None) -> list[float]:
    """Surface features of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    tokens = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = int(counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum())
    k = max(1, len(tokens))
    pairs = len(set(zip(tokens, tokens[1:]))) / max(1, k - 1) if k > 1 else 1.0
    same_next = sum(map(bytes.__eq__, tokens, tokens[1:])) / k
    out = [counts[m] / k for m in _MARKS]
    out += [
        counts[65:91].sum() / max(1, letters),
        counts[48:58].sum() / n,
        counts[10] / k,
        counts[44] / k,
        counts[46] / k,
        letters / n,
        len(set(tokens)) / k,
        pairs,
        same_next,
        len(set(lines)) / max(1, len(lines)),
        math.log1p(k),
        math.log1p(n / k),
        max((len(x) for x in tokens), default=0) / n,
        1.0 if not tokens else 0.0,
    ]
    return [float(x) for x in out]


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 60) -> dict:
    """Newton's method with a ridge penalty on standardised, square-rooted features."""
    x = np.sqrt(np.maximum(x, 0))
    mean, sd = x.mean(0), x.std(0) + 1e-3
    z = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1]) * l2 * len(x)
    ridge[-1, -1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p) + 1e-6)) @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "sd": sd, "w": w}


def _logit(model: dict | None, text: str | None) -> float:
    if model is None:
        return 0.0
    z = (np.sqrt(np.maximum(np.array(features(text)), 0)) - model["mean"]) / model["sd"]
    return float(np.clip(np.append(np.clip(z, -8, 8), 1.0) @ model["w"], -15, 15))


def _prior_strength(n: F.Column, k: F.Column, p: F.Column) -> F.Column:
    """Method of moments for a beta-binomial: how many pseudo-counts the parent's rate is worth (1 to 1000)."""
    spread = F.try_divide(F.sum(n * F.pow(F.try_divide(k, n) - p, 2)), F.sum(n))
    within = F.try_divide(F.avg(p * (1 - p)) * F.count(F.lit(1)), F.sum(n))
    between = F.greatest(spread - within, F.lit(1e-6))
    return F.least(F.greatest(F.try_divide(F.avg(p * (1 - p)), between) - 1, F.lit(1.0)), F.lit(1000.0))


def _labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): one label a document, the best of several."""
    return labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))


def site_posteriors(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(host posteriors, path posteriors, global rate) from all labelled documents, by grouped aggregation."""
    known = _labels(labels).select("doc_id", F.col("quality").cast("double").alias("_y"))
    sites = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("_host"), F.coalesce("lang", F.lit("")).alias("_path")
    )
    paths = sites.join(known, "doc_id").groupBy("_host", "_path").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("_y").alias("k")
    )
    total = paths.agg(F.coalesce(F.sum("k"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    rate = (total[0] + 1.0) / (total[1] + 2.0)
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    s1 = hosts.agg(_prior_strength(F.col("hn"), F.col("hk"), F.lit(rate))).first()[0] or 1000.0
    hosts = hosts.select("_host", ((F.col("hk") + s1 * rate) / (F.col("hn") + s1)).alias("host_rate"), "hn")
    joined = paths.join(hosts, "_host")
    s2 = joined.agg(_prior_strength(F.col("n"), F.col("k"), F.col("host_rate"))).first()[0] or 1000.0
    paths = joined.select(
        "_host", "_path", ((F.col("k") + s2 * F.col("host_rate")) / (F.col("n") + s2)).alias("path_rate"), "n"
    )
    return hosts, paths, rate


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in parts:
        yield pa.array([features(t.as_py()) for t in texts], pa.list_(pa.float64()))
        trim()


def fit_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict | None:
    """The document classifier, from at most max_labelled labelled rows in hash order; None without two classes."""
    known = _labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("h"), _features("text").alias("x"))
    sample = rows.groupBy("doc_id", "quality").agg(F.min_by("x", "h").alias("x")).orderBy("doc_id").collect()  # a row a label
    if len({r["quality"] for r in sample}) < 2:
        return None
    return fit_logistic(np.array([r["x"] for r in sample]), np.array([float(r["quality"]) for r in sample]))


def score_quality(
    docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, keep_at: float = KEEP_AT, site_limit: float = SITE_LIMIT
) -> DataFrame:
    """docs with the columns doc_logit, host_rate, path_rate, probability and keep; no row moves or goes.

    Of columns of docs with these names the new ones stay."""
    docs, restore = shielded(docs, "doc_id", "text", "source", "lang")
    names = docs.columns
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit_documents(docs, labels, max_labelled))

    @F.arrow_udf("double")
    def logit(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([_logit(shared.value, t.as_py()) for t in texts], pa.float64())
            trim()

    hosts, paths, rate = site_posteriors(docs, labels)
    paths = sized(paths.select("_host", "_path", "path_rate"))
    hosts = sized(hosts.select("_host", "host_rate"))
    # never null: what tests for that would be moved below and evaluate each text twice, in two workers a task
    own = docs.select(
        *names, F.coalesce(logit("text"), F.lit(0.0)).alias("doc_logit"), F.coalesce("source", F.lit("")).alias("_host"),
        F.coalesce("lang", F.lit("")).alias("_path"),
    )
    out = own.join(hosts, "_host", "left").join(paths, ["_host", "_path"], "left")
    host = F.coalesce("host_rate", F.lit(rate))
    path = F.coalesce("path_rate", host)
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = lambda p: F.log(clip(p) / (1 - clip(p)))
    site = F.least(F.greatest(odds(path) - odds(F.lit(rate)), F.lit(-site_limit)), F.lit(site_limit))
    out = out.select(
        *names, "doc_logit", host.alias("host_rate"), path.alias("path_rate"),
        (1 / (1 + F.exp(-(F.col("doc_logit") + site)))).alias("probability"),
    )
    return restore(out.withColumn("keep", F.col("probability") >= keep_at), "doc_logit", "host_rate", "path_rate", "probability", "keep")


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns."""
    docs, restore = shielded(docs, "doc_id", "text", "source", "lang")
    return restore(score_quality(docs, labels, **options).where("keep"))
