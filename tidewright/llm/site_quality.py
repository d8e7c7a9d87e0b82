"""Quality by hierarchical empirical Bayes: a document classifier, and what its site and path are like.

A logistic regression on a text's statistics gives each document a probability. Documents then vote for their
site and, within it, their path: labelled ones with their label, others with their probability. Rates of sites
are shrunk towards the global one and rates of paths towards their site's, the more so the fewer votes there
are; how strongly, follows from the spread of the rates (method of moments). The posterior adds the document's
evidence to the rate of its path, from which its own vote has been taken out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, quality_rules

#: Labelled rows that the classifier is fitted on, at most; those whose hash of doc_id is below a share of its range.
SAMPLE = 50_000
#: Least and largest weight of a prior, in votes.
WEIGHT = (1.0, 1e6)
KEPT = 0.5


def features() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    shares = [F.least(F.col(c) / words, F.lit(3.0)) for c in ("n_symbols", "n_marks", "n_dup_lines", "n_repeat_words", "word_chars")]
    return [F.log1p(words), *shares, F.col("n_upper") / chars, F.sqrt(F.col("n_symbols") / words), F.sqrt(F.col("n_marks") / words), F.sqrt(F.col("n_upper") / chars)]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression on columns scaled to unit variance, intercept first; by Newton steps."""
    centre, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    w, pull = np.zeros(z.shape[1]), np.r_[1e-3, np.full(x.shape[1], ridge)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[1:] / scale
    return np.r_[w[0] - slopes @ centre, slopes]


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _weight(n: Column, squares: Column, groups: Column, mean: Column) -> Column:
    """Votes that a prior counts, from the spread of rates: squares is the sum of n * (rate - prior mean) ** 2."""
    inside = mean * (1 - mean)
    between = (squares - (groups - 1) * inside) / F.greatest(n, F.lit(1.0))
    return F.least(F.greatest(F.when(between > 0, inside / between - 1).otherwise(F.lit(WEIGHT[1])), F.lit(WEIGHT[0])), F.lit(WEIGHT[1]))


def judge(docs: DataFrame, labels: DataFrame, site: str = "source", path: str = "lang", kept: float = KEPT) -> DataFrame:
    """doc_id, classifier, site_rate, path_rate, quality (the posterior), kept; a row for each row of docs.

    labels: doc_id and quality (1 or 0; of repeated ones the best counts). A null site or path is one of its own.
    A null text has no words. Without labels the classifier says one half of everything, and all is kept. Other
    columns are ignored.
    """
    counted = quality_rules.counts(docs, (site, path))
    rows = counted.select("doc_id", F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.array(*features()).alias("x"))
    best = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).cast("double").alias("label"))
    rows = common.stage_table(rows.join(best, "doc_id", "left"), "features")
    labelled = rows.where("label is not null")
    share = min(1.0, 0.95 * SAMPLE / max(1, labelled.count()))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(SAMPLE).select("x", "label").toPandas()
    width = len(features())
    weights = fit(np.array(sample["x"].tolist(), float).reshape(-1, width), sample["label"].to_numpy(float)) if len(sample) else np.zeros(width + 1)
    score = sum((F.col("x")[i] * F.lit(float(w)) for i, w in enumerate(weights[1:])), F.lit(float(weights[0])))
    rows = rows.select("doc_id", "site", "path", (1 / (1 + F.exp(-score))).alias("classifier"), "label").withColumn("vote", F.coalesce("label", "classifier"))

    paths = common.stage_table(rows.groupBy("site", "path").agg(F.count("*").cast("double").alias("n"), F.sum("vote").alias("s")), "paths")
    sites = paths.groupBy("site").agg(F.sum("n").alias("site_n"), F.sum("s").alias("site_s"))
    total = sites.agg(F.sum("site_n").alias("n"), (F.sum("site_s") / F.sum("site_n")).alias("mean"), F.count("*").alias("groups")).first()
    mean = F.lit(float(total["mean"] if total["mean"] is not None else 0.5))
    rate = F.col("site_s") / F.col("site_n")
    prior = sites.agg(_weight(F.sum("site_n"), F.sum(F.col("site_n") * (rate - mean) ** 2), F.count("*"), mean).alias("w")).first()["w"]
    prior = F.lit(float(prior if prior is not None else WEIGHT[1]))
    sites = sites.withColumn("site_rate", (F.col("site_s") + prior * mean) / (F.col("site_n") + prior)).select("site", "site_rate")
    known = paths.join(sites, "site")
    spread = F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("site_rate")) ** 2)
    below = known.agg(_weight(F.sum("n"), spread, F.count("*") - F.countDistinct("site") + 1, mean).alias("w")).first()["w"]
    below = F.lit(float(below if below is not None else WEIGHT[1]))

    out = rows.join(known, ["site", "path"])
    path_rate = (F.col("s") - F.col("vote") + below * F.col("site_rate")) / (F.col("n") - 1 + below)
    out = out.withColumn("path_rate", path_rate)
    out = out.withColumn("quality", 1 / (1 + F.exp(-(_logit(F.col("classifier")) + _logit(F.col("path_rate")) - _logit(mean)))))
    return out.select("doc_id", "classifier", "site_rate", "path_rate", "quality", (F.col("quality") >= kept).alias("kept"))
