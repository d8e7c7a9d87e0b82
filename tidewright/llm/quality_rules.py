"""Quality rules with risk-controlled cutoffs.

A rule rejects a document whose value per word (or per letter) exceeds a cutoff. Which cutoff, is decided per
stratum on a labelled holdout: along a rule's cutoffs from the mildest on, the exact binomial test asks whether
the share of good documents that it rejects is certainly below the risk; the first cutoff that fails ends the
row, so testing along it costs nothing. Bonferroni's correction covers strata and rules, and the risk is shared
among the rules: with probability 1 - delta, no stratum loses more than `risk` of its good documents. Among
certified cutoffs the one that parts bad from good best is taken; without one, the rule does not apply there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .rolling import IS_SPACE, WINDOW, Words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_upper")
#: name, count, what it is divided by, cutoffs from the mildest to the strictest
RULES = (
    ("symbols", "n_symbols", "n_words", (1.0, 0.8, 0.6, 0.4, 0.2, 0.1)),
    ("marks", "n_marks", "n_words", (2.0, 1.5, 1.0, 0.6, 0.3, 0.1)),
    ("upper", "n_upper", "word_chars", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2)),
    ("length", "word_chars", "n_words", (14.0, 12.0, 10.0, 9.0, 8.0, 7.0)),
    ("lines", "n_dup_lines", "n_words", (0.1, 0.05, 0.03, 0.02, 0.01, 0.005)),
    ("repeats", "n_repeat_words", "n_words", (0.45, 0.4, 0.3, 0.2, 0.1, 0.05)),
)
RISK, DELTA = 0.05, 0.05
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def counts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of COUNTS and those named in `keep`, a row for each row of docs; null text: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("quality rules")
        for batch in common.chunks(batches, "text", 1 << 20):
            texts = batch.column(batch.schema.get_field_index("text"))
            w = Words(texts)
            data, at, n = w.data, w.offsets, np.diff(w.first)

            def per_text(mask: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
                return sums[at[1:]] - sums[at[:-1]]

            places = w.whole(3)
            doc, hashes = w.doc[places], w.windows(3, WINDOW)[places]
            order = np.lexsort((hashes, doc))
            same = (doc[order[1:]] == doc[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
            twice = np.zeros(len(order), bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            cover = np.zeros(len(w.hash), bool)
            for k in range(3):
                cover[places[twice] + k] = True
            repeats = np.bincount(w.doc[cover], minlength=len(n))
            dups = []
            for text in texts.to_pylist():
                lines = [x for x in text.split(b"\n") if x.strip()]
                dups.append(len(lines) - len(set(lines)))
            found = [n, per_text(~IS_SPACE[data] & ((data & 0xC0) != 0x80)), per_text(_SYMBOL[data]), dups, repeats, per_text(data == ord("!")), per_text((data >= ord("A")) & (data <= ord("Z")))]
            own = common.batch_of(", ".join(f"{c} long" for c in COUNTS), [np.asarray(x, np.int64) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *own.columns, *[batch.column(batch.schema.get_field_index(c)) for c in keep]], names=["doc_id", *COUNTS, *keep])

    rows = docs.select(common.long_id(docs, "doc_id").alias("doc_id"), *[c for c in keep if c != "text"], common.utf8("text").alias("text"))
    form = ["doc_id long", *[f"{c} long" for c in COUNTS], *[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]]
    return rows.mapInArrow(run, ", ".join(form))


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def exceeds(rule: tuple, cutoff) -> F.Column:
    return F.col(rule[1]) > F.lit(cutoff) * F.col(rule[2])


@F.pandas_udf(T.DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X <= k) of X binomial in n and p: the chance of so few rejections were the share as high as p."""
    from math import exp, lgamma, log, log1p

    def tail(k: int, n: int, p: float) -> float:
        return sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1)) if k < n * p else 1.0

    return pd.Series([tail(*x) for x in zip(k, n, p, strict=True)], dtype=float)


def cutoffs(counted: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: the certified cutoffs. labels: doc_id, quality (1: good); the best counts if repeated."""
    best = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = counted.where(~base_failed()).join(best, "doc_id").withColumn("stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    good, bad = F.col("quality") == 1, F.col("quality") != 1
    tests = [F.struct(F.lit(r[0]).alias("rule"), F.lit(c).alias("cutoff"), F.count_if(good & exceeds(r, c)).alias("k"), F.count_if(bad & exceeds(r, c)).alias("caught")) for r in RULES for c in r[3]]
    seen = held.groupBy("stratum").agg(F.count_if(good).alias("n"), F.count_if(bad).alias("n_bad"), F.array(*tests).alias("tests"))
    seen = common.stage_table(seen, "holdout")
    level = delta / (len(RULES) * max(1, seen.count()))
    rows = seen.select("stratum", "n", "n_bad", F.explode("tests").alias("t")).select("stratum", "n", "n_bad", "t.*")
    rows = rows.withColumn("certain", binomial_tail("k", "n", F.lit(risk / len(RULES))) <= level)
    ends = rows.groupBy("stratum", "rule").agg(F.max(F.when(~F.col("certain"), F.col("cutoff"))).alias("fails"))
    rows = rows.join(ends, ["stratum", "rule"]).where("fails is null or cutoff > fails")
    parts = rows.withColumn("gain", F.col("caught") * F.col("n") - F.col("k") * F.col("n_bad")).where("gain > 0")
    return parts.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("best")).select("stratum", "rule", F.col("best.cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, COUNTS, base_failed, failed_rule (the first that rejects, else null), kept, and the columns of `keep`.

    Every row of docs gets a verdict, those without a label as well; repeated rows get the same one. A null
    stratum is one of its own, and so is "". A stratum without enough good labels keeps what the base rules keep.
    An empty or unlabelled table has no certified cutoff.
    """
    counted = common.stage_table(counts(docs, (stratum,)), "counts")
    chosen = common.stage_table(cutoffs(counted, labels, stratum, risk, delta), "cutoffs")
    if set(keep) - {stratum}:  # counted again rather than written with the texts
        counted = counts(docs, tuple(dict.fromkeys((stratum, *keep))))
    wide = chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r[0], F.col("cutoff"))).alias(f"cutoff_{r[0]}") for r in RULES])
    rows = counted.withColumn("stratum", F.coalesce(F.col(stratum).cast("string"), F.lit(""))).join(wide, "stratum", "left")
    failed = F.coalesce(*[F.when(exceeds(r, F.col(f"cutoff_{r[0]}")), F.lit(r[0])) for r in RULES])
    rows = rows.withColumn("base_failed", base_failed()).withColumn("failed_rule", F.when(~F.col("base_failed"), failed))
    return rows.select("doc_id", *COUNTS, "base_failed", "failed_rule", (~F.col("base_failed") & F.col("failed_rule").isNull()).alias("kept"), *[F.col(c).cast(docs.schema[c].dataType).alias(c) for c in keep])


def oracle_sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    tests = ", ".join(f"('{r[0]}', {c!r}, '{r[1]}', '{r[2]}')" for r in RULES for c in r[3])
    value = lambda c: "CASE " + " ".join(f"WHEN {c} = '{x}' THEN {x}" for x in COUNTS) + " END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, stratum, t, regexp_extract_all(t, '{word}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS gram FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
c AS (SELECT w.doc_id, stratum, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  (length(t) - length(replace(t, '!', '')))::BIGINT AS n_marks, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper FROM w LEFT JOIN p ON w.doc_id = p.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
rules(rule, cutoff, top, bottom) AS (VALUES {tests}),
x AS (SELECT b.*, rule, cutoff, {value("top")} > cutoff::DOUBLE * {value("bottom")} AS hit FROM b, rules),
l AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
s AS (SELECT stratum, rule, cutoff::DOUBLE AS cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality <> 1) AS n_bad, count(*) FILTER (quality = 1 AND hit) AS k, count(*) FILTER (quality <> 1 AND hit) AS caught
  FROM x JOIN l USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
v AS (SELECT *, CASE WHEN k < n * {RISK / len(RULES)!r} THEN list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1) END + i * ln({RISK / len(RULES)!r}) + (n - i) * ln(1 - {RISK / len(RULES)!r})))) ELSE 1.0 END
  <= {DELTA!r} / ({len(RULES)} * (SELECT count(DISTINCT stratum) FROM s)) AS certain FROM s),
f AS (SELECT stratum, rule, max(cutoff) FILTER (NOT certain) AS fails FROM v GROUP BY ALL),
q AS (SELECT stratum, rule, arg_max(cutoff, (caught * n - k * n_bad) * 1000 + cutoff) AS cutoff FROM v JOIN f USING (stratum, rule) WHERE (fails IS NULL OR cutoff > fails) AND caught * n - k * n_bad > 0 GROUP BY ALL),
j AS (SELECT doc_id, bool_or(hit) AS hit FROM x JOIN q ON x.stratum = q.stratum AND x.rule = q.rule AND x.cutoff::DOUBLE = q.cutoff GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(hit, false) AS kept FROM b LEFT JOIN j ON b.doc_id = j.doc_id"""
