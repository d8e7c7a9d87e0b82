"""Licence scan: Dice coefficient over word bigrams between passages of a text and licence templates.

Only DataFrame functions. Texts are normalised to lower-case words whatever their lines. A passage begins at a bigram
that the template has and is as long as the template, so notices inside a line and texts over many lines are found
alike. Size bounds prune: a passage of n bigrams and a template of m share at most min(n, m), so at threshold t only
templates of t / (2 - t) to (2 - t) / t times its size are compared, and only where as many of the template's bigrams
stand within its length as the threshold takes. Texts without any of a few words, of which every match has one, are
left out first. Templates are a parameter; their bigrams are a table of fixed size, which is broadcast.
"""

from __future__ import annotations

import json
from functools import reduce
from math import ceil, floor
from re import sub

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common
from .licence_texts import TEMPLATES

THRESHOLD = 0.8
#: Words that most texts have.
EVERYDAY = frozenset("a above after all an and any are arising as at be by can files following for form free from if in including is it law list loss made may means more must no not of on or other out particular program provided public see shall some source subject such terms that the then third this to under use used version whether which with without work you".split())
#: Words of all templates together, at most: their bigrams are broadcast.
MOST = 200_000


def _words(text: str) -> list[str]:
    return sub(r"[\W_]+", " ", text.lower()).split()


def _bigrams(text: str) -> list[str]:
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes of which a coefficient with a set of `size` can reach the threshold."""
    return ceil(threshold / (2 - threshold) * size - 1e-9), floor((2 - threshold) / threshold * size + 1e-9)


def needed(size: int, threshold: float) -> int:
    """Bigrams that a passage shares with a template of `size` at least, if it reaches the threshold."""
    return max(1, ceil(threshold / 2 * (bounds(size, threshold)[0] + size) - 1e-9))


def _table(templates: list[tuple[str, str]], threshold: float) -> list[dict]:
    rows = []
    for tid, (name, text) in enumerate(templates):
        grams = _bigrams(text)
        if grams:
            low, high = bounds(len(grams), threshold)
            rows.append({"tid": tid, "license": name, "grams": grams, "m": len(grams), "span": len(_words(text)) - 1, "low": low, "high": high, "shared": needed(len(grams), threshold)})
    if sum(r["span"] for r in rows) > MOST:
        raise ValueError(f"the templates have more than {MOST} words")
    return rows


def _keywords(rows: list[dict]) -> list[str]:
    """Words of which every passage that reaches the threshold has one, whatever its template.

    A template's passage can't miss more than m - needed bigrams, so words that stand in more than that will do; words
    that are long or in many templates are taken first, those of everyday texts last.
    """
    weight: dict[str, int] = {}
    for r in rows:
        for gram in r["grams"]:
            for w in gram.split(" "):
                weight[w] = weight.get(w, 0) + len(w)
    order = sorted(weight, key=lambda w: (w in EVERYDAY or w.isdigit(), -weight[w] if len(w) > 1 else 0, w))
    taken: set[str] = set()
    for r in sorted(rows, key=lambda r: r["m"]):
        for w in order:
            if sum(not taken.isdisjoint(g.split(" ")) for g in r["grams"]) > r["m"] - r["shared"]:
                break
            if any(w in g.split(" ") for g in r["grams"]):
                taken.add(w)
    return sorted(taken)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line_no (from 0, where the passage begins), license, dice: the passages that reach the threshold.

    Of a licence's passages that overlap, that with the largest coefficient counts, of equal ones the first; then, of
    overlapping passages of all licences, that with the largest coefficient, of equal ones the longest template, then the
    last name in order. A null or empty text has no words; repeated rows give their passages again; other columns are
    ignored. Words are runs of letters and digits, bigrams count once per passage.
    """
    rows, spark = _table(templates, threshold), docs.sparkSession
    if not rows:
        return docs.select(common.long_id(docs, "doc_id").alias("doc_id"), F.lit(0).alias("line_no"), F.lit("").alias("license"), F.lit(0.0).alias("dice")).where("false")
    form = "array<struct<tid: int, license: string, grams: array<string>, m: int, span: int, low: int, high: int, shared: int>>"
    known = spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), form)).alias("x")).select("x.*")
    longest = max(r["span"] for r in rows)

    lower = docs.select(common.long_id(docs, "doc_id").alias("doc_id"), F.lower(docs["text"].cast("string")).alias("text"))
    lower = lower.where(reduce(Column.__or__, (F.contains("text", F.lit(w)) for w in _keywords(rows))))
    lines = F.transform(F.split("text", "\n"), lambda line: F.filter(F.split(F.regexp_replace(line, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != ""))
    words = F.flatten(F.transform(lines, lambda own, i: F.transform(own, lambda w: F.struct(i.alias("line_no"), w.alias("w")))))
    lower = lower.select("doc_id", words.alias("w")).where(F.size("w") > 1)
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.struct(a.line_no.alias("line_no"), F.concat_ws(" ", a.w, b.w).alias("gram")))
    texts = common.stage_table(lower.select(F.monotonically_increasing_id().alias("row"), "doc_id", pairs.alias("pairs")), "licence-texts")

    at = texts.select("row", F.posexplode("pairs").alias("at", "pair")).select("row", "at", "pair.gram")
    at = at.join(F.broadcast(known.select("tid", "span", "shared", F.explode("grams").alias("gram"))), "gram")
    ahead = F.collect_list("at").over(Window.partitionBy("row", "tid").orderBy("at").rangeBetween(0, longest))
    at = at.withColumn("_ahead", ahead).where(F.size(F.filter("_ahead", lambda x: x < F.col("at") + F.col("span"))) >= F.col("shared"))

    own = at.select("row", "tid", "at").join(texts, "row").join(F.broadcast(known), "tid")
    own = own.withColumn("passage", F.array_distinct(F.transform(F.slice("pairs", F.col("at") + 1, F.col("span")), lambda x: x.gram)))
    own = own.select("row", "doc_id", "tid", "license", "m", "span", "at", F.get("pairs", F.col("at")).line_no.alias("line_no"), F.size("passage").alias("n"), F.size(F.array_intersect("passage", "grams")).alias("common"), "low", "high")
    own = own.where(F.col("n").between(F.col("low"), F.col("high"))).withColumn("dice", 2.0 * F.col("common") / (F.col("n") + F.col("m"))).where(F.col("dice") >= threshold)

    def no_better(rows: DataFrame, keys: list[str], better) -> DataFrame:
        """Rows without a better one among those that overlap them; a passage covers at to at + span."""
        near = F.collect_list(F.struct("at", "span", "dice", "m", "license")).over(Window.partitionBy(*keys).orderBy("at").rangeBetween(-longest, longest))
        rows = rows.withColumn("_near", near)
        return rows.where(~F.exists("_near", lambda x: (x["at"] <= F.col("at") + F.col("span")) & (F.col("at") <= x["at"] + x["span"]) & better(x))).drop("_near")

    own = no_better(own, ["row", "tid"], lambda x: (x["dice"] > F.col("dice")) | ((x["dice"] == F.col("dice")) & (x["at"] < F.col("at"))))
    own = no_better(own, ["row"], lambda x: F.struct(x["dice"], x["m"], x["license"]) > F.struct("dice", "m", "license"))
    return own.select("doc_id", "line_no", "license", "dice")


def oracle_sql() -> str:
    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    rows = ", ".join(f"({r['tid']}, {text(r['license'])}, [{', '.join(map(text, r['grams']))}], {r['m']}, {r['span']})" for r in _table(TEMPLATES, THRESHOLD))
    overlap = "b.pos <= a.pos + a.span AND a.pos <= b.pos + b.span"
    return rf"""
WITH templates(tid, license, grams, m, span) AS (VALUES {rows}),
l AS (SELECT row, doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT row_number() OVER () AS row, doc_id, string_split(lower(text), chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
v AS (SELECT row, doc_id, line_no, list_filter(string_split(regexp_replace(line, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS own FROM l),
w AS (SELECT row, doc_id, line_no, unnest(range(len(own))) AS i, unnest(own) AS w FROM v),
g AS (SELECT row, doc_id, line_no, pos, w || ' ' || after AS gram FROM (SELECT *, row_number() OVER o - 1 AS pos, lead(w) OVER o AS after FROM w WINDOW o AS (PARTITION BY row ORDER BY line_no, i)) WHERE after IS NOT NULL),
k AS (SELECT tid, license, m, span, unnest(grams) AS gram FROM templates),
h AS MATERIALIZED (SELECT row, doc_id, line_no, pos, tid, license, m, span FROM g JOIN k USING (gram)),
p AS (SELECT a.row, a.doc_id, a.line_no, a.pos, a.tid, any_value(a.license) AS license, any_value(a.m) AS m, any_value(a.span) AS span FROM h a JOIN h b ON b.row = a.row AND b.tid = a.tid AND b.pos BETWEEN a.pos AND a.pos + a.span - 1 GROUP BY ALL HAVING count(*) >= 0.6 * any_value(a.m)),
d AS (SELECT p.row, p.doc_id, p.line_no, p.pos, p.tid, p.license, p.m, p.span, count(DISTINCT g.gram) AS n, count(DISTINCT g.gram) FILTER (g.gram IN (SELECT gram FROM k WHERE k.tid = p.tid)) AS c FROM p JOIN g ON g.row = p.row AND g.pos BETWEEN p.pos AND p.pos + p.span - 1 GROUP BY ALL),
e AS MATERIALIZED (SELECT *, 2.0::DOUBLE * c / (n + m) AS dice FROM d WHERE 2.0::DOUBLE * c / (n + m) >= {THRESHOLD}::DOUBLE),
f AS MATERIALIZED (SELECT * FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.row = a.row AND b.tid = a.tid AND {overlap} AND (b.dice > a.dice OR b.dice = a.dice AND b.pos < a.pos)))
SELECT doc_id, line_no::INTEGER AS line_no, license, dice FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.row = a.row AND {overlap} AND (b.dice, b.m, b.license) > (a.dice, a.m, a.license))"""
