"""Secret scans: an incremental ledger of blobs.

Every version of a document is known by its content's SHA-256 (a blob), whatever path and version it stands at. The
ledger is a table of blobs and the rule versions that have scanned them, with the spans they found. A scan takes the
blobs of what it is given, looks up which rules each of them still lacks, reads just these pairs, once for each blob,
and adds their spans. Findings are joined back to every path and version that has the blob. A text is dealt by its
blob; equal texts are one row before they are dealt.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPAN = "struct<kind:string,start:int,end:int>"
#: A row for each scan of a blob: the rule versions that it took and what they found.
LEDGER = f"blob binary, rules array<string>, spans array<{SPAN}>"
ARROW_LEDGER = pa.schema([("blob", pa.binary()), ("rules", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])
ASSIGNED = "password|passwd|secret|token|api_?key"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern (group 0 is the span), the least length of a group, and texts one of which it needs.

    Patterns use what Python's and SQL's engines read alike: no look-around, no back references. A new version of a
    rule has the blobs scanned again; old versions' spans stay in the ledger and are no longer read.
    """

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    needs: tuple[str, ...] = field(default=())
    fold: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str, folded: str) -> Iterator[tuple[int, int]]:
        """Leftmost matches that don't overlap; those whose group is too short are dropped, not tried again."""
        if self.needs and not any(x in (folded if self.fold else text) for x in self.needs):
            return
        for m in re.finditer(self.pattern, text, re.ASCII | (re.IGNORECASE if self.fold else 0)):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


#: A run shorter than sixteen can't be part of a longer one, so the least length stands in the pattern.
BASE = (
    Rule("assign", 1, rf"""(?:{ASSIGNED})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1, ("passw", "secret", "token", "apikey", "api_key"), True),
    Rule("access", 1, "AKIA[A-Z0-9]+", 18, 0, ("AKIA",)),
    Rule("hex", 1, "[0-9a-f]{16,}"),
)
#: Public formats of credentials.
MORE = (
    Rule("private_key", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", needs=("PRIVATE KEY-----",)),
    Rule("signed_token", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", needs=("eyJ",)),
    Rule("forge_token", 1, "gh[opsur]_[A-Za-z0-9]+", 40, needs=("gh",)),
    Rule("chat_token", 1, "xox[abprs]-[A-Za-z0-9-]+", 20, needs=("xox",)),
    Rule("cloud_key", 1, "AIza[A-Za-z0-9_-]+", 39, needs=("AIza",)),
    Rule("url_login", 1, r"://[^\x20/:@\x09-\x0D]+:[^\x20/:@\x09-\x0D]+@", needs=("://",)),
)


def find(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """Spans in code points, by start, then in the rules' order."""
    folded = text.lower()
    found = [(start, k, end) for k, r in enumerate(rules) for start, end in r.spans(text, folded)]
    return [(rules[k].kind, start, end) for start, k, end in sorted(found)]


def blob(text: str | Column) -> Column:
    """The content's address; a null text has that of an empty one."""
    return F.unhex(F.sha2(common.utf8(text), 256))


class Ledger:
    """A folder of LEDGER tables, one for each scan; a scan that fails leaves none that is read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def rows(self) -> DataFrame:
        """What all finished scans have written."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = system.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/scan-*/_SUCCESS"))
        folders = [f"{self.folder}/{x.getPath().getParent().getName()}" for x in done or []]
        return self.spark.read.schema(LEDGER).parquet(*folders) if folders else self.spark.createDataFrame([], LEDGER)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
        """Scans the blobs of versions[text] with the rules they lack; returns what was added to the ledger.

        A null text counts as an empty one; repeated rows and equal texts of other paths are scanned once; texts are
        scanned whole, however long (one must fit an Arrow batch); an empty table adds nothing; other columns don't
        matter.
        """
        seen, every = self.rows(), F.lit([r.name for r in rules])
        # equal texts are one row before the shuffle, so a text that fills a third of the table is one row of each task
        contents = versions.select(blob(versions[text]).alias("blob"), F.coalesce(versions[text].cast("string"), F.lit("")).alias("content")).groupBy("blob").agg(F.first("content").alias("content"))
        if seen.head(1):
            had = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("had"))
            contents = contents.join(had, "blob", "left")
            every = F.array_except(every, F.coalesce("had", F.array().cast("array<string>")))
        lacking = contents.select("blob", "content", every.alias("rules")).where(F.size("rules") > 0)
        by_name = {r.name: r for r in rules}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.begin("secret scan")
            for batch in common.chunks(batches, "content"):
                wanted = common.values(batch, "rules")
                found = [find(t, tuple(by_name[r] for r in own)) for t, own in zip(common.values(batch, "content"), wanted, strict=True)]
                spans = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in own] for own in found]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((common.values(batch, "blob"), wanted, spans), ARROW_LEDGER, strict=True)], schema=ARROW_LEDGER)

        path = f"{self.folder}/scan-{uuid.uuid4().hex}"
        lacking.mapInArrow(run, LEDGER).write.parquet(path)
        return self.spark.read.schema(LEDGER).parquet(path)

    def findings(self, versions: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
        """The rows of versions without their text, with `blob` and `spans`, by start, then in the rules' order.

        Every row is returned, repeated ones and null ids as well; where nothing is found, spans is empty. A rule's
        spans are those of its present version. Columns named blob or spans are replaced. Only blobs with spans are
        joined; one that a third of the rows have is a skewed key of a left join, which Spark parts at run time.
        """
        name_of = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.name)])
        place = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)])
        own = self.rows().where(F.size("spans") > 0)
        valid = F.filter("spans", lambda s: F.array_contains("rules", F.element_at(name_of, s["kind"])))
        keyed = F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.element_at(place, s["kind"]).alias("place"), s["kind"].alias("kind"), s["end"].alias("end")))
        merged = own.select("blob", keyed.alias("keyed")).where(F.size("keyed") > 0).groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("keyed")))).alias("keyed"))
        merged = merged.select("blob", F.transform("keyed", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"))
        merged = common.stage_table(merged, "findings")  # so that the join's sides come from shuffles, which Spark can part
        left = versions.select(*[versions[c] for c in versions.columns if c not in (text, "blob", "spans", "found")], blob(versions[text]).alias("blob"))
        return left.join(merged, "blob", "left").withColumn("spans", F.coalesce("found", F.array().cast(f"array<{SPAN}>"))).drop("found")


def of_kinds(spans: Column | str, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def listed(spans: Column | str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def oracle_sql() -> str:
    """Places follow from the lengths of what lies between the matches."""

    def kind(k: int, rule: Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        if rule.fold:
            pattern = pattern.replace(ASSIGNED, re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", ASSIGNED))
        return f"""SELECT id, {k} AS k, '{rule.kind}' AS kind, p, m, g, {rule.least} AS least FROM (
  SELECT id, regexp_split_to_array(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS g FROM docs) WHERE len(m) > 0"""

    base = ", ".join(f"'{r.kind}'" for r in BASE)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
matched AS ({" UNION ALL ".join(kind(k, r) for k, r in enumerate((*BASE, *MORE)))}),
places AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM matched),
spans AS (SELECT id, k, kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, length(m[i]) AS size FROM places WHERE length(g[i]) >= least),
named AS (SELECT id, k, kind, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT) AS span FROM spans),
each AS (SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(span, ',' ORDER BY start, k) FILTER (kind IN ({base})), '') AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM named GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN each USING (id)"""
