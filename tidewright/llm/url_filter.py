"""URL filters: glob rules as one bit-parallel Shift-And automaton over many machine words.

All patterns stand end to end in one mask, a bit for each symbol; a star is no symbol but lets the state before
it stay. One step per character moves the states of every pattern, for every URL of a batch, at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Stands between host and path for globs that hold it: a byte that UTF-8 has not, so no URL has it.
BETWEEN = "\udcff"


@dataclass(frozen=True)
class Rule:
    """name; verdict (block or allow); the glob over the canonical URL: a dot, the host, the path.

    A glob with BETWEEN in it is matched with BETWEEN between host and path, so its star can't lead from one to the other.
    """

    name: str
    verdict: str
    glob: str

    @staticmethod
    def of_site(verdict: str, site: str) -> "Rule":
        """Host and path prefix: fits the host and all its subdomains, and each path that starts so."""
        own_host, slash, own_path = site.replace("*", "").partition("/")
        return Rule(site, verdict, f"*.{own_host}{BETWEEN}{slash}{own_path}*")


class Automaton:
    """'*' stands for any bytes, '?' for one byte, anything else for itself; a glob fits the whole text."""

    def __init__(self, globs: list[str]):
        coded = [g.encode(errors="surrogateescape") for g in globs]
        symbols = [g.replace(b"*", b"") for g in coded]
        sizes = [len(s) for s in symbols]
        self.words = max(1, -(-sum(sizes) // 64))
        self.chars = np.zeros((256, self.words), np.uint64)
        self.loops, self.first, self.at_start, self.always = (np.zeros(self.words, np.uint64) for _ in range(4))
        self.ends: list[tuple[int, int] | None] = []  # word and bit of the last symbol; None: a glob of stars
        self.empty = [g == "" for g in globs]
        at = 0
        for glob, size in zip(coded, sizes, strict=True):
            bit = at
            for c in glob:
                word, mask = bit // 64, np.uint64(1 << bit % 64)
                if c == ord("*"):
                    if bit > at:
                        self.loops[(bit - 1) // 64] |= np.uint64(1 << (bit - 1) % 64)
                    continue
                if c == ord("?"):
                    self.chars[:, word] |= mask
                else:
                    self.chars[c, word] |= mask
                bit += 1
            if size:
                word, mask = at // 64, np.uint64(1 << at % 64)
                self.first[word] |= mask
                (self.always if glob.startswith(b"*") else self.at_start)[word] |= mask
            self.ends.append(((at + size - 1) // 64, (at + size - 1) % 64) if size else None)
            at += size

    def match(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text, a column for each glob."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order])
        state = np.zeros((len(texts), self.words), np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        for t in range(int(lengths[0]) if len(texts) else 0):
            live = int(np.searchsorted(-lengths, -t, "left"))  # those longer than t
            s = state[:live]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            moved &= ~self.first
            moved |= self.always if t else self.always | self.at_start
            state[:live] = (moved & self.chars[data[begin[:live] + t]]) | (s & self.loops)
        out = np.zeros((len(texts), len(self.ends)), bool)
        for k, end in enumerate(self.ends):
            out[order, k] = (state[:, end[0]] >> np.uint64(end[1]) & one).astype(bool) if end else (lengths == 0) | (not self.empty[k])
        return out


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased; none of them: empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: tuple[Rule, ...], otherwise: tuple[Rule, ...] = (), keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """host, path, rule, verdict and the columns of `keep` for each row of pages (by its url).

    Of the rules that fit, the one with the longest name decides (of equals, the first). If none fits, rule is
    null and the first fitting glob of `otherwise` gives the verdict, else it is "allow". A null or empty url, or
    one without ://, has an empty host and path. Repeated rows are judged alike; the number of rules is a
    parameter, not data, so the automaton's size is known.
    """
    machine_rules = [*rules, *otherwise]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parted = np.array([BETWEEN in r.glob for r in machine_rules], bool)
        machines = [(own, Automaton([machine_rules[k].glob for k in own]), sign) for own, sign in ((np.flatnonzero(parted), BETWEEN.encode(errors="surrogateescape")), (np.flatnonzero(~parted), b"")) if len(own)]
        rank = sorted(range(len(rules)), key=lambda k: (-len(rules[k].name), k)) + list(range(len(rules), len(machine_rules)))
        for batch in batches:
            at = len(keep)
            parts = list(zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(at + 1).cast(pa.binary()).to_pylist(), strict=True))
            fits = np.zeros((len(parts), len(machine_rules)), bool)
            for own, machine, sign in machines:
                fits[:, own] = machine.match([b"." + h + sign + p for h, p in parts])
            fits = fits[:, rank]
            best = np.where(fits.any(axis=1), fits.argmax(axis=1), -1) if machines else np.full(len(parts), -1)
            chosen = [machine_rules[rank[b]] if b >= 0 else None for b in best.tolist()]
            own = common.batch_of("rule string, verdict string", [[r.name if r and b < len(rules) else None for r, b in zip(chosen, best.tolist(), strict=True)], [r.verdict if r else "allow" for r in chosen]])
            yield pa.RecordBatch.from_arrays([*batch.columns, *own.columns], names=[*keep, "host", "path", "rule", "verdict"])

    rows = pages.select(*keep, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    form = [*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep], "host string, path string, rule string, verdict string"]
    return rows.mapInArrow(run, ", ".join(form))


#: The rules of the registered query, and the globs that judge what they leave open.
SITES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
SPAM = (
    "*cheap-pills.*", "*spam-farm.*", "*casino*.*", "*.doubleclick.*", "*.adserver.*", "*.bet365.*", "*poker-online*", "*online-poker*", "*slot-machine*", "*sports-betting*", "*payday-loan*", "*replica-watch*", "*cheap-viagra*", "*buy-viagra*",
    "*free-crack*", "*keygen-*", "*warez*.*", "*torrent-download*", "*xxx-*.*", "*.xxx/*", "*adult-cam*", "*escort-service*", "*link-farm*", "*seo-backlinks*", "*click-track*", "*essay-writing-service*", "*work-from-home-jobs*",
    "*/wp-login.php*", "*/xmlrpc.php*", "*/cgi-bin/*", "*/trackback/", "*/calendar/????-??-??*", "*/tag/*/page/*", "*/search/*/page/*", "*/print/*", "*/feed/", "*/amp/amp/*", "*//*//*//*",
)


def oracle_sql() -> str:
    rule = "CASE " + " ".join(
        f"WHEN (host = '{s.split('/')[0]}' OR ends_with(host, '.{s.split('/')[0]}')) AND starts_with(path, '/{s.split('/', 1)[1]}') THEN '{s}'" for _, s in sorted(SITES, key=lambda x: -len(x[1]))
    ) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{s}' THEN '{v}'" for v, s in SITES)
    spam = " OR ".join(f"('.' || host || path) LIKE '{g.replace('*', '%').replace('?', '_')}'" for g in SPAM)
    return f"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']) AS x FROM pages),
h AS (SELECT page_id, translate(x.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, x.p AS path FROM u),
r AS (SELECT *, {rule} AS rule FROM h)
SELECT page_id, host, path, rule, {verdict} WHEN {spam} THEN 'block' ELSE 'allow' END AS verdict FROM r"""
