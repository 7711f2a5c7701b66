"""URL filters by a bit-parallel wildcard automaton.

Every rule is a glob.  All rules' positions are packed, one bit each, into a few
64-bit words; one Shift-And step a byte moves all rules of all URLs of a batch
at once.  A rule of a domain and a path becomes the glob "any subdomain, dot,
domain, end of host, path, anything"; the byte 0xFF, which UTF-8 never has, ends
the host in the canonical form, so a domain is never found in a path.

Edge cases: a null URL, or one without "://", has an empty host and an empty
path; an empty path fits no rule, as it does not start with "/".  Of several
fitting domain rules the longest wins, of equally long ones the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

HOST_END = 0xFF

#: (verdict, host, path): fixed values of the contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Globs over host and path that block a URL without a fitting domain rule; ``*`` any run, ``?`` one byte.
BLOCKED = ("*adult*", "*casino*", "*porn*", "*ads-*", "*/ads/*", "*-track.*")


class Automaton:
    """Shift-And masks of many globs.  A glob is a list of ("byte", b), ("any",), ("star",) or ("hoststar",)."""

    def __init__(self, globs: list[list[tuple]]):
        bits: list[tuple[object, str | None]] = []
        self.starts, self.finals = [], []
        for glob in globs:
            self.starts.append(len(bits))
            bits.append((None, None))
            for item in glob:
                if item[0] in ("star", "hoststar"):
                    bits[-1] = (bits[-1][0], "star" if "star" in (item[0], bits[-1][1]) else "hoststar")
                else:
                    bits.append((item[1] if item[0] == "byte" else "any", None))
            self.finals.append(len(bits) - 1)
        self.words = -(-max(1, len(bits)) // 64)
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        for i, (what, star) in enumerate(bits):
            w, mask = i // 64, np.uint64(1 << (i % 64))
            if what == "any":
                self.step[:HOST_END, w] |= mask
            elif what is not None:
                self.step[what, w] |= mask
            if star:
                self.stay[:, w] |= mask
                if star == "hoststar":
                    self.stay[HOST_END, w] &= ~mask
        for i in self.starts:
            self.first[i // 64] |= np.uint64(1 << (i % 64))

    def fits(self, texts: list[bytes]) -> np.ndarray:
        """Which globs fit which whole texts: (texts, globs)."""
        n = len(texts)
        sizes = np.array([len(t) for t in texts], int)
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = (np.cumsum(sizes) - sizes)[order]
        live = n - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), side="right")
        state = np.tile(self.first, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        for j, m in enumerate(live.tolist()):
            c = flat[begin[:m] + j]
            d = state[:m]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[:m] = (moved & self.step[c]) | (d & self.stay[c])
        out = np.zeros((n, len(self.finals)), bool)
        for k, i in enumerate(self.finals):
            out[order, k] = (state[:, i // 64] >> np.uint64(i % 64)) & one != 0
        return out


def rule_glob(host: str, path: str) -> list[tuple]:
    body = b"." + host.encode() + bytes([HOST_END]) + path.encode()
    return [("hoststar",), *(("byte", b) for b in body), ("star",)]


def text_glob(glob: str) -> list[tuple]:
    special = {ord("*"): ("star",), ord("?"): ("any",)}
    return [("byte", HOST_END - 1), *(special.get(b) or ("byte", b) for b in glob.encode())]


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:stop], rest[stop:]
    end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), tail[:end]


class Filter:
    """Domain rules that decide, and globs for what they leave open."""

    def __init__(self, rules=RULES, blocked=BLOCKED):
        self.rules, self.blocked = list(rules), list(blocked)
        self.domain = Automaton([rule_glob(h, p) for _, h, p in self.rules])
        self.text = Automaton([text_glob(g) for g in self.blocked])

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
        """(host, path, rule, verdict) of every URL."""
        split = [parts(u) for u in urls]
        raw = [(h.encode("utf-8", "surrogatepass"), p.encode("utf-8", "surrogatepass")) for h, p in split]
        fits = self.domain.fits([b"." + h + bytes([HOST_END]) + p for h, p in raw])
        bad = self.text.fits([bytes([HOST_END - 1]) + h + p for h, p in raw]).any(1)
        length = np.array([len(h + p) for _, h, p in self.rules])
        best = np.where(fits, length, -1).argmax(1) if len(length) else np.zeros(len(urls), int)
        out = []
        for (host, path), hit, k, blocked in zip(split, fits.any(1), best, bad):
            if hit:
                verdict, h, p = self.rules[k]
                out.append((host, path, h + p, verdict))
            else:
                out.append((host, path, None, "block" if blocked else "allow"))
        return out


def judge(pages: DataFrame, rules=RULES, blocked=BLOCKED) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Filter(rules, blocked).judge
        for batch in batches:
            out = pd.DataFrame(judge(batch["url"].tolist()), columns=["host", "path", "rule", "verdict"])
            out.insert(0, "page_id", batch["page_id"].to_numpy())
            yield out

    return pages.select("page_id", "url").mapInPandas(run, schema)


def op6_urls(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


def allowed(pages: DataFrame, rules=RULES, blocked=BLOCKED) -> DataFrame:
    """The rows of ``pages`` whose URL is allowed, all columns kept."""
    names, schema = pages.columns, pages.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Filter(rules, blocked).judge
        for batch in batches:
            verdicts = judge(batch["url"].tolist())
            yield batch[np.array([v[3] == "allow" for v in verdicts], bool)][names]

    return pages.mapInPandas(run, schema)


_GLOB_SQL = " OR ".join("hp LIKE '" + g.replace("*", "%").replace("?", "_") + "'" for g in BLOCKED)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM a),
c AS (SELECT page_id, translate(raw_host, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM b),
r(verdict, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
m AS (SELECT c.page_id, c.host, c.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS v
      FROM c LEFT JOIN r ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN {_GLOB_SQL} THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT *, host || path AS hp FROM m)
"""
