"""URL rules as a bit-parallel wildcard automaton.

A rule is host/path: it fits the host, all its subdomains, and paths that begin with the rule's; `*` stands for any characters, but no
`/` in the host. As globs over the canonical URL (host in lower case and path, as bytes) these are host/path* and *.host/path*. All
globs lie one after the other in the bits of 64-bit words, a bit per character; a table has for each byte the bits whose character it
is (Shift-And), another the bits that a `*` holds on to. All rules advance at once over a batch of URLs, byte by byte, until every
glob of a URL is done or dead, so that long paths cost nothing. The longest rule that matches wins, of equally long ones the first.

The rules are a parameter of the job and go with the code. Each URL is judged by itself: there is no shuffle, and equal URLs, nulls
(no host, no path, no rule), empty and very long ones are rows like others. Columns of pages are kept; host, path, rule and verdict
replace columns of that name. An empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import kept

#: Rules and verdicts of production; what none matches is allowed.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
DEFAULT = "allow"


class Automaton:
    """The packed globs of rules; bits of one glob lie side by side, a star is no bit of its own but holds the one before it."""

    def __init__(self, rules: list[str]):
        globs = [(start + rule.encode() + b"*", i) for i, rule in enumerate(rules) for start in (b"", b"*.")]
        n = sum(len(g.replace(b"*", b"")) + 1 for g, _ in globs)
        self.words = -(-n // 64)
        takes, holds = np.zeros((256, 64 * self.words), bool), np.zeros((256, 64 * self.words), bool)
        self.first, self.last = np.zeros(64 * self.words, bool), np.zeros((len(rules), 64 * self.words), bool)
        at = 0
        for glob, i in globs:
            self.first[at] = True  # the state before the glob's first character
            in_path = False
            for byte in glob:
                if byte == ord("*"):
                    holds[:, at] = True
                    holds[ord("/"), at] = in_path
                else:
                    at += 1
                    takes[byte, at] = True
                    in_path |= byte == ord("/")
            self.last[i, at] = True
            at += 1
        pack = lambda bits: np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)
        self.takes, self.holds, self.first, self.last = pack(takes), pack(holds), pack(self.first), pack(self.last)
        self.done = np.bitwise_or.reduce(self.last, axis=0)

    def matched(self, urls: list[bytes]) -> np.ndarray:
        """For each URL and rule, whether a glob of the rule matches the whole URL."""
        sizes = np.fromiter(map(len, urls), np.int64, len(urls))
        starts, text = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(urls), np.uint8)
        state = np.tile(self.first, (len(urls), 1))
        live, at = np.flatnonzero(sizes > 0), 0
        while len(live):
            now, byte = state[live], text[starts[live] + at]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            now = moved & self.takes[byte] | now & self.holds[byte]
            state[live] = now
            at += 1
            live = live[(now & ~self.done).any(axis=1) & (sizes[live] > at)]
        return (state[:, None, :] & self.last).any(axis=2)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, default: str = DEFAULT) -> DataFrame:
    """pages(url, ...) with host, path, rule (null: none) and verdict."""
    if bad := [r for r, _ in rules if "/" not in r]:
        raise ValueError(f"rules without a path: {bad}")
    longest = sorted(rules, key=lambda r: -len(r[0]))
    patterns = [r for r, _ in longest]

    @F.pandas_udf("int")
    def which(url: pd.Series) -> pd.Series:
        found = Automaton(patterns).matched(list(url))
        return pd.Series(np.where(found.any(axis=1), found.argmax(axis=1), -1).astype(np.int32))

    rest = F.when(F.col("url").contains("://"), F.substring(F.col("url"), F.locate("://", F.col("url")) + 3, F.length("url"))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host, path = F.translate(raw, upper, lower), F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*+", 0)
    own = pages.select([c for c in kept(pages.drop("host", "path", "rule", "verdict"))] + [F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")])
    if not rules:
        return own.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    best = which(F.concat("host", "path").cast("binary"))
    names, verdicts = (F.array(*[F.lit(x[i]) for x in longest]) for i in (0, 1))
    out = own.withColumn("rule", best)
    return out.withColumns({"rule": F.when(F.col("rule") >= 0, F.get(names, "rule")), "verdict": F.when(F.col("rule") >= 0, F.get(verdicts, "rule")).otherwise(default)})
