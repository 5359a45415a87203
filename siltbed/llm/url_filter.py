"""URL filters: all wildcard rules simulated at once by a multiword Shift-And automaton.

Rules are globs over the canonical url ``.host/path``: ``*`` stands for any bytes but ``/``,
``**`` for any bytes. Every pattern owns consecutive bits of one bit string (several 64-bit
words); a step per byte moves all patterns of all urls of a batch with a few word operations.
Patterns lie in the order of their rank, so the lowest accepting bit names the winning rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path`` (empty: any path)."""

    verdict: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        host = self.host.translate({c: c + 32 for c in range(65, 91)})
        if self.path:
            return [f"*.{host}{self.path}**"]
        return [f"*.{host}", f"*.{host}/**"]


class ShiftAnd:
    """A bit-parallel automaton for ``globs``; ``match`` gives each text's first fitting glob."""

    def __init__(self, globs: list[str]):
        consume: list[np.ndarray] = []  # per bit: the bytes that enter it
        loop: list[np.ndarray] = []  # per bit: the bytes that keep it
        start, accept, self.owner = [], [], []
        slash = np.ones(256, bool)
        slash[ord("/")] = False
        for k, glob in enumerate(globs):
            start.append(len(consume))
            consume.append(np.zeros(256, bool))
            loop.append(np.zeros(256, bool))
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i] == ord("*"):
                    double = raw[i + 1 : i + 2] == b"*"
                    loop[-1] = loop[-1] | (np.ones(256, bool) if double else slash)
                    i += 1 + double
                    continue
                one = np.zeros(256, bool)
                one[raw[i]] = True
                consume.append(one)
                loop.append(np.zeros(256, bool))
                i += 1
            accept.append(len(consume) - 1)
            self.owner += [k] * (len(consume) - len(self.owner))
        bits = len(consume)
        self.words = max(1, -(-bits // 64))
        self.enter, self.keep = self._masks(consume), self._masks(loop)
        self.first, self.accept = self._bits(start), self._bits(accept)
        self.settled = self._bits([b for b in accept if loop[b].all()])
        self.owner = np.asarray(self.owner + [-1] * (64 * self.words - bits))

    def _bits(self, positions: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in positions:
            out[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return out

    def _masks(self, classes: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((256, self.words), np.uint64)
        for b, members in enumerate(classes):
            out[members, b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return out

    def match(self, texts: list[bytes]) -> np.ndarray:
        """The index of the first glob that fits each text, or -1."""
        n = len(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1])) if n else np.zeros(0, np.int64)
        flat = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        final = np.zeros((n, self.words), np.uint64)
        rows = np.arange(n)
        state = np.tile(self.first, (n, 1))
        at = 0
        while len(rows):
            over = sizes[rows] <= at
            if at % 8 == 0:  # no byte to come can change a dead or an accepted row
                over |= ~(state & ~self.settled).any(axis=1)
            if over.any():
                final[rows[over]] = state[over]
                rows, state = rows[~over], state[~over]
                if not len(rows):
                    break
            byte = flat[begin[rows] + at]
            moved = state << np.uint64(1)
            moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
            state = (moved & self.enter[byte]) | (state & self.keep[byte])
            at += 1
        out = np.full(n, -1, np.int64)
        hits = final & self.accept
        for w in reversed(range(self.words)):
            word = hits[:, w]
            some = word != 0
            low = word[some] & (~word[some] + np.uint64(1))
            out[some] = self.owner[64 * w + np.log2(low.astype(np.float64)).astype(np.int64)]
        return out


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(df: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row (key, host, path, rule, verdict) for each row of ``df``.

    The longest fitting rule wins; of equally long ones, the one that is first in ``rules``.
    Null urls and those without ``://`` have an empty host and path and fit no rule. Repeated
    rows stay, an empty table gives an empty result, urls of any length are read whole; other
    columns, whatever their names, are not read. The rules are parameters of
    bounded number and travel with the code; there is no shuffle.
    """
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    globs, of = [], []
    for i in ranked:
        for g in rules[i].globs():
            globs.append(g)
            of.append(i)
    automaton, owner = ShiftAnd(globs), np.asarray([*of, -1])

    @F.pandas_udf("int")
    def winner(canonical: pd.Series) -> pd.Series:
        return pd.Series(owner[automaton.match([u.encode() for u in canonical])].astype("int32"))

    parts = df.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    hit = parts.withColumn("__rule", winner(F.concat(F.lit("."), "host", "path")))
    names = F.array(*[F.lit(r.name) for r in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array().cast("array<string>")
    return hit.select(
        key, "host", "path",
        F.when(F.col("__rule") >= 0, F.get(names, F.col("__rule"))).alias("rule"),
        F.when(F.col("__rule") >= 0, F.get(verdicts, F.col("__rule"))).otherwise(F.lit(default)).alias("verdict"),
    )
