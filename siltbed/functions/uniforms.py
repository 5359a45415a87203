"""Counter-based uniforms: the n-th draw of a stage is a digest, so any engine can replay it."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, stage: str, n: int) -> float:
    """A number in [0, 1) from the first 32 bits of md5("seed|stage|n")."""
    return int(hashlib.md5(f"{seed}|{stage}|{n}".encode()).hexdigest()[:8], 16) / 2**32


def uniform_column(seed: int, stage: str, n: Column) -> Column:
    """The same numbers for a column of counters."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stage), n.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32


class Replay:
    """The uniforms of a stage one after another, where a kernel asks a generator for them."""

    def __init__(self, seed: int, stage: str):
        self.seed, self.stage, self.n = seed, stage, 0

    def random(self) -> float:
        self.n += 1
        return uniform(self.seed, self.stage, self.n - 1)
