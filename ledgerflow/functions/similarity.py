"""String similarities that Spark has no function for, as Arrow-batched pandas UDFs.

They run last in a plan, on distinct values or on candidate pairs that cheaper predicates have let through.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@lru_cache(maxsize=65536)
def indel(a: str, b: str) -> float:
    """100 * 2 LCS / (len a + len b): the normalised insert-delete similarity. Two empty strings are alike."""
    if not a and not b:
        return 100.0
    if len(a) < len(b):
        a, b = b, a
    # bit-parallel longest common subsequence (Hyyro): zero bits mark matches
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return 200.0 * (len(b) - row.bit_count()) / (len(a) + len(b))


def token_set(a: str, b: str) -> float:
    """Best indel similarity among the shared words, and the shared words with either side's own; 0 if a side has no words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_a, only_b = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_a or not only_b):
        return 100.0
    with_a, with_b = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    return max(indel(with_a, with_b), *((indel(both, with_a), indel(both, with_b)) if both else (0.0,)))


@lru_cache(maxsize=65536)
def sequence(a: str, b: str) -> float:
    """Ratcliff/Obershelp ratio; the order of arguments matters."""
    return SequenceMatcher(a=a, b=b).ratio()


def _udf(fn):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


indel_ratio = _udf(indel)
token_set_ratio = _udf(token_set)
sequence_ratio = _udf(sequence)
