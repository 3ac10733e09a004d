"""Stable identities and reproducible draws, all from text digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.text import _col


def stable_hash(*cols: Column | str) -> Column:
    """Content hash of a row identity. Pass coordinates as scaled integers."""
    parts = [F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols]
    return F.sha2(F.concat_ws("|", *parts), 256)


def draw_key(seed: int, *cols: Column | str) -> Column:
    """Uniform sort key for sampling: the order depends on seed and key only."""
    parts = [F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("#", F.lit(str(seed)), *parts).cast("binary"))
