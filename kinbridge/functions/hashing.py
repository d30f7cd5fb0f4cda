"""Keyed hashes that order rows alike on every run and every cluster."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_key(value: Column, seed: str) -> Column:
    """32 hex digits by SQL functions alone; any engine with MD5 agrees."""
    return F.md5(F.concat_ws("|", F.lit(seed), value.cast("string")))


def blake_key(value: Column, seed: str) -> Column:
    """16 hex digits of keyed BLAKE2b-64, read as a little-endian integer; text order is number order."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        key = seed.encode()
        return x.map(lambda v: f"{int.from_bytes(hashlib.blake2b(str(v).encode(), digest_size=8, key=key).digest(), 'little'):016x}")

    return run(value.cast("string"))


def uniform(value: Column, seed: str) -> Column:
    """From 0 to 1, by the first seven hex digits."""
    return F.conv(F.substring(md5_key(value, seed), 1, 7), 16, 10).cast("double") / float(16**7)
