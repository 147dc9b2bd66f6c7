"""Random numbers by hash: a row's draws depend on its key and a seed alone.

They are the same on any cluster, after a lost executor and in SQL, as they come from md5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: str | Column) -> Column:
    """In [0, 1): the first 32 bits of md5 over seed and keys, joined by colons."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(seed: int, *keys: str) -> str:
    """uniform() for DuckDB."""
    return f"(CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def normal(seed: int, *keys: str | Column) -> Column:
    """A standard normal from two uniforms."""
    one, two = uniform(seed, *keys), uniform(seed + 1_000_003, *keys)
    return F.sqrt(-2 * F.log(one + F.lit(2.0**-33))) * F.cos(2 * math.pi * two)


def normal_sql(seed: int, *keys: str) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(seed, *keys)} + power(2.0::DOUBLE, -33))) * cos(2 * pi() * {uniform_sql(seed + 1_000_003, *keys)}))"


def poisson(u: Column) -> Column:
    """A Poisson(1) count from a uniform of this module, by its distribution."""
    out = F.lit(0)
    for k, below in enumerate(poisson_steps(), start=1):
        out = F.when(u > below, F.lit(k)).otherwise(out)
    return out


def poisson_sql(u: str) -> str:
    steps = list(enumerate(poisson_steps(), start=1))
    return "CASE " + " ".join(f"WHEN {u} > {below!r}::DOUBLE THEN {k}" for k, below in reversed(steps)) + " ELSE 0 END"


def poisson_steps() -> list[float]:
    """The distribution at 0, 1, 2... as far as a uniform of 32 bits can lie above it."""
    p = total = math.exp(-1)
    out = []
    while total < 1 - 2.0**-32:
        out.append(total)
        p /= len(out)
        total += p
    return out
