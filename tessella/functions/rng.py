"""Counter-based uniform numbers: the same for a key wherever and however often they are computed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *key: Column | str) -> Column:
    """In [0, 1), from the first 32 bits of md5('seed:key:key...')."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.lit(k) if isinstance(k, str) else k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / 4294967296.0


def uniform_sql(seed: int, *key: str) -> str:
    """The same in DuckDB; keys are SQL expressions."""
    return f"(CAST(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(key)})), 1, 8)) AS BIGINT)/4294967296.0e0)"
