"""Block sizes, read from the session so that a user can tune them.

One run may hold a third of all rows, so no window, list or fold in this package
spans a whole run.  Sequences are cut into blocks of at most ``blockRows`` rows
(or ``blockMs`` of media time); what must cross a block edge travels through
one summary row per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

BLOCK_ROWS = "cinetrace.blockRows"
BLOCK_MS = "cinetrace.blockMs"
PART_ROWS = "cinetrace.partRows"
FOLD_ROWS = "cinetrace.foldRows"

_DEFAULTS = {
    BLOCK_ROWS: 65536,
    BLOCK_MS: 600_000,
    PART_ROWS: 1000,  # elements per emitted list or text part
    FOLD_ROWS: 4096,  # rows per block of an order-dependent fold
}


def setting(df: DataFrame, key: str) -> int:
    return int(df.sparkSession.conf.get(key, str(_DEFAULTS[key])))


def block_rows(df: DataFrame) -> int:
    return setting(df, BLOCK_ROWS)


def block_ms(df: DataFrame) -> int:
    return setting(df, BLOCK_MS)


def part_rows(df: DataFrame) -> int:
    return setting(df, PART_ROWS)


def fold_rows(df: DataFrame) -> int:
    return setting(df, FOLD_ROWS)
