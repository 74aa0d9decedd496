"""Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Without it the optimiser copies an array expression into every lambda that reads it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def round_to(value: Column, places: int) -> Column:
    """Round the binary value, ties to even, as Python does for the values met here."""
    scale = 10.0**places
    return F.bround(value * scale, 0) / scale
