"""Deterministic surrogate keys.

A key is a hash of the natural key, so re-running a job (or re-computing a lost
partition) yields the same identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def surrogate(*parts: Column | str) -> Column:
    """Non-negative 63-bit key of a natural key."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.xxhash64(*cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def _whole(number: Column | str) -> Column:
    """One type for whole numbers: the hash of an int is not that of an equal bigint."""
    return (F.col(number) if isinstance(number, str) else number).cast("bigint")


def generation_key(experiment: Column | str, number: Column | str) -> Column:
    return surrogate(F.lit("generation"), _whole(experiment), _whole(number))


def variant_key(experiment: Column | str, number: Column | str, index: Column | str) -> Column:
    return surrogate(F.lit("variant"), _whole(experiment), _whole(number), index)


def control_key(experiment: Column | str, number: Column | str) -> Column:
    return surrogate(F.lit("control"), _whole(experiment), _whole(number))
