"""Distinct counts that merge: HyperLogLog states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2^12 registers: a state takes about 2 kB, whatever it has counted.
REGISTERS = 12
# Three standard errors of an estimate; a thousandth at most of all estimates lie beyond.
ERROR_BOUND = 3 * 1.04 / 2 ** (REGISTERS / 2)


def distinct_state(value: Column | str) -> Column:
    """State of the different values of a column, to be united with others; nulls do not count."""
    return F.hll_sketch_agg(value, F.lit(REGISTERS))


def united(state: Column | str) -> Column:
    """The state of all values that any of a group's states has counted."""
    return F.hll_union_agg(state)


def estimate(state: Column | str) -> Column:
    return F.hll_sketch_estimate(state)
