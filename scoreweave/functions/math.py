"""Scalar expressions shared by scoring and evaluation."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endpoint clip of log-odds, float guard of log loss.
LOG_ODDS_CLIP = 1e-6
FLOAT_EPSILON = sys.float_info.epsilon


def sigmoid(x: Column) -> Column:
    """Logistic function that never overflows."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def log_odds(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def clipped_log_odds(p: Column, eps: float = LOG_ODDS_CLIP) -> Column:
    q = F.greatest(F.least(p, F.lit(1.0 - eps)), F.lit(eps))
    return F.log(q / (1 - q))


def log_loss_term(y: Column, p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1.0 - FLOAT_EPSILON)), F.lit(FLOAT_EPSILON))
    return -F.when(y == 1, F.log(q)).otherwise(F.log1p(-q))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division with NULL where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def sql_literal(value) -> str:
    """SQL text of a frozen parameter."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def balanced_case(x: str, edges, values=None) -> str:
    """Number of edges below ``x`` (right-closed bins) as a balanced CASE tree.

    ``values`` replaces the position by a literal per bin. Depth is logarithmic in
    the number of edges and everything stays in generated code. The result is SQL
    text: learned parameters become one parsed expression, however many there are.
    """
    cuts = [float(e) for e in edges]
    leaves = [sql_literal(v) for v in (range(len(cuts) + 1) if values is None else values)]
    if len(leaves) != len(cuts) + 1:
        raise ValueError("one value per bin is required")

    def build(low: int, high: int) -> str:
        if low == high:
            return leaves[low]
        middle = (low + high) // 2
        return f"CASE WHEN {x} <= {sql_literal(cuts[middle])} THEN {build(low, middle)} ELSE {build(middle + 1, high)} END"

    return build(0, len(cuts))


def balanced_position(x: str, edges) -> Column:
    return F.expr(balanced_case(x, edges))
