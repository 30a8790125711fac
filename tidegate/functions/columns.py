"""Column functions: seeded draws, activations, losses, formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# 15 hexadecimal digits of an md5 make a 60-bit integer.
DRAW_DIGITS = 15
DRAW_RANGE = float(16**DRAW_DIGITS)


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def digest(seed, *parts) -> Column:
    """md5 text of ``seed:part:part``; the order and split key of every sampling operator."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(p) for p in parts]).cast("binary"))


def draw_int(hash_col) -> Column:
    """Non-negative 60-bit integer from an md5 text."""
    return F.conv(F.substring(_col(hash_col), 1, DRAW_DIGITS), 16, 10).cast("bigint")


def draw_unit(hash_col) -> Column:
    """Number in [0, 1) from an md5 text."""
    return draw_int(hash_col).cast("double") / F.lit(DRAW_RANGE)


def pick(hash_col, *values) -> Column:
    """Uniform choice between ``values``."""
    options = F.array(*[F.lit(v) for v in values])
    return F.element_at(options, (draw_int(hash_col) % len(values) + 1).cast("int"))


def log_uniform(hash_col, low: float, high: float) -> Column:
    """Log-uniform draw between ``low`` and ``high``."""
    import math

    return F.exp(F.lit(math.log(low)) + draw_unit(hash_col) * F.lit(math.log(high) - math.log(low)))


def relu(x) -> Column:
    return F.greatest(_col(x), F.lit(0.0))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


def softmax(scores) -> Column:
    """Softmax of an array column, shifted by its maximum."""
    scores = _col(scores)
    raised = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(raised, F.lit(0.0), lambda acc, e: acc + e)
    return F.transform(raised, lambda e: e / total)


def argmax(scores) -> Column:
    """Position of the largest score, the first one on ties."""
    scores = _col(scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("bigint")


def cross_entropy(scores, label) -> Column:
    """-log softmax(scores)[label] without overflow."""
    scores = _col(scores)
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s - top))
    return top + F.log(total) - F.element_at(scores, (_col(label) + 1).cast("int"))


# Fixed value: a logarithm below -100 counts as -100.
LOG_FLOOR = -100.0


def binary_cross_entropy(p, label) -> Column:
    """-(y ln p + (1-y) ln(1-p)) with the logarithms held at LOG_FLOOR."""
    p, y = _col(p), _col(label).cast("double")

    def safe_log(v: Column) -> Column:
        return F.when(v <= 0, F.lit(LOG_FLOOR)).otherwise(F.greatest(F.log(v), F.lit(LOG_FLOOR)))

    return -(y * safe_log(p) + (1 - y) * safe_log(1 - p))


def two_decimals(x) -> Column:
    return F.format_string("%.2f", _col(x))


def percent(x) -> Column:
    """Share as per cent, rounded to two decimals."""
    return F.round(_col(x) * 100, 2)
