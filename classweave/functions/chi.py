"""Tail of the chi-square distribution, in logarithms.

On a large table a p-value drops below the smallest double long before two
slots stop being comparable, so slots are ranked by its logarithm.
"""

from __future__ import annotations

import math

_ASYMPTOTIC = 600.0


def _log_erfc_root(y: float) -> float:
    """log(erfc(sqrt(y)))."""
    if y < _ASYMPTOTIC:
        return math.log(math.erfc(math.sqrt(y)))
    series = 1.0 - 1.0 / (2 * y) + 3.0 / (4 * y * y)
    return -y - 0.5 * math.log(math.pi * y) + math.log(series)


def log_p_value(statistic: float, dof: int) -> float:
    """log P(X > statistic) for ``dof`` degrees of freedom; 0 for no test."""
    if dof <= 0 or statistic <= 0:
        return 0.0
    y = statistic / 2.0
    if dof % 2:
        start, terms = [_log_erfc_root(y)], (dof - 1) // 2
        shift = 0.5
    else:
        start, terms = [-y], dof // 2 - 1
        shift = 0.0
    # each further term is y^a e^-y / gamma(a + 1), a in steps of one
    logs = start + [
        (i - shift) * math.log(y) - y - math.lgamma(i - shift + 1)
        for i in range(1, terms + 1)
    ]
    top = max(logs)
    return min(0.0, top + math.log(sum(math.exp(v - top) for v in logs)))


def chi_square(cells: list[tuple[float, float]]) -> tuple[float, int]:
    """Statistic and degrees of freedom of a table of (class 0, class 1) rows."""
    rows = [(a, b) for a, b in cells if a + b > 0]
    zero, one = sum(a for a, _ in rows), sum(b for _, b in rows)
    if len(rows) < 2 or not zero or not one:
        return 0.0, 0
    total = zero + one
    statistic = 0.0
    for a, b in rows:
        for seen, share in ((a, zero / total), (b, one / total)):
            expected = (a + b) * share
            statistic += (seen - expected) ** 2 / expected
    return statistic, len(rows) - 1
