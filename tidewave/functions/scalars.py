"""Column functions used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the Abramowitz and Stegun polynomial 7.1.26 for the error function.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def erf(x: Column) -> Column:
    """Error function within 1.5e-7, as a column expression."""
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = t * (ERF[0] + t * (ERF[1] + t * (ERF[2] + t * (ERF[3] + t * ERF[4]))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return (erf(z / 2**0.5) + 1) / 2


def squared_distance(q: Column, s: Column, q_std: Column | None = None, s_std: Column | None = None) -> Column:
    """(q - s) squared, plus that of the deviations where both are given."""
    d = (q - s) * (q - s)
    return d if q_std is None or s_std is None else d + (q_std - s_std) * (q_std - s_std)


def has_ending(name: Column | str, ending: str) -> Column:
    return (F.col(name) if isinstance(name, str) else name).endswith(ending)
