"""Normal probabilities and t quantiles as plain column arithmetic.

Spark has no ``erf``. Both functions below use only + - * / exp and CASE, so
they stay inside whole-stage code generation and need no UDF.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rational approximation of the normal tail (Hart 1968, as given by
# West 2005), highest power first.
PHI_NUMERATOR = (
    3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
PHI_DENOMINATOR = (
    8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
PHI_SPLIT = 7.07106781186547
PHI_LIMIT = 37.0
ROOT_TWO_PI = 2.506628274631

# Fixed value: 97.5 % point of the standard normal.
Z_975 = 1.959963984540054


# The far tail is the continued fraction z + 1/(z + 2/(z + 3/(z + 4/(z + 0.65)))).
FAR_TERMS = (4.0, 3.0, 2.0, 1.0)
FAR_LAST = 0.65


def _far_fraction() -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The continued fraction as one quotient of polynomials, highest power first."""
    top, bottom = [1.0, FAR_LAST], [1.0]
    for k in FAR_TERMS:
        # z + k / (top / bottom) = (z * top + k * bottom) / top
        shifted, scaled = [*top, 0.0], [k * c for c in bottom]
        padded = [0.0] * (len(shifted) - len(scaled)) + scaled
        top, bottom = [s + t for s, t in zip(shifted, padded, strict=True)], top
    return tuple(top), tuple(bottom)


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    text = f"{coefficients[0]!r}D"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}D)"
    return text


def with_normal_cdf(df: DataFrame, scores: Mapping[str, Column]) -> DataFrame:
    """Add P(Z <= score) under each name; absolute error about 2e-16. NULL in, NULL out.

    The steps are columns of their own because each is used many times: written as one
    expression they would be copied into every use. The distance from zero is never NULL,
    so the polynomials compile without null checks. Both keep the generated method within
    the size that the JVM still compiles (8000 bytes).
    """
    z, d, t = ({name: f"_{k}_{name}" for name in scores} for k in "zdt")
    if not scores:
        return df
    df = df.withColumns({z[n]: score for n, score in scores.items()})
    df = df.withColumns({d[n]: F.coalesce(F.abs(z[n]), F.lit(0.0)) for n in scores})
    df = df.withColumns({t[n]: F.expr(_tail(f"`{d[n]}`")) for n in scores})
    df = df.withColumns({n: F.when(F.col(z[n]) > 0, 1 - F.col(t[n])).when(F.col(z[n]) <= 0, F.col(t[n])) for n in scores})
    return df.drop(*z.values(), *d.values(), *t.values())


def _tail(d: str) -> str:
    """P(Z > d) for a distance d >= 0; 0 from the limit on."""
    top, bottom = _far_fraction()
    near = f"{_horner(PHI_NUMERATOR, d)} / {_horner(PHI_DENOMINATOR, d)}"
    far = f"{_horner(bottom, d)} / ({_horner(top, d)} * {ROOT_TWO_PI}D)"
    return (f"CASE WHEN {d} >= {PHI_LIMIT}D THEN 0D "
            f"ELSE exp({d} * {d} * -0.5D) * CASE WHEN {d} < {PHI_SPLIT}D THEN {near} ELSE {far} END END")


def t_975(degrees: Column) -> Column:
    """97.5 % point of Student's t (Abramowitz & Stegun 26.7.5 expansion)."""
    z, v = Z_975, degrees.cast("double")
    first = (z**3 + z) / 4
    second = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    third = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    fourth = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    u = F.try_divide(F.lit(1.0), v)
    return F.lit(z) + u * (F.lit(first) + u * (F.lit(second) + u * (F.lit(third) + u * F.lit(fourth))))
