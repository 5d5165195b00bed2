"""Table summaries in place of the plots an analyst would look at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.ordering import quantiles_exact
from larder.sources.staging import stage


def summary_stats(df: DataFrame, col: str, tie: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, mean, maximum and number missing; quartiles are exact.

    The rows are staged, as the quartiles read them more than once.
    """
    value = stage(df.select(F.col(col), *tie))
    quartiles = quantiles_exact(value, col, [0.25, 0.5, 0.75], tie, names=["q1", "median", "q3"])
    rest = value.agg(F.min(col).alias("min"), F.avg(col).alias("mean"), F.max(col).alias("max"),
                     F.count_if(F.col(col).isNull()).alias("n_missing"))
    return rest.crossJoin(F.broadcast(quartiles)).select("min", "q1", "median", "mean", "q3", "max", "n_missing")  # one row each


def histogram(df: DataFrame, col: str, lo: float = 0, hi: float = 10000, bins: int = 30,
              tie: Sequence[str] | None = None) -> DataFrame:
    """Rows per equal-width bin of [lo, hi); values outside are left out.

    With ``tie`` (columns that tell equal values apart) every bin also shows the exact median of
    all known values, those outside the bins included.
    """
    value = F.col(col)
    inside = df.filter((value >= lo) & (value < hi))
    bin_no = F.width_bucket(value, F.lit(float(lo)), F.lit(float(hi)), F.lit(bins))
    width = (hi - lo) / bins
    counted = (inside.groupBy(bin_no.alias("bin")).agg(F.count("*").alias("n"))
               .withColumn("bin_start", F.lit(float(lo)) + (F.col("bin") - 1) * F.lit(width)))
    if tie is None:
        return counted
    # One row against at most ``bins`` rows.
    return counted.crossJoin(F.broadcast(quantiles_exact(stage(df.select(col, *tie)), col, [0.5], tie, names=["median"])))


def mean_by(df: DataFrame, y: str, x: str) -> DataFrame:
    """Mean of ``y`` at each value of ``x``, beside the line through all rows.

    The fit is one row, joined to the groups as such: ``x`` may be continuous, with nearly as
    many groups as rows.
    """
    groups = df.groupBy(x).agg(F.count("*").alias("n"), F.avg(y).alias(f"mean_{y}"))
    fit = df.agg(_slope(y, x).alias("slope"), _correlation(y, x).alias("corr"))
    return groups.crossJoin(F.broadcast(fit))


def log_log_fit(df: DataFrame, y: str, x: str, lo: float = 0, hi: float = 20) -> DataFrame:
    """Slope and correlation of ln y on ln x where both lie within [lo, hi]."""
    logs = df.select(F.ln(x).alias("lx"), F.ln(y).alias("ly")).filter(
        F.col("lx").between(lo, hi) & F.col("ly").between(lo, hi))
    return logs.agg(F.count("*").alias("n"), _slope("ly", "lx").alias("slope"), _correlation("ly", "lx").alias("corr"))


def smooth(df: DataFrame, y: str, x: str, at: Sequence[float], span: float = 0.75, degree: int = 2) -> DataFrame:
    """The smooth curve through (x, y) as a table: ``at``, ``smooth_<y>``, and ``n``, the rows that bear on it.

    At each point a polynomial of ``degree`` 0 to 2 is fitted to the ``span`` share of rows nearest to it (all rows
    that tie with the last one count), with tricube weights of the distance; its value there is
    the curve. Rows are summed up by their value of x first, and only those sums meet the points: no
    row meets another. Meant for an x of few different values (people, adult equivalents). Where
    fewer values bear on a point than a polynomial needs, the degree is lower.
    """
    if degree not in (0, 1, 2) or not 0 < span <= 1:
        raise ValueError(f"degree {degree}, span {span}")
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = stage(known.groupBy(F.col(x).cast("double").alias("_x")).agg(F.count("*").alias("_n"), F.sum(F.col(y).cast("double")).alias("_sum")))
    whole = sums.agg(F.sum("_n").alias("_all"))  # one row
    points = F.explode(F.array(*[F.lit(float(a)) for a in dict.fromkeys(at)]))
    met = sums.crossJoin(F.broadcast(whole)).withColumn("at", points).withColumn("_d", F.abs(F.col("_x") - F.col("at")))
    point = Window.partitionBy("at")
    met = met.withColumn("_upto", F.sum("_n").over(point.orderBy("_d")))  # ties included
    enough = F.col("_upto") >= F.ceil(F.lit(float(span)) * F.col("_all"))
    met = met.withColumns({"_q": F.min(F.when(enough, F.col("_d"))).over(point), "_least": F.min("_d").over(point)})
    share = F.try_divide("_d", "_q")
    near = (F.when(F.col("_q") == F.col("_least"), F.when(F.col("_d") == F.col("_q"), 1.0))  # all of them equally near
            .when(F.col("_d") < F.col("_q"), F.pow(1 - F.pow(share, 3), 3)))
    u = F.when(F.col("_q") == 0, F.lit(0.0)).otherwise((F.col("_x") - F.col("at")) / F.col("_q"))
    met = met.withColumns({"_w": near, "_u": u}).filter(F.col("_w").isNotNull())
    rows, ys = F.col("_w") * F.col("_n"), F.col("_w") * F.col("_sum")
    fits = met.groupBy("at").agg(
        F.sum("_n").alias("n"), F.count("*").alias("_values"),
        *[F.sum(rows * F.pow("_u", F.lit(p))).alias(f"_s{p}") for p in range(5)], *[F.sum(ys * F.pow("_u", F.lit(p))).alias(f"_t{p}") for p in range(3)])
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(f"_{c}") for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    level = F.try_divide(t0, s0)
    line = F.try_divide(t0 * s2 - t1 * s1, s0 * s2 - s1 * s1)
    minor = s2 * s4 - s3 * s3
    curve = F.try_divide(t0 * minor - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2),
                         s0 * minor - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))
    used = F.least(F.col("_values") - 1, F.lit(degree))
    return fits.select("at", "n", F.when(used >= 2, curve).when(used == 1, line).otherwise(level).alias(f"smooth_{y}"))


def _slope(y: str, x: str) -> Column:
    """Least-squares slope over rows with both values; NULL, not an error, if x is constant."""
    known = F.when(F.col(y).isNotNull(), F.col(x))
    return F.try_divide(F.covar_pop(y, x), F.var_pop(known))


def _correlation(y: str, x: str) -> Column:
    known_x, known_y = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_pop(y, x), F.sqrt(F.var_pop(known_x) * F.var_pop(known_y)))
