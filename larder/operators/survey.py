"""Weighted survey estimates: means, standard errors, intervals, long form, gaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.missing import percent, ratio
from larder.functions.stats import t_975
from larder.sources.staging import stage


def interaction(*columns: str) -> Column:
    """Cross of category columns as one label, NULL if any part is."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.lit("."), F.col(c).cast("string")]
    return F.concat(*parts[1:])


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum(w x) / sum(w) over rows that have a value."""
    return ratio(F.sum(weight * value), F.sum(F.when(value.isNotNull(), weight)))


# What a stratum with a single PSU (or row) adds to an error: nothing is known about its spread. It
# makes the error missing, adds nothing (it was certain to be drawn), or counts by its distance
# from the mean over all strata instead of its own.
LONELY = ("missing", "certainty", "adjust")


@dataclass(frozen=True)
class SurveyDesign:
    """A table with sampling weights and, optionally, strata and clusters.

    ``ids`` names the primary sampling units (enumeration areas, say), numbered within strata:
    rows of one unit are not drawn independently, so errors come from the spread of the units'
    totals. Without it every row is a unit. ``weight=None`` weighs every row 1; a name that is not a column is an error, so a
    misspelt weight cannot silently turn an estimate into an unweighted one. A row with a
    value but without a weight raises when an estimate runs (``on_null="raise"``, checked
    in the estimate's own aggregate) or is left out (``on_null="drop"``). The same holds for a
    row without a unit where an error is asked for.
    """

    df: DataFrame
    weight: str | None
    strata: str | None = None
    on_null: str = "raise"
    ids: str | None = None

    def __post_init__(self) -> None:
        if self.on_null not in ("raise", "drop"):
            raise ValueError(self.on_null)
        absent = [c for c in (self.weight, self.strata, self.ids) if c is not None and c not in self.df.columns]
        if absent:
            raise ValueError(f"not in the table: {absent}")

    def weights(self) -> Column:
        return F.lit(1.0) if self.weight is None else F.col(self.weight)

    def check(self) -> DataFrame:
        """Counts that decide whether the design can be used.

        With ``ids`` also units and strata with a single unit. Rows are counted by unit first,
        so however many rows a unit has, one row per unit and task moves.
        """
        w = self.weights()
        strata = F.lit(None) if self.strata is None else F.col(self.strata)
        counts = [
            F.count("*").alias("n_rows"),
            F.count_if(w.isNull()).alias("null_weights"),
            F.count_if(w <= 0).alias("non_positive_weights"),
            F.count_if(strata.isNull()).alias("null_strata") if self.strata else F.lit(0).cast("bigint").alias("null_strata"),
            F.sum(w).alias("sum_weights"),
        ]
        if self.ids is None:
            return self.df.agg(*counts)
        unit = F.col(self.ids)
        by = [self.strata] if self.strata else []
        units = self.df.groupBy(*by, self.ids).agg(*counts)
        names = units.columns[len(by) + 1:]
        known = unit.isNotNull() & (F.col("n_rows") > F.col("null_weights"))
        sums = [F.sum(c).alias(c) for c in names]
        per = [F.sum(F.when(unit.isNull(), F.col("n_rows")).otherwise(0)).alias("null_ids"), F.count_if(known).alias("n_units")]
        of_strata = units.groupBy(*(by or [F.lit(0)])).agg(*sums, *per)
        return of_strata.agg(*sums, F.sum("null_ids").alias("null_ids"), F.sum("n_units").alias("n_units"),
                             F.count_if(F.col("n_units") == 1).alias("lonely_strata"))

    def _refusing(self, estimate: Column, unweighted: Column) -> Column:
        """``estimate``, or an error if ``unweighted`` rows were counted and are not to be dropped."""
        if self.weight is None or self.on_null == "drop":
            return estimate
        error = F.raise_error(F.lit(f"rows without a weight in {self.weight}")).cast("double")
        return F.when(unweighted > 0, error).otherwise(estimate)

    def mean_of(self, variable: str) -> Column:
        """The weighted mean as an aggregate, under the design's rule for missing weights."""
        x, w = F.col(variable), self.weights()
        return self._refusing(weighted_mean(x, w), F.count_if(w.isNull() & x.isNotNull()))

    def complete(self, columns: Sequence[str]) -> SurveyDesign:
        """Only rows with every one of ``columns`` present."""
        return replace(self, df=self.df.dropna(subset=list(columns)))

    def mean(self, variables: Sequence[str] | Mapping[str, str], by: Sequence[str] = (),
             digits: int | None = None, as_percent: bool = False) -> DataFrame:
        """Weighted means of any number of variables in one aggregate.

        A mapping gives output names: ``{variable: name}``.
        """
        names = _names(variables)
        estimates = [_scaled(self.mean_of(v), digits, as_percent).alias(n)
                     for v, n in names.items()]
        return self.df.groupBy(*by).agg(*estimates) if by else self.df.agg(*estimates)

    def mean_sets(self, variables: Sequence[str] | Mapping[str, str], sets: Sequence[Sequence[str]],
                  overall: Mapping[str, str]) -> DataFrame:
        """Means at several levels of grouping in one scan.

        A column of ``overall`` shows its label on the rows aggregated over it. That is
        decided by ``grouping``, so a group whose value is missing stays distinct.
        """
        columns = list(dict.fromkeys(c for s in sets for c in s))
        names = _names(variables)
        grouped = self.df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(
            *[F.grouping(c).alias(f"_over_{c}") for c in overall],
            *[self.mean_of(v).alias(n) for v, n in names.items()])
        return grouped.select(
            *[F.when(F.col(f"_over_{c}") == 1, F.lit(overall[c])).otherwise(F.col(c)).alias(c)
              if c in overall else F.col(c) for c in columns],
            *names.values())

    def mean_ci(self, variable: str, by: Sequence[str] = (), out: str | None = None,
                degrees: float | None = None, digits: int | None = None, missing_counts: bool = True,
                lonely: str = "missing") -> DataFrame:
        """Weighted mean with its linearised standard error and 95 % interval.

        The error of m = sum(wx)/sum(w) is that of the total of z = (wx - m w)/sum(w).
        Its sum of squares follows from means, variances and the covariance of wx and w,
        which one aggregate yields (Spark merges them as central moments, so nothing
        cancels as it would with raw power sums). With ``ids`` the same is done with the units'
        totals of wx and w in place of the rows', after an aggregate by unit that sums before
        rows move. Only a table with a row per group and stratum is left for the rest: no
        second scan, no join back to the rows.

        A domain keeps the whole design's sample size; rows (units) outside it count as zeros. So
        do rows without a value, unless ``missing_counts`` is false: then they are no part of
        the design, as after ``complete([variable])`` but without computing it twice.
        ``degrees`` defaults to units minus strata, rows minus strata without ``ids``. ``lonely`` (see
        ``LONELY``) says what a stratum of one unit that takes part does to the error. Rows without
        a weight are not part of the design; one that has a value raises unless ``on_null`` is ``drop``.
        """
        if lonely not in LONELY:
            raise ValueError(lonely)
        out = out or variable
        by = list(by)
        x, w = F.col(variable), self.weights()
        strata = [self.strata] if self.strata else []
        kept = self.df if self.on_null == "raise" else self.df.filter(w.isNotNull() & (F.lit(True) if self.ids is None else F.col(self.ids).isNotNull()))
        unit = [] if self.ids is None else [F.col(self.ids).alias("_unit")]
        rows = kept.select(
            *by, *strata, *unit, F.when(w.isNotNull(), x).alias("_x"), (w * x).alias("_wx"), F.when(x.isNotNull(), w).alias("_w"),
            w.isNotNull().alias("_weighed"), (w.isNull() & x.isNotNull()).alias("_unweighed"))
        size = F.count_if("_weighed") if missing_counts else F.count("_x")
        if self.ids is None:
            sizes, bad, low, high = size, F.count_if("_unweighed"), F.min("_x"), F.max("_x")
        else:
            rows = self._units(rows, by, strata, size)
            sizes, bad, low, high = F.sum("_units"), F.sum("_bad"), F.min("_low"), F.max("_high")
        cells = rows.groupBy(*by, *strata).agg(
            sizes.alias("_rows"), F.count("_wx").alias("_n"), bad.alias("_bad"),
            F.avg("_wx").alias("_mx"), F.avg("_w").alias("_mw"),
            F.var_pop("_wx").alias("_vx"), F.var_pop("_w").alias("_vw"), F.covar_pop("_wx", "_w").alias("_c"),
            low.alias("_low"), high.alias("_high"))
        # From here on: one row per group and stratum. They are read twice; staged, the rows behind them are read once.
        cells = stage(cells)
        one = [F.lit(0)]
        domain = Window.partitionBy(*(by or one))
        # Design totals come as one row, not from a window over all cells: with a fine ``by`` there may be very many.
        taking = F.lit(True) if self.ids is None else F.col("_rows") > 0
        strata_count = F.count_distinct(F.when(taking, F.struct(*strata))) if strata else F.lit(1).cast("bigint")
        totals = cells.agg(F.sum("_rows").alias("_nall"), strata_count.alias("_strata"))
        cells = cells.crossJoin(F.broadcast(totals)).withColumns({
            "_sw": F.sum(F.col("_n") * F.col("_mw")).over(domain),
            "_m": ratio(F.sum(F.col("_n") * F.col("_mx")).over(domain),
                        F.sum(F.col("_n") * F.col("_mw")).over(domain)),
            # A constant has no spread; rounding would leave a trace of one.
            "_flat": F.min("_low").over(domain) == F.max("_high").over(domain),
            "_nh": F.sum("_rows").over(Window.partitionBy(*strata)) if strata else F.col("_nall"),
        })
        m = F.col("_m")
        mean_z = F.col("_mx") - m * F.col("_mw")
        spread = F.greatest(F.col("_vx") - 2 * m * F.col("_c") + m * m * F.col("_vw"), F.lit(0.0))
        sum_z2 = F.col("_n") * (spread + mean_z * mean_z)
        sum_z = F.col("_n") * mean_z
        part = ratio(F.col("_nh"), F.col("_nh") - 1) * (sum_z2 - ratio(sum_z * sum_z, F.col("_nh")))
        if lonely != "missing":
            # The mean of z over all units is 0, as m is the mean: the distance from it is z itself.
            part = F.when(F.col("_nh") == 1, F.lit(0.0) if lonely == "certainty" else sum_z2).otherwise(part)
        cells = cells.withColumn("_part", F.when((F.col("_n") == 0) | F.col("_flat"), F.lit(0.0)).otherwise(part))
        result = cells.groupBy(*by).agg(
            self._refusing(F.first("_m"), F.sum("_bad")).alias("_m"), F.first("_sw").alias("_sw"),
            F.when(F.count_if(F.col("_part").isNull()) == 0, F.sum("_part")).alias("_ss"),
            F.first(F.col("_nall") - F.col("_strata")).alias("_df"))
        se = ratio(F.sqrt(F.greatest(F.col("_ss"), F.lit(0.0))), F.col("_sw"))
        se = F.when(F.col("_ss").isNotNull(), se)
        t = t_975(F.col("_df") if degrees is None else F.lit(float(degrees)))
        return result.select(
            *by,
            (F.col("_m") if digits is None else F.bround("_m", digits)).alias(out),
            se.alias(f"{out}_se"), (F.col("_m") - t * se).alias(f"{out}_low"), (F.col("_m") + t * se).alias(f"{out}_upp"))

    def _units(self, rows: DataFrame, by: list[str], strata: list[str], size: Column) -> DataFrame:
        """Totals by group, stratum and unit; ``_units`` is 1 in one of a unit's groups if the unit is part of the design.

        A unit may lie in several groups (men and women of a village): it is counted with the first of them.
        """
        sums = rows.groupBy(*by, *strata, "_unit").agg(
            F.sum("_wx").alias("_wx"), F.sum("_w").alias("_w"), size.alias("_size"), F.count_if("_unweighed").alias("_bad"),
            F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        error = F.raise_error(F.lit(f"rows without a unit in {self.ids}")).cast("int")
        taking = F.col("_size") > 0
        first = F.lit(1)
        if by:
            groups = Window.partitionBy(*strata, "_unit", taking).orderBy(*by)
            first = F.when(F.row_number().over(groups) == 1, F.lit(1)).otherwise(F.lit(0))
        counted = F.when(taking & F.col("_unit").isNull(), error).when(taking, first).otherwise(F.lit(0))
        return sums.withColumn("_units", counted)


def long(estimates: DataFrame, by: Sequence[str] = (), name: str = "micronutrient", value: str = "estimate") -> DataFrame:
    """Wide estimates -> one row per group and variable."""
    columns = [c for c in estimates.columns if c not in by]
    return estimates.unpivot(list(by), columns, name, value)


def gap(estimates: DataFrame, key: str, pivot: str, a: str, b: str, value: str = "estimate") -> DataFrame:
    """Wide by two values of ``pivot`` with their absolute difference; incomplete keys drop.

    A conditional aggregate over the estimate table (``pivot`` with listed values).
    """
    wide = estimates.groupBy(key).pivot(pivot, [a, b]).agg(F.first(value))
    return wide.dropna(subset=[a, b]).withColumn("diff", F.abs(F.col(a) - F.col(b)))


def quintile_label(quintile: Column) -> Column:
    return (F.when(quintile == 1, F.lit("1 - Poorest")).when(quintile == 5, F.lit("5 - Wealthiest"))
            .otherwise(quintile.cast("string")))


def to_percent(df: DataFrame, columns: Sequence[str], digits: int | None = None) -> DataFrame:
    """Shares -> percent, rounded half-to-even."""
    return df.withColumns({c: percent(F.col(c), digits) for c in columns})


def _names(variables: Sequence[str] | Mapping[str, str]) -> dict[str, str]:
    return dict(variables) if isinstance(variables, Mapping) else {v: v for v in variables}


def _scaled(estimate: Column, digits: int | None, as_percent: bool) -> Column:
    if as_percent:
        return percent(estimate, digits)
    return estimate if digits is None else F.bround(estimate, digits)
