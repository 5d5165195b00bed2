"""Readers and writers: typed tables, the three-table survey, staged outputs, reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder import params
from larder.functions.missing import drop_nan
from larder.operators.joins import once_per_key
from larder.sources import schemas
from larder.sources.labelled import read_labelled

MISSING = "NA"


@dataclass(frozen=True)
class Survey:
    """Households, food consumption and food composition of one survey."""

    hh: DataFrame
    food: DataFrame
    fct: DataFrame

    def with_fct(self, fct: DataFrame) -> Survey:
        return Survey(self.hh, self.food, fct)


def read_table(spark: SparkSession, path: str, schema: T.StructType, names: Mapping[str, str] | None = None) -> DataFrame:
    """A CSV, labelled (``.dta``) or Parquet table with the given schema; ``NA`` cells and NaN become NULL.

    A CSV or labelled file is matched to the schema by its header, so column order and extra columns
    do not matter. ``names`` says what a labelled file calls a column, where it has a name of its own.
    """
    if path.rstrip("/").lower().endswith(".dta"):
        coded = read_labelled(spark, path, {f.name: (names or {}).get(f.name, f.name) for f in schema})
        df = coded.select(*[_as(coded, f).alias(f.name) for f in schema])
    elif path.rstrip("/").endswith(".csv"):
        named = spark.read.option("header", True).option("nullValue", MISSING).csv(path)
        absent = [f.name for f in schema if f.name not in named.columns]
        if absent:
            raise ValueError(f"{path} lacks columns {absent}")
        # The header fixes the order; types come from the schema, extras are pruned.
        ordered = T.StructType([schema[c] if c in schema.names else T.StructField(c, T.StringType())
                                for c in named.columns])
        df = (spark.read.schema(ordered).option("header", True).option("nullValue", MISSING)
              .option("mode", "FAILFAST").csv(path))
    else:
        df = spark.read.schema(schema).parquet(path)
    return df.select(*[drop_nan(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in schema])


def _as(df: DataFrame, field: T.StructField) -> Column:
    """A labelled file's column in the schema's type; a code kept as a floating-point number is written without a fraction."""
    column = F.col(field.name)
    if isinstance(field.dataType, T.StringType) and isinstance(df.schema[field.name].dataType, T.DoubleType):
        return F.when(column == F.floor(column), F.floor(column).cast("string")).otherwise(column.cast("string"))
    return column.cast(field.dataType)


def read_survey(spark: SparkSession, name: str, path: str, nutrients: Sequence[str] = tuple(params.NUTRIENTS),
                fmt: str = "csv") -> Survey:
    """The tables ``<name>_hh_information``, ``_food_consumption`` and ``_fct`` under ``path``."""
    def table(part: str, schema: T.StructType) -> DataFrame:
        return read_table(spark, f"{path.rstrip('/')}/{name}_{part}.{fmt}", schema)

    return Survey(table("hh_information", schemas.HH_INFORMATION),
                  table("food_consumption", schemas.FOOD_CONSUMPTION),
                  table("fct", schemas.fct(nutrients)))


def write_table(df: DataFrame, path: str, stage: str, fmt: str = "parquet",
                partition_by: Sequence[str] = ()) -> str:
    """Write to ``path/stage=<stage>.<fmt>`` and return that path.

    Each stage has a path of its own: a job that overwrote the table it is still
    reading would destroy its input, so an existing stage is an error.
    """
    target = f"{path.rstrip('/')}/stage={stage}.{fmt}"
    writer = df.write.mode("errorifexists").partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", MISSING)
    writer.format(fmt).save(target)
    return target


def write_report(df: DataFrame, path: str, by: str = "nutrient") -> str:
    """A report with one folder per value of ``by`` (the sheets of a workbook)."""
    return write_table(df, path, "report", partition_by=[by])


def labels_dim(spark: SparkSession, labels: Mapping[int, str] | Iterable[tuple[int, str]]) -> DataFrame:
    """(code, label) from the value labels of a coded column."""
    return params.labels_frame(spark, dict(labels))


def decode(df: DataFrame, column: str, labels: Mapping[int, str]) -> DataFrame:
    """Replace the codes of ``column`` by their labels; an unlisted code becomes NULL."""
    chain = None
    for code, label in labels.items():
        hit = F.col(column) == code
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return df.withColumn(column, chain)


def decode_with(df: DataFrame, column: str, dim: DataFrame) -> DataFrame:
    """Like ``decode`` with the labels in a (code, label) frame; its size decides how it is joined.

    A code with two labels is refused when the plan runs: it would multiply rows. A missing
    code takes the label of the frame's missing code, if it has one.
    """
    labels = once_per_key(dim.select(F.col("code").alias("_code"), F.col("label").alias("_label")), "_code")
    joined = df.join(labels, F.col(column).eqNullSafe(F.col("_code")), "left")
    return joined.select(*[F.col("_label").alias(c) if c == column else F.col(c) for c in df.columns])
