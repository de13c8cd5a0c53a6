"""Class and subclass names: aliases, validity, lookups, as DataFrames and expressions over small literal maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import CLASS_ALIASES, CLASS_OF, SUBCLASS_ALIASES, TAXONOMY


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


def taxonomy(spark: SparkSession) -> DataFrame:
    rows = [(k, name, sub) for k, (name, subs) in enumerate(TAXONOMY.items(), 1) for sub in subs]
    return spark.createDataFrame(rows, "class_id int, class string, subclass string")


def normal_class(name: Column) -> Column:
    """The class that a spelling stands for; null if unknown."""
    return _map(CLASS_ALIASES)[F.lower(F.trim(name))]


def normal_subclass(name: Column) -> Column:
    return _map(SUBCLASS_ALIASES)[F.lower(F.trim(name))]


def class_of(subclass: Column) -> Column:
    return _map(CLASS_OF)[subclass]


def normalized(df: DataFrame, strict: bool = False) -> DataFrame:
    """Class and subclass in their own spelling; the class follows from a known subclass. With ``strict`` rows of unknown names fail the job."""
    sub = normal_subclass(F.col("subclass"))
    out = df.withColumn("_sub", sub).withColumn("class", F.coalesce(class_of(F.col("_sub")), normal_class(F.col("class")), F.col("class"))).withColumn("subclass", F.coalesce("_sub", "subclass")).drop("_sub")
    if strict:
        bad = normal_class(F.col("class")).isNull() | normal_subclass(F.col("subclass")).isNull()
        out = out.withColumn("class", F.when(bad, F.raise_error(F.concat(F.lit("unknown class or subclass: "), "class", F.lit(" / "), "subclass"))).otherwise(F.col("class")))
    return out


def valid_motif(df: DataFrame, keep_derived: bool = True) -> DataFrame:
    """Rows whose names are in the taxonomy. Hybrids and clusters name their parts in the subclass; ``keep_derived`` keeps them."""
    known = normal_subclass(F.col("subclass")).isNotNull() & normal_class(F.col("class")).isNotNull()
    if keep_derived:
        known = known | F.col("class").isin("Hybrid", "Non-B_DNA_Clusters")
    return df.filter(F.coalesce(known, F.lit(False)))


def missing_classes(df: DataFrame) -> DataFrame:
    """Classes and subclasses of the taxonomy that df has no row of."""
    return taxonomy(df.sparkSession).join(df.select("class", "subclass").distinct(), ["class", "subclass"], "left_anti")
