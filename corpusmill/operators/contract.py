"""Schema contracts: fill what is missing, report drift, refuse breaking changes."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.functions.text import strip
from corpusmill.operators.upsert import require_columns

log = logging.getLogger("corpusmill.contract")


@dataclass(frozen=True)
class Field:
    """A column every reader may rely on. Without a default, nulls stay."""

    name: str
    type: str
    default: object = None


# The specimen contract.
SPECIMEN = (
    Field("specimen_id", "string"),
    Field("species", "string", "unknown"),
    Field("age_ma", "double", 0.0),
    Field("location", "string", "unknown"),
    Field("discoverer", "string", "unknown"),
    Field("excavation_site", "string", "unknown"),
    Field("geological_period", "string", "unknown"),
)

# Fixed values: (actual, contract) types that may differ.
WIDER = (("bigint", "int"), ("double", "int"), ("double", "bigint"), ("double", "float"))


def compatible(actual: str, expected: str) -> bool:
    return actual == expected or (actual, expected) in WIDER


def fill(df: DataFrame, contract: Sequence[Field] = SPECIMEN) -> DataFrame:
    """Add absent columns and replace nulls by defaults, in one projection."""
    present = set(df.columns)
    filled = {}
    for field in contract:
        default = F.lit(field.default).cast(field.type)
        if field.name not in present:
            log.warning("column %s is missing, filled with %r", field.name, field.default)
            filled[field.name] = default
        elif field.default is not None:
            filled[field.name] = F.coalesce(F.col(field.name), default)
    return df.withColumns(filled) if filled else df


def drift_rows(schema: StructType, contract: Sequence[Field] = SPECIMEN) -> list[tuple]:
    """(kind, column, expected, actual, action) for every difference, in a stable order."""
    actual = {field.name: field.dataType.simpleString() for field in schema.fields}
    expected = {field.name: field.type for field in contract}
    rows = [("new_field", name, None, actual[name], "warn") for name in sorted(set(actual) - set(expected))]
    rows += [("missing_field", name, expected[name], None, "default") for name in sorted(set(expected) - set(actual))]
    rows += [
        ("breaking_change", name, expected[name], actual[name], "fail")
        for name in sorted(set(actual) & set(expected)) if not compatible(actual[name], expected[name])
    ]
    return rows


def drift_report(df: DataFrame, contract: Sequence[Field] = SPECIMEN) -> DataFrame:
    """The differences as a table; it is as small as the schemas."""
    schema = "kind string, column string, expected string, actual string, action string"
    return df.sparkSession.createDataFrame(drift_rows(df.schema, contract), schema)


def drift_impact(df: DataFrame, contract: Sequence[Field] = SPECIMEN) -> DataFrame:
    """The report with how many rows each difference touches, from one pass over the table.

    That is every row for a missing column, else the rows that hold a value in the column.
    """
    rows = drift_rows(df.schema, contract)
    touched = F.array(*[
        F.struct(
            *[F.lit(value).cast("string").alias(name) for name, value in zip(("kind", "column", "expected", "actual", "action"), row)],
            (F.count("*") if row[0] == "missing_field" else F.count(F.col(row[1]))).alias("rows"),
        )
        for row in rows
    ])
    return df.agg(touched.alias("drift")).select(F.inline("drift"))


def validate(df: DataFrame, contract: Sequence[Field] = SPECIMEN) -> DataFrame:
    """Warn about additive drift, fail on a type that cannot be read as the contract says."""
    breaking = []
    for kind, name, expected, actual, action in drift_rows(df.schema, contract):
        if action == "fail":
            breaking.append(f"{name}: expected {expected}, got {actual}")
        else:
            log.warning("schema drift: %s %s (%s)", kind, name, action)
    if breaking:
        raise ValueError("breaking schema change: " + "; ".join(breaking))
    return df


def enrich_specimens(df: DataFrame) -> DataFrame:
    return df.selectExpr(
        "specimen_id", "UPPER(species) AS species_upper", "age_ma", "location", "discoverer",
        "excavation_site", "geological_period",
    )


def read_evolving(spark: SparkSession, groups: Sequence[Sequence[str]], contract: Sequence[Field] = SPECIMEN) -> DataFrame:
    """Read file groups of different schemas as one table.

    Each group has one schema; types are brought to the contract before the union, so files that
    hold int and long for one column can be read together, which a merged read refuses.
    """
    types = {field.name: field.type for field in contract}
    table = None
    for paths in groups:
        part = validate(spark.read.option("mergeSchema", "true").parquet(*paths), contract)
        part = part.withColumns({name: F.col(name).cast(types[name]) for name in part.columns if name in types})
        table = part if table is None else table.unionByName(part, allowMissingColumns=True)
    if table is None:
        raise ValueError("no file groups to read")
    return table


# Column names of the specimen records before and after.
RENAMES = {"Species": "species", "Age_MYA": "age_mya"}
REQUIRED = ("species", "age_mya")


def normalise_records(df: DataFrame) -> DataFrame:
    """Rename, drop rows with nulls in required columns, trim and lower-case, drop blanks.

    Nulls go before the cast to text, or they would come back as the word "none".
    """
    renamed = require_columns(df.withColumnsRenamed(RENAMES), REQUIRED, "records")
    kept = renamed.dropna(subset=list(REQUIRED))
    return kept.withColumn("species", F.lower(strip(F.col("species").cast("string")))).filter(F.col("species") != "")


def normalise_counts(df: DataFrame) -> DataFrame:
    """Rows kept and dropped by :func:`normalise_records`, in one pass over the input."""
    renamed = require_columns(df.withColumnsRenamed(RENAMES), REQUIRED, "records")
    nan = F.isnan("age_mya") if dict(renamed.dtypes)["age_mya"] in ("double", "float") else F.lit(False)
    good = F.coalesce(
        F.col("age_mya").isNotNull() & ~nan & (strip(F.col("species").cast("string")) != ""), F.lit(False)
    )
    return renamed.agg(F.count_if(good).alias("rows_kept"), F.count_if(~good).alias("rows_dropped"))
