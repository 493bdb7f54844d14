"""Differences between two copies of one dataset, field by field."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "#row"


@dataclass(frozen=True)
class Field:
    """A field to compare. left and right are expressions of either side; tolerance is for arrays of numbers."""

    name: str
    left: Column | None = None
    right: Column | None = None
    tolerance: float | None = None

    def of(self, side: str) -> Column:
        given = self.left if side == "l" else self.right
        return given if given is not None else F.col(self.name)


def arrays_close(a: Column, b: Column, tolerance: float) -> Column:
    """True if both are null, or equally long with no number (or null) further apart than the tolerance."""
    apart = F.zip_with(
        a,
        b,
        lambda x, y: F.when(x.isNull() | y.isNull(), x.isNull() != y.isNull()).otherwise(
            F.abs(x.cast("double") - y.cast("double")) > F.lit(tolerance)
        ),
    )
    same = (F.size(a) == F.size(b)) & ~F.exists(apart, lambda z: z)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)


def current_rows(df: DataFrame, key: str, row: Column, version: str | None) -> DataFrame:
    """(_key, _row): of every key the row with the highest version, of equal ones the greatest row; rows without a key are ignored.

    Each task keeps only its own newest row of a key, so a key written a great many times moves a handful of rows.
    """
    order = F.coalesce(F.col(version).cast("bigint"), F.lit(-(2**63))) if version else F.lit(0)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.struct(order.alias("_order"), row.alias("_row")).alias("_won"))
    return rows.groupBy("_key").agg(F.max("_won").alias("_won")).select("_key", F.col("_won._row").alias("_row"))


def signed_cells(df: DataFrame, key: str, fields: list[Field], version: str | None, side: str) -> DataFrame:
    """(_key, field, value, numbers, sign) of one side: a row per field of every key's current row, and one for the row itself.

    The left counts +1, the right -1. Values are compared as strings, arrays of numbers as they are.
    """
    row = F.struct(F.lit(1).alias("_"), *[f.of(side).alias(f.name) for f in fields])
    rows = current_rows(df, key, row, version)
    kind = next((rows.schema["_row"].dataType[f.name].dataType.simpleString() for f in fields if f.tolerance is not None), "array<double>")
    nothing, none = F.lit(None).cast("string"), F.lit(None).cast(kind)
    cell = lambda name, value, numbers: F.struct(F.lit(name).alias("field"), value.alias("value"), numbers.alias("numbers"))
    of = lambda f: F.col("_row")[f.name]
    cells = [cell(f.name, nothing, of(f)) if f.tolerance is not None else cell(f.name, of(f).cast("string"), none) for f in fields]
    return rows.select("_key", F.explode(F.array(cell(ROW, nothing, none), *cells)).alias("c"), F.lit(1 if side == "l" else -1).alias("sign")).select("_key", "c.*", "sign")


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    key: str,
    fields: list[Field],
    version: str | None = None,
    left_lacks: str = "not_in_left",
    right_lacks: str = "not_in_right",
) -> DataFrame:
    """Rows (key, difference): keys that one side lacks, and each field whose value differs on both.

    Each side's current rows are unpivoted by themselves to key, field and value, the left with count +1, the right with -1.
    Both are put together and grouped by key and field: a cell cancels if its counts sum to nought and its two values are equal or, for
    arrays with a tolerance, close. What does not cancel is a difference: a whole row's cell shows a key that one side lacks, a field's a value that differs.

    Null equals null and differs from any value. Of several rows of one key that with the highest version
    counts. Rows with a null key are ignored. Empty sides give one difference per key of the other.
    Columns that are not named as fields play no part, whatever they are called.
    """
    cells = signed_cells(left, key, fields, version, "l").unionByName(signed_cells(right, key, fields, version, "r"))
    own, other = F.col("sign") > 0, F.col("sign") < 0
    exact = {f.name: f.tolerance for f in fields if f.tolerance is not None}
    aggs = [F.sum("sign").alias("net"), F.max(F.when(own, F.col("value"))).alias("a"), F.max(F.when(other, F.col("value"))).alias("b")]
    if exact:
        aggs += [F.max(F.when(own, F.col("numbers"))).alias("x"), F.max(F.when(other, F.col("numbers"))).alias("y")]
    met = cells.groupBy("_key", "field").agg(*aggs)
    same = F.col("a").eqNullSafe(F.col("b"))
    for name, tolerance in exact.items():
        same = F.when(F.col("field") == name, arrays_close(F.col("x"), F.col("y"), tolerance)).otherwise(same)
    # a key that one side lacks is told by its row's cell alone
    said = (
        F.when((F.col("field") == ROW) & (F.col("net") > 0), right_lacks)
        .when((F.col("field") == ROW) & (F.col("net") < 0), left_lacks)
        .when((F.col("field") != ROW) & (F.col("net") == 0) & ~same, F.col("field"))
    )
    return met.select(F.col("_key").alias(key), said.alias("difference")).where("difference is not null")
