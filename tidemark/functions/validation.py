"""Validators as column expressions: what is wrong with a value, or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def non_empty(value: Column) -> Column:
    """A text that says something."""
    return F.when(value.isNull(), "missing").when(F.trim(value) == "", "empty")


def optional_text(value: Column) -> Column:
    """A text, or none; a blank one is wrong."""
    return F.when(F.trim(value) == "", "blank")


def whole_number(value: Column) -> Column:
    """Digits, with a sign or without, that fit 64 bits."""
    return F.when(value.isNull(), "missing").when(~F.trim(value).rlike("^[+-]?[0-9]+$") | F.trim(value).try_cast("long").isNull(), "not an integer")


def positive_number(value: Column) -> Column:
    """A whole number over 0."""
    wrong = whole_number(value)
    return F.when(wrong.isNotNull(), wrong).when(F.trim(value).try_cast("long") <= 0, "not positive")


def finite_number(value: Column) -> Column:
    """A number that is neither infinite nor none."""
    n = F.trim(value).try_cast("double")
    return F.when(value.isNull(), "missing").when(n.isNull(), "not a number").when(F.isnan(n) | (F.abs(n) == float("inf")), "not finite")


def boolean(value: Column) -> Column:
    """``true`` or ``false``, in any case, and no other word."""
    return F.when(value.isNull(), "missing").when(~F.lower(F.trim(value)).isin("true", "false"), "not a boolean")


def json_object(value: Column) -> Column:
    """A JSON object."""
    return F.when(value.isNull(), "missing").when(~F.trim(value).startswith("{") | F.from_json(value, "map<string,string>").isNull() | F.json_object_keys(value).isNull(), "not an object")


def identifier(value: Column) -> Column:
    """Lower-case words and numbers joined by underscores."""
    return F.when(value.isNull(), "missing").when(~value.rlike("^[a-z0-9]+(_[a-z0-9]+)*$"), "not an identifier")


def problems(checks: dict[str, Column]) -> Column:
    """Array of ``field: problem`` over checks by field; empty if all is well."""
    return F.array_compact(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{n}: "), c)) for n, c in checks.items()]))


def quarantine(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that are well, and the others with their ``problems``."""
    judged = rows.withColumn("problems", problems(checks))
    return judged.where(F.size("problems") == 0).drop("problems"), judged.where(F.size("problems") > 0)


def required(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The rows; reading one with a problem is an error that names it."""
    found = problems(checks)
    fail = F.raise_error(F.concat(F.lit("invalid row: "), F.array_join(found, ", "))).cast("boolean")
    return rows.where(F.when(F.size(found) == 0, F.lit(True)).otherwise(fail))
