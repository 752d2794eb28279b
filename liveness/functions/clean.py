"""Record cleaning as column expressions chosen by each column's data type."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegralType, StringType

from .. import constants as K
from .scores import _c


def is_null_token(col) -> Column:
    """NULL, '', 'NULL' or 'N/A' (exact: untrimmed and case-sensitive)."""
    c = _c(col)
    return c.isNull() | c.isin(*K.NULL_TOKENS)


def normalize_nulls(df: DataFrame) -> DataFrame:
    """Null tokens -> NULL in every string column; other columns unchanged."""
    return df.select(*[
        F.when(is_null_token(f.name), F.lit(None).cast("string")).otherwise(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, StringType) else F.col(f.name)
        for f in df.schema.fields])


def sanitize_text(col) -> Column:
    """Strip surrounding white space (Unicode-aware) and upper-case."""
    return F.upper(F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", ""))


#: Digit strings are read as whole numbers of up to this many digits; longer ones are kept as text beside.
VALUE_TYPE, VALUE_DIGITS = "decimal(38,0)", 38


def _overlong(c: Column) -> Column:
    return c.rlike(r"\A0*[1-9][0-9]{%d,}\z" % VALUE_DIGITS)


def clean_value(df: DataFrame, col: str = "value") -> Column:
    """Digit strings -> integer (unclamped); integers -> clamped to [0, 1000]
    (booleans count as integers); anything else -> -1; null tokens -> NULL.

    The integer is a DECIMAL(38,0); a digit string longer than that gives NULL here and is
    kept as it is by ``quarantined_value``."""
    dtype = df.schema[col].dataType
    c = F.col(col)
    error = F.lit(K.VALUE_ERROR).cast(VALUE_TYPE)
    if isinstance(dtype, StringType):
        digits = F.regexp_replace(c, r"\A0+(?=[0-9])", "").cast(VALUE_TYPE)
        return F.when(is_null_token(c) | _overlong(c), F.lit(None).cast(VALUE_TYPE)).when(
            c.rlike(r"\A[0-9]+\z"), digits).otherwise(error)
    if isinstance(dtype, (IntegralType, BooleanType)):
        v = c.cast("bigint")
        return F.least(F.greatest(v, F.lit(K.VALUE_MIN)), F.lit(K.VALUE_MAX)).cast(VALUE_TYPE)
    return F.when(c.isNull(), F.lit(None).cast(VALUE_TYPE)).otherwise(error)


def quarantined_value(df: DataFrame, col: str = "value") -> Column:
    """The digit strings that are too long for ``clean_value``; NULL for every other value."""
    if not isinstance(df.schema[col].dataType, StringType):
        return F.lit(None).cast("string")
    return F.when(_overlong(F.col(col)), F.col(col))


def clean_records(df: DataFrame, value: str = "value", status: str = "status") -> DataFrame:
    """Null tokens -> NULL everywhere; ``status`` sanitised; ``value`` cleaned, with digit strings
    too long for it in ``<value>_quarantine``; other columns unchanged. One projection, no shuffle."""
    out = []
    for f in df.schema.fields:
        if f.name == value:
            out.append(clean_value(df, value).alias(value))
            out.append(quarantined_value(df, value).alias(f"{value}_quarantine"))
        elif f.name == status:
            s = F.col(status)
            out.append(F.when(is_null_token(s), F.lit(None).cast("string")).otherwise(sanitize_text(s)).alias(status))
        elif isinstance(f.dataType, StringType):
            out.append(F.when(is_null_token(f.name), F.lit(None).cast("string")).otherwise(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# --- arithmetic formulas ----------------------------------------------------------

def _floor_div(a: Column, b: Column) -> Column:
    """Quotient rounded down, as a whole number; whole operands are divided as whole numbers.
    NULL for a divisor of 0."""
    whole = F.call_function("div", a - _modulo(a, b), F.nullif(b, F.lit(0)))
    real = F.typeof(a).isin("float", "double") | F.typeof(b).isin("float", "double")
    return F.when(real, F.floor(F.try_divide(a, b)).cast("bigint")).otherwise(whole.cast("bigint"))


def _modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; NULL for a divisor of 0."""
    d = F.nullif(b, F.lit(0))
    return F.try_mod(F.try_mod(a, d) + d, d)


def _power(a: Column, b: Column) -> Column:
    """NULL where the power is not a real, finite number: 0 to a negative power, a negative
    base with a fraction, or an overflow."""
    p = F.pow(a, b)
    return F.when((a == 0) & (b < 0), F.lit(None)).when(F.isnan(p) | (F.abs(p) == float("inf")), F.lit(None)).otherwise(p)


_BINOPS = {
    ast.Add: lambda a, b: F.try_add(a, b),
    ast.Sub: lambda a, b: F.try_subtract(a, b),
    ast.Mult: lambda a, b: F.try_multiply(a, b),
    ast.Div: lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    ast.FloorDiv: _floor_div,
    ast.Mod: _modulo,
    ast.Pow: _power,
}


def formula_column(formula: str, context: dict[str, Column]) -> Column:
    """Compile an arithmetic formula over named columns into a Column.

    Allowed: numbers, names from ``context``, + - * / // % ** and unary +/-. Anything
    else (calls, attributes, unknown names) is rejected here, before any data is read;
    a formula that fails at run time (overflow, division by zero, NULL input) gives
    NULL for that row. Nothing is evaluated with ``eval``."""
    tree = ast.parse(formula, mode="eval")

    def build(node) -> Column:
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) \
                and not isinstance(node.value, bool):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            if node.id not in context:
                raise ValueError(f"unknown name {node.id!r} in formula")
            return context[node.id]
        if isinstance(node, ast.BinOp) and type(node.op) in _BINOPS:
            return _BINOPS[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            v = build(node.operand)
            return F.try_subtract(F.lit(0), v) if isinstance(node.op, ast.USub) else v
        raise ValueError(f"formula element not allowed: {ast.dump(node)[:80]}")

    return build(tree)


def evaluate_formula(df: DataFrame, formula: str, names: dict[str, str], out: str = "result") -> DataFrame:
    """Adds ``out`` = formula evaluated per row with ``names`` mapping formula names to
    columns; rows where it cannot be computed get NULL."""
    ctx = {k: F.col(v) for k, v in names.items()}
    return df.withColumn(out, formula_column(formula, ctx))
