"""Numbers: rounding on the exact binary value, finite coercion, money sums, printed amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CENT = 0.01 + 1e-9


def py_round(x: Column, digits: int = 2) -> Column:
    """Half-even on the exact value of the double, which neither round nor bround gives. Null, NaN and infinities give
    null; minus zero gives zero."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", finite(x), F.lit(pattern)).cast("double") + F.lit(0.0)


def finite(x: Column) -> Column:
    """x as a double; null for what is not a finite number."""
    x = x.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def money_sum(x: Column) -> Column:
    """The sum of amounts in cents, the same in whatever order a shuffle brings them."""
    return F.sum(x.cast("decimal(18,2)")).cast("double")


def agree(a: Column, b: Column) -> Column:
    """Equal to the cent."""
    return F.abs(a - b) <= CENT


def printed(x: Column) -> Column:
    """An amount as text with at least one digit after the point and no exponent."""
    return F.call_function("format_number", x, F.lit("0.0#"))


def to_number(text: Column) -> Column:
    """`$1,515.63`, `(62.47)`, `15-`, `1.234,56` and `1234,56` as doubles; null for placeholders and what has no number."""
    raw = F.trim(text)
    negative = raw.rlike(r"^\(.*\)$|^-|-$")
    kept = F.regexp_replace(raw, r"[^0-9.,]", "")
    comma, dot = F.instr(kept, ",") > 0, F.instr(kept, ".") > 0
    no_commas = F.replace(kept, F.lit(","), F.lit(""))
    decimal_comma = F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = (
        F.when(comma & dot, F.when(kept.rlike(r",[^.]*$"), decimal_comma).otherwise(no_commas))
        .when(comma, F.when(kept.rlike(r"^[^,]*,[0-9]{2}$"), decimal_comma).otherwise(no_commas))
        .otherwise(kept)
    )
    number = plain.try_cast("double")
    blank = F.lower(raw).isin("", "null", "none", "n/a", "na", "-", "--")
    return F.when(blank, None).when(negative, -F.abs(number)).otherwise(number)
