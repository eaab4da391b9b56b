"""Answer equality: of numbers, natively, and of written mathematics, by canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .forms import math_form, math_same, same_form  # noqa: F401

_PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)$"
_POWER = r"^[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+$"


def _digits(t: Column) -> Column:
    """One text for each plain decimal of any length: its sign, digits without leading zeros, point, digits without trailing zeros. Null for other texts."""
    body = F.regexp_replace(t, "^[+-]", "")
    whole = F.regexp_replace(F.regexp_extract(body, r"^(\d*)", 1), "^0+", "")
    part = F.regexp_replace(F.regexp_extract(body, r"\.(\d*)$", 1), "0+$", "")
    value = F.concat(whole, F.lit("."), part)
    return F.when(t.rlike(_PLAIN), F.when(t.startswith("-") & (value != "."), F.concat(F.lit("-"), value)).otherwise(value))


def numeric_equal(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """Whether two texts are numbers within a tolerance; thousands' commas and an end's dots don't count. Plain decimals are compared exactly, whatever their length; powers of ten and tolerances by 38 digits, else as doubles."""
    x, y = (F.rtrim(F.trim(F.replace(c, F.lit(","), F.lit(""))), F.lit(".")) for c in (a, b))
    number = lambda t: t.rlike(_PLAIN) | t.rlike(_POWER)
    exact = [t.try_cast("decimal(38,18)") for t in (x, y)]
    rough = [t.try_cast("double") for t in (x, y)]
    near = F.when(exact[0].isNotNull() & exact[1].isNotNull(), F.abs(exact[0] - exact[1]) <= F.lit(str(tolerance)).cast("decimal(38,18)")).otherwise(F.abs(rough[0] - rough[1]) <= tolerance)
    same = near if tolerance else F.coalesce(_digits(x) == _digits(y), near)
    return F.coalesce(number(x) & number(y) & same, F.lit(False))


def exact_match(predicted: Column, label: Column, tolerance: float = 0.0) -> Column:
    """Equal numbers within a tolerance, else equal stripped texts; an empty prediction matches nothing."""
    a, b = F.trim(F.coalesce(predicted, F.lit(""))), F.trim(F.coalesce(label, F.lit("")))
    return F.when(a == "", False).when(a == b, True).otherwise(numeric_equal(a, b, tolerance))


def math_equal(a: Column, b: Column) -> Column:
    """Whether two written answers are the same mathematics (forms.py): each text's form is made once, the comparison is native. A lone choice letter is found in a text that names it last."""
    x, y = F.trim(a), F.trim(b)
    choice = y.rlike("^[A-E]$") & (F.element_at(F.regexp_extract_all(F.upper(x), F.lit(r"\b([A-E])\b"), F.lit(1)), -1) == y)
    said = F.regexp_count(F.upper(x), F.lit(r"\b[A-E]\b")) > 0
    return F.coalesce(F.when(F.lower(x) == F.lower(y), x != "").when(said & choice, True).otherwise(same_form(math_form(a), math_form(b))), F.lit(False))
