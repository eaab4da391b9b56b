"""One canonical form for each written mathematical answer: a small recursive parser with exact fractions, run once a text on Arrow batches.

A form is a shape (operators and symbols, `#` for each number) and the numbers in order. Equality of two answers is a comparison of their forms,
so that many answers are matched by a join on the shape, never pair by pair in Python.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

# Spellings of numbers, names of functions and constants, and units that don't count.
WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
UNITS = "degrees? dollars? cents? units? cm mm km m kg g inches inch feet foot hours? minutes? seconds? days? square cubic points? miles?".split()
NAMES = ["sin", "cos", "tan", "log", "ln", "exp", "sqrt", "frac", "pi", "infty", "cup", "cap", "cdot", "times", "div", "pm", "le", "ge", "ne", "in", "mathbb", "alpha", "beta", "theta", "lambda", "binom"]

_TOKEN = re.compile(r"\s*(\d+\.?\d*|\.\d+|\\begin\{\w+\}|\\end\{\w+\}|\\\\|\\[A-Za-z]+|<=|>=|[A-Za-z]|\S)")
_DROP = re.compile(r"(?<!\\)\\(?:left|right|displaystyle|!|,|;|:| |\$|%|mathrm|mathbf|mathit|textbf|operatorname)(?![a-z])|\^\{?\\circ\}?|[$%]")
_VALUES = {"pi": math.pi, "e": math.e, "infty": math.inf}
_FUNCTIONS = {"sin": math.sin, "cos": math.cos, "tan": math.tan, "ln": math.log, "log": math.log10, "exp": math.exp}


def number_words(text: str) -> str:
    """"forty-two" as 42, up to 99."""
    parts = re.split(r"[\s-]+", text.strip().lower())
    if len(parts) == 1 and parts[0] in WORDS:
        return str(WORDS.index(parts[0]))
    if parts[0] in TENS and (len(parts) == 1 or len(parts) == 2 and parts[1] in WORDS[1:10]):
        return str(20 + 10 * TENS.index(parts[0]) + (WORDS.index(parts[1]) if len(parts) == 2 else 0))
    return text


def tidy(text: str) -> str:
    """Without what only dresses an answer: display commands, text around it, units, thousands' commas, a short name before `=`."""
    t = text.replace("\n", " ").strip().rstrip(".").replace("\\{", "{").replace("\\}", "}")
    t = re.sub(r"\\[dt]frac", r"\\frac", _DROP.sub("", t).replace("\\(", "").replace("\\)", ""))
    t = re.sub(r"\\begin\{array\}\{[^}]*\}", r"\\begin{pmatrix}", t).replace("\\end{array}", "\\end{pmatrix}").replace("bmatrix", "pmatrix")
    bare = re.sub(r"\\(?:text|mbox)\{[^{}]*\}\s*$", "", t).strip()
    t = re.sub(r"\\(?:text|mbox)\{([^{}]*)\}", r"\1", bare or t)
    t = re.sub(rf"(?<=[\d}}\s])\s*\b(?:{'|'.join(UNITS)})\b\.?", "", t) if re.search(r"\d", t) else t
    t = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", t) if not re.match(r"\s*[\[({]", t) else t
    return number_words(re.sub(r"^\s*[A-Za-z]\w?\s*(?:=|\\in(?![a-z]))\s*", "", t).strip())


class Parser:
    """Recursive descent: relations, sums, products (written or not), powers, fractions, roots, lists in brackets, matrices."""

    def __init__(self, text: str):
        self.left = _TOKEN.findall(text)

    def peek(self) -> str:
        return self.left[0] if self.left else ""

    def take(self) -> str:
        if not self.left:
            raise ValueError("the answer ends too soon")
        return self.left.pop(0)

    def whole(self):
        parts = [self.relation()]
        while self.peek() in (",", ";", "\\cup"):
            parts.append(self.take()) if self.peek() == "\\cup" else self.take()
            parts.append(self.relation())
        if self.left:
            raise ValueError(f"not understood: {self.left[0]}")
        return parts[0] if len(parts) == 1 else ("list", "", *parts)

    def relation(self):
        a = self.sum()
        while self.peek() in ("=", "<", ">", "<=", ">=", "\\le", "\\ge", "\\leq", "\\geq", "\\ne", "\\neq", "\\in"):
            sign = self.take().replace("\\", "").replace("<=", "le").replace(">=", "ge").replace("leq", "le").replace("geq", "ge")
            b = self.sum()
            a = ("rel", sign, *sorted((a, b), key=repr)) if sign == "=" else ("rel", sign, a, b)
        return a

    def sum(self):
        sign = -1 if self.peek() == "-" and self.take() else 1
        if self.peek() == "+":
            self.take()
        parts = [times([sign, self.product()])]
        while self.peek() in ("+", "-"):
            sign = 1 if self.take() == "+" else -1
            parts.append(times([sign, self.product()]))
        return plus(parts)

    def product(self):
        parts = [self.power()]
        while (p := self.peek()) and p not in ("+", "-", ",", ";", ")", "]", "}", "&", "=", "<", ">", "<=", ">=", "\\\\", "|") and not (p.startswith("\\end") or p in ("\\cup", "\\in", "\\le", "\\ge", "\\leq", "\\geq", "\\ne", "\\neq")):
            if p in ("*", "\\cdot", "\\times"):
                self.take()
                parts.append(self.power())
            elif p in ("/", "\\div"):
                self.take()
                parts.append(power(self.power(), Fraction(-1)))
            elif isinstance(parts[-1], Fraction) and p == "\\frac" and parts[-1].denominator == 1 and len(parts) == 1:  # a mixed number
                f = self.power()
                parts = [parts[0] + f] if isinstance(f, Fraction) and 0 < f < 1 else [*parts, f]
            else:
                parts.append(self.power())
        return times(parts)

    def power(self):
        a = self.atom()
        while self.peek() in ("^", "!"):
            a = power(a, self.argument()) if self.take() == "^" else ("fn", "!", a)
        return a

    def argument(self):
        """What a command takes: a group, or one digit or sign."""
        if self.peek() == "{":
            return self.atom()
        t = self.take()
        if t[0].isdigit() and len(t) > 1 and "." not in t:
            self.left.insert(0, t[1:])
            t = t[0]
        if t == "-":
            return times([-1, self.argument()])
        self.left.insert(0, t)
        return self.atom()

    def atom(self):
        t = self.take()
        if t == "-":
            return times([-1, self.power()])
        if t[0].isdigit() or t[0] == "." and len(t) > 1:
            return Fraction(t.rstrip(".") or "0")
        if t in ("(", "[", "{"):
            return self.bracket(t)
        if t.startswith("\\begin"):
            return self.matrix()
        name = t.removeprefix("\\")
        if name == "frac":
            return times([self.argument(), power(self.argument(), Fraction(-1))])
        if name == "sqrt":
            degree = Fraction(2)
            if self.peek() == "[":
                degree = self.bracket(self.take())
            return power(self.argument(), power(degree, Fraction(-1)))
        if name in _FUNCTIONS:
            return ("fn", name, self.power())
        if re.fullmatch(r"[A-Za-z]+|\W", name) and t not in (")", "]", "}", "&", "\\\\"):
            if self.peek() == "_":
                self.take()
                name += f"_{self.argument()}"
            return ("sym", name)
        raise ValueError(f"not understood: {t}")

    def bracket(self, opened: str):
        parts, closed = [], {"(": ")]", "[": ")]", "{": "}"}[opened]
        while self.peek() not in tuple(closed):
            parts.append(self.relation())
            if self.peek() in (",", ";"):
                self.take()
        end = self.take()
        if len(parts) == 1 and opened + end in ("()", "{}", "[]"):
            return parts[0]
        return ("list", opened + end, *(sorted(parts, key=repr) if opened == "{" else parts))

    def matrix(self):
        rows = [[]]
        while not self.peek().startswith("\\end"):
            if self.peek() == "\\\\":
                self.take()
                rows.append([])
            elif self.peek() == "&":
                self.take()
            else:
                rows[-1].append(self.relation())
        self.take()
        return ("list", "matrix", *(("list", "row", *r) for r in rows if r))


def plus(parts: list):
    flat = [q for p in parts for q in (p[1:] if isinstance(p, tuple) and p[0] == "+" else [p])]
    number = sum((p for p in flat if isinstance(p, Fraction)), Fraction(0))
    counts: dict[str, list] = {}
    for p in flat:
        if not isinstance(p, Fraction):
            factor, rest = (p[1], times(list(p[2:]))) if p[0] == "*" and isinstance(p[1], Fraction) else (Fraction(1), p)
            counts.setdefault(repr(rest), [Fraction(0), rest])[0] += factor
    rest = [times([f, r]) for _, (f, r) in sorted(counts.items()) if f]
    rest = rest + [number] if number or not rest else rest
    return rest[0] if len(rest) == 1 else ("+", *rest)


def times(parts: list):
    flat = [q for p in parts for q in (p[1:] if isinstance(p, tuple) and p[0] == "*" else [Fraction(p) if isinstance(p, int) else p])]
    number = math.prod((p for p in flat if isinstance(p, Fraction)), start=Fraction(1))
    exponents: dict[str, list] = {}
    for p in flat:
        if not isinstance(p, Fraction):
            base, e = (p[1], p[2]) if p[0] == "^" else (p, Fraction(1))
            at = exponents.setdefault(repr(base), [base, Fraction(0)])
            at[1] = plus([at[1], e])
    rest = [power(b, e) for _, (b, e) in sorted(exponents.items())]
    number *= math.prod((p for p in rest if isinstance(p, Fraction)), start=Fraction(1))
    rest = [p for p in rest if not isinstance(p, Fraction)]
    if not number or not rest:
        return number
    if len(rest) == 1 and rest[0][0] == "+" and number != 1:
        return plus([times([number, p]) for p in rest[0][1:]])
    return rest[0] if number == 1 and len(rest) == 1 else ("*", *([number] if number != 1 else []), *rest)


def power(a, e):
    if isinstance(a, Fraction) and isinstance(e, Fraction):
        if e.denominator == 1 and abs(e) <= 64 and (a or e > 0):
            return a ** int(e)
        if e.denominator <= 8 and a > 0 and abs(e.numerator) <= 8:
            roots = [round(x ** (1 / e.denominator)) for x in (a.numerator, a.denominator)]
            if roots[0] ** e.denominator == a.numerator and roots[1] ** e.denominator == a.denominator:
                return Fraction(*roots) ** e.numerator
    if isinstance(e, Fraction) and e == 1:
        return a
    if isinstance(e, Fraction) and e == 0:
        return Fraction(1)
    if isinstance(a, tuple) and a[0] == "^":
        return power(a[1], times([a[2], e]))
    if isinstance(a, tuple) and a[0] == "*" and isinstance(e, Fraction) and e.denominator == 1:
        return times([power(p, e) for p in a[1:]])
    return ("^", a, e)


def value(node) -> float | None:
    """The number that a closed expression stands for."""
    if isinstance(node, Fraction):
        return float(node)
    kind, *rest = node
    if kind == "sym":
        return _VALUES.get(rest[0])
    if kind in ("+", "*", "^"):
        parts = [value(p) for p in rest]
        if None in parts:
            return None
        out = sum(parts) if kind == "+" else math.prod(parts) if kind == "*" else parts[0] ** parts[1]
        return out if isinstance(out, float) and not math.isnan(out) else None
    if kind == "fn" and rest[0] in _FUNCTIONS and (v := value(rest[1])) is not None:
        return _FUNCTIONS[rest[0]](v)
    return None


def render(node, numbers: list[float]) -> str:
    v = value(node)
    if v is not None:
        numbers.append(v)
        return "#"
    kind, *rest = node
    if kind == "sym":
        return rest[0]
    head = [rest.pop(0)] if kind in ("list", "rel", "fn") else []
    return f"({' '.join([kind, *head, *(p if p == '\\cup' else render(p, numbers) for p in rest)])})"


def form(text: str | None) -> tuple[str, list[float]] | None:
    """(shape, numbers); a text of words or one that isn't understood is its own shape, without blanks and case; null and blank texts have none."""
    t = (text or "").strip()
    if not t:
        return None
    try:
        numbers: list[float] = []
        if re.fullmatch(r"[A-Za-z\s]*[A-Za-z]{3,}[A-Za-z\s]*", tidy(t)):
            raise ValueError("words")
        return render(Parser(tidy(t)).whole(), numbers), numbers
    except (ValueError, KeyError, OverflowError, ZeroDivisionError, RecursionError, TypeError, IndexError):
        return "text " + re.sub(r"\s+", "", tidy(t)).lower(), []


@pandas_udf(StructType([StructField("shape", StringType()), StructField("numbers", ArrayType(DoubleType()))]))
def _forms(texts: pd.Series) -> pd.DataFrame:
    known = {t: form(t) or (None, None) for t in texts.unique()}
    return pd.DataFrame([known[t] for t in texts], columns=["shape", "numbers"])


def math_form(x: Column) -> Column:
    """Struct of shape and numbers of a written answer: equal shapes are what a join matches, same_form() tells whether their numbers agree."""
    return _forms(x)


def same_form(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    """Whether two forms agree: equal shapes and numbers within a relative tolerance (of b); a single number also as a percentage of the other."""
    near = lambda x, y: (x == y) | ((F.abs(x - y) <= F.lit(tolerance) * F.greatest(F.abs(x), F.abs(y))) & (F.abs(x - y) < F.lit(math.inf)))
    x, y = F.get(a["numbers"], 0), F.get(b["numbers"], 0)
    one = (a["shape"] == "#") & (near(x * 100, y) | near(x, y * 100))
    each = F.forall(F.zip_with(a["numbers"], b["numbers"], lambda x, y: F.coalesce(near(x, y), F.lit(False))), lambda same: same)
    return F.coalesce((a["shape"] == b["shape"]) & (one | each), F.lit(False))


def math_same(a: str | None, b: str | None, tolerance: float = 1e-4) -> bool:
    """same_form() of two texts, for single answers in a driver."""
    f, g = form(a), form(b)
    if f is None or g is None or f[0] != g[0]:
        return False
    near = lambda x, y: x == y or abs(x - y) <= tolerance * max(abs(x), abs(y)) < math.inf
    if f[0] == "#" and (near(f[1][0] * 100, g[1][0]) or near(f[1][0], g[1][0] * 100)):
        return True
    return all(near(x, y) for x, y in zip(f[1], g[1], strict=True))
