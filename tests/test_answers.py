"""Objects in prose at any depth, and answers that mean the same mathematics."""

import json

import pytest
from pyspark.sql import functions as F

from episodica.functions import forms, outputs, rules

SAME = [
    ("\\frac12", "0.5"), ("\\frac{1}{2}", "1/2"), ("\\dfrac{3}{4}", "0.75"), ("\\tfrac34", "3/4"), ("\\frac{\\frac{1}{2}}{3}", "\\frac16"), ("\\frac{1}{\\frac{2}{3}}", "3/2"), ("\\frac{a}{\\frac{b}{c}}", "\\frac{ac}{b}"),
    ("\\sqrt{2}/2", "\\frac{1}{\\sqrt{2}}"), ("\\sqrt{12}", "2\\sqrt{3}"), ("\\sqrt 4", "2"), ("\\sqrt[3]{27}", "3"), ("\\sqrt{\\frac{9}{4}}", "1.5"), ("\\sqrt{x^2}", "x"), ("2^{10}", "1024"), ("2^{-1}", "0.5"), ("10^3", "1,000"),
    ("1,234,567", "1234567"), ("12 \\text{ cm}", "12"), ("5 degrees", "5"), ("90^\\circ", "90"), ("45^{\\circ}", "45"), ("\\$20", "20"), ("50\\%", "50"), ("50%", "0.5"), ("0.25", "25"), ("x = 7", "7"), ("y=\\frac{1}{3}", "1/3"), ("x \\in [0, 1]", "[0,1]"),
    ("(1, 2)", "(1,2.0)"), ("(\\frac12, 3)", "(0.5, 3)"), ("[0, \\infty)", "[0,\\infty)"), ("\\left(0, 1\\right]", "(0,1]"), ("\\{1, 2, 3\\}", "\\{3,2,1\\}"), ("\\begin{pmatrix} 1 & 2 \\\\ 3 & 4 \\end{pmatrix}", "\\begin{bmatrix}1&2\\\\3&4\\end{bmatrix}"),
    ("\\begin{array}{cc} 1 & 0.5 \\end{array}", "\\begin{pmatrix} 1 & \\frac12 \\end{pmatrix}"), ("x + 1", "1 + x"), ("2x + 3y", "3y+2x"), ("x + x", "2x"), ("2(x+1)", "2x + 2"), ("xy", "y \\cdot x"), ("x \\times y", "yx"), ("x \\cdot x", "x^2"), ("\\frac{x}{2}", "0.5x"),
    ("a+b = c^2", "c^2 = b + a"), ("x+y=3", "3 = y + x"), ("x < 2", "x<2"), ("x \\le 2", "x \\leq 2"), ("x <= 2", "x \\le 2"), ("\\pi", "3.14159265"), ("2\\pi", "\\pi \\cdot 2"), ("\\frac{\\pi}{4}", "\\pi/4"), ("e^0", "1"), ("\\sin(0)", "0"), ("\\ln(e)", "1"),
    ("seven", "7"), ("twelve", "12"), ("forty-two", "42"), ("Twenty", "20"), ("\\text{yes}", "YES"), ("\\text{Monday}", "monday"), ("1\\frac{1}{2}", "1.5"), ("2\\frac34", "2.75"), ("-\\frac{1}{2}", "-0.5"), ("-(-3)", "3"), ("3-5", "-2"), ("2^3 \\cdot 3", "24"),
    ("\\frac{10}{4}", "2.5"), ("0.3333333", "\\frac13"), ("(x+1)", "x+1"), ("\\displaystyle \\frac{1}{2}", "\\frac12"), ("\\mathbf{3}", "3"), ("3.", "3"), (".5", "0.5"), ("n!", "n!"), ("a_1 + a_2", "a_2 + a_1"), ("\\alpha + 1", "1+\\alpha"), ("f(x)", "f(x)"),
    ("(-\\infty, 1) \\cup (2, 3)", "(-\\infty,1)\\cup(2,3)"), ("1, 2", "1,2"), ("x^{2} + 2x + 1", "2x + x^2 + 1"), ("\\frac{x+1}{2}", "(x+1)/2"), ("\\frac{1}{x}", "x^{-1}"), ("2 \\text{ and } more", "2 and more"), ("6 \\div 4", "1.5"), ("((2))", "2"), ("\\log(100)", "2"),
]
OTHER = [
    ("3", "4"), ("(1,2)", "(2,1)"), ("(0,1)", "[0,1]"), ("[0,1)", "[0,1]"), ("x", "y"), ("x < 2", "x > 2"), ("x < 2", "x \\le 2"), ("\\sqrt{2}", "2"), ("1/3", "0.3"), ("x^2", "2x"), ("(1,2)", "(1,2,3)"), ("\\frac12", "\\frac13"), ("", "0"), ("a+b", "a-b"), ("\\begin{pmatrix} 1 & 2 \\end{pmatrix}", "\\begin{pmatrix} 1 \\\\ 2 \\end{pmatrix}"),
    ("yes", "no"), ("seven", "8"), ("10", "12"), ("2x+1", "2x+2"), ("\\{1,2\\}", "\\{1,3\\}"), ("5", "-5"), ("1000", "1"), ("\\pi", "3"), ("e", "\\pi"), ("a=b", "a=c"), ("\\infty", "-\\infty"), ("n!", "n"), ("\\frac{", "1"), ("x_1", "x_2"), ("sin x", "cos x"),
]


def test_same_mathematics(spark):
    assert len({p for p in SAME + OTHER}) == len(SAME) + len(OTHER)
    d = spark.createDataFrame([(a, b, True) for a, b in SAME] + [(b, a, True) for a, b in SAME] + [(a, b, False) for a, b in OTHER] + [(b, a, False) for a, b in OTHER], "a string, b string, same boolean")
    wrong = d.where(rules.math_equal(F.col("a"), F.col("b")) != F.col("same")).collect()
    assert not wrong
    for a, b in SAME:
        assert rules.math_same(a, b), (a, b)
    assert not any(rules.math_same(a, b) for a, b in OTHER)


def test_equality_is_a_join_on_shapes(spark):
    d = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(SAME)], "i int, t string").withColumn("f", forms.math_form(F.col("t")))
    e = spark.createDataFrame([(j, b) for j, (_, b) in enumerate(SAME)], "j int, u string").withColumn("g", forms.math_form(F.col("u")))
    met = d.join(e, (F.col("f.shape") == F.col("g.shape")) & forms.same_form(F.col("f"), F.col("g")))
    assert {r.i for r in met.where("i = j").collect()} == set(range(len(SAME)))


def test_odd_answers(spark):
    odd = [None, "", "  ", "{" * 500, "(" * 5000, "\\frac{1}{0}", "9" * 5000, "x^" * 300, "\x00", "0^0", "2^{99999}", "\\sqrt{-1}", "a" * 20000]
    d = spark.createDataFrame([(t,) for t in odd], "t string")
    for r in d.select("t", rules.math_equal(F.col("t"), F.lit("7")).alias("x"), rules.math_equal(F.col("t"), F.col("t")).alias("self")).collect():
        assert r.x is False and r.self is bool((r.t or "").strip(" "))
    choice = spark.createDataFrame([("The answer is (B).", "B", True), ("A or B", "B", True), ("B, not A", "B", False), ("C", "C", True)], "t string, g string, want boolean")
    assert all(r.got == r.want for r in choice.select("want", rules.math_equal(F.col("t"), F.col("g")).alias("got")).collect())


def deep(n):
    return '{"k": ' * n + "{}" + "}" * n


OBJECTS = {
    'p {"a":{"b":{"c":{"d":{"e":1}}}},"score":7} then {"score":9}': 7, 'p {"a":{"b":{"c":{"d":1}}},"score":7} then {"score":9}': 7, f'x {{"deep": {deep(12)}, "score": 3}} y': 3, f'{deep(40)} and {{"score": 4}}': None,
    "I don't know {\"score\": 5}": 5, "{ don't use {\"score\": 6}": 6, 'a { open, then {"score": 8} end': 8, '{} then {"score": 1}': 1, 'two {"score": 1} {"score": 2}': 1, '{"t": "a } b { c", "score": 2}': 2,
    '{"score": 3, /* why } not */ "t": 1}': 3, '{"score": 4, // the best\n "t": 1}': 4, '{"t": "a" + "b" +\n "c", "score": 5}': 5, '{"t": "x", "+": "y // no /* comment", "score": 6}': 6, '```\n{"score": 7}\n```': 7, '```json\nnot this\n``` but ```JSON\n{"score": 8}\n```': 8,
    "no object": None, "}{": None, "": None,
}


def test_objects_at_any_depth(spark):
    d = spark.createDataFrame([(t,) for t in OBJECTS] + [(None,)], "t string")
    for r in d.select("t", outputs.json_object(F.col("t"), "score int")["score"].alias("score")).collect():
        assert r.score == OBJECTS.get(r.t), r.t


def test_objects_with_expected_keys(spark):
    d = spark.createDataFrame([('{"a": 1} {"b": {"score": 2}} {"score": 3}',), ('{"a": 1}',)], "t string")
    assert [r.o and r.o.score for r in d.select(outputs.json_object(F.col("t"), "score int", ["score"]).alias("o")).collect()] == [2, None]


def plain_braces(text):
    """By scanning from each brace that isn't inside quotes of an object around it."""
    out, open_, quote, escape = [], [], "", False
    for i, c in enumerate(text):
        if escape:
            escape = False
        elif c == "\\":
            escape = True
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and open_:
            quote = c
        elif c == "{":
            open_.append(i)
        elif c == "}" and open_:
            first = open_.pop()
            out.append((first, text[first : i + 1]))
    return [t for _, t in sorted(out)]


@pytest.mark.parametrize("seed", range(3))
def test_balanced_parts_of_random_texts(spark, seed):
    import random

    r = random.Random(seed)
    texts = ["".join(r.choice(['{', '}', '"', "'", "\\", "a", " ", "{", "é"]) for _ in range(r.randint(0, 40))) for _ in range(200)] + [json.dumps({"a": [{"b": {"c": "}"}}] * 3})]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in d.select("t", outputs.balanced(F.col("t")).alias("parts")).collect():
        assert row.parts == plain_braces(row.t), row.t
