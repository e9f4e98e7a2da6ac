import random
import re

import pytest
from pyspark.sql import functions as F

from tablewright.functions import cells, numbers

AMOUNT = r"[0-9,.\-]+"


@pytest.mark.parametrize(("raw", "want"), [
    ("( 297)", "(297)"), ("(123 )", "(123)"), ("((123)", "(123)"), ("( 4410", "(4410)"), ("123)", "(123)"), ("-5)", "(-5)"), ("(abc", "(abc"),
    ("(abc 12", "(abc 12)"), ("(note) 5", "(note) 5)"), ("abc)", "abc)"), ("1(((2", "1(2"), (None, None), ("", ""),
])
def test_fix_parens(spark, raw, want):
    assert spark.range(1).select(cells.fix_parens(F.lit(raw).cast("string"))).first()[0] == want


#: On a row written as one string, | between cells and ~ for null: an opening moves over the bar, and an amount that is
#: closed and opened again closes the cell before it.
MOVES = re.compile(rf"\s*\(\s*(?P<bar>\|)\s*(?P<null>~?)|(?P<before>~?)\|\s*(?P<amount>{AMOUNT})\)\((?=\s*(?:\||$))")


def rewritten(row):
    """What is left when no move applies any more, the leftmost first."""
    line = "|".join("~" if v is None else v.strip() for v in row)
    while m := MOVES.search(line):
        line = line[: m.start()] + ("|(" if m["bar"] else f")|({m['amount']})(") + line[m.end() :]
        line = "|".join(c.strip() or ("~" if i == line[: m.start()].count("|") and m["bar"] else "") for i, c in enumerate(line.split("|")))
    return [None if c == "~" else c for c in line.split("|")]


@pytest.mark.parametrize(("raw", "want"), [
    (["10,947 (", "3,094)(", "578)(", "173"], ["10,947", "(3,094)", "(578)", "(173"]), (["5 (", None, "7"], ["5", None, "(7"]), (["a (", "1)"], ["a", "(1)"]), (["X", "3)("], ["X)", "(3)("]),
    (["Vacancy", "3)(", "9"], ["Vacancy)", "(3)", "(9"]), ([None, "1)((", "x"], [")", "(1)", "((x"]),
])
def test_carry_parens(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "v array<string>")
    assert df.select(cells.carry_parens(F.col("v"))).first()[0] == want


def test_carry_parens_leaves_no_move(spark):
    rng = random.Random(3)
    parts = ["1", "2,0", ")", "(", " ", "x", ")(", "%"]
    rows = [([None if rng.random() < 0.2 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 5))],) for _ in range(3000)]
    got = spark.createDataFrame(rows, "v array<string>").select("v", cells.carry_parens(F.col("v")).alias("w")).collect()
    wrong = [(r.v, r.w, want) for r in got if (want := rewritten(r.v)) != r.w]
    assert not wrong, wrong[:5]


@pytest.mark.parametrize(("text", "want"), [
    ("2020", ["202", "0"]), ("(123.45)", ["-123.45"]), ("$1,234", ["1234"]), ("50%", ["50"]), ("(50%)", ["(50"]), ("($5)", ["5)"]), ("$(5)", ["-5"]), ("-3.34%", ["3.34"]),
    ("1234,567", ["123", "4567"]), ("1.5.2", ["1.5", "2"]), ("none", []),
])
def test_number_tokens(spark, text, want):
    assert spark.range(1).select(numbers.number_tokens(F.lit(text))).first()[0] == want


@pytest.mark.parametrize(("n", "want"), [(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (53, "BA"), (702, "ZZ")])
def test_column_letter(spark, n, want):
    assert spark.range(1).select(cells.column_letter(F.lit(n))).first()[0] == want
