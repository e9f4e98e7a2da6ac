"""Repair of parenthesised negatives in cells and along rows, and small cell functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters of a printed amount.
AMOUNT = "[0-9,.-]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def fix_parens(value: Column) -> Column:
    """Close or open a lone parenthesis around an amount; blanks inside parentheses and doubled openings go."""
    v = strip(value)
    for pattern, new in ((r"\(\s+", "("), (r"\s+\)", ")"), (r"\(+", "(")):
        v = F.regexp_replace(v, pattern, new)
    opens, closes = v.startswith("("), v.endswith(")")
    return (
        F.when(opens & ~closes & v.rlike(f"{AMOUNT}$"), F.concat(v, F.lit(")")))
        .when(closes & ~opens & v.rlike(rf"^{AMOUNT}\)$"), F.concat(F.lit("("), v))
        .otherwise(v)
    )


def fix_percent(value: Column) -> Column:
    """Drop an opening parenthesis left behind a percent sign at the end."""
    return F.regexp_replace(strip(value), r"%\s*\($", "%")


def carry_parens(row: Column) -> Column:
    """Move parentheses that a cell split left at its end to the cell they belong to, along a row of strings.

    One fold from left to right. An opening at the end of a cell travels to the next cell, through nulls; a cell that is
    an amount with `)(` closes the cell before it and opens anew. The last cell keeps what it gets.
    """
    n = F.size(row)

    def take(acc: Column, cell: Column) -> Column:
        k, carry, out = acc["k"], acc["carry"], acc["out"]
        last = k == n - 1
        v = strip(cell)
        meets = v.rlike(rf"^{AMOUNT}\)\($") | (~last & v.rlike(rf"^{AMOUNT}\)\((\s*\()+$"))
        fires = F.coalesce((k > 0) & (carry == 0) & meets, F.lit(False))
        before = F.when(fires, F.concat(F.slice(out, F.lit(1), F.greatest(k - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.get(out, k - 1), F.lit("")), F.lit(")"))))).otherwise(out)
        v = F.when(fires, F.concat(F.lit("("), v)).otherwise(v)
        v = F.when(carry > 0, F.concat(F.repeat(F.lit("("), carry), F.coalesce(v, F.lit("")))).otherwise(v)
        run = F.when(last, F.lit("")).otherwise(F.coalesce(F.regexp_extract(v, r"((?:\s*\()+)$", 1), F.lit("")))
        rest = strip(F.substr(v, F.lit(1), F.length(v) - F.length(run)))
        kept = F.when(F.length(run) == 0, v).when(rest == "", F.lit(None)).otherwise(rest)
        opened = F.length(F.regexp_replace(run, r"[^(]", ""))
        return F.struct(F.concat(before, F.array(kept)).alias("out"), opened.alias("carry"), (k + 1).alias("k"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("carry"), F.lit(0).alias("k"))
    return F.aggregate(row, start, take, lambda acc: acc["out"])


def clean_row(row: Column) -> Column:
    """What a table read from a picture gets: carry_parens, then for each cell fix_percent and fix_parens."""
    return F.transform(carry_parens(row), lambda v: fix_parens(fix_percent(v)))


def column_letter(n: Column) -> Column:
    """1 is A, 27 is AA; up to 702 (ZZ)."""
    letter = lambda i: F.char((i + 65).cast("int"))
    return F.when(n <= 26, letter(n - 1)).otherwise(F.concat(letter(F.floor((n - 27) / 26)), letter(F.pmod(n - 1, F.lit(26)))))
