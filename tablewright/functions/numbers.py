"""Numbers printed in text: tokens, accounting negatives and comparison keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a printed number.
NUMBER = r"\$?\(?[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?\)?%?"


def number_tokens(text: Column) -> Column:
    """All number tokens of a text without $ , and %, wrapped ones negative. Null text: null."""

    def plain(token: Column) -> Column:
        bare = F.translate(token, "$,%", "")
        wrapped = bare.startswith("(") & bare.endswith(")")
        return F.when(wrapped, F.concat(F.lit("-"), F.substr(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)

    # most texts have no digit, which is quickly told
    found = F.when(text.rlike("[0-9]"), F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))).when(text.isNotNull(), F.array().cast("array<string>"))
    return F.transform(found, plain)


def token_number(token: Column) -> Column:
    """The token as a double, -0.0 as 0.0; null if it isn't one."""
    return token.try_cast("double") + F.lit(0.0)


def token_rest(token: Column) -> Column:
    """The token itself where it is no number."""
    return F.when(token_number(token).isNull(), token)
