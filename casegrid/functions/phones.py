"""Phone numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(c: Column) -> Column:
    """All decimal digits of a string, in order; null stays null."""
    return F.regexp_replace(c, r"[^0-9]", "")


def suffix(c: Column, n: int) -> Column:
    """Last n characters; empty if shorter or null."""
    return F.when(F.length(c) >= n, F.right(c, F.lit(n))).otherwise(F.lit(""))


def with_country(raw: Column, country: str = "91") -> Column:
    """Digits of a number with its country prefix; null where there is no digit.

    `+` or `00` introduces a prefix; ten digits, or 0 and ten digits, get `country`; shorter ones are short codes.
    """
    only = digits(raw)
    plus = F.coalesce(F.rlike(raw, F.lit(r"^[^0-9+]*\+")), F.lit(False))
    found = (  # the first condition holds the digits, so that they are made once for all branches
        F.when((F.length(only) > 0) & plus, only)
        .when(only.startswith("00"), F.substring(only, 3, 1 << 20))
        .when((F.length(only) == 11) & only.startswith("0"), F.concat(F.lit(country), F.substring(only, 2, 10)))
        .when(F.length(only) == 10, F.concat(F.lit(country), only))
        .otherwise(only)
    )
    return F.when(F.length(found) > 0, found)


def e164(raw: Column, country: str = "91") -> Column:
    """Normalised number with `+`: strip to digits and `+`; `00` becomes `+`; 0 and ten digits, ten digits and
    longer numbers are completed; anything else gets the country in front. Null for null or blank."""
    kept = F.regexp_replace(raw, r"[^0-9+]", "")
    n = F.length(kept)
    found = (
        F.when(kept.startswith("+"), kept)
        .when(kept.startswith("00"), F.concat(F.lit("+"), F.substring(kept, 3, 1 << 20)))
        .when(kept.startswith("0") & (n == 11), F.concat(F.lit("+" + country), F.substring(kept, 2, 10)))
        .when(n == 10, F.concat(F.lit("+" + country), kept))
        .when(n > 10, F.concat(F.lit("+"), kept))
        .otherwise(F.concat(F.lit("+" + country), kept))
    )
    return F.when(n > 0, found)
