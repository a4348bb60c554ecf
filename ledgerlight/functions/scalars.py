"""Scalar functions as Column expressions, all evaluated in the JVM.

Digits are ASCII only; case folding is ``lower``. Unknown is null and never becomes zero.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import constants as K


def strip(c: Column) -> Column:
    """Without Unicode blanks at either end."""
    return F.btrim(c, F.lit(K.BLANK_CHARACTERS))


def collapse(c: Column) -> Column:
    """Stripped, with each run of blanks as one space."""
    return strip(F.regexp_replace(c, K.BLANKS, " "))


def normal(c: Column) -> Column:
    """Lower-case letters and digits only; null gives an empty string."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def money_cents(c: Column) -> Column:
    """Exact cents as DECIMAL(38,0) of a nonnegative dollar amount, else null."""
    return amount_cents(amount(strip(c)))


def amount(given: Column) -> Column:
    """A stripped value without its dollar sign and the blanks after that."""
    return F.when(F.startswith(given, F.lit("$")), strip(F.substring(given, 2, 1 << 30))).otherwise(given)


def amount_cents(raw: Column) -> Column:
    """``money_cents`` of an ``amount``: as a column of its own, that is worked out once."""
    ok = (F.length(raw) <= K.MONEY_CHARS) & raw.rlike(K.MONEY)
    return F.when(ok, (F.replace(raw, F.lit(","), F.lit("")).try_cast("decimal(20,2)") * 100).cast("decimal(38,0)"))


def money_text(cents: Column) -> Column:
    """Canonical form of cents, like 150.00."""
    return (cents.cast("decimal(30,0)") / 100).cast("decimal(32,2)").cast("string")


def dollars(cents: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number((cents.cast("decimal(30,0)") / 100).cast("decimal(32,2)"), 2)), F.lit("Unknown"))


def strict_date(c: Column) -> Column:
    """A date written as YYYY-MM-DD and nothing else; there is no year 0."""
    return F.when(c.rlike(K.ISO_DATE) & ~F.startswith(c, F.lit("0000")), c.try_cast("date"))


def loose_date(c: Column) -> Column:
    """A date in one of the four forms that documents use."""
    forms = ((r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z", "yyyy-M-d"), (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z", "M/d/yyyy"), (r"^[A-Za-z]+ [0-9]{1,2}, [0-9]{4}\z", "MMMM d, yyyy"), (r"^[A-Za-z]+ [0-9]{1,2}, [0-9]{4}\z", "MMM d, yyyy"))
    # month names in any case: each word's first letter is raised
    return F.coalesce(*[F.when(c.rlike(p), F.try_to_date(F.initcap(c), f)) for p, f in forms])


def normalize_value(key: Column, value: Column) -> Column:
    """The canonical text of a field's value, null if it can't be one."""
    v = strip(value)
    return (
        F.when(key.isin(*K.MONEY_FIELDS), money_text(money_cents(v)))
        .when(key.isin(*K.DATE_FIELDS), F.date_format(loose_date(v), "yyyy-MM-dd"))
        .otherwise(F.when(F.length(v) <= K.FIELD_CHARS, v))
    )


def html_escape(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")), c)


def narrative_hash(c: Column, strict: bool = False) -> Column:
    """SHA-256 of a text without regard to case and runs of blanks. ``strict`` folds case fully (so that a sharp s equals
    two), in Arrow batches; else letters are lower-cased in the JVM."""
    return F.sha2(collapse(_case_folded()(c) if strict else F.lower(c)), 256)


def _case_folded():
    @F.pandas_udf("string")
    def fold(text: pd.Series) -> pd.Series:
        return text.str.casefold()

    return fold


def dollar_escape(c: Column) -> Column:
    """Text for markdown, in which a dollar sign would begin a formula."""
    return F.replace(c, F.lit("$"), F.lit("\\$"))


def field_problem(key: Column, value: Column) -> Column:
    """What is the matter with a value that a user enters for a field; null if nothing. Dates may also be written without
    hyphens; the rules only read those with them, so such a date is accepted here and unknown there."""
    day = F.coalesce(strict_date(value), F.when(value.rlike("^[0-9]{8}\\z"), F.try_to_date(value, "yyyyMMdd")))
    return F.when(key.isin(*K.MONEY_FIELDS) & money_cents(value).isNull(), "Use an exact nonnegative dollar amount.").when(
        key.isin(*K.DATE_FIELDS) & day.isNull(), "Use YYYY-MM-DD for dates; leave unknown dates blank."
    )


def overlay(base: Column, own: Column) -> Column:
    """A map with the entries of both; where a key is in both, the second one's value counts."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(own), k)), own)


def register(spark) -> list[str]:
    """Scalars as SQL functions of a session, for queries in SQL: names of them. Bodies are SQL, so they are planned like
    built-in functions."""
    blanks = "".join(f"\\u{ord(c):04x}" for c in K.BLANK_CHARACTERS)
    stripped = f"btrim(x, '{blanks}')"
    bare = f"btrim(if(startswith({stripped}, '$'), substring({stripped}, 2), {stripped}), '{blanks}')"
    bodies = {
        "ll_strip(x STRING) RETURNS STRING": stripped,
        "ll_normal(x STRING) RETURNS STRING": "regexp_replace(lower(coalesce(x, '')), '[^a-z0-9]', '')",
        "ll_money_cents(x STRING) RETURNS DECIMAL(38,0)": f"if(length({bare}) <= {K.MONEY_CHARS} and rlike({bare}, r'{K.MONEY}'), cast(try_cast(replace({bare}, ',', '') as decimal(20,2)) * 100 as decimal(38,0)), null)",
        "ll_dollars(x DECIMAL(38,0)) RETURNS STRING": "coalesce(concat('$', format_number(cast(cast(x as decimal(30,0)) / 100 as decimal(32,2)), 2)), 'Unknown')",
        "ll_strict_date(x STRING) RETURNS DATE": f"if(rlike(x, r'{K.ISO_DATE}'), try_to_date(x, 'yyyy-MM-dd'), null)",
        "ll_html_escape(x STRING) RETURNS STRING": "replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\\'', '&#x27;')",
        "ll_narrative_hash(x STRING) RETURNS STRING": f"sha2(btrim(regexp_replace(lower(x), r'{K.BLANKS}', ' '), '{blanks}'), 256)",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.partition("(")[0] for head in bodies]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, for use inside lambdas, where Spark shares nothing."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def supported_value(key: Column, value: Column, quote: Column) -> Column:
    """Whether a quote holds the (canonical) value. A malformed amount before the right one spoils the quote."""

    def amount(x: Column) -> Column:
        at = F.array_position(F.transform(x["numbers"], lambda n: F.coalesce(n == x["wanted"], F.lit(False))), F.lit(True)).cast("int")
        return let(at, lambda i: (i > 0) & ~F.exists(F.slice(x["numbers"], F.lit(1), F.greatest(i - 1, F.lit(0))), lambda n: n.isNull()))

    numbers = F.transform(F.regexp_extract_all(quote, F.lit(K.QUOTED_NUMBER), F.lit(0)), money_cents)
    money_ok = let(F.struct(numbers.alias("numbers"), money_cents(value).alias("wanted")), amount)
    dates = F.transform(F.regexp_extract_all(quote, F.lit(K.QUOTED_DATE), F.lit(0)), lambda d: F.date_format(loose_date(d), "yyyy-MM-dd"))
    date_ok = F.exists(dates, lambda d: F.coalesce(d == value, F.lit(False)))
    return F.when(key.isin(*K.MONEY_FIELDS), money_ok).when(key.isin(*K.DATE_FIELDS), date_ok).otherwise(F.contains(F.lower(quote), F.lower(value)))


def barrier(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows; filters (also those that Spark infers for an explode) stay above, where long expressions would be
    repeated in them. ``keys`` are left out of it, so that rows still count as dealt by them."""
    return df.select(*keys, F.explode_outer(F.array(F.struct(*[c for c in df.columns if c not in keys]))).alias("r")).select(*keys, "r.*")
