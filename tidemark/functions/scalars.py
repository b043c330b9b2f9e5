"""Column helpers shared by the operators: missing values, finiteness, ranks, correlation, tolerances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Fixed value: the number that stands for a missing target in rank metrics.
SENTINEL = -999999.0
#: Bootstrap draws with a deviation of at most this are degenerate.
LEAST_DEVIATION = 1e-12


def sentinel_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(SENTINEL))


def finite(value: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def doubled_rank(value: Column, within: Sequence[str]) -> Column:
    """Twice the rank in which ties share their mean: a whole number. Both windows are met by one exchange on ``within``."""
    order = Window.partitionBy(*within).orderBy(value)
    ties = Window.partitionBy(*within, value)
    return 2 * F.rank().over(order) + F.count(F.lit(1)).over(ties) - 1


def average_rank(value: Column, within: Sequence[str]) -> Column:
    """Ranks in which ties share their mean."""
    return doubled_rank(value, within) / F.lit(2.0)


def whole_correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of a group of whole numbers, null where either side is constant.

    Covariance and variances are differences of whole sums, exact in whatever order rows come, so that a
    correlation of zero is zero and not the noise of a floating sum. Doubled ranks fit to a million rows a group.
    """
    wide = lambda c: c.cast("decimal(20,0)")
    apart = lambda a, b: (wide(F.count(F.lit(1))) * wide(F.sum(a * b)) - wide(F.sum(a)) * wide(F.sum(b))).cast("double")
    return F.when((apart(x, x) > 0) & (apart(y, y) > 0), apart(x, y) / (F.sqrt(apart(x, x)) * F.sqrt(apart(y, y))))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of a group, null where either side is constant."""
    return F.when(
        (F.var_pop(x) > 0) & (F.var_pop(y) > 0),
        F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y)),
    )


def ratio(value: Column) -> Column:
    """Mean over population deviation, null where the deviation is zero."""
    return F.when(F.stddev_pop(value) > 0, F.avg(value) / F.stddev_pop(value))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(F.round(value), F.lit(low)), F.lit(high)).cast("long")


def within_tolerance(expected: Column, actual: Column, tolerance: float) -> Column:
    """Whole numbers must be equal, others within ``tolerance`` relative to 1 + abs(expected); nulls match nulls, NaN and infinities nothing."""
    close = F.when(expected == F.floor(expected), expected == actual).otherwise(F.abs(expected - actual) <= tolerance * (1 + F.abs(expected)))
    return F.when(expected.isNull() & actual.isNull(), True).otherwise(finite(expected) & finite(actual) & F.coalesce(close, F.lit(False)))


def is_close(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return F.abs(a - b) <= tolerance


def one_hot(position: Column, k: int) -> Column:
    return F.when(position == k, 1.0).otherwise(0.0)


def letter(index: Column) -> Column:
    return F.char(index + 65)


def url_quote(text: Column) -> Column:
    """Percent-encoded UTF-8 of all but letters, digits, ``_.-~`` and ``/``."""
    form = F.url_encode(text)  # the form encoding differs in these four
    for was, now in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        form = F.replace(form, F.lit(was), F.lit(now))
    return form


def url_unquote(text: Column) -> Column:
    """Percent-encodings undone; a text with malformed ones stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def html_escape(text: Column) -> Column:
    for was, now in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(was), F.lit(now))
    return text


def html_unescape(text: Column) -> Column:
    """The escapes of ``html_escape`` undone, also the decimal form of the apostrophe's."""
    for was, now in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(was), F.lit(now))
    return text


def with_placeholders(arguments: Column, values: dict[str, Column]) -> Column:
    """An array of texts in which each ``{name}`` is replaced by the name's value."""

    def filled(text: Column) -> Column:
        for name, value in values.items():
            text = F.replace(text, F.lit("{" + name + "}"), value)
        return text

    return F.transform(arguments, filled)
