"""Prices, places and plausibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, folded, let


# An amount is followed by a currency word, or is the low end of a range that is; words for free entry.
AMOUNT = r"(?i)([0-9]+(?:[.,][0-9]+)?)(?=\s*(?:€|euros?\b|eur\b)|\s*(?:à|-|–|/)\s*[0-9]+(?:[.,][0-9]+)?\s*(?:€|euros?\b|eur\b))"
FREE = r"\b(?:gratuit|free|entree libre|prix libre)\b"


def price_range(text: Column) -> Column:
    """'lo–hi €' or 'n €' of the amounts over 0 and under 1000, 'paid' for other text that says so, else null."""
    amounts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double")), lambda n: (n > 0) & (n < 1000))
    show = lambda n: F.regexp_replace(F.format_string("%.2f", n), r"\.00$", "")

    def shown(a):
        lo, hi = F.array_min(a), F.array_max(a)
        return F.when(lo == hi, F.concat(show(lo), F.lit(" €"))).when(lo < hi, F.concat(show(lo), F.lit("–"), show(hi), F.lit(" €"))).when(text.rlike("(?i)payant"), "paid")

    return let(amounts, shown)


def is_free(text: Column) -> Column:
    return F.coalesce(folded(clean_text(text)).rlike(FREE), F.lit(False))


def price_text(text: Column) -> Column:
    """At most 60 characters of the price's text; null without any."""
    return F.nullif(F.substring(clean_text(text), 1, 60), F.lit(""))


def plausible(count: Column, before: Column) -> Column:
    """False for no rows, and for far fewer or more than the last success had; true where that is unknown or was none."""
    known = F.coalesce(before, F.lit(0)) > 0
    return F.when(F.coalesce(count, F.lit(0)) == 0, False).when(~known, True).when(count < F.greatest(F.lit(1.0), 0.3 * before), False).otherwise(count <= 4 * before + 20)


def km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 12742.0 * F.asin(F.sqrt(a))


def token_cost(n_in: Column, n_out: Column, read: Column, written: Column, price_in: Column, price_out: Column, batch: Column) -> Column:
    usd = (n_in * price_in + n_out * price_out + read * price_in * 0.1 + written * price_in * 1.25) / 1e6
    return F.when(batch, usd / 2).otherwise(usd)


def nice_step(x: Column) -> Column:
    """The least of 1, 2, 2.5, 5, 10 times a power of ten that is no less than x."""
    p = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    f = x / p
    return p * F.when(f <= 1, 1.0).when(f <= 2, 2.0).when(f <= 2.5, 2.5).when(f <= 5, 5.0).otherwise(10.0)
