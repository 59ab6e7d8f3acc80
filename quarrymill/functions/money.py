"""Money, ratios and ages as Column functions. Half cents round towards plus infinity, as in IEEE floor(x + 0.5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
DAY_MS = 86_400_000


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with columns that later steps read and never compute again: an array of one struct is unfolded, which the optimiser keeps apart from what comes after it."""
    return rows.select(*[F.col(c) for c in rows.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def round_half_up(x, places: int = 2) -> Column:
    """Rounding with a nudge of one machine epsilon first, so 1.005 becomes 1.01."""
    scale = float(10**places)
    return F.floor((col(x) + F.lit(EPSILON)) * scale + 0.5) / scale


def round_plain(x, places: int = 2) -> Column:
    scale = float(10**places)
    return F.floor(col(x) * scale + 0.5) / scale


def half_dollar_down(x) -> Column:
    return F.floor(col(x) * 2.0) / 2.0


def clamp(x, low, high) -> Column:
    """x between low and high; unknown stays unknown."""
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), F.lit(float(low))), F.lit(float(high))))


def scaled(x, low: float, high: float) -> Column:
    """Position of x between low and high; 0 where x is unknown."""
    return F.coalesce((col(x) - low) / (high - low), F.lit(0.0))


def ratio(top, bottom, otherwise=None) -> Column:
    """top / bottom to four places, `otherwise` where the bottom isn't positive."""
    return F.when(col(bottom) > 0, round_half_up(col(top) / col(bottom), 4)).otherwise(F.lit(otherwise).cast("double"))


def known_amount(x) -> Column:
    """x if it's a finite number of at least 0, else null: unknown is not zero."""
    x = col(x).cast("double")
    return F.when((x >= 0) & (x < float("inf")), x)


def positive_amount(x) -> Column:
    x = known_amount(x)
    return F.when(x > 0, x)


def parse_price(text) -> Column:
    """Number in a price text: everything but digits, dots, commas and minus goes, commas go, a numeric prefix counts; at least 0, null without one."""
    clean = F.regexp_replace(F.regexp_replace(col(text), r"[^0-9.,\-]", ""), ",", "")
    number = F.regexp_extract(clean, r"^-?(\d+\.?\d*|\.\d+)", 0).try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), number))


def first_amount(text) -> Column:
    """First amount that stands in a text."""
    return F.regexp_replace(F.regexp_extract(col(text), r"-?\d[\d,]*(\.\d+)?", 0), ",", "").try_cast("double")


def total_price(price, shipping) -> Column:
    return col(price) + F.coalesce(col(shipping), F.lit(0.0))


def confidence(text) -> Column:
    """A number clipped to 1, or the value of high, medium and low."""
    number = known_amount(col(text).try_cast("double"))
    words = {"high": 1.0, "medium": 0.65, "low": 0.3}
    return F.coalesce(F.when(number.isNotNull(), F.least(number, F.lit(1.0))), reduce(lambda c, w: c.when(col(text) == w[0], w[1]), words.items(), F.when(F.lit(False), 0.0)), F.lit(0.0))


# Country names and the currency taken for granted there.
CURRENCIES = {
    "USD": ["US", "USA", "UNITED STATES"],
    "GBP": ["UK", "GB", "UNITED KINGDOM"],
    "CAD": ["CA", "CANADA"],
    "AUD": ["AU", "AUSTRALIA"],
    "JPY": ["JP", "JAPAN"],
    "EUR": ["EU", "EUROPEAN UNION"],
}


def currency_of_country(country) -> Column:
    name = F.upper(F.trim(col(country)))
    return reduce(lambda c, kv: c.when(name.isin(kv[1]), kv[0]), CURRENCIES.items(), F.when(F.lit(False), ""))


def currency_code(text) -> Column:
    code = F.upper(F.trim(col(text)))
    return F.when(code.rlike("^[A-Z]{3}$"), code)


def age_in_days(moment, now) -> Column:
    """Whole days from moment to now; null when it lies more than five minutes ahead, else at least 0."""
    elapsed = F.unix_millis(col(now).cast("timestamp")) - F.unix_millis(col(moment).cast("timestamp"))
    return F.when(elapsed >= -300_000, F.greatest(F.floor(elapsed / DAY_MS), F.lit(0)))


def date_age(day, as_of) -> Column:
    """Whole days from the day's UTC midnight to as_of; null when negative."""
    age = F.floor((F.unix_millis(col(as_of).cast("timestamp")) - F.unix_millis(col(day).cast("date").cast("timestamp"))) / DAY_MS)
    return F.when(age >= 0, age)


def short_month_date(text) -> Column:
    """Dates like Jul-10-26."""
    return F.to_date(F.try_to_timestamp(col(text), F.lit("MMM-d-yy")))


def reconcile_price_tier(price, good: float = 15.0, fair: float = 20.0) -> Column:
    """Tier of an absolute price."""
    return F.when(positive_amount(price).isNull(), "unknown").when(col(price) <= good, "strong").when(col(price) <= fair, "fair").otherwise("high")


def max_percent(text, low: int = 30, high: int = 99) -> Column:
    """Largest NN% of a text between low and high."""
    found = F.transform(F.regexp_extract_all(col(text), F.lit(r"(\d{1,3})\s*%"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_max(F.filter(found, lambda x: (x >= low) & (x <= high)))


def least_offer(offers) -> Column:
    """Least price of an array<struct<price, available>>: of the available offers, else of all."""
    price = lambda a: F.array_min(F.transform(a, lambda o: positive_amount(o["price"])))
    return F.coalesce(price(F.filter(offers, lambda o: o["available"])), price(offers))
