"""Numbers, times, JSON and arrays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# Input pattern of localised counts.
COUNT_PATTERN = r"^([0-9]+(?:\.[0-9]+)?)\s*(万|亿|w|k)?\+?$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_ts(c) -> Column:
    """Epoch seconds or milliseconds, as text or number, to milliseconds; NULL when unusable."""
    v = _c(c).cast("string").try_cast("double").cast("bigint")
    return F.when(v <= 0, None).when(v < 10**12, v * 1000).otherwise(v)


def parse_count(c) -> Column:
    """``1.2万`` → 12000, ``10+`` → 10, ``1,234`` → 1234, anything else → 0."""
    s = F.replace(F.lower(F.trim(_c(c).cast("string"))), F.lit(","), F.lit(""))
    number = F.regexp_extract(s, COUNT_PATTERN, 1)
    unit = F.regexp_extract(s, COUNT_PATTERN, 2)
    factor = (
        F.when(unit.isin("万", "w"), 10_000).when(unit == "亿", 100_000_000)
        .when(unit == "k", 1_000).otherwise(1)
    )
    return F.coalesce((number.try_cast("double") * factor).cast("bigint"), F.lit(0))


def utc_day(ms) -> Column:
    """UTC calendar day of an epoch-millisecond value."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(_c(ms) / K.DAY_MS).cast("int"))


def age_hours(now_ms: int, ts) -> Column:
    return F.greatest(F.lit(0), F.floor((F.lit(now_ms) - _c(ts)) / K.HOUR_MS)).cast("bigint")


def like_weight(c) -> Column:
    return F.log10(1 + F.greatest(F.lit(0), _c(c)))


def quote_symbol(ticker) -> Column:
    t = _c(ticker)
    out = F.replace(t, F.lit("."), F.lit("-"))
    for name, symbol in K.SYMBOL_OVERRIDES.items():
        out = F.when(t == name, F.lit(symbol)).otherwise(out)
    return out


def valid_ticker(c) -> Column:
    return _c(c).rlike(K.TICKER_PATTERN)


def split_list(c) -> Column:
    """Comma list to an array: trimmed, no blanks, first occurrence kept."""
    parts = F.transform(F.split(F.coalesce(_c(c), F.lit("")), ","), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def token_cost(tokens_in, tokens_out) -> Column:
    cost = (_c(tokens_in) * K.COST_IN_PER_M + _c(tokens_out) * K.COST_OUT_PER_M) / 1e6
    return F.round(cost, 6)


SENTIMENT_SCHEMA = "bullish bigint, bearish bigint, neutral bigint"


def sentiment(c) -> Column:
    """Decode the sentiment JSON; NULL when it is not an object."""
    return F.when(F.from_json(_c(c), "map<string,string>").isNotNull(), F.from_json(_c(c), SENTIMENT_SCHEMA))


def lean(c) -> Column:
    """bullish − bearish, missing fields as zero; NULL for undecodable JSON."""
    raw = F.coalesce(_c(c), F.lit("{}"))
    s = sentiment(raw)
    ok = F.from_json(raw, "map<string,string>").isNotNull()
    return F.when(ok, F.coalesce(s["bullish"], F.lit(0)) - F.coalesce(s["bearish"], F.lit(0)))


def sentiment_sign(bull, bear) -> Column:
    d = _c(bull) - _c(bear)
    return F.when(d > 0, "bull").when(d < 0, "bear").otherwise("neut")


def divergence(net, change_pct) -> Column:
    """The crowd leans one way and the price went the other."""
    n, c = _c(net), _c(change_pct)
    return F.coalesce(((n >= 2) & (c <= -2)) | ((n <= -2) & (c >= 2)), F.lit(False))
