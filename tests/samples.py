"""Small instrument lists and seeded random candles."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

from barvault import schemas

FOREX = [
    ("AED/BRL", "Exotic-Cross", "UAE Dirham", "Brazil Real"),
    ("JPY/ZAR", "Exotic-Cross", "Japanese Yen", "South African Rand"),
    ("ARS/USD", "Exotic", "Argentinian Peso", "US Dollar"),
    ("KGS/RUB", "Minor", "Kyrgyzstan som", "Russian Ruble"),
    ("USD/EUR", "Major", "US Dollar", "Euro"),
    ("USD/GBp", "Major", "US Dollar", "British Pound"),
    ("USD/JPY", "Major", "US Dollar", "Japanese Yen"),
]
EXCHANGES = [
    ("BHB", "XBAH", "Bahrain", "Asia/Bahrain", ("Level C", "Enterprise")),
    ("SZSE", "XSHE", "China", "Asia/Shanghai", ("Level B", "Pro")),
    ("LSE", "XLON", "United Kingdom", "Europe/London", ("Level A", "Grow")),
    ("NASDAQ", "XNGS", "United States", "America/New_York", ("Basic", "Basic")),
    ("NASDAQ", "XNMS", "United States", "America/New_York", ("Basic", "Basic")),
    ("OTC", "PINX", "", "America/New_York", ("Basic", "Basic")),
]
EQUITIES = [
    ("AADV", "Albion Development VCT PLC", "GBp", "XLON", "United Kingdom", "Common Stock", "Grow"),
    ("AAPL", "Apple Inc", "USD", "XNGS", "United States", "Common Stock", "Basic"),
    ("NVDA", "NVIDIA Corp", "USD", "XNGS", "United States", "Common Stock", "Basic"),
    ("OTEX", "Open Text Corp", "USD", "XNGS", "United States", "Common Stock", "Basic"),
    ("ABLLL", "Abacus Life, Inc.", "USD", "XNMS", "United States", "Exchange-Traded Note", "Basic"),
    ("BKISF", "ISHARES IV PLC", "USD", "PINX", "", "ETF", "Basic"),
]
POSITION = "input_pos struct<source_file:string,_pos:int>"


def forex_list(spark):
    rows = [(*r, ("f", i)) for i, r in enumerate(FOREX)]
    return spark.createDataFrame(rows, f"{schemas.FOREX_ROW}, {POSITION}")


def exchange_list(spark):
    rows = [(*r, ("f", i)) for i, r in enumerate(EXCHANGES)]
    return spark.createDataFrame(rows, f"{schemas.EXCHANGE_ROW}, {POSITION}")


def equity_list(spark, rows=EQUITIES):
    full = [(s, n, cur, mic, mic, cty, kind, ("x", plan), ("f", i)) for i, (s, n, cur, mic, cty, kind, plan) in enumerate(rows)]
    return spark.createDataFrame(full, f"{schemas.EQUITY_ROW}, {POSITION}")


def random_times(rng: random.Random, interval: str, count: int) -> list[datetime]:
    """Weekday times one step apart, with gaps now and then."""
    now = datetime(2010 + rng.randrange(12), rng.randint(1, 12), rng.randint(1, 28))
    step = timedelta(days=1)
    if interval == "1min":
        now += timedelta(hours=rng.randint(9, 23), minutes=rng.randrange(60))
        step = timedelta(minutes=1)
    times = []
    while len(times) < count:
        if now.isoweekday() < 6:
            times.append(now)
        now += step
        if rng.random() < 0.03:
            now += step * rng.randint(1, 40 if interval == "1day" else 1500)
    return times


def candle_rows(rng: random.Random, key: str, interval: str, times) -> list[tuple]:
    rows = []
    for i, time in enumerate(times):
        low, a, b, high = sorted(rng.randint(4, 26) for _ in range(4))
        open_, close = (a, b) if rng.random() < 0.5 else (b, a)
        prices = [Decimal(p) for p in (open_, close, high, low)]
        rows.append(("equity", interval, key, i, time, *prices, rng.randint(100_000, 300_000)))
    return rows


def candle_frame(spark, rows):
    return spark.createDataFrame(rows, schemas.CANDLES)
