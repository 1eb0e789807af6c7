"""Ledger operators against a plain loop, with segments small enough to be crossed often."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from barvault import schemas
from barvault.operators import ledger


@pytest.fixture(scope="module")
def trades(spark):
    rng = random.Random(42)
    runs = {run: [rng.random() < chance for _ in range(size)] for run, (size, chance) in enumerate(
        [(1, 1), (2, 0), (40, 0.42), (200, 0.42), (300, 0.8), (100, 1), (100, 0), (64, 0.5)]
    )}
    rows = [(run, no, win) for run, wins in runs.items() for no, win in enumerate(wins)]
    rng.shuffle(rows)
    return runs, spark.createDataFrame(rows, schemas.TRADES)


def loop(wins, scheme, streak):
    balance = lowest = scheme.start
    stake, luck, rows = 1, 0, []
    for win in wins:
        used = stake if streak else 1
        balance -= scheme.commission * used
        balance += used * scheme.bet * scheme.reward if win else -used * scheme.bet
        luck = luck + 1 if win else 0
        stake = stake + 1 if win else 1
        if luck > scheme.luck:
            stake = 1
        lowest = min(lowest, balance)
        rows.append((used, balance, lowest))
    return rows


@pytest.mark.parametrize("width", [1, 3, 16, 1000])
@pytest.mark.parametrize("streak", [False, True])
def test_balances_equal_loop(trades, width, streak):
    runs, df = trades
    operator = ledger.streak_balance if streak else ledger.running_balance
    scheme = ledger.STREAK if streak else ledger.FLAT
    got = {}
    for row in operator(df, segment=F.floor(F.col("trade_no") / width)).orderBy("run_id", "trade_no").collect():
        got.setdefault(row.run_id, []).append((row.stake if streak else 1, row.balance, row.lowest))
    assert got == {run: loop(wins, scheme, streak) for run, wins in runs.items()}


def test_summary(trades):
    runs, df = trades
    summary = ledger.scheme_summary(ledger.run_results(ledger.streak_balance(df))).first()
    ends = [loop(wins, ledger.STREAK, True)[-1][1] for wins in runs.values()]
    lows = [loop(wins, ledger.STREAK, True)[-1][2] for wins in runs.values()]
    assert summary.runs == len(runs)
    assert summary.profitability == pytest.approx(sum(e > 800 for e in ends) / len(ends))
    assert summary.chance_600 == pytest.approx(sum(v > -550 for v in lows) / len(lows))
    assert summary.chance_1000 == pytest.approx(sum(v > -950 for v in lows) / len(lows))
    assert (summary.minimum_drawdown, summary.maximum_end_balance) == (min(lows), max(ends))
    assert summary.expectancy == pytest.approx(float(sum(ends) / len(ends)))
    assert summary.interest_rate == pytest.approx(float(sum(ends) / len(ends) / Decimal(800)))
