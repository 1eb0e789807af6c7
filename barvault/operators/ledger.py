"""Running balances and drawdowns over trade ledgers of many runs.

A ledger is any table with a run key, an order and a boolean ``win``. ``segment`` is a column that never decreases
along the order (a block of trade numbers, a day of trade times); a run is worked on in segments, so one very long
run is spread over many tasks. Amounts are decimals, so sums do not depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barvault.operators import segments

AMOUNT = "decimal(24,4)"
TRADES_PER_SEGMENT = 65_536


class Scheme(NamedTuple):
    """Terms of a money-management scheme. The defaults are fixed values."""

    bet: Decimal = Decimal("10")
    reward: Decimal = Decimal("2.3")
    commission: Decimal = Decimal("1.74")
    start: Decimal = Decimal("800")
    luck: int = 3


FLAT = Scheme()
STREAK = Scheme(bet=Decimal("8"))
# A run is safe for a smaller or larger account while its lowest balance stays above these.
SAFE_FOR_600 = -550
SAFE_FOR_1000 = -950


def trade_segment(trade_no: Column) -> Column:
    """Segment for ledgers that carry a trade number."""
    return F.floor(trade_no / TRADES_PER_SEGMENT)


def _amount(value: Decimal | int) -> Column:
    return F.lit(value).cast(AMOUNT)


def _balance(rows: DataFrame, run: Sequence[str], order, start: Decimal) -> DataFrame:
    """Running balance and running lowest balance from the per-trade result ``_pnl``, segment by segment."""
    local = segments.within(run, "_segment", order).rowsBetween(segments.Window.unboundedPreceding, 0)
    inside = rows.withColumn("_sum", F.sum("_pnl").over(local).cast(AMOUNT)).withColumn(
        "_dip", F.min("_sum").over(local)
    )
    # lowest point and result of each segment, relative to the balance the segment starts with
    parts = inside.groupBy(*run, "_segment").agg(
        F.sum("_pnl").cast(AMOUNT).alias("_total"), F.min("_sum").alias("_lowest")
    )
    before = segments.earlier(run, "_segment")
    carried = parts.withColumn(
        "_opening", (_amount(start) + F.coalesce(F.sum("_total").over(before), _amount(0))).cast(AMOUNT)
    )
    carried = carried.select(
        *run,
        "_segment",
        "_opening",
        F.least(
            _amount(start), F.min((F.col("_opening") + F.col("_lowest")).cast(AMOUNT)).over(before)
        ).alias("_low_before"),
    )
    return (
        segments.attach(inside, carried, run, "_segment")
        .withColumn("balance", (F.col("_opening") + F.col("_sum")).cast(AMOUNT))
        .withColumn("lowest", F.least("_low_before", (F.col("_opening") + F.col("_dip")).cast(AMOUNT)))
    )


def running_balance(
    trades: DataFrame,
    run: Sequence[str] = ("run_id",),
    order: Sequence[str] = ("trade_no",),
    segment: Column | None = None,
    scheme: Scheme = FLAT,
) -> DataFrame:
    """``balance`` after each trade of a flat-stake ledger and ``lowest`` balance so far, the start included."""
    cut = trades.withColumn("_segment", trade_segment(F.col("trade_no")) if segment is None else segment)
    pnl = F.when(F.col("win"), F.lit(scheme.bet * scheme.reward)).otherwise(-F.lit(scheme.bet))
    rows = cut.withColumn("_pnl", (pnl - F.lit(scheme.commission)).cast(AMOUNT))
    return _balance(rows, run, order, scheme.start).select(*trades.columns, "balance", "lowest")


def _with_streak(cut: DataFrame, run: Sequence[str], order) -> DataFrame:
    """Add ``_streak``: how many trades in a row were won right before this one."""
    local = segments.within(run, "_segment", order)
    inside = cut.withColumn("_no", F.row_number().over(local))
    lost_at = F.when(~F.col("win"), F.col("_no"))
    parts = inside.groupBy(*run, "_segment").agg(
        F.count(F.lit(1)).alias("_size"), F.max(lost_at).alias("_last_loss")
    )
    before = segments.earlier(run, "_segment")
    placed = parts.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    carried = placed.select(
        *run,
        "_segment",
        "_before",
        # number of the last lost trade in an earlier segment; 0 stands for the start of the run
        F.coalesce(F.max(F.col("_before") + F.col("_last_loss")).over(before), F.lit(0)).alias("_loss_before"),
    )
    past = local.rowsBetween(segments.Window.unboundedPreceding, -1)
    joined = segments.attach(
        inside.withColumn("_loss_here", F.max(lost_at).over(past)), carried, run, "_segment"
    )
    last_loss = F.coalesce(F.col("_before") + F.col("_loss_here"), F.col("_loss_before"))
    return joined.withColumn("_streak", F.col("_before") + F.col("_no") - 1 - last_loss).drop(
        "_no", "_loss_here", "_before", "_loss_before"
    )


def streak_balance(
    trades: DataFrame,
    run: Sequence[str] = ("run_id",),
    order: Sequence[str] = ("trade_no",),
    segment: Column | None = None,
    scheme: Scheme = STREAK,
) -> DataFrame:
    """``stake``, ``balance`` and ``lowest`` when the stake grows by one per win in a row.

    A loss resets the stake to 1, and so does a winning streak longer than ``scheme.luck`` for as long as it lasts.
    """
    cut = trades.withColumn("_segment", trade_segment(F.col("trade_no")) if segment is None else segment)
    streak = F.col("_streak")
    staked = _with_streak(cut, run, order).withColumn(
        "stake", F.when(streak <= scheme.luck, streak + 1).otherwise(1).cast("bigint")
    )
    unit = F.when(F.col("win"), F.lit(scheme.bet * scheme.reward)).otherwise(-F.lit(scheme.bet))
    rows = staked.withColumn("_pnl", (F.col("stake") * (unit - F.lit(scheme.commission))).cast(AMOUNT))
    return _balance(rows, run, order, scheme.start).select(*trades.columns, "stake", "balance", "lowest")


def run_results(
    balances: DataFrame, run: Sequence[str] = ("run_id",), order: str = "trade_no", start: Decimal = FLAT.start
) -> DataFrame:
    """One row per run: end balance, lowest balance and whether it made money or stayed safe."""
    ends = balances.groupBy(*run).agg(
        F.max_by("balance", order).cast(AMOUNT).alias("end_balance"), F.min("lowest").alias("drawdown")
    )
    return ends.withColumns(
        {
            "made_money": F.col("end_balance") > _amount(start),
            "safe_for_600": F.col("drawdown") > SAFE_FOR_600,
            "safe_for_1000": F.col("drawdown") > SAFE_FOR_1000,
        }
    )


def scheme_summary(results: DataFrame, start: Decimal = FLAT.start) -> DataFrame:
    """Figures over all runs: chances, worst drawdown, best and mean end balance, mean as a multiple of the start."""
    share = lambda c: F.avg(F.col(c).cast("int"))
    mean = F.sum("end_balance").cast("double") / F.count(F.lit(1))
    return results.agg(
        F.count(F.lit(1)).alias("runs"),
        share("made_money").alias("profitability"),
        share("safe_for_600").alias("chance_600"),
        share("safe_for_1000").alias("chance_1000"),
        F.min("drawdown").alias("minimum_drawdown"),
        F.max("end_balance").alias("maximum_end_balance"),
        mean.alias("expectancy"),
        (mean / F.lit(float(start))).alias("interest_rate"),
    )
