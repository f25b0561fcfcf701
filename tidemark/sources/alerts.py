"""Messages to readers: signals of a strategy, results of a backtest, and their delivery by executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.functions.scalars import filled

# The texts of the two messages.
SIGNAL = """{mark} <b>ТОРГОВЫЙ СИГНАЛ</b> {mark}

📊 <b>Инструмент:</b> {symbol}
📈 <b>Сигнал:</b> {signal_type}
⏰ <b>Таймфрейм:</b> {timeframe}
🎯 <b>Стратегия:</b> {strategy_name}
🔷 <b>Паттерн:</b> {pattern_type}

💰 <b>ЦЕНЫ:</b>
├ Вход: ${entry_price}
├ Цель: ${target_price}
└ Стоп: ${stop_loss}

📊 <b>ПАРАМЕТРЫ:</b>
├ Ожидаемая прибыль: {expected_profit_percent}%
└ Риск/Прибыль: 1:{risk_reward_ratio}

⏳ <b>Время:</b> {at}

⚠️ <i>Это не финансовая рекомендация. Торгуйте на свой риск.</i>"""
BACKTEST = """📊 <b>РЕЗУЛЬТАТЫ БЕКТЕСТИНГА</b>

🎯 <b>Стратегия:</b> {strategy_name}

📈 <b>СТАТИСТИКА:</b>
├ Всего сделок: {total_trades}
├ Прибыльных: {winning_trades} ✅
├ Убыточных: {losing_trades} ❌
└ Винрейт: {win_rate}%

💰 <b>ПРИБЫЛЬНОСТЬ:</b>
├ Общая прибыль: {total_profit}%
├ Макс. просадка: {max_drawdown}%
└ Коэф. Шарпа: {sharpe_ratio}

⏳ <b>Время:</b> {at}"""
BUY_MARK, OTHER_MARK, UNNAMED = "🟢", "🔴", "Паттерн"


def price(c: Column) -> Column:
    """Two decimals, thousands apart by commas; a missing one is 0."""
    return F.format_number(F.coalesce(c, F.lit(0.0)), 2)


def decimal(c: Column) -> Column:
    return F.replace(price(c), F.lit(","))


def signal_message(at: Column, **given: Column) -> Column:
    """The message of a signal; names that are missing show as N/A, numbers as 0."""
    of = lambda name: given.get(name, F.lit(None))
    numbers = {n: price(of(n).cast("double")) for n in ("entry_price", "target_price", "stop_loss")} | {n: decimal(of(n).cast("double")) for n in ("expected_profit_percent", "risk_reward_ratio")}
    texts = {n: of(n) for n in ("symbol", "signal_type", "timeframe", "pattern_type")} | {"strategy_name": F.coalesce(of("strategy_name"), F.lit(UNNAMED))}
    mark = F.when(of("signal_type") == "BUY", BUY_MARK).otherwise(OTHER_MARK)
    return filled(SIGNAL, mark=mark, at=F.date_format(at, "yyyy-MM-dd HH:mm:ss"), **texts, **numbers)


def backtest_message(at: Column, **given: Column) -> Column:
    """The message of a backtest's figures."""
    of = lambda name: given.get(name, F.lit(None))
    counts = {n: F.coalesce(of(n).cast("long"), F.lit(0)) for n in ("total_trades", "winning_trades", "losing_trades")}
    shares = {n: decimal(of(n).cast("double")) for n in ("win_rate", "total_profit", "max_drawdown", "sharpe_ratio")}
    return filled(BACKTEST, strategy_name=of("strategy_name"), at=F.date_format(at, "yyyy-MM-dd HH:mm:ss"), **counts, **shares)


def deliver(messages: DataFrame, send: Callable[[Iterator[Row]], None]) -> None:
    """Hand the rows of each partition to a sender on the executors. A task that is lost is run again, so a
    sender must know messages that it has sent, by a key in the row. As a stream's sink: foreachBatch."""
    messages.foreachPartition(send)
