"""Recurrences over a series: EMA, MACD, KAMA, SuperTrend, Wilder's ATR.

A series is cut into chunks of about CHUNK bars, by time; a row holds a chunk's bars in order. All but
SuperTrend are affine in the value that they start from, so a chunk's effect on any start is two
numbers for each: chunks are reduced to these in parallel, a fold over the few rows of a series gives
every chunk's start, and each chunk is then run from its start, again in parallel. A chunk gets the last
LOOK_BACK bars before it for what looks back at a few bars.

SuperTrend's bands ratchet and have no such short form: its chunks run in order, one after another, in
one task for a series that holds one chunk at a time.

Defined results: values begin with the series but for KAMA (n bars later) and SuperTrend (10th bar), which
are null before; an empty table gives an empty result; prices must not be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import KEY
from tidemark.runtime import settle, ship

CHUNK = 4096
LOOK_BACK = 15
#: Weight of the newest value, by name.
ALPHAS = {"ema9": 2 / 10, "ema21": 2 / 22, "ema55": 2 / 56, "ema12": 2 / 13, "ema26": 2 / 27, "signal": 2 / 10, "atr_wilder": 1 / 14}
OF_CLOSE = ("ema9", "ema21", "ema55", "ema12", "ema26")
#: Bars that an efficiency ratio looks back, by name of the average.
KAMAS = {"kama10": 10, "ama14": 14}
STATES = (*OF_CLOSE, "signal", "atr_wilder", *KAMAS)
AFFINE = ("ema9", "ema21", "ema55", "macd", "macd_signal", "macd_hist", *KAMAS, "atr_wilder")
KEY_SCHEMA = "instrument string, timeframe string"
KAMA_FAST, KAMA_SLOW = 2, 30
ATR_BARS, BAND = 10, 3.0


def smoothed(x: np.ndarray, alpha: float, start: float) -> np.ndarray:
    """y = y + alpha * (x - y) from start on."""
    return pd.Series(np.concatenate([[start], x])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


def run_kama(close: np.ndarray, speed: np.ndarray, start: float) -> np.ndarray:
    out, y = np.empty(len(close)), start
    for i in range(len(close)):
        y += speed[i] * (close[i] - y)
        out[i] = y
    return out


class Bars:
    """A chunk's bars and, from those before it, the values that look back."""

    def __init__(self, row, n_before: int):
        past = 0 if row.past_close is None else len(row.past_close)
        high, low, close = (np.concatenate([p if past else [], x]).astype(float) for p, x in ((row.past_high, row.high), (row.past_low, row.low), (row.past_close, row.close)))
        before = np.concatenate([[np.nan], close[:-1]])
        with np.errstate(invalid="ignore"):
            tr = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
        self.high, self.low, self.close, self.tr = high[past:], low[past:], close[past:], tr[past:]
        self.before = before[past:]
        self.n_before = n_before
        self.place = n_before + np.arange(len(self.close))
        steps = np.abs(np.diff(close, prepend=close[:1]))
        mean = lambda x, n, f: np.array([f(x[max(0, i + 1 - n) : i + 1]) for i in range(past, len(x))])
        self.speed = {}
        for name, n in KAMAS.items():
            travelled = mean(steps, n, np.sum)
            far = np.abs(close - np.concatenate([np.full(min(n, len(close)), np.nan), close[:-n]]))[past:]
            er = np.divide(far, travelled, out=np.zeros(len(far)), where=(travelled > 0) & (self.place >= n))
            self.speed[name] = (er * (2 / (KAMA_FAST + 1) - 2 / (KAMA_SLOW + 1)) + 2 / (KAMA_SLOW + 1)) ** 2
        self.atr = np.where(self.place >= ATR_BARS - 1, mean(tr, ATR_BARS, np.mean), np.nan)

    def kama(self, name: str, start: float) -> np.ndarray:
        """Begins where as many bars as it looks back are before, with the close."""
        out, n = np.full(len(self.close), np.nan), KAMAS[name]
        at = int(np.clip(n - self.n_before, 0, len(self.close)))
        if self.n_before <= n and at < len(self.close):
            out[at], start, at = self.close[at], self.close[at], at + 1
        out[at:] = run_kama(self.close[at:], self.speed[name][at:], start)
        return out

    def effect(self) -> dict[str, float]:
        """For each state: end = a * start + b, and the share of ema12 and ema26 in the signal's end."""
        n, out = len(self.close), {"first_close": self.close[0], "first_tr": self.tr[0]}
        for name in (*OF_CLOSE, "atr_wilder"):
            out[f"{name}_a"] = (1 - ALPHAS[name]) ** n
            out[f"{name}_b"] = smoothed(self.tr if name == "atr_wilder" else self.close, ALPHAS[name], 0.0)[-1]
        fade = {name: (1 - ALPHAS[name]) ** np.arange(1, n + 1) for name in ("ema12", "ema26")}
        macd = smoothed(self.close, ALPHAS["ema12"], 0.0) - smoothed(self.close, ALPHAS["ema26"], 0.0)
        ends = {k: smoothed(x, ALPHAS["signal"], 0.0)[-1] for k, x in (("b", macd), ("ema12", fade["ema12"]), ("ema26", -fade["ema26"]))}
        out |= {"signal_a": (1 - ALPHAS["signal"]) ** n, **{f"signal_{k}": x for k, x in ends.items()}}
        for name, n in KAMAS.items():
            out |= {f"{name}_a": float(np.prod(1 - self.speed[name])) if self.n_before > n else 0.0, f"{name}_b": float(np.nan_to_num(self.kama(name, 0.0)[-1]))}
        return out

    def values(self, start: dict[str, float]) -> dict[str, np.ndarray]:
        ema = {name: smoothed(self.close, ALPHAS[name], start[name]) for name in OF_CLOSE}
        macd = ema["ema12"] - ema["ema26"]
        signal = smoothed(macd, ALPHAS["signal"], start["signal"])
        return {**{k: ema[k] for k in OF_CLOSE[:3]}, "macd": macd, "macd_signal": signal, "macd_hist": macd - signal, **{k: self.kama(k, start[k]) for k in KAMAS}, "atr_wilder": smoothed(self.tr, ALPHAS["atr_wilder"], start["atr_wilder"])}


EFFECT_SCHEMA = ", ".join(f"{c} double" for c in ("first_close", "first_tr", *(f"{s}_{x}" for s in (*OF_CLOSE, "atr_wilder", *KAMAS, "signal") for x in "ab"), "signal_ema12", "signal_ema26"))
START_SCHEMA = ", ".join(f"{s} double" for s in STATES)


def starts(effects: pd.DataFrame) -> pd.DataFrame:
    """The states that each chunk of one series starts from."""
    effects, out, state = effects.sort_values("chunk"), [], None
    for e in effects.to_dict("records"):
        if state is None:
            state = {**dict.fromkeys(OF_CLOSE, e["first_close"]), "signal": 0.0, "atr_wilder": e["first_tr"], **dict.fromkeys(KAMAS, 0.0)}
        out.append({**{k: e[k] for k in (*KEY, "chunk")}, **state})
        end = {s: e[f"{s}_a"] * state[s] + e[f"{s}_b"] for s in STATES}
        end["signal"] += e["signal_ema12"] * state["ema12"] + e["signal_ema26"] * state["ema26"]
        state = end
    return pd.DataFrame(out, columns=[*KEY, "chunk", *STATES])


def chunked(bars: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk: KEY, chunk, ts, high, low, close (arrays in order of time), the last bars
    before it and their number."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = bars.select(*KEY, micros.alias("at"), "high", "low", "close")
    spans = rows.groupBy(*KEY).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    spans = spans.select(*[F.col(k).alias(f"of_{k}") for k in KEY], "first", F.ceil((F.col("last") - F.col("first") + 1) / F.ceil(F.col("n") / chunk)).alias("width"))
    same = [rows[k].eqNullSafe(spans[f"of_{k}"]) for k in KEY]
    placed = rows.join(spans, same).withColumn("chunk", F.expr("(at - first) div width"))
    held = placed.groupBy(*KEY, "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "high", "low", "close"))).alias("bars"))
    held = settle(held.select(*KEY, "chunk", F.col("bars.at").alias("ts"), *[F.col(f"bars.{c}").alias(c) for c in ("high", "low", "close")]), "chunks")
    order = Window.partitionBy(*KEY).orderBy("chunk")
    near = order.rowsBetween(-LOOK_BACK, -1)
    tail = lambda c: F.when(F.size(c) <= LOOK_BACK, F.col(c)).otherwise(F.slice(c, -LOOK_BACK, LOOK_BACK))
    past = held.select(*KEY, "chunk", F.size("close").alias("n"), *[tail(c).alias(c) for c in ("high", "low", "close")])
    past = past.select(*KEY, "chunk", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n_before"), *[F.flatten(F.collect_list(c).over(near)).alias(f"past_{c}") for c in ("high", "low", "close")])
    past = past.select(*[F.col(c).alias(f"of_{c}") for c in (*KEY, "chunk")], "n_before", *[tail(f"past_{c}").alias(f"past_{c}") for c in ("high", "low", "close")])
    same = [held[c].eqNullSafe(past[f"of_{c}"]) for c in (*KEY, "chunk")]
    return held.join(past, same).drop(*[f"of_{c}" for c in (*KEY, "chunk")])


def exploded(rows: list[tuple], names: tuple[str, ...]) -> pd.DataFrame:
    """Rows of (row, values by name) as one row for each bar."""
    parts = [pd.DataFrame({"instrument": r.instrument, "timeframe": r.timeframe, "ts": pd.to_datetime(np.asarray(r.ts), unit="us"), **{n: v[n] for n in names}}) for r, v in rows]
    return pd.concat(parts) if parts else pd.DataFrame(columns=[*KEY, "ts", *names])


def affine_indicators(bars: DataFrame, chunk: int = CHUNK, names: tuple[str, ...] = AFFINE) -> DataFrame:
    """KEY, ts and these of the affine recurrences."""
    ship(bars.sparkSession)
    held = chunked(bars, chunk)

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([{**{k: getattr(r, k) for k in (*KEY, "chunk")}, **Bars(r, r.n_before).effect()} for r in frame.itertuples()], columns=[*KEY, "chunk", *(x.split()[0] for x in EFFECT_SCHEMA.split(", "))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield exploded([(r, Bars(r, r.n_before).values({s: getattr(r, s) for s in STATES})) for r in frame.itertuples()], names)

    effects = held.mapInPandas(reduce, f"{KEY_SCHEMA}, chunk long, {EFFECT_SCHEMA}")
    begin = effects.groupBy(*KEY).applyInPandas(starts, f"{KEY_SCHEMA}, chunk long, {START_SCHEMA}")
    begin = begin.withColumnsRenamed({c: f"of_{c}" for c in (*KEY, "chunk")})
    both = held.join(begin, [held[c].eqNullSafe(begin[f"of_{c}"]) for c in (*KEY, "chunk")])
    return both.mapInPandas(run, f"{KEY_SCHEMA}, ts timestamp_ntz, {', '.join(f'{n} double' for n in names)}")


class Ratchet:
    """Bands of hl2 -/+ BAND ATR that ratchet while the close stays on their side; the direction flips
    when the close crosses the band of the bar before. Starts upwards at the first full ATR."""

    def __init__(self):
        self.up = self.low = 0.0
        self.way = 0

    def run(self, b: Bars) -> dict[str, np.ndarray]:
        line, way = np.full(len(b.close), np.nan), np.zeros(len(b.close), np.int32)
        middle = (b.high + b.low) / 2
        for i in np.flatnonzero(b.place >= ATR_BARS - 1).tolist():
            up, low = middle[i] + BAND * b.atr[i], middle[i] - BAND * b.atr[i]
            if self.way == 0:
                self.way = 1
            else:
                up = min(up, self.up) if b.before[i] <= self.up else up
                low = max(low, self.low) if b.before[i] >= self.low else low
                self.way = 1 if b.close[i] > self.up else -1 if b.close[i] < self.low else self.way
            self.up, self.low = up, low
            line[i], way[i] = (low if self.way == 1 else up), self.way
        return {"supertrend": line, "supertrend_dir": pd.array([x or None for x in way.tolist()], "Int32")}


def supertrend(bars: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """KEY, ts, supertrend and supertrend_dir: the chunks of a series one after another."""
    ship(bars.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, Ratchet()
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                if (r.instrument, r.timeframe) != now:
                    now, state = (r.instrument, r.timeframe), Ratchet()
                rows.append((r, state.run(Bars(r, r.n_before))))
            yield exploded(rows, ("supertrend", "supertrend_dir"))

    ordered = chunked(bars, chunk).repartition(*KEY).sortWithinPartitions(*KEY, "chunk")
    return ordered.mapInPandas(run, f"{KEY_SCHEMA}, ts timestamp_ntz, supertrend double, supertrend_dir int")
