"""One pass of incremental updates over all series at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rolling import KEY, newest_first
from tidemark.functions.scalars import SHOWN, backfill_days, looked_up

#: Bars that a series without stored ones begins with.
COLD_START = 100


def missing_bars(offered: DataFrame, stored: DataFrame, now: DataFrame, cold_start: int = COLD_START) -> DataFrame:
    """The offered bars (KEY, ts, ...) that an update inserts: later than the series' last stored one
    and no older than its timeframe's back-fill limit before now (one row, one column). A series without
    stored bars gets the last cold_start offered ones. Late bars are never revised."""
    marks = stored.groupBy(*KEY).agg(F.max("ts").alias("_mark"))
    # A bar that is offered twice is inserted once.
    rows = offered.dropDuplicates([*KEY, "ts"]).join(marks, list(KEY), "left")
    since = F.greatest(F.col("_mark"), now.scalar().cast("timestamp_ntz") - F.make_dt_interval(backfill_days(F.col("timeframe"))))
    later = rows.filter(F.col("_mark").isNotNull() & (F.col("ts") > since))
    first = rows.filter("_mark is null").withColumn("_rank", F.row_number().over(newest_first())).filter(F.col("_rank") <= cold_start)
    return later.unionByName(first.drop("_rank")).drop("_mark")


def shown_bars(bars: DataFrame, otherwise: int = 500) -> DataFrame:
    """The newest bars of each series, as many as a chart of its timeframe shows."""
    ranked = bars.withColumn("_rank", F.row_number().over(newest_first()))
    # The largest number of all is a limit that is kept before the exchange.
    ranked = ranked.filter(F.col("_rank") <= max(otherwise, *SHOWN.values()))
    return ranked.filter(F.col("_rank") <= looked_up(F.col("timeframe"), SHOWN, otherwise)).drop("_rank")


def of_touched(bars: DataFrame, fresh: DataFrame) -> DataFrame:
    """All bars of the series that have fresh ones: what must be computed again."""
    return bars.join(fresh.select(*KEY).distinct(), list(KEY), "left_semi")
