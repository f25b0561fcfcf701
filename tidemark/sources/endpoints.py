"""Requests for public market data and the records of their answers, by a registry that callers extend."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.messages import RECORDS
from tidemark.sources.signing import sorted_query


@dataclass(frozen=True)
class Endpoint:
    """path and parameters of a request; where the answer has its records and what each of them holds. A field
    that isn't a list is one record."""

    path: str
    needs: tuple[str, ...] = ()
    takes: tuple[str, ...] = ()
    field: str = "data"
    record: str = "value string"
    many: bool = True


# Paths, parameters and records of the exchange's public data.
MERGED = "id bigint, open double, close double, low double, high double, amount double, vol double, count bigint, version bigint, bid array<double>, ask array<double>"
TICKER = "symbol string, open double, close double, low double, high double, amount double, vol double, count bigint, bid double, bidSize double, ask double, askSize double"
ENDPOINTS = {
    "candles": Endpoint("/market/history/kline", ("symbol", "period"), ("size",), record=RECORDS["kline"]),
    "depth": Endpoint("/market/depth", ("symbol", "type"), ("depth",), "tick", RECORDS["depth"], many=False),
    "detail": Endpoint("/market/detail", ("symbol",), (), "tick", RECORDS["detail"], many=False),
    "merged": Endpoint("/market/detail/merged", ("symbol",), (), "tick", MERGED, many=False),
    "tickers": Endpoint("/market/tickers", record=TICKER),
    "trade": Endpoint("/market/trade", ("symbol",), (), "tick", RECORDS["trade"], many=False),
    "trades": Endpoint("/market/history/trade", ("symbol",), ("size",), record=RECORDS["trade"]),
    "symbols": Endpoint("/v1/common/symbols", record="`base-currency` string, `quote-currency` string, `price-precision` int, `amount-precision` int, `symbol-partition` string, symbol string, state string"),
    "currencies": Endpoint("/v1/common/currencys", record="string"),
    "chains": Endpoint("/v2/reference/currencies", (), ("currency", "authorizedUser"), record="currency string, instStatus string, chains array<struct<chain: string, chainStatus: string, depositStatus: string, withdrawStatus: string, minDepositAmt: string, minWithdrawAmt: string>>"),
    "market_status": Endpoint("/v2/market-status", record="marketStatus int, haltStartTime bigint, haltEndTime bigint, haltReason int, affectedSymbols string", many=False),
    "timestamp": Endpoint("/v1/common/timestamp", record="bigint", many=False),
}


def request_url(name: str, base: str, endpoints: dict[str, Endpoint] = ENDPOINTS, **params: Column) -> Column:
    """The address of a request; parameters that are null are left out. A parameter that is needed and isn't
    given, or is given and isn't known, is an error; where a needed one is null the address is null."""
    at = endpoints[name]
    if missing := [p for p in at.needs if p not in params]:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    if unknown := [p for p in params if p not in at.needs + at.takes]:
        raise ValueError(f"{name} doesn't take {', '.join(unknown)}")
    address = F.lit(base.rstrip("/") + at.path)
    if not params:
        return address
    query = sorted_query(F.create_map(*[x for p, c in params.items() for x in (F.lit(p), c.cast("string"))]))
    whole = F.when(query == "", address).otherwise(F.concat(address, F.lit("?"), query))
    given = F.lit(True)
    for p in at.needs:
        given = given & params[p].isNotNull()
    return F.when(given, whole)


def records(answers: DataFrame, name: str, body: str = "body", endpoints: dict[str, Endpoint] = ENDPOINTS) -> DataFrame:
    """A row for each record in the answers whose status or code says that all is well, with the column
    record; the other columns are kept, the body goes. Answers that can't be read give none."""
    at = endpoints[name]
    head = F.from_json(body, "status string, code string")
    fine = F.coalesce(head["status"] == "ok", head["code"] == "200", F.lit(False))
    schema = at.record if " " not in at.record else f"struct<{at.record}>"
    wrapped = F.from_json(body, f"{at.field} {f'array<{schema}>' if at.many else schema}")[at.field]
    found = F.explode(wrapped if at.many else F.array(wrapped)).alias("record")
    return answers.filter(fine).select(*[c for c in answers.columns if c != body], found).filter("record is not null")
