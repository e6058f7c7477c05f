"""Explicit schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_LONG, _INT, _DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
_STRING, _DATE, _BOOL = T.StringType(), T.DateType(), T.BooleanType()

INSTRUMENTS = _schema(
    ("instrument_token", _LONG),
    ("exchange_token", _LONG),
    ("tradingsymbol", _STRING),
    ("name", _STRING),
    ("instrument_type", _STRING),
    ("segment", _STRING),
    ("exchange", _STRING),
)

STOCK_LIST = T.StructType([T.StructField("Date_Update", _DATE, True), *INSTRUMENTS.fields])

TICKS = _schema(
    ("tradingsymbol", _STRING),
    ("ts", T.TimestampNTZType()),
    ("tick_id", _LONG),
    ("price", _DOUBLE),
    ("quantity", _LONG),
)

STOCK_TIMESERIES = _schema(
    ("open", _DOUBLE),
    ("high", _DOUBLE),
    ("low", _DOUBLE),
    ("close", _DOUBLE),
    ("volume", _LONG),
    ("tradingsymbol", _STRING),
    ("date", _DATE),
)

INDICATOR_COLUMNS = [
    "MA20",
    "MA50",
    "RSI14",
    "ATR14",
    "MACD",
    "MACD_signal",
    "OBV",
    "avg_daily_volume",
    "volatility_1m",
    "price_change_1w",
    "price_change_1m",
]

STOCK_INDICATORS = T.StructType(
    [
        *STOCK_TIMESERIES.fields,
        T.StructField("pos", _LONG, True),
        *[T.StructField(name, _DOUBLE, True) for name in INDICATOR_COLUMNS],
    ]
)

STOCK_LATEST = T.StructType([*STOCK_INDICATORS.fields, T.StructField("previous_OBV", _DOUBLE, True)])

#: All that is needed of a symbol's bars to go on with its indicators; ``tail`` are the last bars.
INDICATOR_STATE = T.StructType(
    [
        *_schema(
            ("tradingsymbol", _STRING),
            ("n_rows", _LONG),
            ("max_date", _DATE),
            ("fast", _DOUBLE),
            ("slow", _DOUBLE),
            ("signal", _DOUBLE),
            ("obv", _DOUBLE),
        ).fields,
        T.StructField(
            "tail",
            T.ArrayType(
                T.StructType([STOCK_TIMESERIES["date"], *[f for f in STOCK_TIMESERIES.fields if f.name not in ("date", "tradingsymbol")]])
            ),
            True,
        ),
    ]
)

STOCK_SCORES = _schema(
    ("tradingsymbol", _STRING),
    ("score", _DOUBLE),
    ("latest_close", _DOUBLE),
    ("Date_Update", _DATE),
)

STOCK_SECTORS = _schema(
    ("Date_Update", _DATE),
    ("tradingsymbol", _STRING),
    ("name", _STRING),
    ("sector", _STRING),
    ("is_allowed", _BOOL),
)

STOCK_SHORT_BUY = _schema(
    ("tradingsymbol", _STRING),
    ("score", _DOUBLE),
    ("sector", _STRING),
    ("latest_close", _DOUBLE),
    ("Date_Update", _DATE),
)

INTENDED_ORDERS = _schema(
    ("id", _LONG),
    ("tradingsymbol", _STRING),
    ("quantity", _INT),
    ("amo", _BOOL),
    ("product", _STRING),
    ("order_type", _STRING),
    ("requested_at", T.TimestampNTZType()),
    ("order_id", _STRING),
    ("status", _STRING),
    ("error_message", _STRING),
    ("broker_status", _STRING),
    ("broker_message", _STRING),
    ("filled_quantity", _INT),
    ("average_price", _STRING),
)

NEWS = _schema(
    ("name", _STRING),
    ("item_no", _LONG),
    ("title", _STRING),
    ("desc", _STRING),
    ("date", _STRING),
)

LATE_BARS = T.StructType(
    [*STOCK_TIMESERIES.fields, *_schema(("stream", _STRING), ("run", _LONG), ("Date_Update", _DATE)).fields]
)

#: What a stream has done: ``state`` is ``prepared`` or ``applied``, ``last_batch`` its newest batch then.
STREAM_LOG = _schema(("stream", _STRING), ("run", _LONG), ("last_batch", _LONG), ("state", _STRING))

SECTOR_REPLY_ITEMS = T.ArrayType(
    _schema(("tradingsymbol", _STRING), ("name", _STRING), ("sector", _STRING))
)

# table name -> (schema, partition columns); partition columns come last in the schema or are derived
TABLES: dict[str, tuple[T.StructType, list[str]]] = {
    "stock_list": (STOCK_LIST, []),
    "stock_timeseries": (STOCK_TIMESERIES, ["month"]),
    "late_bars": (LATE_BARS, ["Date_Update"]),
    "stream_log": (STREAM_LOG, []),
    "stock_indicators": (STOCK_INDICATORS, ["month"]),
    "stock_latest": (STOCK_LATEST, []),
    "indicator_state": (INDICATOR_STATE, []),
    "stock_scores": (STOCK_SCORES, ["Date_Update"]),
    "stock_sectors": (STOCK_SECTORS, []),
    "stock_short_buy": (STOCK_SHORT_BUY, ["Date_Update"]),
    "stock_intended_orders": (INTENDED_ORDERS, []),
}

# columns a table has beside its schema, which only lay it out: type and SQL
_BY_MONTH = {"month": ("date", "trunc(date, 'MM')")}
DERIVED = {"stock_timeseries": _BY_MONTH, "stock_indicators": _BY_MONTH}
