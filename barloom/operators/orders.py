"""Order intents, the order ledger and the holdings view. Nothing here sends an order."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import round_half_even
from barloom.schemas import INTENDED_ORDERS

# fixed values: order defaults and texts looked for in, or written to, the ledger
ORDER_TYPE = "MARKET"
PRODUCT = "CNC"
MIN_DIFFERENCE = 0.1
AFTER_MARKET_REFUSED = "AMO orders cannot be placed"
UNEXPECTED_RESPONSE = "The response is not an order record"

HOLDING_COLUMNS = ["tradingsymbol", "quantity", "average_price", "last_price", "pnl"]


def trigger_price(
    last_price: Column, buy: bool = True, min_difference: float = MIN_DIFFERENCE
) -> Column:
    """The last price moved by the required difference, two decimals."""
    step = F.lit(min_difference)
    return round_half_even(last_price + step if buy else last_price - step)


def order_intents(
    picks: DataFrame,
    quotes: DataFrame,
    ledger: DataFrame,
    as_of: date,
    quantity: int = 1,
    amo: bool = True,
    product: str = PRODUCT,
    buy: bool = True,
    min_difference: float = MIN_DIFFERENCE,
) -> DataFrame:
    """One intent per pick that was not requested yet on the day, with its trigger price.

    Of several quotes for a symbol the newest by ``quoted_at`` counts, or the highest where quotes have no time.
    """
    today = ledger.filter(F.to_date("requested_at") == F.lit(as_of))
    requested = today.select("tradingsymbol").distinct()
    newest = [name for name in ("quoted_at", "last_price") if name in quotes.columns]
    prices = quotes.groupBy("tradingsymbol").agg(F.max_by("last_price", F.struct(*newest)).alias("last_price"))
    return (
        picks.select("tradingsymbol")
        .distinct()
        .join(requested, "tradingsymbol", "left_anti")
        .join(prices, "tradingsymbol", "left")
        .select(
            "tradingsymbol",
            F.lit(quantity).alias("quantity"),
            F.lit(amo).alias("amo"),
            F.lit(product).alias("product"),
            F.lit(ORDER_TYPE).alias("order_type"),
            "last_price",
            trigger_price(F.col("last_price"), buy, min_difference).alias("trigger_price"),
        )
    )


def order_ledger(
    responses: DataFrame,
    requested_at: datetime,
    quantity: int = 1,
    amo: bool = True,
    product: str = PRODUCT,
) -> DataFrame:
    """Ledger rows of landed broker responses.

    ``responses`` has ``tradingsymbol, success, order_id, message`` and may have ``error_kind, requested_at,
    filled_quantity, average_price`` and ``response_no``, which tells responses of one symbol apart. A NULL
    ``success`` means the response was not a record and ``message`` is its text. Only a refusal by the broker (``error_kind``
    'broker') is cut at the first ``[``; other errors keep their text. Rows without a time of their
    own get ``requested_at``. ``amo_refused`` flags refusals that only concern after-market orders. The same response
    landed twice gives one row. Without ``response_no`` a response is told apart by its outcome and its message too,
    so two different failures of a symbol in one second are two rows. Of rows that still share an ``id`` the
    greatest by all columns stays, whatever order they landed in.
    """
    optional = {
        "error_kind": "string",
        "requested_at": "timestamp_ntz",
        "filled_quantity": "int",
        "average_price": "string",
        "response_no": "string",
    }
    landed = responses.withColumns(
        {
            name: F.col(name).cast(kind) if name in responses.columns else F.lit(None).cast(kind)
            for name, kind in optional.items()
        }
    )
    is_record = F.col("success").isNotNull()
    outcome = F.when(F.col("success"), F.lit("SUCCESS")).otherwise(F.lit("FAILED"))
    by_broker = is_record & ~F.col("success") & F.coalesce(F.col("error_kind") == "broker", F.lit(False))
    cut = F.trim(F.split("message", r"\[")[0])
    requested = F.coalesce(F.col("requested_at"), F.lit(requested_at).cast("timestamp_ntz"))
    unnumbered = F.concat_ws("|", F.coalesce(F.col("success").cast("string"), F.lit("")), F.coalesce("message", F.lit("")))
    parts = F.concat_ws(
        "|",
        "tradingsymbol",
        F.date_format(requested, "yyyy-MM-dd HH:mm:ss"),
        F.coalesce("order_id", F.lit("")),
        F.coalesce(F.col("response_no"), unnumbered),
    )
    columns = {
        # 60 bits of a digest: the same row gets the same id on a re-run
        "id": F.conv(F.substring(F.md5(parts), 1, 15), 16, 10).cast("bigint"),
        "quantity": F.lit(quantity),
        "amo": F.lit(amo),
        "product": F.lit(product),
        "order_type": F.lit(ORDER_TYPE),
        "requested_at": requested,
        "order_id": F.when(is_record, F.col("order_id")),
        "status": F.when(is_record, outcome).otherwise(F.lit("FAILED")),
        "error_message": F.when(~is_record, F.lit(UNEXPECTED_RESPONSE)),
        "broker_status": F.when(is_record, outcome).otherwise(F.lit("UNKNOWN")),
        "broker_message": F.when(by_broker, cut).otherwise(F.col("message")),
        "filled_quantity": F.when(is_record, F.col("filled_quantity")),
        "average_price": F.when(is_record, F.col("average_price")),
        "amo_refused": by_broker & F.coalesce(F.col("message").contains(AFTER_MARKET_REFUSED), F.lit(False)),
    }
    shown = [*INTENDED_ORDERS.fieldNames(), "amo_refused"]
    rows = landed.withColumns(columns).select(*shown)
    rest = [name for name in shown if name != "id"]
    return rows.groupBy("id").agg(F.max(F.struct(*rest)).alias("_row")).select("id", "_row.*").select(*shown)


def holdings_view(holdings: DataFrame, places: int | None = None) -> DataFrame:
    """The display columns that are present; values stay whole unless ``places`` asks for rounded ones."""
    shown = [name for name in HOLDING_COLUMNS if name in holdings.columns]
    kinds = dict(holdings.dtypes)
    return holdings.select(
        *[
            round_half_even(name, places).alias(name) if places is not None and kinds[name] == "double" else F.col(name)
            for name in shown
        ]
    )
