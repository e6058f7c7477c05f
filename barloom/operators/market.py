"""Trading session membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: session bounds in exchange time, both inclusive
SESSION_ZONE = "Asia/Kolkata"
SESSION_OPEN = "09:15"
SESSION_CLOSE = "15:30"


def market_session(rows: DataFrame, ts: str = "ts", source_zone: str = "UTC") -> DataFrame:
    """Rows whose timestamp falls inside the session, with the exchange-local time.

    ``ts`` is a timestamp without zone, read as ``source_zone``. The comparison keeps microseconds.
    """
    local = F.convert_timezone(F.lit(source_zone), F.lit(SESSION_ZONE), F.col(ts))
    midnight = F.to_date("local_ts").cast("timestamp_ntz")

    def at(clock: str):
        return midnight + F.expr(f"INTERVAL '{clock}' HOUR TO MINUTE")

    inside = F.col("local_ts").between(at(SESSION_OPEN), at(SESSION_CLOSE))
    return rows.withColumn("local_ts", local).filter(inside)
