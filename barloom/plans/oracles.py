"""The registered queries as SQL for DuckDB, written apart from the Spark plans to check them."""

from __future__ import annotations

from barloom.operators.orders import UNEXPECTED_RESPONSE
from barloom.operators.sectors import ALLOWED_SECTORS

AS_OF = "DATE '2024-01-30'"

BARS_SHORT = """
bars_short AS (
  SELECT 'U' || user_id AS tradingsymbol, CAST(ts AS DATE) AS date,
         arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, row(ts, event_id)) AS close, count(*) AS volume
  FROM events GROUP BY ALL)"""

BARS_LONG = """
bars_long AS (
  SELECT tradingsymbol, date,
         arg_min(price, k) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, k) AS close, sum(quantity) AS volume
  FROM (SELECT 'S' || l_suppkey AS tradingsymbol, CAST(l_shipdate AS DATE) AS date,
               l_extendedprice / l_quantity AS price, l_quantity AS quantity,
               row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k
        FROM lineitem)
  GROUP BY tradingsymbol, date)"""

INSTRUMENTS = """
instruments AS (
  SELECT c_custkey AS instrument_token, c_custkey AS exchange_token,
         CASE WHEN c_custkey % 17 = 0 THEN (c_custkey % 10) || 'X-GS'
              ELSE 'U' || c_custkey END AS tradingsymbol,
         CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS name,
         'EQ' AS instrument_type,
         CASE WHEN c_custkey % 7 = 0 THEN 'INDICES'
              WHEN c_custkey % 5 = 0 THEN 'BSE' ELSE 'NSE' END AS segment,
         CASE WHEN c_custkey % 5 = 0 THEN 'BSE' ELSE 'NSE' END AS exchange
  FROM customer)"""

UNIVERSE = INSTRUMENTS + f""",
universe AS (
  SELECT {AS_OF} AS Date_Update, instrument_token, exchange_token, tradingsymbol, name,
         instrument_type, segment, exchange
  FROM instruments
  WHERE exchange = 'NSE' AND segment = 'NSE'
    AND NOT regexp_matches(tradingsymbol, '^[0-9].*-.{{2}}$'))"""

ALL_SECTORS = f"""
all_sectors AS (
  SELECT {AS_OF} AS Date_Update, 'U' || c_custkey AS tradingsymbol, c_name AS name,
         c_mktsegment AS sector, c_custkey // 50 AS batch_id
  FROM customer)"""

SECTORS = ALL_SECTORS + """,
sectors AS (SELECT * FROM all_sectors WHERE CAST(substr(tradingsymbol, 2) AS BIGINT) % 3 <> 0)"""

UNREADABLE = "(batch_id % 7 = 6 OR batch_id % 11 = 10 OR batch_id % 13 = 12 OR batch_id % 17 = 16)"

REPLIED = ALL_SECTORS + f""",
replied AS (SELECT * FROM all_sectors WHERE NOT {UNREADABLE})"""

STORED = BARS_SHORT + """,
stored AS (
  SELECT * FROM bars_short
  WHERE CAST(substr(tradingsymbol, 2) AS BIGINT) % 2 = 0 AND date <= DATE '2024-01-20')"""

PLAN = STORED + "," + UNIVERSE + f""",
plan AS (
  SELECT u.tradingsymbol,
         CAST(coalesce(max_date + 1, {AS_OF} - INTERVAL 3 MONTH) AS DATE) AS from_date,
         {AS_OF} AS to_date
  FROM (SELECT DISTINCT tradingsymbol FROM universe) u
  LEFT JOIN (SELECT tradingsymbol, max(date) AS max_date FROM stored GROUP BY 1) w
    ON w.tradingsymbol = u.tradingsymbol
  WHERE max_date IS NULL OR max_date < {AS_OF})"""

NEWS = """
news AS (
  SELECT source AS name, doc_id AS item_no, split_part(text, chr(10), 1) AS title,
         CASE WHEN position(chr(10) IN text) > 0
              THEN substr(text, position(chr(10) IN text) + 1) END AS body,
         CASE doc_id % 4 WHEN 0 THEN ' ' || (doc_id % 48) || '  hours ago'
                         WHEN 1 THEN (doc_id % 48) || chr(9) || 'days ago'
                         WHEN 2 THEN (doc_id % 48) || ' mins ago'
                         ELSE 'an hour ago' END AS date
  FROM documents)"""

LEXICON = """
lexicon(word, valence) AS (
  VALUES ('the', 0.5::DOUBLE), ('of', -0.3), ('and', 0.4), ('is', 1.1), ('that', -0.7),
         ('for', 0.9), ('with', 1.3), ('was', -1.6))"""

COLUMNS = (
    "MA20 MA50 RSI14 ATR14 MACD MACD_signal OBV avg_daily_volume volatility_1m "
    "price_change_1w price_change_1m"
).split()


def _full(expression: str, column: str, rows: int) -> str:
    frame = f"(w ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) OVER {frame} = {rows} THEN {expression} OVER {frame} END"


def _indicator_ctes(bars: str) -> str:
    w = "WINDOW w AS (PARTITION BY tradingsymbol ORDER BY date)"
    # the averages behind MACD, folded bar by bar
    fast, slow = (f"a.{name} + (m.close - a.{name}) * 2 / {span + 1}" for name, span in (("fast", 12), ("slow", 26)))
    return f"""
looked AS (
  SELECT *, row_number() OVER w - 1 AS pos, lag(close) OVER w AS before,
         lag(close, 5) OVER w AS before5, lag(close, 22) OVER w AS before22
  FROM {bars} {w}),
moved AS MATERIALIZED (
  SELECT *, close / nullif(before, 0) - 1 AS ret,
         CASE WHEN before IS NOT NULL THEN greatest(close - before, 0) END AS gain,
         CASE WHEN before IS NOT NULL THEN greatest(before - close, 0) END AS loss,
         greatest(high - low, abs(high - before), abs(low - before)) AS tr,
         coalesce(sign(close - before) * volume, 0)::DOUBLE AS signed,
         close / nullif(before5, 0) - 1 AS price_change_1w,
         close / nullif(before22, 0) - 1 AS price_change_1m
  FROM looked),
averages(tradingsymbol, pos, fast, slow, signal) AS (
  SELECT tradingsymbol, pos, close::DOUBLE, close::DOUBLE, 0::DOUBLE FROM moved WHERE pos = 0
  UNION ALL
  SELECT m.tradingsymbol, m.pos, {fast}, {slow},
         a.signal + (({fast}) - ({slow}) - a.signal) * 2 / 10
  FROM averages a JOIN moved m ON m.tradingsymbol = a.tradingsymbol AND m.pos = a.pos + 1),
rolled AS (
  SELECT *,
         {_full("avg(close)", "close", 20)} AS MA20,
         {_full("avg(close)", "close", 50)} AS MA50,
         {_full("avg(gain)", "gain", 14)} AS ag,
         {_full("avg(loss)", "loss", 14)} AS al,
         {_full("avg(tr)", "tr", 14)} AS ATR14,
         {_full("avg(volume)", "volume", 20)} AS avg_daily_volume,
         {_full("stddev_samp(ret)", "ret", 22)} AS volatility_1m,
         sum(signed) OVER (w ROWS UNBOUNDED PRECEDING) AS OBV
  FROM moved {w}),
indicators AS (
  SELECT *, fast - slow AS MACD, signal AS MACD_signal,
         CASE WHEN al = 0 AND ag > 0 THEN 100 WHEN al > 0 THEN 100 - 100 / (1 + ag / al) END AS RSI14,
         lag(OBV) OVER w AS previous_OBV,
         row_number() OVER (PARTITION BY tradingsymbol ORDER BY date DESC) AS from_end
  FROM rolled JOIN averages USING (tradingsymbol, pos) {w}),
latest AS (SELECT * FROM indicators WHERE from_end = 1 AND pos >= 1)"""


def _score_cte(scale: float, low: float, high: float) -> str:
    return f"""
scored AS (
  SELECT *, pts_liquidity + pts_volatility + pts_change_1w + pts_change_1m + pts_trend + pts_rsi
            + pts_macd + pts_obv AS score
  FROM (
    SELECT tradingsymbol, date, close,
      CASE WHEN avg_daily_volume IS NOT NULL
           THEN least(avg_daily_volume / {scale}, 1) * 10 END AS pts_liquidity,
      CASE WHEN volatility_1m BETWEEN {low} AND {high} THEN 10.0 ELSE 0.0 END AS pts_volatility,
      CASE WHEN price_change_1w IS NOT NULL
           THEN greatest(price_change_1w, 0) * 50 END AS pts_change_1w,
      CASE WHEN price_change_1m IS NOT NULL
           THEN greatest(price_change_1m, 0) * 50 END AS pts_change_1m,
      CASE WHEN MA20 > MA50 THEN 10.0 ELSE 0.0 END AS pts_trend,
      CASE WHEN RSI14 BETWEEN 40 AND 60 THEN 5.0 ELSE 0.0 END AS pts_rsi,
      CASE WHEN MACD > MACD_signal THEN 5.0 ELSE 0.0 END AS pts_macd,
      CASE WHEN OBV > previous_OBV THEN 5.0 ELSE 0.0 END AS pts_obv
    FROM latest))"""


SCORE_PARTS = (
    "pts_liquidity pts_volatility pts_change_1w pts_change_1m pts_trend pts_rsi pts_macd pts_obv "
    "score"
).split()
SHORT_SCORE = (3.0, 3.0, 10.0)
LONG_SCORE = (30.0, 0.3, 0.5)


def _cents(column: str) -> str:
    return f"round_even({column} * 100, 0) / 100"


def _rounded(*columns: str, places: int = 6) -> str:
    return ", ".join(f"round({c}::DOUBLE, {places}) AS {c}" for c in columns)


PRICES = "open, high, low, close"


def _indicator_query(bars_cte: str, bars: str, *columns: str) -> str:
    return (
        f"WITH RECURSIVE {bars_cte},{_indicator_ctes(bars)} "
        f"SELECT tradingsymbol, date, pos, {_rounded(*columns)} FROM indicators"
    )


def _all_indicators(
    bars_cte: str, bars: str, source: str, *extra: str, places: int = 6
) -> str:
    return (
        f"WITH RECURSIVE {bars_cte},{_indicator_ctes(bars)} "
        f"SELECT tradingsymbol, date, {PRICES}, volume, pos, "
        f"{_rounded(*COLUMNS, *extra, places=places)} FROM {source}"
    )


def _score_query(bars_cte: str, bars: str, rules: tuple[float, float, float]) -> str:
    return (
        f"WITH RECURSIVE {bars_cte},{_indicator_ctes(bars)},{_score_cte(*rules)} "
        f"SELECT tradingsymbol, date, close, {_rounded(*SCORE_PARTS)} FROM scored"
    )


def _scores_of_day(day: str) -> str:
    return f"""
SELECT DATE '{day}' AS Date_Update, tradingsymbol, {_cents("score")} AS score,
       {_cents("close")} AS latest_close
FROM (WITH RECURSIVE {BARS_SHORT}, cut AS (SELECT * FROM bars_short WHERE date <= DATE '{day}'),
      {_indicator_ctes("cut")},{_score_cte(*SHORT_SCORE)} SELECT * FROM scored)"""


def _candidate_ctes(bars: str, sectors: str) -> str:
    return f"""{_indicator_ctes(bars)},{_score_cte(*SHORT_SCORE)},
candidates AS (
  SELECT {AS_OF} AS Date_Update, s.tradingsymbol, u.name, g.sector,
         {_cents("s.score")} AS score, {_cents("s.close")} AS latest_close
  FROM scored s
  LEFT JOIN {sectors} g ON g.tradingsymbol = s.tradingsymbol
  LEFT JOIN universe u ON u.tradingsymbol = s.tradingsymbol
  WHERE {_cents("s.close")} <= 30)"""


def _selection_ctes(bars: str, align: str = "pos", max_per_sector: int | None = None) -> str:
    sector_rule = ""
    if max_per_sector is not None:
        sector_rule = (
            " AND len(list_filter(w.sectors, lambda x: x = coalesce(r.sector, '-'))) "
            f"< {max_per_sector}"
        )
    taken = (
        "len(w.acc) < 10 AND NOT list_has_any(w.acc, coalesce(c.conflicts, []::VARCHAR[]))"
        + sector_rule
    )
    return f"""
returns AS (
  SELECT tradingsymbol, date, pos, close / nullif(before, 0) - 1 AS r
  FROM (SELECT *, row_number() OVER w - 1 AS pos, lag(close) OVER w AS before FROM {bars}
        WINDOW w AS (PARTITION BY tradingsymbol ORDER BY date))
  WHERE close / nullif(before, 0) - 1 IS NOT NULL),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, tradingsymbol) AS rk
  FROM candidates),
close_pairs AS (
  SELECT a.tradingsymbol AS s, b.tradingsymbol AS o,
         covar_samp(a.r, b.r) / nullif(stddev_samp(a.r) * stddev_samp(b.r), 0) AS c
  FROM returns a JOIN returns b ON a.{align} = b.{align} AND a.tradingsymbol <> b.tradingsymbol
  WHERE a.tradingsymbol IN (SELECT tradingsymbol FROM candidates)
    AND b.tradingsymbol IN (SELECT tradingsymbol FROM candidates)
  GROUP BY 1, 2),
conflicts AS MATERIALIZED (SELECT s, list(o) AS conflicts FROM close_pairs WHERE abs(c) >= 0.25 GROUP BY 1),
walk(rk, acc, sectors) AS (
  SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[]
  UNION ALL
  SELECT r.rk,
         CASE WHEN {taken} THEN list_append(w.acc, r.tradingsymbol) ELSE w.acc END,
         CASE WHEN {taken} THEN list_append(w.sectors, coalesce(r.sector, '-'))
              ELSE w.sectors END
  FROM walk w JOIN ranked r ON r.rk = w.rk + 1
  LEFT JOIN conflicts c ON c.s = r.tradingsymbol),
picks AS (
  SELECT CAST(generate_subscripts(acc, 1) AS INTEGER) AS pick_no, unnest(acc) AS tradingsymbol
  FROM (SELECT acc FROM walk ORDER BY rk DESC LIMIT 1))"""


_SELECT_BASE = f"WITH RECURSIVE {BARS_SHORT},{UNIVERSE},{SECTORS},"


def _selection(tail: str, align: str = "pos", max_per_sector: int | None = None) -> str:
    rest = _candidate_ctes("bars_short", "sectors") + ","
    rest += _selection_ctes("bars_short", align, max_per_sector)
    return _SELECT_BASE + rest + " " + tail


def _against_picks(align: str) -> str:
    return _selection(
        f"""SELECT a.tradingsymbol, b.tradingsymbol AS other, count(*) AS n_common,
       round(covar_samp(a.r, b.r) / nullif(stddev_samp(a.r) * stddev_samp(b.r), 0), 6) AS correlation
FROM returns a JOIN returns b ON a.{align} = b.{align} AND a.tradingsymbol <> b.tradingsymbol
WHERE b.tradingsymbol IN (SELECT tradingsymbol FROM picks) GROUP BY 1, 2"""
    )


PICKED_ROWS = f"""
SELECT {AS_OF} AS Date_Update, tradingsymbol, score, sector, latest_close
FROM candidates WHERE tradingsymbol IN (SELECT tradingsymbol FROM picks)"""

_RECENT = """
recent AS (
  SELECT *, CAST(TIMESTAMP '2024-01-30 12:00:00' - age AS TIMESTAMP) AS article_time
  FROM (SELECT *, CASE WHEN contains(date, 'hour') THEN to_hours(n)
                       WHEN contains(date, 'day') THEN to_days(n){minutes} END AS age
        FROM (SELECT *, TRY_CAST(regexp_extract(date, '^\\s*(\\S+)', 1) AS INTEGER) AS n,
                     row_number() OVER (PARTITION BY name ORDER BY item_no) AS rn FROM news)
        WHERE rn <= {first})
  WHERE age <= INTERVAL 1 DAY)"""
RECENT = _RECENT.format(minutes="", first=50)
RECENT_MINUTES = _RECENT.format(
    minutes=" WHEN contains(date, 'min') THEN to_minutes(n)", first=20
)


WORDS = "regexp_split_to_array(lower(concat_ws(' ', title, body)), '[^\\p{L}]+')"

LARGE_LEXICON = f"""
lexicon AS (
  SELECT DISTINCT word, (length(word) % 7 - 3) / 2.0::DOUBLE AS valence
  FROM (SELECT unnest({WORDS}) AS word FROM news))"""


def _sentiment_cte(source: str) -> str:
    return f"""
sentiments AS (
  SELECT name, item_no, count(valence) AS n_hits,
         round(coalesce(sum(valence), 0)
               / sqrt(pow(coalesce(sum(valence), 0), 2) + 15), 4) AS sentiment
  FROM (SELECT name, item_no,
               unnest({WORDS}) AS word
        FROM {source}) t
  LEFT JOIN lexicon l ON l.word = t.word GROUP BY 1, 2)"""


_ALLOWED = ", ".join(ALLOWED_SECTORS)

ORACLES: dict[str, str] = {
    "universe_filter": f"WITH {UNIVERSE} SELECT * FROM universe",
    "universe_snapshot": f"WITH {UNIVERSE} SELECT * FROM universe",
    "instrument_lookup": f"""WITH {INSTRUMENTS}
SELECT r.tradingsymbol, r.exchange, min(i.instrument_token) AS instrument_token,
       count(i.instrument_token) > 0 AS found
FROM (SELECT DISTINCT 'U' || user_id AS tradingsymbol, 'NSE' AS exchange FROM events) r
LEFT JOIN instruments i ON i.tradingsymbol = r.tradingsymbol AND i.exchange = r.exchange
GROUP BY 1, 2""",
    "daily_bars": f"WITH {BARS_SHORT} SELECT tradingsymbol, date, {PRICES}, volume "
    "FROM bars_short",
    "daily_bars_long": f"WITH {BARS_LONG} SELECT tradingsymbol, date, {PRICES}, volume "
    "FROM bars_long",
    "ingest_watermark": f"WITH {STORED} SELECT tradingsymbol, max(date) AS max_date FROM stored "
    "GROUP BY 1",
    "ingest_plan": f"WITH {PLAN} SELECT * FROM plan",
    "ingest_new_bars": f"WITH {PLAN} SELECT b.tradingsymbol, date, {PRICES}, volume "
    "FROM bars_short b JOIN plan p ON p.tradingsymbol = b.tradingsymbol "
    "WHERE date BETWEEN from_date AND to_date",
    "ingest_new_bars_min2": f"""WITH {BARS_SHORT},{UNIVERSE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY tradingsymbol ORDER BY date DESC) AS recent FROM bars_short),
kept AS (SELECT * FROM ranked WHERE recent > 1 + CAST(substr(tradingsymbol, 2) AS BIGINT) % 2)
SELECT b.tradingsymbol, date, {PRICES}, volume
FROM bars_short b LEFT JOIN (SELECT tradingsymbol, max(date) AS max_date FROM kept GROUP BY 1) w USING (tradingsymbol)
WHERE b.tradingsymbol IN (SELECT tradingsymbol FROM universe)
  AND date BETWEEN coalesce(max_date + 1, {AS_OF} - INTERVAL 3 MONTH) AND {AS_OF}
QUALIFY count(*) OVER (PARTITION BY b.tradingsymbol) >= 2""",
    "intraday_bars": f"""
SELECT 'U' || user_id AS tradingsymbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start,
       arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, row(ts, event_id)) AS close, count(*) AS volume
FROM events GROUP BY ALL""",
    "event_time_bars": """
WITH landed AS (
  SELECT *, CAST(ts AS DATE) AS day,
         (CAST(ts AS DATE) - DATE '2024-01-01') // 10 + CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END AS run
  FROM events),
runs AS (
  SELECT run, max(max(ts)) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest_before,
         max(max(ts)) OVER () AS newest
  FROM landed GROUP BY run)
SELECT 'U' || user_id AS tradingsymbol, day AS date,
       arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, row(ts, event_id)) AS close, count(*) AS volume
FROM landed JOIN runs USING (run)
WHERE day + INTERVAL 1 DAY <= newest - INTERVAL 2 DAY
  AND (newest_before IS NULL OR day + INTERVAL 1 DAY > newest_before - INTERVAL 2 DAY)
GROUP BY 1, 2""",
    "session_bars": """
WITH slots AS (
  SELECT row_number() OVER (ORDER BY day, n) AS slot, CAST(day AS DATE) AS date,
         day + INTERVAL 555 MINUTE + n * INTERVAL 60 MINUTE AS start
  FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) d(day), range(7) r(n)
  WHERE isodow(day) < 6 AND day <> DATE '2024-01-26'),
traded AS (
  SELECT 'U' || user_id AS tradingsymbol, slot,
         arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, row(ts, event_id)) AS close, count(*) AS volume
  FROM (SELECT *, ts + INTERVAL 330 MINUTE AS here FROM events) e
  JOIN slots s ON CAST(here AS DATE) = s.date AND here >= s.start
   AND (here < s.start + INTERVAL 60 MINUTE AND here <= s.date + INTERVAL 930 MINUTE)
  GROUP BY 1, 2),
spans AS (SELECT tradingsymbol, min(slot) AS low, max(slot) AS high FROM traded GROUP BY 1)
SELECT p.tradingsymbol, s.date, CAST(s.start AS TIMESTAMP) AS start, open, t.high, t.low, close,
       coalesce(volume, 0) AS volume, t.slot IS NOT NULL AS traded
FROM spans p JOIN slots s ON s.slot BETWEEN p.low AND p.high
LEFT JOIN traded t ON t.tradingsymbol = p.tradingsymbol AND t.slot = s.slot""",
    "universe_from_csv": f"WITH {UNIVERSE} SELECT * FROM universe",
    "late_bars": f"WITH {STORED} SELECT b.tradingsymbol, date, {PRICES}, volume, {AS_OF} AS Date_Update "
    "FROM bars_short b JOIN (SELECT tradingsymbol, max(date) AS max_date FROM stored GROUP BY 1) w "
    "USING (tradingsymbol) WHERE date <= max_date",
    "ingest_stream": f"WITH {PLAN} SELECT tradingsymbol, date, {PRICES}, volume FROM ("
    "SELECT * FROM stored UNION ALL SELECT b.* FROM bars_short b "
    "JOIN plan p ON p.tradingsymbol = b.tradingsymbol WHERE date BETWEEN from_date AND to_date)",
    "moving_averages": _indicator_query(BARS_LONG, "bars_long", "MA20", "MA50"),
    "rsi14": _indicator_query(BARS_LONG, "bars_long", "RSI14"),
    "atr14": _indicator_query(BARS_LONG, "bars_long", "ATR14"),
    "macd": _indicator_query(BARS_LONG, "bars_long", "MACD", "MACD_signal"),
    "obv": _indicator_query(BARS_LONG, "bars_long", "OBV"),
    "liquidity_volatility": _indicator_query(
        BARS_LONG, "bars_long", "avg_daily_volume", "volatility_1m"
    ),
    "price_changes": _indicator_query(
        BARS_LONG, "bars_long", "price_change_1w", "price_change_1m"
    ),
    "indicators": _all_indicators(BARS_LONG, "bars_long", "indicators"),
    "indicators_short": _all_indicators(BARS_SHORT, "bars_short", "indicators"),
    "indicators_chunked": _all_indicators(BARS_LONG, "bars_long", "indicators", places=4),
    "indicators_incremental": _all_indicators(BARS_LONG, "bars_long", "indicators"),
    "latest_bar": _all_indicators(BARS_LONG, "bars_long", "latest", "previous_OBV"),
    "latest_bar_maintained": _all_indicators(BARS_LONG, "bars_long", "latest", "previous_OBV"),
    "score": _score_query(BARS_LONG, "bars_long", LONG_SCORE),
    "score_short": _score_query(BARS_SHORT, "bars_short", SHORT_SCORE),
    "scores_snapshot": _scores_of_day("2024-01-29") + " UNION ALL " + _scores_of_day("2024-01-30"),
    "latest_scores": _scores_of_day("2024-01-30"),
    "candidates": f"WITH RECURSIVE {BARS_SHORT},{UNIVERSE},{SECTORS},{_candidate_ctes('bars_short', 'sectors')} "
    "SELECT * FROM candidates",
    "return_correlation": _against_picks("pos"),
    "return_correlation_by_date": _against_picks("date"),
    "select_top": _selection("SELECT * FROM picks"),
    "select_top_by_date": _selection("SELECT * FROM picks", align="date"),
    "select_top_one_per_sector": _selection("SELECT * FROM picks", max_per_sector=1),
    "top_picks": _selection(PICKED_ROWS),
    "unclassified_symbols": f"WITH {UNIVERSE},{SECTORS} SELECT * FROM universe "
    "WHERE tradingsymbol NOT IN (SELECT tradingsymbol FROM sectors)",
    "sector_prompt_batches": f"""WITH {UNIVERSE},{SECTORS},
new AS (SELECT * FROM universe WHERE tradingsymbol NOT IN (SELECT tradingsymbol FROM sectors)),
bucketed AS (
  SELECT tradingsymbol, instrument_token,
         tradingsymbol || ' - ' || coalesce(nullif(name, ''), tradingsymbol) AS line,
         CAST(CAST('0x' || substr(md5(tradingsymbol || ':' || instrument_token), 1, 8) AS BIGINT)
              % greatest(1, ceil((SELECT count(*) FROM new) / 100.0)) AS BIGINT) AS bucket
  FROM new),
numbered AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY bucket ORDER BY tradingsymbol, instrument_token)
                  - 1) // 40 AS BIGINT) AS batch_no
  FROM bucketed)
SELECT bucket, batch_no, count(*) AS n_symbols,
       'Give every stock below exactly one sector out of this list: {_ALLOWED}.' || chr(10)
       || 'Answer with a JSON array of objects having the fields tradingsymbol, name and sector.'
       || chr(10) || string_agg(line, chr(10) ORDER BY tradingsymbol, instrument_token) AS request
FROM numbered GROUP BY 1, 2""",
    "sector_replies": f"WITH {REPLIED} SELECT Date_Update, tradingsymbol, name, sector, "
    "sector IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') AS is_allowed FROM replied",
    "sector_rejects": f"WITH {ALL_SECTORS} SELECT DISTINCT batch_id FROM all_sectors WHERE {UNREADABLE}",
    "news_recency": f"WITH {NEWS},{RECENT} SELECT name, item_no, title, date, article_time "
    "FROM recent",
    "news_recency_minutes": f"WITH {NEWS},{RECENT_MINUTES} SELECT name, item_no, date, article_time "
    "FROM recent",
    "lexicon_sentiment": f"WITH {NEWS},{LEXICON},{_sentiment_cte('news')} SELECT * FROM sentiments",
    "lexicon_sentiment_large": f"WITH {NEWS},{LARGE_LEXICON},{_sentiment_cte('news')} SELECT * FROM sentiments",
    "sentiment_summary": f"""WITH {NEWS},{LEXICON},{RECENT},{_sentiment_cte('recent')}
SELECT n.name, count(s.name) AS n_items,
       coalesce({_cents("avg(sentiment)")}, 0) AS avg_sentiment
FROM (SELECT DISTINCT name FROM news) n LEFT JOIN sentiments s ON s.name = n.name GROUP BY 1""",
    "order_intents": f"""
SELECT tradingsymbol, 1 AS quantity, true AS amo, 'CNC' AS product, 'MARKET' AS order_type,
       last_price, {_cents("(last_price + 0.1::DOUBLE)")} AS trigger_price
FROM (SELECT 'U' || user_id AS tradingsymbol, arg_max(value, row(ts, event_id)) AS last_price
      FROM events GROUP BY 1)
WHERE tradingsymbol NOT IN (
  SELECT 'U' || o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '2000-02-21')""",
    "order_ledger": f"""
SELECT CAST('0x' || substr(md5(symbol || '|' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '|'
                               || coalesce(placed, '') || '|' || o_orderkey), 1, 15) AS BIGINT) AS id,
       symbol AS tradingsymbol, 1 AS quantity, true AS amo, 'CNC' AS product,
       'MARKET' AS order_type, CAST(o_orderdate AS TIMESTAMP) AS requested_at, placed AS order_id,
       CASE WHEN o_orderstatus = 'F' THEN 'SUCCESS' ELSE 'FAILED' END AS status,
       CASE WHEN unknown THEN '{UNEXPECTED_RESPONSE}' END AS error_message,
       CASE WHEN unknown THEN 'UNKNOWN' WHEN o_orderstatus = 'F' THEN 'SUCCESS' ELSE 'FAILED' END
         AS broker_status,
       CASE WHEN o_orderstatus = 'F' THEN 'Order placed [ID] ' || o_orderkey
            WHEN o_orderstatus = 'O' THEN 'AMO orders cannot be placed now.'
            WHEN unknown THEN '[no record]'
            WHEN o_orderkey % 4 = 0 THEN 'Insufficient funds'
            ELSE 'KeyError: [''ltp''] missing' END AS broker_message,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 3 AS INTEGER) END AS filled_quantity,
       CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 > 0
            THEN CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) END AS average_price,
       o_orderstatus = 'O' AS amo_refused
FROM (SELECT *, 'U' || o_custkey AS symbol,
             CASE WHEN o_orderstatus = 'F' THEN 'R' || o_orderkey END AS placed,
             o_orderstatus NOT IN ('F', 'O') AND o_orderkey % 2 <> 0 AS unknown FROM orders)""",
    "holdings_view": f"""
SELECT tradingsymbol, CAST(q AS INTEGER) AS quantity, {_cents("(e / q)")} AS average_price,
       {_cents("p")} AS last_price
FROM (SELECT 'S' || l_suppkey AS tradingsymbol, sum(l_quantity) AS q, sum(l_extendedprice) AS e,
             arg_max(l_extendedprice / l_quantity,
                     row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS p
      FROM lineitem GROUP BY 1)""",
    "market_session": """
SELECT event_id, ts, local_ts
FROM (SELECT event_id, ts, ts + INTERVAL 330 MINUTE AS local_ts FROM events)
WHERE CAST(local_ts AS TIME) BETWEEN TIME '09:15:00' AND TIME '15:30:00'""",
    "daily_pipeline": f"WITH RECURSIVE {BARS_SHORT},{UNIVERSE},{REPLIED}, kept AS ("
    "SELECT * FROM bars_short WHERE tradingsymbol IN (SELECT tradingsymbol FROM universe) "
    f"AND date BETWEEN DATE '2023-10-30' AND {AS_OF}),"
    f"{_candidate_ctes('kept', 'replied')},{_selection_ctes('kept')}{PICKED_ROWS}",
}
