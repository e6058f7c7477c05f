"""Universe, scores, sectors, news, orders and session: small frames with known answers."""

import datetime as dt

import pytest
from frames import DAY0
from pyspark.sql import functions as F

from barloom.functions.columns import round_half_even
from barloom.operators import market, news, orders, scoring, sectors, universe
from barloom.schemas import INSTRUMENTS, NEWS
from barloom.sources.readers import jdbc_options, read_instruments, read_jdbc

NOW = dt.datetime(2024, 1, 30, 12)


def test_rounding(spark):
    values = [0.125, 2.665, 2.675, 1.005, 10.375, -0.125]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(round_half_even("x")).collect()]
    assert got == [0.12, 2.66, 2.68, 1.0, 10.38, -0.12]


def test_universe_from_csv(spark, tmp_path):
    path = tmp_path / "instruments.csv"
    path.write_text(
        "instrument_token,exchange_token,tradingsymbol,name,last_price,instrument_type,segment,exchange\n"
        "1,11,AAA,Alpha,0.0,EQ,NSE,NSE\n"
        "2,12,75ABC30-GS,Bond,0.0,EQ,NSE,NSE\n"
        "3,13,BBB,Beta,0.0,EQ,INDICES,NSE\n"
        "4,14,CCC,Gamma,0.0,EQ,BSE,BSE\n"
        "5,15,3ABC,Digit,0.0,EQ,NSE,NSE\n"
        "6,16,AAA,Alpha,0.0,EQ,BSE,BSE\n"
    )
    instruments = read_instruments(spark, str(path))
    assert instruments.schema == INSTRUMENTS
    rows = universe.universe_filter(instruments, DAY0).orderBy("tradingsymbol").collect()
    assert [r["tradingsymbol"] for r in rows] == ["3ABC", "AAA"]
    requests = spark.createDataFrame(
        [("AAA", "NSE"), ("AAA", "BSE"), ("NONE", "NSE")],
        "tradingsymbol string, exchange string",
    )
    found = universe.instrument_lookup(requests, instruments).collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in found} == {
        ("AAA", "NSE"): (1, True),
        ("AAA", "BSE"): (6, True),
        ("NONE", "NSE"): (None, False),
    }


def test_snapshot_replaces(spark, store):
    def instruments(*tokens):
        rows = [(t, t, f"S{t}", "n", "EQ", "NSE", "NSE") for t in tokens]
        return spark.createDataFrame(rows, INSTRUMENTS)

    assert universe.universe_snapshot(store, instruments(1, 2, 3), DAY0).count() == 3
    assert universe.universe_snapshot(store, instruments(4), DAY0).count() == 1


LATEST = (
    "tradingsymbol string, date date, close double, avg_daily_volume double, volatility_1m double, "
    "price_change_1w double, price_change_1m double, MA20 double, MA50 double, RSI14 double, "
    "MACD double, MACD_signal double, OBV double, previous_OBV double"
)


def test_score(spark):
    rows = [
        ("ALL", DAY0, 10.0, 2e6, 0.05, 0.1, 0.2, 2.0, 1.0, 50.0, 2.0, 1.0, 2.0, 1.0),
        ("EDGE", DAY0, 10.0, 5e5, 0.08, -0.1, 0.0, 1.0, 1.0, 60.0, 1.0, 1.0, 1.0, 1.0),
        ("GAPS", DAY0, 10.0, 1e6, None, 0.1, 0.1, 1.0, None, None, 1.0, 2.0, 1.0, 2.0),
        ("NULL", DAY0, 10.0, 1e6, 0.05, 0.1, None, 2.0, 1.0, 50.0, 2.0, 1.0, 2.0, 1.0),
    ]
    scored = scoring.score(spark.createDataFrame(rows, LATEST))
    got = {r["tradingsymbol"]: r["score"] for r in scored.collect()}
    assert got["ALL"] == pytest.approx(10 + 10 + 5 + 10 + 10 + 5 + 5 + 5)
    assert got["EDGE"] == pytest.approx(5 + 10 + 5)
    assert got["GAPS"] == pytest.approx(10 + 5 + 5)
    assert got["NULL"] is None


def test_scores_are_stored_once_per_day(spark, store):
    rows = spark.createDataFrame(
        [("A", 1.005, 2.675), ("B", None, 1.0)], "tradingsymbol string, score double, close double"
    )
    next_day = DAY0 + dt.timedelta(days=1)
    for day in (DAY0, next_day, next_day):
        stored = scoring.scores_snapshot(store, rows, day)
    assert stored.count() == 4
    newest = scoring.latest_scores(stored).orderBy("tradingsymbol").collect()
    assert [(r["Date_Update"], r["score"], r["latest_close"]) for r in newest] == [
        (next_day, 1.0, 2.68),
        (next_day, None, 1.0),
    ]
    # a re-run that scores fewer symbols replaces the day as a whole
    stored = scoring.scores_snapshot(store, rows.filter("tradingsymbol = 'B'"), next_day)
    assert stored.count() == 3


def test_request_batches_hold_every_symbol_once(spark):
    rows = [(i, f"S{i:05d}", None if i % 3 else f"Name {i}") for i in range(1234)]
    new = spark.createDataFrame(rows, "instrument_token long, tradingsymbol string, name string")
    batches = sectors.sector_request_batches(new, 100, ["One", "Two"], rows_per_bucket=300).collect()
    assert max(r["n_symbols"] for r in batches) <= 100
    assert sum(r["n_symbols"] for r in batches) == 1234
    lines = [line for r in batches for line in r["request"].split("\n")[2:]]
    assert sorted(lines) == sorted(
        f"{s} - {name or s}" for _, s, name in rows
    )
    assert all("One, Two" in r["request"] for r in batches)


def test_replies(spark):
    good = 'Sure [see below]\n[ {"tradingsymbol":"A","name":"n","sector":"Metals"},\n'
    good += '{"tradingsymbol":"B","sector":"Nonsense"} ]\nBye'
    replies = spark.createDataFrame(
        [(1, good), (2, "nothing here"), (3, '[{"tradingsymbol": "C", oops}]'), (4, None)],
        "batch_id long, reply string",
    )
    rows = sectors.sector_replies(replies, DAY0).orderBy("tradingsymbol").collect()
    assert [tuple(r) for r in rows] == [
        (DAY0, "A", "n", "Metals", True),
        (DAY0, "B", None, "Nonsense", False),
    ]
    rejected = sectors.rejected_replies(replies).collect()
    assert sorted(r["batch_id"] for r in rejected) == [2, 3, 4]


def test_allowed_sectors():
    assert len(sectors.ALLOWED_SECTORS) == len(set(sectors.ALLOWED_SECTORS)) == 34


def test_news(spark):
    ages = ["24 hours ago", "25 hours ago", "1 day ago", "2 days ago", "5 mins ago", "an hour ago"]
    rows = [("N", i, "the", None, age) for i, age in enumerate(ages)]
    rows += [("HOT", i, "and", "x", "1 hour ago") for i in range(300)]
    rows += [("OLD", 1, "is", "x", "9 days ago")]
    items = spark.createDataFrame(rows, NEWS)
    kept = news.news_recency(items, NOW).collect()
    assert sorted(r["item_no"] for r in kept if r["name"] == "N") == [0, 2]
    assert sorted(r["item_no"] for r in kept if r["name"] == "HOT") == list(range(50))
    assert kept[0]["article_time"].tzinfo is None
    minutes = news.news_recency(items, NOW, include_minutes=True).filter("name = 'N'").collect()
    assert sorted(r["item_no"] for r in minutes) == [0, 2, 4]
    recent = news.lexicon_sentiment(news.news_recency(items, NOW), news.lexicon_table(spark, {"the": 1.0, "and": -2.0}))
    summary = {r["name"]: r for r in news.sentiment_summary(items, recent).collect()}
    assert summary["N"]["avg_sentiment"] == 0.25 and summary["N"]["n_items"] == 2
    assert summary["HOT"]["avg_sentiment"] == -0.46 and summary["HOT"]["n_items"] == 50
    assert summary["OLD"]["avg_sentiment"] == 0.0 and summary["OLD"]["n_items"] == 0


def test_sentiment_reads_whole_texts(spark):
    text = "word " * 50_000 + "good"
    items = spark.createDataFrame([("N", 1, "t", text, ""), ("N", 2, None, None, "")], NEWS)
    got = news.lexicon_sentiment(items, news.lexicon_table(spark, {"good": 1.0})).orderBy("item_no").collect()
    assert [(r["n_hits"], r["sentiment"]) for r in got] == [(1, 0.25), (0, 0.0)]


def test_sentiment_with_a_lexicon_too_large_to_broadcast(spark, monkeypatch):
    """Hot words meet a broadcast of their few entries, the others are joined plainly; results are those of one join."""
    monkeypatch.setattr(news, "HOT_WORDS", 2)
    texts = [("N", i, "good good bad Größe", "fine " * (i % 3), "") for i in range(40)]
    items = spark.createDataFrame(texts, NEWS)
    lexicon = news.lexicon_table(spark, {"good": 1.5, "bad": -1.0, "größe": 0.25})
    one = {(r["item_no"], r["n_hits"], r["sentiment"]) for r in news.lexicon_sentiment(items, lexicon).collect()}
    assert {n for _, n, _ in one} == {4}
    for share in (1.0, 0.0):  # with hot words found and with none
        monkeypatch.setattr(news.hot_words, "__defaults__", (share,))
        shuffled = news.lexicon_sentiment(items, lexicon, broadcast_words=2)
        assert {(r["item_no"], r["n_hits"], r["sentiment"]) for r in shuffled.collect()} == one
        plan = shuffled._jdf.queryExecution().optimizedPlan().toString()
        assert ("good" in plan) == (share == 1.0) and plan.count("Join LeftOuter") == (2 if share else 1)


def test_hot_words_are_the_commonest(spark, monkeypatch):
    texts = [("N", i, "common common rare" + chr(97 + i % 26) * 3, None, "") for i in range(200)]
    items = spark.createDataFrame(texts, NEWS)
    monkeypatch.setattr(news, "HOT_WORDS", 1)
    assert news.hot_words(items, 1.0) == ["common"]
    assert news.hot_words(items.filter("false"), 1.0) == []


def test_ages_split_at_any_white_space(spark):
    ages = ["  3 hours ago", "3\thours ago", "\n1  day ago", "many hours ago", ""]
    items = spark.createDataFrame([("N", i, "t", "d", a) for i, a in enumerate(ages)], NEWS)
    assert sorted(r["item_no"] for r in news.news_recency(items, NOW).collect()) == [0, 1, 2]


def test_replies_must_be_one_array(spark):
    one = '[{"tradingsymbol": "A", "name": "n", "sector": "Metals"}]'
    texts = [one, f"see {one}.", f"{one} and {one}", one.replace('"', "'"), one[:-9] + "]", "none", None]
    replies = spark.createDataFrame(list(enumerate(texts)), "batch_id int, reply string")
    assert sorted(r["batch_id"] for r in sectors.rejected_replies(replies).collect()) == [2, 3, 4, 5, 6]
    assert sectors.sector_replies(replies, DAY0).count() == 2


def test_order_intents(spark):
    picks = spark.createDataFrame([("A",), ("B",), ("C",), ("A",)], "tradingsymbol string")
    quotes = spark.createDataFrame(
        [("A", 10.0), ("B", 11.0)], "tradingsymbol string, last_price double"
    )
    ledger = spark.createDataFrame(
        [("B", dt.datetime(2024, 1, 1, 23, 59, 59)), ("A", dt.datetime(2024, 1, 2))],
        "tradingsymbol string, requested_at timestamp_ntz",
    )
    rows = orders.order_intents(picks, quotes, ledger, DAY0, quantity=3)
    got = {r["tradingsymbol"]: (r["quantity"], r["trigger_price"]) for r in rows.collect()}
    assert got == {"A": (3, 10.1), "C": (3, None)}
    below = quotes.select(orders.trigger_price(F.col("last_price"), buy=False)).first()[0]
    assert below == 9.9


def test_ledger(spark, store):
    responses = spark.createDataFrame(
        [
            ("A", True, "1", "placed [x]", None),
            ("B", False, None, " AMO orders cannot be placed now. [code]", "broker"),
            ("C", False, None, "KeyError: ['ltp'] missing", "other"),
            ("D", None, None, "[1, 2]", None),
            ("D", None, None, "[1, 2]", None),
        ],
        "tradingsymbol string, success boolean, order_id string, message string, error_kind string",
    )
    ledger = orders.order_ledger(responses, NOW)
    got = {r["tradingsymbol"]: r for r in ledger.collect()}
    assert ledger.count() == 4
    assert got["C"]["broker_message"] == "KeyError: ['ltp'] missing"
    assert (got["A"]["status"], got["A"]["broker_message"]) == ("SUCCESS", "placed [x]")
    assert got["B"]["broker_message"] == "AMO orders cannot be placed now."
    assert [got[s]["amo_refused"] for s in "ABCD"] == [False, True, False, False]
    assert (got["D"]["status"], got["D"]["broker_status"]) == ("FAILED", "UNKNOWN")
    assert got["D"]["error_message"] and not got["C"]["error_message"]
    assert len({r["id"] for r in got.values()}) == 4
    store.append("stock_intended_orders", ledger)
    requested = store.read("stock_intended_orders")
    left = orders.order_intents(
        responses, spark.createDataFrame([], "tradingsymbol string, last_price double"),
        requested, NOW.date(),
    )
    assert left.count() == 0


def test_ledger_keeps_what_a_response_carries(spark):
    at = [dt.datetime(2024, 1, 1, 9, i) for i in range(2)]
    rows = [("A", True, "1", "ok", at[0], 3, "9.5", "x"), ("A", True, "1", "ok", at[0], 3, "9.5", "y"), ("A", True, "2", "ok", at[1], None, None, "x")]
    responses = spark.createDataFrame(
        rows,
        "tradingsymbol string, success boolean, order_id string, message string, requested_at timestamp_ntz, "
        "filled_quantity int, average_price string, response_no string",
    )
    got = orders.order_ledger(responses, NOW).collect()
    assert len({r["id"] for r in got}) == 3
    assert sorted((r["requested_at"], r["filled_quantity"] or 0, r["average_price"] or "") for r in got) == [
        (at[0], 3, "9.5"), (at[0], 3, "9.5"), (at[1], 0, ""),
    ]


def test_two_failures_in_one_second_are_two_rows(spark):
    kind = "tradingsymbol string, success boolean, order_id string, message string, error_kind string"
    rows = [("A", False, None, "no funds", "broker"), ("A", False, None, "no margin", "broker"), ("A", None, None, None, None)]
    got = orders.order_ledger(spark.createDataFrame(rows + rows, kind), NOW).collect()
    assert sorted(r["broker_message"] or "" for r in got) == ["", "no funds", "no margin"]
    assert len({r["id"] for r in got}) == 3


def test_the_row_of_a_number_does_not_depend_on_its_order(spark):
    kind = "tradingsymbol string, success boolean, order_id string, message string, response_no string"
    rows = [("A", False, None, text, "7") for text in ("first", "second")]
    for given in (rows, rows[::-1]):
        got = orders.order_ledger(spark.createDataFrame(given, kind).repartition(2), NOW).collect()
        assert [r["broker_message"] for r in got] == ["second"]


def test_one_intent_per_pick_from_the_newest_quote(spark):
    quotes = spark.createDataFrame(
        [("A", 10.0, 1), ("A", 12.0, 3), ("A", 11.0, 2)], "tradingsymbol string, last_price double, quoted_at int"
    )
    none = spark.createDataFrame([], "tradingsymbol string, requested_at timestamp_ntz")
    rows = orders.order_intents(quotes.select("tradingsymbol"), quotes, none, DAY0).collect()
    assert [r["last_price"] for r in rows] == [12.0]


def test_holdings_show_present_columns(spark):
    rows = spark.createDataFrame(
        [("A", 2, 1.005, "x", 9.0)],
        "tradingsymbol string, quantity int, average_price double, other string, pnl double",
    )
    assert tuple(orders.holdings_view(rows).first()) == ("A", 2, 1.005, 9.0)
    view = orders.holdings_view(rows, places=2)
    assert view.columns == ["tradingsymbol", "quantity", "average_price", "pnl"]
    assert tuple(view.first()) == ("A", 2, 1.0, 9.0)


def test_session_bounds(spark):
    at = [(3, 44, 59, 999999), (3, 45, 0, 0), (10, 0, 0, 0), (10, 0, 0, 1), (20, 0, 0, 0)]
    rows = [(i, dt.datetime(2024, 1, 1, *t)) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz")
    assert sorted(r["id"] for r in market.market_session(df).collect()) == [1, 2]


def test_session_does_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 31, 4, 0),)], "ts timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Zurich")
    try:
        assert market.market_session(df).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_jdbc_options():
    options = jdbc_options("jdbc:x", "bars", "id", 0, 100, 8)
    assert options["numPartitions"] == "8" and options["partitionColumn"] == "id"
    assert "partitionColumn" not in jdbc_options("jdbc:x", "bars")
    with pytest.raises(ValueError):
        read_jdbc(None, "jdbc:x", "bars")


def test_a_lexicon_gathered_from_the_texts_is_gathered_once(spark, monkeypatch):
    """The texts are split for the hot words and for the others, not again for the lexicon, and words meet no shuffle of their own."""
    monkeypatch.setattr(news.hot_words, "__defaults__", (1.0,))
    monkeypatch.setattr(news, "HOT_WORDS", 2)
    texts = [("N", i, "good good bad Größe", "fine " * (i % 3), "") for i in range(40)]
    items = spark.createDataFrame([*texts, texts[0]], NEWS)
    words = news.item_words(items).select("word").distinct().withColumn("valence", F.length("word") % 7 / F.lit(2.0))
    one = {tuple(r) for r in news.lexicon_sentiment(items, words).collect()}
    shuffled = news.lexicon_sentiment(items, words, broadcast_words=2)
    assert {tuple(r) for r in shuffled.collect()} == one and len(one) == 40
    plan = shuffled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2 and plan.count("Aggregate") == 1
