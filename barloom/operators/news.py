"""Recency of news items and lexicon sentiment."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.columns import round_half_even
from barloom.session import cut_lineage

# fixed value: constant of the compound polarity s / sqrt(s^2 + 15), kept to 4 decimals
NORMALISER = 15.0
COMPOUND_PLACES = 4

SPREAD = 64

#: Up to this many lexicon words are broadcast.
BROADCAST_WORDS = 100_000
#: Of a larger lexicon, the words looked for in a sketch of the texts, the entries of that sketch, the items it sees.
HOT_WORDS = 4_096
SKETCH_WORDS = 65_536
HOT_SAMPLE = 0.05


def _first_items(news: DataFrame, max_articles: int) -> DataFrame:
    """The first ``max_articles`` items of each name by ``item_no``.

    Only keys are ranked; texts are fetched for the items that are left. A name's keys are first spread over
    ``SPREAD`` groups, each of which keeps its own first items, so the second step sees a bounded number of
    rows per name. Spark also applies the limit on the map side of both steps.
    """
    spread = F.pmod(F.xxhash64("item_no"), F.lit(SPREAD))
    part = Window.partitionBy("name", "_spread").orderBy("item_no")
    whole = Window.partitionBy("name").orderBy("item_no")
    kept = (
        news.select("name", "item_no", spread.alias("_spread"))
        .withColumn("_rank", F.row_number().over(part))
        .filter(F.col("_rank") <= max_articles)
        .withColumn("_rank", F.row_number().over(whole))
        .filter(F.col("_rank") <= max_articles)
    )
    return news.join(kept.select("name", "item_no"), ["name", "item_no"], "left_semi")


def news_recency(
    news: DataFrame, as_of: datetime, max_articles: int = 50, include_minutes: bool = False
) -> DataFrame:
    """Of the first items per name, those at most a day old, with their article time.

    The age is text such as ``"5 hours ago"``, split at white space of any kind; texts of another form are
    dropped, as are minutes unless ``include_minutes`` is set.
    """
    age = F.col("date")
    number = F.regexp_extract(age, r"^\s*(\S+)", 1).try_cast("int")
    zero = F.lit(0)
    elapsed = F.when(age.contains("hour"), F.make_dt_interval(zero, number, zero, F.lit(0.0))).when(
        age.contains("day"), F.make_dt_interval(number, zero, zero, F.lit(0.0))
    )
    if include_minutes:
        elapsed = elapsed.when(
            age.contains("min"), F.make_dt_interval(zero, zero, number, F.lit(0.0))
        )
    now = F.lit(as_of).cast("timestamp_ntz")
    return (
        _first_items(news, max_articles)
        .withColumn("_elapsed", elapsed)
        .filter(F.col("_elapsed") <= F.expr("INTERVAL '1' DAY"))
        .withColumn("article_time", now - F.col("_elapsed"))
        .drop("_elapsed")
    )


def lexicon_table(spark: SparkSession, lexicon: Mapping[str, float]) -> DataFrame:
    """A word list kept in code as the (word, valence) table the operators take."""
    return spark.createDataFrame([(w, float(v)) for w, v in lexicon.items()], "word string, valence double")


def item_words(news: DataFrame) -> DataFrame:
    """(name, item_no, word) for every run of letters, of any script, in title and description."""
    text = F.lower(F.concat_ws(" ", "title", "desc"))
    return news.select("name", "item_no", F.explode(F.split(text, r"[^\p{L}]+")).alias("word"))


def hot_words(news: DataFrame, share: float = HOT_SAMPLE) -> list[str]:
    """The commonest words of a share of the items, at most ``HOT_WORDS``, by a sketch of bounded size.

    Only the layout of a join follows from them, never its result, so a word that is missed costs time alone.
    """
    sketch = F.expr(f"approx_top_k(word, {HOT_WORDS}, {SKETCH_WORDS})").alias("top")
    top = item_words(news.sample(share, seed=1)).agg(sketch).first()["top"]
    return [entry["item"] for entry in top or []]


def _valued(words: DataFrame, lexicon: DataFrame, hot: list[str]) -> DataFrame:
    """(name, item_no, word) with the word's valence: hot words from a small broadcast, the others by a plain join."""
    if not hot:
        return words.join(lexicon, "word", "left")
    is_hot = F.col("word").isin(*hot)
    found = words.filter(~is_hot).join(lexicon, "word", "left")
    return found.unionByName(words.filter(is_hot).join(F.broadcast(lexicon.filter(is_hot)), "word", "left"))


def lexicon_sentiment(news: DataFrame, lexicon: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Compound polarity of title and description per item: (name, item_no, n_hits, sentiment).

    ``lexicon`` has ``word, valence``, a word once. The words of whole texts are matched with it and summed per
    item; an item without a hit comes out as 0. A lexicon of at most ``broadcast_words`` words is broadcast, and then
    nothing but one narrow row per item and task is shuffled. Beyond that the words that a sketch finds to be hot, most of
    any text, meet a broadcast of their at most ``HOT_WORDS`` entries and are summed per item where they are; all others are
    joined plainly, so no key has more than a small share of the rows and each lexicon entry is shuffled once. The lexicon
    is written first, for it is read up to three times and may have been gathered from the texts.
    """
    lexicon = cut_lineage(lexicon.select("word", "valence"), "lexicon")
    words = item_words(news)
    if lexicon.limit(broadcast_words + 1).count() <= broadcast_words:
        valued = words.join(F.broadcast(lexicon), "word", "left")
    else:
        valued = _valued(words, lexicon, hot_words(news))
    total = F.coalesce(F.sum("valence"), F.lit(0.0))
    compound = F.col("_total") / F.sqrt(F.col("_total") * F.col("_total") + F.lit(NORMALISER))
    return (
        valued.groupBy("name", "item_no")
        .agg(F.count("valence").alias("n_hits"), total.alias("_total"))
        .select(
            "name", "item_no", "n_hits", F.round(compound, COMPOUND_PLACES).alias("sentiment")
        )
    )


def sentiment_summary(names: DataFrame, sentiments: DataFrame) -> DataFrame:
    """Mean sentiment per name, two decimals; 0 for a name without recent items."""
    means = sentiments.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_items"), round_half_even(F.avg("sentiment")).alias("_mean")
    )
    return (
        names.select("name")
        .distinct()
        .join(means, "name", "left")
        .select(
            "name",
            F.coalesce("n_items", F.lit(0)).alias("n_items"),
            F.coalesce("_mean", F.lit(0.0)).alias("avg_sentiment"),
        )
    )
