"""URL allow and block rules found through an index on their rarest literal token."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import col

#: Up to this many rules the index is broadcast; a longer list is joined by shuffle.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is a host, its subdomains included, and a path prefix, such as ``example.com/en/``."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]

    def regex(self) -> str:
        """Matches host and path of a url, written together."""
        return r"^([^/]*\.)?" + _quoted(self.host) + _quoted(self.path)

    def literals(self) -> list[str]:
        """Tokens that every url the rule fits must have: host labels and closed path segments."""
        labels = [f"h:{label}" for label in self.host.split(".") if label]
        segments = [f"p:{segment}" for segment in self.path.split("/")[1:-1] if segment]
        return sorted(set(labels + segments))


def _quoted(text: str) -> str:
    return re.sub(r"([^\w/])", r"\\\1", text, flags=re.ASCII)


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + F.lit(3), F.length(url))
    return F.when(F.coalesce(at, F.lit(0)) > 0, rest).otherwise("")


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments))


def rule_table(spark: SparkSession, rules: Sequence[UrlRule]) -> DataFrame:
    """One row per rule; a larger ``priority`` wins: the longer pattern, then the greater one."""
    if len({rule.pattern for rule in rules}) < len(rules):
        raise ValueError("a pattern may be listed once only")
    if unbound := [rule.pattern for rule in rules if not rule.host.strip(".")]:
        raise ValueError(f"rules without a host: {unbound}")
    ordered = sorted(rules, key=lambda rule: (len(rule.pattern), rule.pattern))
    rows = [(i, r.pattern, r.verdict, r.regex(), r.literals()) for i, r in enumerate(ordered)]
    schema = "priority int, rule string, rule_verdict string, regex string, literals array<string>"
    return spark.createDataFrame(rows, schema)


def rarest_literal_index(tokens: DataFrame, rules: DataFrame, small: bool) -> DataFrame:
    """(token, priority, regex): each rule under the literal that the fewest urls have.

    ``tokens`` has one array column ``tokens`` per url. Only tokens that some rule names are counted.
    """
    literals = rules.select("priority", F.explode("literals").alias("token"))
    named = _sized(literals.select("token").distinct(), small)
    counts = tokens.select(F.explode("tokens").alias("token")).join(named, "token").groupBy("token").count()
    held = literals.join(counts, "token", "left").select(
        "priority", "token", F.coalesce("count", F.lit(0)).alias("n")
    )
    rarest = held.groupBy("priority").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    return rarest.join(rules.select("priority", "regex"), "priority")


def _sized(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def filter_urls(
    pages: DataFrame,
    rules: Sequence[UrlRule],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Judge every url: ``id_col``, ``host``, ``path``, ``rule``, ``verdict`` and ``n_candidates``.

    Each rule is filed under its rarest literal token. A url's own tokens fetch candidate rules from that
    file, and regular expressions run on those only. The longest fitting rule wins; a url that none fits
    has a null rule and the verdict ``default``. ``n_candidates`` counts the regular expressions tried.

    A null url or one without ``://`` has an empty host and path and no rule. Repeated rows and ids give a
    row each; other columns are left out, whatever their names. Rows of one url are combined inside the
    task that exploded them, so the only shuffle carries one short row per url, dealt by a row number.
    """
    spark = pages.sparkSession
    small = len(rules) <= BROADCAST_RULES
    parsed = pages.select(
        col(id_col).alias("id"), url_host(col(url_col)).alias("host"), url_path(col(url_col)).alias("path")
    ).withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    known = rule_table(spark, rules)
    index = _sized(rarest_literal_index(parsed.select("tokens"), known, small), small)
    numbered = parsed.withColumn("row", F.monotonically_increasing_id())
    asked = numbered.select("row", "id", "host", "path", F.explode("tokens").alias("token"))
    tried = asked.join(index, "token", "left")
    fits = F.rlike(F.concat("host", "path"), F.col("regex"))
    best = (
        tried.withColumn("fitting", F.when(fits, F.col("priority")))
        .groupBy("row", "id", "host", "path")
        .agg(F.max("fitting").alias("priority"), F.count("priority").alias("n_candidates"))
    )
    judged = best.join(_sized(known.select("priority", "rule", "rule_verdict"), small), "priority", "left")
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", F.lit(default)).alias("verdict"),
        "n_candidates",
    )
