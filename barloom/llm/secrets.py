"""Secret spans of whole texts, and corpus-wide ownership that tells copied examples from live credentials."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import col, cut_lineage


def either_case(word: str) -> str:
    """A pattern for the ASCII letters of ``word`` in either case, other characters as they are."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


class Kind(NamedTuple):
    """``pattern``'s group 1 is the secret itself, of ``least`` characters at least. A text without any of
    ``hints``, lower-cased, cannot match."""

    name: str
    pattern: str
    least: int
    hints: tuple[str, ...] = ()


_NAMES = "|".join([*map(either_case, ["password", "passwd", "secret", "token"]), either_case("api_?key")])

#: The base patterns and their least lengths.
BASE_KINDS = [
    Kind(
        "assign",
        rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
    ),
    Kind("access", r"(AKIA[A-Z0-9]{16,})", 20, ("akia",)),
    Kind("hex", r"([0-9a-f]{24,})", 24),
]
#: Kinds this operator adds: authorisation headers and passwords inside urls.
MORE_KINDS = [
    Kind("bearer", either_case("bearer") + r"\x20+([A-Za-z0-9._~+/=-]+)", 20, ("bearer",)),
    Kind("login", r"://[^\x09-\x0D\x20/:@?#]+:([^\x09-\x0D\x20/:@?#<>]+)@", 6, ("://",)),
]
KINDS = [*BASE_KINDS, *MORE_KINDS]

#: A value that at least so many owners have is a copied example and no one's own credential.
EXAMPLE_OWNERS = 3
#: Values with more than one in so many of all spans are hot: fewer than this many, by their definition.
HOT_VALUES = 1_000
PLACEHOLDERS = {"live": "<secret>", "example": "<example-secret>"}

_COMPILED = [re.compile(kind.pattern) for kind in KINDS]
_SPAN = "struct<kind:string,start:int,end:int,value_start:int,value_end:int,value:string>"


def find_spans(text: str) -> list[dict]:
    """The spans of one text by start, then kind in the order of KINDS; ends are exclusive."""
    lower, found = text.lower(), []
    for kind, pattern in zip(KINDS, _COMPILED):
        if kind.hints and not any(hint in lower for hint in kind.hints):
            continue
        for match in pattern.finditer(text):
            low, high = match.span(1)
            if high - low >= kind.least:
                found.append(
                    {
                        "kind": kind.name,
                        "start": match.start(),
                        "end": match.end(),
                        "value_start": low,
                        "value_end": high,
                        "value": text[low:high],
                    }
                )
    return sorted(found, key=lambda span: span["start"])  # stable: equal starts stay in the order of KINDS


def secret_spans(source: DataFrame) -> DataFrame:
    """Adds ``found``, the spans, and ``key``, a number of its own for each row, to ``id``, ``text``,
    ``repo``, ``owner`` and ``row``; the text itself is dropped."""
    kept = [name for name in source.columns if name != "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            spans = [find_spans(text.as_py() or "") for text in batch.column("text")]
            keys = pa.array(range(key, key + len(spans)), pa.int64())
            key += len(spans)
            found = pa.array(spans, pa.list_(pa.struct(_arrow_span())))
            columns = [batch.column(name) for name in kept]
            yield pa.RecordBatch.from_arrays([*columns, found, keys], [*kept, "found", "key"])

    types = {field.name: field.dataType.simpleString() for field in source.schema}
    layout = ", ".join(f"{name} {types[name]}" for name in kept)
    return source.mapInArrow(scan, f"{layout}, found array<{_SPAN}>, key long")


def _arrow_span() -> list[tuple[str, pa.DataType]]:
    whole, text = pa.int32(), pa.string()
    return [
        ("kind", text), ("start", whole), ("end", whole),
        ("value_start", whole), ("value_end", whole), ("value", text),
    ]


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n, n_repos, n_owners) from (hash, repo, owner) rows, one for each candidate anywhere.

    Distinct places come first, then counts per hash. Both aggregations combine before they shuffle, so a
    value copied into a third of all documents costs each task a row per place.
    """
    places = candidates.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = places.groupBy("hash", "owner").agg(F.sum("n").alias("n"))
    repos = places.groupBy("hash", "repo").agg(F.lit(1).alias("one"))
    return (
        by_owner.groupBy("hash")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_owners"))
        .join(repos.groupBy("hash").agg(F.count("one").alias("n_repos")), "hash")
    )


def _with_owners(spans: DataFrame, owners: DataFrame) -> DataFrame:
    """``spans`` with the counts of their ``hash``.

    A value with more than one in ``HOT_VALUES`` of all spans would gather its rows in one task of a join. There are fewer
    than ``HOT_VALUES`` such values, whatever the corpus, so their counts are broadcast; the others are joined by hash.
    """
    total = owners.agg(F.sum("n")).first()[0] or 0
    counts = owners.withColumn("hot", F.col("n") * HOT_VALUES > total)
    hot = F.broadcast(counts.filter("hot").select("hash", "n_repos", "n_owners"))
    cold = counts.filter(~F.col("hot")).select("hash", "n_repos", "n_owners")
    rest = spans.join(hot.select("hash"), "hash", "left_anti")
    return spans.join(hot, "hash").unionByName(rest.join(cold, "hash"))


def scan_secrets(
    docs: DataFrame,
    repo: Column,
    owner: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    example_owners: int = EXAMPLE_OWNERS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: ``id``, ``row`` (a struct of the columns in ``carry``) and ``spans``, an array
    of (kind, start, end, value_start, value_end, n_repos, n_owners, verdict) by start, then kind.

    Spans come from the base kinds, which find the same whatever else is found, and from MORE_KINDS.
    Hashes of all values are aggregated over the whole corpus by distinct repositories and owners: a value
    of ``example_owners`` owners or more is an ``example``, any other is ``live``.

    Offsets count code points. A null or empty text has no spans; null repositories and owners count as one
    of that kind; repeated rows and null ids give a row each; an empty table gives no rows. Only rows with
    spans are shuffled, by a number of their own.
    """
    row = F.struct(*[col(name) for name in carry]) if carry else F.struct(F.lit(True).alias("none"))
    source = docs.select(
        col(id_col).alias("id"),
        col(text_col).alias("text"),
        F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        row.alias("row"),
    )
    scanned = cut_lineage(secret_spans(source), "secret-spans")
    with_spans = scanned.filter(F.size("found") > 0)
    spans = with_spans.select("key", "repo", "owner", F.posexplode("found").alias("place", "span")).withColumn(
        "hash", F.sha2("span.value", 256)
    )
    owners = cut_lineage(ownership(spans.select("hash", "repo", "owner")), "secret-owners")
    owned = _with_owners(spans.select("key", "hash", "place", "span"), owners)
    verdict = F.when(F.col("n_owners") >= example_owners, "example").otherwise("live")
    judged = F.struct(
        "place", "span.kind", "span.start", "span.end", "span.value_start", "span.value_end",
        "n_repos", "n_owners", verdict.alias("verdict"),
    )
    gathered = owned.groupBy("key").agg(F.sort_array(F.collect_list(judged)).alias("spans"))
    rest = scanned.filter(F.size("found") == 0).select("id", "row", "key")
    found = with_spans.select("id", "row", "key").join(gathered, "key")
    empty = F.array().cast(gathered.schema["spans"].dataType)
    return found.select("id", "row", "spans").unionByName(rest.select("id", "row", empty.alias("spans")))


def redact(text: str | None, spans: list[dict]) -> str | None:
    """The text with each secret value, overlapping ones as one, replaced by its verdict's placeholder."""
    merged: list[list] = []
    for span in sorted(spans, key=lambda span: (span["value_start"], span["value_end"])):
        low, high, verdict = span["value_start"], span["value_end"], span["verdict"]
        if merged and low < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
            merged[-1][2] = "live" if "live" in (merged[-1][2], verdict) else verdict
        else:
            merged.append([low, high, verdict])
    parts, at = [], 0
    for low, high, verdict in merged:
        parts += [text[at:low], PLACEHOLDERS[verdict]]
        at = high
    return "".join([*parts, text[at:]]) if parts else text


def redact_secrets(
    docs: DataFrame,
    repo: Column,
    owner: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str | None = None,
) -> DataFrame:
    """``docs`` with every secret value replaced; all rows and columns stay, and rows without secrets are
    unchanged. ``length_col`` is a column with the text's length, if there is one."""
    scanned = scan_secrets(docs, repo, owner, id_col, text_col, carry=docs.columns)
    whole = scanned.select("row", "spans", F.col("row").getField(text_col).alias("text"))
    found = whole.filter(F.size("spans") > 0)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                redact(text.as_py(), spans.as_py())
                for text, spans in zip(batch.column("text"), batch.column("spans"))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    kind = found.schema["row"].dataType.simpleString()
    redacted = found.mapInArrow(replace, f"row {kind}, text string")
    changed = {text_col: F.col("text")}
    if length_col:
        changed[length_col] = F.length("text").cast(docs.schema[length_col].dataType)
    rows = {c: F.col("row").getField(c) for c in docs.columns}
    return redacted.select(*[changed.get(c, row).alias(c) for c, row in rows.items()]).unionByName(
        whole.filter(F.size("spans") == 0).select(*[row.alias(c) for c, row in rows.items()])
    )
