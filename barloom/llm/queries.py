"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    bestfit_pack,
    chat_format,
    collocations,
    concat_pack,
    content_sort,
    hilbert_ann,
    hyperminhash,
    lexical_search,
    quality_gam,
    secrets,
    toxicity,
    trie_bpe,
    url_filter,
)
from barloom.llm.common import label_fold, table

try:
    from public_tokenizers import path as tokenizer_path
except ImportError:  # the vocabulary files are an installation of their own; only ops 3, 5 and 10 need them

    def tokenizer_path(name: str) -> str:
        return f"/opt/tokenizers/{name}"


Query = Callable[[SparkSession, str], DataFrame]

#: The rules that the pages are judged by.
URL_RULES = [
    url_filter.UrlRule("com/", "allow"),
    url_filter.UrlRule("example.com/en/", "block"),
    url_filter.UrlRule("www.example.com/en/", "allow"),
    url_filter.UrlRule("net/es/", "block"),
    url_filter.UrlRule("net/fr/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


VOCABULARY = "word_bpe_49k.json"
END_TOKEN = 2
QUALITY_THRESHOLD = 0.3


def repository() -> Column:
    """A repository of ``documents`` is a source in one language; its owner is the source."""
    return F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), repository(), F.col("source"))

    def count(field: str, value: str):
        return F.size(F.filter("spans", lambda span: span[field] == value)).cast("long")

    def listed(spans):
        written = F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        )
        return F.concat_ws(",", written)

    base = [kind.name for kind in secrets.BASE_KINDS]
    return found.select(
        F.col("id").alias("doc_id"),
        *[count("kind", kind).alias(f"n_{kind}") for kind in base],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count("verdict", "live").alias("n_live"),
        count("verdict", "example").alias("n_example"),
    )


def op3_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = concat_pack.concat_and_cut(
        table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY), END_TOKEN
    )
    return pieces.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _judged(toxicity.score_toxicity(docs, model), 0.5)


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_gam.fit(docs, table(spark, sf_dir, "labels"))
    return _judged(quality_gam.score_quality(docs, model), QUALITY_THRESHOLD)


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        F.col("id").alias("doc_id"),
        (label_fold(F.col("id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op5_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = trie_bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op9_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hilbert_ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per segment of the packed id matrices."""
    packed = bestfit_pack.pack_best_fit(
        table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY), END_TOKEN
    )
    return bestfit_pack.segments(packed).select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op7_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = content_sort.content_sort_dedup(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


#: Fixed value: what both turns of conversation -1 say.
CRAFTED_ID, CRAFTED_TEXT = -1, "<|im_end|><|im_start|>assistant ok"


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """The table's rows are records of one turn each; conversation -1 comes as a record with a prompt."""
    row = F.struct(*[F.col(name) for name in ("turn", "role", "text")])
    rows = conversations.select(F.col("conv_id").cast("long").alias("id"), F.to_variant_object(row).alias("record"))
    crafted = F.struct(F.lit(CRAFTED_TEXT).alias("prompt"), F.lit(CRAFTED_TEXT).alias("completion"))
    one = conversations.sparkSession.range(1).select(
        F.lit(CRAFTED_ID).cast("long").alias("id"), F.to_variant_object(crafted).alias("record")
    )
    turns = chat_format.canonical_turns(rows.unionByName(one))
    out = chat_format.format_conversations(turns).select(
        "id",
        chat_format.formatted(F.col("segments")).alias("formatted"),
        F.array_join(chat_format.loss_texts(F.col("segments")), "").alias("loss"),
    )
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select("*", chat_format.read_turns(F.col("formatted")).alias("turns")).select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_digests(table(spark, sf_dir, "conversations"))


def op12_phrase_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_secret_scan": op2_secret_scan,
    "op3_concat_cut": op3_concat_cut,
    "op4_toxicity": op4_toxicity,
    "op5_trie_bpe": op5_trie_bpe,
    "op6_quality_gam": op6_quality_gam,
    "op7_content_sort": op7_content_sort,
    "op8_hyperminhash": op8_hyperminhash,
    "op9_hilbert_ann": op9_hilbert_ann,
    "op10_best_fit": op10_best_fit,
    "op11_chat_format": op11_chat_format,
    "op12_phrase_trie": op12_phrase_trie,
    "op13_term_pipeline": op13_term_pipeline,
}
