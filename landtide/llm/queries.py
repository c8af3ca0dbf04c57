"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landtide.llm import capfilters, crf_secrets, fm_dedup, gru_lm, langid, mixing, oracles, packing, pieces, repetition, simhash, url_filter, whitening, yinyang


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the URL query: verdict, and host with the start of a path.
URL_RULES = (
    url_filter.Rule("block", "com/en/"),
    url_filter.Rule("allow", "example.com/en/7"),
    url_filter.Rule("allow", "net/de/"),
    url_filter.Rule("block", "example.net/de/8"),
    url_filter.Rule("block", "org/es/"),
)


def op1_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; a null URL has neither host nor path and is allowed."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document; a group of rows without ids has no name."""
    rows = simhash.groups(_table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public tokenizer files are installed; imported here as other operators do without."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document; a null text is empty."""
    return pieces.encode(_table(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


def op4_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those not held out; ``und`` for texts without letters."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihoods of every document under unigrams and the recurrent model; a null text is its end alone."""
    return gru_lm.score_all(_table(spark, sf_dir, "documents"))


def op6_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages that start anywhere else as well."""
    return fm_dedup.removed(_table(spark, sf_dir, "documents"))


def op7_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by patterns and by the field; a null text has none."""
    rows = crf_secrets.find(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_crf")


def op8_target_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes; null is a source of its own, the last one."""
    rows = mixing.plan(_table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every vector; vectors that are null, zero or not finite have no links."""
    rows = capfilters.groups(_table(spark, sf_dir, "embeddings"))
    return rows.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition of every document and whether it is kept; a null text fails."""
    rows = repetition.measure(_table(spark, sf_dir, "documents"))
    return rows.withColumn("base_failed", repetition.base_failed()).withColumn("kept", ~F.col("base_failed") & repetition.verdict()).drop("covered_words", "longest_repeat")


def op11_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes; a null text is its end alone."""
    rows = packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))
    return rows.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def op12_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every vector of 64 finite components, with figures of its cluster."""
    return yinyang.summary(*yinyang.cluster(_table(spark, sf_dir, "embeddings")))


def op13_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of every finite vector; a deviation beyond 64 bits is null."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``corpus_pipeline.run``."""
    import corpus_pipeline  # it takes its tokenizer's place from here

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_markov": op1_url_markov,
    "op2_simhash_groups": op2_simhash_groups,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_cross_parsing": op4_cross_parsing,
    "op5_gru_scores": op5_gru_scores,
    "op6_fm_substrings": op6_fm_substrings,
    "op7_crf_secrets": op7_crf_secrets,
    "op8_target_mix": op8_target_mix,
    "op9_cap_filters": op9_cap_filters,
    "op10_suffix_repetition": op10_suffix_repetition,
    "op11_sum_of_squares_packing": op11_sum_of_squares_packing,
    "op12_yinyang_clusters": op12_yinyang_clusters,
    "op13_svd_whitening": op13_svd_whitening,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op6_fm_substrings": oracles.passages(fm_dedup.WINDOW),
    "op8_target_mix": oracles.mix(mixing.WEIGHTS, mixing.MOST),
    "op9_cap_filters": oracles.near_vectors(capfilters.COSINE),
    "op10_suffix_repetition": oracles.repetition(repetition.MIN_WORDS, repetition.MAX_COVERED, repetition.MAX_REPEAT),
    "op12_yinyang_clusters": oracles.clusters(yinyang.DIM, yinyang.SCALE, yinyang.CENTRES, yinyang.ROUNDS, 2),
}
