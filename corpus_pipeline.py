"""From raw documents to shuffled shards: every stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dugout.llm import containment, language, mixing, sharding, simhash
from dugout.llm.common import boxed, col, table, word_count
from dugout.sources.scratch import materialize
from dugout.sources.shipping import ship

#: Least share of a text's grams that its language must explain.
MIN_LANGUAGE_SCORE = 0.2
#: Rows that a Python worker and the queue beside it hold at once; texts may be long, and all stages share a session.
BATCH_ROWS = 1000


def _prepare(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _unpacked(rows: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *more)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts that no learned language explains; keeps those too short to tell."""
    _prepare(spark)
    model = language.fit(docs)
    rows = docs.select(
        boxed(docs).alias("row"), language.identify(docs, model).alias("found"), language.too_short(col("text")).alias("too_short")
    )
    known = (F.col("found.score") >= MIN_LANGUAGE_SCORE) | F.col("too_short")
    return _unpacked(rows.filter((F.col("found.lang") != language.UNKNOWN) & known), docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each SimHash component: three-word shingles, at most three differing bits."""
    _prepare(spark)
    return simhash.drop_near_duplicates(docs, shingle=3, distance=3)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item: 0.8 or more of its five-word shingles."""
    _prepare(spark)
    return containment.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that each source comes near its target number of words."""
    mixed = mixing.systematic_mix(docs, word_count(col("text")))
    copies = mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return _unpacked(copies, docs)


def deal_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with shard and slot."""
    _prepare(spark)
    plain = docs.select(*[c for c in docs.columns if c.lower() not in ("shard", "slot")])
    return _unpacked(sharding.shuffle_into_shards(plain, 40), plain, "shard", "slot")


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", deal_into_shards),
]

#: Hashing, Bloom filters and random deals have no SQL form; tests/llm holds the pipeline against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
