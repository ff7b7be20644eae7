"""Corpus pipeline: language, near duplicates, benchmark passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
one's docs; all but the last return the columns of documents. run(spark, sf_dir) applies them to documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectorium.llm._io import saved, scratch, table
from lectorium.llm._text import tokens
from lectorium.llm.decontamination import scan
from lectorium.llm.jaccard_join import jaccard_components
from lectorium.llm.language_id import UND, identify, train
from lectorium.llm.mixing import mix
from lectorium.llm.tokens import default_tokenizer, read_tokens, write_tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _key: the doc_id, or where that is null a number of the row's own beyond all doc_ids."""
    most = docs.agg(F.max("doc_id")).first()[0]
    own = F.lit(0 if most is None else max(0, most + 1)) + F.monotonically_increasing_id()
    rest = saved(docs.filter(F.col("doc_id").isNull()).withColumn("_key", own), "unnumbered")
    return docs.filter(F.col("doc_id").isNotNull()).withColumn("_key", F.col("doc_id").cast("long")).unionByName(rest)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language go: those without text or letters, and all where no row has a label."""
    docs = docs.select(*COLUMNS)
    model = train(docs.select("doc_id", "text", "lang"))
    named = identify(docs.select(*COLUMNS, F.col("text").alias("_text")), model, text="_text")
    return named.filter(F.col("lang_pred") != UND).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles the
    one of smallest doc_id stays; of rows that repeat it, one. Every row of null doc_id is a document of its
    own, and stays only for a group without any doc_id."""
    docs = _keyed(docs.select(*COLUMNS))
    groups = jaccard_components(docs.select(F.col("_key").alias("doc_id"), "text"), n=5, percent=80)
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_key")).distinct()
    return docs.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go."""
    docs = _keyed(docs.select(*COLUMNS))
    found = scan(docs.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    hit = found.filter(F.size("hits") > 0).select(F.col("doc_id").alias("_key")).distinct()
    return docs.join(hit, "_key", "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document stands as often as the mix takes it, to the nearest
    whole turn; documents without words stay out, as no weight can take them."""
    docs = _keyed(docs.select(*COLUMNS))
    sized = docs.select("doc_id", "source", tokens(F.col("text")).alias("size"), "_key")
    taken = mix(sized, ["_key"]).filter(F.col("size") > 0).select("_key", F.round(F.col("taken") / F.col("size")).cast("int").alias("times"))
    taken = taken.filter("times > 0").groupBy("_key").agg(F.max("times").alias("times"))
    return docs.join(taken, "_key").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as shards of token ids, read back by key: doc_id, start, n_tokens, ids_crc32."""
    manifest = write_tokens(docs.select("doc_id", "text"), scratch(spark, "pipeline-tokens"), default_tokenizer(), end_id=2)
    return read_tokens(docs.select("doc_id"), manifest)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_ids),
]

#: SQL can't express language ID and the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for n, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"stage-{n}")
    return docs
