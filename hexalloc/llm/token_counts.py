"""Token counts through a digest cache.

Content and tokenizer version are both named by SHA-256.  A count is looked up by the
pair; only one row of each unseen content is encoded, by the tokenizer's own library,
and what was encoded is appended to the cache table.  Normalisation must not change a
count, so it only turns a null text into the empty one.

Several writers may append to one cache: a digest that two of them stored is read once.

Edge cases: null text counts as empty (0 tokens); rows with equal text share one entry,
rows that repeat an id are answered one by one; a null id is kept; an empty table gives
an empty result and appends nothing; other columns are never read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CACHE_SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokenizer", T.StringType())])


def tokenizer_digest(model: bytes) -> str:
    return hashlib.sha256(model).hexdigest()


def counter(model: bytes, kind: str):
    """A function from a list of texts to their counts, for one tokenizer file."""
    if kind == "sentencepiece":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)] if texts else []
    if kind == "tokenizers":
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(model.decode())
        tok.no_truncation()
        tok.no_padding()
        return lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
    raise ValueError(f"unknown tokenizer library {kind!r}")


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version; none where the table isn't there yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CACHE_SCHEMA)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer") == tokenizer)
    # Writers at the same time may store a digest twice; then one of its rows is taken, from a table
    # of its own, so that the cache is a plain side of later joins either way.
    if stored.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return stored
    once = stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).withColumn("tokenizer", F.lit(tokenizer))
    return common.materialise(once, "cache_once")


def count_tokens(docs: DataFrame, model_path: str, cache_path: str, kind: str = "sentencepiece", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, n_bytes, n_tokens`` for every row; fills the cache at ``cache_path``."""
    spark = docs.sparkSession
    common.ship(spark)
    with open(model_path, "rb") as f:
        model = f.read()
    version, held = tokenizer_digest(model), spark.sparkContext.broadcast(model)

    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    # Ids and digests once, without texts: the two joins on digests read these few bytes a row.
    keyed = common.materialise(docs.select(F.col(id_col).alias("id"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")), "token_keys")
    stored = read_cache(spark, cache_path, version)
    # One row of each unseen content; min() has partial sums, so a hot content is one row a task.
    misses = keyed.groupBy("digest").agg(F.min("id").alias("id")).join(stored, "digest", "left_anti")

    # Only here texts move, dealt by content and id, the latter so that copies spread.
    texts = docs.select(F.col(id_col).alias("id"), digest.alias("digest"), text.alias("text"))
    m = misses.select(F.col("id").alias("m_id"), F.col("digest").alias("m_digest")).hint("shuffle_hash")
    wanted = texts.join(m, (F.col("digest") == F.col("m_digest")) & F.col("id").eqNullSafe(F.col("m_id")), "left_semi").select("digest", "text")

    def encode(batches):
        count = counter(held.value, kind)
        for whole in batches:
            for b in common.chunks(whole, "text"):
                n = count(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    new = wanted.mapInArrow(common.tidied(encode), T.StructType(CACHE_SCHEMA.fields[:2])).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    new.select("digest", "n_tokens", F.lit(version).alias("tokenizer")).write.mode("append").partitionBy("tokenizer").parquet(cache_path)

    # The cache is read with each digest once, so both sides of the join are plain exchanges and a
    # hot content can be split.
    return keyed.join(read_cache(spark, cache_path, version), "digest", "left").select(F.col("id").alias(id_col), "digest", "n_bytes", "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query; it starts with an empty cache, so every content is encoded."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    got = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), common.scratch(spark, "token_cache"))
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
