"""The corpus pipeline: toxicity, exact dedup, n-gram join, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of ``documents``; the last returns
one row of token digests per row of the mixture. Between stages the rows are
written as Parquet to the shared folder and read again.

Defined results. A null text is an empty one: it scores as a text without words,
equals other empty texts, links with nothing, counts no words in the mixture and
has no tokens. Rows without an id are judged by their text alone; they stay in
the n-gram join. Rows equal in id and text are one after exact dedup. A null source
is a source of its own. Empty tables go through all stages. Other columns travel along
unchanged; names that begin with two underscores are taken for helpers.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, exact_dedup, idmap, mixing, ngram_join, toxicity
from quillspark.session import materialise, table

#: The mixture: every source at least once, none more than this many times.
MIXTURE = mixing.Target(entropy=0.98, repeats=1.5, budget=None)
TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model, TOXIC_FROM)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; of rows equal in id and text one.

    Rows without an id are kept only if no other row has their text.
    """
    decided = materialise(exact_dedup.dedup(docs, exact_dedup.halves(docs)), "decided")
    # The id and the whole digest: rows are dropped by what they are, not by a hash of it.
    key = lambda i, sha: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("-")), sha)
    out = idmap.without(docs, key(F.col("doc_id").cast("long"), F.sha2(exact_dedup.normalised(F.col("text")), 256)), decided.filter("NOT kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("key")))
    again = decided.groupBy("doc_id", "text_sha256").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return out
    # Only rows whose id comes twice can be repeated.
    words = spark.sparkContext.broadcast(idmap.id_map(again, "doc_id"))
    own = F.col("doc_id").cast("long")
    repeated = idmap.where_marked(out, own, words).withColumn("__own", exact_dedup.normalised(F.col("text"))).dropDuplicates(["doc_id", "__own"]).select(*docs.columns)
    return idmap.where_marked(out, own, words, False).unionByName(repeated)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one with the smallest id; rows without an id stay."""
    found = ngram_join.join_documents(docs, ngram_join.Join(size=5, num=80, den=100))
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return idmap.without(docs, F.col("doc_id").cast("long"), materialise(gone, "near-copies"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the tempered weights ask; every document at least once."""
    return mixing.mix(docs, MIXTURE).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row of the mixture."""
    codec = bpe.load_codec(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip(docs, codec)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: The classifier, the near-copy join and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
