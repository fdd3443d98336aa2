"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before it has kept; all but the last return the columns of ``documents``.

1. toxicity: documents that the classifier chain rejects go;
2. near_duplicates: of each group linked by 5-word shingle Jaccard similarity of
   0.8 or more the document with the smallest doc_id stays (of rows that share
   an id, or have none, one of each group too, and unlike texts all stay);
3. repeated_passages: windows of 51 words, and of 400 bytes, that start anywhere
   else go from the texts (a document that consists of such windows stays, with
   what is left);
4. secrets: reported spans are masked in the texts;
5. packing: the texts become pieces in sequences of 4096 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statweave.llm import jaccard, packing, secrets, suffix, toxicity
from statweave.llm.common import Stored, packed, release, stored, table, tables
from statweave.llm.registry import vocabulary

#: Greatest number of ids that are broadcast to drop their documents: 4 MB; beyond it documents are joined.
BROADCAST_IDS = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the chain's probability of rejection, by models trained on ``labels``.

    Null and empty texts are scored as texts without features; repeated rows share
    their score and stay or go together; without labels nothing is rejected; other
    columns, also such as are named like probabilities, stay as they are.
    """
    models = toxicity.train(docs, table(spark, sf_dir, "labels"))
    prefix = "p_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return toxicity.score(docs, models, prefix).where(F.col(f"{prefix}toxic") < models.reject).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least doc_id.

    Texts without words are near to none and stay; where doc_ids repeat or are null,
    rows are told apart by number (see ``_drop_near_duplicates_by_row``); an empty
    table stays empty; other columns stay as they are.
    """
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").isEmpty():
        return _drop_near_duplicates_by_row(docs)
    found = stored(jaccard.linked(docs.select("doc_id", "text")).select("doc_id", "component_id"))
    extra = found.where("doc_id <> component_id").select("doc_id").distinct()
    few = extra.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(extra) if few else extra, "doc_id", "left_anti").select(*docs.columns)


def _drop_near_duplicates_by_row(docs: DataFrame) -> DataFrame:
    """Where doc_id is no key: rows are numbered and linked by number; of each group the row with the least doc_id stays (null last), and rows without words stay once for each doc_id."""
    rows = stored(packed(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text")).withColumn("key", F.monotonically_increasing_id()))
    found = stored(jaccard.linked(rows.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "n_shingles", "component_id"))
    named = found.join(rows.select("key", "doc_id"), "key")
    group = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    least = named.groupBy(group.alias("group"), F.when(group.isNull(), F.col("doc_id")).alias("bare")).agg(F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "key")).alias("one"))
    kept = rows.join(least.select("one.key"), "key", "left_semi")
    return kept.select(*[F.col("row").getField(f.name).alias(f.name, metadata=f.metadata) for f in docs.schema.fields])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 400 bytes and of 51 words that start anywhere else too.

    Every row stays, if only with an empty text; null and short texts lose nothing;
    equal texts lose all their windows alike; n_chars is set anew, other columns stay.
    """
    return suffix.dedup(docs, size=400, words=51)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with all reported secrets masked, character by character; null texts are empty, all rows and other columns stay."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens.

    A null or empty text is the end id alone; repeated rows are packed as often as
    they occur; an empty table gives no pieces; other columns are left out.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), size=4096, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), tables()
    for _, stage in STAGES[:-1]:
        now = Stored(stage(spark, docs, sf_dir))
        docs = now.df
        release(before | {now.path})  # what the stage has read, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
