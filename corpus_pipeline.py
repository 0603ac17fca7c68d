"""The corpus pipeline: language, near copies, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.llm import bpe, jaccard, langid, mixing, secret_scan
from riverbed.llm.common import discard, fold, materialize, scratch, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (null, no letter, or far from every centroid) go; the others carry the language found.

    Without any known language nothing is learned and everything goes. Repeated rows stay; an empty table stays empty; of equally near
    languages the first in the alphabet is taken.
    """
    docs = docs.select(*COLUMNS)
    with small_batches(spark):  # they hold for what runs inside, so the result is written here
        model = langid.fit(docs.where(fold("doc_id", 3) != 1))
        found = langid.predict(docs, model, COLUMNS).where(~F.col("rejected"))
        return materialize(found.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars"), "language")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document of smallest id stays (of several texts under that id, the one of smallest hash).

    Equal rows count once. Rows without an id, and texts without a word, are no copies and stay. An empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    with scratch() as keep:
        found = jaccard.jaccard_links(docs).where("n_shingles > 0 and doc_id is not null")
        first = found.groupBy("component_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
        rows = found.groupBy("component_key", "doc_id", "text_hash").count().join(first, "component_key")
        stays = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash"))
        judged = keep(materialize(rows.select("doc_id", "text_hash", "count", stays.alias("stays")).where("not stays or count > 1"), "judged"))
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    kept = hashed.join(judged.where("not stays").select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_anti")
    again = judged.where("stays").select("doc_id", "text_hash")
    if not again.isEmpty():
        once = kept.join(again, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
        kept = kept.join(again, ["doc_id", "text_hash"], "left_anti").unionByName(once)
    return kept.select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, null and empty texts and repeated rows as they are."""
    return secret_scan.redact(docs.select(*COLUMNS), secret_scan.train(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is repeated as often as its rate asks for, so that the sources' expected tokens take shares in proportion to tokens ** 0.7.

    No row goes, as the source in the largest excess keeps its rows once; repeated rows are repeated alike; without any source every row
    comes once.
    """
    mixed = mixing.mix(docs.select(*COLUMNS), "source", mixing.Params(temper=0.7), keep=COLUMNS)
    times = F.greatest(F.col("copies"), F.lit(1))
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), times)).alias("copy")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them; a null text counts as empty."""
    with small_batches(spark):  # they hold for what runs inside, so the result is written here
        return materialize(bpe.encode_documents(docs, keep=("doc_id", "lang", "source"), ids=True, digests=True), "tokens")


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_copies), ("secret scans", secrets), ("mixing sources to target weights", mixture), ("BPE encoding and decoding", tokens)]

#: SQL can express neither the trained models nor the encoder; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again; a stage's input goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        kept = made if hasattr(made, "_written_to") else materialize(made, f"stage-{k}")
        if k:
            discard(docs)
        docs = kept
    return docs
