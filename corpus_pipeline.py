"""Training-data pipeline over ``documents``: quality rules, near duplicates, repeated passages, packing.

Every stage works on all documents its predecessor kept; each result is written as Parquet in
the shared folder and read again.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import marked_possible, stored, table
from tidepanel.llm.packing import packed
from tidepanel.llm.quality import quality_verdicts
from tidepanel.llm.similar import similar_documents
from tidepanel.llm.substring import without_repeats


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed by place, and the new name of each: no other name can clash."""
    names = {name: f"c{k}" for k, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not condemned.

    Ids identify documents: of rows that repeat an id all go if one fails, and null ids are one id.  Null and
    empty texts have no words and go; long texts are measured whole; an empty table stays empty.  A null
    source is a host of its own.
    """
    frame, names = _plain(docs)
    verdicts = quality_verdicts(frame, names["doc_id"], names["text"], names["source"])
    failed = stored(verdicts.where(~F.col("kept")).select("doc_id").distinct(), "failed")
    return frame.join(failed, F.col(names["doc_id"]).eqNullSafe(F.col("doc_id")), "left_anti").toDF(*names)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of documents that share 0.8 or more of their five-word shingles the one with the smallest doc_id.

    Candidates come from the trie self-join of SimHash fingerprints, every link is checked on the shingles
    themselves.  Of rows that repeat an id one stays.  A row without an id stays only if no document with one is
    in its class; of such classes one row stays.  Null and empty texts are one class, long texts are compared
    whole, an empty table stays empty.
    """
    frame, names = _plain(docs)
    id = names["doc_id"]
    classes = stored(similar_documents(frame, id, names["text"]).select("doc_id", "component_id"), "classes")
    first = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("doc_id").agg(F.count("*").alias("rows"))
    # Documents whose id is surely the first of one class are not moved.
    times = F.count(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), 1))
    doubtful = classes.groupBy("doc_id").agg(times.alias("rows")).where("rows <> 1").select(F.xxhash64("doc_id"))
    marked = marked_possible(frame.withColumn("hash", F.xxhash64(id)), "hash", doubtful)
    kept = marked.where("possible").join(first, F.col(id).eqNullSafe(F.col("doc_id"))).drop("doc_id")
    kept = kept.unionByName(marked.where("NOT possible").withColumn("rows", F.lit(1).cast("bigint")))
    if not first.where("rows > 1").limit(1).count():
        return kept.select(*names.values()).toDF(*names)
    # Only rows that share an id are compared with each other.
    kept = kept.drop("hash", "possible")
    alone = kept.where("rows = 1").drop("rows")
    shared = kept.where("rows > 1").drop("rows")
    numbered = shared.where(F.col(id).isNotNull()).dropDuplicates([id])
    nameless = shared.where(F.col(id).isNull()).dropDuplicates([names["text"]])
    return alone.unionByName(numbered).unionByName(nameless).toDF(*names)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines and passages that an earlier document has; documents left without a word go.

    Documents nothing was cut from stay as they are, null and empty texts too.  n_chars follows the text where
    there is such a column.  Long texts are cut like any other; an empty table stays empty.
    """
    frame, names = _plain(docs)
    text = names["text"]
    trimmed = without_repeats(frame, names["doc_id"], text)
    touched = F.size("removed_spans") > 0
    kept = trimmed.where(~touched | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in names:
        count = names["n_chars"]
        size = F.char_length(text).cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn(count, F.when(touched, size).otherwise(F.col(count)))
    return kept.select(*names.values()).toDF(*names)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    Null and empty texts are one end id long.  Null and repeated ids are documents of their own; an empty
    table gives no pieces.
    """
    return packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

# Fingerprints and token ids have no SQL form; tests/llm/test_pipeline.py compares the stages with
# plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last one."""
    documents = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        documents = stored(stage(spark, documents, sf_dir), name)
    return documents
