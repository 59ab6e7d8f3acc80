"""The corpus pipeline: a table of documents through five of the training-data operators, each stage stored before the next.

Every stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, and returns a DataFrame; all
but the last return the columns of documents. The stages work on whole texts and on all rows.

Cases: an empty table passes through all stages; a null or empty text is judged like any other by the classifier, and after it
is linked with nothing, loses nothing, hits nothing and has no pieces. Rows without an id stay. Rows that share an id: the
near-copy stage keeps one of those with the same text, the decontamination stage drops all rows of an id that is hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import decontaminate, jaccard, pieces, quality, suffixes
from quarrymill.llm.blocks import files_for, fresh_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
FILE_CHARS = 32 << 20  # a file of a stage has texts of about so many characters, or less


def _documents(frame: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the length of the text at hand."""
    return frame.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def _in_files(frame: DataFrame, docs: DataFrame) -> DataFrame:
    """frame, made from docs, in as many partitions as its texts want: an executor pays for every file of a stage."""
    size = docs.agg(F.sum(F.abs(F.col("n_chars").cast("long")))).first()[0] or 0
    return frame.coalesce(files_for(docs.sparkSession, -(-size // FILE_CHARS)))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents with a score under the threshold go."""
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _in_files(quality.score(docs, model).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the one with the least id stays."""
    docs = docs.select(*COLUMNS)
    return _in_files(jaccard.keep_one(docs), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: bytes of passages that start earlier in the corpus go; a document of which nothing is left goes."""
    docs = docs.select(*COLUMNS)
    kept = suffixes.keep_rest(docs)
    # A text that was empty before stays; one that has been emptied goes.
    return _in_files(_documents(kept.where(F.col("text").isNull() | (F.col("text") != "") | (F.coalesce(F.col("n_chars"), F.lit(0)) == 0))), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a window of a benchmark item go."""
    docs = docs.select(*COLUMNS)
    hit = decontaminate.report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select(F.col("doc_id").alias("_hit")).distinct()
    return _in_files(docs.join(hit, docs["doc_id"].eqNullSafe(hit["_hit"]), "left_anti").select(*COLUMNS), docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding, decoded again as a proof: doc_id, counts, digests, round_trip and the ids."""
    return _in_files(pieces.round_trip(docs, with_ids=True), docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", tokenise),
]

ORACLE_SQL = None  # a conditional random field, a sorted suffix array and a segmentation; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and reread as the next one's input."""
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, frame, sf_dir).write.parquet(path)
        frame = spark.read.parquet(path)
    return frame
