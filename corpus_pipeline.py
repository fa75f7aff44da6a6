"""A corpus for training, in stages: each takes all documents the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventwarden.llm import toxicity
from eventwarden.llm.byte_bpe import round_trip
from eventwarden.llm.decontaminate import contaminated
from eventwarden.llm.near_dedup import near_duplicates
from eventwarden.llm.repeats import remove_repeats
from eventwarden.llm.scratch import Scratch

#: Score from which a document is rejected as toxic.
TOXIC = 0.5
#: Similarity of near duplicates, and of items to documents, over shingles of five words.
SIMILAR = 0.8
#: Words from which a passage that repeats is removed.
PASSAGE = 50
#: Rows a task holds at a time: workers live on from stage to stage, and documents can be long. Stages write what
#: tasks over texts give them themselves, as Spark takes the size of a batch from the session that writes; the first does
#: not, as its copy of nearly all texts would lie on disk through all others.
BATCH_ROWS = 2000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below TOXIC. Rows with a null id are scored too.

    The lexicon is learned from the labelled rows among the documents; without labels nothing is toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learn(docs, labels, Scratch(spark, "toxicity", BATCH_ROWS))
    clean = toxicity.clean(docs, lexicon, TOXIC)
    clean._unwritten = True
    return clean


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; null ids stay."""
    scratch = Scratch(spark, "near", BATCH_ROWS)
    # Handed on as it is, the first stage would run again for every read of its documents.
    docs = scratch.cut(docs, "clean") if hasattr(docs, "_unwritten") else docs
    judged = near_duplicates(docs.select("doc_id", "text"), scratch, threshold=SIMILAR)
    gone = judged.where("not kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    # Equal rows under one id are one node; one of them stays.
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id is null"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of PASSAGE words that a smaller id has; n_chars follows the text.

    A document that loses all its words goes. Untouched texts stay as they are; null ids stay whole. Columns beyond
    doc_id and text may have any names and pass unchanged but for n_chars, which need not be there.
    """
    named = [F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"of_{c}") for c in docs.columns]
    scratch = Scratch(spark, "repeats", BATCH_ROWS)
    cut = remove_repeats(docs.select(*named), scratch, wanted=PASSAGE)
    touched = F.col("n_removed") > 0
    left = cut.where(~touched | (F.col("n_removed") < F.col("n_words")))
    kept = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept["n_chars"] = F.when(touched, F.length("kept_text").cast(kind)).otherwise(F.col("of_n_chars"))
    return scratch.cut(left.select(*[kept.get(c, F.col(f"`of_{c}`")).alias(c) for c in docs.columns]), "left")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: none whose shingles they have to SIMILAR or more.

    Rows with a null id, and null, empty or very short texts, hold none. Rows that share an id go together.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    scratch = Scratch(spark, "items", BATCH_ROWS)
    found = contaminated(docs, items, scratch, threshold=SIMILAR)
    gone = scratch.cut(found.select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids) of every row; null and empty texts have no ids."""
    scratch = Scratch(spark, "bpe", BATCH_ROWS)
    return scratch.cut(round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Learned scores and sketches are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again before the next.

    Rows with a null id or a null text pass all stages; repeated rows of one id and text become one in the second.
    An empty table gives an empty result.
    """
    scratch = Scratch(spark, "pipeline", BATCH_ROWS)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if hasattr(docs, "_written_to") else scratch.cut(docs, name)
    return docs
