"""The dealt operators as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventwarden.llm import quality, toxicity
from eventwarden.llm.byte_bpe import round_trip
from eventwarden.llm.cap_links import near_vectors
from eventwarden.llm.chat import digests, format_chats
from eventwarden.llm.decontaminate import contaminated
from eventwarden.llm.filter_audit import audit
from eventwarden.llm.near_dedup import near_duplicates
from eventwarden.llm.repeats import remove_repeats
from eventwarden.llm.runs import find_runs
from eventwarden.llm.samples import class_counts, fold
from eventwarden.llm.scratch import Scratch
from eventwarden.llm.token_files import write_tokens
from eventwarden.llm.url_rules import judge
from eventwarden.llm.warc import read_warc, write_warc

#: The listed rules: host, path, verdict.
URL_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _judged(scored: DataFrame, folds: int, held_out: int, *more: str) -> DataFrame:
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"), *more)


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    lexicon = toxicity.learn(docs, labels, Scratch(spark, "op1"), folds=4, held_out=2)
    return _judged(toxicity.score(docs, lexicon), 4, 2)


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    store = write_tokens(_table(spark, folder, "documents"), Scratch(spark, "op2"), _tokenizer("word_bpe_49k.json"),
                         end_id=2, vocabulary=49408)
    return store.documents()


def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    values = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")
    return judge(_table(spark, folder, "pages"), rules, Scratch(spark, "op3"))


def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), Scratch(spark, "op4"))


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "op5")
    place, files = write_warc(_table(spark, folder, "pages"), scratch)
    return read_warc(place, files, scratch)


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    scratch = Scratch(spark, "op6")
    ranking = quality.learn(docs, labels, scratch, folds=5, held_out=0)
    scored = scratch.cut(quality.score(docs, ranking), "scored")
    # As large a share of all documents is kept as of the labelled ones is good.
    zeros, ones = class_counts(labels, "quality", 5, 0)
    kept = quality.best(scored, ones / (zeros + ones) if zeros + ones else 1.0)
    return _judged(kept, 5, 0, "kept")


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return remove_repeats(docs, Scratch(spark, "op7"), levels=True).select(
        "doc_id", "n_words", "n_removed", "kept_sha256", "longest_level")


def op8_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"), Scratch(spark, "op8"), threshold=0.85)


def op9_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(_table(spark, folder, "documents"), _tokenizer("byte_bpe_50k.json"))


def op10_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"), Scratch(spark, "op10"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in all documents, a tenth of which are first made to repeat themselves."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = docs.withColumn("h", h).withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    placed = chosen.withColumns({
        "a": F.expr("if(n > 0, cast(h div 10 % n AS int), null)"),
        "p": F.expr("if(n > 0, cast(1 + (n - h div 10 % n) div (3 + h div 10 % 8) AS int), null)")})
    repeated = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[a + (i - a) % p])), ' ')")
    found = find_runs(placed.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.col3")).alias("period"),
        F.expr("1000 * best.length div -best.col3").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one of control strings as training text, written, and digests of what reads back."""
    marks = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{marks}'), (-1L, 1L, 'assistant', '{marks}') "
                        "AS rows(conv_id, turn, role, text)")
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return digests(Scratch(spark, "op12").cut(format_chats(turns), "formatted"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters keep, remove and repeat in all their orders, per language."""
    return audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: job for name, job in globals().items() if name.startswith("op") and name[2].isdigit()}
    return own


def llm_oracles() -> dict[str, str]:
    from eventwarden.llm.oracle import ORACLES

    return dict(ORACLES)
