"""URL verdicts from listed (host, path) rules: blocked Bloom filter first, exact join after.

A url is cut into its canonical (host, path). Every host suffix at a dot, with every path prefix of a
listed length, is a key that may be listed. Keys probe a blocked Bloom filter: each key has all its bits in
one block of 512, so a probe reads one row. Keys that pass are joined exactly with the list, which removes
false positives. Only DataFrame functions are used.

Keys are made once per distinct (host, path), so a url or host that fills a third of the table costs little.
Filter and list are broadcast while their row count is small; beyond, the same joins are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden.llm.scratch import Scratch

#: Bits of a block, as words of 64; bits set per key; bits of filter per listed key.
BLOCK_WORDS = 8
BITS_PER_KEY = 6
BITS_PER_ENTRY = 16
#: Rows up to which filter blocks and list are broadcast: about 8 MB of blocks.
BROADCAST_ROWS = 100_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _masks(key: Column) -> list[Column]:
    """The bits of a key in each word of its block."""
    words: list[Column] = [F.lit(0).cast("bigint")] * BLOCK_WORDS
    for k in range(BITS_PER_KEY):
        place = F.pmod(F.xxhash64(key, F.lit(k + 1)), F.lit(64 * BLOCK_WORDS)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place % 64)
        words = [w.bitwiseOR(F.when(place.cast("int") >= 64 * i, F.when(place < 64 * (i + 1), bit)
                                    .otherwise(0)).otherwise(0)) for i, w in enumerate(words)]
    return words


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks))


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of a column ``key``: one row per block that has bits."""
    marked = keys.select(_block(F.col("key"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_WORDS)])


def passed(keys: DataFrame, bloom: DataFrame, blocks: int, small: bool) -> DataFrame:
    """Rows of ``keys`` whose column ``key`` has all its bits in the filter."""
    probe = keys.withColumn("block", _block(F.col("key"), blocks))
    for i, mask in enumerate(_masks(F.col("key"))):
        probe = probe.withColumn(f"m{i}", mask)
    joined = probe.join(F.broadcast(bloom) if small else bloom, "block")
    for i in range(BLOCK_WORDS):
        joined = joined.where(F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    return joined.select(*keys.columns)


def judge(pages: DataFrame, rules: DataFrame, scratch: Scratch, id: str = "page_id", url: str = "url",
          other: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict), one row per row of ``pages``.

    ``rules`` has (host, path, verdict). A rule fits its host and all subdomains if the path starts with its
    own; the longest host and path together wins, then the longer host, then block before allow. Urls that
    fit no rule get ``other`` and a null rule; null urls and urls without ``://`` have empty host and path.
    An empty rule table fits nothing. Rules with a null host, path or verdict are ignored.
    """
    listed = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(
        F.max(F.col("verdict")).alias("verdict")).withColumn("key", F.concat_ws("\u0001", "host", "path"))
    shape = listed.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    blocks = max(1, -(-shape["n"] * BITS_PER_ENTRY // (64 * BLOCK_WORDS)))
    small = shape["n"] <= BROADCAST_ROWS
    # Path lengths of the list; there are at most as many as the longest path has characters.
    lengths = F.array(*[F.lit(n) for n in shape["lengths"]]).cast("array<int>")

    seen = pages.select(F.col(id).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    # A url becomes several keys, so the distinct ones are dealt evenly before.
    width = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    urls = seen.where("host <> '' or path <> ''").select("host", "path").distinct().repartition(width)
    keys = urls.select("host", "path", F.explode(suffixes).alias("suffix")).select(
        "host", "path", "suffix", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))).alias("length")).select(
        "host", "path", F.concat_ws("\u0001", "suffix", F.expr("left(path, length)")).alias("key"))
    hits = passed(keys, bloom_filter(listed, blocks), blocks, small)
    entry = F.struct(
        (F.length("r.host") + F.length("r.path")).alias("size"), F.length("r.host").alias("host_size"),
        F.col("r.verdict").alias("verdict"), F.concat("r.host", "r.path").alias("rule"))
    exact = listed.alias("r")
    found = hits.alias("h").join(F.broadcast(exact) if small else exact, F.col("h.key") == F.col("r.key")).groupBy(
        F.col("h.host").alias("host"), F.col("h.path").alias("path")).agg(F.max(entry).alias("best"))
    # Written, as a join with an aggregate could not split a url that very many pages share.
    found = scratch.cut(found, "found")
    return seen.join(found, ["host", "path"], "left").select(
        F.col("id").alias(id), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(other)).alias("verdict"))
