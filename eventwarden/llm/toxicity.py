"""Toxicity by a weighted lexicon of word beginnings.

Texts are folded first: compatibility forms to plain letters, lower case, look-alike letters of other alphabets to
Latin, digits and signs that stand for letters to those letters, invisible characters gone, everything else that is
no letter to blanks. Letters that one sign can stand for are one class: l and i with 1, ! and |. A ! or | before
a letter can also end a word, so such words are read both ways. The lexicon is folded like the texts.
The lexicon is found by one Aho-Corasick pass; an entry counts where a word begins with it. Exception phrases are
part of the same automaton and take back the hits they cover. The sum of weights over the length of the text
gives the score through a fitted curve.

Entries, weights, exceptions and the curve are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventwarden.llm.samples import balanced, class_counts, labelled, logistic, sigmoid
from eventwarden.llm.scratch import in_parts

#: Look-alike letters and what they look like.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһӏԛԝвнкмтгпαεοριυκντχγβηωⅼｏ",
    "aeopcyxijsdhlqwbhkmtrnaeopiukvtxybnwlo")
#: Digits and signs that stand for letters.
SIGNS = str.maketrans("01345789@$€", "oieastbgase")
#: Signs that are a letter where another follows, or the end of a word.
EITHER = re.compile(r"[!|](?=\w)")
#: Characters that show nothing.
HIDDEN = (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)

SHORTEST, LONGEST = 3, 16
#: Counts a task holds before it passes them on; bounds its memory, not its result.
COUNTED = 100_000


class Lexicon(NamedTuple):
    """Entry weights, exception phrases, and the curve: score = sigmoid(offset + slope * log1p(density))."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    offset: float
    slope: float


def fold_table() -> dict[int, int | None]:
    table: dict[int, int | None] = {}
    for code in [*range(0x00, 0xC0), *range(0x2000, 0x2070), 0xD7, 0xF7, 0x3000]:
        if not chr(code).isalpha():
            table[code] = 0x20
    table |= LOOKALIKES | SIGNS
    # One class with i, whatever it was before.
    table |= {code: ord("i") for code, to in table.items() if to == ord("l")} | {ord("l"): ord("i")}
    table |= {code: None for code in HIDDEN}
    return table


def folded(text: str, table: dict[int, int | None]) -> str:
    """The folded text, with one blank in front and behind."""
    text = unicodedata.normalize("NFKC", text).lower()
    if EITHER.search(text):
        text = " ".join(f"{w} {EITHER.sub('i', w)}" if EITHER.search(w) else w for w in text.split())
    return f" {' '.join(text.translate(table).split())} "


def automaton(lexicon: Lexicon):
    import ahocorasick

    found, table = ahocorasick.Automaton(), fold_table()
    weights: dict[str, float] = {}
    for entry, weight in lexicon.weights.items():
        entry = folded(entry, table)[:-1]
        if entry.strip():
            weights[entry] = max(weight, weights.get(entry, weight))
    for entry, weight in weights.items():
        found.add_word(entry, (weight, len(entry)))
    for phrase in lexicon.exceptions:
        phrase = folded(phrase, table)
        found.add_word(phrase, (0.0, len(phrase)))
    found.make_automaton()
    return found if len(found) else None


def hits(text: str, found) -> list[tuple[int, int, float]]:
    """(begin, end, weight) of entries that no exception covers; of entries at one place the longest."""
    if found is None:
        return []
    entries: dict[int, tuple[int, float]] = {}
    covered: list[tuple[int, int]] = []
    for last, (weight, size) in found.iter(text):
        begin = last + 1 - size
        if weight:
            entries[begin] = max(entries.get(begin, (0, 0.0)), (last + 1, weight))
        else:
            covered.append((begin, last + 1))
    # Of the exceptions that begin no later than an entry, the one that reaches furthest decides.
    covered.sort()
    begins = [c for c, _ in covered]
    furthest = [-1, *accumulate((d for _, d in covered), max)]
    return [(a, b, w) for a, (b, w) in entries.items() if furthest[bisect_right(begins, a)] < b]


def density(weight: float, words: int) -> float:
    """Weight per hundred words; short texts count as if they had twenty more."""
    return 100 * weight / (words + 20)


def _count_words(table):
    """Arrow task over (id, text, label): in how many texts of each class a word beginning occurs."""

    def told(label: int, counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([label] * len(counts), pa.int32()),
             pa.array(list(counts.values()), pa.int64())], ["entry", "label", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter(), Counter()]
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = set(folded(text or "", table).split())
                seen[label].update({w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)})
                if len(seen[label]) > COUNTED:
                    yield told(label, seen[label])
                    seen[label] = Counter()
        for label, counts in enumerate(seen):
            yield told(label, counts)

    return task


def _count_phrases(lexicon: Lexicon, table):
    """Arrow task over (id, text, label): word pairs around hits, by class, once per text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(lexicon)
        seen = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                flat = folded(text or "", table)
                pairs = set()
                for begin, _, _ in hits(flat, found):
                    before = flat[:begin].rpartition(" ")[2]
                    word, _, rest = flat[begin + 1:].partition(" ")
                    after = rest.partition(" ")[0]
                    pairs |= {p for p in ((before, word), (word, after)) if all(p)}
                seen[label].update(" ".join(p) for p in pairs)
        for label, counts in enumerate(seen):
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array([label] * len(counts), pa.int32()),
                 pa.array(list(counts.values()), pa.int64())], ["phrase", "label", "n"])

    return task


def _by_class(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("ones"),
                               F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("zeros"))


def learn(docs: DataFrame, labels: DataFrame, scratch, label: str = "toxic", folds: int = 4, held_out: int = 2,
          id: str = "doc_id", text: str = "text", share: float = 0.02, odds: float = 10.0) -> Lexicon:
    """Learn a lexicon from labelled rows outside the held-out fold, at most PER_CLASS of each class.

    An entry begins words in at least ``share`` of the toxic sample and is surely ``odds`` times as frequent
    there as in the rest; of beginnings that occur in the same texts the longest is taken, and of entries that
    begin with one another the one with the most weight. An exception is a pair of words around entries that is four
    times as frequent in the clean sample. Both lists are as long as the sample, which is bounded, makes them.
    Without toxic labels the lexicon is empty and every score 0.
    """
    table = fold_table()
    sample = scratch.cut(labelled(docs, labels, label, folds, held_out, id, text), "sample")
    zeros, ones = class_counts(labels, label, folds, held_out, id)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not toxic:
        return Lexicon({}, (), -60.0, 0.0)
    counted = _by_class(sample.mapInArrow(_count_words(table), "entry string, label int, n bigint"), "entry")
    least = max(3, math.ceil(share * toxic))
    # The lower end of the log odds: three lucky texts must not make an entry.
    ratio = F.log((F.col("ones") / toxic) / ((F.col("zeros") + 0.5) / (clean + 1)))
    weight = ratio - 1.64 * F.sqrt(1 / F.col("ones") + 1 / (F.col("zeros") + 0.5))
    rows = counted.where((F.col("ones") >= least) & (weight >= math.log(odds))).withColumn("weight", weight)
    frequent = {r["entry"]: (r["ones"], r["weight"]) for r in rows.collect()}
    followed = {e[:-1] for e, (n, _) in frequent.items() if frequent.get(e[:-1], (None,))[0] == n}
    weights: dict[str, float] = {}
    inner: set[str] = set()
    for entry in sorted(set(frequent) - followed, key=lambda e: (-frequent[e][1], e)):
        begins = {entry[:n] for n in range(SHORTEST, len(entry))}
        if entry in inner or begins & weights.keys():
            continue
        weights[entry] = frequent[entry][1]
        inner |= begins
    lexicon = Lexicon(weights, (), 0.0, 1.0)
    if not weights:
        return Lexicon({}, (), -60.0, 0.0)

    pairs = _by_class(sample.mapInArrow(_count_phrases(lexicon, table), "phrase string, label int, n bigint"), "phrase")
    harmless = pairs.where(
        (F.col("zeros") >= 3) & (F.col("zeros") / (clean + 1) >= 4 * (F.col("ones") + 0.5) / (toxic + 1)))
    phrases = [r["phrase"] for r in harmless.orderBy(F.desc("zeros"), "phrase").collect()]
    lexicon = lexicon._replace(exceptions=tuple(phrases))

    measured = sample.mapInArrow(_measure(lexicon, ["id", "label"]), "id bigint, label int, density double").collect()
    x = np.array([[1.0, math.log1p(r["density"])] for r in measured])
    y = np.array([float(r["label"]) for r in measured])
    offset, slope = logistic(x, y, balanced(y, zeros, ones), ridge=0.05)
    return lexicon._replace(offset=float(offset), slope=float(slope))


def _measure(lexicon: Lexicon, carried: list[str]):
    """Arrow task over (carried..., text): the hit weight per hundred words."""
    table = fold_table()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(lexicon)
        for batch in batches:
            out = []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                flat = folded((raw or b"").decode("utf-8", "replace"), table)
                out.append(density(sum(w for _, _, w in hits(flat, found)), flat.count(" ") - 1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(out, pa.float64())], [*carried, "density"])

    return task


def score(docs: DataFrame, lexicon: Lexicon, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, density, score) of every row, its whole text read. Null and empty texts have density 0."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    measured = rows.mapInArrow(_measure(lexicon, ["id"]), f"id {kind}, density double")
    curve = 1 / (1 + F.exp(-(F.lit(lexicon.offset) + F.lit(lexicon.slope) * F.log1p("density"))))
    return measured.select(F.col("id").alias(id), "density", curve.alias("score"))


def clean(docs: DataFrame, lexicon: Lexicon, limit: float, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that score below ``limit``, with all their columns and in one pass over the texts."""
    table = fold_table()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(lexicon)
        for batch in in_parts(batches):
            keep = []
            for raw in batch.column(text).cast(pa.binary()).to_pylist():
                flat = folded((raw or b"").decode("utf-8", "replace"), table)
                amount = density(sum(w for _, _, w in hits(flat, found)), flat.count(" ") - 1)
                keep.append(float(sigmoid(np.float64(lexicon.offset + lexicon.slope * math.log1p(amount)))) < limit)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
