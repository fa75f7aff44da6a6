"""What op7 writes and shuffles follows what repeats, not the whole texts."""

import hashlib
import random

from pyspark.sql import functions as F

from eventwarden.llm import repeats
from eventwarden.llm.scratch import Scratch


def _rows():
    rnd = random.Random(12)
    passage = " ".join(f"p{rnd.randrange(9999)}" for _ in range(80))
    rows = [(n, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(900))) for n in range(300)]
    rows[7] = (7, f"{rows[7][1]} {passage}")
    # A passage that a smaller id has, a copy, and rows that share an id or repeat.
    return rows + [(400, f"a {passage} b"), (401, rows[3][1]), (402, rows[5][1]), (402, f"c {passage}"), (400, f"a {passage} b"),
                   (3, rows[3][1]), (None, rows[4][1]), (500, None), (501, ""), (502, " ".join(passage.split()[:49]))]


def test_whole_texts_are_not_copied_and_few_are_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame(_rows(), "doc_id bigint, text string")
    copies, joined = [], []
    cut, join = Scratch.cut, type(docs).join
    monkeypatch.setattr(Scratch, "cut", lambda self, df, name="cut": copies.append(df.columns) or cut(self, df, name))

    def noted(self, other, on=None, how=None):
        if "text" in self.columns and on == ["id", "tag"]:
            joined.append(self.count())
        return join(self, other, on, how) if how else join(self, other, on)

    monkeypatch.setattr(type(docs), "join", noted)
    out = {}
    for r in repeats.remove_repeats(docs, Scratch(spark, "t"), levels=True).collect():
        out.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.longest_level, r.kept_sha256))
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert out[400] == [(82, 80, 50, digest("a b"))] * 2
    assert out[401] == [(900, 900, 800, digest(""))] and sorted(r[:3] for r in out[402]) == [(81, 80, 50), (900, 900, 800)]
    assert all(r[1] == 0 for n, rows in out.items() if n not in (400, 401, 402) for r in rows) and sum(map(len, out.values())) == 310
    assert not any("text" in columns for columns in copies)
    assert len(joined) == 2 and max(joined) < 20


def test_filter_loses_no_entry(spark, monkeypatch):
    rows = spark.range(0, 4000, 1, 4).select("id", F.xxhash64("id").alias("tag"))
    entries = rows.where("id % 4 = 1")
    few = repeats.listed_rows(rows, entries, Scratch(spark, "t"))
    assert few.count() == 4000 and few.where("id % 4 = 1 and not listed").count() == 0
    assert few.where("id % 4 <> 1 and listed").count() < 30
    assert repeats.listed_rows(rows, entries.limit(0), Scratch(spark, "t")).where("listed").count() == 0
    # A filter that is full flags too many, and still loses none.
    monkeypatch.setattr(repeats, "FILTER_WORDS", 4)
    full = repeats.listed_rows(rows, entries, Scratch(spark, "t"))
    assert full.count() == 4000 and full.where("id % 4 = 1 and not listed").count() == 0
