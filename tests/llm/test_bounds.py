"""What has no cap or switch: lexicon, pairs of preferences, caps at every size; folders with a scheme; any column names."""

import random

import numpy as np

import corpus_pipeline
from eventwarden.llm import cap_links, quality, toxicity
from eventwarden.llm.samples import labelled, sigmoid
from eventwarden.llm.scratch import Scratch, open_store


def test_exceptions_cover_as_defined():
    rnd = random.Random(1)
    lexicon = toxicity.Lexicon({"bad": 2.0, "worse": 3.0, "ba": 1.0}, ("bad luck", "not bad", "bad luck worse"), 0.0, 1.0)
    found, table = toxicity.automaton(lexicon), toxicity.fold_table()
    for _ in range(300):
        text = toxicity.folded(" ".join(rnd.choice(["bad", "luck", "not", "worse", "good", "badly"]) for _ in range(rnd.randint(0, 12))), table)
        entries, covered = {}, []
        for last, (weight, size) in found.iter(text):
            if weight:
                entries[last + 1 - size] = max(entries.get(last + 1 - size, (0, 0.0)), (last + 1, weight))
            else:
                covered.append((last + 1 - size, last + 1))
        want = [(a, b, w) for a, (b, w) in entries.items() if not any(c <= a and b <= d for c, d in covered)]
        assert toxicity.hits(text, found) == want
    # A text of exceptions only costs no more than its length.
    assert toxicity.hits(toxicity.folded("bad luck " * 100_000, table), found) == []


def test_preferences_are_those_of_all_pairs(monkeypatch):
    monkeypatch.setattr(quality, "PAIRED_ROWS", 7)
    rng = np.random.default_rng(3)
    good, bad = rng.standard_normal((30, 4)) + [1, 0, 0.5, 0], rng.standard_normal((20, 4))
    w = quality.preferences(good, bad, 1 / 12, 0.7)
    pairs = (good[:, None, :] - bad[None, :, :]).reshape(-1, 4)
    slope = 0.7 * w - (pairs * (1 - sigmoid(pairs @ w))[:, None]).sum(axis=0) / 12
    assert np.abs(slope).max() < 1e-9


def test_few_vectors_pass_filters_too(spark):
    caps = cap_links.caps_for(64, 500, 0.95)
    assert caps.codewords > 1 and caps.turns > 1
    rows = [(n, [x]) for n, x in enumerate([1.0, 5.0, -2.0, 1e-9, -7.0, 0.0] + [3.0] * 4)]
    found = cap_links.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), Scratch(spark, "t")).collect()
    ones, twos = {0, 1, 3, 6, 7, 8, 9}, {2, 4}
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == (
        {n: (6, 0) for n in ones} | {n: (1, 2) for n in twos} | {5: (0, 5)})


def test_texts_of_one_id_are_told_apart_by_their_hash(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id bigint, toxic int")
    one, two = (sorted(map(tuple, labelled(d, labels, "toxic", 1, 1).collect()), key=str) for d in (docs, docs.orderBy("text")))
    assert one == two and len(one) == 2


def test_folders_carry_their_scheme(spark):
    path = Scratch(spark, "t").path("x")
    assert path.startswith("file:/")
    store, inner = open_store(path)
    store.create_dir(inner, recursive=True)
    spark.range(3).write.parquet(f"{path}/rows")
    assert store.get_file_info(f"{inner}/rows/_SUCCESS").is_file


def test_pipeline_over_odd_rows(spark, tmp_path, small):
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))
    passage = " ".join(f"p{n}" for n in range(60))
    rows = [(1, f"one {passage} end", 9), (2, f"{passage} two " + " ".join(f"z{n}" for n in range(80)), 8), (3, None, 7), (4, "", 6), (None, "x", 5),
            (None, None, 4), (5, "long " * 50_000, 3), (6, "same", 2), (6, "same", 2)]
    odd = "doc_id bigint, text string, n_removed int"
    more = {"n_words": "a", "kept_text": "b", "spans": "c", "kept_sha256": "d", "id": "e", "key": "f", "text_1": "g"}
    docs = spark.createDataFrame(rows, odd)
    for name, value in more.items():
        docs = docs.selectExpr("*", f"'{value}' AS `{name}`")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    after = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = Scratch(spark, "t").cut(stage(spark, after, str(tmp_path)))
        assert after.columns == docs.columns
    kept = {r.doc_id: r for r in after.where("doc_id is not null").collect()}
    assert kept.keys() == {1, 2, 3, 4, 5, 6} and kept[1].text == rows[0][1] and kept[2].text.startswith("two z0")
    assert kept[2].n_removed == 8 and kept[2].text_1 == "g"
    assert after.where("doc_id is null").count() == 2
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 8
