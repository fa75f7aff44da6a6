"""What every stage of the pipeline keeps, next to brute force over planted documents."""

import hashlib
import math
import random
import re

import public_tokenizers

import corpus_pipeline
from eventwarden.llm import toxicity
from eventwarden.llm.scratch import Scratch

INSULTS = ("moron", "scumbag", "wretch")


def corpus():
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("bcdfghkprtuvxz") for _ in range(rnd.randint(4, 8))) for _ in range(600)]

    def prose(n):
        return [rnd.choice(vocab) for _ in range(n)]

    rows = {n: prose(150) for n in range(100)}
    for n in range(100, 140):
        rows[n] = prose(60)
        for _ in range(8):
            rows[n][rnd.randrange(60)] = rnd.choice(INSULTS)
    passage, item = prose(70), prose(40)
    for n in range(140, 150):
        # Near copies of the smaller ids: some above and some below the similarity.
        rows[n] = list(rows[n - 140])
        for k in range(1 + (n - 140) // 2):
            rows[n][10 + 25 * k] = "changed"
    for n in range(150, 156):
        rows[n] = prose(100) + passage + prose(40)
    rows[156] = list(passage)
    for n in range(157, 160):
        rows[n] = prose(90) + item + prose(30)
    rows[160] = prose(90) + item[:20] + prose(30)
    rows[161] = list(rows[50])
    texts = {n: " ".join(w) for n, w in rows.items()}
    texts[50] = texts[50].replace(" ", "\n", 3)
    labels = [(n, 1, int(100 <= n < 130)) for n in range(130)]
    return texts, labels, [(0, " ".join(item)), (1, " ".join(prose(30)))]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def clean(texts, lexicon):
    kept = {}
    for n, t in texts.items():
        w = t.lower().replace("l", "i").split()
        amount = 0.0
        for k, word in enumerate(w):
            entries = [e for e in lexicon.weights if word.startswith(e)]
            pairs = {" ".join(w[max(0, k - 1):k + 1]), " ".join(w[k:k + 2]), word}
            if entries and not pairs & set(lexicon.exceptions):
                amount += lexicon.weights[max(entries, key=len)]
        value = lexicon.offset + lexicon.slope * math.log1p(100 * amount / (len(w) + 20))
        if 1 / (1 + math.exp(-value)) < corpus_pipeline.TOXIC:
            kept[n] = t
    return kept


def without_copies(texts):
    sets, part = {n: shingles(t) for n, t in texts.items()}, {n: n for n in texts}
    for a in texts:
        for b in texts:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = part[a], part[b]
                part = {n: min(x, y) if p in (x, y) else p for n, p in part.items()}
    return {n: t for n, t in texts.items() if part[n] == n}


def without_repeats(texts):
    size, first, kept = corpus_pipeline.PASSAGE, {}, {}
    for n, t in sorted(texts.items()):
        w = t.split()
        gone = set()
        for k in range(len(w) - size + 1):
            if first.setdefault(tuple(w[k:k + size]), n) < n:
                gone |= set(range(k, k + size))
        if not gone:
            kept[n] = t
        elif len(gone) < len(w):
            # A removed word takes the blanks after it along.
            kept[n] = "".join(x for k, x in enumerate(re.findall(r"\S+\s*", t)) if k not in gone)
    return kept


def without_items(texts, items):
    wanted = [shingles(t) for _, t in items]
    return {n: t for n, t in texts.items() if not any(100 * len(s & shingles(t)) >= 80 * len(s) for s in wanted)}


def test_stages_equal_brute_force(spark, tmp_path):
    texts, labels, items = corpus()
    folder = str(tmp_path)
    rows = [(n, t, "en", "web", len(t)) for n, t in texts.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"), Scratch(spark, "t"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "bpe"]
    scratch, expected, lost = Scratch(spark, "stages"), texts, []
    brute = [lambda t: clean(t, lexicon), without_copies, without_repeats, lambda t: without_items(t, items)]
    for (name, stage), own in zip(corpus_pipeline.STAGES[:4], brute, strict=True):
        docs = scratch.cut(stage(spark, docs, folder), name)
        before, expected = expected, own(expected)
        found = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert len(found) == len(expected) and {r.doc_id: r.text for r in found} == expected, name
        assert all(r.n_chars == len(r.text) for r in found), name
        lost.append({n for n, t in before.items() if expected.get(n) != t})
    # What was planted is what goes.
    assert lost[0] == set(range(100, 140))
    assert {140, 161} <= lost[1] < set(range(140, 150)) | {161}
    assert {151, 152, 153, 154, 155, 156} <= lost[2] and 156 not in expected and 155 in expected
    assert lost[3] == {157, 158, 159}

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in out) == sorted(expected)
    for r in out:
        ids = library.encode(expected[r.doc_id], add_special_tokens=False).ids
        assert (list(r.token_ids), r.n_tokens) == (ids, len(ids))
        assert r.decoded_sha256 == hashlib.sha256(expected[r.doc_id].encode()).hexdigest()
