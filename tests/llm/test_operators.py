"""The dealt operators on small tables: edge cases, brute force, round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from eventwarden.llm import quality, toxicity
from eventwarden.llm.byte_bpe import Encoder, decode, encode, round_trip
from eventwarden.llm.cap_links import near_vectors
from eventwarden.llm.components import components
from eventwarden.llm.decontaminate import contaminated
from eventwarden.llm.near_dedup import near_duplicates
from eventwarden.llm.queries import llm_oracles, llm_queries
from eventwarden.llm.repeats import remove_repeats
from eventwarden.llm.scratch import Scratch
from eventwarden.llm.token_files import PieceEncoder, write_tokens
from eventwarden.llm.url_rules import judge
from eventwarden.llm.warc import read_warc, write_warc
from tests.compare import compare, duck

DOCS = "doc_id bigint, text string, id int, rep string"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def texts():
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    base = [rnd.choice(vocab) for _ in range(300)]
    rows = [(0, " ".join(base)), (1, " ".join(base)), (1, " ".join(base)), (2, None), (3, ""), (4, " \n\t "), (5, "One two"),
            (6, "one  TWO"), (7, " ".join(rnd.choice(vocab) for _ in range(30_000))), (None, " ".join(base)), (None, None)]
    for n in range(8, 40):
        own = list(base)
        for _ in range(n // 3):
            own[rnd.randrange(300)] = rnd.choice(vocab)
        rows.append((n, " ".join(own)))
    rows += [(n, " ".join(rnd.choice(vocab) for _ in range(60)) + " " + " ".join(base[40:100])) for n in range(40, 50)]
    return [(i, t, 7, "x") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("threshold", [80, 85])
def test_near_duplicates(spark, docs, empty, threshold):
    sets = {}
    for i, t, *_ in texts():
        w = words((t or "").lower())
        found = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
        sets[i] = found
    parent = {i: i for i in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            same = len(sets[a] & sets[b])
            if a < b and same and 100 * same >= threshold * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    rows = near_duplicates(docs, Scratch(spark, "t"), threshold=threshold / 100).collect()
    assert len(rows) == len(texts())
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)
    assert near_duplicates(empty, Scratch(spark, "t")).count() == 0


def test_repeats(spark, docs, empty):
    first = {}
    for i, t, *_ in sorted((r for r in texts() if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k:k + 50]), i)
    out = remove_repeats(docs, Scratch(spark, "t"))
    assert out.columns[:4] == ["doc_id", "id", "rep", "n_words"]
    rows = out.collect()
    assert len(rows) == len(texts())
    expected = []
    for i, t, *_ in texts():
        w = words(t)
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - 49):
                if first[tuple(w[k:k + 50])] < i:
                    gone[k:k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected.append((str(i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in rows) == sorted(expected)
    assert all(hashlib.sha256(" ".join(words(r.kept_text)).encode()).hexdigest() == r.kept_sha256 for r in rows)
    assert remove_repeats(empty, Scratch(spark, "t"), levels=True).count() == 0
    assert remove_repeats(empty, Scratch(spark, "t")).count() == 0


def longest_shared(own, others):
    """The most words that stand in a row in ``own`` and in one of ``others``."""
    best = 0
    for other in others:
        row = [0] * (len(other) + 1)
        for x in own:
            row = [0] + [row[k] + 1 if x == y else 0 for k, y in enumerate(other)]
            best = max(best, max(row))
    return best


def test_levels_of_repeats(spark):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(5000)}" for _ in range(900)]
    rows = [(0, base)]
    for n, size in enumerate((49, 50, 62, 99, 100, 125, 130, 199, 250, 260, 399, 500, 640, 900), 1):
        at = rnd.randrange(901 - size)
        rows.append((n, [f"x{n}a{k}" for k in range(30)] + base[at:at + size] + [f"y{n}b{k}" for k in range(rnd.randrange(40))]))
    rows += [(50, base[:450]), (51, base[:450]), (52, [])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    out = {r.doc_id: r.longest_level for r in remove_repeats(docs, Scratch(spark, "t"), levels=True).collect()}
    for i, own in rows:
        longest = longest_shared(own, [w for j, w in rows if j < i])
        sure = max([0] + [n for n in (50, 100, 200, 400, 800) if (n == 50 and longest >= 50) or 5 * n <= 4 * longest])
        assert sure <= out[i] <= longest, (i, longest, out[i])
    assert out[51] == 400


def test_token_files(spark, docs, empty):
    rows = write_tokens(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), Scratch(spark, "t"), WORDS, 2, 49408).documents(with_ids=True).collect()
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(WORDS), 0
    source = {i: t for i, t, *_ in texts()}
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = library.encode(source[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert write_tokens(docs, Scratch(spark, "t"), WORDS, 2, 49408).documents().count() == len(texts())
    assert write_tokens(empty, Scratch(spark, "t"), WORDS, 2, 49408).documents().count() == 0


def test_encoders_equal_the_library():
    from tokenizers import Tokenizer

    nine, two = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    own, pieces = Encoder(BYTES), PieceEncoder(WORDS, 2)
    rnd = random.Random(5)
    parts = [" ", "  ", "\n", "\t", " \n", "\x1c", "\x85", "\xa0", "　", "​", "a", "Hello", "'s", "'LL", "123",
             "é", "é", "ñ", "漢字", "🙂", "!!!", "<|endoftext|>", "<|endoftext", "|>", "ß", "İ", "Σς", "́", "ǅ", "..."]
    for k in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        if k % 50 == 0:
            text = "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(20, 3000)))
        ids = nine.encode(text, add_special_tokens=False).ids
        assert own.encode([text])[0].tolist() == ids
        assert own.decode(ids).decode() == nine.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(pieces.encode([text.encode()], b"")[0], "<u2").tolist() == two.encode(text, add_special_tokens=False).ids


def test_encode_then_decode(spark, docs, empty):
    back = decode(encode(docs, BYTES), BYTES)
    assert back.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
    assert round_trip(docs, BYTES).count() == len(texts())
    assert encode(empty, BYTES).count() == 0


def test_urls(spark):
    urls = ["http://www.Example.com/en/1", "http://a.example.com/en/", "http://example.com", "x", None, "http://net/es/", "http://anet/es/",
            "https://q.net/fr?x", "https://q.net/fr/?x", "http://com:80/", "://com/#a"]
    pages = spark.createDataFrame([(n % 9, u, "h") for n, u in enumerate(urls)], "page_id bigint, url string, host string")
    rules = spark.sql("SELECT * FROM VALUES ('com','/','allow'),('example.com','/en/','block'),('www.example.com','/en/','allow'),"
                      "('net','/es/','block'),('net','/fr/','block') AS r(host, path, verdict)")
    got = sorted((r.host, r.path, r.rule or "", r.verdict) for r in judge(pages, rules, Scratch(spark, "t")).collect())
    assert got == sorted([
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("a.example.com", "/en/", "example.com/en/", "block"),
        ("example.com", "", "", "allow"), ("", "", "", "allow"), ("", "", "", "allow"), ("net", "/es/", "net/es/", "block"),
        ("anet", "/es/", "", "allow"), ("q.net", "/fr", "", "allow"), ("q.net", "/fr/", "net/fr/", "block"),
        ("com:80", "/", "", "allow"), ("com", "/", "com/", "allow")])
    assert judge(pages, rules.where("false"), Scratch(spark, "t")).where("rule is not null").count() == 0
    assert judge(pages.where("false"), rules, Scratch(spark, "t")).count() == 0


def test_warc_rejects_heads_in_payloads(spark):
    fake = "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = [None, "", "same", "same", "same", fake, fake * 40, "é" * 70_000, "WARC/1.0\r\n"]
    rows = [(n, f"http://a/\r\n{n}", h, "z") for n, h in enumerate(html)] + [(None, None, "same", "z"), (None, None, "q", "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string")
    scratch = Scratch(spark, "t")
    place, files = write_warc(pages, scratch, file_bytes=20_000)
    got = read_warc(place, files, scratch, stretch=1000, with_payload=True).collect()
    assert len(got) == len(rows)
    import base64

    for r in got:
        if r.page_id is None:
            assert r.record_type == "response"
            continue
        raw = (html[r.page_id] or "").encode()
        last = max(n for n, h in enumerate(html) if (h or "") == (html[r.page_id] or ""))
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last == r.page_id else ("revisit", last))
        assert r.record_type == "revisit" or r.payload == raw
    place, files = write_warc(pages.where("false"), scratch)
    assert read_warc(place, files, scratch).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 64))
    near = base[:10] + 0.02 * rng.standard_normal((10, 64))
    rows = [(n, [float(x) for x in v]) for n, v in enumerate(np.concatenate([base, near, base[:3]]))]
    rows += [(100, None), (101, [0.0] * 64), (102, [float("nan")] + [1.0] * 63), (103, [None] + [1.0] * 63), (104, []),
             (105, [1.0, 2.0]), (106, [2.0, 4.0]), (None, rows[0][1]), (107, [1e300] * 64), (108, [1e-300] * 64)]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(
        [(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, weight int"), Scratch(spark, "t")).collect()}
    good = {i: np.array(v) / np.abs(v).max() for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    for i, _ in rows:
        links = [j for j, w in good.items() if i in good and j != i and len(w) == len(good[i])
                 and w @ good[i] / np.linalg.norm(w) / np.linalg.norm(good[i]) >= 0.95]
        assert got[i].n_links == len(links), i
        assert got[i].component_id == (min([i, *links]) if i is not None else None)
    assert near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), Scratch(spark, "t")).count() == 0


def test_items_in_documents(spark, docs, empty):
    items = spark.createDataFrame([(0, " ".join(words(texts()[0][1])[50:75])), (1, "one two"), (2, None), (3, ""), (4, "no such thing"),
                                   (None, "one two")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items, Scratch(spark, "t")).collect()}
    piece = words(texts()[0][1])[50:75]
    want = {tuple(piece[k:k + 5]) for k in range(21)}
    expected = {(5, 1), (6, 1)}
    for i, t, *_ in texts():
        w = words(t)
        if i is not None and len(want & {tuple(w[k:k + 5]) for k in range(len(w) - 4)}) >= 0.8 * len(want):
            expected.add((i, 0))
    assert got == expected
    assert contaminated(empty, items, Scratch(spark, "t")).count() == 0
    assert contaminated(docs, items.where("false"), Scratch(spark, "t")).count() == 0


def test_scattered_items(spark):
    rnd = random.Random(9)
    item_words = [[f"i{n}w{k}" for k in range(size)] for n, size in enumerate((6, 9, 14, 30, 65, 120))]
    rows, held = [], set()
    for n in range(120):
        at = n % len(item_words)
        own = item_words[at]
        shingles = [own[k:k + 5] for k in range(len(own) - 4)]
        share = rnd.choice((0.5, 0.75, 0.8, 0.9, 1.0))
        taken = rnd.sample(shingles, round(share * len(shingles)))
        # A shingle here and there in a long text; a common one in all of them.
        text = [f"f{rnd.randrange(10**6)}" for _ in range(400)] + shingles[0]
        for piece in taken:
            text += [f"f{rnd.randrange(10**6)}" for _ in range(rnd.randrange(60, 90))] + piece
        have = {tuple(text[k:k + 5]) for k in range(len(text) - 4)}
        held |= {(n, i) for i, w in enumerate(item_words)
                 if 100 * len(have & {tuple(w[k:k + 5]) for k in range(len(w) - 4)}) >= 80 * (len(w) - 4)}
        rows.append((n, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(item_words)], "item_id bigint, text string")
    assert len(held) > 40
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items, Scratch(spark, "t")).collect()} == held


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").union(spark.sql("select 500L, 501L"))
    got = {r.node: r.component for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {n: 0 for n in range(201)} | {500: 500, 501: 500}
    assert components(edges.where("false"), Scratch(spark, "t")).count() == 0


def test_lexicon_folds_and_excepts():
    lexicon = toxicity.Lexicon({"idiot": 3.0}, ("idiot savant",), -3.0, 4.0)
    found, table = toxicity.automaton(lexicon), toxicity.fold_table()
    for text, count in (("You 1d10t!", 1), ("іdіоt", 1), ("id​iot", 1), ("an idiot savant here", 0), ("xidiot", 0), ("", 0)):
        assert len(toxicity.hits(toxicity.folded(text, table), found)) == count, text


def test_models_on_labels(spark, small):
    folder = small.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    for name, label, floor in (("op1_toxicity", "toxic", 0.9), ("op6_quality_classifier", "quality", 0.97)):
        out = llm_queries()[name](spark, folder).join(labels, "doc_id").where("held_out")
        assert out.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= floor
    assert toxicity.learn(docs, labels.where("false"), Scratch(spark, "t")).weights == {}
    ranking = quality.learn(docs, labels.where("false"), Scratch(spark, "t"))
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "a")], "doc_id bigint, text string")
    assert ranking is None and quality.score(odd, ranking).count() == 3
    scored = quality.best(quality.score(docs, quality.learn(docs, labels, Scratch(spark, "t"))), 0.9)
    assert abs(scored.agg(F.avg(F.col("kept").cast("int"))).first()[0] - 0.9) < 0.02


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_sql(spark, small, name):
    assert compare(spark, duck(small), llm_queries()[name], llm_oracles()[name], small) is None


def test_pipeline(spark, small):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, small).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
