"""The filter audit next to brute force, its tries, and its prefixes."""

import random
import re
from itertools import permutations

import pytest

from eventwarden.llm import filter_audit as A
from eventwarden.llm.text_trie import Trie

DOCS = "doc_id bigint, text string, lang string, id int, part string, mask int, range int"
LABELS = "doc_id bigint, quality int, toxic int"


def texts():
    rnd = random.Random(4)
    prose = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 5) for _ in range(250)) for _ in range(6)]
    varied = " ".join(f"w{n}" for n in range(260))
    rows = [(0, prose[0], "en"), (1, prose[0], "de"), (2, prose[1], "en"), (2, prose[1], "en"), (2, prose[1], "de"),
            (3, None, "en"), (4, "", None), (5, " \n", "en"), (None, prose[0], "en"), (None, None, None),
            (6, varied, "en"), (7, varied + " $", ""), (8, varied.upper(), "fr"), (9, "é" * 100 + " ABC", "fr"),
            (10, "é" * 100 + " ABCD", "fr"), (-3, prose[2], "en"), (11, prose[2], "fr"), (12, varied * 300, "en"),
            (13, varied, None)]
    rows += [(n, prose[n % 6] + (" x" if n % 4 else ""), rnd.choice(["en", "de"])) for n in range(20, 70)]
    rows += [(70, prose[3], "en")] * 25
    return [(i, t, p, 1, "clash", 2, 3) for i, t, p in rows]


def labels():
    return [(0, 1, 0), (0, 0, 1), (2, 1, None), (None, 1, 1), (11, 0, 1), (30, 1, 1), (99, 1, 1), (70, 1, 0)]


def brute():
    lows = {}
    for i, t, *_ in texts():
        if i is not None:
            lows[t or ""] = min(lows.get(t or "", i), i)
    docs = []
    for i, t, lang, *_ in texts():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {c for c, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            re.search(r"[#$%&*|]", t), i is not None and i > lows[t]), strict=True) if bad}
        said = [x for x in labels() if x[0] == i and i is not None]
        docs.append((lang or "", fails, any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for _, fails, *_ in own:
                if fails:
                    shapley[next(c for c in order if c in fails)] += 1
        for order in permutations("ABCDE"):
            for step, c in enumerate(order, 1):
                gone = set(order[:step - 1])
                here = [d for d in own if c in d[1] and not d[1] & gone]
                out[part, "".join(order), step] = (
                    sum(not d[1] & (gone | {c}) for d in own), len(here), sum(c in d[1] and bool(d[1] & gone) for d in own),
                    sum(d[1] == {c} for d in own), sum(d[2] for d in here), sum(d[3] for d in here), shapley[c])
    return out


@pytest.mark.parametrize("held", [None, 2000])
def test_audit(spark, monkeypatch, held):
    if held:
        monkeypatch.setattr(A, "HELD_BYTES", held)
    docs, said = spark.createDataFrame(texts(), DOCS).repartition(5), spark.createDataFrame(labels(), LABELS)
    rows = A.audit(docs, said).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in rows} == brute()
    assert A.audit(docs.where("false"), said).count() == 0


def test_trie():
    rnd = random.Random(8)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9))) * rnd.choice([1, 60]) for _ in range(600)]
    trie, least = Trie(), {}
    nodes = [trie.insert(t, n % 97) for n, t in enumerate(texts)]
    for n, t in enumerate(texts):
        least[t] = min(least.get(t, 97), n % 97)
    assert all(trie.least[node] == least[t] for node, t in zip(nodes, texts, strict=True))
    found = list(trie.ordered())
    assert [(t, i) for t, i, _ in found] == sorted(least.items())
    for (a, *_), (b, _, shared) in zip(found, found[1:]):
        assert a[:shared] == b[:shared] and a[:shared + 1] != b[:shared + 1]
    assert len(trie) <= 2 * len(least) + 1


def test_prefixes_tell_texts_with_long_common_beginnings_apart(spark):
    rows = [("license " * 500 + f"{n:05}",) for n in range(2000)]
    frame = spark.createDataFrame(rows, "text string").selectExpr("cast(text as binary) AS text")
    bounds = A.adaptive_prefixes(frame)
    assert len(bounds) >= 6 and bounds == sorted(bounds) and all(len(b) > 4000 for b in bounds)
