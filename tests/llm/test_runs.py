"""Periodic runs next to brute force: suffix trees, cut texts, planted documents, odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from eventwarden.llm import runs as R
from eventwarden.llm.queries import op11_periodic_runs
from eventwarden.llm.suffix_tree import Extensions, SuffixTree, next_smaller


def brute(s, least=6, exponent=4):
    """All (start, length, period): for every period, the longest stretches; a multiple of a smaller period is none."""
    found = []
    for p in range(1, len(s) // exponent + 1):
        same = [s[i] == s[i + p] for i in range(len(s) - p)] + [False]
        begin = None
        for i, yes in enumerate(same):
            if yes and begin is None:
                begin = i
            if not yes and begin is not None:
                length = i - begin + p
                if length >= max(least, exponent * p) and not any(
                        a <= begin and a + n >= begin + length for a, n, _ in found):
                    found.append((begin, length, p))
                begin = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sequences():
    rnd = random.Random(6)
    for _ in range(800):
        n = rnd.randint(1, 60)
        s = [rnd.randint(1, rnd.randint(1, 4)) for _ in range(n)]
        a, p = rnd.randrange(n), rnd.randint(1, 9)
        yield [s[i] if i < a else s[a + (i - a) % p] if a + (i - a) % p < n else s[a] for i in range(n)]


@pytest.mark.parametrize("least, exponent", [(6, 4), (1, 2), (9, 3)])
def test_runs_of_sequences(least, exponent):
    for s in sequences():
        assert [tuple(r) for r in R.repeats_in(s, least, exponent).tolist()] == brute(s, least, exponent)


def test_trees():
    rnd = random.Random(7)
    for _ in range(200):
        s = [rnd.randint(1, 3) for _ in range(rnd.randint(1, 80))]
        tree = SuffixTree(s)
        depths, places, ordered = tree.tour()
        assert ordered == sorted(range(len(s) + 1), key=lambda i: s[i:])
        assert tree.downwards() == sorted(range(len(s) + 1), key=lambda i: [-x for x in s[i:]])
        i, j = np.array([(a, b) for a in range(len(s) + 1) for b in range(len(s) + 1) if a != b]).T
        want = [next(k for k in range(len(s) + 1) if s[a + k:a + k + 1] != s[b + k:b + k + 1] or a + k == len(s) or b + k == len(s))
                for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert Extensions(depths, places).common(i, j).tolist() == want
        after = next_smaller(ordered)
        for a in range(len(s)):
            assert after[a] == next((b for b in range(a + 1, len(s)) if s[b:] < s[a:]), len(s))


def planted(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def documents():
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    rows = [(n, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 120)))) for n in range(200)]
    rows += [(200, None), (201, ""), (202, "\n \t"), (203, "a " * 400), (204, "x\ty\r\nz x y  z x y z x y z x y z"), (None, "b b b b b b b"),
             (None, None), (205, "a a a a a"), (206, "a a a a a a"), (207, " ".join((vocab[:30] * 4) + ["end"])), (207, "same id"),
             (208, " ".join(vocab[k % 700 % 60] for k in range(6_000))), (208, "q q q q q q q q"),
             (209, " ".join(["l1 l2", "m m m m m m m", "l1 l2"] * 5)), (210, "one  " * 3 + "two " * 9 + "one\n" * 6)]
    return rows


@pytest.mark.parametrize("tree_words", [None, 8])
def test_query(spark, tmp_path, monkeypatch, tree_words):
    if tree_words:
        monkeypatch.setattr(R, "TREE_WORDS", tree_words)
    spark.createDataFrame([(i, t, 1, "x", 2) for i, t in documents()], "doc_id bigint, text string, n int, words string, a int") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    found = op11_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for i, t in documents():
        w = planted(i, t)
        runs = brute(w)
        gone = {k for a, n, p in runs for k in range(a + p, a + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                     hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_empty_table(spark):
    assert R.find_runs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
