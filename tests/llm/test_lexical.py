"""Lexical search against a loop over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from weftline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k):
    docs = [(i, Counter(terms(t))) for i, t, *_ in docs if i is not None and terms(t)]
    n, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item in {i for i, *_ in items if i is not None}:
        wanted = {t for i, text, *_ in items if i == item for t in terms(text)}
        scores = []
        for i, c in docs:
            m = 100 - 50 + 50 * c.total() * n // total
            scores.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c), i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1)]
    return sorted(out)


def found(spark, docs, items, k):
    d = spark.createDataFrame(docs, "doc_id long, text string, ids string, terms string")
    q = spark.createDataFrame(items, "item_id long, text string, weight string")
    return sorted(tuple(r) for r in lexical.search(lexical.build_index(d.repartition(3)), q, k).select("query", "rank", "id", "score").collect())


def test_terms():
    for text in ("A-b c_d\x00e1 É x ÀB 9[z]", "", "...", "İstanbul K"):
        assert [t.decode() for t in lexical.terms_of(text)] == terms(text)


@pytest.mark.parametrize("settings", [(4096, 1 << 20, 1024), (3, 20, 2)])
def test_search(spark, monkeypatch, settings):
    for name, value in zip(("BLOCK_ROWS", "BLOCK_POSTINGS", "GROUP_QUERIES"), settings, strict=True):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["the"] * 40
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12))), "x", None) for i in range(60)]
    docs += [(i + 100, docs[5][1], "copies", None) for i in range(9)] + [(5, docs[5][1], "x", None)]  # ties and a repeated row
    docs += [(None, "the w1", "x", None), (90, None, "x", None), (91, "", "x", None), (92, "!!", "x", None), (93, "the " * 50_000 + "w3", "x", None)]
    items = [(i, " ".join(rng.choice(words) for _ in range(5)), "x") for i in range(7)]
    items += [(0, items[0][1], "x"), (1, "w9 w9", "x"), (20, None, "x"), (21, "", "x"), (None, "w1", "x"), (22, "nowhere", "x"), (23, "THE The the", "x")]
    assert found(spark, docs, items, 5) == by_hand(docs, items, 5)


def test_the_selection_of_the_best():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 40):
        ids, scores = rng.permutation(n), rng.integers(0, 4, n)
        for k in (1, 3, 5, 50):
            want = sorted(zip(-scores, ids, strict=True))[:k]
            assert sorted((-scores[i], ids[i]) for i in lexical.best(ids, scores, k)) == want


def test_empty_tables(spark):
    docs, items = [(1, "a b", None, None)], [(1, "a", None)]
    assert found(spark, [], items, 3) == found(spark, docs, [], 3) == []
    assert found(spark, docs, items, 3) == by_hand(docs, items, 3)
