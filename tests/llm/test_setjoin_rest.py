"""Large nodes of the Jaccard join: the sets that are like no pivot are compared with the whole node, or the node is split."""

import random

import numpy as np
import pandas as pd
import pytest

from fieldloom.llm import setjoin
from tests.llm import test_models


def family(n, others):
    """Near copies of one text, and texts that share a passage with it, in pairs just above the threshold."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for k in range(n):
        t = list(base)
        for _ in range(rng.randrange(1, 12)):
            t[rng.randrange(300)] = f"own{k}"
        texts.append(" ".join(t))
    for k in range(others):
        texts.append(" ".join(base[:150] + [f"p{k // 2}x{i}" for i in range(150)] + [f"o{k}x{i}" for i in range(20)]))
    return texts


@pytest.mark.parametrize("rest", [512, 3])
def test_large_nodes_give_the_links_of_all_pairs_and_few_rows(spark, monkeypatch, rest):
    made, real = {}, setjoin.staged
    monkeypatch.setattr(setjoin, "REST", rest)
    monkeypatch.setattr(setjoin, "SMALL", 8)
    monkeypatch.setattr(setjoin, "staged", lambda df, name: made.setdefault(name, real(df, name)))
    texts = family(300, 60)
    got = {r.doc_id: r.links for r in setjoin.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [set(setjoin.shingles(t, {}).tolist()) for t in texts]
    assert got == {i: sum(i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    assert rest == 3 or "pivots-4" not in made  # no node is split


def test_rest_is_compared_with_all_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(setjoin, "BLOCK", 8)
    sig = rng.integers(0, 1 << 32, (300, setjoin.TOKENS), dtype=np.uint32)
    for i, j in ((0, 299), (1, 150), (1, 2)):  # likely pairs of left ones; 200 and 201 are none of them
        sig[j] = sig[i]
        sig[j, :8] = rng.integers(0, 1 << 32, 8, dtype=np.uint32)
    sig[201] = sig[200]
    rows = pd.DataFrame({"node": 7, "id": range(300), "sig": [bytes(s.tobytes()) for s in sig], "left": [i < 3 for i in range(300)], "n_group": 300})
    edges = setjoin._rest_pairs(spark.createDataFrame(rows, "node long, id long, sig binary, left boolean, n_group long")).distinct().collect()
    assert sorted((min(e), max(e)) for e in map(tuple, edges)) == [(0, 299), (1, 2), (1, 150)]


def test_recall_when_nodes_are_split_deeply(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "REST", 0)
    test_models.test_jaccard_join_recall_when_nodes_are_split_deeply(spark, monkeypatch)
