import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftscan.llm import minhash

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(docs):
    """doc_id to component, of every pair of texts; a doc_id is one node, and rows without one are none."""
    sets = [(k, brute_set(t)) for k, t in docs if k is not None]
    up = {k: k for k, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            where[g].append(i)
    for i, (k, s) in enumerate(sets):
        for j, both in Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * both >= 75 * (len(s) + len(sets[j][1]) - both):
                a, b = sorted((root(k), root(sets[j][0])))
                up[b] = a
    return {k: root(k) for k, _ in sets}


def check(df, docs):
    rows = minhash.near_duplicates(df).collect()
    assert len(rows) == len(docs)
    expected = brute_components(docs)
    assert Counter((r.doc_id, r.n_shingles) for r in rows) == Counter((k, len(brute_set(t))) for k, t in docs)
    for r in rows:
        assert r.component_id == (expected[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    return expected


def near(text, changes, seed):
    rng = random.Random(seed)
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(1000)}"
    return " ".join(words)


def test_edges(edge_docs, edge_rows, no_docs):
    check(edge_docs, [(k, t) for k, t, *_ in edge_rows])
    assert minhash.near_duplicates(no_docs).count() == 0


def test_against_every_pair(spark):
    passage = prose(77, 60)
    docs = []
    for g in range(12):  # groups of near copies at changing distance, chained
        text = prose(200 + g, 150)
        for k in range(8):
            docs.append((len(docs), text))
            text = near(text, 1 + g % 5, len(docs))
    docs += [(len(docs) + k, prose(900 + k, 20 + 3 * (k % 7)) + " " + passage) for k in range(60)]  # one passage, much of each text
    docs += [(2000 + k, docs[3][1]) for k in range(30)] + [(3000, "one two three"), (3001, "One TWO three"), (3002, "one two"), (3003, "")]
    random.Random(1).shuffle(docs)
    expected = check(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), docs)
    assert expected[3001] == 3000 and expected[3002] == 3002
    assert 1 < len(set(expected.values())) < len(docs)


def test_mixed_buckets_are_compared_in_cells(spark, monkeypatch):
    """With a block of two rows, pairs that the least member does not link must still be found."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    base = prose(5, 100).split()
    docs = [(0, " ".join(base))]
    for k in range(1, 14):  # each like its neighbour, unlike the first ones
        docs.append((k, " ".join([f"n{j}" if j < 6 * k else w for j, w in enumerate(base)])))
    docs += [(50 + k, " ".join([*base[:55], *prose(300 + k // 2, 45).split()])) for k in range(20)]
    check(spark.createDataFrame(docs, "doc_id long, text string"), docs)


def test_estimates_are_close():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.75, 0.9):
        pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        n = int(1000 * share * 2 / (1 + share))
        a, b = np.unique(pool[:1000]), np.unique(np.r_[pool[:n], pool[1000 : 2000 - n]])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x = np.frombuffer(minhash.signature(minhash.minima(a)), np.uint8) ^ np.frombuffer(minhash.signature(minhash.minima(b)), np.uint8)
        assert abs(minhash.estimate(minhash._DIFFERENT[x].sum(dtype=np.int64)) - true) < 0.2


def test_stage_keeps_one_of_each(spark):
    text = prose(9)
    docs = [(1, text, "a"), (1, text, "a"), (2, text + " x", "b"), (3, prose(10), "c"), (None, text, "d"), (4, None, "e"), (5, "", "f")]
    df = spark.createDataFrame(docs, "doc_id long, text string, rep string")
    kept = minhash.stage(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5]


@pytest.mark.parametrize("links", [[], [(1, 2), (2, 3), (5, 4), (7, 7)], [(k, k + 1) for k in range(40)]])
def test_components(spark, links):
    up = {}
    for a, b in links:
        ra, rb = a, b
        while up.get(ra, ra) != ra:
            ra = up[ra]
        while up.get(rb, rb) != rb:
            rb = up[rb]
        up[max(ra, rb)] = min(ra, rb)

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    found = {r.label: r.root for r in minhash.components(spark.createDataFrame(links, "la long, lb long")).collect()}
    assert found == {x: root(x) for a, b in links if a != b for x in (a, b)}
