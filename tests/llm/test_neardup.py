import random

import numpy as np
import pytest

from docugauge.llm import components, neardup, superminhash


def shingles(text, k):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    above = list(range(len(rows)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                above[root(i)] = root(j)
    low = -(2**63)
    ids = [low if i is None else i for i, _ in rows]
    return sorted((ids[i], len(sets[i]), min(ids[j] for j in range(len(rows)) if root(j) == root(i))) for i in range(len(rows)))


def family(rng, size, changes, words=60):
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(size):
        some = list(base)
        for _ in range(rng.randrange(changes)):
            some[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(some))
    return out


@pytest.mark.parametrize("k, percent, seed", [(3, 85, 1), (5, 80, 2), (3, 85, 3)])
def test_like_brute_force(spark, k, percent, seed):
    rng = random.Random(seed)
    texts = [t for _ in range(4) for t in family(rng, 25, 5)]
    chain = texts[0].split(" ")
    for i in range(12):  # each next to the one before, the ends far apart
        chain = list(chain)
        chain[3 * i + 2] = f"c{i}"
        texts.append(" ".join(chain))
    texts += ["Same  Words", "same words\n", "one", "ONE", "", " \t", None, texts[5], texts[5].upper(), "é É", "long " * 3000]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(None, texts[0]), (4, texts[1]), (4, texts[1])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, o string").repartition(4)
    got = sorted((r.o, r.n, r.root) for r in neardup.groups(docs, k=k, percent=percent).collect())
    assert got == brute(rows, k, percent)


def test_one_document_of_each_group_stays(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", "x"), (1, "A b c d e f", "y"), (2, "other words here", "z"), (5, None, "n"), (6, "", "m"), (1, "A b c d e f", "y")], "doc_id long, text string, o string")
    got = neardup.unique_documents(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.o) for r in got] == [(1, "y"), (2, "z"), (5, "n"), (6, "m")] and got[0].asDict().keys() == {"doc_id", "text", "o"}
    assert neardup.unique_documents(docs.limit(0)).count() == 0


def test_signatures_estimate_and_stop_early():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for share in (0.3, 0.6, 0.85):
        n = int(1000 * 2 * share / (1 + share))
        sets = [np.sort(pool[:1000]), np.sort(np.concatenate((pool[:n], pool[1000 : 2000 - n])))]
        both, either = superminhash.jaccard_counts(*sets)
        s = superminhash.signatures(sets, 512)
        assert abs((s[0] == s[1]).mean() - both / either) < 0.07
    small = [np.arange(3, dtype=np.uint64), np.zeros(0, np.uint64), np.arange(3, dtype=np.uint64)]
    s = superminhash.signatures(small, 128)
    assert (s[0] == s[2]).all() and (s[1] == np.iinfo(np.uint64).max).all() and (s[0] < np.iinfo(np.uint64).max).all()
    order = np.argsort(superminhash.signatures([pool[:50]], 64)[0] >> np.uint64(40))
    assert len(order) == 64


def test_union_find_and_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(300)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, 5), (None, 3)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "x long, y long").repartition(7)
    got = {r.node: r.root for r in components.components(df, "x", "y").collect()}
    want = components.union_find([(a, b) for a, b in edges if a is not None])
    assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in set(want) - set(got)) and got[200] == 0
    assert components.components(df.limit(0), "x", "y").count() == 0
