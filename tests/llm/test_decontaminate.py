import random
import re

from docugauge.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=13):
    windows = {}
    for i, t in items:
        w = words(t)
        m = min(n, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[s : s + m]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for g, ids in windows.items():
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    found |= {str(i) for i in ids if i is not None}
        out.append((d, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_like_brute_force_in_one_block_and_in_many(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"b{rng.randrange(50)}" for _ in range(rng.choice([1, 5, 12, 13, 14, 30])))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "..."), (None, "nameless one two"), (3, items[3][1]), (60, "Größe ÉTÉ 12")]
    docs = []
    for d in range(40):
        parts = [rng.choice(items)[1] or "" if rng.random() < 0.4 else " ".join(f"b{rng.randrange(60)}" for _ in range(rng.randrange(60))) for _ in range(4)]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(parts).upper() if d % 3 else "|".join(parts)))
    docs += [(90, None), (91, ""), (92, "GRÖßE été"), (93, "größe ÉTÉ 12"), (None, items[0][1]), (7, docs[7][1])]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], "doc_id long, text string, n_words string, HIT_SPANS string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for block in (D.BLOCK_BYTES, 100):
        out, (n, spans, found, hit, bad) = D.judged(df, bench, block_bytes=block)
        assert [(r.doc_id, r[n], r[hit], r[found], r[bad]) for r in out.collect()] == want
    kept = D.without_contaminated(df, bench)
    assert [r.doc_id for r in kept.collect()] == [w[0] for w in want if not w[4]] and kept.columns == df.columns
    cut = {r.doc_id: r.text for r in D.without_spans(df, bench).collect()}
    assert cut[92] == "GRÖßE été" and len(cut[90] or "") == 0


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.without_contaminated(docs, bench).count() == 1 and D.without_contaminated(docs.limit(0), bench).count() == 0


def test_the_index_is_flat_and_finds_a_window_of_many_items():
    import pickle

    import pyarrow as pa

    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(600)] + [" ".join(f"same{i}" for i in range(20))] * 50
    table = pa.table({"item": [str(i) for i in range(len(texts))], "text": texts})
    built = D.build_index(table, 13)
    assert len(pickle.dumps(built)) < 8 * sum(map(len, texts)) + (2 << 20)
    part = next(D.scan.slices(pa.array(["x " + texts[-1].upper() + " y"]), lower=True))
    found = D.scan.Words(part, D.scan.ALNUM)
    hits = D.window_hits(found, found.hashes(), built)
    assert [h[:2] for h in hits] == [(i, 13) for i in range(1, 9)] and D._items(hits, built) == {str(i) for i in range(600, 650)}


def test_equal_hashes_of_different_windows(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(D.scan, "window_hashes", lambda words, n, name="word": np.zeros(max(0, len(words) - n + 1), dtype=np.uint64))
    built = D.build_index(pa.table({"item": ["a", "b", "c"], "text": ["one two", "three four", "one two"]}), 13)
    part = next(D.scan.slices(pa.array(["zero three four one two five"]), lower=True))
    found = D.scan.Words(part, D.scan.ALNUM)
    hits = D.window_hits(found, found.hashes(), built)
    assert sorted({(i, n) for i, n, _, _ in hits}) == [(1, 2), (3, 2)] and D._items(hits, built) == {"a", "b", "c"}
