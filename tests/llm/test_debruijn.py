import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docugauge.llm import debruijn


def brute(rows, k):
    """rows (id, text): windows of k words; covered where one starts earlier (smaller id, or same row and start)."""
    low = -(2**63)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for s in range(len(w) - k + 1):
            g, at = tuple(w[s : s + k]), (low if i is None else i, s)
            first[g] = min(first.get(g, at), at)
    out = []
    for (i, t), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < (low if i is None else i, s):
                gone |= set(range(s, s + k))
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((low if i is None else i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


def corpus(seed, many=60):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(300)
    passages = [" ".join(word() for _ in range(n)) for n in (25, 40, 90, 19, 20, 21)]
    rows = []
    for i in range(many):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(40))) for _ in range(rng.randrange(6))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    return rows + [(100, " ".join(["same"] * 60)), (101, None), (102, ""), (103, "é " * 30), (None, passages[2]), (104, passages[2]), (104, passages[2]), (104, passages[1] + " end"), (105, rows[3][1])]


@pytest.mark.parametrize("seed, k, chunk", [(1, 20, 1 << 19), (2, 20, 300), (3, 5, 100)])
def test_like_brute_force(spark, seed, k, chunk, monkeypatch):
    monkeypatch.setattr(debruijn, "CHUNK", chunk)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, seq string").repartition(5)
    out, (n, removed, digest) = debruijn.deduplicated(docs, k=k, minimizer=min(6, k - 1), keep_text=False)
    got = sorted((-(2**63) if r.doc_id is None else r.doc_id, r[n], r[removed], r[digest]) for r in out.collect())
    assert got == brute(rows, k) and "text" not in out.columns and out.columns[:2] == ["doc_id", "seq"]


def test_collisions_are_found_and_redone(spark, monkeypatch):
    """Minimizers and prints that the first attempt makes useless: everything meets everything."""
    calls = []
    rows = corpus(4, many=20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    original = debruijn._paths

    def weak(seed, k, m):
        calls.append(seed)
        run = original(seed, k, m)
        if seed:
            return run

        def zeroed(batches):
            import pyarrow as pa

            for b in run(batches):
                prints = [x if lead < 0 else bytes(len(x)) for x, lead in zip(b.column(5).to_pylist(), b.column(4).to_pylist())]
                h = [1 if lead >= 0 else x for x, lead in zip(b.column(0).to_pylist(), b.column(4).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), *b.columns[1:5], pa.array(prints, pa.binary())], names=b.schema.names)

        return zeroed

    monkeypatch.setattr(debruijn, "_paths", weak)
    out, (n, removed, digest) = debruijn.deduplicated(docs, keep_text=False)
    got = sorted((-(2**63) if r.doc_id is None else r.doc_id, r[n], r[removed], r[digest]) for r in out.collect())
    assert len(calls) > 1 and got == brute(rows, 20)


def test_texts_lose_only_what_repeats(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"a\t{passage}\nb", 7), (2, f"c  {passage} d", 8), (3, "untouched   spaces", 9)], "doc_id long, text string, n_chars long")
    out, names = debruijn.deduplicated(docs)
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: (f"a\t{passage}\nb", 7), 2: ("c d", 8), 3: ("untouched   spaces", 9)}
    assert debruijn.deduplicated(docs.limit(0))[0].count() == 0


def test_edges_that_share_32_bits_are_told_apart(spark, monkeypatch):
    """Windows whose hashes agree in the lower half, as many do in a large corpus, need no second attempt."""
    from docugauge.llm import scan

    calls, original, hashes = [], debruijn._paths, scan.window_hashes

    def low(words, n, name="word"):
        return hashes(words, n, name) if name != "word" else hashes(words, n, name) << np.uint64(32)

    def paths(seed, k, m):
        calls.append(seed)
        run = original(seed, k, m)

        def ran(batches):
            scan.window_hashes = low
            try:
                yield from run(batches)
            finally:
                scan.window_hashes = hashes

        return ran

    monkeypatch.setattr(debruijn, "_paths", paths)
    rows = corpus(6, many=20)
    out, names = debruijn.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False)
    assert results(out, names) == brute(rows, 20) and not any(calls)


def test_only_documents_of_a_false_match_meet_again(spark, monkeypatch):
    """Two different documents whose prints agree under the first hashes; the others keep their rows, whatever the later hashes."""
    monkeypatch.setattr(debruijn, "_paths", clashing(debruijn._paths, lambda o: o >= 1000, again := spark.sparkContext.accumulator(0)))
    text = lambda c: " ".join(f"{c}{i}" for i in range(25))
    rows = [*corpus(7, many=20), (1000, text("a")), (1001, text("b")), (1002, text("b"))]
    out, names = debruijn.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(30), keep_text=False)
    assert results(out, names) == brute(rows, 20) and 0 < again.value <= 3


def clashing(original, chosen, again):
    def paths(seed, k, m):
        run = original(seed, k, m)

        def ran(batches):
            for b in batches if seed else run(batches):
                if seed:
                    again.add(b.num_rows)
                    yield from run(iter([b]))
                    continue
                bad = [chosen(o) and lead >= 0 for o, lead in zip(b.column(1).to_pylist(), b.column(4).to_pylist())]
                h = [1 if x else v for x, v in zip(bad, b.column(0).to_pylist())]
                lead = [len(p) // 8 + (v & 64) if x else v for x, v, p in zip(bad, b.column(4).to_pylist(), b.column(5).to_pylist())]
                prints = [bytes(len(v)) if x else v for x, v in zip(bad, b.column(5).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), *b.columns[1:4], pa.array(lead, pa.int32()), pa.array(prints, pa.binary())], names=b.schema.names)

        return ran

    return paths


def test_edges_of_hot_minimizers_part(spark, monkeypatch):
    monkeypatch.setattr(debruijn, "HOT", 1)
    monkeypatch.setattr(debruijn, "SHARE", 1)
    rows = corpus(8, many=30)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert len(debruijn._hot(docs.selectExpr("doc_id AS o", "0 AS seq", "text").where("o IS NOT NULL"), 20, 6))
    out, names = debruijn.deduplicated(docs, keep_text=False)
    assert results(out, names) == brute(rows, 20)


def results(out, names):
    n, removed, digest = names
    return sorted((-(2**63) if r.doc_id is None else r.doc_id, r[n], r[removed], r[digest]) for r in out.collect())


def test_paths_are_cut_where_the_graph_branches(spark):
    """Two repeated paths that share nodes, one of them in the middle of a document that the other never touches."""
    k = 4
    words = lambda s: s.split()
    texts = {0: "a b c d e f g", 1: "x a b c d e f g y", 2: "p q c d e r s", 3: "1 p q c d e r s 2", 4: "z z z z z z z z"}

    def scan(docs):
        cut = debruijn._paths(0, k, 2)
        rows = docs.mapInArrow(cut, debruijn._ROW_SQL).repartition("h").sortWithinPartitions("h")
        return rows.mapInArrow(debruijn._meet, debruijn._MET_SQL)

    for parts in (1, 5):  # repeats within a task's words, and among tasks
        docs = spark.createDataFrame([(i, 0, t) for i, t in texts.items()], "o long, seq int, text string").repartition(parts, "o")
        met = scan(docs).cache()
        found = debruijn._paths_of(met.where("nodes IS NOT NULL").drop("so", "sseq", "sstart"))
        got = sorted((r.o, r.start, r.edges) for r in found.collect())
        edges, where = {}, {}
        for i in sorted(texts):
            w = words(texts[i])
            for s in range(len(w) - k + 1):
                e = tuple(w[s : s + k])
                edges[e] = edges.get(e, 0) + 1
                where.setdefault(e, (i, s))
        graph = {e for e, n in edges.items() if n > 1}
        ins, outs = {}, {}
        for e in graph:
            outs.setdefault(e[:-1], set()).add(e)
            ins.setdefault(e[1:], set()).add(e)
        branch = {n for n in {*ins, *outs} if len(ins.get(n, ())) > 1 or len(outs.get(n, ())) > 1}
        assert branch == {("c", "d", "e")}
        want = []
        for i, s in sorted(where[e] for e in graph):
            node = tuple(words(texts[i])[s : s + k - 1])
            if want and want[-1][0] == i and sum(want[-1][1:]) == s and node not in branch:
                want[-1][2] += 1
            else:
                want.append([i, s, 1])
        assert got == [tuple(x) for x in want] and (0, 0, 2) in got and (0, 2, 2) in got
        pieces = debruijn._pieces(debruijn._compacted(met.where("nodes IS NULL").drop("nodes")), found, k)
        assert sorted((r.o, r["at"], r.so, r.a, r.b) for r in pieces.where("o = 1").collect()) == [(1, 1, 0, 0, 2), (1, 3, 0, 2, 7)]


def test_a_passage_in_a_third_of_all_documents(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) + (" " + passage if i % 3 == 0 else "")) for i in range(3000)]
    out, names = debruijn.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), keep_text=False)
    got = {r.doc_id: r[names[1]] for r in out.collect()}
    assert got == {i: 60 if i % 3 == 0 and i else 0 for i in range(3000)}
