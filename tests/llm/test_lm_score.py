import collections
import math
import re
import zlib

import public_tokenizers as P
import pytest

from docugauge.llm import lattice, lm_score

TEXTS = ["The cat sat", "the cat the dog", "", None, "naïve Größe 日本語 🙂", "x" * 300 + " tail", "a\tb\nc  d", "the the the the", "rare word here", "ﬁnal ½", "the cat sat"]


@pytest.fixture(scope="module")
def vocabulary():
    return lattice.pieces(P.path(lm_score.MODEL))


def test_lattice_like_an_enumeration(vocabulary):
    def total(text):
        if not text:
            return 1.0
        out = sum(math.exp(vocabulary.by_name[text[:n]]) * total(text[n:]) for n in range(1, min(len(text), vocabulary.longest) + 1) if text[:n] in vocabulary.by_name)
        return out + (math.exp(vocabulary.byte * len(text[0].encode())) * total(text[1:]) if text[0] not in vocabulary.by_name else 0.0)

    words = ["cat", "the", "naïve", "日本x", "a", "🙂🙂", "q" * 9, "antidis", "▁x", "z" * 70]
    got = vocabulary.words([w.encode() for w in words])
    for word, log in zip(words[:-1], got):
        assert log == pytest.approx(math.log(total(lattice.MARK + word)), rel=1e-9)
    assert got[-1] == pytest.approx(vocabulary.alone("z" * 70)) and vocabulary.words([]).tolist() == []
    mass = sum(math.exp(s) for s in vocabulary.scores) + 256 * math.exp(vocabulary.byte) + math.exp(vocabulary.end)
    assert mass == pytest.approx(1.0)


@pytest.mark.parametrize("head", [1_000_000, 2, 0])
def test_like_brute_force(spark, vocabulary, head):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "null id"), (2, "repeated id")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [None]) for i, t in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, ws in tokens if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    log = lambda w: vocabulary.end if w is None else vocabulary.alone(w)
    want = sorted((-1 if i is None else i, out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6), round(sum(math.log10(c[w] + v * math.exp(log(w))) if c[w] else math.log10(v) + log(w) / math.log(10) for w in ws) - len(ws) * math.log10(n + v), 6)) for i, ws in tokens)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm_score.scored(docs, head=head).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], abs=1e-5)


def test_nothing_to_train_on(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm_score.scored(spark.createDataFrame([(held, "the cat")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and r.score < 0
    assert lm_score.scored(spark.createDataFrame([], "doc_id long, text string")).collect() == []
