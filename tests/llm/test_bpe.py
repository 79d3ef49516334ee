import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from docugauge.llm import bpe


@pytest.fixture(scope="module")
def own():
    return bpe.codec(P.path(bpe.RANKS))


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "a", "Hello world, don't they'll 'same ''t \n\n x   y\t z", "naïve Größe 日本語 🙂👩‍👩‍👧 éclair", "a" * 5000, "-" * 300 + "=" * 77, "<|endoftext|>", "\x00\x01    end", "abcabcabd" * 400, "1234567890" * 30, "ththhationblereou onthanerther"]


def test_like_tiktoken(own, theirs):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz  \n'.,ABC0189éßø日本🙂"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(500)]
    texts += ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "tion", "ing", "s"]) for _ in range(rng.randrange(60))) for _ in range(500)]
    for text in texts:
        ids = own.encode(text).tolist()
        assert ids == theirs.encode_ordinary(text)
        assert "".join(own.decode(ids, piece=3)) == text


def test_few_transitions_change_nothing(theirs):
    ranks = theirs._mergeable_ranks
    small = bpe.Transducer(ranks, most=50)
    for word in [b"understanding", b" internationalisation", b"zzzzzzzzzzqqqqq", b"xyzzy" * 40]:
        assert small.encode(word) == theirs.encode_ordinary(word.decode())
        assert small.encode(word) == (bpe.merge(word, ranks) if word not in ranks else [ranks[word]])


def test_emits_before_the_end(own):
    seen = []

    def chunks():
        for _ in range(200):
            yield b"ab1xyz"
            seen.append(len(out))

    out = []
    for token in own.transducer.stream(chunks()):
        out.append(token)
    assert seen[100] > 100 and b"".join(own.tokens[i] for i in out) == b"ab1xyz" * 200


def test_utf8_machine_by_single_bytes():
    data = "aé日🙂z".encode()
    machine = bpe.Utf8Machine()
    assert "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.close() == "aé日🙂z"
    for bad in (b"\xff", b"\xe0\x80\x80", b"\xed\xa0\x80", b"\xf4\x90", b"\xc3", b"\xf0\x9f\x99", b"a\xe2\x82b"):
        machine = bpe.Utf8Machine()
        assert "".join(machine.feed(bad[i : i + 1]) for i in range(len(bad))) + machine.close() == bad.decode("utf-8", "replace")


def test_frame_of_nulls_ties_and_other_columns(spark):
    rows = [(1, None, "x"), (2, "", None), (None, "two words", "y"), (3, "two words", "y"), (3, "two words", "y"), (4, "é" * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    out = bpe.digests(docs).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(out) == 6 and [r.n_tokens for r in out][:5] == [0, 0, 2, 2, 2] and out[0].ids_sha256 == out[1].decoded_sha256 == empty
    assert out[5].decoded_sha256 == hashlib.sha256(("é" * 3000).encode()).hexdigest() and out[5].n_words == "z"
    assert bpe.digests(docs.limit(0)).collect() == []
    clash = bpe.digests(docs.withColumnRenamed("n_words", "N_Tokens"))
    assert clash.columns[-3:] == ["_n_tokens", "ids_sha256", "decoded_sha256"] and clash.collect()[2]["_n_tokens"] == 2
    back = bpe.decoded(bpe.encoded(docs)).collect()
    assert [r.decoded for r in back] == [r.text or "" for r in back]


def test_slices_like_the_tiktoken_library():
    """What the queries call: texts in slices, cut into parts that are remembered."""
    import random

    import pyarrow as pa
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    from docugauge.llm import scan

    path = bpe.public_tokenizers.path(bpe.RANKS)
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    rng = random.Random(11)
    pieces = ["'s", "'LL", " ", "  ", "a", "Zebra", "9", "1234", ".", "...", "\n", "\r\n", "\t", "é", "ß", "×", "\u00a0", "\u3000", "日本語", "한국", "🙂", "<|endoftext|>", "don't", "\x85", "𝒳"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(3000)] + [None, "", " ", "日本" * 3000, "a" * 5000, " \n " * 500]
    own = bpe.Codec(path)
    own.by_parts.most = 30_000
    for part in scan.slices(pa.array(texts), 20_000):
        ids, ends = own.encode_slice(part)
        for i, pieces_of in enumerate(own.decode_slice(ids, ends, 7)):
            text = texts[part.first + i] or ""
            assert ids[ends[i] : ends[i + 1]].tolist() == library.encode_ordinary(text), repr(text)
            assert "".join(pieces_of) == text


def test_transitions_are_cleared_within_a_match():
    own = bpe.codec(bpe.public_tokenizers.path(bpe.RANKS)).transducer
    small = bpe.Transducer(own.ranks, most=40)
    text = ("lorem ipsum dolor sit amet " * 40).encode() + bytes(range(256)) * 3
    assert list(small.stream([text[:100], text[100:]])) == own.encode(text) and len(small.moves) <= 41
