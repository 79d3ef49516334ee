import glob
import random
import zlib

import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docugauge.llm import records, scan


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path(records.TOKENIZER))


def test_parts_like_whole_texts(library):
    rng = random.Random(3)
    texts = ["", " ", "  ", "a  b", " a", "a ", "a \nb", "a\n b", "a\n  b\t c", "x  y  z", "don't  stop  ", "<|endoftext|> a", "日本 語\r\n é", "\x85 a \x85"]
    texts += ["".join(rng.choice("ab'1é日 \n\t 　.,") for _ in range(rng.randrange(40))) for _ in range(2000)]
    texts += ["".join(rng.choice(["'s", "'", " ", "a", "Z", "9", ".", "\n", "é", "×", "÷", "à", "\u00a0", "\u2003", "\u3000", "\r", "\t", "ß", "日"]) for _ in range(rng.randrange(30))) for _ in range(4000)]
    whole = "<|endoftext|>"
    texts += [f"a {whole} b", f"a  {whole}  b", f"a\n\n{whole}\n c{whole}{whole}'s", "<|endof", "text|> x", f"{whole}é1", f" {whole} ", "<|endoftext|", f"don{whole}'t"]
    texts += ["".join(rng.choice(["a", " ", "  ", "\n", "'s", "é", "1", ".", whole, "<|", "|>"]) for _ in range(rng.randrange(12))) for _ in range(3000)]
    own = records.Encoder(P.path(records.TOKENIZER))
    own.most = 20_000  # so that parts are forgotten on the way
    for part in scan.slices(pa.array(texts), 5000):
        ids, ends = own.encode(part)
        for i in range(part.rows):
            assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(texts[part.first + i], add_special_tokens=False).ids, repr(texts[part.first + i])


def test_files_index_and_nulls(spark, tmp_path, library):
    rows = [(7, "one two"), (3, None), (None, "a null id"), (3, ""), (3, "tie"), (9, "é\nñ " * 3000), (7, "one two"), (-5, "below")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    records.write(docs, f"{tmp_path}/data", file_bytes=60)
    records.write_index(records.read(spark, f"{tmp_path}/data"), f"{tmp_path}/index")
    index = sorted(spark.read.parquet(f"{tmp_path}/index").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in index] == [None, -5, 3, 3, 3, 7, 7, 9]
    at = 0
    for r in index:
        doc, ids = records.at_offset(glob.glob(f"{tmp_path}/data/{r.file}")[0], r.offset)
        assert (doc, r.start, r.n_tokens, r.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) and ids[-1] == 0
        at += len(ids)
    left = sorted([i, library.encode(t or "", add_special_tokens=False).ids + [0]] for i, t in rows if i is not None)
    held = sorted([r.doc_id, list(r.ids)] for r in records.read(spark, f"{tmp_path}/data", ids=True).collect() if r.doc_id is not None)
    assert left == held


def test_files_follow_by_number(spark):
    names = ["part-00000-x-c999.txt", "part-00000-x-c1000.txt", "part-00001-x-c000.txt", "part-100000-x-c000.txt", "part-99999-x-c000.txt"]
    rows = [(n, 0, 10, i, 0, i + 1, 0) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "file string, offset long, bytes long, doc_id long, before long, n_tokens long, ids_crc32 long")
    assert {r.file: r.start for r in records.with_starts(df).collect()} == {names[0]: 0, names[1]: 1, names[2]: 3, names[4]: 6, names[3]: 11}


def test_long_parts_are_forgotten(library):
    own = records.Encoder(P.path(records.TOKENIZER))
    texts = [chr(0x4E00 + i % 5000) * 3 + "".join(chr(0x4E00 + (i * 7 + j * 31) % 9000) for j in range(1000)) for i in range(200)]
    for at in range(0, 200, 20):
        for part in scan.slices(pa.array(texts[at : at + 20])):
            ids, ends = own.encode(part)
            assert ids[ends[3] : ends[4]].tolist() == library.encode(texts[at + 3], add_special_tokens=False).ids
    assert own.parts.held_bytes() < 10_000


def test_a_very_long_text(spark, tmp_path):
    long = "some words and 12 more, é \n" * 1_500_000  # 40 MB
    records.write(spark.createDataFrame([(1, "a"), (2, long), (3, "b")], "doc_id long, text string").coalesce(1), str(tmp_path / "d"))
    got = records.with_starts(records.read(spark, str(tmp_path / "d"))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [1, 2, 3] and got[2].start == got[0].n_tokens + got[1].n_tokens and got[1].n_tokens > 10_000_000


def test_damage_is_found(spark, tmp_path):
    records.write(spark.createDataFrame([(1, "some text here")], "doc_id long, text string"), str(tmp_path / "d"))
    name = glob.glob(str(tmp_path / "d" / "part-*"))[0]
    data = bytearray(open(name, "rb").read())
    data[25] ^= 1
    with pytest.raises(ValueError):
        records.parse(memoryview(bytes(data)), 0)


def test_empty_table(spark, tmp_path):
    records.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "d"))
    assert records.read(spark, str(tmp_path / "d")).collect() == []
