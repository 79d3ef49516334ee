import random
import re

import corpus_pipeline
from docugauge.llm import bpe

EN = "the and of to in that is was for with his they are this have from one had word but what some we can out other were all there when use your how said each she which their time will way about many then them".split()


def sentence(rng, n, tag):
    return " ".join(rng.choice(EN) if rng.random() < 0.6 else f"{rng.choice(EN)}{rng.choice(EN)}" for _ in range(n)) + f" {tag}"


def test_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(12)
    clean = {i: sentence(rng, 120, f"tail{i}") for i in range(30)}
    passage = sentence(rng, 60, "shared")
    item = sentence(rng, 40, "question")
    docs = dict(clean)
    docs[100] = clean[3]  # an exact copy
    docs[101] = clean[4].replace(" tail4", " tale4")  # a near copy
    docs[102], docs[103] = f"{sentence(rng, 80, 'a')} {passage}", f"{passage} {sentence(rng, 80, 'b')}"
    docs[104] = f"{sentence(rng, 100, 'c')} {item}"
    docs[105], docs[106] = "12345 67890 ### %%%", None
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "extra") for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, o string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        columns, held = held.columns, corpus_pipeline.stored(stage(spark, held, str(tmp_path)), name)
        kept[name] = {r.doc_id: r for r in held.collect()}
        assert name == "byte_bpe" or held.columns == columns
    everything = set(docs)
    assert set(kept["language_id"]) == everything - {105, 106}
    assert set(kept["near_duplicates"]) == everything - {105, 106, 100, 101}
    left = kept["repeated_spans"]
    assert left[102].text == docs[102] and "shared" not in left[103].text and left[103].n_chars == len(left[103].text) and left[5].text == docs[5]
    assert set(kept["decontamination"]) == everything - {105, 106, 100, 101, 104}
    last = kept["byte_bpe"]
    assert set(last) == set(kept["decontamination"]) and all(r.round_trip and r.n_tokens == len(r.ids) for r in last.values())
    own = bpe.codec(bpe.public_tokenizers.path(bpe.RANKS))
    assert list(last[5].ids) == own.encode(docs[5]).tolist()
    whole = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {i: list(r.ids) for i, r in last.items()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, accepted):
    """The texts that each stage keeps, by id; accepted: what language ID says, which has a brute-force test of its own."""
    now = {i: t for i, t in docs.items() if i in accepted}
    stages = [dict(now)]
    sets = {}
    for i, t in now.items():
        w = words(lowered(t))
        sets[i] = {tuple(w[s : s + 5]) for s in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in now}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    now = {i: t for i, t in now.items() if find(i) == i}
    stages.append(dict(now))
    first = {}
    for i in sorted(now):
        w = words(now[i])
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    left = {}
    for i, t in now.items():
        w, gone = words(t), set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (i, s):
                gone |= set(range(s, s + 20))
        if not gone or len(gone) < len(w):
            left[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
    stages.append(dict(left))
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = {tuple(w[s : s + min(13, len(w))]) for w in map(alnum, items) if w for s in range(max(1, len(w) - 12))}
    clean = {}
    for i, t in left.items():
        w, hit = alnum(t), set()
        for g in windows:
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
        if not (hit and 20 * len(hit) >= len(w)):
            clean[i] = t
    stages.append(clean)
    return stages


def test_like_brute_force(spark, tmp_path):
    rng = random.Random(21)
    shared = [sentence(rng, n, f"end{n}") for n in (12, 25, 70)]
    items = [sentence(rng, n, "ask") for n in (5, 14, 30)]
    docs = {}
    for i in range(70):
        kind = rng.random()
        if kind < 0.25 and docs:
            w = words(docs[rng.choice(list(docs))])
            for _ in range(rng.randrange(4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(EN)
            docs[i] = " ".join(w).upper() if rng.random() < 0.1 else " ".join(w)
        else:
            parts = [sentence(rng, rng.randrange(1, 60), f"t{i}")] + [rng.choice(shared) for _ in range(rng.randrange(3))] + ([rng.choice(items)] if rng.random() < 0.3 else [])
            rng.shuffle(parts)
            docs[i] = rng.choice([" ", "\n"]).join(parts)
    docs |= {90: None, 91: "", 92: "..", 93: "the", 94: shared[2], 95: items[0]}
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        held = corpus_pipeline.stored(stage(spark, held, str(tmp_path)), name)
        kept.append(held.collect())
    accepted = {r.doc_id for r in kept[0]}
    assert accepted == {i for i, t in docs.items() if re.search("[A-Za-z]", t or "")}  # one language, so each with a letter
    for got, want in zip(kept, brute(docs, items, accepted)):
        assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    own = bpe.codec(bpe.public_tokenizers.path(bpe.RANKS))
    assert {r.doc_id: (list(r.ids), r.n_tokens, r.round_trip) for r in kept[4]} == {r.doc_id: (own.encode(r.text).tolist(), len(own.encode(r.text)), True) for r in kept[3]}
