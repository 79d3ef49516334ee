"""Language ID by Bayesian fusion of evidence.

Four sources speak for each language: the text, by a trigram model; the language that the markup
declares; the end of the address; and what its host is known for. The host's prior is smoothed towards
its domain's, and that towards the corpus's: counts of expected languages, summed by a grouped
aggregation over all rows, with the row's own share taken out again. Sums per host are stored and
joined back, so a host with a third of all rows is split like any other.

    log P(language | all) = tau * log P(text) + log P(declared) + log P(address) + log P(language | host)

Trigrams of one text are far from independent, so beyond EVIDENCE of them tau shrinks the text's voice
to that many. The trigram model is fitted on at most SAMPLE labelled texts, in equal parts for each
language, by order of a hash, of at most SAMPLE_CHARS characters each; all else covers every row and whole
texts. The table of languages must be small: one row each.

A text without any letter is rejected, as is one whose best language has a probability below LEAST, and
one most of whose trigrams no labelled text held (beyond UNSEEN of them): it is of no known language or
script, however likely one of them is against the others.
Null and empty texts are rejected, whatever is declared. Null or unknown declarations, addresses and
hosts say nothing; rows without a host share the corpus's prior. Ties go to the language first in
alphabetical order. Repeated rows are judged alike. Without labelled rows there is no language and all
is rejected. Other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docugauge.llm import scan
from docugauge.llm.frames import discard, fresh, let, some, stored

SAMPLE, SAMPLE_CHARS = 2000, 4000
#: Trigrams that a text counts for, the share of right declarations and addresses, pseudo-counts of a prior, and the least probability.
EVIDENCE, TRUST, ADDRESS_TRUST, STRENGTH, LEAST = 60.0, 0.9, 0.8, 5.0, 0.5
#: Trigrams that no labelled text held, beyond as many that one did.
UNSEEN = 10
_BUCKETS = 1 << 15
#: Ends of addresses that name a language.
SUFFIXES = {"at": "de", "de": "de", "es": "es", "fr": "fr", "ie": "en", "it": "it", "mx": "es", "nl": "nl", "pl": "pl", "pt": "pt", "uk": "en", "us": "en"}

_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 0x20
_lower[list(range(0x21)) + list(range(0x30, 0x3A)) + [0x7F]] = 0x20
#: What no word holds counts as a space, so marks strewn over a text say nothing.
_lower[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x20
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xF5)]] = True


def trigrams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams that end at each byte, and which of them count: those that don't end with two spaces. Spaces go before each start."""
    x = _lower[data].astype(np.uint32)
    one, two = np.full(len(x), 0x20, dtype=np.uint32), np.full(len(x), 0x20, dtype=np.uint32)
    one[1:], two[2:] = x[:-1], x[:-2]
    for before, at in ((one, starts), (two, starts), (two, starts + 1)):
        before[at[at < len(x)]] = 0x20
    code = (two << np.uint32(16)) | (one << np.uint32(8)) | x
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32), (one != 0x20) | (x != 0x20)


class Model:
    """Log probabilities of trigrams by language."""

    def __init__(self, texts: list[tuple[str, str]]) -> None:
        self.languages = sorted({lang for lang, _ in texts})
        counts = np.full((len(self.languages), _BUCKETS), 0.1)
        for lang, text in texts:
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            if len(data):
                bucket, good = trigrams(data, np.zeros(1, np.int64))
                counts[self.languages.index(lang)] += np.bincount(bucket[good], minlength=_BUCKETS)
        self.seen = counts.max(axis=0, initial=0) > 0.5
        self.logs = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)

    def evidence(self, part: scan.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihoods, a row for each text; and whether it has a letter and is of a known kind."""
        bucket, good = trigrams(part.data, part.ends[:-1])
        ends = part.ends
        sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.float64)))[ends])
        n = sums(good)
        tau = np.minimum(1.0, EVIDENCE / np.maximum(n, 1.0))
        logs = np.stack([sums(np.where(good, log[bucket], 0)) * tau for log in self.logs], axis=1) if len(self.logs) else np.zeros((part.rows, 0))
        return logs, (sums(_LETTER[part.data]) > 0) & (2 * sums(good & ~self.seen[bucket]) <= n + UNSEEN)


def fitted(labelled: DataFrame, lang: str = "lang", text: str = "text", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """Fits on at most so many texts, as many of each language; fewer where a language has fewer."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.substring(text, 1, chars).alias("t"))
    languages = known.select("l").distinct().count()
    rows = some(known, ["l", "t"], max(1, sample // max(1, languages)), within="l")
    return Model([(r.l, r.t) for r in rows.collect()])


_OPEN = re.compile(rb"(?i)<(?:(script|style)\b|!--)?")
_ENDS = {b"script": re.compile(rb"(?i)</script\s*>"), b"style": re.compile(rb"(?i)</style\s*>"), None: re.compile(rb"-->")}


def plain(html: bytes) -> bytes:
    """The text of a page, roughly: what is outside tags, scripts, styles and comments.

    What is never closed is a tag, or text. Each kind of end is looked for once past each place, and no more
    where there is none, so time is in proportion to the page.
    """
    out, at, ends = [], 0, {}

    def end_of(kind: bytes | None, after: int) -> int:
        """Where the next end of a kind ends, -1 if there is none."""
        begin, end = ends.get(kind, (0, 0))
        if end >= 0 and begin < after:
            found = _ENDS[kind].search(html, after)
            ends[kind] = begin, end = found.span() if found else (after, -1)
        return end

    while found := _OPEN.search(html, at):
        kind = (found[1] or b"").lower() or None
        end = end_of(kind, found.end()) if kind or found[0] == b"<!--" else -1
        if end < 0:
            end = html.find(b">", found.start()) + 1
        if not end:
            break
        out += (html[at : found.start()], b" ")
        at = end
    return b"".join([*out, html[at:]])


def declared_language(html: Column) -> Column:
    """The main language of the markup's lang attribute, in lower case; null if there is none."""
    found = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^<>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    return F.when(found != "", found)


def host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def address_language(url: Column) -> Column:
    """The language that the host's last label stands for, or else a first path segment that is a language's code."""
    table = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    last = F.try_element_at(table, F.substring_index(host(url), ".", -1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1)
    return F.coalesce(last, F.when(path != "", path))


def _without_markup(part: scan.Slice) -> scan.Slice:
    texts = [plain(part.text(i)) for i in range(part.rows)]
    ends = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return scan.Slice(np.frombuffer(b"".join(texts), dtype=np.uint8), ends, part.first)


def _scanner(model: Model, at: int, names: list[str], html: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in scan.slices(batch.column(at), scan.SLICE // 2):
                texts = _without_markup(part) if html else part
                logs, letters = model.evidence(texts)
                size = logs.shape[1]
                held = pa.ListArray.from_arrays(pa.array(np.arange(part.rows + 1, dtype=np.int32) * size), pa.array(logs.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.slice(part.first, part.rows).select(names[:-2]).columns, held, pa.array(letters)], names=names)

    return run


def identified(rows: DataFrame, model: Model, *, text: str, declared: Column, address: Column, host: Column, html: bool = False, least: float = LEAST, keep_text: bool = True) -> tuple[DataFrame, list[str]]:
    """rows with the language (null if rejected), its probability, and whether it is accepted; and those three names.

    Texts are scanned once; what they say is stored with the rows. keep_text False: the texts aren't, and don't come back.
    """
    languages = model.languages
    says, ends, home, logs, letters, own, prior, joint = fresh(rows, "declared", "address", "host", "logs", "letters", "own", "prior", "joint")
    out_names = fresh(rows, "language", "probability", "accepted")
    if not languages:
        return rows.withColumns(dict(zip(out_names, (F.lit(None).cast("string"), F.lit(0.0), F.lit(False))))), out_names
    base = rows.withColumns({says: declared, ends: address, home: host})
    schema = T.StructType([*(f for f in base.schema.fields if keep_text or f.name != text), T.StructField(logs, T.ArrayType(T.DoubleType())), T.StructField(letters, T.BooleanType())])
    col = lambda n: F.col(f"`{n}`")

    def voices(c: str, trust: float, lang: str) -> Column:
        right, wrong = np.log(trust), np.log((1 - trust) / max(1, len(languages) - 1))
        return F.when(col(c).isin(languages), F.when(col(c) == lang, F.lit(float(right))).otherwise(F.lit(float(wrong)))).otherwise(F.lit(0.0))

    fused = F.array(*[col(logs)[i] + voices(says, TRUST, lang) + voices(ends, ADDRESS_TRUST, lang) for i, lang in enumerate(languages)])
    held = stored(base.mapInArrow(scan.tidy(_scanner(model, base.columns.index(text), schema.names, html)), schema), "evidence")
    with_own = held.withColumn(logs, fused).withColumn(own, _softmax(col(logs)))
    narrow = F.when(col(home).isNotNull() & col(letters), col(own))
    hosts = with_own.select(col(home).alias("host"), narrow.alias("p")).where("p IS NOT NULL").groupBy("host").agg(*[F.sum(F.col("p")[i]).alias(f"n{i}") for i in range(len(languages))])
    hosts = stored(hosts, "hosts")
    domain = F.array_join(F.slice(F.split("host", r"\."), -F.least(F.lit(2), F.size(F.split("host", r"\."))), 2), ".")
    counts = F.array(*[F.col(f"n{i}") for i in range(len(languages))])
    domains = stored(hosts.withColumn("domain", domain).groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"d{i}") for i in range(len(languages))]), "domains")
    total = domains.agg(*[F.coalesce(F.sum(f"d{i}"), F.lit(0.0)) for i in range(len(languages))]).first()
    sums = stored(hosts.withColumn("domain", domain).join(domains, "domain").select(F.col("host").alias(home), counts.alias(prior), F.array(*[F.col(f"d{i}") for i in range(len(languages))]).alias(joint)), "priors")
    discard(hosts)
    discard(domains)
    everything = F.array(*[F.lit(float(x)) for x in total])
    met = with_own.join(sums, home, "left")
    zero = F.array(*[F.lit(0.0) for _ in languages])
    mine = F.when(col(home).isNotNull() & col(letters), col(own)).otherwise(zero)

    def without(x: Column) -> Column:
        return F.zip_with(F.coalesce(x, zero), mine, lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def smoothed(x: Column, towards: Column) -> Column:
        return let(x, lambda k: let(F.aggregate(k, F.lit(0.0), lambda a, b: a + b), lambda n: F.zip_with(k, towards, lambda a, b: (a + STRENGTH * b) / (n + STRENGTH))))

    even = F.array(*[F.lit(1.0 / len(languages)) for _ in languages])
    by_host = smoothed(without(col(prior)), smoothed(without(col(joint)), smoothed(without(everything), even)))
    post = _softmax(F.zip_with(col(logs), by_host, lambda a, b: a + F.log(b)))
    met = met.withColumn(joint, post)
    best = F.array_max(col(joint))
    good = col(letters) & (best >= least)
    lang = F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position(col(joint), best).cast("int"))
    out = met.select(*[col(c) for c in rows.columns if keep_text or c != text], F.when(good, lang).alias(out_names[0]), F.when(good, F.round(best, 6)).otherwise(F.lit(0.0)).alias(out_names[1]), good.alias(out_names[2]))
    return out, out_names


def _softmax(logs: Column) -> Column:
    """Of an array of logarithms."""
    raised = let(logs, lambda x: let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))))
    return let(raised, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda v: v / total)))
