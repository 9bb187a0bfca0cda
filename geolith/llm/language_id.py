"""Language identification: the proportions of languages in each document by expectation-maximisation over n-grams.

A document's n-grams are, for each of its letters, that letter with the characters beside it (in lower case; what is neither letter
nor mark is a blank), hashed to ``BUCKETS``.

1. *Learning.* ``learn`` counts the n-grams of each language over all documents that it may learn from; tasks hand in one row for each
   language and bucket. The model has ``BUCKETS`` probabilities a language, at most ``MAX_LANGUAGES`` languages, whatever
   the corpus: it is collected and broadcast. A language's probabilities lean towards the mean of all languages, so an n-gram
   that none has seen speaks for none.
2. *Inference.* A document's n-grams are drawn from a mixture of languages. Expectation-maximisation finds the proportions of all
   languages; then sets of one, two, ... languages in the order of these proportions are fitted alone, and a set that is larger by one
   is taken as long as the likelihood rises by more than a penalty: half the logarithm of the number of n-grams, times the ``ORDER``
   n-grams that every character is in. The language with the largest proportion of the chosen set is the prediction.

``score`` is the proportion of the predicted language; if the set has one language, it is the likelihood of that one among all
languages taken alone.

Edge cases: a null text, and one without a letter, is ``und`` with score 0 and no languages; so is every text if there is nothing to
learn from; texts of any length count whole, a million characters at a time; rows without doc_id are predicted and neither held out nor
learned from; repeated rows are predicted alike and each learned from; ties go to the language that comes first in
order of its name; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import pieces

ORDER, BUCKETS = 3, 1 << 16
MAX_LANGUAGES = 128
UNKNOWN = "und"
#: N-grams of the mean of all languages that are added to each, and the part of that mean that is spread evenly.
PRIOR, EVEN = 500.0, 0.05
ROUNDS = 12
#: What a language in a set of several needs at least.
MIN_SHARE = 0.02
#: Characters that are cut at a time, and probabilities that are held at a time.
SLICE_CHARS, BLOCK = 1 << 20, 1 << 20
#: Languages whose counts a task holds.
HELD_LANGUAGES = 16
#: Documents of this remainder of the id's CRC-32 by 4 are never learned from.
HELD_OUT = 2


@functools.lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """The character that stands for each code point: its lower case, or a blank if it is neither letter nor mark."""
    out = np.full(0x110000, ord(" "), np.uint32)
    for c in map(chr, range(0x110000)):
        if unicodedata.category(c)[0] in "LM":
            low = c.lower()
            out[ord(c)] = ord(low if len(low) == 1 else c)
    return out


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Of all letters but the first and the last character: their places, and the buckets of their n-grams."""
    c = _alphabet()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    at = np.flatnonzero(c[1:-1] != ord(" ")) + 1
    h = c[at - 1] * np.uint32(0x9E3779B1) ^ c[at] * np.uint32(0x85EBCA77) ^ c[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return at, (h >> np.uint32(16)).astype(np.int64)


def _long(text: str) -> np.ndarray:
    """How often each bucket occurs in a text of any length."""
    total = np.zeros(BUCKETS, np.int64)
    for a in range(0, len(text), SLICE_CHARS):
        b = a + SLICE_CHARS
        before, after = " " if a == 0 else "", " " if b >= len(text) else ""
        total += np.bincount(_grams(before + text[max(0, a - 1) : b + 1] + after)[1], minlength=BUCKETS)
    return total


def features(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts [a, b) and their buckets with counts, in order of the text: ``a, b, text number, bucket, count``."""
    a = 0
    while a < len(texts):
        if len(texts[a]) > SLICE_CHARS:
            count = _long(texts[a])
            bucket = np.flatnonzero(count)
            yield a, a + 1, np.full(len(bucket), a), bucket, count[bucket]
            a += 1
            continue
        b, chars = a, 0
        while b < len(texts) and chars + len(texts[b]) <= SLICE_CHARS:
            chars += len(texts[b])
            b += 1
        at, bucket = _grams("\n" + "\n".join(texts[a:b]) + "\n")
        ends = np.cumsum([len(t) + 1 for t in texts[a:b]])  # of the blank behind each
        key, count = np.unique(np.searchsorted(ends, at) * BUCKETS + bucket, return_counts=True)
        yield a, b, key // BUCKETS + a, key % BUCKETS, count
        a = b


# --- learning ---

COUNT_SCHEMA = "lang string, bucket int, n long"


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, total in held.items():
            bucket = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket), pa.string()), pa.array(bucket.astype(np.int32)), pa.array(total[bucket])], names=["lang", "bucket", "n"])
        held.clear()

    for batch in pieces(batches):
        for lang in pc.unique(batch.column(0)).to_pylist():
            texts = batch.column(1).filter(pc.equal(batch.column(0), lang)).to_pylist()
            if lang not in held and len(held) >= HELD_LANGUAGES:
                yield from rows()
            total = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for _, _, _, bucket, count in features(texts):
                np.add.at(total, bucket, count)
    yield from rows()


class Model:
    """The languages, and the probability of each bucket in each of them."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: languages x buckets."""
        self.languages = languages
        total = counts.sum(axis=1, keepdims=True, dtype=np.float64)
        mean = (counts / np.maximum(total, 1)).mean(axis=0) if len(languages) else np.zeros(BUCKETS)
        mean = (1 - EVEN) * mean / max(mean.sum(), 1e-300) + EVEN / BUCKETS
        self.p = np.ascontiguousarray(((counts + PRIOR * mean) / (total + PRIOR)).T.astype(np.float32))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all rows whose text and language are not null."""
    lang, text = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(lang.alias("lang"), text.alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(_learned, COUNT_SCHEMA).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).where("n > 0")
    # at most a row for each language and bucket; one row more than is allowed tells
    found = counts.limit(MAX_LANGUAGES * BUCKETS + 1).toArrow()
    languages = sorted(pc.unique(found["lang"]).to_pylist())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out = np.zeros((len(languages), BUCKETS), np.float64)
    number = pc.index_in(found["lang"], pa.array(languages, pa.string())).to_numpy()
    out[number, found["bucket"].to_numpy()] = found["n"].to_numpy()
    return Model(languages, out)


# --- inference ---


def _mixed(p: np.ndarray, doc: np.ndarray, starts: np.ndarray, count: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages (documents x languages), and the logarithm of each document's likelihood."""
    share = (allowed / allowed.sum(axis=1, keepdims=True)).astype(np.float32)
    n = np.add.reduceat(count, starts)[:, None]
    for _ in range(rounds):
        each = p * share[doc]
        each *= (count / each.sum(axis=1))[:, None]
        share = np.add.reduceat(each, starts, axis=0) / n
    likely = np.log(np.einsum("ij,ij->i", p, share[doc]))
    return share, np.add.reduceat((count * likely).astype(np.float64), starts)


def _chosen(model: Model, doc: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of documents 0, 1, ... that all have n-grams: the proportions of the chosen languages, and the score of the first of them."""
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    p, count = model.p[bucket], count.astype(np.float32)
    n_docs, k = len(starts), len(model.languages)
    n = np.add.reduceat(count, starts).astype(np.float64)
    alone = np.add.reduceat((count[:, None] * np.log(p)).astype(np.float64), starts, axis=0)
    best = alone.argmax(axis=1)
    share = np.zeros((n_docs, k))
    share[np.arange(n_docs), best] = 1
    among = np.exp((alone - alone.max(axis=1, keepdims=True)) / ORDER)
    score = 1 / among.sum(axis=1)
    likely = alone.max(axis=1)
    every, most = _mixed(p, doc, starts, count, np.ones((n_docs, k)), ROUNDS)
    penalty = ORDER * 0.5 * np.log(n + 1)
    order = np.argsort(-every, axis=1, kind="stable")
    open_docs = np.flatnonzero(most - likely > penalty)  # no set is likelier than all languages
    for size in range(2, k + 1):
        if not len(open_docs):
            break
        allowed = np.zeros((len(open_docs), k))
        np.put_along_axis(allowed, order[open_docs, :size], 1, axis=1)
        mine = np.isin(doc, open_docs)
        place = np.searchsorted(open_docs, doc[mine])
        heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        fitted, after = _mixed(p[mine], place, heads, count[mine], allowed, ROUNDS)
        least = np.take_along_axis(fitted, order[open_docs, size - 1 : size], axis=1)[:, 0]
        better = (after - likely[open_docs] > penalty[open_docs]) & (least >= MIN_SHARE)
        open_docs, fitted = open_docs[better], fitted[better]
        share[open_docs], likely[open_docs], score[open_docs] = fitted, after[better], fitted.max(axis=1)
    return share, score


def mixtures(model: Model, texts: list[str]) -> list[tuple[np.ndarray, float] | None]:
    """The proportions of the languages in each text and its score; None where it has no letter or there is no language."""
    out: list[tuple[np.ndarray, float] | None] = [None] * len(texts)
    if not model.languages:
        return out
    for _, _, doc, bucket, count in features(texts):
        ids, sizes = np.unique(doc, return_counts=True)
        ends = np.cumsum(sizes)
        a = 0
        while a < len(ids):
            first = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, first + BLOCK // len(model.languages), side="right")))
            own = slice(first, int(ends[b - 1]))
            share, score = _chosen(model, np.searchsorted(ids[a:b], doc[own]), bucket[own], count[own])
            for i, s, x in zip(ids[a:b].tolist(), share, score.tolist(), strict=True):
                if any(map(str.isalpha, texts[i])):
                    out[i] = s, x
            a = b
    return out


PREDICTED_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang: string, share: double>>"


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, languages`` (the chosen languages and their proportions, largest first)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value.languages
        for batch in pieces(batches):
            langs, scores, sets = [], [], []
            for found in mixtures(sent.value, batch.column(1).to_pylist()):
                share, score = found or (np.zeros(0), 0.0)
                largest = [i for i in np.argsort(-share, kind="stable").tolist() if share[i] > 0]
                langs.append(names[largest[0]] if largest else UNKNOWN)
                scores.append(min(1.0, float(score)))
                sets.append([{"lang": names[i], "share": float(share[i])} for i in largest])
            cols = [batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, kind)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "lang_pred", "score", "languages"])

    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"))
    return read.mapInArrow(run, PREDICTED_SCHEMA)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning; null where it has no id."""
    return F.crc32(F.col(f"`{id_col}`").cast("long").cast("string")) % 4 == HELD_OUT


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``predict`` for all documents by a model of those that are not held out."""
    return predict(docs, learn(docs.where(~held_out(id_col)), text_col, lang_col), id_col, text_col)
