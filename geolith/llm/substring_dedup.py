"""Substring dedup by a relative Lempel-Ziv parse of the documents against all reference blocks.

Words are what stands between blanks (0x20, 0x09-0x0D). The corpus, in ascending doc_id order, is its
own reference. It is dealt into reference blocks, and three passes over the dealt texts (one shuffle
of them, read three times) do the parse:

1. *Index.* Of every ``window`` of words the smallest hash of its ``ANCHOR``-word sequences is its
   anchor, so equal windows have equal anchors. Each block hands in its distinct anchors; those that
   occur twice anywhere go back to the documents that hold them.
2. *Sources.* Windows at known anchors are hashed whole (96 bits) and indexed by position: inside a block all but the
   first of equal windows point to the first at once; the first of each block meets the other blocks'
   firsts, and all but the earliest point to that. A frequent window so costs one row per block, however often it occurs.
3. *Factors.* A document is parsed greedily from the left: a factor (start, length, source document, source start) begins
   at the first window that has a source and goes on for as long as the next window's source is the next one
   of the same document. Where the source changes, the next factor begins at the first window that the last one
   does not hold, so the two overlap: every window across the joint is tested, and joints hide nothing. Factors
   have at least ``window`` words; they are the duplicate spans.

The earliest occurrence is the one with the smaller doc_id, or in the same document the earlier start.

Edge cases: a null text has no words; a text shorter than a window keeps all its words; texts of any
length are parsed whole; rows that share a doc_id (or have none; those come first) are documents of their own, in order of a
hash of their text, and repeated rows among them follow one another as one document; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import id_and_text, pieces, shuffle_partitions

WINDOW = 20
ANCHOR = 8
#: Words that a block gathers before it hands in what it has.
BLOCK_WORDS = 3_000_000
_SLICE = 1 << 20  # bytes that are hashed at a time
_MIXED_FROM = 16  # values whose hash is mixed before it becomes part of a longer one
_NO_ID = -(1 << 63)

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_VALUES = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASES = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xF1357AEA2E62A9C5], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word: a value of its own for each byte at each place of a word, mixed before it is added up, so that no pattern of bytes cancels out."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + _SLICE)
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        b = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.concatenate([[False], ~_BLANK[b], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        values = _BYTE_VALUES[b]
        heads = np.concatenate([[0], starts])
        place = np.arange(len(b), dtype=np.uint64) - np.repeat(heads, np.diff(np.append(heads, len(b)))).astype(np.uint64)
        place *= _STEP
        values += place
        values ^= values >> np.uint64(32)
        values *= np.uint64(0xBF58476D1CE4E5B9)
        values ^= values >> np.uint64(29)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        out.append(_mixed(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _rolled(h: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A hash of every run of ``size`` values."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    powers, have = {1: h}, 1
    factors = {1: base}
    while have * 2 <= size:
        left = _mixed(powers[have]) if have >= _MIXED_FROM else powers[have]  # else long patterns of two values cancel out
        powers[have * 2] = left[:-have] * factors[have] + left[have:]
        factors[have * 2] = np.uint64(pow(int(factors[have]), 2, 1 << 64))
        have *= 2
    out, length = powers[have], have
    for part in sorted((p for p in powers if p != have), reverse=True):
        if length + part <= size:
            n = len(h) - length - part + 1
            out = out[:n] * factors[part] + powers[part][length : length + n]
            length += part
    return _mixed(out)


def _least(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of every run of ``size`` values, and the place of its first occurrence in the run."""
    at = np.arange(len(x), dtype=np.int32)

    def smaller(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        left = x[:n] <= x[step : step + n]
        return np.where(left, x[:n], x[step : step + n]), np.where(left, at[:n], at[step : step + n])

    have = 1
    while have * 2 <= size:
        x, at = smaller(have, len(x) - have)
        have *= 2
    return smaller(size - have, len(x) - (size - have)) if have < size else (x, at)


Doc = tuple[int, int]  # id, and hash of the text: one document, in this order


class _Block:
    """Texts of one partition in ascending order of their documents, gathered up to BLOCK_WORDS words."""

    def __init__(self, window: int):
        self.window, self.last, self.offset = window, None, 0
        self.clear()

    def clear(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.docs: list[Doc] = []
        self.offsets: list[int] = []
        self.words = 0

    def skip(self, doc: Doc, n: int) -> int:
        """The place of a row of n words in its document."""
        at = self.offset if doc == self.last else 0
        self.last, self.offset = doc, at + n
        return at

    def add(self, doc: Doc, hashes: np.ndarray) -> None:
        at = self.skip(doc, len(hashes))
        if len(hashes) >= self.window:
            self.hashes.append(hashes)
            self.docs.append(doc)
            self.offsets.append(at)
            self.words += len(hashes)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All word hashes; of each window its first word's place there, its document (id, hash), and its start in the document."""
        counts = np.array([len(h) for h in self.hashes], np.int64)
        inside = counts - self.window + 1
        rows = np.repeat(np.arange(len(counts)), inside)
        within = np.arange(len(rows)) - np.repeat(np.cumsum(inside) - inside, inside)
        firsts = np.repeat(np.cumsum(counts) - counts, inside) + within
        return np.concatenate(self.hashes), firsts, np.array(self.docs, np.int64)[rows], within + np.array(self.offsets, np.int64)[rows]


def _anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window: its anchor and the place of that."""
    anchor = min(ANCHOR, window)
    return _least(_rolled(hashes, anchor, _BASES[0]), window - anchor + 1)


def _batch(schema: str, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[f.split()[0] for f in schema.split(", ")])


ANCHOR_SCHEMA = "value long, doc long, th long, kind byte"
#: Once in its block; more than once, for the meeting by value; more than once, for its document only.
_ONCE, _OFTEN, _KNOWN = 0, 1, 2


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    changed = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        changed |= c[1:] != c[:-1]
    return np.concatenate([np.ones(min(1, len(columns[0])), bool), changed])


def _anchor_rows(block: _Block) -> pa.RecordBatch:
    hashes, firsts, docs, _ = block.windows()
    values, places = (x[firsts] for x in _anchors(hashes, block.window))
    change = _starts(places)
    values, docs = values[change], docs[change]
    order = np.lexsort((docs[:, 1], docs[:, 0], values))
    values, docs = values[order], docs[order]
    fresh = _starts(values)
    group = np.cumsum(fresh) - 1
    often = np.diff(np.concatenate([np.flatnonzero(fresh), [len(values)]])) > 1
    first_of_doc = _starts(values, docs[:, 0], docs[:, 1])
    kind = np.where(fresh, np.where(often[group], _OFTEN, _ONCE), _KNOWN).astype(np.int8)
    return _batch(ANCHOR_SCHEMA, values[first_of_doc].view(np.int64), docs[first_of_doc, 0], docs[first_of_doc, 1], kind[first_of_doc])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, hash), text, and the third column's value of rows id, th, text, ..."""
    for batch in pieces(batches, 2):
        more = batch.column(3) if batch.num_columns > 3 else [None] * len(batch)
        for i, th, text, x in zip(*(batch.column(k).to_pylist() for k in range(3)), more, strict=True):
            yield (i, th), text, x


def _index(window: int, block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(window)
        for doc, text, _ in _texts(batches):
            block.add(doc, word_hashes(text.encode()))
            if block.words >= block_words:
                yield _anchor_rows(block)
                block.clear()
        if block.words:
            yield _anchor_rows(block)

    return run


def _gathered(batches: Iterator[pa.RecordBatch], n: int) -> list[np.ndarray] | None:
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns[:n]] for b in batches]
    return [np.concatenate([p[i] for p in parts]) for i in range(n)] if parts else None


def _repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc, th, value`` of the anchors that occur more than once."""
    if (cols := _gathered(batches, 4)) is None:
        return
    values, docs, ths, kind = cols
    known = kind == _KNOWN
    unique, place = np.unique(values[~known], return_inverse=True)
    twice = np.bincount(place, weights=1 + (kind[~known] == _OFTEN), minlength=len(unique)) > 1
    keep = known.copy()
    keep[~known] = twice[place]
    yield _batch("doc long, th long, value long", docs[keep], ths[keep], values[keep])


#: A window, or (``runs``) the packed copies that a block has found for the documents of part ``hash``.
WINDOW_SCHEMA = "hash long, more int, doc long, th long, start long, runs binary"
#: Columns of a packed factor: document, its start and number of windows, source document and start there.
_FACTOR = 7
_BYTES = zstandard.ZstdCompressor(level=1)


def _packed(rows: np.ndarray) -> bytes:
    """Rows of whole numbers as differences from row to row, column by column."""
    return _BYTES.compress(np.diff(rows, axis=0, prepend=np.zeros((1, rows.shape[1]), np.int64)).T.astype("<i8").tobytes())


def _unpacked(data: bytes, columns: int = _FACTOR) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), "<i8").reshape(columns, -1), axis=1).T


def _factors(rows: np.ndarray) -> np.ndarray:
    """Runs in order of document and start, joined where both sides go on: greedy factors."""
    doc, th, start, n, s_doc, s_th, s_start = rows.T
    goes_on = ~_starts(doc, th)
    for x, y in ((start, start + n), (s_start, s_start + n), (s_doc, s_doc), (s_th, s_th)):
        goes_on[1:] &= x[1:] == y[:-1]
    heads = np.flatnonzero(~goes_on)
    out = rows[heads].copy()
    out[:, 3] = np.add.reduceat(n, heads) if len(heads) else n
    return out


def _by_part(rows: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """The rows, packed for each part of the documents."""
    part = (_mixed(rows[:, 0].view(np.uint64) ^ _mixed(rows[:, 1].view(np.uint64))) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0], part))
    rows, part = rows[order], part[order]
    heads = np.flatnonzero(_starts(part))
    for p, own in zip(part[heads].tolist(), np.split(rows, heads[1:]), strict=True):
        yield p, _packed(_factors(own))


def _window_rows(block: _Block, known: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    hashes, firsts, docs, starts = block.windows()
    at = np.isin(_anchors(hashes, block.window)[0][firsts], np.unique(np.concatenate(known)).view(np.uint64))
    firsts, docs, starts = firsts[at], docs[at], starts[at]
    if not len(firsts):
        return
    full = _rolled(hashes, block.window, _BASES[1])[firsts]
    more = (_rolled(hashes, block.window, _BASES[2])[firsts] >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((more, full))  # stable, and the block's windows are in order of document and start
    head = _starts(full[order], more[order])
    source = np.empty(len(full), np.int64)
    source[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    copy = np.flatnonzero(source != np.arange(len(full)))
    own = np.flatnonzero(source == np.arange(len(full)))
    yield _batch(WINDOW_SCHEMA, full[own].view(np.int64), more[own].view(np.int32), docs[own, 0], docs[own, 1], starts[own], pa.nulls(len(own), pa.binary()))
    if len(copy):
        found = np.column_stack([docs[copy], starts[copy], np.ones(len(copy), np.int64), docs[source[copy]], starts[source[copy]]])
        sent = [*_by_part(found, parts)]
        zeros = np.zeros(len(sent), np.int64)
        yield _batch(WINDOW_SCHEMA, np.array([p for p, _ in sent], np.int64), zeros.astype(np.int32), zeros, zeros, zeros, pa.array([x for _, x in sent], pa.binary()))


def _match(window: int, block_words: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known = _Block(window), []
        for doc, text, values in _texts(batches):
            if not values.is_valid:
                block.skip(doc, len(text.encode().split()))
                continue
            block.add(doc, word_hashes(text.encode()))
            known.append(values.values.to_numpy())
            if block.words >= block_words:
                yield from _window_rows(block, known, parts)
                block.clear()
                known.clear()
        if block.words:
            yield from _window_rows(block, known, parts)

    return run


def _sources(parts: int):
    """``part, found``: what has a source, packed, one row for each part of the documents and each packed run that came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            packed = batch.filter(batch.column(5).is_valid())
            if len(packed):
                yield pa.RecordBatch.from_arrays([packed.column(0).cast(pa.int32()), packed.column(5)], names=["part", "found"])
            held.append(batch.filter(batch.column(5).is_null()))
        if (cols := _gathered(held, 5)) is None:
            return
        full, more, doc, th, start = cols
        order = np.lexsort((start, th, doc, more, full))
        head = _starts(full[order], more[order])
        source = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
        later, source = order[~head], source[~head]
        if len(later):
            found = np.column_stack([doc[later], th[later], start[later], np.ones(len(later), np.int64), doc[source], th[source], start[source]])
            sent = [*_by_part(found, parts)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in sent], pa.int32()), pa.array([x for _, x in sent], pa.binary())], names=["part", "found"])

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc, th, factors``: all factors of each document of the parts that this task got, one row a document."""
    by_part: dict[int, list[bytes]] = {}
    for b in batches:
        for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by_part.setdefault(p, []).append(x)
    for packed in by_part.values():
        rows = np.concatenate([_unpacked(x) for x in packed])
        rows = _factors(rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))])
        heads = np.flatnonzero(_starts(rows[:, 0], rows[:, 1]))
        out = [_packed(p) for p in np.split(np.ascontiguousarray(rows[:, 2:]), heads[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(rows[heads, 0]), pa.array(rows[heads, 1]), pa.array(out, pa.binary())], names=["doc", "dth", "factors"])


def _factors_of(n: int, offset: int, window: int, factors: bytes | None) -> list[tuple[int, int, int, int]]:
    """(start, end, source id, source start) in words of a row of n words that starts at ``offset`` of its document."""
    if not factors or n < window:
        return []
    start, count, s_doc, _, s_start = _unpacked(factors, _FACTOR - 2).T
    low, high = np.maximum(start, offset), np.minimum(start + count, offset + n - window + 1)  # the row's own windows
    mine = low < high
    ends = high + window - 1 - offset
    return list(zip(*(x[mine].tolist() for x in (low - offset, ends, s_doc, s_start + low - start)), strict=True))


def _parsed(window: int, finish, schema: str):
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.string() if "string" in f else pa.int64() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(window)
        for batch in pieces(batches, 2):
            out = []
            for doc, text, factors in _texts(iter([batch])):
                words = text.encode().split()
                out += finish(None if doc[0] == _NO_ID else doc[0], words, _factors_of(len(words), block.skip(doc, len(words)), window, factors.as_py()))
            cols = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


DIGEST_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
SPAN_SCHEMA = "doc_id long, start long, n_words long"
FACTOR_SCHEMA = "doc_id long, start long, n_words long, source_id long, source_start long"
TEXT_SCHEMA = "doc_id long, text string"


def _kept(words: list[bytes], factors: list[tuple]) -> list[bytes]:
    keep = np.ones(len(words), bool)
    for a, b, *_ in factors:
        keep[a:b] = False
    return words if keep.all() else [words[i] for i in np.flatnonzero(keep)]


def _digest(doc, words, factors):
    kept = _kept(words, factors)
    return [(doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())]


def _spans(doc, words, factors):
    out: list[list[int]] = []
    for a, b, *_ in factors:
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(doc, a, b - a) for a, b in out]


def _sourced(doc, words, factors):
    return [(doc, a, b - a, None if s == _NO_ID else s, at) for a, b, s, at in factors]


def _text(doc, words, factors):
    return [(doc, b" ".join(_kept(words, factors)).decode())]


def _parse(docs: DataFrame, finish, schema: str, window: int, block_words: int, id_col: str, text_col: str) -> DataFrame:
    parts = shuffle_partitions(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col).select(F.coalesce("id", F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("th"), "text")
    texts = texts.repartition(parts, "id", "th").sortWithinPartitions("id", "th", "text")

    def of(other: DataFrame, what: str) -> DataFrame:
        """The texts with what is known of their documents, where they are."""
        return texts.join(other, (F.col("id") == F.col("doc")) & (F.col("th") == F.col("dth")), "left").select("id", "th", "text", what)

    anchors = texts.mapInArrow(_index(window, block_words), ANCHOR_SCHEMA)
    known = anchors.repartition(parts, F.when(F.col("kind") == _KNOWN, F.xxhash64("doc", "th")).otherwise(F.col("value")))
    known = known.mapInArrow(_repeated_anchors, "doc long, th long, value long").toDF("doc", "dth", "value").groupBy("doc", "dth").agg(F.collect_list("value").alias("values"))
    windows = of(known, "values").mapInArrow(_match(window, block_words, parts), WINDOW_SCHEMA)
    runs = windows.repartition(parts, "hash").mapInArrow(_sources(parts), "part int, found binary")
    factors = runs.repartition(parts, "part").mapInArrow(_by_document, "doc long, dth long, factors binary")
    return of(factors, "factors").mapInArrow(_parsed(window, finish, schema), schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text``: the words that are left, joined by one blank."""
    return _parse(docs, _text, TEXT_SCHEMA, window, block_words, id_col, text_col)


def repeated_spans(docs: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, n_words``: the duplicate spans in words of the row."""
    return _parse(docs, _spans, SPAN_SCHEMA, window, block_words, id_col, text_col)


def factors(docs: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, n_words, source_id, source_start``: each factor, in words, and where the same words stand earlier."""
    return _parse(docs, _sourced, FACTOR_SCHEMA, window, block_words, id_col, text_col)


def digest_repeats(docs: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``."""
    return _parse(docs, _digest, DIGEST_SCHEMA, window, block_words, id_col, text_col)
