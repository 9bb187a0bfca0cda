"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark windows.

Text is normalised byte by byte: A-Z become a-z, every other ASCII character that is not a letter or
digit becomes a blank. Words are what stands between blanks, so all non-ASCII characters belong to
words. A window is ``window`` consecutive words of an item; an item with fewer words, but not none,
is one window. The automaton's symbols are the benchmark's words, numbered (a word that no item has is 0), which takes an eighth
of the memory of one over characters. It reads each document once; match ends are word
numbers, and through them offsets in the original text (``hit_spans``).

A document is contaminated if it has a hit word and ``share`` times its hit words reach its words.

An automaton holds at most ``max_block_words`` windows (about 600 bytes each); a Python worker builds it once and keeps it. A
larger benchmark is a stated query set read in blocks: the documents pass one block after another,
of which the driver and the executors hold one at a time, and the hits of all blocks are united per text.
An item longer than a block is cut into pieces that overlap by a window.

Edge cases: a null or empty text has no words and is clean; an item without words has no window;
repeated documents are judged one by one; repeated items each count; rows with a null item_id count
as an item whose name is left out of the digest; an empty benchmark makes every document clean; an
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import fresh_names, id_and_text, pieces, stored

WINDOW = 13
SHARE = 20
MAX_BLOCK_WORDS = 400_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


#: A piece of an item: the item's number among all rows, its id, and words.
Piece = tuple[int, int | None, list[bytes]]


class Windows:
    """The automaton of one block of pieces."""

    def __init__(self, block: list[Piece], window: int):
        self.names = {number: name for number, name, _ in block}
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for number, _, words in block:
            symbols = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            for i in range(max(1, len(symbols) - window + 1) if symbols else 0):
                owners.setdefault(tuple(symbols[i : i + window]), set()).add(number)
        self.found = [(len(w), items) for w, items in owners.items()]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, w in enumerate(owners):
            self.automaton.add_word(w, i)
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word ranges [start, end), in order and apart, and the numbers of the items that occur."""
        if not self.found or not words:
            return [], set()
        number = self.numbers.get
        ranges, items = [], set()
        for last, i in self.automaton.iter(tuple([number(w, 0) for w in words])):
            n, owners = self.found[i]
            ranges.append((last + 1 - n, last + 1))
            items |= owners
        return _united(ranges), items


@functools.lru_cache(maxsize=1)
def _automaton(_: str, block: Broadcast, window: int) -> Windows:
    """One to a Python worker, which works for many tasks."""
    return Windows(block.value, window)


def _united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hit_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as [start, end) character offsets of the original text."""
    data = text.encode()
    inside = np.frombuffer(data.translate(_TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    character = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return [(int(character[starts[a]]) - 1, int(character[ends[b - 1] - 1])) for a, b in ranges]


SCAN_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, max_block_words: int = MAX_BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    texts = id_and_text(docs, id_col, text_col)
    judge, verdicts = _judge(texts, benchmark, window, share, max_block_words, item_col, item_text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, judged in judge(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), *judged], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    if verdicts is None:
        return texts.mapInArrow(run, SCAN_SCHEMA)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n = [len(words_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64())], names=["doc_id", "h1", "h2", "n_words"])

    counted = texts.select("id", "text", *_text_keys("text")).mapInArrow(count, "doc_id long, h1 long, h2 long, n_words long")
    clean = {"n_hit": F.lit(0), "n_items": F.lit(0), "items_sha256": F.sha2(F.lit(""), 256), "contaminated": F.lit(False)}
    return counted.join(verdicts, ["h1", "h2"], "left").select("doc_id", "n_words", *[F.coalesce(c, v).alias(c) for c, v in clean.items()])


def filter_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, max_block_words: int = MAX_BLOCK_WORDS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows that are not contaminated, with all their columns; each is judged where it stands."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_normal_text")
    judge, verdicts = _judge(docs.select(F.lit(0).alias("id"), text.alias("text")), benchmark, window, share, max_block_words, item_col, item_text_col)
    n, names = len(docs.columns), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, judged in judge(batches, n):
            yield pa.RecordBatch.from_arrays(batch.columns[:n], names=names).filter(pc.invert(judged[-1]))

    if verdicts is None:
        return docs.select("*", text).mapInArrow(run, docs.schema)
    h1, h2 = fresh_names(docs, "_h1", "_h2")
    keyed = docs.withColumns(dict(zip((h1, h2), _text_keys(text), strict=True)))
    return keyed.join(verdicts.where("contaminated").select(F.col("h1").alias(h1), F.col("h2").alias(h2)), [h1, h2], "left_anti").select(*docs.columns)


def _text_keys(text) -> list:
    """Two hashes of their own seeds."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _blocks(items: DataFrame, window: int, most: int) -> Iterator[list[Piece]]:
    """The items in lists of at most ``most`` windows, one list at a time on the driver."""
    held, n = [], 0
    for number, row in enumerate(items.toLocalIterator()):
        words = words_of(row.text)
        for begin in range(0, max(1, len(words) - window + 1) if words else 0, most):
            piece = words[begin : begin + most + window - 1]
            size = max(1, len(piece) - window + 1)
            if held and n + size > most:
                yield held
                held, n = [], 0
            held.append((number, row.id, piece))
            n += size
    yield held


def _digest(names: list[int | None]) -> str:
    return hashlib.sha256(",".join(sorted(str(x) for x in names if x is not None)).encode()).hexdigest()


def _judge(texts: DataFrame, benchmark: DataFrame, window: int, share: int, most: int, item_col: str, item_text_col: str):
    """With a single block: a function of batches and the place of their text column, which gives each batch with the columns of SCAN_SCHEMA behind doc_id.

    With more: the verdicts ``h1, h2, n_hit, n_items, items_sha256, contaminated`` on all texts that are hit.
    """
    context = texts.sparkSession.sparkContext
    blocks = _blocks(id_and_text(benchmark, item_col, item_text_col), window, most)
    first = next(blocks)
    second = next(blocks, None)

    def scanned(block: Broadcast, key: str):
        def scan_batches(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, Windows, list[int], list[tuple]]]:
            automaton = _automaton(key, block, window)
            for batch in pieces(batches, at):
                words = [words_of(t) for t in batch.column(at).to_pylist()]
                yield batch, automaton, [len(w) for w in words], [automaton.scan(w) for w in words]

        return scan_batches

    if second is None:
        alone = scanned(context.broadcast(first), uuid.uuid4().hex)

        def judge(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
            for batch, automaton, n_words, found in alone(batches, at):
                hits = [sum(b - a for a, b in r) for r, _ in found]
                digests = [_digest([automaton.names[x] for x in i]) for _, i in found]
                contaminated = [h > 0 and share * h >= n for h, n in zip(hits, n_words, strict=True)]
                counts = [pa.array(c, pa.int64()) for c in (n_words, hits, [len(i) for _, i in found])]
                yield batch, [*counts, pa.array(digests, pa.string()), pa.array(contaminated, pa.bool_())]

        return judge, None

    keyed, hits = texts.select("text", *_text_keys("text")), None
    rest = [first, second]
    while rest:
        block = context.broadcast(rest.pop(0))
        one = scanned(block, uuid.uuid4().hex)

        def hit_rows(batches: Iterator[pa.RecordBatch], one=one) -> Iterator[pa.RecordBatch]:
            for batch, automaton, n_words, found in one(batches, 0):
                hit = pa.array([bool(r) for r, _ in found], pa.bool_())
                some = [(r, sorted(i), n) for (r, i), n in zip(found, n_words, strict=True) if r]
                cols = [pa.array([[x for ab in r for x in ab] for r, _, _ in some], pa.list_(pa.int32())), pa.array([i for _, i, _ in some], pa.list_(pa.int64())), pa.array([[automaton.names[x] for x in i] for _, i, _ in some], pa.list_(pa.int64())), pa.array([n for *_, n in some], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(1).filter(hit), batch.column(2).filter(hit), *cols], names=["h1", "h2", "ranges", "items", "names", "n_words"])

        # one row of each text; a table, because the block leaves the executors
        found = stored(keyed.mapInArrow(hit_rows, "h1 long, h2 long, ranges array<int>, items array<long>, names array<long>, n_words long").dropDuplicates(["h1", "h2"]), "hits")
        hits = found if hits is None else hits.unionByName(found)
        block.destroy()
        if not rest and (more := next(blocks, None)) is not None:
            rest.append(more)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ranges, items, names, n_words in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                n_hit = sum(b - a for a, b in _united([ab for r in ranges for ab in zip(r[::2], r[1::2], strict=True)]))
                named = {x: name for i, own in zip(items, names, strict=True) for x, name in zip(i, own, strict=True)}
                out.append((n_hit, len(named), _digest([*named.values()]), n_hit > 0 and share * n_hit >= n_words))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], names=["h1", "h2", "n_hit", "n_items", "items_sha256", "contaminated"])

    gathered = hits.groupBy("h1", "h2").agg(F.collect_list("ranges").alias("ranges"), F.collect_list("items").alias("items"), F.collect_list("names").alias("names"), F.first("n_words").alias("n_words"))  # a row for each block at most
    return None, gathered.mapInArrow(unite, "h1 long, h2 long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
