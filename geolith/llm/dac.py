"""Token ids as binary output in directly addressable codes.

An id is cut into chunks of ``WIDTHS`` bits, lowest first. Level 0 holds the first chunk of every
id; level k holds the next chunk of the ids that need it. Each level has a continuation bitmap (does
this id go on?) and a rank directory (how many go on before each run of 512 bits), so that ``DacBlock.get``
finds any single token by at most one rank per level, without decoding a block.

``write_tokens`` writes a table of blocks below a folder: rows in ascending order of (part, seq), each
block a bounded number of whole documents in ascending doc_id order, with the ids and token counts of
its documents beside the payload. ``read_tokens`` gives, from the files alone, each document's place
in the whole stream. Blocks end at document boundaries; a document longer than a block is a block of
its own. Only sums per part (as many as there are write tasks) are put in one order on one task.

Edge cases: a null text is empty and holds the end id alone; a null doc_id comes first; rows that
share a doc_id are ordered by text and kept one by one; an empty table writes an empty table.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geolith.llm.byte_bpe import byte_table
from geolith.llm.common import Remembered, id_and_text, pieces, shuffle_partitions

#: Bits of each level's chunks; together they hold an unsigned 32-bit id.
WIDTHS = (8, 8, 16)
RANK_RUN = 512
BLOCK_TOKENS = 1 << 20
MAX_VOCABULARY_BYTES = 64 << 20
#: Entries in each generation of words and of pieces that a Python worker keeps.
CACHE_ENTRIES = 450_000

_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Words and signs with all sorts of white space about them, to try a tokenizer on.
_PROBES = ["a", " a", "a ", *(f"Some{gap}words,{gap}12{gap}éa{gap}...{gap}中文{gap}it's" for gap in (" ", "  ", "\n", " \n ", "\t", "\r\n", "\u00a0", "\u3000"))]


def dac_encode(ids: np.ndarray) -> bytes:
    """Levels one after another: count, chunks, continuation bitmap, rank directory."""
    rest, out = ids.astype(np.uint32), []
    for width in WIDTHS:
        chunk = rest & np.uint32((1 << width) - 1)
        rest = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
        on = rest > 0
        bits = np.packbits(on, bitorder="little")
        starts = np.arange(0, len(on), RANK_RUN)
        ranks = np.cumsum(np.add.reduceat(on, starts, dtype=np.uint32), dtype=np.uint32) if len(on) else np.zeros(0, np.uint32)
        directory = np.concatenate([np.zeros(1, np.uint32), ranks[:-1]])[: len(starts)]
        out += [np.uint32(len(on)).tobytes(), chunk.astype(f"<u{width // 8}").tobytes(), bits.tobytes(), directory.astype("<u4").tobytes()]
        rest = rest[on]
    return b"".join(out)


class DacBlock:
    """Reader of one payload; ``get`` looks up one token, ``all`` reads every token."""

    def __init__(self, payload: bytes):
        self.levels, at = [], 0
        for width in WIDTHS:
            n = int(np.frombuffer(payload, "<u4", 1, at)[0])
            at += 4
            chunks = np.frombuffer(payload, f"<u{width // 8}", n, at)
            at += n * width // 8
            bits = np.frombuffer(payload, np.uint8, (n + 7) // 8, at)
            at += len(bits)
            ranks = np.frombuffer(payload, "<u4", -(-n // RANK_RUN), at)
            at += 4 * len(ranks)
            self.levels.append((width, chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][1])

    def get(self, i: int) -> int:
        value = shift = 0
        for width, chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            shift += width
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            run = i // RANK_RUN
            head = np.unpackbits(bits[run * RANK_RUN // 8 : (i >> 3) + 1], bitorder="little")[: i - run * RANK_RUN]
            i = int(ranks[run]) + int(head.sum())
        return value

    def all(self) -> np.ndarray:
        value, shift = np.zeros(len(self), np.uint32), 0
        at: np.ndarray | slice = slice(None)
        for width, chunks, bits, _ in self.levels:
            value[at] |= chunks.astype(np.uint32) << np.uint32(shift)
            shift += width
            on = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            if not on.any():
                break
            at = np.flatnonzero(on) if isinstance(at, slice) else at[on]
        return value


class WordCoder:
    """A tokenizers file. If its pieces never cross white space (tried when it is read), words met before are looked up; else texts are encoded whole."""

    def __init__(self, model: str):
        self.tokenizer = Tokenizer.from_str(model)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        written = byte_table()
        self.written = dict(enumerate(written))
        latin = "".join(chr(c) for c in range(0xC0, 0x130) if chr(c).isalpha())
        self.latin = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str(f"AZ{latin}") == f"AZ{latin}".lower()
        #: Whether a run of letters below U+0130 is one piece of its bytes, also before a full stop or comma.
        self.runs = self.latin and all([p for p, _ in cut(f"az{latin.lower()}{c}")] == [self._bytes(f"az{latin.lower()}"), *c] for c in ("", ".", ","))
        self.pieces = Remembered(self._piece, CACHE_ENTRIES)
        self.words = Remembered(self._word, CACHE_ENTRIES)
        #: Whether the tokenizer treats the words between white space one by one.
        self.by_word = all(b"".join(map(self._word, t.split())) == self._whole(t) for t in _PROBES)

    def _bytes(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.written)

    def _normal(self, text: str) -> str:
        return text if self.tokenizer.normalizer is None else self.tokenizer.normalizer.normalize_str(text)

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        latin = self.latin and max(word) < "\u0130"
        plain = word.lower() if latin else self._normal(word)
        if latin and self.runs:
            run = plain[:-1] if plain[-1] in ".," else plain
            if run.isalpha():
                ids = self.pieces[run if run.isascii() else self._bytes(run)]
                return ids if run is plain else ids + self.pieces[plain[-1]]
        return b"".join([self.pieces[p] for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, as the tokenizer gives for the whole text."""
        if not self.by_word or _ODD_SPACE.search(text) or any(s in text for s in self.specials):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


@functools.lru_cache(maxsize=2)
def word_coder(model: str) -> WordCoder:
    return WordCoder(model)


BLOCK_SCHEMA = "part int, seq int, n_tokens long, doc_ids array<long>, counts array<long>, payload binary"


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts, each with ``end_id`` behind, and writes the blocks below ``folder``."""
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(text) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{tokenizer_path} holds more than {MAX_VOCABULARY_BYTES} characters")
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(text)
    end = np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = word_coder(model.value).encode, TaskContext.get().partitionId()
        seq, ids, counts, held, tokens = 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            payload = dac_encode(np.frombuffer(b"".join(held), "<u4"))
            cols = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([tokens], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "seq", "n_tokens", "doc_ids", "counts", "payload"])

        for batch in pieces(batches):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = encode(t) + end
                if held and tokens + len(data) // 4 > block_tokens:
                    yield block()
                    seq, ids, counts, held, tokens = seq + 1, [], [], [], 0
                ids.append(i)
                counts.append(len(data) // 4)
                held.append(data)
                tokens += counts[-1]
        if held:
            yield block()

    ordered = id_and_text(docs, id_col, text_col).repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: ``doc_id, start, n_tokens, ids_crc32``, and its ``part`` and ``seq``."""
    table = spark.read.schema(BLOCK_SCHEMA).parquet(folder)
    sizes = table.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = F.coalesce(F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("in_part", within).join(parts.select("part", before.alias("of_part")), "part")
    starts = starts.select("part", "seq", (F.col("of_part") + F.col("in_part")).alias("block_start"))
    read = table.mapInArrow(_read_blocks, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "seq"]).select("doc_id", (F.col("block_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, ids, counts, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "doc_ids", "counts", "payload")), strict=True):
            data = memoryview(DacBlock(payload).all().astype("<u4").tobytes())
            ends = np.cumsum(counts)
            starts = ends - counts
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(ids)
            cols = [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), *(pa.array(c, pa.int64()) for c in (ids, starts, counts, crc))]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])
