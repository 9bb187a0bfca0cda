"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 token, rank) becomes a tokenizers BPE model: each byte is written as one
printable character (the byte table), a merge is any pair of tokens whose bytes together are a
token, ordered by that token's rank, and a piece that is itself a token is not split. Text is cut
into pieces by the given pattern; each piece is encoded separately, so a piece needs encoding once
per Python worker and is then looked up.

Decoding reverses the byte table: every id stands for bytes, and a character whose bytes are split
over several tokens comes back whole because bytes are joined before they are read as UTF-8.
``spans`` maps tokens to offsets in the original text through the byte-to-character map; tokens
that share a split character all span that character.

Edge cases: a null text is empty and has no ids; texts of any length are encoded whole; repeated
rows are encoded one by one; an empty table gives an empty result; other columns are not looked at; null
ids and ids outside the vocabulary decode to no bytes. A pattern whose pieces cross white space, unlike those
of the usual vocabularies, is noticed when the coder is built, and texts are then cut whole.
The rank file is read by the driver and broadcast; ``MAX_VOCABULARY_BYTES`` bounds it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from geolith.llm.common import Remembered, give_memory_back, id_and_text, pieces

MAX_VOCABULARY_BYTES = 64 << 20
#: Entries in each of the two generations that a Python worker keeps of what it has encoded.
CACHE_ENTRIES = 120_000
#: A blank and what is not white space, or white space, cut where the pattern cuts it.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space to Python's ``re`` but not to Unicode.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Words, numbers and signs between all sorts of white space, to try a pattern on.
_PROBE = "".join(f"{gap}{item}" for item in ("ab", "A1b", "12345", "don't", "...", "é中", "_", "(x)", "a-b") for gap in ("", " ", "  ", "   ", "\n", " \n", "\n ", "\n\n", "\t", "\r\n", "\u00a0", "\u3000 ", " \u2003")) + "  \n "


def byte_table() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """A tokenizers model equal to the rank file."""
    table = byte_table()
    written = {token: "".join(table[b] for b in token) for token in ranks}
    merges = [
        (written[token[:i]], written[token[i:]])
        for token in sorted(ranks, key=ranks.get)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    vocab = {written[token]: rank for token, rank in ranks.items()}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": vocab, "merges": merges}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": None, "model": model})


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} holds more than {MAX_VOCABULARY_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class ByteBpe:
    """Encoder and decoder of one model, as each Python worker holds it."""

    def __init__(self, model: str, pattern: str):
        self.tokenizer = Tokenizer.from_str(model)
        self.pieces = regex.compile(pattern).findall
        vocab = self.tokenizer.get_vocab()
        byte_of = {c: b for b, c in enumerate(byte_table())}
        self.bytes_of = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        self.written = dict(enumerate(byte_table()))
        self.chunks = Remembered(self._ids_of, CACHE_ENTRIES)
        #: Whether the pattern cuts nothing else than what the chunks are cut into.
        self.by_chunk = self.pieces(_PROBE) == [p for c in _CHUNK.findall(_PROBE) for p in self.pieces(c)]

    def _ids_of(self, chunk: str) -> bytes:
        """Of each piece separately, by the model on the piece's bytes as characters."""
        tokenize, written = self.tokenizer.model.tokenize, self.written
        ids = array("I")
        for piece in self.pieces(chunk):
            ids.extend([t.id for t in tokenize(piece.encode().decode("latin-1").translate(written))])
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not self.by_chunk or _ODD_SPACE.search(text):
            return self._ids_of(text)
        return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text)))

    def forget(self) -> None:
        """At the end of a task, so that only the model stays for the tasks of other operators too."""
        self.chunks.forget()
        give_memory_back()

    def decode(self, ids: Iterable[int | None]) -> bytes:
        """The bytes that the ids stand for; null and what is not in the vocabulary stand for none."""
        n = len(self.bytes_of)
        return b"".join([self.bytes_of[i] for i in ids if i is not None and 0 <= i < n])

    def spans(self, text: str, ids: bytes) -> list[tuple[int, int]]:
        """[start, end) in characters of ``text`` for each id."""
        data = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
        sizes = np.array([len(self.bytes_of[i]) for i in np.frombuffer(ids, "<u4").tolist()], np.int64)
        ends = np.cumsum(sizes)
        return [(int(character[e - n]), int(character[e - 1]) + 1) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


@functools.lru_cache(maxsize=4)
def coder(model: str, pattern: str) -> ByteBpe:
    """One to a Python worker, which works for many tasks."""
    made = ByteBpe(model, pattern)
    give_memory_back()  # building takes more than the coder keeps
    return made


def _broadcast(spark: SparkSession, ranks_path: str, pattern: str):
    return spark.sparkContext.broadcast((tokenizer_json(read_ranks(ranks_path)), pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array<int>), ``starts`` and ``ends`` (array<int>): each token's characters in the text."""
    model = _broadcast(docs.sparkSession, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(*model.value)
        for batch in pieces(batches):
            texts = batch.column(1).to_pylist()
            ids = [bpe.encode(t) for t in texts]
            spans = [bpe.spans(t, i) for t, i in zip(texts, ids, strict=True)]
            cols = [[np.frombuffer(i, "<u4").astype(np.int32) for i in ids], [np.array([a for a, _ in s], np.int32) for s in spans], [np.array([b for _, b in s], np.int32) for s in spans]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(pa.int32())) for c in cols)], names=["doc_id", "ids", "starts", "ends"])
        bpe.forget()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded`` (binary) from arrays of ids."""
    model = _broadcast(encoded.sparkSession, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(*model.value)
        for batch in batches:
            out = [bpe.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, "doc_id long, decoded binary")


ROUND_TRIP_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: the number and digest of its ids, and the digest of the bytes they decode to; ``with_ids`` adds the ids themselves."""
    model = _broadcast(docs.sparkSession, ranks_path, pattern)
    more = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(*model.value)
        for batch in pieces(batches):
            counts, encoded, decoded, lists = [], [], [], []
            for text in batch.column(1).to_pylist():
                data = bpe.encode(text)
                ids = np.frombuffer(data, "<u4")
                counts.append(len(ids))
                encoded.append(hashlib.sha256(data).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids.tolist())).hexdigest())
                lists.append(ids.view(np.int32))
            cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
            cols += [pa.array(lists, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
        bpe.forget()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, ROUND_TRIP_SCHEMA + more)
