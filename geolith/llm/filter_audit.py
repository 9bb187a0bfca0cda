"""What each filter of a cascade removes, in every order of the filters: contractions of contingency tensors.

A document either passes or fails each of k filters, whatever the order they are applied in. So all that the orders
differ in follows from one count per pattern of failures: reshaped to a tensor of k axes of two (pass, fail), a step
of an order is a contraction that takes *pass* along the axes of the filters before it, *fail* or *pass* along its
own and *all* along those after it. ``SELECT`` holds these three as vectors, and one einsum contracts the tensors of a
whole batch of parts with the selections of every step of every order.

1. ``document_failures`` judges the texts in place; only ids, a digest of the text and the flags leave the scan.
   A text fails as a copy if a smaller doc_id has the same text: the smallest id of each repeated text meets the
   documents by digest, in a join whose hot keys Spark can split.
2. ``audit`` counts documents, good and toxic ones by part and pattern (partial sums before the shuffle, at most 2**k
   rows a part after it) and contracts. Only these counts reach Python.

Edge cases: a null text is an empty one, and passes the filters on length, repetition, capitals and signs but the first; a null
or empty part is ''; a row without doc_id is nobody's copy and makes no copies; rows that share a doc_id are documents of
their own, none the other's copy, with the labels of their doc_id; a doc_id with several labels has all of them; texts of
any length are judged whole, a megabyte at a time; an empty table has no parts; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import pieces, stored

MIN_WORDS = 200
#: Percent of words that are distinct, at least, and of characters that are capitals, at most.
MIN_DISTINCT, MAX_CAPITALS = 50, 2
SIGNS = b"#$%&*|"
#: The filters of ``document_failures``: words, repetition, capitals, signs, copies.
FILTERS = "ABCDE"
#: Bytes of a text whose words are held at a time.
SLICE_BYTES = 1 << 20
#: A part's tensor has two to this power cells.
MAX_FILTERS = 8

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_BLANK = re.compile(rb"[ \t-\r]")
FACTS_SCHEMA = "doc_id long, part string, digest binary, A boolean, B boolean, C boolean, D boolean"

# what a contraction takes of (pass, fail)
PASS, FAIL, ALL = 0, 1, 2
SELECT = np.array([[1, 0], [0, 1], [1, 1]], np.int64)


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists, each of about SLICE_BYTES (a longer word alone)."""
    at = 0
    while at < len(data):
        cut = _BLANK.search(data, at + SLICE_BYTES)
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def _few_distinct(data: bytes) -> tuple[int, bool]:
    """The number of words, and whether too few of them are distinct."""
    n, seen = 0, set()
    for words in _words(data):
        n += len(words)
        seen.update(words)
    return n, 100 * len(seen) < MIN_DISTINCT * n


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        n_chars = pc.utf8_length(batch.column(1)).to_pylist()
        out = []
        for text, chars in zip(batch.column(1).cast(pa.binary()).to_pylist(), n_chars, strict=True):
            n_words, repeats = _few_distinct(text)
            capitals = len(text) - len(text.translate(None, _CAPITALS))
            signs = len(text.translate(None, SIGNS)) < len(text)
            out.append((hashlib.sha256(text).digest()[:16], n_words < MIN_WORDS, repeats, 100 * capitals > MAX_CAPITALS * chars, signs))
        digests, *flags = zip(*out, strict=True) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digests, pa.binary()), *(pa.array(f, pa.bool_()) for f in flags)], names=[f.split()[0] for f in FACTS_SCHEMA.split(", ")])


def document_failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document: ``doc_id, part``, whether it fails each of ``FILTERS``, and whether it is ``good`` and ``toxic`` by ``labels``."""
    doc, text, part = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"), F.col(f"`{part_col}`").cast("string")
    read = docs.select(doc.alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(part, F.lit("")).alias("part"))
    facts = stored(read.mapInArrow(_judged, FACTS_SCHEMA), "judged")
    # tables of their own, so that Spark can split the documents of a hot text or id in the joins
    copied = facts.where("doc_id IS NOT NULL").groupBy(F.col("digest").alias("of")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first")
    copied = stored(copied.select("of", "first"), "copied")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    marks = stored(marks.where("good OR toxic"), "marks")
    out = facts.join(copied, F.col("digest") == F.col("of"), "left").join(marks, F.col("doc_id") == F.col("labelled"), "left")
    is_copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return out.select("doc_id", "part", "A", "B", "C", "D", is_copy.alias("E"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def orders_of(filters: Sequence[str]) -> list[tuple[str, int, int]]:
    """(order, step from 1, number of the step's filter) of every step of every order."""
    return [("".join(filters[i] for i in order), s + 1, order[s]) for order in itertools.permutations(range(len(filters))) for s in range(len(filters))]


def selections(filters: Sequence[str], at_step: int, before: int = PASS, after: int = ALL) -> np.ndarray:
    """What is taken along each axis (steps x filters): ``before`` and ``after`` along those of the filters applied before and after the step's."""
    place = np.array([[order.index(f) for f in filters] for order, _, _ in orders_of(filters)])
    step = np.array([s - 1 for _, s, _ in orders_of(filters)])[:, None]
    return np.where(place < step, before, np.where(place == step, at_step, after))


def contract(tensors: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Sums of each tensor (n x 2 x ... x 2) over what each row of ``taken`` takes along the axes: n x rows."""
    k = tensors.ndim - 1
    axes, step, one = list(range(k)), k, k + 1
    operands: list = [tensors, [one, *axes]]
    for i in axes:
        operands += [SELECT[taken[:, i]], [step, i]]
    return np.einsum(*operands, [one, step], optimize="greedy")


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _contracted(filters: Sequence[str]):
    steps = orders_of(filters)
    own = np.array([i for _, _, i in steps])
    k, n_steps = len(filters), len(steps)
    removed_at, kept_at = selections(filters, FAIL), selections(filters, PASS)
    failing, only = selections(filters, FAIL, ALL, ALL), selections(filters, FAIL, PASS, PASS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.slice(at, 64)
                flat = some.column(1).flatten()
                tensors = np.zeros((3, len(some), 2**k), np.int64)
                where = np.repeat(np.arange(len(some)), pc.list_value_length(some.column(1)).to_numpy()), flat.field("pattern").to_numpy()
                for t, name in zip(tensors, ("docs", "good", "toxic"), strict=True):
                    t[where] = flat.field(name).to_numpy()
                docs, good, toxic = tensors.reshape(3, len(some), *[2] * k)
                removed = contract(docs, removed_at)
                by_filter = np.zeros((len(some), k), np.int64)
                for i in range(k):
                    by_filter[:, i] = removed[:, own == i].sum(axis=1)
                values = [contract(docs, kept_at), removed, contract(docs, failing) - removed, contract(docs, only), contract(good, removed_at), contract(toxic, removed_at), by_filter[:, own]]
                part = some.column(0).take(pa.array(np.repeat(np.arange(len(some)), n_steps)))
                order, step = pa.array([o for o, _, _ in steps] * len(some)), pa.array([s for _, s, _ in steps] * len(some), pa.int32())
                yield pa.RecordBatch.from_arrays([part, order, step, *(pa.array(np.ascontiguousarray(v).reshape(-1)) for v in values)], names=["part", "filter_order", "step", *COUNTS])

    return run


def audit(failures: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row per part, order of ``filters`` (boolean columns: fails) and step: ``part, filter_order, step`` and ``COUNTS``.

    ``failures`` has ``part, good, toxic`` besides. Counts are of documents of the part: kept after the step, removed by it,
    redundant (fail its filter, removed before), unique_fails (fail its filter only), good and toxic ones removed by it;
    ``shapley`` is its filter's removed over all orders.
    """
    if not 1 <= len(filters) <= MAX_FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"one to {MAX_FILTERS} filters, each once")
    k = len(filters)
    pattern = sum((F.col(f).cast("int") * (1 << (k - 1 - i)) for i, f in enumerate(filters)), F.lit(0))
    counts = failures.groupBy("part", pattern.alias("pattern")).agg(F.count("*").alias("docs"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    tensors = counts.groupBy("part").agg(F.collect_list(F.struct(F.col("pattern").cast("int").alias("pattern"), "docs", "good", "toxic")).alias("cells"))  # 2**k at most
    return tensors.mapInArrow(_contracted(filters), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``audit`` of ``document_failures``."""
    return audit(document_failures(docs, labels, id_col, text_col, part_col))
