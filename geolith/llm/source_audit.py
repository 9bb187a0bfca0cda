"""How the sources of a language differ in their words: exact divergences from sparse term counts.

A text's terms are its runs of ASCII letters and non-ASCII characters. One ``bytes.translate`` lowers A-Z and blanks all other
ASCII, ``bytes.split`` cuts, and a Counter per document yields how often each term occurs and that it occurs at all.

1. *Counts.* Each task adds its documents' Counters up by language and source and hands on what it holds when that is
   ``HELD_TERMS`` terms, so a frequent term is a few rows a task, not one a document. All rows of a (language, term) meet in one
   shuffle: their sums by source, and the number of the language's documents that hold the term.
2. *Terms.* A language keeps the terms that occur in at least ``min_docs`` of its documents. From here on tables are as large as the
   vocabularies: one row per kept term with the counts of its sources. A term's smoothed share of a source in billionths is
   whole numbers in decimals of 38 digits, so no count overflows.
3. *Divergences.* Two sources differ by the sum of the differences of all kept terms, also of those that neither holds. Rows of
   all sources' shares stand one beneath the other in blocks of bounded size; each task sums the differences of all pairs over
   its blocks, and these sums meet by pair. Only the pairs themselves, which the result lists anyway, are rows.
   The terms that a source has more of than its language are ranked by Spark, which keeps the first ``top`` of each task before it shuffles.

The sources of a language are one row of an array, since the result has as many rows as the square of their number.

Edge cases: a null text, language or source is ''; a text without terms makes its (language, source) occur; texts of any length
are read whole, a megabyte at a time; repeated rows and rows that share a doc_id count each; a language without kept terms has pairs
of value 0 and no terms; a language with one source has no pairs; ties are put in order of the item's UTF-8 bytes; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.llm.common import pieces, stored

MIN_DOCS, TOP = 30, 50
#: Occurrences that each kept term is given besides its own, and the unit of shares.
SMOOTHING, UNIT = 5, 1_000_000_000
#: Distinct terms that a task holds before it hands them on, and bytes of text that are cut at a time.
HELD_TERMS, SLICE_BYTES = 400_000, 1 << 20
#: Shares in a block whose pairs are compared at once.
BLOCK_SHARES = 1 << 18

_LETTERS = bytes(range(ord("a"), ord("z") + 1))
_TABLE = bytes(b if b >= 0x80 or b in _LETTERS else b + 32 if ord("A") <= b <= ord("Z") else 0x20 for b in range(256))

COUNT_SCHEMA = "lang string, source string, term string, n long, n_docs long"


def terms(data: bytes) -> Counter:
    """How often each term occurs in a text."""
    found, at = Counter(), 0
    data = data.translate(_TABLE)
    while at < len(data):
        end = data.find(b" ", at + SLICE_BYTES)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


class _Held:
    """Sums over documents by language and source."""

    def __init__(self):
        self.sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.size = 0

    def add(self, group: tuple[str, str], found: Counter) -> None:
        if group not in self.sums:
            self.sums[group] = Counter(), Counter()
            self.size += 1  # a group is a row too
        n, n_docs = self.sums[group]
        before = len(n)
        n.update(found)
        n_docs.update(found.keys())
        self.size += len(n) - before

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What is held: one row for each group and term, and one without a term for each group."""
        for (lang, source), (n, n_docs) in self.sums.items():
            names, counts = [None, *n], [0, *n.values()]
            of = [0, *map(n_docs.__getitem__, n)]
            for at in range(0, len(names), 1 << 16):
                some = names[at : at + (1 << 16)]
                cols = [pa.array([x] * len(some), pa.string()) for x in (lang, source)]
                cols += [pa.array(some, pa.binary()).cast(pa.string()), pa.array(counts[at : at + (1 << 16)], pa.int64()), pa.array(of[at : at + (1 << 16)], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in COUNT_SCHEMA.split(", ")])
        self.__init__()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Held()
    for batch in pieces(batches, 2):
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            held.add((lang, source), terms(text))
            if held.size >= HELD_TERMS:
                yield from held.rows()
    yield from held.rows()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, term, n_docs, n, by_source`` (array of source, n): the terms of each language; one row without a term lists all its sources."""
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    rows = read.mapInArrow(_counted, COUNT_SCHEMA).repartition("lang", "term")  # both sums below keep this dealing
    by_source = rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    return by_source.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("by_source"))


def _share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(UNIT * (n + SMOOTHING) / (total + SMOOTHING * size)) in whole numbers."""
    wide = "decimal(20,0)"
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + SMOOTHING).cast(wide), (total.cast(wide) + SMOOTHING * size).cast(wide)) + 1


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows lang, shares: ``lang, a, b, value`` for a < b, the sums over the task's rows."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0)
        for lang in pc.unique(langs).to_pylist():
            lists = batch.column(1).filter(pc.equal(langs, lang))
            k = len(lists[0])
            own = sums.setdefault(lang, np.zeros((k, k), np.int64))
            rows = max(1, BLOCK_SHARES // k)
            for at in range(0, len(lists), rows):
                block = lists.slice(at, rows).flatten().to_numpy().reshape(-1, k)
                for i in range(k - 1):
                    own[i, i + 1 :] += np.abs(block[:, i + 1 :] - block[:, i : i + 1]).sum(axis=0)
    for lang, own in sums.items():
        a, b = np.triu_indices(len(own), 1)
        for at in range(0, len(a), 1 << 16):
            i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(own[i, j])], names=["lang", "a", "b", "value"])


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: of each source of a language, its divergence from each other source (part *pair*), and the terms that it has more of than the language (part *term*, the first ``top``)."""
    found = term_counts(docs, text_col, lang_col, source_col).where(F.col("term").isNull() | (F.col("n_docs") >= min_docs))
    found = stored(found, "terms")
    kept = found.where("term IS NOT NULL")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    in_source = kept.select("lang", F.explode("by_source").alias("s")).groupBy("lang", "s.source").agg(F.sum("s.n").alias("n"))
    every = found.where("term IS NULL").select("lang", F.explode("by_source.source").alias("source"))
    groups = every.join(in_source, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("sources"))
    langs = groups.join(sizes, "lang", "left").select("lang", "sources", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("total", F.lit(0)).alias("total"))
    langs = stored(langs, "languages")

    counts = F.map_from_arrays("by_source.source", "by_source.n")
    in_order = F.transform("sources", lambda s: F.coalesce(F.element_at(counts, s["source"]), F.lit(0)))
    rows = kept.join(langs.withColumnRenamed("total", "lang_total"), "lang").select("lang", "term", "n", "lang_total", "size", "sources", in_order.alias("counts"))
    rows = rows.withColumn("shares", F.zip_with("counts", "sources", lambda n, s: _share(n, s["n"], F.col("size"))))
    rows = stored(rows.select("lang", "term", _share(F.col("n"), F.col("lang_total"), F.col("size")).alias("q"), "counts", "shares"), "shares")

    sums = rows.select("lang", "shares").mapInArrow(_pair_sums, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    number = F.sequence(F.lit(0), F.size("sources") - 1)
    # every pair is a row of the result, in both directions
    pairs = langs.select("lang", "sources", F.explode(number).alias("own")).select("*", F.explode(F.filter(number, lambda j: j != F.col("own"))).alias("other"))
    pairs = pairs.select("lang", F.get("sources", "own")["source"].alias("source"), F.get("sources", "other")["source"].alias("item"), F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    cells = rows.select("lang", "term", "q", F.posexplode(F.arrays_zip("counts", "shares")).alias("own", "c")).where("c.counts > 0 AND c.shares > q")
    more = cells.select("lang", "own", "term", (F.col("c.shares") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "own").orderBy(F.desc("value"), "term")
    first = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = langs.select("lang", F.posexplode("sources.source").alias("own", "source"))
    first = first.join(names, ["lang", "own"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.unionByName(first)
