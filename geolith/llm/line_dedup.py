"""Line dedup by a suffix array over line-ID sequences, built by distributed prefix doubling.

The corpus is one sequence of line ids: documents in ascending order of doc_id, each with its lines
that are not blank. Lines that occur once cannot be part of a repeated run; they are left out and cut
the sequence into segments.

1. *Suffix array.* The rank of a position is the number of positions whose next ``depth`` lines sort before its
   own. Ranks for depth 1 come from the line ids; each round ranks the pairs (rank here, rank ``depth``
   lines on) and so doubles the depth, until only suffixes that are equal to the end of their segments share a rank.
   Ranking counts equal pairs first, so a line that holds a third of all rows is one row of the sort,
   and deals distinct pairs by range; only the sums of each range are put in order. Ranks that are settled are not sorted again.
2. *Common prefixes.* The round in which two neighbours of the suffix array parted bounds how many lines
   they share: none, one, or at least ``depth`` and less than twice that. A longer prefix whose neighbours are also preceded by the
   same line is one line shorter than that of the position before it; the few that are left are read
   from the two documents' line ids, from the bound on.
3. *Intervals.* Positions in order of the array, cut where the common prefix is shorter than ``min_lines``,
   are intervals of equal runs; the earliest position of an interval stays, and the lines that a later
   one's run covers are deleted. Runs that overlap or follow one another make up the maximal repeated run.
   A single line between others counts as a run if it has at least ``min_words`` words: its interval has a common prefix of one.

A blank line is deleted when the nearest line above it that is not blank is deleted.

Edge cases: a null text is empty and stays null; a document that loses all its lines keeps an empty
text; rows that share doc_id and text are one document and are treated alike; rows that share a doc_id
with other texts are ordered by a hash of the text; a null doc_id comes first; an empty table gives an
empty result. All columns of the table are handed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from geolith.llm.common import fresh_names, pieces, stored

MIN_LINES = 2
MIN_WORDS = 5
_NO_ID = -(1 << 63)
#: What follows the last line of a segment; it sorts before all ranks.
_END = -1
_PLACE = ("id", "th", "pos")


def _keys(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """What names a document: its id, and a hash of its text."""
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)), F.xxhash64(F.col(f"`{text_col}`"))


# --- the suffix array ---


def _ranked(pairs: DataFrame, more: bool) -> DataFrame:
    """Rows ``k1, k2, base, n`` with ``k1, k2, rank, base, open``: running counts in order of (k1, k2).

    ``rank`` of the first ranking counts all rows before; ``more``: it refines rank k1, whose rows the counts see from ``base`` on.
    ``open`` pairs have to be ranked again, and ``base`` counts their rows before.
    """
    spark = pairs.sparkSession
    ordered = pairs.repartitionByRange("k1", "k2").sortWithinPartitions("k1", "k2").withColumn("part", F.spark_partition_id())
    ordered = stored(ordered.mapInArrow(_running, "k1 long, k2 long, base long, n long, part int, before long, open boolean, open_before long"), "ranks")
    sums = ordered.groupBy("part").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("open"), F.col("n")).otherwise(0)).alias("k")).collect()  # one row per range
    starts, n, k = [], 0, 0
    for r in sorted(sums):
        starts.append((r.part, n, k))
        n, k = n + r.n, k + r.k
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, n_start long, k_start long"))
    before = F.col("before") + F.col("n_start")
    rank = F.col("k1") + before - F.col("base") if more else before
    return ordered.join(offsets, "part").select("k1", "k2", rank.alias("new_rank"), (F.col("open_before") + F.col("k_start")).alias("new_base"), F.col("open").alias("still_open"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = opened = 0
    for batch in batches:
        k2, n = batch.column(1).to_numpy(), batch.column(3).to_numpy()
        is_open = (n > 1) & (k2 != _END)
        k = np.where(is_open, n, 0)
        cols = [pa.array(np.cumsum(n) - n + rows), pa.array(is_open), pa.array(np.cumsum(k) - k + opened)]
        rows, opened = rows + int(n.sum()), opened + int(k.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=["k1", "k2", "base", "n", "part", "before", "open", "open_before"])


def _positions(docs: DataFrame, min_words: int | None, id_col: str, text_col: str) -> DataFrame:
    """``id, th, pos, line, wordy, segment, k, left, prev`` of the lines that occur more than once, with ``line`` as their rank.

    ``k`` numbers the rows of a document from 1, ``left`` counts the lines to the end of the segment, ``prev`` is the
    line before in the segment.
    """
    doc, th = _keys(docs, id_col, text_col)
    lines = docs.select(doc.alias("id"), th.alias("th"), F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda x: F.trim(x) != "").alias("lines"))
    wordy = F.col("line").rlike(f"^ *([^ ]+ +){{{min_words - 1}}}[^ ]") if min_words else F.lit(False)
    # two hashes with seeds of their own: neither follows from the other
    lines = lines.select("id", "th", F.posexplode("lines").alias("pos", "line")).select(*_PLACE, F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), wordy.alias("wordy"))
    place = F.struct(*_PLACE)
    repeated = lines.groupBy("k1", "k2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("k1", "k2")
    repeated = stored(repeated, "repeated")  # a table of its own, so that Spark can split the rows of a hot line in the join
    rows = stored(lines.join(repeated, ["k1", "k2"]).dropDuplicates([*_PLACE]), "lines")
    counts = rows.groupBy("k1", "k2").agg(F.lit(0).cast("long").alias("base"), F.count("*").alias("n"))
    rows = rows.join(_ranked(counts, False), ["k1", "k2"]).select(*_PLACE, F.col("new_rank").alias("line"), "wordy")
    by_doc = Window.partitionBy("id", "th").orderBy("pos")
    rows = rows.withColumn("k", F.row_number().over(by_doc)).withColumn("segment", F.col("pos") - F.col("k"))
    whole = Window.partitionBy("id", "th", "segment")
    rows = rows.withColumn("left", (F.max("pos").over(whole) - F.col("pos") + 1).cast("long"))
    return stored(rows.withColumn("prev", F.lag("line").over(whole.orderBy("pos"))), "positions")


def _suffix_ranks(positions: DataFrame) -> DataFrame:
    """``id, th, pos, rank, parted``: whole suffixes of segments in order, and the depth at which a rank's first position parted from the one before.

    A segment whose ranks are all settled is read no more.
    """
    in_segment = Window.partitionBy("id", "th", "segment").orderBy("pos")

    def followed(rows: DataFrame, depth: int) -> DataFrame:
        rows = rows.withColumn("k2", F.coalesce(F.lead("rank", depth).over(in_segment), F.lit(_END).cast("long")))
        return stored(rows.withColumn("live", F.max("open").over(Window.partitionBy("id", "th", "segment"))), "pairs")

    depth = 1
    # all lines here occur more than once, so all ranks are open and the rows before a rank are all open too
    rows = positions.select(*_PLACE, "segment", F.col("line").alias("rank"), F.col("line").alias("base"), F.lit(True).alias("open"), F.lit(0).alias("parted"))
    rows = followed(rows, depth)
    settled = rows.where("NOT live")
    while not (rows := rows.where("live")).isEmpty():
        pairs = rows.where("open").groupBy(F.col("rank").alias("k1"), "k2").agg(F.min("base").alias("base"), F.count("*").alias("n"))
        fresh = _ranked(pairs, True).withColumnRenamed("k2", "to_k2")
        rows = rows.join(fresh, (F.col("rank") == F.col("k1")) & (F.col("k2") == F.col("to_k2")), "left").select(
            *_PLACE,
            "segment",
            F.coalesce("new_rank", "rank").alias("rank"),
            F.coalesce("new_base", "base").alias("base"),
            F.coalesce("still_open", F.lit(False)).alias("open"),
            F.when(F.col("new_rank") != F.col("rank"), depth).otherwise(F.col("parted")).alias("parted"),
        )
        depth *= 2
        rows = followed(rows, depth)
        settled = settled.union(rows.where("NOT live"))
    return settled.select(*_PLACE, "rank", "parted")


_OWN = ("rank", "id", "th", "k", "left", "prev")


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's number in its range, and the row before it (null for the first of the range) as ``b_...``."""
    last, n = None, 0
    for batch in batches:
        if not len(batch):
            continue
        before = []
        for name in _OWN:
            column = batch.column(name)
            head = pa.nulls(1, column.type) if last is None else last.column(name).slice(len(last) - 1)
            before.append(pa.concat_arrays([head, column.slice(0, len(batch) - 1)]))
        number = pa.array(np.arange(n, n + len(batch)), pa.int64())
        last, n = batch, n + len(batch)
        yield pa.RecordBatch.from_arrays([*batch.columns, number, *before], names=[*batch.schema.names, "at", *(f"b_{c}" for c in _OWN)])


def suffix_array(docs: DataFrame, min_words: int | None = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The suffixes of all segments in order of (``part``, ``at``): ``id, th, pos, rank, line, wordy, left`` and ``lcp``, the lines shared with the suffix before.

    Equal suffixes share a rank and are in order of their place.
    """
    spark = docs.sparkSession
    positions = _positions(docs, min_words, id_col, text_col)
    rows = _suffix_ranks(positions).join(positions.withColumnRenamed("segment", "seg"), [*_PLACE])
    order = ["rank", *_PLACE]
    rows = rows.select(*order, F.col("parted").cast("long").alias("parted"), "line", "wordy", "seg", F.col("k").cast("long").alias("k"), "left", "prev")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    beside = stored(rows.mapInArrow(_beside, f"{kinds}, at long, {', '.join(f'b_{c} long' for c in _OWN)}"), "suffixes")
    lasts = beside.groupBy("part").agg(F.max_by(F.struct(*_OWN), "at").alias("last")).collect()  # one row per range
    lasts.sort(key=lambda r: r.part)
    edges = [(here.part, *before.last) for before, here in zip(lasts, lasts[1:], strict=False)]
    edges = F.broadcast(spark.createDataFrame(edges, f"part int, {', '.join(f'e_{c} long' for c in _OWN)}"))
    first = F.col("at") == 0
    beside = beside.join(edges, "part", "left").withColumns({f"b_{c}": F.when(first, F.col(f"e_{c}")).otherwise(F.col(f"b_{c}")) for c in _OWN})
    same_before = F.coalesce(F.col("prev") == F.col("b_prev"), F.lit(False))
    known = F.when(F.col("b_rank").isNull(), 0).when(F.col("b_rank") == F.col("rank"), F.col("left")).when(F.col("parted") <= 1, F.col("parted"))
    beside = stored(beside.select(*order, "part", "at", "line", "wordy", "seg", "k", "left", "parted", "b_id", "b_th", "b_k", "b_left", known.alias("lcp"), same_before.alias("same_before")), "neighbours")

    asked = beside.where("lcp IS NULL AND NOT same_before")
    lines = positions.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("s")).select(F.col("id").alias("d_id"), F.col("th").alias("d_th"), F.col("s.line").alias("s"))

    def beyond(k: str, left: str) -> Column:
        """The lines from the bound on, at most as many as the bound and as the segment has."""
        return F.slice("s", (F.col(k) + F.col("parted")).cast("int"), F.greatest(F.least(F.col("parted"), F.col(left) - F.col("parted")), F.lit(0)).cast("int"))

    own = asked.select(*_PLACE, "k", "left", "parted", "b_id", "b_th", "b_k", "b_left").join(lines, (F.col("id") == F.col("d_id")) & (F.col("th") == F.col("d_th")))
    own = own.select(*_PLACE, "parted", "b_id", "b_th", "b_k", "b_left", beyond("k", "left").alias("mine"))
    both = own.join(lines, (F.col("b_id") == F.col("d_id")) & (F.col("b_th") == F.col("d_th"))).select(*_PLACE, "parted", "mine", beyond("b_k", "b_left").alias("theirs"))
    differs = F.array_position(F.zip_with("mine", "theirs", lambda a, b: a.eqNullSafe(b)), False)
    found = both.select(*_PLACE, (F.col("parted") + F.when(differs > 0, differs - 1).otherwise(F.size("mine"))).alias("found"))
    in_segment = Window.partitionBy("id", "th", "seg").orderBy("pos")
    rows = beside.join(found, [*_PLACE], "left").withColumn("lcp", F.coalesce("lcp", "found"))
    rows = rows.withColumn("lcp", F.coalesce("lcp", F.last(F.col("lcp") + F.col("pos"), ignorenulls=True).over(in_segment) - F.col("pos")))
    return stored(rows.select(*order, "part", "at", "line", "wordy", "left", F.col("lcp").cast("long").alias("lcp")), "array")


# --- intervals and runs ---


def _cuts(batches: Iterator[pa.RecordBatch], thresholds: list[int]) -> Iterator[pa.RecordBatch]:
    """Adds the running number of places where the common prefix, the last column, is shorter than each threshold."""
    totals = [0] * len(thresholds)
    for batch in batches:
        lcp = batch.column(batch.num_columns - 1).to_numpy()
        cols = []
        for i, t in enumerate(thresholds):
            numbers = np.cumsum(lcp < t) + totals[i]
            totals[i] = int(numbers[-1]) if len(numbers) else totals[i]
            cols.append(pa.array(numbers, pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *(f"i{i}" for i in range(len(thresholds)))])


def lcp_intervals(suffixes: DataFrame, thresholds: list[int]) -> DataFrame:
    """The suffix array with ``i0, i1 ...``: equal numbers are neighbours that share at least so many lines, for each threshold."""
    spark = suffixes.sparkSession
    rows = suffixes.select(*_PLACE, "wordy", "part", "at", "lcp").repartitionByRange("part", "at").sortWithinPartitions("part", "at")
    names = [f"i{i}" for i in range(len(thresholds))]
    rows = rows.select(*_PLACE, "wordy", F.spark_partition_id().alias("deal"), "lcp")
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    rows = stored(rows.mapInArrow(lambda batches: _cuts(batches, thresholds), f"{kinds}, {', '.join(f'{n} long' for n in names)}"), "intervals")
    sums = rows.groupBy("deal").agg(*[F.max(n).alias(n) for n in names]).collect()  # one row per range
    starts, totals = [], [0] * len(names)
    for r in sorted(sums):
        starts.append((r.deal, *totals))
        totals = [t + r[n] for t, n in zip(totals, names, strict=True)]
    offsets = F.broadcast(spark.createDataFrame(starts, f"deal int, {', '.join(f's_{n} long' for n in names)}"))
    return rows.join(offsets, "deal").select(*_PLACE, "wordy", "lcp", *[(F.col(n) + F.col(f"s_{n}")).alias(n) for n in names])


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, th, starts``: per document the positions, with numbers of lines, whose run of ``min_lines`` lines, or single line of ``min_words`` words, stands earlier too."""
    single = min_words is not None and min_lines > 1
    rows = lcp_intervals(suffix_array(docs, min_words if single else None, id_col, text_col), [min_lines, 1] if single else [min_lines])
    place, out = F.struct(*_PLACE), None
    for name, length, own in (("i0", min_lines, rows), ("i1", 1, rows.where("wordy")))[: 1 + single]:
        earliest = own.groupBy(name).agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select(name, "lo")
        later = own.join(stored(earliest, "earliest"), name).where(place > F.col("lo")).select(*_PLACE, F.lit(length).alias("n"))
        out = later if out is None else out.union(later)
    return out.groupBy("id", "th").agg(F.collect_list(F.struct("pos", "n")).alias("starts"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, th, start, n_lines``: the maximal runs of lines that stand earlier too, counted in lines that are not blank."""
    starts = later_copies(docs, min_lines, min_words, id_col, text_col).select("id", "th", F.explode("starts").alias("s")).select("id", "th", "s.pos", (F.col("s.pos") + F.col("s.n")).alias("end"))
    by_doc = Window.partitionBy("id", "th").orderBy("pos", "end")
    reached = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = starts.withColumn("fresh", F.coalesce(F.col("pos") > reached, F.lit(True))).withColumn("run", F.sum(F.col("fresh").cast("int")).over(by_doc))
    return runs.groupBy("id", "th", "run").agg(F.min("pos").alias("start"), (F.max("end") - F.min("pos")).alias("n_lines")).drop("run")


# --- the texts without their copies ---


def _deleted(lines: list[str], starts: list[dict]) -> np.ndarray:
    """Which of all lines go."""
    full = np.array([bool(x.strip(" ")) for x in lines], bool)
    edges = np.zeros(int(full.sum()) + 1, np.int64)
    at, n = np.array([s["pos"] for s in starts]), np.array([s["n"] for s in starts])
    np.add.at(edges, at, 1)
    np.add.at(edges, at + n, -1)
    gone = np.concatenate([[False], np.cumsum(edges)[:-1] > 0])
    return gone[np.cumsum(full)]  # a blank line goes with the line above it


def _cut(batches: Iterator[pa.RecordBatch], at: int, n_lines: str, n_removed: str) -> Iterator[pa.RecordBatch]:
    """Replaces column ``at``, the text; the last column holds the starts and becomes the numbers of lines and of deleted lines."""
    for batch in pieces(batches, at):
        texts, counts, removed = [], [], []
        for text, starts in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            lines = [] if text is None else text.split("\n")
            if starts:
                gone = _deleted(lines, starts)
                text = "\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g)
                removed.append(int(gone.sum()))
            else:
                removed.append(0)
            texts.append(text)
            counts.append(len(lines))
        cols = list(batch.columns[:-1])
        cols[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*batch.schema.names[:-1], n_lines, n_removed])


def _without_copies(docs: DataFrame, min_lines: int, min_words: int | None, id_col: str, text_col: str) -> DataFrame:
    """The table with new texts and two more columns at its end: the numbers of lines and of deleted lines."""
    names = fresh_names(docs, "_later_id", "_later_th", "_starts", "_n_lines", "_n_removed")
    later_id, later_th, starts, n_lines, n_removed = names
    later = later_copies(docs, min_lines, min_words, id_col, text_col).toDF(later_id, later_th, starts)
    doc, th = _keys(docs, id_col, text_col)
    joined = docs.join(later, (doc == F.col(later_id)) & (th == F.col(later_th)), "left").drop(later_id, later_th)
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(n_lines, LongType()), StructField(n_removed, LongType())])
    return joined.mapInArrow(lambda batches: _cut(batches, at, n_lines, n_removed), schema)


def remove_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns, without the later copies of repeated runs of at least ``min_lines`` lines or of one line of ``min_words`` words."""
    out = _without_copies(docs, min_lines, min_words, id_col, text_col)
    return out.drop(*out.columns[-2:])


def digest_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` per document."""
    kept = _without_copies(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), min_lines, min_words, "doc_id", "text")
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
