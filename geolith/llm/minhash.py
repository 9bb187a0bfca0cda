"""Near-duplicate documents by BagMinHash signatures, banding and verified multiset overlap.

A document is the multiset of its five-word shingles (a shorter text is one shingle of all its words).
Every shingle carries Poisson processes over time and weight: weights are discretised to whole
numbers, the weight axis is cut into [0, 1), [1, 2), [2, 4), [4, 8) ..., and each of these intervals has
a process of its own whose rate is its length. A point belongs to a document if it lies below the
shingle's weight there: whole intervals at once, in the interval that holds the weight point by point.
Component k of the signature is the earliest point of all the document's processes that is assigned
to k, so two documents agree in a component with the probability of their weighted Jaccard similarity.
Points are made in order of time up to a bound that almost surely fills all components; the few
documents it does not fill get a later bound.

``near_duplicates`` works on distinct texts; copies follow their text.

1. Bands of ``ROWS`` components make buckets. Every member of a bucket is paired with its smallest id
   only, pairs far below the threshold by their signatures go unless a bucket holds just the two, the rest is verified exactly
   (sum of minima over sum of maxima of the shingle counts), and the components of the links are found.
2. Buckets that still hold several components are read again. Only the documents outside a bucket's largest
   component are compared, exactly, with all its others: they are dealt to chunks of bounded bytes, whose postings of
   shingles meet the bucket's documents in slices of bounded bytes, one text at a time. Each link that joins
   two components is kept. So a link between two texts that share a bucket is either found or joins
   documents that are in one class already, and no pairs within a class are listed. A bucket costs its texts
   once for each chunk and its outsiders once for each slice: in proportion to its size while what its
   largest component leaves over fits a chunk; only a bucket of many texts that are all unlike grows with the square.

Classes are connected components of links of at least ``threshold``; the class id is the smallest
doc_id. Two texts at the threshold miss each other in all bands with probability 5e-8. Distinct texts, known by 128 bits of hash, are
numbered in order of their smallest doc_id, so the smallest number of a class is its first document.

Edge cases: a null text is empty; texts without words are alike; rows that share a doc_id (or have none; those come before all
others) are documents of their own, compared by their texts, and stand in order of a hash of these; each of several rows with the
same doc_id and text has its row in the result, marked alike, and ``keep_first`` keeps one of them; texts of any length count
whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import fresh_names, id_and_text, pieces, shuffle_partitions, stored
from geolith.llm.substring_dedup import _BASES, _mixed, _rolled, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
SIZE = BANDS * ROWS
#: Standard deviations below the threshold at which a signature estimate rules a pair out.
SLACK = 4.5
#: Bytes of text of a bucket's outsiders whose postings a task holds, and of the documents that it compares with them.
CHUNK_BYTES, SLICE_BYTES = 8 << 20, 16 << 20
_ELEMENTS = 150_000  # shingles whose points are made together
_NO_ID = -(1 << 63)


def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a list of texts: text number, hash, count; in order of number and hash."""
    per_text = [word_hashes(t.encode()) for t in texts]
    counts = np.array([len(h) for h in per_text], np.int64)
    hashes = np.concatenate(per_text) if per_text else np.zeros(0, np.uint64)
    inside = np.maximum(counts - size + 1, 0)
    owner = np.repeat(np.arange(len(texts)), inside)
    firsts = np.arange(len(owner)) - np.repeat(np.cumsum(inside) - inside, inside) + np.repeat(np.cumsum(counts) - counts, inside)
    found = _rolled(hashes, size, _BASES[0])[firsts] if len(firsts) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.array([_rolled(per_text[i], len(per_text[i]), _BASES[0])[0] for i in short], np.uint64) + counts[short].astype(np.uint64)
        owner, found = np.concatenate([owner, short]), np.concatenate([found, whole])
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    fresh = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])])) if len(owner) else np.zeros(0, np.int64)
    return owner[fresh], found[fresh], np.diff(np.concatenate([fresh, [len(owner)]]))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53


def bag_minhash(owner: np.ndarray, found: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """Signatures (n x size, uint32) of n multisets; an empty one is all zeros."""
    out = np.zeros((n, size), np.uint32)
    total = np.bincount(owner, weights=weight, minlength=n)
    todo, reach = np.flatnonzero(total > 0), np.log(size) + 3.0
    while len(todo):
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        mine = place[owner] >= 0
        best = _earliest(place[owner[mine]], found[mine], weight[mine], reach / total[todo], size)
        full = np.isfinite(best).all(axis=1)
        out[todo[full]] = (_mixed(best[full].view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
        todo, reach = todo[~full], reach * 2
    return out


def _earliest(owner: np.ndarray, found: np.ndarray, weight: np.ndarray, bound: np.ndarray, size: int) -> np.ndarray:
    """The earliest time of each component below the bound of its multiset, or infinity."""
    levels = np.frexp(weight.astype(np.float64) - 0.5)[1] + 1  # intervals that the weight reaches into
    levels = np.where(weight <= 1, 1, levels)
    who = np.repeat(np.arange(len(weight)), levels)
    level = np.arange(len(who)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, np.ldexp(0.5, level))
    length = np.where(level == 0, 1.0, low)
    seed = _mixed(found[who] ^ _mixed(level.astype(np.uint64) + np.uint64(0x51ED270B)))
    top, who, time = weight[who].astype(np.float64), owner[who], np.zeros(len(who))
    best = np.full(len(bound) * size, np.inf)
    with np.errstate(over="ignore"):
        while len(who):
            seed = seed + np.uint64(0x9E3779B97F4A7C15)
            draw = _mixed(seed)
            time = time - np.log(_uniform(draw)) / (size * length)
            alive = time < bound[who]
            seed, top, who, time, low, length, draw = (x[alive] for x in (seed, top, who, time, low, length, draw))
            second = _mixed(draw ^ np.uint64(0xD6E8FEB86659FD93))
            below = low + length * ((second >> np.uint64(32)).astype(np.float64) * 2.0**-32) < top
            slot = who * size + (second & np.uint64(0xFFFFFFFF)).astype(np.int64) % size
            np.minimum.at(best, slot[below], time[below])
    return best.reshape(len(bound), size)


SIGNATURE_SCHEMA = "id long, k1 long, k2 long, size long, sig binary"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts = batch.column(1).to_pylist()
        sigs, at = [], 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) // 6 <= _ELEMENTS):
                held += len(texts[end]) // 6
                end += 1
            sigs.append(bag_minhash(*shingles(texts[at:end]), end - at))
            at = end
        rows = [r.tobytes() for s in sigs for r in s]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 2, 3)), pa.array([len(t) for t in texts], pa.int64()), pa.array(rows, pa.binary())], names=["id", "k1", "k2", "size", "sig"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(ids), BANDS))
        for r in range(ROWS):
            keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + sigs[:, :, r])
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, BANDS))], names=["key", "id"])


def _near_enough(threshold: float):
    least = int(SIZE * (threshold - SLACK * (threshold * (1 - threshold) / SIZE) ** 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, SIZE) for i in (2, 3))
            near = pa.array(((a == b).sum(axis=1) >= least) | (batch.column(4).to_numpy() == 2))  # step 2 does not read buckets of two
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    return run


def _verified(threshold: float):
    """Keeps pairs whose multisets overlap enough. Rows: a, b, text of a, text of b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in pieces(batches, 2):
            keep = []
            for b, x, y in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if last[0] != b:
                    last = (b, shingles([y])[1:])
                (h1, c1), (h2, c2) = shingles([x])[1:], last[1]
                at = np.minimum(np.searchsorted(h2, h1), max(len(h2) - 1, 0))
                both = h2[at] == h1 if len(h2) else np.zeros(len(h1), bool)
                shared = int(np.minimum(c1[both], c2[at[both]]).sum())
                union = int(c1.sum() + c2.sum()) - shared
                keep.append(union == 0 or shared >= threshold * union - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


class _Labels(dict):
    """Component labels that are joined as links are found."""

    def of(self, x: int) -> int:
        while (y := self.get(x, x)) != x:
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.of(x), self.of(y)
        self[max(x, y)] = min(x, y)


class _Chunk:
    """The outsiders of one bucket that a task holds, by their shingles."""

    def __init__(self, ids: list[int], comps: list[int], texts: list[str]):
        self.ids, self.comp = np.array(ids, np.int64), np.array(comps, np.int64)
        owner, found, count = shingles(texts)
        self.total = np.bincount(owner, weights=count, minlength=len(ids))
        order = np.argsort(found, kind="stable")
        self.values, self.owner, self.count = found[order], owner[order], count[order]

    def near(self, text: str, threshold: float) -> np.ndarray:
        """Which of them reach the threshold with this text."""
        _, found, count = shingles([text])
        lo, hi = np.searchsorted(self.values, found), np.searchsorted(self.values, found, side="right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shared = np.bincount(self.owner[at], weights=np.minimum(self.count[at], np.repeat(count, n)), minlength=len(self.ids))
        return shared >= threshold * (self.total + count.sum() - shared) - 1e-9


def _block_links(threshold: float):
    """Pairs of components that a link joins, each once a task. Rows in order of the block, outsiders first: key, chunk, slice, streamed, id, comp, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, labels, held, chunk, there = None, _Labels(), ([], [], []), None, set()
        for batch in pieces(batches, 6):
            joined = []
            for key, x, y, streamed, i, comp, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != (key, x, y):
                    block, labels, held, chunk, there = (key, x, y), _Labels(), ([], [], []), None, set()
                if not streamed:
                    for values, v in zip(held, (i, comp, text), strict=True):
                        values.append(v)
                    continue
                if chunk is None:
                    chunk, there = _Chunk(*held), {*held[1]}
                own = labels.of(comp)
                if all(labels.of(c) == own for c in there):
                    continue  # nothing here can join two components any more
                for j in np.flatnonzero(chunk.near(text, threshold) & (chunk.comp != comp)).tolist():
                    other = held[1][j]
                    if labels.of(comp) != labels.of(other):
                        labels.join(comp, other)
                        joined.append((comp, other))
            if joined:
                yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in joined], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """``node, c``: the smallest node of each connected component, for the nodes of ``links`` (a, b).

    Every node takes the smallest label among itself and its neighbours, then its label's label, until
    nothing changes. Each round is a table in the shared folder.
    """
    both = stored(links.union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("c").alias("m"))
        lower = stored(labels.join(around, F.col("node") == F.col("a")).select("node", F.col("c").alias("was"), F.least("c", "m").alias("c")), "labels")
        jump = lower.select(F.col("node").alias("at"), F.col("c").alias("further"))
        after = stored(lower.join(jump, F.col("c") == F.col("at")).select("node", "was", F.least("c", "further").alias("c")), "labels")
        if after.where("c <> was").isEmpty():
            return after.select("node", "c")
        labels = after.select("node", "c")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, k1, k2``: the text's hash in two halves."""
    texts = id_and_text(docs, id_col, text_col).withColumn("id", F.coalesce("id", F.lit(_NO_ID)))
    return texts.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, class_id, kept``; ``kept`` marks the first document of the class, whose id is the class id."""
    rows = _classified(docs, threshold, id_col, text_col)
    named = {c: F.when(F.col(v) != _NO_ID, F.col(v)) for c, v in (("doc_id", "id"), ("class_id", "class_id"))}
    return rows.select(named["doc_id"].alias("doc_id"), named["class_id"].alias("class_id"), "kept")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first document of a class of near copies, one row for each class."""
    kept = _classified(docs, threshold, id_col, text_col).where("kept").groupBy("id", "k1", "k2").agg(F.count("*").alias("n"))
    i, x, y, n = fresh_names(docs, "kept_id", "kept_k1", "kept_k2", "kept_n")
    kept = stored(kept.toDF(i, x, y, n), "kept")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    same = (F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)) == F.col(i)) & (F.xxhash64(text) == F.col(x)) & (F.xxhash64(F.lit(1), text) == F.col(y))
    found = docs.join(kept, same)
    once, often = found.where(F.col(n) == 1), found.where(F.col(n) > 1).dropDuplicates([i, x, y])
    return once.unionByName(often).select(*[F.col(f"`{c}`") for c in docs.columns])


def _classified(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """``id, k1, k2, class_id, kept`` of each row."""
    parts = shuffle_partitions(docs.sparkSession)
    texts = _keyed(docs, id_col, text_col)
    rows = stored(texts.mapInArrow(_signatures, SIGNATURE_SCHEMA), "signatures")
    # firsts, members and shared are tables of their own, so that Spark can split the rows of a hot key in the joins
    firsts = rows.groupBy("k1", "k2").agg(F.min("id").alias("first")).repartitionByRange("first", "k1", "k2").sortWithinPartitions("first", "k1", "k2")
    firsts = stored(firsts.withColumn("node", F.monotonically_increasing_id()), "firsts")
    members = stored(rows.select("id", "k1", "k2").join(firsts, ["k1", "k2"]), "members")
    sigs = rows.join(firsts, (rows["k1"] == firsts["k1"]) & (rows["k2"] == firsts["k2"]) & (F.col("id") == F.col("first")))
    sigs = sigs.groupBy(F.col("node").alias("id")).agg(F.min(F.struct("size", "sig")).alias("s")).select("id", "s.*")  # repeated rows are one
    sigs = stored(sigs, "signatures")

    in_bands = sigs.select("id", "sig").mapInArrow(_buckets, "key long, id long")
    shared = in_bands.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    bucketed = stored(in_bands.join(stored(shared, "shared"), "key"), "buckets")
    wanted = bucketed.select(F.col("id").alias("want")).distinct()
    sig_of = stored(sigs.join(wanted, F.col("id") == F.col("want"), "left_semi"), "signatures")
    want = sig_of.select(F.col("id").alias("want")).join(firsts, F.col("want") == F.col("node")).select("node", F.col("first").alias("id"), "k1", "k2")
    text_of = texts.join(want, ["id", "k1", "k2"]).select(F.col("node").alias("id"), "text")
    text_of = stored(text_of.dropDuplicates(["id"]), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        a = text_of.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
        b = text_of.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verified(threshold), "a long, b long")

    stars = bucketed.where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b"), "n").groupBy("a", "b").agg(F.min("n").alias("n"))
    sig_a = sig_of.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    sig_b = sig_of.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    stars = stars.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sig_a", "sig_b", "n").mapInArrow(_near_enough(threshold), "a long, b long")
    links = stored(verified(stars), "links")

    first = components(links)
    size_of = sig_of.select(F.col("id").alias("sized"), "size")
    placed = bucketed.where("n > 2").join(first, F.col("id") == F.col("node"), "left").join(size_of, F.col("id") == F.col("sized"))
    placed = stored(placed.select("key", "id", "size", F.coalesce("c", "id").alias("comp")), "placed")
    by_comp = placed.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    mixed = by_comp.groupBy("key").agg(F.max_by(F.struct("comp", "bytes"), F.struct("n", "comp")).alias("main"), F.sum("bytes").alias("bytes"), F.count("*").alias("comps")).where("comps > 1")
    chunks, slices = (F.ceil((b + 1) / F.lit(most)).cast("int") for b, most in ((F.col("bytes") - F.col("main.bytes"), CHUNK_BYTES), (F.col("bytes"), SLICE_BYTES)))
    mixed = stored(mixed.select("key", F.col("main.comp").alias("main"), chunks.alias("chunks"), slices.alias("slices")), "mixed")
    again = placed.join(mixed, "key")

    def dealt(n: str):
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    def each(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    held = again.where("comp <> main").select("key", dealt("chunks").alias("x"), each("slices").alias("y"), F.lit(False).alias("streamed"), "id", "comp")
    streamed = again.select("key", each("chunks").alias("x"), dealt("slices").alias("y"), F.lit(True).alias("streamed"), "id", "comp")
    again = held.union(streamed).join(text_of.select(F.col("id").alias("i"), "text"), F.col("id") == F.col("i")).drop("i")
    again = again.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y", "streamed", "id")
    more = stored(again.mapInArrow(_block_links(threshold), "a long, b long").distinct(), "joins")

    # the second links are between first components, so they are few and their components name what those become
    second = components(more)
    classes = first.join(second.toDF("from", "to"), F.col("c") == F.col("from"), "left").select("node", F.coalesce("to", "c").alias("c"))
    alone = second.join(first.select("node").withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left_anti")  # components of one document
    classes = classes.unionByName(alone)
    classes = stored(classes.toDF("of", "c"), "classes")
    named = firsts.select(F.col("node").alias("c"), F.col("first").alias("class_id"))
    classes = classes.join(named, "c").select("of", F.col("c").alias("class"), "class_id")
    out = members.join(classes, F.col("node") == F.col("of"), "left")
    kept = (F.coalesce("class", "node") == F.col("node")) & (F.col("id") == F.col("first"))
    return out.select("id", "k1", "k2", F.coalesce("class_id", "first").alias("class_id"), kept.alias("kept"))
