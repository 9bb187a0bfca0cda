"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

The shingles of a text are its runs of ``SHINGLE`` words (a text of fewer words is one shingle), each
hashed once to 64 bits. The top bits choose one of ``BINS`` bins; a bin keeps its smallest hash. A bin
without a hash borrows from the first bin with one along its own fixed random order of bins, the same
for every text (optimal densification): some positions of that order are read from tables, and what
is still empty takes the smallest of the order's keys over all filled bins. Of every bin the low-order
``BITS`` bits are kept, eight bins packed into one long.

Two fingerprints agree by chance in a bin with probability 2**-BITS; ``likeness`` takes that out of the
share of bins that agree and cuts below 0.

Everything here is DataFrame functions.

Edge cases: a null text is empty; the empty text is one shingle of one empty word, so empty texts are
alike and unlike all others. Rows that share a doc_id are fingerprinted one by one; the next document
of any of them is the next larger doc_id (its smallest beginning, if that one is shared too). A null
doc_id comes before all others. A single document follows itself. An empty table gives an empty
result. Other columns are not looked at.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.llm.common import id_and_text, shuffle_partitions, stored

SHINGLE = 5
BINS = 256
BITS = 8
#: Positions of each bin's order that are read from tables.
TABLED = 8

_REST = (1 << 56) - 1  # the bits below those that choose the bin
_NO_ID = -(1 << 63)  # stands for a null doc_id


def _longs(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def _bin(x: Column) -> Column:
    return F.shiftright(x, 56)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: an array of BINS * BITS / 64 longs.

    A column that a lambda reads is read twice in its step, which keeps the optimizer from moving its
    computation into the lambda.
    """
    rnd = random.Random(20240229)
    orders = [[rnd.randrange(BINS) for _ in range(BINS)] for _ in range(TABLED)]
    empty_bins = _longs([((i - BINS // 2) << 56) | _REST for i in range(BINS)])

    words, hashes, bins, filled, values = "_fp_words", "_fp_hashes", "_fp_bins", "_fp_filled", "_fp_values"
    out = df.withColumn(words, F.split(text, r"\s+"))
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1)))
    shingles = F.transform(starts, lambda i: F.xxhash64(F.slice(F.col(words), i, SHINGLE)))
    out = out.withColumn(hashes, F.sort_array(F.concat(shingles, empty_bins)))
    least = F.filter(hashes, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col(hashes), i - 1))))
    out = out.withColumn(bins, F.transform(least, lambda x: F.when(x.bitwiseAND(F.lit(_REST)) != _REST, x)))
    out = out.withColumn(filled, F.filter(bins, lambda x: x.isNotNull()))

    def borrowed(i: Column) -> Column:
        keyed = F.transform(filled, lambda x: F.struct(F.xxhash64(i, _bin(x)).alias("key"), x.alias("value")))
        return F.when(F.size(filled) > 0, F.array_min(keyed)["value"])

    tabled = [_longs(order) for order in orders]
    dense = F.transform(bins, lambda v, i: F.coalesce(v, *[F.get(F.col(bins), F.get(t, i).cast("int")) for t in tabled], borrowed(i)))
    out = out.withColumn(values, dense)
    per_long = 64 // BITS
    low = F.lit((1 << BITS) - 1)
    packed = F.transform(
        F.sequence(F.lit(0), F.lit(BINS // per_long - 1)),
        lambda j: F.aggregate(F.slice(F.col(values), j * per_long + 1, per_long), F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, BITS).bitwiseOR(F.coalesce(v, F.lit(0).cast("long")).bitwiseAND(low))),
    )
    out = out.withColumn(name, F.when(F.size(values) > 0, packed))
    return out.drop(words, hashes, bins, filled, values)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1."""
    folded = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    for shift in (4, 2, 1):  # the lowest bit of a byte becomes whether any of its bits is set
        folded = F.transform(folded, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, shift)))
    apart = F.aggregate(folded, F.lit(0), lambda s, x: s + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101))))
    by_chance = 2.0**-BITS
    agreeing = (F.lit(BINS) - apart) / F.lit(float(BINS))
    return F.greatest(F.lit(0.0), (agreeing - by_chance) / (1.0 - by_chance))


def hex_string(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def next_ids(ids: DataFrame) -> DataFrame:
    """``id, n, next_id`` over distinct ids in ascending order, the first after the last.

    Ids are dealt by range; only the smallest id of each range meets the others on one task.
    """
    spark = ids.sparkSession
    ranged = ids.repartitionByRange(shuffle_partitions(spark), "id").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "ids")
    firsts = ranged.groupBy("part").agg(F.min("id").alias("first_id"))
    after = firsts.select("part", F.coalesce(F.lead("first_id").over(Window.orderBy("part")), F.min("first_id").over(Window.partitionBy())).alias("after"))
    within = F.lead("id").over(Window.partitionBy("part").orderBy("id"))
    return ranged.withColumn("within", within).join(after, "part").select("id", "n", F.coalesce("within", "after").alias("next_id"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has its last floor(n_chars / 4) characters replaced by the first as many of the next
    document. Texts are shuffled once, with their fingerprints; beyond that only the beginnings that
    edits need travel.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("id", F.coalesce("id", F.lit(_NO_ID)))
    order = next_ids(rows.groupBy("id").agg(F.max(F.length("text")).alias("n")))
    texts = with_fingerprint(rows, "text", "fp")  # dealt by id by the joins, so that Spark can split an id that many rows share; one shuffle serves both

    needs = order.select(F.col("id").alias("to"), F.col("next_id").alias("from_id"), F.expr("n div 4").cast("int").alias("need"))
    sent = texts.join(needs.hint("merge"), F.col("id") == F.col("from_id")).select("to", F.struct(F.col("text").substr(F.lit(1), F.col("need")).alias("head"), F.col("fp").alias("next_fp")).alias("next"))
    sent = sent.groupBy("to").agg(F.min("next").alias("next"))

    n = F.length("text")
    cut = F.expr("length(text) div 4").cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), (n - cut).cast("int")), F.col("next.head").substr(F.lit(1), cut))
    both = texts.join(sent.hint("merge"), F.col("id") == F.col("to")).select("id", n.cast("long").alias("n_chars"), "fp", F.col("next.next_fp").alias("next_fp"), edited.alias("edited"))
    both = with_fingerprint(both, "edited", "edited_fp")
    return both.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        hex_string(F.col("fp")).alias("fingerprint"),
        hex_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
