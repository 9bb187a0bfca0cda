"""Quality classifier by co-training two views of a document.

The *content* view sees the distinct words, word beginnings and symbol runs of the text and how repetitive it is; the
*metadata* view sees source, language, length and layout of the page. Each view has a logistic
classifier of its own. In every round both are fitted and calibrated; each then scores all documents
without a label and labels those of which it is sure, and the other view learns from these labels in the next round. At the
end the calibrated views are combined by adding their log-odds (the prior counts once), and all
documents are scored. This is done for ``quality`` and for ``toxic``; a document is kept unless it is
likely of low quality or likely toxic.

The classifiers are fitted on the driver on a bounded sample: at most ``max_labelled`` labelled documents
and, for each view and target, ``max_unlabelled`` of the documents of which the other view is sure, those with the smallest
hash. Every document of the table is scored, whole, in each round and at the end, from its tokens, which are made and stored once.

Edge cases: null text and metadata are values like others; a null label is no label; a document that
is labelled twice has its lower quality and its higher toxicity; labels without a document are not
used; without labels, or with one class only, a view knows only the prior and documents are kept;
rows that share a labelled doc_id are fitted by the one with the smallest hash; repeated rows are scored one by one; an empty table gives an empty result; further columns of the
table are not looked at, and a table without the metadata columns lacks those features.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import Remembered, fresh_names, pieces, stored

MAX_LABELLED = 6000
MAX_UNLABELLED = 4000
ROUNDS = 3
SURE = 0.98
FEATURES = 4096
#: Standard deviations by which a token must differ from chance to be a feature.
TELLING = 4.0
TARGETS = ("quality", "toxic")
_NO_ID = -(1 << 63)

#: Lengths of the word beginnings.
STEMS = (3, 4, 5)

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _hash(token: str) -> int:
    return xxhash.xxh32_intdigest(token)


def _step(x: float) -> int:
    """A number on a logarithmic scale."""
    return int(math.log2(x + 1) * 2)


def content_tokens(text: str) -> tuple[set[str], list[str]]:
    """Distinct tokens and word beginnings of the text, and what its repetition amounts to."""
    found = _TOKEN.findall(text.lower())
    distinct = set(found)
    n = max(1, len(found))
    lines = text.split("\n")
    symbols = sum(1 for t in found if not (t[0].isalnum() or t[0] == "_"))
    again = sum(map(operator.eq, found, found[1:]))
    stems = {"^" + t[:k] for k in STEMS for t in distinct if len(t) > k}
    shape = [
        f"distinct={int(10 * len(distinct) / n)}/{min(6, int(math.log10(n) * 2))}",
        f"symbols={int(10 * symbols / n)}",
        f"again={int(10 * again / n)}",
        f"lines={int(10 * len(set(lines)) / len(lines))}/{min(4, int(math.log10(len(lines)) * 2))}",
        f"empty={not found}",
    ]
    return distinct | stems, shape


def metadata_tokens(text: str, source: str | None, lang: str | None, n_chars: int | None) -> list[str]:
    n_lines = text.count("\n") + 1
    chars = len(text) if n_chars is None else n_chars
    return [f"source={source}", f"lang={lang}", f"both={source}/{lang}", f"chars={_step(max(0, chars))}", f"lines={_step(n_lines)}", f"line={_step(max(0, chars) / n_lines)}"]


class View:
    """A calibrated logistic classifier over sets of hashed tokens."""

    def __init__(self):
        self.names, self.weights, self.bias, self.scale, self.shift = np.zeros(0, np.uint32), np.zeros(0), 0.0, 1.0, 0.0

    def fit(self, sets: list[np.ndarray], y: np.ndarray) -> View:
        """Fits on four fifths of the sets and calibrates on the rest."""
        if not len(y):
            return self
        held = np.arange(len(y)) % 5 == 4
        prior = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        self.bias = prior
        if 0 < y[~held].sum() < (~held).sum():
            self._fit([s for s, h in zip(sets, held, strict=True) if not h], y[~held])
            self._calibrate(self._raw([s for s, h in zip(sets, held, strict=True) if h]), y[held], prior)
        return self

    def _fit(self, sets: list[np.ndarray], y: np.ndarray) -> None:
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        names, place = np.unique(np.concatenate(sets), return_inverse=True)
        df = np.bincount(place, minlength=len(names))
        in_pos = np.bincount(place, weights=y[rows], minlength=len(names))
        rate = y.mean()
        telling = np.abs(in_pos - df * rate) / np.sqrt(df * rate * (1 - rate) + 1.0)
        telling[df < 4] = -1
        chosen = np.sort(np.argsort(-telling, kind="stable")[:FEATURES])
        chosen = chosen[telling[chosen] > TELLING]
        column = np.full(len(names), -1)
        column[chosen] = np.arange(len(chosen))
        keep = column[place] >= 0
        rows, cols = rows[keep], column[place][keep]
        k, n = len(chosen), len(y)
        w, b = np.zeros(k), self.bias
        m, v = np.zeros(k + 1), np.zeros(k + 1)
        for t in range(1, 201):  # Adam on the whole sample
            p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=w[cols], minlength=n) + b, -30, 30)))
            r = (p - y) / n
            g = np.append(np.bincount(cols, weights=r[rows], minlength=k) + 1e-4 * w, r.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            w, b = w - step[:k], b - step[k]
        self.names, self.weights, self.bias = names[chosen], w, float(b)

    def _calibrate(self, raw: np.ndarray, y: np.ndarray, prior: float) -> None:
        """Platt scaling, drawn towards the prior alone when the scores tell nothing."""
        a, c = 0.0, prior
        soft = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * raw + c, -30, 30)))
            h = np.maximum(p * (1 - p), 1e-9)
            g = np.array([((p - soft) * raw).sum() + 1e-3 * a, (p - soft).sum()])
            hess = np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-3]])
            d = np.linalg.solve(hess, g)
            a, c = a - d[0], c - d[1]
            if np.abs(d).max() < 1e-6:
                break
        if a > 0:
            self.scale, self.shift = float(a), float(c)
        else:
            self.scale, self.shift = 0.0, prior

    def _raw(self, sets: list[np.ndarray]) -> np.ndarray:
        lookup = dict(zip(self.names.tolist(), self.weights.tolist(), strict=True))
        return np.array([sum(map(lookup.get, s.tolist(), [0.0] * len(s))) for s in sets]) + self.bias

    def logit(self, raw):
        return self.scale * raw + self.shift

class CoTrained:
    """Two views of one target. ``taught`` holds, by view, the documents that the other view labels: order -> (label, tokens)."""

    def __init__(self, y: np.ndarray):
        self.prior = math.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0
        self.seen = bool(len(y)) and 0 < y.sum() < len(y)
        self.views = [View(), View()]

    def fit(self, sets: list[list[np.ndarray]], y: np.ndarray, taught: list[dict[tuple, tuple[float, np.ndarray]]]) -> None:
        for k in (0, 1):
            more = [taught[k][i] for i in sorted(taught[k])]
            self.views[k] = View().fit(sets[k] + [s for _, s in more], np.append(y, [label for label, _ in more]))

    def combined(self, raws: list[np.ndarray]) -> np.ndarray:
        """The probabilities from both views' raw scores."""
        logit = sum(view.logit(raw) for view, raw in zip(self.views, raws, strict=True)) - self.prior
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


SCORE_SCHEMA = "doc_id long, p_quality double, p_toxic double, score double, kept boolean"
_VIEW_SCHEMA = "id long, th long, content array<int>, metadata array<int>"


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """id, text, source, lang, n_chars and a hash of them all, under names of their own."""

    def column(name: str, kind: str) -> Column:
        return (F.col(f"`{name}`") if name in docs.columns else F.lit(None)).cast(kind)

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    columns = [F.col(f"`{id_col}`").cast("long"), text, column("source", "string"), column("lang", "string"), column("n_chars", "long")]
    columns.append(F.xxhash64(*columns))
    return [c.alias(f"_view_{n}") for c, n in zip(columns, ("id", "text", "source", "lang", "n_chars", "th"), strict=True)]


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tokens of both views of every row, stored: id, th, content, metadata."""
    return stored(docs.select(*_inputs(docs, id_col, text_col)).mapInArrow(_views, _VIEW_SCHEMA), "views")


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows id, text, source, lang, n_chars, th as the tokens of both views."""
    hashes = Remembered(_hash, 120_000)
    kind = pa.list_(pa.int32())
    for batch in pieces(batches):
        content, metadata = [], []
        for t, *m in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
            distinct, shape = content_tokens(t)
            content.append(np.array([hashes[x] for part in (distinct, shape) for x in part], np.uint32).view(np.int32))
            metadata.append(np.array([hashes[x] for x in metadata_tokens(t, *m)], np.uint32).view(np.int32))
        cols = [batch.column(0), batch.column(5), pa.array(content, kind), pa.array(metadata, kind)]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "th", "content", "metadata"])


def _token_sets(lists: pa.ListArray) -> list[np.ndarray]:
    values, offsets = lists.values.to_numpy().view(np.uint32), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


class _Batches:
    """Raw scores of one view's classifiers for many token sets at once."""

    def __init__(self, views: list[View]):
        self.views = views
        self.names = np.unique(np.concatenate([v.names for v in views]))
        self.weights = np.zeros((len(views), len(self.names)))
        for w, v in zip(self.weights, views, strict=True):
            w[np.searchsorted(self.names, v.names)] = v.weights
        self.maybe = np.zeros(1 << 20, bool)  # by the low bits of a token, so that few are looked up
        self.maybe[self.names & 0xFFFFF] = True

    def raw(self, lists: pa.ListArray) -> list[np.ndarray]:
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy().view(np.uint32)[offsets[0] : offsets[-1]]
        rows = np.repeat(np.arange(len(lists)), np.diff(offsets))
        near = np.flatnonzero(self.maybe[values & 0xFFFFF])
        at = np.searchsorted(self.names, values[near])
        at[at == len(self.names)] = 0
        hit = self.names[at] == values[near] if len(near) else np.zeros(0, bool)
        rows, at = rows[near][hit], at[hit]
        return [v.bias + np.bincount(rows, weights=w[at], minlength=len(lists)) for v, w in zip(self.views, self.weights, strict=True)]


def _sure(models, sure: float):
    """Rows of _VIEW_SCHEMA as id, th and the label of each view for each target, null where it is not sure; rows without labels go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [_Batches([m.views[k] for m in models.value.values()]) for k in (0, 1)]
        for batch in pieces(batches, None):
            labels, some = [], np.zeros(len(batch), bool)
            for k in (0, 1):
                for view, raw in zip(scorers[k].views, scorers[k].raw(batch.column(2 + k)), strict=True):
                    p = 1 / (1 + np.exp(-np.clip(view.logit(raw), -30, 30)))
                    given = (p >= sure) | (p <= 1 - sure)
                    some |= given
                    labels.append(pa.array((p >= 0.5).astype(float), mask=~given))
            cols = [c.filter(pa.array(some)) for c in (batch.column(0), batch.column(1), *labels)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "th", *(f"{t}_{k}" for k in (0, 1) for t in models.value)])

    return run


def _teach(sets: DataFrame, known: DataFrame, models: dict[str, CoTrained], taught: dict[str, list[dict]], most: int, sure: float) -> None:
    """Lets the views label all documents without a label, and adds those of which they are sure to what the other view is taught.

    Each view keeps ``most`` of all that it was ever taught, those with the smallest hash; the first label counts.
    """
    spark = sets.sparkSession
    columns = [(t, k) for k in (0, 1) for t in models]
    shared = spark.sparkContext.broadcast(models)
    schema = "id long, th long, " + ", ".join(f"{t}_{k} double" for t, k in columns)
    # _sure names only what it needs, so that a row is small; the labels of the table join these rows, not the texts
    found = sets.mapInArrow(_sure(shared, sure), schema).join(known, F.col("id") == F.col("pick"), "left").drop("pick")
    found = stored(found.dropDuplicates(["id", "th"]), "sure").withColumn("turn", F.xxhash64("id", "th"))
    fresh: dict[tuple, list] = {}
    for t, k in columns:
        own = found.where(F.col(t).isNull() & F.col(f"{t}_{k}").isNotNull())
        for r in own.select("turn", "id", "th", F.col(f"{t}_{k}").alias("label")).orderBy("turn", "id", "th").limit(most).collect():
            key = (r.turn, _NO_ID if r.id is None else r.id, r.th)
            if key not in taught[t][1 - k]:
                fresh.setdefault(key, []).append((t, 1 - k, r.label))
    for t, k in columns:
        names = sorted([*taught[t][k], *(key for key, uses in fresh.items() if any(u[:2] == (t, k) for u in uses))])
        last = names[min(most, len(names)) - 1] if names else None
        taught[t][k] = {key: v for key, v in taught[t][k].items() if key <= last}
        for key in fresh:
            fresh[key] = [u for u in fresh[key] if u[:2] != (t, k) or key <= last]
    fresh = {key: uses for key, uses in fresh.items() if uses}
    if not fresh:
        return
    places = {key[1:]: key for key in fresh}
    wanted = spark.createDataFrame([*places], "want long, want_th long")
    rows = sets.withColumn("id", F.coalesce("id", F.lit(_NO_ID))).join(F.broadcast(wanted), (F.col("id") == F.col("want")) & (F.col("th") == F.col("want_th")))
    rows = rows.drop("want", "want_th").dropDuplicates(["id", "th"]).toArrow()  # one row of each
    views = [_token_sets(rows.column(c).combine_chunks()) for c in ("content", "metadata")]
    for n, place in enumerate(zip(rows.column("id").to_pylist(), rows.column("th").to_pylist(), strict=True)):
        for t, k, label in fresh[places[place]]:
            taught[t][k][places[place]] = (label, views[k][n])


def train(sets: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED, rounds: int = ROUNDS, id_col: str = "doc_id") -> dict[str, CoTrained]:
    """Models of both targets from the tokens of all documents (``tokenized``) and the labels of some."""
    sets = sets.select("id", "th", "content", "metadata")
    known = labels.select(F.col(id_col).cast("long").alias("pick"), F.col("quality").cast("double"), F.col("toxic").cast("double"))
    known = known.where("pick IS NOT NULL").groupBy("pick").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    first = known.orderBy(F.xxhash64("pick"), "pick").limit(max_labelled)
    own = sets.join(F.broadcast(first.select("pick")), F.col("id") == F.col("pick"))
    own = own.groupBy("pick").agg(F.min(F.struct("th", "content", "metadata")).alias("row")).select(F.col("pick").alias("id"), "row.content", "row.metadata")  # one row of each id
    rows = own.join(F.broadcast(first), F.col("id") == F.col("pick")).drop("pick").toArrow().sort_by("id")  # at most max_labelled rows
    y = {t: rows.column(t).to_numpy(zero_copy_only=False).astype(float) for t in TARGETS}
    views = [_token_sets(rows.column(c).combine_chunks()) for c in ("content", "metadata")]
    spread = np.argsort([xxhash.xxh32_intdigest(str(i)) for i in rows.column("id").to_pylist()], kind="stable")
    given = {t: [i for i in spread.tolist() if np.isfinite(y[t][i])] for t in TARGETS}
    models = {t: CoTrained(y[t][given[t]]) for t in TARGETS}
    taught: dict[str, list[dict]] = {t: [{}, {}] for t in TARGETS}
    learning = {t: m for t, m in models.items() if m.seen}
    for left in reversed(range(rounds + 1)):
        for t, model in models.items():
            model.fit([[v[i] for i in given[t]] for v in views], y[t][given[t]], taught[t])
        if left and learning and max_unlabelled > 0:
            _teach(sets, known, learning, taught, max_unlabelled, SURE)
    return models


class _Scorer:
    """The probabilities of quality and of toxicity. A target whose labels do not differ decides nothing."""

    def __init__(self, models: dict[str, CoTrained]):
        self.models, self.views = models, [_Batches([models[t].views[k] for t in TARGETS]) for k in (0, 1)]

    def score(self, content: pa.ListArray, metadata: pa.ListArray) -> list[np.ndarray]:
        raws = [view.raw(lists) for view, lists in zip(self.views, (content, metadata), strict=True)]
        return [self.models[t].combined([r[i] for r in raws]) if self.models[t].seen else np.full(len(content), float(t == "quality")) for i, t in enumerate(TARGETS)]


def _scores(docs: DataFrame, labels: DataFrame, min_quality: float, max_toxic: float, id_col: str, text_col: str, options: dict) -> DataFrame:
    """``doc_id, th, p_quality, p_toxic, score, kept`` of every row."""
    sets = tokenized(docs, id_col, text_col)
    models = docs.sparkSession.sparkContext.broadcast(train(sets, labels, id_col=id_col, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(models.value)
        for batch in pieces(batches, None):
            q, x = scorer.score(batch.column(2), batch.column(3))
            kept = (q >= min_quality) & (x <= max_toxic)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (q, x, q * (1 - x), kept))], names=["doc_id", "th", "p_quality", "p_toxic", "score", "kept"])

    return sets.mapInArrow(run, SCORE_SCHEMA.replace("doc_id long", "doc_id long, th long"))


def score_documents(docs: DataFrame, labels: DataFrame, min_quality: float = 0.5, max_toxic: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``doc_id, p_quality, p_toxic, score, kept``. ``options`` are those of ``train``."""
    return _scores(docs, labels, min_quality, max_toxic, id_col, text_col, options).drop("th")


def filter_documents(docs: DataFrame, labels: DataFrame, min_quality: float = 0.5, max_toxic: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that are kept, with all their columns: those whose id and hash of all that is judged are among the kept."""
    kept = _scores(docs, labels, min_quality, max_toxic, id_col, text_col, options).where("kept")
    own_id, *_, own_th = _inputs(docs, id_col, text_col)
    kept = stored(kept.select(F.col("doc_id").alias("_kept_id"), F.col("th").alias("_kept_th")).distinct(), "kept")
    i, th = fresh_names(docs, "_kept_id", "_kept_th")
    kept = kept.toDF(i, th)
    return docs.join(kept, own_id.eqNullSafe(F.col(i)) & (own_th == F.col(th)), "left_semi")
