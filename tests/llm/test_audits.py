"""Filter interaction audit, language identification and source divergence against brute force and awkward tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from geolith.llm import filter_audit, language_id, quality, source_audit

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"
#: Nulls in every column, empty and blank texts, equal and repeated rows, rows that share an id, and a very long text.
AWKWARD = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, " \n\t ", None, ""),
    (4, "one two three", "en", "a"),
    (4, "one two three", "en", "b"),
    (5, "one two three", "de", "a"),
    (None, "one two three", "de", "a"),
    (None, "a row without an id", None, None),
    (6, "word " * 300_000, "en", "b"),
    (7, "été Ünïcode 中文 😀 words\nAND LINES\nand lines\n", "fr", "b"),
    (8, "\x1codd \x85 space　here $", "fr", "a"),
    (9, "x" * 2_500_000 + " tail", "en", "c"),
]
MARKS = [(1, 1, 0), (4, 1, 1), (4, 0, 0), (5, 0, 1), (6, 1, None), (None, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def awkward(spark):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(AWKWARD, DOCS)
    return df.withColumns({c: F.lit(None).cast("string") for c in ("part", "digest", "A", "good", "term", "n", "held_out", "of", "sources", "pattern")})


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame(MARKS, LABELS)


# --- 11 ---


def failures(rows, marks):
    """part, failing filters, good, toxic of each row, by the plainest means."""
    out = []
    for i, text, _, source in rows:
        t = text or ""
        words = [w.decode() for w in t.encode().split()]
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        fails += "E" * any(i is not None and j is not None and j < i and (u or "") == t for j, u, *_ in rows)
        out.append((source or "", fails, any(i == j and q == 1 for j, q, _ in marks if j is not None), any(i == j and x == 1 for j, _, x in marks if j is not None)))
    return out


def audited(rows, marks, filters="ABCDE"):
    judged, out = failures(rows, marks), {}
    for part in {p for p, *_ in judged}:
        own = [r for r in judged if r[0] == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations(filters)):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                fail = [r for r in own if f in r[1]]
                only = [r for r in own if set(r[1]) & set(filters) == {f}]
                out[part, order, step] = [f, len(left), len(gone), len(fail) - len(gone), len(only), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for order, step in [k[1:] for k in out if k[0] == part]:
            out[part, order, step].append(shapley[out[part, order, step][0]])
    return {k: tuple(v[1:]) for k, v in out.items()}


def as_counts(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.COUNTS) for r in df.collect()}


def test_audit_of_awkward_rows(awkward, marks):
    got = as_counts(filter_audit.audit_documents(awkward, marks))
    assert got == audited(AWKWARD, MARKS)
    assert len(got) == 4 * 600


def test_audit_of_fewer_filters(awkward, marks):
    judged = filter_audit.document_failures(awkward, marks)
    assert as_counts(filter_audit.audit(judged, "EB")) == audited(AWKWARD, MARKS, "EB")
    with pytest.raises(ValueError):
        filter_audit.audit(judged, "AA")


def test_audit_without_rows(awkward, marks):
    assert filter_audit.audit_documents(awkward.limit(0), marks).count() == 0
    assert len(as_counts(filter_audit.audit_documents(awkward, marks.limit(0)))) == 4 * 600


def test_a_cascade_loses_what_it_removes(spark):
    from geolith.llm.queries import QUERIES

    out = QUERIES["op11_filter_audit"](spark, SF)
    totals = out.groupBy("part", "filter_order").agg(F.sum("removed").alias("gone"), F.min_by("kept", -F.col("step")).alias("left"))
    n = spark.read.parquet(f"{SF}/documents.parquet").groupBy(F.coalesce("source", F.lit("")).alias("part")).count()
    assert totals.join(n, "part").where("gone + left <> count").count() == 0


# --- 12 ---


def test_held_out_accuracy(spark):
    from geolith.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = {r.doc_id: r for r in QUERIES["op12_language_id"](spark, sf).collect()}
    assert set(got) == set(want)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    kept = [i for i, r in got.items() if r.held_out]
    assert len(kept) > 150 and sum(got[i].lang_pred == want[i] for i in kept) > 0.98 * len(kept)


def test_nothing_but_the_texts_decides(spark, awkward):
    """Neither languages of held-out rows nor ids and sources of any row change a prediction."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn(df.where(~language_id.held_out()))
    other = df.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    same = language_id.learn(other.where(~language_id.held_out()))
    assert same.languages == model.languages and (same.p == model.p).all()
    plain = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, model).collect()}
    moved = df.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", F.lit("yy").alias("lang"), F.lit("z").alias("source"))
    assert {r.doc_id - 1_000_000: (r.lang_pred, r.score) for r in language_id.predict(moved, model).collect()} == plain


def test_languages_of_awkward_rows(spark, awkward):
    got = language_id.identify(awkward).collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        texts = [t for i, t, *_ in AWKWARD if i == r.doc_id]
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if all(t is None or not any(map(str.isalpha, t)) for t in texts):
            assert (r.lang_pred, r.score, r.languages) == ("und", 0.0, [])
        else:
            assert r.lang_pred in {"en", "de", "fr"} and abs(sum(x.share for x in r.languages) - 1) < 1e-4
    assert language_id.identify(awkward.limit(0)).count() == 0
    nothing = language_id.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_mixtures_are_found():
    """Texts drawn from two languages in known proportions, and a long text cut into slices."""
    rnd = random.Random(3)
    words = {lang: ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 8))) for _ in range(300)] for lang, letters in (("aa", "abcdefgh"), ("bb", "abcdmnop"), ("cc", "wxyzabmn"))}
    texts = {lang: [" ".join(rnd.choices(w, k=400)) for _ in range(30)] for lang, w in words.items()}
    counts = []
    for lang in sorted(texts):
        total = [0] * language_id.BUCKETS
        for _, _, _, bucket, n in language_id.features(texts[lang]):
            for b, x in zip(bucket.tolist(), n.tolist(), strict=True):
                total[b] += x
        counts.append(total)
    model = language_id.Model(sorted(texts), language_id.np.array(counts, float))
    mixed = [" ".join(rnd.choices(words["aa"], k=int(400 * part)) + rnd.choices(words["bb"], k=400 - int(400 * part))) for part in (1.0, 0.8, 0.5, 0.2, 0.0)]
    found = language_id.mixtures(model, mixed)
    for (share, _), part in zip(found, (1.0, 0.8, 0.5, 0.2, 0.0), strict=True):
        assert abs(share[0] - part) < 0.08 and share[2] == 0
        assert (share > 0).sum() == (1 if part in (0.0, 1.0) else 2)


def test_long_texts_count_whole(monkeypatch):
    text = "Ein Wort, été " * 3000
    [(_, _, _, bucket, count)] = language_id.features([text])
    monkeypatch.setattr(language_id, "SLICE_CHARS", 1001)
    [(_, _, _, bucket2, count2)] = language_id.features([text])
    assert bucket.tolist() == bucket2.tolist() and count.tolist() == count2.tolist()
    assert sum(count.tolist()) == sum(c.isalpha() for c in text)


# --- 13 ---


def diverged(rows, min_docs=30, top=50):
    """All rows of the result by whole numbers of Python."""
    cut = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    lower = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
    counts, n_docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = Counter(cut.findall((text or "").translate(lower)))
        counts[lang, source] += found
        n_docs[lang].update(found.keys())
        sources[lang].add(source)
    out = set()
    for lang, own in sources.items():
        kept = [t for t, n in n_docs[lang].items() if n >= min_docs]
        whole = {t: sum(counts[lang, s][t] for s in own) for t in kept}

        def shares(of):
            total = sum(of[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (of[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in own}, shares(whole)
        for s in own:
            pairs = sorted(((-sum(abs(p[s][t] - p[x][t]) for t in kept), x.encode(), x) for x in own if x != s))
            out |= {(lang, s, "pair", x, -v, k) for k, (v, _, x) in enumerate(pairs, 1)}
            more = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(more[:top], 1)}
    return out


def as_rows(df):
    rows = [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("min_docs", "top"), [(1, 50), (2, 3), (30, 50)])
def test_divergences_of_awkward_rows(awkward, min_docs, top):
    assert as_rows(source_audit.divergences(awkward, min_docs, top)) == diverged(AWKWARD, min_docs, top)


def test_divergences_of_many_sources(spark, monkeypatch):
    """Ties, terms that tasks hand on early, and blocks of one term."""
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choices("Ab cd éf gh ij kl mn op qr st".split(), k=rnd.randint(0, 12))), rnd.choice(["x", "y", None]), f"s{rnd.randint(0, 8)}") for i in range(400)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    assert as_rows(source_audit.divergences(df, 10, 4)) == diverged(rows, 10, 4)
    assert source_audit.divergences(df.limit(0)).count() == 0


def test_shares_do_not_overflow(spark):
    n = 5 * 10**15
    got = spark.range(1).select(source_audit._share(F.lit(n), F.lit(3 * n), F.lit(7)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (3 * n + 35) and math.isclose(got, 1e9 / 3, rel_tol=1e-6)


def test_terms_are_cut_in_slices(monkeypatch):
    text = "Éa b1c_d DEF ".encode() * 200
    whole = source_audit.terms(text)
    monkeypatch.setattr(source_audit, "SLICE_BYTES", 7)
    held = source_audit._Held()
    assert source_audit.terms(text) == whole == {"Éa".encode(): 200, b"b": 200, b"c": 200, b"d": 200, b"def": 200}
    held.add(("l", "s"), whole)
    held.add(("l", "s"), whole)
    [batch] = held.rows()
    assert batch.to_pylist()[0] == {"lang": "l", "source": "s", "term": None, "n": 0, "n_docs": 0}
    assert {r["term"]: (r["n"], r["n_docs"]) for r in batch.to_pylist()[1:]} == {t.decode(): (400, 2) for t in whole} and held.size == 0


# --- 5: the co-training itself, by plain means ---


def plain_raw(view, tokens):
    weights = dict(zip(view.names.tolist(), view.weights.tolist(), strict=True))
    return view.bias + sum(weights.get(t, 0.0) for t in tokens)


def plain_sure(view, tokens):
    """The label that a view gives, None where it is not sure."""
    p = 1 / (1 + math.exp(-max(-30.0, min(30.0, view.scale * plain_raw(view, tokens) + view.shift))))
    return 1.0 if p >= quality.SURE else 0.0 if p <= 1 - quality.SURE else None


def check_fit(view, sets, y):
    """Features, weights and calibration of a view against the conditions that define them."""
    learned = [(set(s), v) for i, (s, v) in enumerate(zip(sets, y, strict=True)) if i % 5 != 4]
    held = [(s, v) for i, (s, v) in enumerate(zip(sets, y, strict=True)) if i % 5 == 4]
    n, rate = len(learned), sum(v for _, v in learned) / len(learned)
    df, positive = Counter(t for s, _ in learned for t in s), Counter(t for s, v in learned for t in s if v)
    told = {t: abs(positive[t] - k * rate) / math.sqrt(k * rate * (1 - rate) + 1) for t, k in df.items() if k >= 4}
    chosen = sorted(t for t, x in sorted(told.items(), key=lambda x: (-x[1], x[0]))[: quality.FEATURES] if x > quality.TELLING)
    assert view.names.tolist() == chosen
    # 200 steps come close to the least of the penalised loss: better by far than the prior alone, and no step along the gradient gains much
    def loss(weights, bias):
        z = [bias + sum(weights.get(t, 0.0) for t in s) for s, _ in learned]
        return sum(math.log1p(math.exp(-abs(x))) + max(x, 0) - x * v for x, (_, v) in zip(z, learned, strict=True)) / n + 0.5e-4 * sum(w * w for w in weights.values())

    weights = dict(zip(chosen, view.weights.tolist(), strict=True))
    got = loss(weights, view.bias)
    if chosen:
        assert got < 0.8 * loss({}, math.log(rate / (1 - rate)))
    z = [view.bias + sum(weights.get(t, 0.0) for t in s) for s, _ in learned]
    off = [1 / (1 + math.exp(-x)) - v for x, (_, v) in zip(z, learned, strict=True)]
    slope = {t: sum(r for r, (s, _) in zip(off, learned, strict=True) if t in s) / n + 1e-4 * weights[t] for t in chosen}
    lower = loss({t: w - 0.5 * slope[t] for t, w in weights.items()}, view.bias - 0.5 * sum(off) / n)
    assert lower > got - 0.01
    # Platt scaling: the derivatives by scale and shift are zero
    yes = sum(v for _, v in held)
    soft = [(yes + 1) / (yes + 2) if v else 1 / (len(held) - yes + 2) for _, v in held]
    raw = [plain_raw(view, s) for s, _ in held]
    if view.scale > 0:
        p = [1 / (1 + math.exp(-(view.scale * r + view.shift))) for r in raw]
        assert abs(sum((a - b) * r for a, b, r in zip(p, soft, raw, strict=True)) + 1e-3 * view.scale) < 1e-2
        assert abs(sum(a - b for a, b in zip(p, soft, strict=True))) < 1e-2


def test_co_training_by_plain_means(spark, monkeypatch):
    """What each view is taught is what the other was sure of, about all documents without a label; and each fit is what it should be."""
    import copy

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").unionByName(spark.createDataFrame([(10**6, 1, None)], LABELS))
    fits, fit = [], quality.CoTrained.fit

    def noted(self, sets, y, taught):
        fit(self, sets, y, taught)
        fits.append((copy.deepcopy(self.views), [list(map(list, s)) for s in sets], list(y), copy.deepcopy(taught)))

    monkeypatch.setattr(quality.CoTrained, "fit", noted)
    tokens = quality.tokenized(docs)
    quality.train(tokens, labels, rounds=1)
    assert len(fits) == 4  # two targets, before and after the round
    rows = [(r.id, r.th, [[x & 0xFFFFFFFF for x in v] for v in (r.content, r.metadata)]) for r in tokens.collect()]
    known = {r.doc_id: r for r in labels.collect()}
    for target, before, after in zip(quality.TARGETS, fits[:2], fits[2:], strict=True):
        views, sets, y, taught = before
        assert taught == [{}, {}] and len(y) == sum(getattr(r, target) is not None for i, r in known.items() if i < 10**6)
        for k in (0, 1):
            check_fit(views[k], sets[k], y)
            want = {(i, th): plain_sure(views[k], v[k]) for i, th, v in rows if i not in known or getattr(known[i], target) is None}
            want = {key: label for key, label in want.items() if label is not None}
            got = {key[1:]: label for key, (label, _) in after[3][1 - k].items()}
            assert got == want
            own = {(i, th): v[1 - k] for i, th, v in rows}
            assert all(sorted(s.tolist()) == sorted(own[key[1:]]) for key, (_, s) in after[3][1 - k].items())
        for k in (0, 1):
            more = [after[3][k][key] for key in sorted(after[3][k])]
            check_fit(after[0][k], after[1][k] + [s.tolist() for _, s in more], after[2] + [label for label, _ in more])
