"""The operators against brute force, round trips, held-out accuracy and awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geolith.llm import byte_bpe, chat, dac, decontaminate, fingerprints, line_dedup, minhash, quality, substring_dedup, url_filter
from geolith.llm.common import read_table
from geolith.llm.queries import ORACLE_SQL, QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"
#: Nulls, empty and blank texts, equal and repeated rows, and a very long text.
AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two three"),
    (4, "one two three"),
    (5, "one two three"),
    (None, "a row without an id"),
    (6, "word " * 60_000),
    (7, "été Ünïcode 中文 😀 words\nand lines\nand lines\n"),
    (8, "\x1codd \x85 space\u3000here"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(AWKWARD, DOCS)
    extra = ("id", "th", "pos", "rank", "part", "key", "a", "b", "n", "words", "runs", "_starts", "source")
    return df.withColumns({c: F.lit(None).cast("string") for c in extra})


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def rows_of(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted(c.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall(), key=repr)


# --- 1 ---


def shingle_set(text):
    w = re.split(r"[ \t\n\x0b\f\r]+", text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_fingerprints_estimate_without_bias(spark, texts):
    got = rows_of(QUERIES["op1_fingerprints"](spark, SF), "doc_id")
    ids = sorted(texts)
    errors, beside = [], []
    for k, i in enumerate(ids):
        t, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == sha(edited)
        a, b = shingle_set(t), shingle_set(edited)
        errors.append(got[i].near_edited - len(a & b) / len(a | b))
        c = shingle_set(following)
        beside.append(got[i].near_next - len(a & c) / len(a | c))
    assert abs(np.mean(beside)) < 0.01 and np.max(np.abs(beside)) < 0.16
    assert len(got) == len(ids) and abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.16
    by_text = {}
    for i, r in got.items():
        assert by_text.setdefault(texts[i], r.fingerprint) == r.fingerprint


def test_fingerprints_of_awkward_texts(awkward, empty):
    out = fingerprints.fingerprint_edits(awkward).collect()
    assert len(out) == len(AWKWARD)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].fingerprint == by[2][0].fingerprint and by[1][0].near_next == 1.0
    assert by[4][0].fingerprint == by[4][1].fingerprint == by[5][0].fingerprint
    assert by[4][0].near_next == 1.0 and all(0 <= r.near_edited <= 1 for r in out)
    assert by[8][0].edited_sha256  # the last is edited with the first, the row without an id
    assert fingerprints.fingerprint_edits(empty).count() == 0
    alone = fingerprints.fingerprint_edits(awkward.where("doc_id = 5")).first()
    assert alone.near_next == 1.0


# --- 2 ---


def brute_lines(rows, k, min_words=None):
    """Kept text of each (doc_id, text), by windows of k lines that are not blank, and by single lines of ``min_words`` words."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = t.split("\n")
        full = [n for n, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for p in range(len(full) - k + 1):
            w = tuple(lines[n] for n in full[p : p + k])
            if w in seen:
                gone.update(range(p, p + k))
            seen.add(w)
        for p in range(len(full)):
            line = lines[full[p]]
            if min_words and len([x for x in line.split(" ") if x]) >= min_words:
                if ("single", line) in seen:
                    gone.add(p)
                seen.add(("single", line))
        place, kept = -1, []
        for n, x in enumerate(lines):
            place += n in full
            if place not in gone:
                kept.append(x)
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_line_dedup_equals_brute_force(spark, k):
    rnd = random.Random(k)
    rows = [(i, "\n".join(rnd.choice(["a", "b", "c", "", " ", "x" * 9, str(rnd.randrange(40))]) for _ in range(rnd.randrange(0, 40)))) for i in range(40)]
    rows += [(100 + i, t) for i, t in rows[:5]]
    got = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, DOCS), k).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(rows, k)


def test_line_dedup_of_single_lines_with_enough_words(spark):
    rnd = random.Random(3)
    pool = ["a b c d e", "a  b c d e ", "one two", "x", "", " ", "f g h i j k", "l m n o"]
    rows = [(i, "\n".join(rnd.choice([*pool, *(f"own {i} {k}" for k in range(8))]) for _ in range(rnd.randrange(0, 12)))) for i in range(60)]
    got = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(rows, 2, 5)


def test_suffix_array_and_common_prefixes(spark):
    rnd = random.Random(12)
    rows = [(i, "\n".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 25)))) for i in range(25)]
    long = [rnd.choice("abcdefghij") for _ in range(90)]
    rows += [(100, rows[0][1]), (101, "only here"), (200, "\n".join(long)), (201, "\n".join(long[3:])), (202, "\n".join([*long[:50], "unique", *long[51:]])), (203, "\n".join([*long[:70], "a", *long[71:]]))]
    got = line_dedup.suffix_array(spark.createDataFrame(rows, DOCS)).orderBy("part", "at").collect()
    texts = {i: t.split("\n") for i, t in rows}
    ends = {i: [next((k for k in range(p, len(t)) if t[k] in ("only here", "unique")), len(t)) for p in range(len(t))] for i, t in texts.items()}
    suffixes = [tuple(texts[r.id][r.pos : ends[r.id][r.pos]]) for r in got]
    assert len(got) == sum(map(len, texts.values())) - 2  # all lines but those that occur once
    assert all((a.rank == b.rank) == (s == t) and a.rank <= b.rank for a, b, s, t in zip(got, got[1:], suffixes, suffixes[1:], strict=False))
    line = {}
    for r in got:
        line[r.line] = texts[r.id][r.pos]
    order = {v: k for k, v in line.items()}
    keys = [[order[x] for x in s] for s in suffixes]
    assert keys == sorted(keys)

    def shared(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    assert [r.lcp for r in got] == [0] + [shared(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False)]


def brute_runs(rows, k):
    """Maximal stretches of lines under windows of k lines that stand earlier."""
    seen, out = set(), []
    for i, t in sorted(rows):
        full = [x for x in t.split("\n") if x.strip(" ")]
        gone = [False] * len(full)
        for p in range(len(full) - k + 1):
            w = tuple(full[p : p + k])
            if w in seen:
                gone[p : p + k] = [True] * k
            seen.add(w)
        begin = [p for p in range(len(full)) if gone[p] and not (p and gone[p - 1])]
        out += [(i, p, next((q for q in range(p, len(full)) if not gone[q]), len(full)) - p) for p in begin]
    return sorted(out)


def test_repeated_runs_are_maximal(spark, docs, texts):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\ny\nd\ne"), (3, "b\nc")]
    got = line_dedup.repeated_runs(spark.createDataFrame(rows, DOCS), 2, None).collect()
    assert sorted((r.id, r.start, r.n_lines) for r in got) == [(2, 1, 3), (2, 5, 2), (3, 0, 2)]
    got = line_dedup.repeated_runs(docs, 2, None).collect()
    assert sorted((r.id, r.start, r.n_lines) for r in got) == brute_runs(texts.items(), 2)


def test_line_dedup_of_awkward_texts(awkward, empty):
    awkward = awkward.withColumns({c: F.lit("x") for c in ("k1", "segment", "lcp", "line", "wordy", "_later_id")})
    out = line_dedup.remove_repeated_lines(awkward)
    assert out.columns == awkward.columns and out.count() == len(AWKWARD)
    assert [r.text for r in out.where("doc_id = 4").collect()] == ["one two three"] * 2
    assert out.where("doc_id = 1").first().text is None
    assert line_dedup.remove_repeated_lines(empty).count() == 0 and line_dedup.repeated_runs(empty).count() == 0
    assert line_dedup.digest_lines(awkward).where("doc_id = 7").first().n_lines == 4


# --- 3 ---


def test_dac_gives_any_token():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = (rnd.integers(0, 1 << 32, n) >> rnd.integers(0, 32, n)).astype(np.uint32)
        block = dac.DacBlock(dac.dac_encode(ids))
        assert len(block) == n and (block.all() == ids).all()
        assert [block.get(i) for i in range(n)] == ids.tolist()


@pytest.mark.parametrize("block_tokens", [dac.BLOCK_TOKENS, 1000])
def test_token_output(spark, docs, texts, tmp_path, block_tokens):
    folder = str(tmp_path / "tokens")
    dac.write_tokens(docs, WORDS, folder, block_tokens=block_tokens)
    got = rows_of(dac.read_tokens(spark, folder), "doc_id")
    tokenizer, start = Tokenizer.from_file(WORDS), 0
    for i in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_output_of_awkward_texts(spark, awkward, empty, tmp_path):
    dac.write_tokens(awkward, WORDS, str(tmp_path / "a"), block_tokens=10)
    got = dac.read_tokens(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8] and got[1].n_tokens == 1
    dac.write_tokens(empty, WORDS, str(tmp_path / "e"))
    assert dac.read_tokens(spark, str(tmp_path / "e")).count() == 0
    coder, rnd = dac.word_coder(open(WORDS, encoding="utf-8").read()), random.Random(4)
    assert coder.by_word
    for _ in range(500):
        t = "".join(rnd.choice(" \n\t'sSt9½²éßÜЖ中😀\u0301\u3000\x1c\x85.,!aaathe<|endoftext|>"[: rnd.choice([30, 60])]) for _ in range(rnd.randrange(40)))
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode("a <|endoftext|> b"), "<u4").tolist() == coder.tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids


# --- 4 ---


@pytest.mark.parametrize("block_words", [decontaminate.MAX_BLOCK_WORDS, 5])
def test_decontamination_in_blocks(spark, block_words):
    rnd = random.Random(9)
    word = lambda: rnd.choice(["Ab", "cd", "é", "中", "9"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([0, 3, 14, 20])))) for i in range(20)] + [(99, None), (None, "Ab cd Ab cd")]
    rows = [(i, " - ".join([items[i % 20][1], *(word() for _ in range(rnd.randrange(30)))])) for i in range(40)] + AWKWARD
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("h1", "_h1", "n_words")})
    got = decontaminate.scan(table, bench, max_block_words=block_words).collect()
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for i, t in rows:
        w, hit, names = split(t), set(), []
        for name, item in items:
            v = split(item)
            n = min(13, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in wins] if n else []
            hit.update(x for k in at for x in range(k, k + n))
            names += [name] * bool(at)
        want.append((i, len(w), len(hit), len(names), sha(",".join(sorted(str(x) for x in names if x is not None))), bool(hit) and 20 * len(hit) >= len(w)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    left = decontaminate.filter_documents(table, bench, max_block_words=block_words)
    assert left.columns == table.columns and sorted(repr(r.doc_id) for r in left.collect()) == sorted(repr(w[0]) for w in want if not w[-1])


def test_decontamination_spans_and_filter(spark, awkward, empty):
    text = "Été: ONE, two;  three!"
    assert [text[a:b] for a, b in decontaminate.hit_spans(text, [(0, 1), (1, 3)])] == ["Été", "ONE, two"]
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    kept = decontaminate.filter_documents(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) - 3
    assert decontaminate.filter_documents(awkward, bench.limit(0)).count() == len(AWKWARD)
    assert decontaminate.scan(empty, bench).count() == 0


# --- 5 ---


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    scores = quality.score_documents(docs, labels.where("doc_id % 5 <> 0"))
    held = scores.join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    clean = [r for r in held if r.quality == 1 and r.toxic == 0]
    assert np.mean([(r.p_quality >= 0.5) == (r.quality == 1) for r in held]) > 0.9
    assert np.mean([r.kept for r in clean]) > 0.9
    assert scores.count() == docs.count()


def test_quality_without_labels_and_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, None, None), (77, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_documents(awkward, labels.limit(0))
    assert out.count() == len(AWKWARD) and out.where("kept").count() == len(AWKWARD)
    assert quality.filter_documents(awkward, labels).columns == awkward.columns
    assert quality.score_documents(empty, labels).count() == 0


def test_quality_scores_combine_calibrated_views(spark, docs, awkward):
    """The combination by hand, from the fitted weights, for the given documents and for awkward rows beside them."""
    labels = read_table(spark, SF, "labels")
    both = docs.select("doc_id", "text", "source", "lang", "n_chars").unionByName(awkward.select("doc_id", "text", "source", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("n_chars")))
    models = quality.train(quality.tokenized(both), labels)
    got = Counter((r.doc_id, *(round(v, 9) for v in (r.p_quality, r.p_toxic, r.score)), r.kept) for r in quality.score_documents(both, labels).collect())
    want = Counter()
    for r in both.collect():
        text, p = r.text or "", []
        distinct, shape = quality.content_tokens(text)
        tokens = ([*distinct, *shape], quality.metadata_tokens(text, r.source, r.lang, r.n_chars))
        for t in quality.TARGETS:
            logit = -models[t].prior
            for view, own in zip(models[t].views, tokens, strict=True):
                weights = dict(zip(view.names.tolist(), view.weights.tolist(), strict=True))
                logit += view.scale * (view.bias + sum(weights.get(quality._hash(x), 0.0) for x in own)) + view.shift
            p.append(1 / (1 + np.exp(-min(30, max(-30, logit)))))
        want[(r.doc_id, *(round(float(v), 9) for v in (p[0], p[1], p[0] * (1 - p[1]))), bool(p[0] >= 0.5 and p[1] <= 0.5))] += 1
    assert got == want
    kept = quality.filter_documents(both.withColumnRenamed("lang", "c0").withColumn("th", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "source", "c0", "n_chars", "th"] and kept.count() > 0
    assert sum(r.kept for r in quality.score_documents(both, labels).collect()) == quality.filter_documents(both, labels).count()


def test_quality_fits_one_row_of_each_labelled_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other")], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(quality.tokenized(docs), labels)["quality"].prior == 0.0  # one of each, not 50 to one


def test_quality_views_teach_from_all_documents(spark):
    word = lambda good: "good words here" if good else "bad words there"
    rows = [(i, word(i % 2), f"s{i // 2 % 3}") for i in range(1200)]  # labelled: only the content tells
    rows += [(2000 + i, f"{i * 7919}", "plain") for i in range(3000)]  # no view is sure of these
    rows += [(9000 + i, word(True), "rare") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1200)], "doc_id long, quality int, toxic int")
    metadata = quality.train(quality.tokenized(docs), labels, max_unlabelled=60)["quality"].views[1]
    assert quality._hash("source=rare") in metadata.names and metadata.weights[metadata.names == quality._hash("source=rare")] > 0


# --- 6 ---


def test_urls(spark):
    urls = ["http://a.com/x", "https://EXAMPLE.com/en/1?q", "http://www.example.com/en/", "http://x.net/es/2", "http://net/fr/", "http://a.org/", "http://a.com", "no url", None, "http://example.com/english", "http://notexample.com/en/", "a://b://c.net/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    rules = spark.createDataFrame(URL_RULES, url_filter.RULES_SCHEMA)
    want = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/", "allow"), ("com/", "allow"), (None, "allow")]
    for most in (url_filter.MAX_BROADCAST_RULES, 2):  # the trie, and the join
        got = url_filter.judge_urls(pages, rules, max_broadcast_rules=most).orderBy("page_id").collect()
        assert [(r.rule, r.verdict) for r in got] == want
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
    odd = ["http://a.com?u=http://b.net/fr/", "http://a.com#x://c.net/es/q", "http://A.net/fr/" + "x/" * 50_000, "http://" + "a." * 5000 + "net/es/", "http://a.net/fr/x", "http://a.net/fr/x"]
    for most in (url_filter.MAX_BROADCAST_RULES, 2):
        got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(odd)), "page_id long, url string"), rules, max_broadcast_rules=most).orderBy("page_id").collect()
        assert [(r.host, r.path) for r in got[:2]] == [("a.com", "")] * 2 and got[2].path == "/fr/" + "x/" * 50_000
        assert [r.rule for r in got] == [None, None, "net/fr/", "net/es/", "net/fr/", "net/fr/"]
    rnd = random.Random(5)
    many = [(rnd.choice(["allow", "block"]), rnd.choice(["com", "a.com", "b.a.com", "net"]), "/" + "".join(rnd.choice("ab/") for _ in range(rnd.randrange(6)))) for _ in range(60)]
    some = [(i, f"http://{rnd.choice(['a.com', 'b.a.com', 'c.b.a.com', 'x.net', 'com'])}/{''.join(rnd.choice('ab/') for _ in range(8))}") for i in range(300)]
    by_trie, by_join = (sorted(map(tuple, url_filter.judge_urls(spark.createDataFrame(some, "page_id long, url string"), spark.createDataFrame(many, url_filter.RULES_SCHEMA), max_broadcast_rules=most).collect())) for most in (100, 5))
    assert by_trie == by_join
    both = spark.createDataFrame([("allow", "a.com", "/x"), ("block", "a.com", "/x"), ("allow", "com", "/x/y/z")], url_filter.RULES_SCHEMA)
    for most in (10, 1):
        assert url_filter.judge_urls(pages.limit(1), both, max_broadcast_rules=most).first().verdict == "block"


# --- 7 ---


def test_chat_round_trip():
    rnd = random.Random(6)
    bits = [*chat.CONTROLS, "\\", " ", "\n", "ok", "<", "[", "/", "INST]", "é"]
    for _ in range(3000):
        turns = [(rnd.choice(["user", "assistant", "system", "tool", "", "a\\b\n[ROLE]"]), "".join(rnd.choice(bits) for _ in range(rnd.randrange(8)))) for _ in range(rnd.randrange(5))]
        text, spans = chat.render(turns)
        assert [t[:2] for t in chat.parse(text)] == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]
    assert chat.render([("user", "plain")])[0] == "[INST] plain [/INST]"
    with pytest.raises(ValueError):
        chat.parse("[INST] never closed")


def test_chat_awkward_tables(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, None, None, "x"), (None, 0, "user", "u"), (2, 0, "user", "same"), (2, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(0))
    got = rows_of(chat.read_back(chat.format_conversations(df)), "conv_id")
    assert got[1].turns_sha256 == sha("\nx\nuser\n\nassistant\nb\n") and got[1].loss_sha256 == sha("b")
    assert got[2].n_turns == 2 and got[None].n_turns == 1 and got[None].loss_chars == 0
    alone = chat.read_back(chat.format_conversations(spark.createDataFrame([(None, 0, "user", "u")] * 3 + [(7, 0, "user", "long [INST] " * 100_000)], "conv_id long, turn long, role string, text string")))
    assert sorted((r.n_turns, r.conv_id) for r in alone.collect() if r.conv_id is None) == [(1, None)] * 3
    assert alone.where("conv_id = 7").first().n_turns == 1
    assert chat.format_conversations(df.limit(0)).count() == 0


# --- 8 ---


def brute_windows(rows, w):
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - w + 1):
            key = tuple(words[k : k + w])
            if key in seen:
                gone[k : k + w] = [True] * w
            seen.add(key)
        kept = [x for x, g in zip(words, gone, strict=True) if not g]
        out[i] = (len(words), sum(gone), sha(b" ".join(kept)))
    return out


@pytest.mark.parametrize(("window", "block"), [(20, substring_dedup.BLOCK_WORDS), (20, 2000), (3, 500), (1, 100)])
def test_substring_dedup_equals_brute_force(spark, docs, texts, window, block):
    rnd = random.Random(window)
    rows = [*texts.items(), *((10_000 + i, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(60)))) for i in range(60)), (20_000, "z " * 100)]
    got = substring_dedup.digest_repeats(spark.createDataFrame(rows, DOCS), window, block).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_windows(rows, window)


@pytest.mark.parametrize(("window", "block"), [(20, substring_dedup.BLOCK_WORDS), (20, 2000), (3, 500)])
def test_factors_equal_their_sources(spark, docs, texts, window, block):
    rnd = random.Random(window)
    rows = [*texts.items(), *((10_000 + i, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(60)))) for i in range(60)), (20_000, "z " * 100)]
    words = {i: (t or "").encode().split() for i, t in rows}
    covered = {i: [False] * len(w) for i, w in words.items()}
    got = substring_dedup.factors(spark.createDataFrame(rows, DOCS), window, block).collect()
    for r in got:
        assert r.n_words >= window and (r.source_id, r.source_start) < (r.doc_id, r.start)
        assert words[r.doc_id][r.start : r.start + r.n_words] == words[r.source_id][r.source_start : r.source_start + r.n_words]
        covered[r.doc_id][r.start : r.start + r.n_words] = [True] * r.n_words
    assert {i: sum(c) for i, c in covered.items()} == {i: n for i, (_, n, _) in brute_windows(rows, window).items()}
    last = {}
    for r in sorted(got):  # a factor goes on as long as its source does
        before = last.get(r.doc_id)
        assert before is None or not (before.start + before.n_words - window + 1 == r.start and (before.source_id, before.source_start + before.n_words - window + 1) == (r.source_id, r.source_start))
        last[r.doc_id] = r


def test_substring_dedup_of_many_rows_without_an_id(spark):
    rows = [(None, f"a b c d e f own{i} words{i}") for i in range(50)] + [(None, "a b c d e f")] * 3 + [(7, "x a b c d e f y")]
    got = substring_dedup.digest_repeats(spark.createDataFrame(rows, DOCS), 5).collect()
    assert sum(r.n_removed == 0 for r in got) == 1 and sum(r.n_removed == 6 for r in got) == 53


def test_substring_dedup_of_awkward_texts(spark, awkward, empty):
    got = substring_dedup.digest_repeats(awkward).collect()
    assert len(got) == len(AWKWARD)
    long = next(r for r in got if r.doc_id == 6)
    assert (long.n_words, long.n_removed) == (60_000, 59_999)
    assert substring_dedup.repeated_spans(awkward).collect() == [(6, 1, 59_999)]
    again = [r.n_removed for r in substring_dedup.digest_repeats(spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e")], DOCS), 3).collect()]
    assert sorted(again) == [0, 5]
    assert substring_dedup.digest_repeats(empty).count() == 0
    assert substring_dedup.remove_repeats(awkward).where("doc_id = 7").first().text == "été Ünïcode 中文 😀 words and lines and lines"


# --- 9 ---


def overlap(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_bag_minhash_is_unbiased():
    rnd, errors = random.Random(2), []
    for _ in range(150):
        base = [rnd.randrange(10**9) for _ in range(rnd.choice([1, 3, 30, 200]))]
        a = Counter({x: rnd.choice([1, 1, 2, 3, 7, 50]) for x in base})
        b = Counter({x: n if rnd.random() < 0.7 else rnd.choice([1, 2, 60]) for x, n in a.items()})
        rows = [(i, x, n) for i, s in enumerate((a, b)) for x, n in sorted(s.items())]
        sig = minhash.bag_minhash(*(np.array([r[k] for r in rows], np.uint64 if k == 1 else np.int64) for k in range(3)), 2)
        errors.append((sig[0] == sig[1]).mean() - overlap(a, b))
    assert abs(np.mean(errors)) < 0.012 and np.max(np.abs(errors)) < 0.2


def shingle_bag(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows, threshold=0.8):
    bags, parent = {i: shingle_bag(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if root(i) != root(j) and (overlap(bags[i], bags[j]) >= threshold or not (bags[i] or bags[j])):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("some", [1 << 20, 5000])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, some):
    monkeypatch.setattr(minhash, "CHUNK_BYTES", some)
    monkeypatch.setattr(minhash, "SLICE_BYTES", 2 * some)
    rnd, rows = random.Random(8), []
    for g in range(6):  # groups whose copies are edited more and more
        base = [f"w{g}x{rnd.randrange(500)}" for _ in range(200)]
        for k in range(30):
            copy = list(base)
            for _ in range(rnd.randrange(0, 9)):
                copy[rnd.randrange(200)] = f"e{rnd.randrange(10**6)}"
            rows.append((g * 100 + k, " ".join(copy)))
    rows += [(1000, ""), (1001, " "), (1002, "short text"), (1003, "short  text"), (1004, "x " * 50), (1005, "x " * 52)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_that_the_signatures_rule_out(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SLACK", -10.0)  # no estimate is high enough: only the second pass finds links
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, "something else altogether, all alone")]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_near_duplicates_of_awkward_texts(awkward, empty):
    got = rows_of(minhash.near_duplicates(awkward), "doc_id")
    assert len(got) == 9 and got[5].class_id == 4 and got[2].class_id == 1 and got[3].class_id == 1 and got[None].kept
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.near_duplicates(awkward).count() == len(AWKWARD)


def test_near_duplicates_without_ids_or_with_shared_ones(spark):
    """Each row is judged by its own text, whatever other rows its doc_id names."""
    words = [f"w{i}" for i in range(100)]
    near = " ".join([*words[:-1], "other"])
    rows = [(None, "one lonely text"), (None, " ".join(words)), (None, "another lonely text"), (7, near), (7, "something else"), (8, "something else"), (9, "a text twice"), (9, "a text twice"), (None, "one lonely text")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], DOCS + ", row long")
    out = minhash.near_duplicates(df).collect()
    assert sorted(map(repr, ((r.doc_id, r.class_id, r.kept) for r in out))) == sorted(
        map(repr, [(None, None, True)] * 4 + [(7, None, False), (7, 7, True), (8, 7, False), (9, 9, True), (9, 9, True)])
    )
    kept = [tuple(r) for r in minhash.keep_first(df).collect()]
    assert sorted(str(r[:2]) for r in kept) == sorted(map(str, [rows[0], rows[1], rows[2], rows[4], rows[6]]))
    assert minhash.keep_first(df).columns == df.columns


def thue_morse(n):
    """A word of 2**n letters and the word with the letters exchanged: sums of powers modulo 2**64 cannot tell them apart from 1024 letters on."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_patterned_words_are_told_apart(spark):
    a, b = thue_morse(11)
    many = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([*many, a])), (2, " ".join([*many, b])), (3, " ".join([*many, a])), (4, a), (5, b)]
    df = spark.createDataFrame(rows, DOCS)
    removed = {r.doc_id: r.n_removed for r in substring_dedup.digest_repeats(df).collect()}
    assert removed == {1: 0, 2: 0, 3: 20, 4: 0, 5: 0}
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df.where("doc_id > 3")).collect()} == {4: 4, 5: 5}
    values = np.array([3, 5], np.uint64)
    x, y = (np.where(np.array(list(w)) == "a", *values) for w in (a, b))
    assert substring_dedup._rolled(x, 2048, substring_dedup._BASES[0])[0] != substring_dedup._rolled(y, 2048, substring_dedup._BASES[0])[0]


# --- 10 ---


def test_byte_bpe_as_tiktoken(spark, docs, texts, awkward, empty):
    ranks = byte_bpe.read_ranks(RANKS)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df, rows in ((docs, list(texts.items())), (awkward, AWKWARD), (empty, [])):
        want = []
        for i, t in rows:
            ids = np.array(reference.encode_ordinary(t or ""), "<u4")
            want.append((i, len(ids), sha(ids.tobytes()), sha(t or "")))
        got = byte_bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    coder, rnd = byte_bpe.coder(byte_bpe.tokenizer_json(ranks), public_tokenizers.PATTERN), random.Random(1)
    for _ in range(1500):
        t = "".join(rnd.choice(" \n\t\r'sStTreveLm09½²ªéß😀👍\u0301\u200b\xa0\u3000\x1c.,!aaaathe\x00中文字") for _ in range(rnd.randrange(40)))
        ids = coder.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)
        assert coder.decode(np.frombuffer(ids, "<u4").tolist()).decode() == t
        spans = coder.spans(t, ids)
        assert not t or (spans[0][0] == 0 and spans[-1][1] == len(t) and all(b[0] in (a[1], a[1] - 1) for a, b in zip(spans, spans[1:], strict=False)))


def test_byte_bpe_operators(spark):
    df = spark.createDataFrame([(1, "héllo 😀 world"), (2, None)], DOCS)
    encoded = byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    r = rows_of(encoded, "doc_id")
    assert len(r[1].ids) == len(r[1].starts) == len(r[1].ends) and r[2].ids == []
    odd = spark.createDataFrame([(1, [10**9, -1, None]), (2, None)], "doc_id long, ids array<int>")
    assert [bytes(x.decoded) for x in byte_bpe.decode(odd, RANKS, public_tokenizers.PATTERN).collect()] == [b"", b""]
    across = byte_bpe.coder(byte_bpe.tokenizer_json(byte_bpe.read_ranks(RANKS)), r"(?s).{1,3}")
    assert not across.by_chunk and across.decode(np.frombuffer(across.encode("a b  c d"), "<u4").tolist()) == b"a b  c d"
    assert byte_bpe.coder(byte_bpe.tokenizer_json(byte_bpe.read_ranks(RANKS)), public_tokenizers.PATTERN).by_chunk
    assert {x.doc_id: bytes(x.decoded).decode() for x in byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()} == {1: "héllo 😀 world", 2: ""}


# --- the pipeline ---


def test_pipeline_run_equals_brute_force(spark, docs, texts):
    """All stages after the classifier by brute force, from what the classifier keeps to the ids of the last table."""
    import corpus_pipeline as p

    got = rows_of(p.run(spark, SF), "doc_id")
    kept = {r.doc_id for r in quality.score_documents(docs, read_table(spark, SF, "labels")).where("kept").collect()}
    lines = brute_lines([(i, texts[i]) for i in kept], line_dedup.MIN_LINES, line_dedup.MIN_WORDS)
    first = {i for i, c in brute_classes(list(lines.items())).items() if i == c}
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in read_table(spark, SF, "benchmark").collect():
        w = split(r.text)
        windows |= {tuple(w[k : k + min(13, len(w))]) for k in range(max(1, len(w) - 12))} if w else set()
    sizes, clean = {len(w) for w in windows}, set()
    for i in first:
        w, hit = split(lines[i]), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            clean.add(i)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    assert set(got) == clean and 0 < len(clean) < len(first) < len(lines) <= len(texts)
    for i, r in got.items():
        ids = reference.encode_ordinary(lines[i])
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == sha(lines[i])


def test_pipeline_stages(spark, docs, texts):
    import corpus_pipeline as p

    kept, stage = docs, dict(p.STAGES)
    for name in ("quality", "lines", "near_duplicates", "decontamination"):
        before = rows_of(kept, "doc_id")
        out = stage[name](spark, kept, SF)
        assert out.columns == docs.columns
        after = rows_of(out, "doc_id")
        assert set(after) <= set(before)
        if name == "lines":
            want = brute_lines([(i, r.text) for i, r in before.items()], line_dedup.MIN_LINES, line_dedup.MIN_WORDS)
            assert {i: r.text for i, r in after.items()} == want and all(r.n_chars == len(r.text) for r in after.values())
        else:
            assert all(after[i] == before[i] for i in after)
        if name == "near_duplicates":
            assert set(after) == {i for i, c in brute_classes([(i, r.text) for i, r in before.items()]).items() if i == c}
        if name == "decontamination":
            bad = rows_of(decontaminate.scan(kept, read_table(spark, SF, "benchmark")), "doc_id")
            assert set(after) == {i for i in before if not bad[i].contaminated}
        if name == "quality":
            labels = rows_of(read_table(spark, SF, "labels"), "doc_id")
            clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
            assert np.mean([i in after for i in clean]) > 0.95
        kept = spark.createDataFrame(list(after.values()), docs.schema)
    assert rows_of(stage["tokens"](spark, kept, SF), "doc_id").keys() == after.keys()
    empty = docs.limit(0)
    for name, run in p.STAGES:
        assert run(spark, empty, SF).count() == 0, name
