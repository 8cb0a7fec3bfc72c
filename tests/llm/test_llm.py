"""The text operators on small fixtures, against brute force and with the cases they define."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from stratafold.llm import (
    decontaminate,
    html_text,
    lm,
    minhash,
    mixing,
    pii,
    quality,
    secret_scan,
    sharding,
    vectors,
)
from stratafold.llm.common import components
from stratafold.llm.crf import viterbi
from stratafold.llm.lattice import Lattice
from stratafold.llm.queries import ORACLE, QUERIES
from compare import connect, duck_rows, same, spark_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, token string, row string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty, very long, repeated rows, ties and columns named like the operators' own."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, base),
        (2, base),
        (2, base),
        (3, base.replace("w58", "x")),
        (4, None),
        (5, ""),
        (6, " \n\t"),
        (None, "lonely words in a row without an id"),
        (7, "long " * 60_000),
        (8, "mail a.b@c.example.org ip 10.0.0.255 card 4111 1111 1111 1111 call +1 (317) 555-3649"),
        (9, 'password = "abcdef123456" AKIAABCDEFGHIJKLMN deadbeefdeadbeef12'),
        (10, "É é ß 漢字 😀"),
    ]
    table = [(i, t, "en", f"s{(i or 0) % 3}", 0, "x", "y") for i, t in rows]
    return spark.createDataFrame(table, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def jaccard_components(rows):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (10, 11), (12, 12)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {3: 3, 4: 3, 5: 3, 9: 3, 10: 10, 11: 10}


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 3).collect()
    assert len(rows) == docs.count()
    assert {r.size for r in rows if r.doc_id in (4, 5)} == {1}
    assert {r.text_crc32 for r in rows if r.doc_id == 10} == {zlib.crc32("É é ß 漢字 😀".encode())}
    groups = {}
    for r in rows:
        groups.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(s) == 1 for s in groups.values())
    for s in range(3):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(empty).collect() == []


def test_longest_first_is_a_plain_heap():
    sizes = [9, 9, 9, 7, 5, 5, 5, 5, 5, 5, 5, 3, 2, 2, 1, 1, 1, 1]
    loads = [0] * 4
    for s in sizes:
        loads[loads.index(min(loads))] += s
    classes = [(s, n, s * n) for s, n in Counter(sizes).items()]
    got = [0] * 4
    for s, upto in sharding.longest_first(classes, 4).items():
        for shard, n in enumerate(np.diff([0, *upto])):
            got[shard] += s * n
    assert sorted(got) == sorted(loads)


def test_lattice_sums_all_segmentations():
    pieces = {"▁a": -1.0, "b": -2.0, "▁ab": -1.5, "c": -1.2, "bc": -0.7, "▁": -3.0, "a": -2.5}
    words = ["abc", "a", "abca", "z", ""]

    def brute(text):
        if not text:
            return 1.0
        total = 0.0
        for n in range(1, len(text) + 1):
            if text[:n] in pieces:
                total += math.exp(pieces[text[:n]]) * brute(text[n:])
        return total + math.exp(-20.0 * len(text[0].encode())) * brute(text[1:])

    found = Lattice(pieces).log_marginals(words)
    assert np.allclose(found, [math.log(brute("▁" + w)) for w in words])


def test_language_model(docs, empty):
    rows = lm.score(docs, head_words=5).collect()
    given = [(r.doc_id, r.text) for r in docs.collect()]
    train = Counter()
    for i, text in given:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            train.update([*lm.tokens(text), None])
    n, v = sum(train.values()), len(train)
    expected = []
    for i, text in given:
        found = [*lm.tokens(text), None]
        base = sum(math.log10((train[t] + 1) / (n + v + 1)) for t in found)
        expected.append((str(i), len(found), sum(train[t] > 0 for t in found), n, base))
    got = [(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows]
    for x, y in zip(sorted(got), sorted(expected)):
        assert x[:4] == y[:4] and math.isclose(x[4], y[4], rel_tol=1e-9)
    assert all(r.score < 0 for r in rows)
    assert lm.score(empty).collect() == []


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 32))
    near = base + rng.normal(size=base.shape) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, near, base[:5]]))]
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [1.0, 2.0]]
    rows += [(200 + i, v) for i, v in enumerate(odd)] + [(None, base[0].tolist())]
    found = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r.vec_id: r for r in found.collect()}
    x = np.vstack([base, near, base[:5], base[:1]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    degree = (x @ x.T >= 0.95).sum(1) - 1
    assert [got[i].n_links for i in range(85)] == degree[:85].tolist()
    assert all(got[40 + i].component_id == i for i in range(40))
    assert all(got[200 + i].n_links == 0 and got[200 + i].kept for i in range(5))
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(nothing).collect() == []


def test_vector_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.951 * x + math.sqrt(1 - 0.951**2) * y
    tables, hashes = vectors.shape_for(400, 64)
    _, own, _ = vectors.hashed(x, tables, hashes)
    _, own2, probes = vectors.hashed(z, tables, hashes)
    met = [bool(set(a) & ({*b} | {*c})) for a, b, c in zip(own, own2, probes)]
    assert np.mean(met) > 0.97


def test_quality(spark, docs, empty, small):
    tables = {n: spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels")}
    scored = quality.score(tables["documents"], tables["labels"])
    held = scored.where(quality.held_out()).join(tables["labels"], "doc_id")
    right = [r.predicted == r.quality for r in held.select("predicted", "quality").collect()]
    assert np.mean(right) > 0.95
    labels = spark.createDataFrame([(1, 1), (9, 0), (None, 1), (8, None)], "doc_id long, quality int")
    odd = quality.score(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in odd if r.doc_id in (4, 5, 6)} == {0.5}
    assert quality.score(empty, labels).collect() == []


def test_quality_voters_keep_the_classes_shares(spark):
    rows = [(i, f"word{i} and more", int(i % 10 > 0)) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    few = quality.fit(frame.drop("quality"), frame.drop("text"), labelled=50)
    assert len(few.labels) == 100 and abs(few.prior - 0.9) < 0.08


def test_quality_reads_words(spark):
    rng = np.random.default_rng(7)
    words = [[f"{a}{b}{c}" for a in x for b in "aeiou" for c in y] for x, y in (("bdg", "lmn"), ("ptk", "rsz"))]
    rows = [(i, " ".join(rng.choice(words[i % 2], 80)), i % 2) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    scored = quality.score(frame.drop("quality"), frame.drop("text"))
    held = scored.where(quality.held_out()).collect()
    assert len(held) > 40
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95


def test_mixing(spark, docs, empty):
    taken = mixing.mix(docs, budget=(1, 2), max_epochs=1)
    assert taken.columns == [*docs.columns, "epoch"]
    tokens = sum(len((r.text or "").split()) for r in taken.collect())
    assert 0 < tokens <= 30_200
    assert mixing.mix(empty).collect() == []


def test_mixing_keeps_columns_named_like_its_own(spark):
    """Columns with the names of the mix pass through as they are; ``epoch`` goes in any case."""
    names = ("_whole", "_domain", "_lang", "_source", "_md5", "last", "domain", "tokens", "row", "a.b")
    fields = ", ".join(f"`{n}` string" for n in (*names, "Epoch"))
    rows = [(i, f"a b c {i}", "en", "s1", *(f"{n}{i}" for n in names), "x") for i in range(9)]
    given = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {fields}")
    taken = mixing.mix(given, budget=(1, 1), max_epochs=1)
    assert taken.columns == ["doc_id", "text", "lang", "source", *names, "epoch"]
    got = sorted(tuple(r) for r in taken.collect())
    assert got == [(*r[:-1], 1) for r in rows]


def test_budgets_go_to_siblings_first(spark):
    stock = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "de", "c", 1000), ("d1", "en", "d", 5)]
    frame = spark.createDataFrame(stock, "domain string, lang string, source string, tokens long")
    weights = {"domain": {"d0": 1, "d1": 1}, "lang": {"en": 1, "de": 1}}
    found = mixing.budgets(frame, weights, (400, 2015), 1).collect()
    got = {r.source: r.budget for r in found}
    # d1 is short of 195, which d0 takes; a is short, and b takes what its sibling leaves
    assert got == {"d": 5, "a": 10, "b": 187, "c": 197}


def test_decontamination(spark, docs, empty):
    items = [
        (1, " ".join(f"w{i}" for i in range(20, 40))),
        (2, "lonely WORDS, in a row"),
        (3, None),
        (None, "漢字"),
        (4, "nowhere to be found at all"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, benchmark)
    rows = {r.doc_id: r for r in found.collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[1].n_items) == (60, 20, 1)
    assert rows[None].n_hit == 5 and rows[10].n_hit == 1 and rows[4].n_words == 0
    assert rows[7].n_words == 60_000 and not rows[7].contaminated
    kept = {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()}
    assert kept == {4, 5, 6, 7, 8, 9}
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.contamination(docs, nothing).collect())
    assert decontaminate.contamination(empty, benchmark).collect() == []


def test_decontamination_sql(spark, small):
    found = QUERIES["op6_decontamination"](spark, small)
    db = connect(small)
    assert same(spark_rows(found), duck_rows(db, ORACLE["op6_decontamination"])) == ""


def test_mixing_sql(spark, small):
    found = QUERIES["op5_mixing"](spark, small)
    assert same(spark_rows(found), duck_rows(connect(small), ORACLE["op5_mixing"])) == ""


def test_minhash(spark, docs, empty, small):
    rows = minhash.near_duplicates(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count()
    assert got[2].component_id == 1 and got[3].component_id == 1 and not got[3].kept
    assert all(got[i].n_shingles == 0 and got[i].kept for i in (4, 5, 6))
    assert got[7].n_shingles == 1 and got[None].kept
    kept = sorted(r.doc_id for r in minhash.deduplicated(docs).collect() if r.doc_id)
    assert kept == [1, 4, 5, 6, 7, 8, 9, 10]
    assert minhash.near_duplicates(empty).collect() == []

    texts = spark.read.parquet(f"{small}/documents.parquet")
    roots, sizes = jaccard_components([(r.doc_id, r.text) for r in texts.collect()])
    found = minhash.near_duplicates(texts).collect()
    assert {r.doc_id: r.component_id for r in found} == roots
    assert {r.doc_id: r.n_shingles for r in found} == sizes


def test_duplicates_go_by_row(spark):
    """Ids that rows share, rows without ids and repeated rows: one row of each group stays."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [
        (1, one, "x"),
        (2, one, "y"),
        (2, two, "z"),
        (None, three, "x"),
        (None, three, "x"),
        (None, three + " more", "y"),
        (None, two + " end", "y"),
        (4, "repeated words of a row", "x"),
        (4, "repeated words of a row", "x"),
        (None, None, "n"),
        (None, None, "n"),
        (5, "", "n"),
    ]
    given = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = [tuple(r) for r in minhash.deduplicated(given, 80).collect()]
    named = sorted((r for r in kept if r[0] is not None), key=str)
    assert named == [(1, one, "x"), (2, two, "z"), (4, "repeated words of a row", "x"), (5, "", "n")]
    unnamed = [r for r in kept if r[0] is None]
    assert len(unnamed) == 3 and unnamed.count((None, None, "n")) == 2
    assert sum((r[1] or "").startswith(three) for r in unnamed) == 1


def test_minhash_links_a_chain_of_copies(spark):
    rng = np.random.default_rng(4)
    words = [f"t{i}" for i in range(200)]
    rows = [(i, None) for i in range(0)]
    for i in range(300):
        rows.append((i, " ".join(words)))
        words[rng.integers(200)] = f"n{i}"
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    roots, _ = jaccard_components(rows)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(frame).collect()} == roots


def test_pipeline_links_from_four_fifths(spark):
    words = [f"t{i}" for i in range(104)]  # 100 shingles
    near = [*words[:50], "x", *words[51:]]  # 95 of 105 shared
    far = [*near[:70], "y", *near[71:]]  # 90 of 110, 0.818
    other = [*words[:20], "z", *words[21:50], "x", *words[51:70], "y", *words[71:]]  # 85 of 115
    rows = [(1, " ".join(words)), (2, " ".join(far)), (5, "a text of its own with no copy")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicate_stage(spark, frame, "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 5]
    assert all(r.kept for r in minhash.near_duplicates(frame).collect())
    rows = [(1, " ".join(words)), (3, " ".join(other))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(corpus_pipeline.near_duplicate_stage(spark, frame, "").collect()) == 2
    assert minhash.matches(85) == 18 and 1 <= minhash.matches(80) < 18


def test_personal_data(docs, empty):
    rows = by_id(pii.detect(docs))
    assert (rows[8].n_email, rows[8].n_ip, rows[8].n_card, rows[8].n_phone) == (1, 1, 1, 1)
    assert all(rows[i].spans == "" for i in (1, 4, 5, 6, 7, 10))
    assert pii.base_spans("a@b a@b.c-d.e@f.g") == [("email", 4, 13)]
    assert [k for k, _, _ in pii.base_spans("1.2.3.4.5.6.7.256")] == ["ip"]
    assert pii.detect(empty).collect() == []


def test_personal_data_model_finds_what_patterns_find(spark, small):
    texts = spark.read.parquet(f"{small}/documents.parquet")
    tagger = pii.train(texts.where("doc_id % 2 = 0"))
    held = [r.text or "" for r in texts.where("doc_id % 2 = 1").collect()]
    base = [set(pii.base_spans(t)) for t in held]
    found = [set(x) for x in tagger.decode(held)]
    total = sum(map(len, base))
    assert sum(len(a & b) for a, b in zip(base, found)) >= 0.6 * total  # 34 spans to learn from


def test_disguised_personal_data_is_found(spark, small):
    """Data in forms that no pattern knows, put into clean texts; clean texts stay clean."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("text is not null")
    tagger = pii.train(docs.where("doc_id % 2 = 0"))
    clean = [r.text for r in docs.where("doc_id % 2 = 1").collect()]
    clean = [x for x in clean if x and not pii.base_spans(x)]
    added = [pii.all_spans([], found, x) for x, found in zip(clean, tagger.decode(clean))]
    assert sum(map(len, added)) <= 0.01 * len(clean)
    draw, planted, gold = random.Random(3), [], []
    for i, text in enumerate(clean[:200]):
        kind = ("card", "phone")[i % 2]
        data = pii._disguised(kind, ("4111111111111111", "+1 (269) 555-3296")[i % 2], draw)
        words = text.split(" ")
        place = draw.randrange(len(words) + 1)
        before = " ".join([*words[:place], ""])
        planted.append(" ".join([*words[:place], data, *words[place:]]))
        gold.append((kind, len(before), len(before) + len(data)))
    hits = sum(
        g in pii.all_spans(pii.base_spans(x), found, x)
        for x, g, found in zip(planted, gold, tagger.decode(planted))
    )
    assert hits >= 0.5 * len(gold)


def test_personal_data_equals_the_plain_patterns(spark, small):
    """Counts and digests of a whole table against each kind's plain expression."""
    patterns = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (
            "ip",
            r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            lambda m: all(int(x) <= 255 for x in m.split(".")),
        ),
        (
            "card",
            r"[0-9]([\x20-]?[0-9])+",
            lambda m: 13 <= len(re.findall("[0-9]", m)) <= 19
            and pii.luhn("".join(re.findall("[0-9]", m))),
        ),
        (
            "phone",
            r"\+[0-9][\x20().0-9-]+[0-9]",
            lambda m: 9 <= len(re.findall("[0-9]", m)) <= 15,
        ),
    )
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pii.detect(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        found = [
            [(k, *m.span()) for m in re.finditer(p, texts[r.doc_id]) if good(m[0])]
            for k, p, good in patterns
        ]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in found]
        listed = ",".join(f"{k}:{s}:{e}" for x in found for k, s, e in x)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()


def test_secrets(docs, empty):
    rows = by_id(secret_scan.detect(docs))
    assert (rows[9].n_assign, rows[9].n_access, rows[9].n_hex) == (1, 1, 1)
    assert all(rows[i].spans == "" for i in (1, 4, 5, 6, 7, 10))
    text = "TOKEN='abcdefgh-1234' paſſword=notasciinotascii AKIAshort"
    assert secret_scan.base_spans(text) == [("assign", 0, 20)]
    assert secret_scan.detect(empty).collect() == []


def test_secrets_behind_a_suspect_are_whole():
    field = secret_scan.Field.new()
    field.weights[zlib.crc32(b"size=8") % secret_scan.FEATURES, 1] = 50.0
    for secret in ("xK9fQ2mL7vT4pR8sW1nZ6bY3cD5eG0hJ", "xKqfQbmLjvTapRbsWknZobYhcDyeGihJ"):
        for before in (
            "",
            "2024-01-17 deploy credential: ",
            "2024-01-17 authentication_header_for_gateway: ",
            "12345678 a b c ab=",
        ):
            text = f"{before}{secret} and more"
            assert ("field", len(before), len(before) + len(secret)) in field.decode(text), text


@pytest.mark.parametrize("seed", range(4))
def test_secret_decoding_is_that_of_the_plain_chain(seed):
    rng = np.random.default_rng(seed)
    weights = rng.normal(size=(secret_scan.FEATURES + 1, 3))
    weights[:, 0] += 0.2 * seed
    field = secret_scan.Field(weights, rng.normal(size=(3, 3)))
    words = ["key1=abcd1234", "wordwithoutdigits", "the", "0123456789ab", "ñandú", "a;b{c"]
    texts = [" ".join(rng.choice(words, n)) for n in (60, 1, 2, 0, 7)]
    split = [secret_scan._TOKEN.findall(x) for x in texts]
    scores, first = secret_scan._Scores(field.weights).of(split, [len(x) for x in texts])
    free = ~secret_scan.surely_outside(scores, field.moves)
    tags = secret_scan.best_tags(scores, free, field.moves)
    for text, tokens, at in zip(texts, split, first):
        if not tokens:
            continue
        ids = secret_scan.features(tokens, 0, len(tokens), secret_scan.file_features(text))
        plain = np.array([field.weights[x].sum(0) for x in ids])
        assert np.allclose(scores[at : at + len(tokens)], plain)
        out = [[0.0, -1e9, -1e9]]
        best = viterbi(np.concatenate([out, plain, out]), field.moves)[1:-1]
        assert tags[at : at + len(tokens)].tolist() == best.tolist()


def test_secrets_equal_the_plain_patterns(spark, small):
    """Counts and digests of a whole table against each kind's plain expression."""

    def plain(text):
        found = [
            ("assign", m.span(), len(m[2]) >= 12)
            for m in re.finditer(
                "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
                "|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?"
                "([A-Za-z0-9+/_.=-]+)",
                text,
            )
        ]
        found += [("access", m.span(), len(m[0]) >= 18) for m in re.finditer("AKIA[A-Z0-9]+", text)]
        found += [("hex", m.span(), len(m[0]) >= 16) for m in re.finditer("[0-9a-f]+", text)]
        order = ("assign", "access", "hex")
        spans = [(k, *at) for k, at, passes in found if passes]
        return sorted(spans, key=lambda x: (x[1], order.index(x[0])))

    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = secret_scan.detect(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        base = plain(texts[r.doc_id])
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [
            sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")
        ]
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r.spans.split(",")) | {""}


def test_secrets_of_a_withheld_pattern_are_found(spark, small):
    """A field that never saw an access key finds most of them, and nothing in clean texts."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("text is not null")
    field = secret_scan.train(docs.where("text not like '%AKIA%'"))
    decode, rng = field.decoder(), np.random.default_rng(5)
    clean = [r.text for r in docs.where(f"not text rlike '{secret_scan.HEX.pattern}'").collect()]
    clean = [x for x in clean if not secret_scan.base_spans(x)]
    spans = decode(clean)
    assert sum(map(len, spans)) <= 0.002 * len(clean)
    letters, hits = list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 0
    for text in clean[:100]:
        words, key = text.split(" "), "AKIA" + "".join(rng.choice(letters, 16))
        place = int(rng.integers(len(words) + 1))
        planted = " ".join([*words[:place], key, *words[place:]])
        at = planted.index(key)
        hits += ("field", at, at + len(key)) in field.decode(planted)
    assert hits >= 80
    shown = "the credential is xK9fQ2mL7vT4pR8sW1nZ6bY3cD5eG0hJ and that is all"
    assert field.decode(shown) == [("field", 18, 50)]


def test_secret_spans_merge_in_one_sweep():
    rng = np.random.default_rng(1)
    for _ in range(200):
        cuts = sorted(rng.choice(60, 12, replace=False).tolist())
        more = [("field", s, e) for s, e in zip(cuts[::2], cuts[1::2])]
        starts = sorted(rng.choice(60, 5).tolist())
        base = [("hex", s, s + int(rng.integers(1, 9))) for s in starts]
        kept = [x for x in more if not any(s < x[2] and e > x[1] for _, s, e in base)]
        got = secret_scan.merged(base, more)
        assert [x for x in got if x[0] == "field"] == kept and len(got) == len(base) + len(kept)


PAGE = """<html><head><title>T</title><script>var x="</p>"</script></head><body><nav><ul>
<li><a href="/a">Home</a><li><a>About</a></ul></nav><article><h1>Head &amp; more</h1>
<p>One <b>bold</b>
 text.<p>Two &lt;3 &copy;</article><div class="comments"><p>me too, this is great</div>
<footer>legal</footer>"""


def test_html(spark, small):
    found = [(b.text, html_text.is_main(b)) for b in html_text.blocks(PAGE)]
    kept = [t for t, main in found if main]
    assert kept == ["Head & more", "One bold text.", "Two <3 ©"]
    pages = spark.read.parquet(f"{small}/pages.parquet")
    labeller = html_text.train(pages)
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (3, "u", "<p>cut <b")]
    given = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract(given, labeller).collect()}
    assert "One bold text." in got[1].text and "legal" not in got[1].text
    assert got[2].text == "" and got[None].n_chars == 0
    held = pages.where("page_id % 3 = 1").collect()
    texts = {r.page_id: r.text for r in html_text.extract(pages, labeller).collect()}
    rule = {
        r.page_id: "\n".join(b.text for b in html_text.blocks(r.html) if html_text.is_main(b))
        for r in held
    }
    assert np.mean([texts[i] == t for i, t in rule.items()]) > 0.98
    assert html_text.extract(given.limit(0)).collect() == []


def test_html_reads_broken_pages_in_one_sweep():
    """Markup that never ends takes time in proportion to its length."""
    for unit in ('<a ', '<a ">"', "<!-- ", "<script ", "<b>x", "</x><i>", "<a '\"", "<", "&", "<p "):
        started = time.perf_counter()
        html_text.blocks(unit * (1_000_000 // len(unit)))
        assert time.perf_counter() - started < 20, unit
    deep = html_text.blocks("<div>x" * 20_000)
    assert len(deep) == 20_000 and max(len(b.path) for b in deep) <= html_text.DEEP


def test_html_quotes_and_cut_tags():
    def texts(page):
        return [b.text for b in html_text.blocks(page)]

    assert texts('<p title="a > b">one<p title=\'<p>\'>two') == ["one", "two"]
    assert texts("one <p>two<a href") == ["one", "two"]
    assert texts("1 < 2 <3 and <<b>x</b>") == ["1 < 2 <3 and <x"]
    assert texts('<p>one<p class="open>two<p>three') == ["one", "two", "three"]
    assert texts("a<!-- <p> -->b<!-- cut") == ["ab"]
    assert texts("a<?php x ?>b<!DOCTYPE html>c") == ["abc"]


def test_html_reads_all_names_of_an_element():
    page = '<article><p>text<div class="row col md-6 mt-4 comments"><p>me too</div></article>'
    found = [(b.text, html_text.is_main(b)) for b in html_text.blocks(page)]
    assert found == [("text", True), ("me too", False)]


def test_pipeline(spark, small):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{small}/documents.parquet")
    given = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{small}/labels.parquet")
    good = {r.doc_id for r in quality.score(docs, labels).where("predicted = 1").collect()}
    roots, _ = jaccard_components([(i, t) for i, t in given.items() if i in good])
    firsts = {i for i, r in roots.items() if i == r}
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.contamination(docs, bench).where("contaminated").collect()}
    clean = firsts - bad
    rows = corpus_pipeline.run(spark, small).collect()
    final = {r.doc_id for r in rows}
    assert final <= clean and len(rows) == len(final)
    words = {i: len(given[i].encode().split()) for i in clean}
    assert 0.6 * sum(words.values()) <= sum(words[i] for i in final) <= 0.8 * sum(words.values())
    assert {r.shard for r in rows} <= set(range(8))
