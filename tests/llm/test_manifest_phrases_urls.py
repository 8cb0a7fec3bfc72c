"""Manifest, phrases and URL filter: against brute force, SQL, and the cases they define."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratafold.llm import collocations, merkle, url_filter
from stratafold.llm.queries import ORACLE, QUERIES
from compare import connect, duck_rows, same, spark_rows

NEW = ("op11_merkle", "op12_collocations", "op13_urls")
#: The operators' own column names, and such of their helpers.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, idx string, grp string, digest string, word string, chunk string"


@pytest.mark.parametrize("name", NEW)
def test_matches_sql(spark, small, name):
    expected = duck_rows(connect(small), ORACLE[name])
    assert expected[1]
    assert same(spark_rows(QUERIES[name](spark, small)), expected) == ""


# -- manifest -----------------------------------------------------------------------------------


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return _h(*(field(row[c]) for c in merkle.FIELDS))


def _tree(digests):
    """Root, and per leaf its steps (left, right)."""
    steps = [[] for _ in digests]
    level, members = list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        above, joined = [], []
        for at in range(0, len(level), 2):
            run = level[at : at + 2]
            for i in range(len(run)):
                for leaf in members[at + i]:
                    steps[leaf].append(("".join(run[:i]), "".join(run[i + 1 :])))
            above.append(_h(*run))
            joined.append(sum(members[at : at + 2], []))
        level, members = above, joined
    return level[0], steps


def _manifest(rows):
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row["lang"]].append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    subtrees = []
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r)))
        subtrees.append(_tree([_leaf(r) for r in by_lang[lang]]))
    root, upper = _tree([s[0] for s in subtrees]) if subtrees else (None, [])
    found = []
    for lang, (subroot, steps), above in zip(langs, subtrees, upper):
        for row, own in zip(by_lang[lang], steps):
            changed = dict(row)
            tampered = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            if tampered and row["n_chars"] is not None:
                changed["n_chars"] += 1
            proof = [*own, *above]
            folded = _leaf(changed)
            for left, right in proof:
                folded = _h(left, folded, right)
            sides = "".join(left + right for left, right in proof)
            found.append(
                (row["doc_id"], _leaf(row), subroot, root, _h(sides), folded, folded == root)
            )
    return Counter(found)


def _documents(sizes):
    """Nulls in every column, empty and long texts, repeated rows, ids that tie."""
    rows = []
    for lang, n in sizes.items():
        for i in range(n):
            rows.append((i, f"text {i} ß😀" if i % 5 else None, lang, f"s{i % 3}" if i % 4 else None, i if i % 6 else None))
    rows += rows[3:6]
    rows += [(None, "no id", "en", "s", 1), (None, "no id", "en", "s", 1), (1, "", "en", "s", 0)]
    rows += [(2, "x" * 300_000, "en", "s", 300_000), (5, "other", "de", None, 5)]
    return [(*r, "i", "g", "d", "w", "c") for r in rows]


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_manifest_equals_brute_force(spark, bits):
    docs = spark.createDataFrame(
        _documents({"en": 21, "de": 8, None: 5, "": 1, "é": 1, "z": 0}), DOCS
    )
    got = merkle.verified(docs, merkle.crc_divides(), bits).collect()
    assert Counter(map(tuple, got)) == _manifest([r.asDict() for r in docs.collect()])
    assert 0 < sum(not r.verified for r in got) < len(got)


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(7, None, None, None, None, *"igdwc")], DOCS)
    row = merkle.manifest(one).collect()[0]
    assert row.leaf == row.subroot == row.root == _h("1:7", "----") and row.proof == []
    assert merkle.verified(one.limit(0), merkle.crc_divides()).collect() == []


def test_queue_holds_a_message_per_level(monkeypatch):
    largest = [0]
    push = merkle.heapq.heappush

    def watched(queue, item):
        push(queue, item)
        largest[0] = max(largest[0], len(queue))

    monkeypatch.setattr(merkle.heapq, "heappush", watched)
    top, nodes = merkle.sweep_up([_h(str(i)) for i in range(3000)], 12)
    assert top == _tree([_h(str(i)) for i in range(3000)])[0]
    assert largest[0] <= 14 and [n[0] for n in nodes] == sorted(n[0] for n in nodes)


# -- phrases ------------------------------------------------------------------------------------


def _phrases(rows, least, top, enclosed):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            sizes[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    found = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in candidates.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    around[part] = max(around[part], a)
        scored = []
        for p, a in candidates.items():
            if 100 * around[p] >= enclosed * a:
                continue
            cuts = [(collocations.SCALE * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(found)


@pytest.mark.parametrize("size", [20, 1_000_000])
def test_phrases_equal_brute_force(spark, size):
    rng = np.random.default_rng(5)
    vocabulary = ["The", "the", "of", "ä\x00", "Ärger", "\x1c", "x y", "😀", "z", "und"]
    rows = []
    for i in range(60):
        words = rng.choice(vocabulary, 80, p=[0.2, 0.15, 0.15] + [0.5 / 7] * 7)
        text = "".join(w + rng.choice([" ", "\t ", ". ", ",", "\r\n", "  "], p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05]) for w in words)
        rows.append((["en", None, "und", ""][i % 4], text))
    rows += [("en", None), ("en", ""), ("en", " \t\n.,"), ("de", "once only"), ("long", "new york city " * 40_000)]
    rows += rows[:3]
    docs = spark.createDataFrame(
        [(i, t, lang, "s", 0, *"igdwc") for i, (lang, t) in enumerate(rows)], DOCS
    )
    for least, top, enclosed in ((10, 2000, 50), (3, 5, 90)):
        got = collocations.collocations(docs, least, top, enclosed, size).collect()
        assert sorted(map(tuple, got)) == _phrases(rows, least, top, enclosed)


def test_phrases_of_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(docs).columns == "lang rank phrase a l r n score".split()


@pytest.mark.parametrize("bits", [1, 2, 7, 21, 22, 27, 32])
@pytest.mark.parametrize("words", [2, 3])
def test_filters_lose_nothing(bits, words):
    rng = np.random.default_rng(bits)
    perm = collocations.Permutation(bits)
    grams = [rng.integers(0, 1 << bits, 4000, dtype=np.uint64) for _ in range(words)]
    hi, lo = perm.forward(grams)
    assert all((a == b).all() for a, b in zip(perm.inverse(hi, lo, words), grams))
    prefix_bits = min(4, perm.width)
    hi, lo, counts = collocations._added(hi, lo, rng.integers(1, 700, 4000))
    prefixes = hi >> np.uint64(perm.width - prefix_bits)
    for prefix in set(prefixes.tolist()):
        at = prefixes == prefix
        given = collocations.Filter(prefix_bits, hi[at], lo[at], counts[at])
        back = collocations.Filter.load(given.dump(perm, words), perm, words, prefix, prefix_bits)
        for part in ("hi", "lo", "counts"):
            assert (getattr(back, part) == getattr(given, part)).all()


def test_filters_of_a_hot_pair_spread(spark):
    """One pair before very many third words doesn't land in one range of quotients."""
    perm = collocations.Permutation(17)
    third = np.arange(1, 100_001, dtype=np.uint64)
    hi, _ = perm.forward([np.full(100_000, 3, np.uint64), np.full(100_000, 4, np.uint64), third])
    sizes = np.bincount((hi >> np.uint64(30)).astype(int), minlength=16)
    assert sizes.max() < 1.2 * sizes.mean()


# -- urls ---------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host string, path string, rule string, verdict string, resource string"


def _verdicts(spark, pages, **options):
    df = spark.createDataFrame([(*p, *"hprvr") for p in pages], PAGES)
    rows = url_filter.judge(df, **options).collect()
    assert len(rows) == len(pages)
    return {r.page_id: r for r in rows}


def _canonical(url):
    return f'<html><head><link rel="canonical" href="{url}"></head></html>'


def test_rules_by_the_letter(spark):
    urls = {
        1: ("http://Example.ORG/es/x", "example.org", "/es/x", "example.org/es/", "block"),
        2: ("http://a.example.org/en/1", "a.example.org", "/en/1", "example.org/en/1", "block"),
        3: ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        4: ("http://example.org?x", "example.org", "", None, "allow"),
        5: ("http://notexample.org#a/es/", "notexample.org", "", None, "allow"),
        6: ("ftp://x.com/de/?q", "x.com", "/de/", "com/de/", "block"),
        7: ("http://x.com/fr/1#b", "x.com", "/fr/1", "com/fr/", "allow"),
        8: ("x.com/de/", "", "", None, "allow"),
        9: (None, "", "", None, "allow"),
        10: ("://x.COM/de/://y.org/", "x.com", "/de/://y.org/", "com/de/", "block"),
        11: ("http://xcom/de/1", "xcom", "/de/1", None, "allow"),
        12: ("", "", "", None, "allow"),
        13: ("http://É.com/de/" + "x" * 200_000, "É.com", "/de/" + "x" * 200_000, "com/de/", "block"),
    }
    found = _verdicts(spark, [(i, u[0], None) for i, u in urls.items()])
    for i, (_, *expected) in urls.items():
        assert [found[i].host, found[i].path, found[i].rule, found[i].verdict] == expected, i


def test_blocks_reach_aliases_and_allow_wins(spark):
    pages = [
        (1, "https://a.net/1", _canonical("http://b.net/2")),
        (2, "http://b.net/2#top", _canonical("/3")),  # resolved: http://b.net/3
        (3, "http://b.net/3", '<meta http-equiv="Refresh" content="0; URL=\'http://x.com/de/9\'">'),
        (4, "http://c.net/", _canonical("http://x.com/de/9")),
        (5, "http://shop.com/fr/1", _canonical("http://x.com/de/9")),  # allowed by its own rule
        (6, "http://d.net/?q=1", _canonical("http://x.com/en/9")),
        (7, "http://d.net/?q=2", "<!--" + _canonical("http://x.com/de/9") + "-->"),
        (8, "http://d.net/?q=3", "<script>" + _canonical("http://x.com/de/9") + "</script>"),
        (9, None, _canonical("http://x.com/de/9")),
        (10, "http://e.net", "<base href='http://x.com/de/'><LINK HREF=9 REL='up Canonical'>"),
        (11, "http://e.net/", None),
    ]
    found = _verdicts(spark, pages)
    blocked = {i for i, r in found.items() if r.verdict == "block"}
    assert blocked == {1, 2, 3, 4, 10, 11}
    extra = spark.createDataFrame([("http://d.net?q=1", "http://c.net"), (None, "http://c.net")], "source string, target string")
    assert _verdicts(spark, pages, redirects=extra)[6].verdict == "block"
    none = url_filter.rule_table(spark).limit(0)
    assert {r.verdict for r in _verdicts(spark, pages, rules=none).values()} == {"allow"}


def test_components_equal_brute_force(spark):
    """Chains, and a URL that a third of all pages name."""
    rng = np.random.default_rng(11)
    n = 300
    urls = [f"http://h{i % 7}.{'com/de' if i % 29 == 0 else 'net/x'}/{i}" for i in range(n)]
    target = [int(rng.integers(n)) if i % 3 else 58 for i in range(n)]
    pages = [(i, urls[i], _canonical(urls[target[i]]) if i % 4 else None) for i in range(n)]
    group = list(range(n))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(n):
        if i % 4:
            group[root(i)] = root(target[i])
    tainted = {root(i) for i in range(n) if i % 29 == 0}
    found = _verdicts(spark, pages)
    assert {i for i, r in found.items() if r.verdict == "block"} == {
        i for i in range(n) if root(i) in tainted
    }


def test_rule_ties_allow_and_bad_rules_do_not_count(spark):
    rules = url_filter.rule_table(
        spark, [("allow", "a.net/x"), ("block", "a.net/x"), ("block", "net"), ("drop", "b.net/"), (None, "b.net/"), ("block", None)]
    )
    found = _verdicts(spark, [(1, "http://a.net/x", None), (2, "http://b.net/", None), (3, "http://b.org/", None)], rules=rules)
    assert [(found[i].rule, found[i].verdict) for i in (1, 2, 3)] == [
        ("a.net/x", "allow"), ("net", "block"), (None, "allow")
    ]


def test_pages_are_scanned_in_linear_time():
    start = time.perf_counter()
    for page in (b"<link " * 400_000, b'<link "' * 400_000, b"<link a" + b" " * 2_000_000 + b">", b"<!--" * 500_000, b"<script>" * 300_000):
        assert url_filter.declared("http://a/", page) == []
    assert time.perf_counter() - start < 5
    assert url_filter.declared("http://a/", _canonical("http://[x").encode()) == []


def test_empty_pages(spark):
    assert url_filter.judge(spark.createDataFrame([], PAGES)).collect() == []
