"""Quality rules, line removal, urls and decontamination on small hand-made tables."""

import random

import numpy as np
import pytest
from pyspark.sql import Row

from ballgraph.llm import decontaminate as dc
from ballgraph.llm import divergence, url_filter
from ballgraph.llm.catalog import LISTED_LABELS, URL_RULES
from ballgraph.llm.site_lines import drop_boilerplate
from ballgraph.session import Scratch


def repeated(words):
    seen = {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k:k + 3]), []).append(k)
    return len({k + d for ks in seen.values() if len(ks) > 1 for k in ks for d in range(3)})


def test_quality_counts(spark):
    rng = random.Random(1)
    texts = [None, "", " \n ", "a", "a b", "a b c", "a b c a b c", "x " * 500, "# * $ % & | < >\n# *\n# *\n\n\n", "\ufeffé\u00a0ü\x0bz\x0c1\r2"]
    for n in (10, 200, 3000):
        texts += [" ".join(rng.choice("abcdefgh") for _ in range(n)), "\n".join(str(rng.randint(0, n)) for _ in range(n))]
    rows = [Row(doc_id=n, text=t, lang=None if n % 3 == 0 else "en", kept="clash") for n, t in enumerate(texts)]
    rows += [rows[4], Row(doc_id=None, text="b", lang="en", kept="clash")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kept string")
    got = {r.doc_id: r for r in divergence.quality(docs).collect()}
    for n, t in enumerate(texts):
        words = (t or "").encode().split()
        words = [w.decode() for w in words]
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = got[n]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words)), repr(t)
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeated(words), (n, r)
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words))
        assert not (r.base_failed and r.kept)
    assert divergence.quality(docs).count() == len(rows)
    kept = divergence.drop_rejected(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in divergence.quality(docs).collect())
    assert divergence.quality(docs.limit(0)).count() == 0 and divergence.drop_rejected(docs.limit(0)).count() == 0


def test_quality_verdict(spark):
    rng = random.Random(2)
    common = "the of and to in a is that it for on was".split()
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("etaoinshr") for _ in range(6))
    good = [" ".join(word() for _ in range(300)) for _ in range(40)]
    symbols = " ".join(word() + "$%&" for _ in range(300))
    listed = " ".join("".join(rng.choice("etaoinshr") for _ in range(6)) for _ in range(300))
    docs = spark.createDataFrame([(n, t, "en") for n, t in enumerate([*good, symbols, listed])], "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in divergence.quality(docs).where("kept").collect()} == set(range(40))


def test_short_texts_are_judged_by_length(spark):
    rng = random.Random(7)
    common = "the of and to in a is that it for on was".split()
    odd = lambda: "".join(rng.choice("etaoinshr") for _ in range(6))
    usual = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else odd() for _ in range(n))
    texts = [usual(300) for _ in range(40)] + [usual(n) for n in (60, 80, 100, 120, 140)]
    texts += [" ".join(odd() for _ in range(n)) for n in (110, 130, 149, 151, 300)]
    docs = spark.createDataFrame([(n, t, "en") for n, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in divergence.quality(docs).where("kept").collect()} == set(range(45))
    assert {r.doc_id for r in divergence.drop_rejected(docs).collect()} == set(range(45))


@pytest.mark.parametrize("limit", [200_000, 0])
def test_distinct_pages(spark, limit):
    rows = [(n, "big", "copied\nown text") for n in range(40)] + [(100 + n, "big", f"own {n}\nfoot") for n in range(6)]
    rows += [(200 + n, "big", f"own {n} too") for n in range(30)] + [(300, "big", None), (301, "big", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    out = drop_boilerplate(docs, ratio=0.15, min_pages=5, broadcast_rows=limit)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {n: None if t is None else t.removesuffix("\nfoot") for n, _, t in rows}
    assert drop_boilerplate(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [200_000, 0])
def test_lines(spark, limit):
    rows = [(n, "big", f"top line\nown {n}\n\n  \nown {n}\nfoot {n % 2}") for n in range(20)]
    rows += [(100 + n, "small", f"top line\nown {n}") for n in range(4)]
    rows += [(200 + n, None, "top line\nx\ntop line") for n in range(6)] + [(300, "big", None), (301, "big", ""), (None, "big", "top line")]
    docs = spark.createDataFrame(
        [Row(doc_id=i, source=s, text=t, n_lines="clash") for i, s, t in rows], "doc_id bigint, source string, text string, n_lines string"
    )
    out = drop_boilerplate(docs, ratio=0.5, min_pages=5, broadcast_rows=limit, distinct=False)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    want = {n: f"own {n}\n\n  \nown {n}\nfoot {n % 2}" for n in range(20)}  # a foot is on less than half
    want |= {100 + n: f"top line\nown {n}" for n in range(4)}  # on too few pages
    want |= {200 + n: "" for n in range(6)} | {300: None, 301: "", None: ""}
    assert got == want
    counted = {r.doc_id: (r.n_lines, r.n_dropped) for r in drop_boilerplate(docs, ratio=0.5, counts=True, broadcast_rows=limit, distinct=False).collect()}
    once = {r.doc_id: r.text for r in drop_boilerplate(docs, ratio=0.5, broadcast_rows=limit).collect()}
    assert once == want | {200 + n: "top line\nx\ntop line" for n in range(6)}  # six copies are one page
    assert counted[0] == (6, 1) and counted[203] == (3, 3) and counted[300] == (0, 0) and counted[301] == (1, 0)
    assert drop_boilerplate(docs.limit(0), broadcast_rows=limit).count() == 0


URLS = [
    (None, ("", "", None, "allow")), ("", ("", "", None, "allow")), ("no scheme.com/en/", ("", "", None, "allow")),
    ("http://EXAMPLE.com/en/1?q", ("example.com", "/en/1", "example.com/en/", "block")),
    ("http://www.example.com/en/1", ("www.example.com", "/en/1", "www.example.com/en/", "allow")),
    ("http://a.www.example.com/en/", ("a.www.example.com", "/en/", "www.example.com/en/", "allow")),
    ("http://notexample.com/en/", ("notexample.com", "/en/", "com/", "allow")),
    ("http://x.com", ("x.com", "", None, "allow")), ("http://x.com?a/b", ("x.com", "", None, "allow")),
    ("http://y.net/es/#x", ("y.net", "/es/", "net/es/", "block")), ("http://y.net/EN/", ("y.net", "/EN/", None, "allow")),
    ("http://spam-farm.example.org/", ("spam-farm.example.org", "/", None, "block")),
    ("http://www.Spam-Farm.example.org#a://b", ("www.spam-farm.example.org", "", None, "block")),
    ("http://spam-farm.com/", ("spam-farm.com", "/", "com/", "allow")), ("x://", ("", "", None, "allow")),
    ("http://É.org/ü?", ("É.org", "/ü", None, "allow")),
]


@pytest.mark.parametrize("limit", [1000, 0])
def test_urls(spark, limit):
    pages = spark.createDataFrame([Row(page_id=n, url=u, host="clash") for n, (u, _) in enumerate(URLS)], "page_id bigint, url string, host string")
    got = url_filter.judge_urls(pages, URL_RULES, listed_labels=LISTED_LABELS, broadcast_keys=limit)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {n: w for n, (_, w) in enumerate(URLS)}
    assert url_filter.judge_urls(pages.limit(0), URL_RULES, listed_labels=LISTED_LABELS, broadcast_keys=limit).count() == 0


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 6)  # many false positives, many levels
    universe = spark.range(4000).selectExpr("concat('k', id) as key")
    listed = universe.where("cast(substr(key, 2) as int) % 5 = 0")
    cascade = url_filter.build_cascade(listed, universe, Scratch(spark, "test"))
    assert len(cascade.levels) > 2
    rows = universe.select("key", *url_filter._hashes(universe["key"])).collect()
    found = cascade.listed(np.array([r.a for r in rows]), np.array([r.b for r in rows]))
    assert [int(r.key[1:]) % 5 == 0 for r in rows] == found.tolist()


def test_wand_retrieves_all_above_threshold():
    rng = random.Random(3)
    vocabulary = [f"w{n}".encode() for n in range(120)]
    items = [(n, " ".join(rng.choice(vocabulary).decode() for _ in range(rng.randint(4, 25))) + ". yes") for n in range(60)]
    words = [dc.words_of(t.encode()) for _, t in items]
    df = {w: sum(w in x for x in words) for x in words for w in x}
    index = dc.Index(items, len(items), sum(map(len, words)) / len(words), df)
    impact = {}
    for t, n in index.terms.items():
        for docs, values, _ in index.blocks[n].values():
            impact |= {(t, d): x for d, x in zip(docs, values)}
    for trial in range(40):
        query = set(rng.sample(vocabulary, 60)) | set(words[trial])
        terms = sorted(index.terms[w] for w in query if w in index.terms)
        want = {d for d in range(60) if sum(impact.get((w, d), 0) for w in query) >= dc.THRESHOLD}
        p, b = index.bounded(np.zeros(len(terms), np.int64), np.array(terms), 1)
        assert {d for block in b.tolist() for d, _ in index.retrieve(terms, block)} == want
        assert {d // dc.BLOCK for d in want} <= set(b.tolist())


def test_leaks(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [(n, " ".join(word() for _ in range(rng.randint(16, 60))) + ". " + " ".join(word() for _ in range(6)) + ".") for n in range(30)]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "...")], "item_id bigint, text string")
    docs, want = [], set()
    for n in range(200):
        parts = [word() for _ in range(rng.randint(0, 300))]
        if n % 4 == 0:
            item = rng.randrange(30)
            at = rng.randint(0, len(parts))
            text = items[item][1].upper() if n % 8 else items[item][1].replace(" ", "\n")
            parts = parts[:at] + [text] + parts[at:]
            want.add((n, item))
        if n % 4 == 1:  # a question without its answer, and half a question
            item = items[rng.randrange(30)][1].split(". ")
            parts += item[0].split()[:8] if n % 8 == 1 else item[1].split()
        docs.append(Row(doc_id=n, text=" ".join(parts), score="clash"))
    docs += [Row(doc_id=900, text=None, score=""), Row(doc_id=None, text=items[3][1], score="")]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, score string").repartition(3)
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()}
    assert got == want | {(None, 3)}
    clean = dc.drop_leaks(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {*range(200), 900} - {n for n, _ in want}
    split = dc.build_indexes(bench, index_bytes=2000)
    assert len(split) > 2 and sorted(i for x in split for i in x.ids) == list(range(30))
    assert dc.find_leaks(docs, bench.limit(0)).count() == 0 and dc.find_leaks(docs.limit(0), bench).count() == 0
    assert dc.drop_leaks(docs, bench.limit(0)).count() == docs.count()
