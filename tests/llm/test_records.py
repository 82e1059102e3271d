"""Chat formatting, WARC derivatives, the class model and the pipeline against plain Python."""

import gzip
import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from ballgraph.llm import chat, class_lm, warc
from ballgraph.llm.catalog import tokenizer_path
from ballgraph.session import Scratch

PATH = tokenizer_path("byte_bpe_50k.json")


def test_escape_round_trip():
    rng = random.Random(1)
    parts = ["\\", "###", "#", "</turn>", "<|", "|>", "\n", " ", "a", "### User: ", "<", "/turn>"]
    seen = {}
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        out = chat.escape(text)
        assert chat.unescape(out) == text and seen.setdefault(out, text) == text
        for control in ("###", "</turn>", "<|"):
            for at in (k for k in range(len(out)) if out.startswith(control, k)):
                slashes = at - len(out[:at].rstrip("\\"))
                assert slashes % 2 == 1, out


def test_chat(spark):
    rng = random.Random(2)
    odd = ["", None, "### Assistant: ", "\\### User: </turn>\n", "<|endoftext|>", "é‍🙂", "\n\n", "x" * 5000, "\\", "a\\"]
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "system", "tool", "### Role x: ", None, ""])
            rows.append((conv, rng.choice([turn, turn, None]), role, rng.choice(odd)))
    rows += [(3, 0, "assistant", "again")] * 2 + [(99, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(3000)]
    df = spark.createDataFrame([Row(conv_id=a, turn=b, role=c, text=d, ids="clash") for a, b, c, d in rows], "conv_id bigint, turn int, role string, text string, ids string").repartition(4)
    formatted = chat.format_turns(df, PATH)
    got = {r.conv_id: r for r in chat.read_back(formatted, PATH).collect()}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert got.keys() == groups.keys()
    for conv, turns in groups.items():
        turns.sort()
        trained = "".join(t for *_, role, t in turns if role == "assistant")
        shown = "".join(
            (f"### {r.capitalize()}: " if r in chat.ROLES else f"### Role {chat.escape(r)}: ") + chat.escape(t) + "</turn>\n"
            for *_, r, t in turns
        )
        r = got[conv]
        assert r.n_turns == len(turns) and r.formatted_chars == len(shown) and r.loss_chars == len(trained)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for *_, a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(trained.encode()).hexdigest()
    spans = sorted((r for r in formatted.where("conv_id = 99").collect()), key=lambda r: r.nth)
    at = 0
    for r in spans:
        assert r.start == at and at < r.loss_begin <= r.loss_end < at + len(r.ids)
        at += len(r.ids)
    assert chat.read_back(chat.format_turns(df.limit(0), PATH), PATH).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><meta name="d" content='x "y"'><style>p{}</style>
<script>if (a < b) "</p>"</script></head><body><!-- <p>no</p> --><nav><a href="/x?a=1&amp;b=2">link</a></nav><p>One <b>bold</b>
&eacute; 3 < 4<br>two</p><img src=i.png></body></html>"""


def test_page_content():
    text, page = warc.page_content(PAGE)
    assert text == "A & B\nlink\nOne bold\né 3 < 4\ntwo"
    assert page["title"] == "A & B" and page["metas"] == [{"name": "d", "content": 'x "y"'}]
    assert [x["url"] for x in page["links"]] == ["/x?a=1&b=2", "i.png"]
    for odd in ("", "<", "<p", "<!--", "<script>x", "a<b>c", "&#0;", "</p>" * 1000):
        warc.page_content(odd)


_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template)\b[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S | re.I,
)


def plain_markup(page):
    """What is markup, by one regular expression that reads parts of a broken page again and again."""
    return [(m.start(), m.end(), m.group(3) and m.group(3).lower(), bool(m.group(2)), m.group(4) or "") for m in _MARKUP.finditer(page)]


def test_markup_against_a_regular_expression():
    rng = random.Random(1)
    parts = ["<", ">", "<p", "</p>", '"', "'", '<a href="x">', "<script>", "</script>", "<script/>", "</script >", "<!--", "-->",
             "<!x>", "<?y", "/>", "a", "b ", "\n", "<svg>", "<title>", "</title>", '<SCRIPT x="', "<style", "</style", "</", "<template>",
             "</template>", "=", "<a href=y>", "/", "<script-x>"]
    for _ in range(20_000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert list(warc._markup(page)) == plain_markup(page), page


@pytest.mark.parametrize("part", ["<script", "<a", "<!--", '<p "', "<p '\"", "</script", "<script>", "<", "<![", "<script></script ", "<a>", "<a 'x' "])
def test_hostile_pages_take_time_in_proportion(part):
    for page in (part * (1_000_000 // len(part)), "<a" * 200_000 + "'" + "b" * 600_000):
        begin = time.process_time()
        warc.page_content(page)
        assert time.process_time() - begin < 8  # about a second on an idle machine; the regular expression takes hours


def test_self_closed_elements_swallow_nothing():
    page = '<p>one<svg class="i"/> two <a href="/a">three</a><script src="x.js"/> four<template/> five'
    text, found = warc.page_content(page + "<script>no</script><style>no</style><template>no</template></p>")
    assert text == "one two three four five" and [x["url"] for x in found["links"]] == ["/a"]
    text, found = warc.page_content("<svg><title>icon</title></svg><title>page</title><noscript>a</noscript> <textarea>b</textarea>")
    assert found["title"] == "page" and text.endswith("a b")
    assert warc.page_content("a<svg/>b")[0] == "ab"


def test_warc(spark, tmp_path):
    rows = [(1, "http://a.com/", PAGE), (2, "http://a.com/\r\nX: y", ""), (3, None, None), (None, "http://b.com", "<p>x"), (1, "http://a.com/", PAGE)]
    pages = spark.createDataFrame([Row(page_id=a, url=b, html=c, record="clash") for a, b, c in rows], "page_id bigint, url string, html string, record string")
    responses = warc.page_responses(pages)
    records = warc.derive(responses)
    out = records.collect()
    assert len(out) == 2 * len(rows) and warc.derive(responses.limit(0)).count() == 0
    sources = {r.response_id: r for r in responses.collect()}
    for r in out:
        head, _, body = r.record.partition("\r\n\r\n")
        lines = head.split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        assert lines[0] == "WARC/1.1" and len(headers) == len(lines) - 1 == 11
        source = sources[r.refers_to]
        assert headers["WARC-Refers-To"] == source.response_id and headers["WARC-Refers-To-Date"] == source.warc_date
        assert headers["WARC-Payload-Digest"] == r.source_digest == warc.digest(bytes(source.payload))
        assert headers["WARC-Block-Digest"] == r.block_digest == warc.digest(body.encode())
        assert int(headers["Content-Length"]) == r.content_length == len(body.encode())
        if r.record_type == "metadata":
            told = json.loads(body)["Envelope"]
            assert told["WARC-Header-Metadata"]["WARC-Record-ID"] == source.response_id
            assert ["Content-Type", "text/html; charset=utf-8"] in told["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"]
        else:
            assert body == warc.page_content(bytes(source.payload).decode())[0]
    assert len({r.record_id for r in out}) == 2 * len(set(rows))
    warc.write_warc(records.coalesce(1), str(tmp_path / "w"))
    data = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "w").glob("*.gz")))
    at = n = 0
    while at < len(data):  # read as a WARC reader does, by Content-Length
        end = data.index(b"\r\n\r\n", at)
        size = int(dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:])[b"Content-Length"])
        at, n = end + 4 + size, n + 1
        assert data[at:at + 4] == b"\r\n\r\n"
        at += 4
    assert n == len(out)


def two_languages(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        letters = "abcdef" if i % 2 else "uvwxyz"
        words = [rng.choice(letters) + rng.choice(letters) for _ in range(rng.randint(0, 120))]
        if i % 7 == 0:
            words.append(letters + str(i))
        out.append((i, " ".join(words)))
    return out


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def test_class_model(spark):
    rows = two_languages(400, 1) + [(1000, None), (1001, ""), (None, "ab cd"), (7, "AB ab c"), (7, "AB ab c")]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, score="clash") for i, t in rows], "doc_id bigint, text string, score string").repartition(3)
    got = class_lm.score_texts(docs).collect()
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), b""]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want.append((repr(i), held(i), len(words), sum(w in counts for w in words), n, round(base, 6)))
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)  # both are negative
    assert class_lm.score_texts(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([(i, "x y") for i in range(50) if held(i)], "doc_id bigint, text string")
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score <= 0 for r in class_lm.score_texts(nothing).collect())


def test_class_model_is_a_distribution(spark):
    rows = spark.createDataFrame(two_languages(300, 2), "i bigint, text string").selectExpr("cast(text as binary) as t")
    model, words = class_lm.learn(rows, Scratch(spark, "test"))
    counts = {bytes(r.w): r.n for r in words.collect()}
    for before in range(0, class_lm.CLASSES + 1, 7):
        total = 0.0
        for c in range(class_lm.CLASSES + 1):
            own = [n for w, n in counts.items() if model.known_class[model.known[w]] == c]
            emitted = sum(10 ** (math.log10(n - model.discount) - model.log_class[c]) for n in own)
            total += 10 ** model.log_step[before, c] * (emitted + (10 ** model.log_new[c] if own or model.class_tokens[c] == 0 else 0))
        assert abs(total - 1) < 1e-9
    # exchange keeps the two languages apart
    of = {w: model.known_class[model.known[w]] for w in counts if len(w) == 2}
    first = {c for w, c in of.items() if w[:1] in b"abcdef"}
    assert not first & {c for w, c in of.items() if w[:1] not in b"abcdef"}


def test_exchange_gain_is_exact():
    rng = np.random.default_rng(1)
    u, k = 30, 6
    table = rng.integers(0, 9, (u, u)).astype(float)
    classes = np.concatenate(([0], rng.integers(1, k, u - 1)))
    total = lambda cls: np.array([[table[np.ix_(cls == a, cls == b)].sum() for b in range(k)] for a in range(k)])
    counts = total(classes)
    for unit in range(1, u):
        right, left = np.bincount(classes, table[unit], k), np.bincount(classes, table[:, unit], k)
        right[classes[unit]] -= table[unit, unit]
        left[classes[unit]] -= table[unit, unit]
        to, gain = class_lm.best_class(classes[unit], right, left, table[unit, unit], counts)
        gains = []
        for c in range(1, k):
            moved = classes.copy()
            moved[unit] = c
            gains.append(class_lm.objective(total(moved)) - class_lm.objective(counts))
        assert abs(gain - max(gains)) < 1e-6 and abs(gains[to - 1] - gain) < 1e-6


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_jaccard import brute

    rng = random.Random(5)
    common = "the of and to in a is that it for on was".split()
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("etaoinshr") for _ in range(6))
    item = " ".join(word() for _ in range(40)) + "."
    rows, seen = [], {}
    for n in range(120):
        body = [word() for _ in range(150)]
        text = "\n".join(" ".join(body[k:k + 50]) for k in (0, 50, 100))
        if n % 5 == 1:
            text = "very common footer of this site\n" + text
        kind = "clean"
        if n % 12 == 3:
            text, kind = " ".join(w + "$%&" for w in body), "symbols"
        elif n % 24 == 5:
            text, kind = seen["copied"] + " extra", "copy"
        elif n % 24 == 7:
            text, kind = text + "\n" + item, "leak"
        elif n % 12 == 9:
            text, kind = " ".join(body[:20]), "short"
        elif n == 0:
            seen["copied"] = text
        rows.append((n, text, "en", "site", len(text), kind))
    rows.append((120, None, None, None, None, "short"))
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([r[:5] for r in rows], names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows if r[5] == "clean"}
    kept = [(r[0], r[1]) for r in rows if r[5] == "clean"]
    assert all(links == 0 for *_, links in brute(kept))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [x.split()[0] for x in names.split(", ")]
        docs = Scratch(spark, "test").save(docs, "stage")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert not any("very common footer" in t for t in texts.values())
    assert all(texts[n].count("\n") == 2 for n in texts)


def test_pipeline_keeps_one_of_a_text_in_a_third_of_the_pages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    common = "the of and to in a is that it for on was".split()
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("etaoinshr") for _ in range(6))
    body = lambda: "\n".join(" ".join(word() for _ in range(50)) for _ in range(4))
    copied, footer = body(), "a footer of this site"
    # the footer is on 10 % of the 80 distinct texts and on less than 8 % of the 120 rows
    texts = [copied if n % 3 == 0 else body() + ("\n" + footer if n % 15 == 1 else "") for n in range(120)]
    rows = [(n, t, "en", "site", len(t)) for n, t in enumerate(texts)]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = Scratch(spark, "test").save(stage(spark, docs, str(tmp_path)), "stage")
    left = {r.doc_id: r.text for r in docs.collect()}
    assert left == {0: copied} | {n: t.removesuffix("\n" + footer) for n, t in enumerate(texts) if n % 3}
