"""Token counts and packing against the tokenizer library and plain Python."""

import random
import zlib
from array import array
from collections import defaultdict

import pytest
from pyspark.sql import Row

from ballgraph.llm.catalog import tokenizer_path
from ballgraph.llm.packing import ChunkIds, best_fit_plan, pack
from ballgraph.llm.tokens import WordCounts, count_tokens, read_tokenizer, whole_tokens

ODD = [
    "", " ", "\n", "a", "The cat's hat.\nNo!", "  two  spaces   three\n\n\nlines \n mixed \t tab\r\n", "<|endoftext|> in <|endoftext|>text",
    "x<|startoftext|>y <|endoftext|>", "É è Ünï ΣΑΣ ς İ ſ 1234 ½²", "\x1cfile\x1d sep", "a  b  c　", "é ́x",
    "ab" * 3000, "'S 'T don'T I'LL", "日本語 テスト 한국어", "\x00 nul", "tail \n", "\n\nhead", "a \n b", "🙂🙃 ok",
]


def random_texts(n=300):
    rng = random.Random(5)
    parts = ["the", "Der", "été", "x", " ", " ", " ", "\n", "\t", ".", ",", "'s", "'re", "12", "ñ", " ", "<|", "|>", "##", "Thereth"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def specs():
    return {n: open(tokenizer_path(n), encoding="utf-8").read() for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def test_words_add_up(specs):
    tok = read_tokenizer(specs["word_bpe_49k.json"])
    whole = whole_tokens(tok)
    assert len(whole) > 10_000
    counts = WordCounts(tok, whole)
    for text in ODD + random_texts():
        assert counts.text(text)[0] == len(tok.encode(text, add_special_tokens=False).ids), repr(text)


def test_chunks_add_up(specs):
    tok = read_tokenizer(specs["byte_bpe_50k.json"])
    texts = ODD + random_texts()
    chunks = ChunkIds(tok)
    for _ in range(2):  # learnt, then remembered
        ids, begins = chunks.encode(texts, 2)
        assert len(begins) == len(texts) + 1 and begins[-1] == len(ids)
        for text, low, high in zip(texts, begins, begins[1:]):
            assert ids[low:high].tolist() == [*tok.encode(text, add_special_tokens=False).ids, 2], repr(text)
    assert [len(x) for x in chunks.encode([], 2)] == [0, 1]


def docs(spark, rows):
    return spark.createDataFrame(
        [Row(doc_id=i, text=t, n_tokens="clash", length="clash") for i, t in rows],
        "doc_id bigint, text string, n_tokens string, length string",
    ).repartition(3)


def test_count_rows(spark, specs):
    tok = read_tokenizer(specs["word_bpe_49k.json"])
    rows = [*enumerate(ODD), (3, None), (None, "null id"), (4, "again"), (4, "again")]
    got = count_tokens(docs(spark, rows), tokenizer_path("word_bpe_49k.json"), limit=100).collect()
    want = sorted(
        ((i if i is not None else -1), len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows
    )
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert count_tokens(docs(spark, rows).limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


def check_packing(got, rows, tok, size=1024):
    want = defaultdict(int)
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % size + 1
        cuts = [0, *range(first, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes()))] += 1
    have = defaultdict(int)
    places = defaultdict(list)
    for r in got:
        have[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return len(places)


def test_pack_rows(spark, specs):
    tok = read_tokenizer(specs["byte_bpe_50k.json"])
    rng = random.Random(1)
    rows = [*enumerate(ODD), (3, None), (None, "null id"), (4, "again"), (4, "again")]
    rows += [(100 + i, "word " * rng.randint(1, 2500)) for i in range(150)]
    got = pack(docs(spark, rows), tokenizer_path("byte_bpe_50k.json")).collect()
    n = check_packing(got, rows, tok)
    assert n <= -(-sum(r.length for r in got) // 1024) + 1  # the lower bound, and one more
    assert pack(docs(spark, rows).limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(60):
        size = rng.choice([7, 20, 64])
        counts = {rng.randint(1, size): rng.randint(1, 40) for _ in range(rng.randint(1, 12))}
        bins = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                free = [b for b in bins if b >= length]
                if free:
                    bins.remove(min(free))
                    bins.append(min(free) - length)
                else:
                    bins.append(size - length)
        plan = best_fit_plan(counts, size)
        assert max(s + m for _, _, m, s, _ in plan) == len(bins)
        assert {k: sum(m for length, _, m, _, _ in plan if length == k) for k in counts} == counts
    assert best_fit_plan({}, 8) == []
