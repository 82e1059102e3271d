"""The Merkle manifest against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np

from ballgraph.llm import manifest as M

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, coord string, total int, grp string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """(root, siblings of each node with their sides, bottom up)."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(now) > 1:
        for k, i in enumerate(at):
            other = i ^ 1
            paths[k].append((i % 2, now[other] if other < len(now) else None))
            at[k] = i // 2
        now = [H(*now[i:i + 2]) for i in range(0, len(now), 2)]
    return now[0], paths


def brute(rows):
    def cells(doc, text, lang, source, n):
        each = (str(doc) if doc is not None else None, source, lang, str(n) if n is not None else None, text)
        return "".join("-" if c is None else f"{len(c.encode())}:{c}" for c in each)

    groups = defaultdict(list)
    for doc, text, lang, source, n in rows:
        forged = None
        if doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0:
            forged = H(cells(doc, text, lang, source, n + 1))
        groups[lang].append((doc is not None, doc or 0, H(cells(doc, text, lang, source, n)), forged))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {}
    for g in names:
        groups[g].sort(key=lambda r: r[:3])
        tops[g] = climb([r[2] for r in groups[g]])
    root, upper = climb([tops[g][0] for g in names])
    out = []
    for g, more in zip(names, upper):
        for k, ((known, doc, leaf, forged), path) in enumerate(zip(groups[g], tops[g][1])):
            digest = forged or leaf
            for odd, other in path + more:
                digest = H(digest) if other is None else H(other, digest) if odd else H(digest, other)
            proof = H(*(o for _, o in path + more if o is not None))
            out.append((doc if known else None, g, k, leaf, tops[g][0], root, proof, digest, digest == root))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], SCHEMA).repartition(5)
    key = lambda r: tuple(str(c) for c in r)
    got = sorted((tuple(r) for r in M.manifest(df).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    return got


def test_unique_ids(spark):
    rng = random.Random(1)
    ids = rng.sample(range(-40_000, 90_000), 2600) + [2**62, -(2**62)]
    rows = [(i, rng.choice(["", None, "a:b-", "é🙂", "word " * rng.randint(1, 30)]), "en" if k < 2300 else rng.choice(["", "de", "fr", "\U0001f600", "￮"]),
             rng.choice([None, "src0"]), rng.choice([None, 0, 7, -1, 2**63 - 1])) for k, i in enumerate(ids)]
    rows.append((5_000_000, "x" * 3_000_000, "long", "s", 3_000_000))
    got = check(spark, rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_repeated_and_null_ids(spark):
    rng = random.Random(2)
    rows = [(i, f"t{i}", None if i % 3 else "en", "s", i) for i in range(700)]
    rows += [(13, "same", "en", "s", 1)] * 900 + [(13, f"other {k}", "en", "s", None) for k in range(600)]
    rows += [(13, "same", None, "s", 1)] * 2 + [(None, rng.choice(["a", "b", None]), rng.choice([None, "en"]), None, 3) for _ in range(50)]
    rows += [(None, None, None, None, None)] * 2 + [(77, "alone", "de", None, 5)] * 2
    check(spark, rows)


def test_one_row_and_none(spark):
    check(spark, [(1, "t", "en", "s", 1)])
    check(spark, [(1, "t", "en", "s", 1), (2, "t", None, "s", 1)])
    empty = M.manifest(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and "proof_sha256" in empty.columns


def test_bitmaps():
    rng = np.random.default_rng(0)
    for n in (1, 3, M.SPARSE - 1, M.SPARSE, 1 << M.BUCKET_BITS):
        at = np.sort(rng.choice(1 << M.BUCKET_BITS, n, replace=False))
        counts = np.where(rng.random(n) < 0.1, rng.integers(2, 9, n), 1)
        body, repeats = M.pack_bitmap(at, counts)
        assert len(body) <= 1 + (1 << M.BUCKET_BITS) // 8
        bits, rows = M.unpack_bitmap(body, repeats)
        assert np.flatnonzero(bits).tolist() == at.tolist() and rows[at].tolist() == counts.tolist()
        assert rows.sum() == counts.sum()
