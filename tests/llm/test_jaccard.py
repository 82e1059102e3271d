"""The Jaccard join against brute force, through every physical path."""

import random

import pytest
from pyspark.sql import Row

from ballgraph.llm import jaccard
from ballgraph.llm.common import components
from ballgraph.llm.jaccard import jaccard_join, keep_one
from ballgraph.session import Scratch


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label, links = list(range(len(rows))), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    out = []
    for n, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if label[m] == label[n] and rows[m][0] is not None]
        out.append((i, len(sets[n]), min(ids) if links[n] and ids else i, links[n]))
    return sorted(out, key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows, number = [], 0
    for n in (3, 5, 6, 12, 40, 120, 300, 2500):
        for _ in range(4):
            words = [rng.choice(vocabulary) for _ in range(n)]
            for _ in range(rng.randint(1, 6)):
                copy = list(words)
                for _ in range(rng.randint(0, max(1, n // 40))):
                    copy[rng.randrange(n)] = rng.choice(vocabulary)
                text = ("\n" if rng.random() < 0.3 else " ").join(copy)
                rows.append((number, text.upper() if rng.random() < 0.2 else text))
                number += 1
                if rng.random() < 0.2:
                    rows.append((number, passage + " " + text))
                    number += 1
    rows += [(number, None), (number + 1, ""), (number + 2, " \n\t"), (None, rows[0][1]), (5, rows[7][1]), (5, rows[7][1])]
    rows += [(number + 3, "Éa é é"), (number + 4, "éa é é"), (number + 5, "x"), (number + 6, "X")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [Row(doc_id=i, text=t, row="clash", n_links="clash") for i, t in rows],
        "doc_id bigint, text string, row string, n_links string",
    ).repartition(3)


@pytest.mark.parametrize("tile", [(1024, 600_000), (3, 500)])
def test_links_and_components(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE_SETS", tile[0])
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", tile[1])
    rows = corpus()
    got = sorted((tuple(r) for r in jaccard_join(frame(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


def test_shuffled_sides_and_empty(spark):
    rows = corpus(9)[:60]
    numbered = frame(spark, rows).selectExpr("monotonically_increasing_id() as row", "doc_id as id", "text")
    got = jaccard.join_rows(numbered, broadcast_rows=0).selectExpr("id", "n_shingles", "component_id", "n_links")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
    assert jaccard_join(frame(spark, rows).limit(0)).count() == 0


def test_keep_one(spark):
    rows = corpus(4)
    want = brute(rows)
    docs = Scratch(spark, "test").save(frame(spark, rows), "docs")
    kept = keep_one(docs).collect()
    assert set(kept[0].asDict()) == set(docs.columns)
    groups = {c for _, _, c, links in want if links}
    single = sum(1 for *_, links in want if not links)
    assert len(kept) == len(groups) + single
    assert groups <= {r.doc_id for r in kept}


def test_keep_one_after_a_split_between_reads(spark, monkeypatch):
    """The scan's split changes while the documents are worked on, as it does when executors join or leave."""
    rows = corpus(6)
    scratch = Scratch(spark, "test")
    docs = scratch.save(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9), "docs")
    want = sorted(str(r.text) for r in keep_one(docs).collect())
    join, key = jaccard.join_rows, "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")

    def split(numbered):
        out = scratch.save(join(numbered), f"joined-{len(calls)}")
        spark.conf.set(key, "4000" if not calls else "100000000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        calls.append(1)
        return out

    calls = []
    monkeypatch.setattr(jaccard, "join_rows", split)
    try:
        kept = [sorted(str(r.text) for r in keep_one(spark.read.parquet(scratch.path("docs"))).collect()) for _ in range(2)]
    finally:
        spark.conf.set(key, before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(calls) == 2 and all(len(k) == len(want) for k in kept)
    answer = brute(rows)  # one row of each group, whatever the split
    assert len(want) == len({c for _, _, c, links in answer if links}) + sum(1 for *_, links in answer if not links)


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, 7)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)]
    edges += [(1000, 1000 + k) for k in range(1, 50)]
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    want = {x: r for x, r in label.items() if any(x in e and e[0] != e[1] for e in edges)}
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in components(spark, df, Scratch(spark, "test"), "c").collect()}
    assert got == want
    assert components(spark, df.limit(0), Scratch(spark, "test"), "c").count() == 0
