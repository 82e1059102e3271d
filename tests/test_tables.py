import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballgraph.operators import counts as C
from ballgraph.operators import labels as L
from ballgraph.operators import scaling as S
from ballgraph.operators import scores as R
from ballgraph.operators import text as X
from ballgraph.session import Scratch, checkpoint_root
from ballgraph.sources import points as P
from ballgraph.sources import stores
from tests.helpers import column, layout_df, points_df


def test_dense_codes_follow_the_key_order(spark):
    keys = spark.createDataFrame([(k,) for k in "zebra quick ant bee cow dog".split()], "k string").repartition(4)
    codes = P.dense_codes(keys, "k", "code", Scratch(spark, "test")).collect()
    assert [r.k for r in sorted(codes, key=lambda r: r.code)] == sorted(r.k for r in codes)
    assert sorted(r.code for r in codes) == list(range(6))


def test_scratch_lives_in_the_named_folder(spark):
    root = checkpoint_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    scratch = Scratch(spark, "test")
    assert scratch.root.startswith(root)
    assert scratch.save(spark.range(5), "five").count() == 5
    scratch.drop("five")


def test_neighbours_that_are_not_points_are_named(spark):
    points = points_df(spark, np.zeros((3, 1)))
    knn = spark.createDataFrame([(0, 1), (1, 7), (2, -1)], "i bigint, j bigint")
    with pytest.raises(ValueError, match=r"\(1, 7\)|\(2, -1\)"):
        P.validate_knn(knn, points)
    P.validate_knn(knn.where("j = 1"), points)


def test_standardize_without_spread(spark):
    v = column(S.standardize(points_df(spark, [[1.0, 5.0], [3.0, 5.0]])), "v")
    assert v.tolist() == [[-1.0, 0.0], [1.0, 0.0]]


def test_zero_rows_stay_zero(spark):
    v = column(S.l2_normalize(points_df(spark, [[0.0, 0.0], [3.0, 4.0]])), "v")
    assert v.tolist() == [[0.0, 0.0], [0.6, 0.8]]


def test_missing_categories(spark):
    df = spark.createDataFrame([(0, "b", 1.0), (1, None, 2.0), (2, "a", 3.0)], "id bigint, c string, x double")
    wide, names = L.one_hot(df, ["c"], ["x"])
    assert names == ["x", "c_a", "c_b"]
    assert sorted(map(tuple, wide.collect())) == [(0, 1.0, 0.0, 1.0), (1, 2.0, 0.0, 0.0), (2, 3.0, 1.0, 0.0)]
    coded = {r.id: r.code for r in L.label_index(df, "c", missing=-1).collect()}
    assert coded == {0: 1, 1: -1, 2: 0}
    assert {r.id: r.code for r in L.label_index(df, "c").collect()}[1] is None
    with pytest.raises(ValueError, match="levels"):
        L.one_hot(df, ["c"], [], max_levels=1)


def test_path_labels(spark):
    names = ["obj7__10.png", "OBJ 12_0.pgm", "readme.txt"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r[0] for r in df.select(L.path_label(F.col("p"))).collect()] == [6, 11, None]


def test_display_names(spark):
    df = spark.createDataFrame([("ball", "Wass_H0"), ("my_way", "mean_rank")], "m string, r string")
    out = df.select(L.display_name(F.col("m"), {"ball": "Ball graph"}, False), L.display_name(F.col("r"), L.METRIC_NAMES, True))
    assert [tuple(r) for r in out.collect()] == [("Ball graph", "Wasserstein $H_0$"), ("my_way", "mean rank")]


def test_dispatch_on_the_column_type(spark):
    text = spark.createDataFrame([(0, "red fox red"), (1, "red hen"), (2, None)], "id bigint, text string")
    rows = X.vectorize(text, "text", min_df=1)
    assert {r.term for r in rows.collect()} == {"red", "fox", "hen"}
    numbers = spark.createDataFrame([(0, [0.0, 2.0])], "id bigint, x array<double>")
    assert [tuple(r) for r in X.vectorize(numbers, "x").collect()] == [(0, "1", 2.0)]
    with pytest.raises(TypeError):
        X.vectorize(spark.createDataFrame([(0, True)], "id bigint, x boolean"), "x")


def test_one_feature_bins_have_score_one(spark):
    rows = [(i, f, float(v)) for f, vs in {"a": [1, 2, 3], "b": [100, 300, 500]}.items() for i, v in enumerate(vs)]
    logged = C.log1p(spark.createDataFrame(rows, "id bigint, feature string, value double"))
    assert {r.feature: r.norm for r in C.dispersions(logged, 3).collect()} == {"a": 1.0, "b": 1.0}
    assert C.highly_variable(logged, 3, 1).count() == 1


SCORES = [
    ("mnist", "first", "trustworthiness", 5, 0, 0.9), ("mnist", "first", "trustworthiness", 5, 1, 0.7),
    ("mnist", "first", "trustworthiness", 5, 2, float("nan")), ("mnist", "second", "trustworthiness", 5, 0, 0.8),
    ("mnist", "first", "other", 99, 0, 1.0),
]


def test_missing_scores(spark):
    scores = spark.createDataFrame(SCORES, R.SCORE_SCHEMA)
    cube = R.result_cube(scores, ["first", "second"], ["trustworthiness"], [5], [0, 1, 2])
    got = {(r.method, r.seed): r.value for r in cube.collect()}
    assert got == {("first", 0): 0.9, ("first", 1): 0.7, ("first", 2): None,
                   ("second", 0): 0.8, ("second", 1): None, ("second", 2): None}
    stats = {r.method: r for r in R.seed_stats(cube).collect()}
    assert stats["first"].mean == pytest.approx(0.8) and stats["first"]["std"] == pytest.approx(math.sqrt(0.02))
    assert stats["second"]["std"] is None and stats["second"].n_seeds == 1


def test_reports_and_stores(spark, tmp_path):
    folder = tmp_path / "reports"
    folder.mkdir()
    (folder / "mnist__5__0.json").write_text('{"first": {"trustworthiness": 0.9, "Wass_H0": NaN}}')
    (folder / "mnist__5__1.json").write_text('{"first": {}}')
    (folder / "notes.json").write_text('{"first": {"trustworthiness": 0.1}}')
    rows = stores.read_reports(spark, str(folder)).collect()
    assert {(r.dataset, r.k, r.seed, r.method, r.metric) for r in rows} == {
        ("mnist", 5, 0, "first", "trustworthiness"), ("mnist", 5, 0, "first", "Wass_H0")}
    emb, path = layout_df(spark, [[1.0, 2.0], [3.0, 4.0]]), str(tmp_path / "emb")
    stores.write_embedding(emb, path, "first", "mnist", 5, 0)
    stores.write_embedding(emb, path, "first", "mnist", 5, 1)
    stores.write_embedding(emb.limit(1), path, "first", "mnist", 5, 1)
    assert stores.read_embeddings(spark, path).count() == 3
    assert stores.read_embeddings(spark, path, seed=1, method="first").count() == 1
    with pytest.raises(ValueError):
        stores.read_embeddings(spark, path, colour=1)
    scores = spark.createDataFrame(SCORES, R.SCORE_SCHEMA)
    stores.write_reports(scores, str(tmp_path / "scores"))
    assert spark.read.json(str(tmp_path / "scores")).count() == 5
    cube = R.result_cube(scores, ["first"], ["trustworthiness"], [5], [0])
    stores.write_cube(cube, str(tmp_path / "cube"))
    assert spark.read.parquet(str(tmp_path / "cube")).where("dataset = 'mnist'").count() == 1


def test_labelled_files(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (deep / "obj3__1.png").write_bytes(b"x")
    (tmp_path / "obj1__0.pgm").write_bytes(b"yy")
    (tmp_path / "obj1__0.txt").write_bytes(b"no")
    (tmp_path / "logo.png").write_bytes(b"no")
    rows = stores.labelled_files(spark, str(tmp_path)).collect()
    assert sorted((r.label, bytes(r.content)) for r in rows) == [(0, b"yy"), (2, b"x")]


def test_scan_reads_only_its_columns(spark):
    points = P.scan_points(spark, "/root/testdata/sf0.001/embeddings.parquet", "vec_id", "embedding")
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert "label" not in plan.split("ReadSchema")[1]
    assert points.count() == 500


def test_codes_beyond_the_broadcast_are_dealt_evenly(spark, monkeypatch):
    """A third of the rows has no value, another third has the same."""
    monkeypatch.setattr(L, "BROADCAST_BYTES", -1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(i, None if i % 3 == 0 else "hot" if i % 3 == 1 else f"v{i % 50:02}") for i in range(3000)]
        coded = L.label_index(spark.createDataFrame(rows, "id bigint, c string"), "c", missing=-1)
        values = sorted({c for _, c in rows if c is not None})
        assert {r.id: r.code for r in coded.collect()} == {i: -1 if c is None else values.index(c) for i, c in rows}
        parts = [r["n"] for r in coded.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) == 8 and max(parts) < 3000 / 3  # neither third is the work of one task


def test_only_datasets_with_new_reports_are_merged_again(spark, tmp_path):
    reports, path = tmp_path / "reports", str(tmp_path / "cube")
    reports.mkdir()

    def report(dataset, k, value):
        (reports / f"{dataset}__{k}__0.json").write_text(json.dumps({"m": {"trust": value}}))

    def merge(ks=(2, 3)):
        rows = stores.merge_reports(spark, str(reports), path, ["m"], ["trust"], list(ks), [0]).collect()
        return {(r.dataset, r.k): r.value for r in rows}

    files = lambda d: sorted(str(f) for f in (tmp_path / "cube" / f"dataset={d}").iterdir())
    report("one", 2, 0.5)
    report("two", 2, 0.25)
    assert merge() == {("one", 2): 0.5, ("one", 3): None, ("two", 2): 0.25, ("two", 3): None}
    held = files("one"), files("two")
    assert merge()["one", 2] == 0.5 and (files("one"), files("two")) == held
    report("two", 3, 0.75)
    report("three", 2, 1.0)
    second = merge()
    assert second["two", 3] == 0.75 and second["two", 2] == 0.25 and second["three", 2] == 1.0 and second["one", 2] == 0.5
    assert files("one") == held[0] and files("two") != held[1]
    (reports / "one__2__0.json").write_text(json.dumps({"m": {"trust": 0.125}}))
    assert merge()["one", 2] == 0.125
    assert merge((2,)) == {("one", 2): 0.125, ("two", 2): 0.25, ("three", 2): 1.0}  # another grid
