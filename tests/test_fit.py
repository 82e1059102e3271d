import numpy as np
import pytest
from pyspark.sql import functions as F

from ballgraph.operators import triangles as R
from ballgraph.operators.evaluation import trustworthiness
from ballgraph.operators.layout import random_layout
from ballgraph.plans.embed import EmbedConfig, fit, fit_transform
from tests.helpers import blobs, column, points_df


@pytest.fixture(scope="module")
def cloud(spark):
    x, _ = blobs(40, 3, 10, seed=1)
    return points_df(spark, x).persist()


def test_loss_falls_and_neighbourhoods_beat_chance(spark, cloud):
    out = fit(cloud, n_neighbors=8, n_epochs=20, init="random", epochs_print=19)
    log = out.log.orderBy("epoch").collect()
    assert [r.epoch for r in log] == [1, 19, 20]
    assert log[-1].loss < 0.8 * log[0].loss
    score = lambda y: trustworthiness(cloud, y, 10).first()[0]
    assert score(out.embedding) > score(random_layout(cloud, 2, 5)) + 0.1


def test_result_does_not_depend_on_partitions_or_ids(spark):
    x, _ = blobs(15, 2, 4, seed=2)
    kw = dict(n_neighbors=4, n_epochs=3, random_state=3)
    one = column(fit_transform(points_df(spark, x, parts=1), **kw), "y")
    seven = column(fit_transform(points_df(spark, x, parts=7), **kw), "y")
    spread = column(fit_transform(points_df(spark, x, ids=[5 * i + 2 for i in range(30)]), **kw), "y")
    assert np.allclose(one, seven, atol=1e-6) and np.allclose(one, spread, atol=1e-6)


OPTIONS = [
    dict(high_dim_cech="discrete"),
    dict(low_dim_cech="discrete", phi="exp"),
    dict(use_softmax=False, optimizer="adagrad", adagrad_lr_decay=0.1),
    dict(use_triplet_weight_in_ce_loss=True, exclude_neighbors_in_negative_triplets=True),
    dict(negative_rate_triplets=0, optimizer="sgd"),
    dict(negative_rate_triplets=1.5, proportion_uniform_triplets=1.0, triplets_per_edge=2),
    dict(anneal_learning_rate=True, anneal="step", clip_norm=1.0, n_components=3),
    dict(pca_components=3, init="spectral", binarize_for_spectral_init=False),
    dict(n_neighbors=1, metric="cosine"),
    dict(nn_method="ivf", nn_options={"n_lists": 4, "n_probe": 4}),
]


@pytest.mark.parametrize("options", OPTIONS, ids=lambda o: "-".join(o))
def test_every_option_runs(spark, cloud, options):
    out = fit(cloud, **{"n_neighbors": 4, "n_epochs": 2, **options})
    y = column(out.embedding, "y")
    assert y.shape == (120, options.get("n_components", 2)) and np.isfinite(y).all()
    assert all(np.isfinite(r.loss) for r in out.log.collect())


def test_no_epochs_gives_the_start_layout(spark, cloud):
    y = column(fit_transform(cloud, n_neighbors=3, n_epochs=0), "y")
    assert y.min() > -0.01 and y.max() < 10.01


def test_one_point_has_no_edges(spark):
    out = fit(points_df(spark, [[1.0, 2.0]]), n_epochs=3, init="random")
    assert out.embedding.count() == 1 and out.log.count() == 0


@pytest.mark.parametrize("bad", [
    dict(init="tsne"), dict(optimizer="adamw"), dict(phi="cauchy"), dict(metric="l1"),
    dict(nn_method="hnsw"), dict(high_dim_cech="rips"), dict(n_neighbors=0), dict(n_epochs=-1),
])
def test_unknown_options_are_refused(bad):
    with pytest.raises(ValueError):
        EmbedConfig(**bad)


def test_bad_points_are_refused(spark):
    for rows, why in (([(0, [1.0]), (0, [2.0])], "unique"), ([(0, [1.0]), (1, [1.0, 2.0])], "widths"),
                      ([(0, [1.0]), (1, [float("nan")])], "missing")):
        with pytest.raises(ValueError, match=why):
            fit(spark.createDataFrame(rows, "id bigint, v array<double>"), n_epochs=0)


def _lists(spark, n, k, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [int(j) for j in rng.choice([c for c in range(n) if c != i], k, replace=False)]) for i in range(n)]
    return spark.createDataFrame(rows, "i bigint, js array<bigint>").persist()


@pytest.mark.parametrize("exclude", [False, True])
def test_negatives_avoid_what_they_must(spark, exclude):
    lists = _lists(spark, 60, 4)
    js = {r.i: set(r.js) for r in lists.collect()}
    rows = R.negative_triplets(lists, 60, 300, 200, 1, 1, exclude).collect()
    assert len(rows) == 500
    for r in rows:
        assert len({r.i, r.j, r.k}) == 3
        assert (r.j not in js[r.i]) if r.slot < 300 else (r.j in js[r.i])
        if exclude:
            assert r.k not in js[r.i] | js[r.j]


def test_samples_ignore_partitions_and_change_with_the_epoch(spark):
    lists = _lists(spark, 40, 3)
    run = lambda df, epoch: sorted(map(tuple, R.negative_triplets(df, 40, 50, 50, 1, epoch).collect()))
    assert run(lists.repartition(1), 1) == run(lists.repartition(7), 1) != run(lists, 2)


def test_three_points_still_get_proper_triangles(spark):
    rows = R.negative_triplets(_lists(spark, 3, 1), 3, 0, 60, 1, 1).collect()
    assert all(len({r.i, r.j, r.k}) == 3 for r in rows)


def test_positive_picks_are_even(spark):
    cand = spark.createDataFrame([(0, 1, [2, 3, 4, 4])], "i bigint, j bigint, ks array<bigint>")
    picks = R.positive_triplets(cand, 9, 4000, 1, 1).groupBy("k").count().collect()
    share = {r["k"]: r["count"] / 4000 for r in picks}
    assert share[4] == pytest.approx(0.5, abs=0.05) and share[2] == pytest.approx(0.25, abs=0.05)


def test_an_edge_without_candidates_takes_another_vertex(spark):
    cand = spark.createDataFrame([(0, 1, [])], "i bigint, j bigint, ks array<bigint>")
    got = {r.k for r in R.positive_triplets(cand, 4, 200, 1, 1).collect()}
    assert got == {2, 3}


def test_negative_counts_round_half_to_even():
    assert R.negative_counts(5, 1, 0.5) == (2, 3)
    assert R.negative_counts(7, 1, 0.5) == (4, 3)
    assert R.negative_counts(10, 0, 0.5) == (0, 0)
    assert R.negative_counts(10, 1, 3.0) == (10, 0)


def test_epoch_plan_has_no_cross_product(spark, cloud):
    from ballgraph.operators.knn import exact_knn
    from ballgraph.operators.loss import start_state, widen
    from ballgraph.plans.embed import _Epochs
    from ballgraph.session import Scratch

    cfg = EmbedConfig(n_neighbors=4)
    epochs = _Epochs(cfg, cloud, exact_knn(cloud, 4), 120, Scratch(spark, "test"))
    state = start_state(widen(random_layout(cloud, 2, 1), 2), 2, cfg.optimizer)
    plan = epochs.step(state.withColumn("loss", F.lit(0.0)), 1)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "PythonUDF" not in plan


def _near(a, b):
    return np.allclose(column(a, "y"), column(b, "y"), atol=1e-6)


@pytest.mark.parametrize("options", [dict(), dict(high_dim_cech="discrete"), dict(optimizer="adagrad", adagrad_lr_decay=0.1),
                                     dict(anneal_learning_rate=True, optimizer="sgd", negative_rate_triplets=0)])
@pytest.mark.parametrize("small", [True, False])
def test_chained_epochs_are_single_steps(spark, cloud, monkeypatch, options, small):
    from ballgraph.plans import embed

    kw = dict(n_neighbors=4, n_epochs=7, epochs_print=7, **options)
    monkeypatch.setattr(embed.loss, "fits_broadcast", lambda n, d: small)
    monkeypatch.setattr(embed, "CHAIN_EPOCHS", 4)
    chained = fit(cloud, **kw)
    start = embed._Epochs.__init__

    def singly(self, *args):
        start(self, *args)
        self.chained = False

    monkeypatch.setattr(embed._Epochs, "__init__", singly)
    single = fit(cloud, **kw)
    assert _near(chained.embedding, single.embedding)
    a, b = ([tuple(r) for r in x.log.orderBy("epoch").collect()] for x in (chained, single))
    assert np.allclose(a, b, atol=1e-6)


def test_a_killed_fit_goes_on(spark, cloud, monkeypatch, tmp_path):
    from ballgraph.plans import embed

    kw = dict(n_neighbors=4, n_epochs=12, epochs_print=4)
    whole = fit(cloud, **kw)
    folder, block, calls = str(tmp_path / "fit"), embed._Epochs.block, []

    def killed(self, state, first, last, *rest):
        calls.append(first)
        if first > 4 and len(calls) < 4:
            raise RuntimeError("killed")
        return block(self, state, first, last, *rest)

    monkeypatch.setattr(embed._Epochs, "block", killed)
    with pytest.raises(RuntimeError, match="killed"):
        fit(cloud, folder=folder, **kw)
    searched = []
    monkeypatch.setattr(embed, "knn", lambda *a, **k: searched.append(a))
    again = fit(cloud, folder=folder, **kw)
    assert calls == [1, 2, 5, 5, 9] and not searched  # tables that were written are not made again
    assert _near(whole.embedding, again.embedding)
    assert [r.epoch for r in again.log.orderBy("epoch").collect()] == [1, 4, 8, 12]
    assert np.allclose([tuple(r) for r in whole.log.orderBy("epoch").collect()],
                       [tuple(r) for r in again.log.orderBy("epoch").collect()], atol=1e-6)
    for options in (dict(kw, random_state=1), dict(kw, n_neighbors=5)):
        with pytest.raises(ValueError, match="other points or parameters"):
            fit(cloud, folder=folder, **options)


def test_epochs_need_as_many_exchanges_in_both_radius_modes(spark, cloud):
    from ballgraph.operators.knn import exact_knn
    from ballgraph.operators.loss import start_state, widen
    from ballgraph.plans.embed import _Epochs
    from ballgraph.session import Scratch, plain_session

    counts = {}
    for radius in ("euclidean", "discrete"):
        scratch = Scratch(spark, "test")
        epochs = _Epochs(EmbedConfig(n_neighbors=4, high_dim_cech=radius), cloud, exact_knn(cloud, 4), 120, scratch)
        epochs.small = False
        table = epochs.draw(1, 2)
        plain = plain_session(spark)
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            plain.conf.set(key, "-1")
        state = scratch.save(start_state(widen(random_layout(cloud, 2, 1), 2), 2, "sparse_adam").withColumn("loss", F.lit(0.0)), "start")
        plan = epochs.chain(plain.read.parquet(scratch.path("start")), table, 1, 2)._jdf.queryExecution().toString()
        physical = plan[plan.index("== Physical Plan =="):]
        counts[radius] = physical.count("Exchange hashpartitioning")
        assert "BroadcastExchange" not in physical and "Arrow" not in physical
        scratch.drop_table(table, "drawn-2")
    assert counts["euclidean"] == counts["discrete"] <= 5  # two an epoch, and the state that begins the block


def test_a_task_draws_for_all_epochs_what_they_draw_alone(spark, monkeypatch):
    """Texts of epochs are picked, not made for each row; few rows draw more than one value; all tasks have all epochs."""
    from ballgraph.functions.draws import Key, draw

    assert "concat" not in draw((1, Key("epoch", 3, 5), "x"), "slot")
    lists = spark.createDataFrame([(i, [(i + 1) % 7, (i + 2) % 7, (i + 4) % 7]) for i in range(7)], "i bigint, js array<bigint>")
    options = dict(n=7, n_uniform=300, n_local=300, seed=5)
    rows = R.negative_triplets(lists, epoch=(3, 5), **options)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "_s3" not in plan and "_t3" not in plan
    parts = {}
    for r in rows.selectExpr("spark_partition_id() AS p", "epoch").distinct().collect():
        parts.setdefault(r.p, set()).add(r.epoch)
    assert len(parts) > 1 and all(found == {3, 4, 5} for found in parts.values())
    for epoch in (3, 4, 5):
        alone = R.negative_triplets(lists, epoch=epoch, **options).collect()
        assert sorted(map(tuple, rows.where(f"epoch = {epoch}").select("slot", "i", "j", "k").collect())) == sorted(map(tuple, alone))
    for limit in (0, R.HELD_BYTES):  # joins by hashing either way
        monkeypatch.setattr(R, "HELD_BYTES", limit)
        joined = R.negative_triplets(lists, epoch=3, **options)._jdf.queryExecution().executedPlan().toString()
        assert ("ShuffledHashJoin" if limit == 0 else "BroadcastHashJoin") in joined and "SortMergeJoin" not in joined


def test_sessions_of_epochs_send_rows_without_a_look_at_their_bytes(spark):
    from ballgraph.session import plain_session

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    assert plain_session(spark, 3).conf.get(name) == str(2**31 - 1)
    assert plain_session(spark).conf.get(name) == spark.conf.get(name) == before != str(2**31 - 1)
