"""The embedding fit: neighbours, start layout, and one Spark job for several epochs.

Everything an epoch needs about the high-dimensional data is computed once and written: the neighbour
lists and, per edge, the candidate triangles with their weights. A block of epochs draws its triangles by
hashes in one job, runs as one chain of shuffles in a second one, and writes the new layout to the
checkpoint folder; nothing of size N passes through the driver. A fit in a folder of its own can be killed
and goes on from the last layout that was written.
"""

from __future__ import annotations

import hashlib
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.operators import cech, layout, loss, triangles
from ballgraph.operators.discrete_loss import discrete_gradient_rows, layout_packs
from ballgraph.operators.graph import knn_edges
from ballgraph.operators.knn import METRICS, complete_lists, neighbour_lists
from ballgraph.operators.linalg import pca
from ballgraph.operators.neighbours import METHODS, knn
from ballgraph.session import Scratch, plain_session
from ballgraph.sources.points import validate_knn, validate_points, with_positions

INITS = ("pca", "spectral", "random")
RADII = ("euclidean", "discrete")
ANNEALS = ("loss", "step")


# Parameter names and defaults of the public interface.
@dataclass(frozen=True)
class EmbedConfig:
    n_neighbors: int = 10
    n_components: int = 2
    metric: str = "euclidean"
    nn_method: str = "exact"
    nn_options: dict = field(default_factory=dict)
    pca_components: int | None = None
    init: str = "pca"
    binarize_for_spectral_init: bool = True
    high_dim_cech: str = "euclidean"
    low_dim_cech: str = "euclidean"
    use_softmax: bool = True
    softmax_beta: float = 10.0
    softmax_beta_discrete: float = 10.0
    triplets_per_edge: int = 1
    negative_rate_triplets: float = 1
    proportion_uniform_triplets: float = 0.5
    exclude_neighbors_in_negative_triplets: bool = False
    phi: str = "student"
    exp_tau: float = 1.0
    gamma: float = 1.0
    use_triplet_weight_in_ce_loss: bool = False
    n_epochs: int = 200
    optimizer: str = "sparse_adam"
    adagrad_lr_decay: float = 0.0
    learning_rate: float = 1.0
    anneal_learning_rate: bool = False
    anneal: str = "loss"     # "loss" scales the loss, "step" the learning rate
    clip_norm: float | None = None
    random_state: int = 42
    hasher: str = "xxhash64"  # "md5" draws the same numbers outside Spark
    epochs_print: int = 10

    def __post_init__(self):
        choices = {
            "metric": METRICS, "nn_method": METHODS, "init": INITS, "high_dim_cech": RADII,
            "low_dim_cech": RADII, "phi": ("student", "exp"), "optimizer": loss.OPTIMIZERS,
            "anneal": ANNEALS, "hasher": ("xxhash64", "md5"),
        }
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"unknown {name} {getattr(self, name)!r}; use one of {allowed}")
        for name in ("n_neighbors", "n_components", "triplets_per_edge"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.n_epochs < 0:
            raise ValueError("n_epochs must not be negative")


@dataclass
class Fit:
    embedding: DataFrame    # (id, y)
    log: DataFrame          # (epoch, loss, mean_edge)
    knn: DataFrame          # (i, j, rank, d) over positions 0..n-1
    n: int


#: Epochs of one block, whose triangles are drawn by one job and whose layout is written for a restart, and epochs that
#: run as one job: beyond a few, the time to plan them grows faster than what a job costs.
BLOCK_EPOCHS = 20
CHAIN_EPOCHS = 5
#: Vertices of a broadcast layout that one task sums.
PARTITION_VERTICES = 50_000
#: Columns of drawn triangles while layouts are broadcast.
DRAWN = ["i", "j", "k", "w", "positive"]
DRAWN_SCHEMA = "i bigint, j bigint, k bigint, w double, positive boolean"


class _Epochs:
    """The written inputs of the epochs and the jobs that make their steps."""

    def __init__(self, cfg: EmbedConfig, points: DataFrame, near: DataFrame, n: int, scratch: Scratch):
        self.cfg, self.n, self.scratch, self.points = cfg, n, scratch, points
        self.lists = scratch.once(lambda: complete_lists(neighbour_lists(near), points), "lists")
        self.ranked, self.n_sources = triangles.source_ranks(self.lists, n, scratch)
        self.max_d = near.agg(F.max("d")).first()[0]
        self.packed = None
        discrete = cfg.high_dim_cech == "discrete"
        self.cached = cfg.n_neighbors > 1
        if discrete or self.cached:
            self.packed = scratch.once(lambda: cech.packs(points, self.lists), "packs")

        def candidates() -> DataFrame:
            if not self.cached:
                return cech.candidate_triangles(self.lists)
            if discrete:
                return cech.weighted_candidates_discrete(self.packed, self.max_d, cfg.softmax_beta_discrete)
            return cech.weighted_candidates(self.packed, self.max_d, cfg.use_softmax, cfg.softmax_beta)

        self.cand = scratch.once(candidates, "candidates")
        # an edge without candidates takes any third vertex, whose triangle has no weight yet
        self.bare = self.cached and not self.cand.where("size(ks) = 0").isEmpty()
        self.n_positive = near.count() * cfg.triplets_per_edge
        self.n_negative = triangles.negative_counts(
            self.n_positive, cfg.negative_rate_triplets, cfg.proportion_uniform_triplets
        )
        self.small = loss.fits_broadcast(n, cfg.n_components)
        # these two need all gradients of an epoch, or the layout at all neighbours, before the step
        self.chained = cfg.clip_norm is None and cfg.low_dim_cech == "euclidean"

    def weigh(self, rows: DataFrame) -> DataFrame:
        cfg = self.cfg
        return cech.triangle_weights(
            rows, self.points, self.packed, self.max_d, cfg.high_dim_cech, cfg.use_softmax,
            cfg.softmax_beta, cfg.softmax_beta_discrete,
        )

    def positives(self, epoch: int | tuple[int, int]) -> DataFrame:
        cfg = self.cfg
        rows = triangles.positive_triplets(
            self.cand, self.n, cfg.triplets_per_edge, cfg.random_state, epoch, cfg.hasher
        ).withColumn("s", F.col("rep").cast("bigint"))
        columns = ["s", "i", "j", "k", "w", *(["epoch"] if isinstance(epoch, tuple) else [])]
        if not self.cached:
            return self.weigh(rows).select(*columns)
        if not self.bare:
            return rows.select(*columns)
        return rows.where("w IS NOT NULL").select(*columns).union(
            self.weigh(rows.where("w IS NULL").drop("w")).select(*columns)
        )

    def negatives(self, epoch: int | tuple[int, int]) -> DataFrame | None:
        cfg = self.cfg
        if not sum(self.n_negative):
            return None
        rows = triangles.negative_triplets(
            self.ranked, self.n, *self.n_negative, cfg.random_state, epoch,
            cfg.exclude_neighbors_in_negative_triplets, cfg.hasher, self.n_sources,
        ).withColumnRenamed("slot", "s")
        rows = self.weigh(rows) if cfg.use_triplet_weight_in_ce_loss else rows.withColumn("w", F.lit(1.0))
        return rows.select("s", "i", "j", "k", "w", *(["epoch"] if isinstance(epoch, tuple) else []))

    def alpha(self, epoch: int) -> tuple[float, float]:
        """(factor of the loss, learning rate) of an epoch."""
        cfg = self.cfg
        left = 1.0 - (epoch - 1) / max(1, cfg.n_epochs) if cfg.anneal_learning_rate else 1.0
        if not cfg.anneal_learning_rate:
            return 1.0, cfg.learning_rate
        if cfg.anneal == "loss":
            return cfg.learning_rate * left, cfg.learning_rate
        return 1.0, cfg.learning_rate * left

    def gradient_rows(self, state: DataFrame, epoch: int) -> DataFrame:
        """(id, g.., loss) rows of one epoch's triangles at the layout in ``state``."""
        cfg, d = self.cfg, self.cfg.n_components
        alpha, _ = self.alpha(epoch)
        wide = state.select("id", *loss.coords(d))
        pos, neg = self.positives(epoch), self.negatives(epoch)
        discrete = cfg.low_dim_cech == "discrete"
        parts = [] if discrete else [pos.withColumn("positive", F.lit(True))]
        if neg is not None:
            parts.append(neg.withColumn("positive", F.lit(False)))
        grads = None
        if parts:
            rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            placed = loss.place(rows, wide, d, self.small)
            losses = loss.triangle_losses(
                placed, cfg.phi, cfg.exp_tau, cfg.gamma, cfg.use_softmax, cfg.softmax_beta
            )
            grads = loss.gradient_rows(losses, d, self.n_positive, alpha)
        if discrete:
            packs = layout_packs(wide, self.lists, d)
            mine = discrete_gradient_rows(
                pos, packs, d, self.n_positive, alpha, cfg.phi, cfg.exp_tau, cfg.softmax_beta_discrete
            )
            grads = mine if grads is None else mine.unionByName(grads)
        return grads

    def step(self, state: DataFrame, epoch: int) -> DataFrame:
        """The next state, with the epoch's loss booked per vertex."""
        cfg, d = self.cfg, self.cfg.n_components
        grads = self.gradient_rows(state, epoch)
        if cfg.clip_norm is not None:
            summed = self.scratch.save(loss.sum_gradients(grads, d), "grads")
            grads = loss.clipped(summed, d, cfg.clip_norm)
        _, rate = self.alpha(epoch)
        return loss.step(state, grads, d, cfg.optimizer, rate, cfg.adagrad_lr_decay)

    def chain(self, state: DataFrame, drawn: str, first: int, last: int) -> DataFrame:
        """The state after the epochs as one query on the state before and the written triangles."""
        cfg, spark = self.cfg, state.sparkSession
        held = [c for c in state.columns if c not in ("id", "loss")]
        for epoch in range(first, last + 1):
            alpha, rate = self.alpha(epoch)
            view = f"state_{uuid.uuid4().hex}"
            state.createOrReplaceTempView(view)
            state = spark.sql(loss.chained_step(
                loss.Steps(view), held, drawn, epoch, cfg.n_components, self.n_positive, cfg.optimizer, rate,
                cfg.adagrad_lr_decay, alpha, cfg.phi, cfg.exp_tau, cfg.gamma, cfg.use_softmax, cfg.softmax_beta,
                self.small,
            ).text())
            spark.catalog.dropTempView(view)
        return state

    def draw(self, first: int, last: int) -> str:
        """A written table with the triangles of several epochs: its folder while states are broadcast, else its name,
        in buckets that the epochs need not shuffle."""
        rows = self.positives((first, last)).withColumn("positive", F.lit(True))
        neg = self.negatives((first, last))
        if neg is not None:
            rows = rows.unionByName(neg.withColumn("positive", F.lit(False)))
        name = f"drawn-{last}"
        if self.small:
            rows.select("epoch", *DRAWN).write.mode("overwrite").partitionBy("epoch").parquet(self.scratch.path(name))
            return name
        rows = loss.with_own_rows(rows, self.lists.select(F.col("i").alias("id")), (first, last))
        return self.scratch.save_bucketed(loss.by_corner(rows), name, "id", "epoch")

    def march(self, state: DataFrame, drawn: str, first: int, last: int, name: str) -> DataFrame:
        """The written state after the epochs, a job each on states that executors hold in memory.

        Only the layout, which is below ``loss.BROADCAST_BYTES``, goes to the tasks. A lost part of a state is computed
        again from the last written one.
        """
        cfg, d, spark, held, sent = self.cfg, self.cfg.n_components, state.sparkSession, [], []
        for epoch in range(first, last + 1):
            sent.append(spark.sparkContext.broadcast(loss.layout_array(state, self.n, d)))
            rows = spark.read.schema(DRAWN_SCHEMA).parquet(self.scratch.path(f"{drawn}/epoch={epoch}"))
            alpha, rate = self.alpha(epoch)
            grads = loss.summed_pulls(
                rows, sent[-1], d, self.n_positive, alpha, cfg.phi, cfg.exp_tau, cfg.gamma, cfg.use_softmax,
                cfg.softmax_beta,
            )
            state = loss.step(state, grads, d, cfg.optimizer, rate, cfg.adagrad_lr_decay, by_task=True)
            if epoch < last:
                held.append(state.persist())
        saved = self.scratch.save(state, name)
        for kept in held:
            kept.unpersist()
        for layout in sent:
            layout.destroy()
        return saved

    def block(self, state: DataFrame, first: int, last: int, drawn: str | None = None) -> DataFrame:
        """The written state after the epochs ``first`` to ``last``, whose triangles may be ``drawn`` already."""
        name, spark = f"state-{last}", self.scratch.spark
        if not self.chained:
            for epoch in range(first, last + 1):
                state = self.scratch.save(self.step(state, epoch), name if epoch == last else f"within-{epoch}")
                if epoch - 1 >= first:
                    self.scratch.drop(f"within-{epoch - 1}")
            return state
        table = drawn or self.draw(first, last)
        plain = plain_session(spark, -(-self.n // PARTITION_VERTICES) if self.small else None)
        paths = state.inputFiles()
        if self.small:
            state = self.march(plain.read.schema(state.schema).parquet(*paths), table, first, last, name)
            self.scratch.drop(table)
            return state
        for begin in range(first, last + 1, CHAIN_EPOCHS):
            end = min(begin + CHAIN_EPOCHS - 1, last)
            at = name if end == last else f"within-{end}"
            now = plain.read.schema(state.schema).parquet(*paths)
            state = self.scratch.save(self.chain(now, table, begin, end), at)
            if begin > first:
                self.scratch.drop(f"within-{begin - 1}")
            paths = [self.scratch.path(at)]
        self.scratch.drop_table(table, f"drawn-{last}")
        return state

    def report(self, state: DataFrame, near: DataFrame) -> DataFrame:
        """One row of the log for a written state."""
        edge = loss.mean_edge_length(near.select("i", "j"), state, self.cfg.n_components, self.small)
        return state.agg(F.sum("loss").alias("loss")).crossJoin(edge)


def start_layout(points: DataFrame, near: DataFrame, n: int, width: int, cfg: EmbedConfig) -> DataFrame:
    if cfg.init == "random":
        return layout.random_layout(points, cfg.n_components, cfg.random_state, cfg.hasher)
    if cfg.init == "spectral":
        edges = knn_edges(near, cfg.binarize_for_spectral_init)
        return layout.spectral_layout(points, edges, n, cfg.n_components, cfg.random_state)
    return layout.pca_layout(points, cfg.n_components, cfg.random_state, width)


def _logged(cfg: EmbedConfig, epoch: int) -> bool:
    return epoch % max(1, cfg.epochs_print) == 0 or epoch in (1, cfg.n_epochs)


def _run_blocks(cfg: EmbedConfig, epochs: _Epochs, state: DataFrame, near: DataFrame, scratch: Scratch):
    """The last state and the log; goes on after the last written state that the folder has."""
    found = [int(x.removeprefix("state-")) for x in scratch.names() if x.startswith("state-")]
    done = max((e for e in found if e <= cfg.n_epochs), default=0)
    if done:
        state = scratch.spark.read.parquet(scratch.path(f"state-{done}"))
    log = []
    for epoch in (e for e in range(1, done + 1) if _logged(cfg, e)):
        kept = scratch.once(lambda: epochs.report(state, near), f"log-{epoch}")  # written with the states, but perhaps the last
        log.append((epoch, *kept.first()))
    blocks = []
    for epoch in range(done + 1, cfg.n_epochs + 1):
        if _logged(cfg, epoch) or epoch == cfg.n_epochs or epoch - (blocks[-1][1] if blocks else done) == BLOCK_EPOCHS:
            blocks.append((blocks[-1][1] + 1 if blocks else done + 1, epoch))
    with ThreadPoolExecutor(1) as ahead:  # the next block's triangles do not depend on the layout
        drawn = ahead.submit(epochs.draw, *blocks[0]) if blocks and epochs.chained else None
        for nth, (first, last) in enumerate(blocks):
            table = drawn.result() if drawn else None
            if drawn and nth + 1 < len(blocks):
                drawn = ahead.submit(epochs.draw, *blocks[nth + 1])
            state = epochs.block(state, first, last, table)
            if _logged(cfg, last):
                log.append((last, *scratch.save(epochs.report(state, near), f"log-{last}").first()))
            if first > 1:
                scratch.drop(f"state-{first - 1}")
    return state, log


def fit(points: DataFrame, cfg: EmbedConfig | None = None, folder: str | None = None, **params) -> Fit:
    """Embeds (id, v) points. Parameters are those of ``EmbedConfig``.

    With a ``folder`` that all executors reach, a fit that was killed goes on from its last written tables when it is
    called again with the same points and parameters; other points or parameters are an error.
    """
    cfg = cfg or EmbedConfig(**params)
    spark = points.sparkSession
    scratch = Scratch(spark, "fit", folder)
    points = points.select("id", "v") if folder else scratch.save(points.select("id", "v"), "input")
    shape = validate_points(points)
    if folder:
        sums = points.select(F.xxhash64("id", "v").alias("h")).agg(F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
        about = hashlib.sha256(repr((cfg, shape, tuple(sums))).encode()).hexdigest()
        kept = scratch.once(lambda: spark.createDataFrame([(about,)], "about string"), "about").first()[0]
        if kept != about:
            raise ValueError(f"{folder} holds a fit of other points or parameters")
        points = scratch.once(lambda: points, "input")
    n, width, d = shape["n"], shape["max_width"], cfg.n_components
    indexed, codes = with_positions(points, shape, scratch)
    if cfg.pca_components and cfg.pca_components < width:
        indexed, width = pca(indexed, cfg.pca_components, width), cfg.pca_components
    if codes is not None or width != shape["max_width"]:
        rows = indexed
        indexed = scratch.once(lambda: rows, "points")
    near = scratch.once(
        lambda: knn(indexed, cfg.n_neighbors, cfg.nn_method, cfg.metric, cfg.random_state, **cfg.nn_options), "knn"
    )
    validate_knn(near, indexed)

    def begin() -> DataFrame:
        start = start_layout(indexed, near, n, width, cfg)
        return loss.start_state(loss.widen(start, d), d, cfg.optimizer).withColumn("loss", F.lit(0.0))

    state, log = scratch.once(begin, "start"), []
    if not near.isEmpty():
        state, log = _run_blocks(cfg, _Epochs(cfg, indexed, near, n, scratch), state, near, scratch)
    emb = loss.narrow(state, d)
    if codes is not None:
        emb = emb.join(codes, emb.id == codes.pos).select(codes["id"], "y")
    table = spark.createDataFrame(log, "epoch bigint, loss double, mean_edge double")
    return Fit(emb, table, near, n)


def fit_transform(points: DataFrame, **params) -> DataFrame:
    """(id, y) of the fitted layout."""
    return fit(points, **params).embedding
