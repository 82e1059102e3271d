"""Brown class-based bigrams: exchange clustering, class transitions and word emissions.

Frequent words are units of their own; every other word belongs to the unit of its last letters, so every word has a
class. Units are exchanged between classes where that raises the likelihood of the class bigrams (Brown et al. 1992;
distributed exchange after Uszkoreit and Brants 2008: a part of the units moves against the same counts). Units, classes
and the words that tasks keep at hand are bounded by shares of the corpus: at most 2^k words can hold 2^-k of it each.
All counts cover all training texts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.llm.common import arrow_rows, groups_of, text_bytes
from ballgraph.session import Scratch

#: Least share of the training tokens of a word that is a unit, and of one whose count all tasks keep.
UNIT_SHARE = 2.0 ** -15
KNOWN_SHARE = 2.0 ** -20
#: Longer words are never kept by tasks, so the kept words are bounded in bytes too.
KEPT_BYTES = 64
#: Units of the other words, by their last bytes.
ENDINGS = 1024
ENDING_BYTES = 3
#: Classes beside the one of the end token.
CLASSES = 48
#: A round that gains less than this share of the objective ends the exchange, once all parts have had their turn.
LEAST_GAIN = 1e-3
#: Tokens counted together, and weight of the class frequencies in a transition.
STEP_BYTES = 8_000_000
PRIOR = 4.0
MEMO_WORDS = 300_000


def ending(word: bytes) -> int:
    return zlib.crc32(word[-ENDING_BYTES:]) % ENDINGS


class Units(dict):
    """Unit of a word: 0 is the end, then the frequent words, then the endings."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, n) for n, w in enumerate(words, 1))
        self.first = len(words) + 1
        self.n = self.first + ENDINGS
        self.limit = len(words) + MEMO_WORDS

    def __missing__(self, word: bytes) -> int:
        unit = self.first + ending(word)
        if len(word) <= KEPT_BYTES and len(self) < self.limit:
            self[word] = unit
        return unit

    def __reduce__(self):
        return Units, ([w for w, n in sorted(self.items(), key=lambda x: x[1]) if n < self.first],)


def count_words(rows: DataFrame) -> DataFrame:
    """(w, n) of lower-cased words of column ``t``; the empty word counts the ends."""

    def run(batch):
        texts = batch["t"]
        for begin, stop in groups_of(texts, STEP_BYTES):
            counts: Counter = Counter()
            for t in texts[begin:stop]:
                counts.update(t.lower().split())
            counts[b""] = stop - begin
            yield {"w": list(counts), "n": list(counts.values())}

    return arrow_rows(rows.select("t"), run, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def count_pairs(rows: DataFrame, units: Units) -> DataFrame:
    """(a, b, n): neighbouring units of the texts in column ``t``, each text between ends."""
    sent = rows.sparkSession.sparkContext.broadcast(units)

    def run(batches):
        table = sent.value
        get, width = table.__getitem__, np.int64(table.n)
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for begin, stop in groups_of(texts, STEP_BYTES):
                stream = [0]
                for t in texts[begin:stop]:
                    stream.extend(map(get, t.lower().split()))
                    stream.append(0)
                u = np.array(stream, np.int64)
                code, n = np.unique(u[:-1] * width + u[1:], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((code // width).astype(np.int32)), pa.array((code % width).astype(np.int32)), pa.array(n)],
                    names=["a", "b", "n"],
                )

    pairs = rows.select("t").mapInArrow(run, "a int, b int, n bigint")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def pack_units(pairs: DataFrame) -> DataFrame:
    """(unit, next, next_n, prev, prev_n): a unit's neighbours as packed arrays, at most one entry per unit each."""
    both = pairs.select(F.col("a").alias("unit"), F.lit(0).alias("side"), F.col("b").alias("other"), "n").union(
        pairs.select(F.col("b").alias("unit"), F.lit(1).alias("side"), F.col("a").alias("other"), "n")
    )

    def run(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5))],
                names=["unit", "next", "next_n", "prev", "prev_n"],
            )

        def row(unit, parts):
            side, other, n = (np.concatenate(x) for x in zip(*parts))
            cells = [x[side == k].tobytes() for k in (0, 1) for x in (other.astype(np.int32), n.astype(np.int64))]
            return [int(unit), *cells]

        now, parts = None, []
        for batch in batches:
            unit, *rest = (batch.column(c).to_numpy() for c in ("unit", "side", "other", "n"))
            if not len(unit):
                continue
            cuts = [0, *(np.flatnonzero(np.diff(unit)) + 1), len(unit)]
            done = []
            for a, b in zip(cuts, cuts[1:]):
                if unit[a] != now:
                    if parts:
                        done.append(row(now, parts))
                    now, parts = unit[a], []
                parts.append([x[a:b] for x in rest])
            if done:
                yield out(done)
        if parts:
            yield out([row(now, parts)])

    return both.repartition("unit").sortWithinPartitions("unit").mapInArrow(
        run, "unit int, next binary, next_n binary, prev binary, prev_n binary"
    )


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def objective(counts: np.ndarray) -> float:
    """Log-likelihood of the classes of all tokens, up to terms that no assignment changes."""
    return float(_g(counts).sum() - _g(counts.sum(1)).sum() - _g(counts.sum(0)).sum())


def best_class(own: int, right: np.ndarray, left: np.ndarray, self_n: float, counts: np.ndarray) -> tuple[int, float]:
    """(class, gain) of the best exchange of one unit. ``right``, ``left``: its neighbours by class, without itself."""
    n = counts.copy()
    n[own] -= right
    n[:, own] -= left
    n[own, own] -= self_n
    rows, cols = counts.sum(1), counts.sum(0)
    out, into = right.sum() + self_n, left.sum() + self_n
    rows[own] -= out
    cols[own] -= into
    with_right, with_left = n + right[None, :], n + left[:, None]
    base = _g(n)
    gain = (_g(with_right) - base).sum(1) + (_g(with_left) - base).sum(0)
    at = np.diag(n)
    gain += _g(at + right + left + self_n) - _g(at)
    gain -= _g(at + right) - _g(at) + _g(at + left) - _g(at)
    gain -= _g(rows + out) - _g(rows) + _g(cols + into) - _g(cols)
    stay = gain[own]
    gain[0] = -np.inf  # the end's own class
    to = int(np.argmax(gain))
    return to, float(gain[to] - stay)


def _unpacked(batch, classes: np.ndarray, k: int):
    """Per unit: (unit, neighbours to the right by class, to the left by class, times beside itself)."""
    for unit, nxt, nxt_n, prv, prv_n in zip(*(batch.column(c).to_pylist() for c in ("unit", "next", "next_n", "prev", "prev_n"))):
        nxt, nxt_n = np.frombuffer(nxt, np.int32), np.frombuffer(nxt_n, np.int64)
        prv, prv_n = np.frombuffer(prv, np.int32), np.frombuffer(prv_n, np.int64)
        beside = float(nxt_n[nxt == unit].sum())
        yield unit, np.bincount(classes[nxt], nxt_n, k), np.bincount(classes[prv], prv_n, k), beside


def class_counts(packed: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Neighbouring classes. A task sends one packed matrix, about root-many tasks add them up, as many come back."""
    sent = packed.sparkSession.sparkContext.broadcast(classes)
    folds = max(1, math.isqrt(packed.rdd.getNumPartitions()))

    def run(batches):
        total = np.zeros((k, k), np.int64)
        for batch in batches:
            for unit, right, _, _ in _unpacked(batch, sent.value, k):
                total[sent.value[unit]] += right.astype(np.int64)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(m, np.int64) for m in table.column("m").to_pylist())
        return pa.table({"m": pa.array([total.tobytes()], pa.binary())})

    rows = packed.mapInArrow(run, "m binary").withColumn("fold", F.pmod(F.spark_partition_id(), F.lit(folds)))
    out = np.zeros(k * k, np.int64)
    for r in rows.groupBy("fold").applyInArrow(add, "m binary").collect():
        out += np.frombuffer(r["m"], np.int64)
    return out.reshape(k, k).astype(float)


def exchange(packed: DataFrame, classes: np.ndarray, k: int, least_gain: float = LEAST_GAIN) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, neighbouring class counts) after exchanges that each raised the objective.

    Units take turns in parts chosen by hash. A round that would lower the objective is undone and the parts halve.
    """
    counts = class_counts(packed, classes, k)
    now, parts, turn, small = objective(counts), 2, 0, 0
    units = np.arange(len(classes))
    part_of = np.array([zlib.crc32(int(u).to_bytes(4, "little")) for u in units], np.int64)
    while small < parts and parts <= 64:
        moving = (part_of % parts == turn % parts) & (units > 0)
        sent = packed.sparkSession.sparkContext.broadcast((classes, counts, moving))

        def run(batches, sent=sent):
            classes, counts, moving = sent.value
            for batch in batches:
                found = []
                for unit, right, left, beside in _unpacked(batch, classes, k):
                    if moving[unit]:
                        own = classes[unit]
                        right[own] -= beside
                        left[own] -= beside
                        to, gain = best_class(own, right, left, beside, counts)
                        if gain > 1e-6 and to != own:
                            found.append((unit, to))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int32()) for c in zip(*found)], names=["unit", "to"]
                    )

        moves = packed.mapInArrow(run, "unit int, to int").collect()  # at most one row per unit
        turn += 1
        if not moves:
            small += 1
            continue
        after = classes.copy()
        after[[m["unit"] for m in moves]] = [m["to"] for m in moves]
        after_counts = class_counts(packed, after, k)
        value = objective(after_counts)
        if value <= now:
            parts, small = parts * 2, 0
            continue
        small = small + 1 if value - now < least_gain * abs(now) else 0
        classes, counts, now = after, after_counts, value
    return classes, counts


class Model:
    """What scoring needs: transitions between classes, emission statistics by class, and the kept words."""

    def __init__(self, units: Units, classes: np.ndarray, counts: np.ndarray, distinct: np.ndarray, kept: list, totals: dict):
        k = counts.shape[0]
        self.tokens, self.vocabulary, self.discount = totals["tokens"], totals["vocabulary"], totals["discount"]
        self.log_all = math.log10(self.tokens + 0.5 * (self.vocabulary + 1))
        self.class_tokens = counts.sum(0)
        prior = (self.class_tokens + 1) / (self.class_tokens.sum() + k)
        self.log_step = np.log10((counts + PRIOR * prior[None, :]) / (counts.sum(1) + PRIOR)[:, None])
        empty = self.class_tokens == 0
        mass = self.discount * distinct / np.where(empty, 1, self.class_tokens)
        self.log_new = np.where(empty | (distinct == 0), 0.0, np.log10(np.maximum(mass, 1e-300)))
        self.log_class = np.log10(np.maximum(self.class_tokens, 1))
        self.ending_class = classes[units.first:]
        self.known = {w: n for n, (w, _) in enumerate(kept)}
        self.known_n = np.array([n for _, n in kept], np.int64)
        # index -1 is a word that is not kept: nothing is added for it here
        self.known_class = np.array([classes[units[w] if w else 0] for w, _ in kept] + [0], np.int64)
        n = np.append(self.known_n, 1).astype(float)
        self.known_base = np.log10(n + 0.5) - self.log_all
        self.known_emit = np.log10(np.maximum(n - self.discount, 1e-300)) - self.log_class[self.known_class]
        self.known_base[-1] = self.known_emit[-1] = 0.0
        self.has_end = b"" in self.known

    def text(self, text: bytes) -> tuple[int, int, float, float, dict]:
        """(tokens, known ones, base, score, {word: (times, class)} of the words not kept)."""
        words = text.lower().split()
        get = self.known.get
        at = np.array([get(w, -1) for w in words] + [get(b"", -1)], np.int64)
        cls = self.known_class[at]
        rest: dict = {}
        for n in np.flatnonzero(at[:-1] < 0):
            w = words[n]
            c = cls[n] = self.ending_class[ending(w)]
            rest[w] = (rest[w][0] + 1 if w in rest else 1, c)
        steps = self.log_step[np.concatenate(([0], cls[:-1])), cls].sum()
        known = int((at >= 0).sum())
        base, score = self.known_base[at].sum(), steps + self.known_emit[at].sum()
        if not self.has_end:  # nothing was learnt
            base += math.log10(0.5) - self.log_all
        return len(at), known, float(base), float(score), rest


def learn(rows: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame]:
    """The model of the texts in column ``t``, and all their words (w, n)."""
    words = scratch.save(count_words(rows), "words")
    sums = words.agg(
        F.sum("n").alias("tokens"), F.count("*").alias("vocabulary"),
        F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"),
    ).first()
    tokens = sums["tokens"] or 0
    once, twice = sums["once"], sums["twice"]
    totals = {
        "tokens": tokens, "vocabulary": sums["vocabulary"],
        "discount": min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5,
    }
    kept = [
        (bytes(r["w"]), r["n"])
        for r in words.where((F.col("n") >= KNOWN_SHARE * tokens) & (F.octet_length("w") <= KEPT_BYTES)).collect()
    ]
    kept.sort(key=lambda x: (-x[1], x[0]))
    units = Units([w for w, n in kept if w and n >= UNIT_SHARE * tokens])
    # every unit starts in turn, by frequency
    classes = np.concatenate(([0], 1 + np.arange(units.n - 1) % CLASSES)).astype(np.int64)
    k = CLASSES + 1
    pairs = scratch.save(count_pairs(rows, units), "pairs")
    packed = scratch.save(pack_units(pairs), "packed")
    classes, counts = exchange(packed, classes, k)

    sent = words.sparkSession.sparkContext.broadcast((units, classes))

    def by_class(batch):
        units, classes = sent.value
        found = Counter(int(classes[units[w] if w else 0]) for w in batch["w"])
        yield {"c": list(found), "n": list(found.values())}

    distinct = np.zeros(k)
    for r in arrow_rows(words.select("w"), by_class, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n")).collect():
        distinct[r["c"]] = r["n"]
    return Model(units, classes, counts, distinct, kept, totals), words


def score_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    The model learns from texts whose crc32 of the id as text is not 1 modulo 5; a null id counts as an empty one and
    is learnt from. A null or empty text is its end token. Both scores are log10 probabilities; in ``score`` a word
    unseen in training is one event of its class, with the mass that discounting seen words leaves. Repeated rows are
    scored and learnt from as often as they occur; other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "class-lm")
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    key = F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        F.col(id_column).alias("id"), text_bytes(text_column).alias("t"), (F.pmod(key, F.lit(5)) == 1).alias("held_out")
    )
    model, words = learn(rows.where("not held_out"), scratch)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = (
        f"row bigint, id {kind}, held_out boolean, w binary, m bigint, c int, n_tokens bigint, n_known bigint,"
        " base double, score double"
    )
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batch):
        model = sent.value
        cells = [batch[c] for c in ("row", "id", "held_out", "t")]
        for begin, stop in groups_of(cells[3], 1_000_000):
            out = []
            for row, own, held, text in zip(*(c[begin:stop] for c in cells)):
                tokens, known, base, score, rest = model.text(text)
                # a key with a space in front is no word: this row joins nothing
                out.append((row, own, held, b" %d" % row, 0, 0, tokens, known, base, score))
                out.extend((row, None, None, w, m, int(c), 0, 0, 0.0, 0.0) for w, (m, c) in rest.items())
            yield dict(zip(names, zip(*out)))

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "t")
    scored = arrow_rows(numbered, run, fields).join(words.withColumnRenamed("n", "count"), "w", "left")
    parts = scored.select(
        "row", "id", "held_out", "n_tokens", "n_known", "base", "score", F.col("m").cast("int").alias("m"), "c", "count"
    )
    literal = lambda xs: "array(" + ", ".join(f"{float(x)!r}D" for x in xs) + ")"
    emitted = (
        f"if(count is null, {literal(model.log_new)}[c], log10(count - {model.discount!r}D) - {literal(model.log_class)}[c])"
    )
    sums = parts.groupBy("row").agg(
        F.max("id").alias("id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.expr("sum(n_known + if(count is null, 0, m))").alias("n_known"),
        F.expr(f"sum(base + m * (log10(coalesce(count, 0) + 0.5D) - {model.log_all!r}D))").alias("base_score"),
        F.expr(f"sum(score + m * {emitted})").alias("score"),
    )
    return sums.select(
        F.col("id").alias(id_column), "held_out", "n_tokens", "n_known",
        F.lit(int(model.tokens)).cast("bigint").alias("train_tokens"), "base_score", "score",
    )
