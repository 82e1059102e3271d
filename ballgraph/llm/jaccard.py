"""Exact n-gram Jaccard join of whole texts by size-banded tiles and bitmap signatures.

Equal shingle sets are one class. Three exact bounds keep unrelated classes apart before sets are compared:

1. Of the shingles below a hash threshold, a class that links must share all but a fifth of its set with others.
2. Classes that link share a shingle of their prefixes, in one global order with rare shingles first. Members of a
   shingle's list, ordered by size, are chained where sizes allow a link: the connected groups hold all links.
3. In a group, tiles of one size band meet tiles of near bands. Bits set in one bitmap only prove missing shingles; the
   bound from them decides whether the sorted arrays are intersected.

Nothing is expanded into pairs: a tile returns link counts and a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.llm.common import (
    BROADCAST_ROWS, arrow_rows, broadcast_if_small, components, groups_of, laid_out, mix, text_bytes, word_hashes,
)
from ballgraph.session import Scratch

SHINGLE = 5
#: Texts hashed together, and hashes that one bucket's task sorts.
STEP_BYTES = 2_000_000
DEAL_BYTES = 8_000_000
BUCKET_HASHES = 2_000_000
#: Share of the hash space counted by the first bound. More of it rules out more classes, and moves more hashes.
SAMPLED = 0.3
#: Fingerprints of sets that a task remembers, so that copies are dealt out once.
SEEN = 1_000_000
#: Cells of the sketch that orders shingles by frequency; any order is right, a better one makes smaller groups.
CELLS = 1 << 20
#: Bits of a signature.
SIGNATURE = 1024
#: A tile's sets and shingles; groups up to one tile are compared in one piece.
TILE_SETS = 1024
TILE_SHINGLES = 600_000

_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_BELOW = np.uint64(int(SAMPLED * 2**64))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; fewer words than a shingle are one, no words none."""
    out: list[np.ndarray] = []
    for begin, stop in groups_of(texts, STEP_BYTES):
        data, cuts = laid_out(texts[begin:stop])
        words, first = word_hashes(data, cuts)
        spread = sum((words[k:len(words) - SHINGLE + 1 + k] * _STEPS[k] for k in range(SHINGLE)), np.uint64(0)) if len(words) >= SHINGLE else words[:0]
        every = mix(spread) if len(words) >= SHINGLE else words[:0]
        for a, b in zip(first[:-1], first[1:]):
            n = b - a
            if n >= SHINGLE:
                out.append(np.unique(every[a:b - SHINGLE + 1]))
            elif n:
                out.append(mix((words[a:b] * _STEPS[:n]).sum(keepdims=True) + np.uint64(n)))
            else:
                out.append(words[:0])
    return out


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    both = mix(s ^ np.uint64(0x5851F42D4C957F2D))
    return int(np.add.reduce(s).view(np.int64)), int(np.add.reduce(both).view(np.int64))


def set_rows(docs: DataFrame, text_column: str) -> DataFrame:
    """(row, id, n, f1, f2, low): size, fingerprint and sampled shingles of every row's set."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batch):
        sets = shingle_sets(batch["t"])
        prints = [_fingerprint(s) for s in sets]
        yield {
            "row": batch["row"], "id": batch["id"], "n": [len(s) for s in sets],
            "f1": [p[0] for p in prints], "f2": [p[1] for p in prints],
            "low": [int(np.searchsorted(s, _BELOW)) for s in sets],
        }

    return arrow_rows(
        docs.select("row", "id", text_bytes(text_column).alias("t")), run,
        f"row bigint, id {kind}, n bigint, f1 bigint, f2 bigint, low bigint",
    )


def _dealt(keys: np.ndarray, buckets: int, *columns: np.ndarray):
    """Rows of (bucket, packed columns...), dealt by the low bits of the keys."""
    bucket = (keys % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cuts))
    packed = [[c[order[cuts[b]:cuts[b + 1]]].tobytes() for b in used] for c in (keys, *columns)]
    return [used.tolist(), *packed]


def _unpacked(table, *kinds):
    return [
        np.concatenate([np.frombuffer(x, kind) for x in table.column(n).to_pylist()])
        for n, kind in enumerate(kinds, 1)
    ]


def _in_steps(column: pa.Array):
    """The texts of a batch in lists of about ``DEAL_BYTES``."""
    texts = column.to_pylist()
    for begin, stop in groups_of(texts, DEAL_BYTES):
        yield texts[begin:stop]


def shared_counts(docs: DataFrame, text_column: str, buckets: int) -> DataFrame:
    """(f1, shared): of a set's sampled shingles, how many are in another set too."""

    def deal(batches):
        seen: set[tuple[int, int]] = set()
        texts = (t for batch in batches for t in _in_steps(batch.column(0)))
        for some in texts:
            low, prints = [], []
            for s in shingle_sets(some):
                own = _fingerprint(s)
                if own not in seen and len(s):
                    if len(seen) < SEEN:
                        seen.add(own)
                    low.append(s[: np.searchsorted(s, _BELOW)])
                    prints.append(own[0])
            if low:
                owners = np.repeat(np.array(prints, np.int64), [len(x) for x in low])
                kinds = [pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(_dealt(np.concatenate(low), buckets, owners), kinds)],
                    names=["bucket", "keys", "prints"],
                )

    def count(table: pa.Table) -> pa.Table:
        keys, prints = _unpacked(table, np.uint64, np.int64)
        order = np.lexsort((prints, keys))
        keys, prints = keys[order], prints[order]
        fresh = np.append(True, (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1]))  # copies count once
        keys, prints = keys[fresh], prints[fresh]
        same = keys[1:] == keys[:-1]
        shared = np.append(same, False) | np.append(False, same)
        own, n = np.unique(prints[shared], return_counts=True)
        return pa.table({"f1": own, "n": n.astype(np.int64)})

    dealt = docs.select(text_bytes(text_column).alias("t")).mapInArrow(deal, "bucket int, keys binary, prints binary")
    return dealt.groupBy("bucket").applyInArrow(count, "f1 bigint, n bigint").groupBy("f1").agg(F.sum("n").alias("shared"))


def frequency_sketch(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall in each cell. Tasks add up their own cells; 256 rows come back."""
    width = CELLS // 256

    def run(batches):
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for s in batch.column("s").to_pylist():
                cells += np.bincount((np.frombuffer(s, np.uint64) >> np.uint64(20)).astype(np.int64) & (CELLS - 1), minlength=CELLS) if len(s) > 8 * CELLS else 0
                if len(s) <= 8 * CELLS:
                    np.add.at(cells, (np.frombuffer(s, np.uint64) >> np.uint64(20)).astype(np.int64) & (CELLS - 1), 1)
        parts = [(n, cells[n * width:(n + 1) * width]) for n in range(256)]
        parts = [(n, x.tobytes()) for n, x in parts if x.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["part", "cells"]
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("cells").to_pylist())
        return pa.table({"part": table.column("part")[:1], "cells": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(CELLS, np.int64)
    rows = sets.select("s").mapInArrow(run, "part int, cells binary")
    for r in rows.groupBy("part").applyInArrow(add, "part int, cells binary").collect():
        out[r["part"] * width:(r["part"] + 1) * width] = np.frombuffer(r["cells"], np.int64)
    return out


def prefix_edges(sets: DataFrame, cells: np.ndarray, buckets: int) -> DataFrame:
    """(a, b): runs of classes that share a prefix shingle, by size, tied to their first.

    A run ends where the next size allows no link, so two that can link are in one run.
    """
    sent = sets.sparkSession.sparkContext.broadcast(np.minimum(cells, 2**31 - 1).astype(np.int32))

    def deal(batch):
        keys, owners, sizes = [], [], []
        for own, s in zip(batch["cls"], batch["s"]):
            s = np.frombuffer(s, np.uint64)
            length = len(s) - (4 * len(s) + 4) // 5 + 1
            rank = sent.value[(s >> np.uint64(20)).astype(np.int64) & (CELLS - 1)]
            prefix = s[np.lexsort((s, rank))[:length]]
            keys.append(prefix)
            owners.append(np.full(length, own, np.int64))
            sizes.append(np.full(length, len(s), np.int64))
        if keys:
            rows = _dealt(np.concatenate(keys), buckets, np.concatenate(owners), np.concatenate(sizes))
            yield dict(zip(("bucket", "keys", "owners", "sizes"), rows))

    def tie(table: pa.Table) -> pa.Table:
        keys, owners, sizes = _unpacked(table, np.uint64, np.int64, np.int64)
        order = np.lexsort((owners, sizes, keys))
        keys, owners, sizes = keys[order], owners[order], sizes[order]
        near = np.append(False, (keys[1:] == keys[:-1]) & (5 * sizes[:-1] >= 4 * sizes[1:]))
        a, b = owners[np.maximum.accumulate(np.where(near, 0, np.arange(len(near))))][near], owners[near]
        if len(a):
            a, b = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0).T
        return pa.table({"a": a, "b": b})

    dealt = arrow_rows(sets.select("cls", "s"), deal, "bucket int, keys binary, owners binary, sizes binary")
    return dealt.groupBy("bucket").applyInArrow(tie, "a bigint, b bigint").distinct()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    bits = np.zeros((len(sets), SIGNATURE), np.uint8)
    for n, s in enumerate(sets):
        bits[n, (s % np.uint64(SIGNATURE)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def compare(owners: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], split: int) -> tuple[np.ndarray, list]:
    """(linked documents per set, forest edges) among the sets before ``split`` and those from there on.

    With ``split`` 0, all sets are compared with each other.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    marks = signatures(sets)
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    present = np.zeros(int(place.max()) + 1 if len(place) else 1, np.int32)
    links, label, edges = np.zeros(n, np.int64), np.arange(n), []
    for a in range(split or n):
        first = split or a + 1
        if first >= n:
            continue
        other = slice(first, n)
        need = (4 * (sizes[a] + sizes[other]) + 8) // 9
        most = np.minimum(
            sizes[a] - np.bitwise_count(marks[a] & ~marks[other]).sum(1, dtype=np.int64),
            sizes[other] - np.bitwise_count(marks[other] & ~marks[a]).sum(1, dtype=np.int64),
        )
        maybe = first + np.flatnonzero(most >= need)
        if not len(maybe):
            continue
        own = place[begins[a]:ends[a]]
        present[own] = 1
        if len(maybe) * 4 >= n - first:
            both = np.add.reduceat(present[place[begins[first]:]], begins[first:] - begins[first])[maybe - first]
        else:
            both = np.array([present[place[begins[b]:ends[b]]].sum() for b in maybe], np.int64)
        present[own] = 0
        hit = maybe[both >= need[maybe - first]]
        if not len(hit):
            continue
        links[a] += copies[hit].sum()
        links[hit] += copies[a]
        for b in hit[label[hit] != label[a]]:
            if label[b] != label[a]:
                edges.append((int(owners[a]), int(owners[b])))
                low, high = sorted((label[a], label[b]))
                label[label == high] = low
    return links, edges


def _found(owners: np.ndarray, links: np.ndarray, edges: list) -> dict:
    linked = np.flatnonzero(links)
    return {
        "a": [int(x) for x in owners[linked]] + [e[0] for e in edges],
        "b": [None] * len(linked) + [e[1] for e in edges],
        "links": [int(x) for x in links[linked]] + [0] * len(edges),
    }


_FOUND = "a bigint, b bigint, links bigint"
_FOUND_TYPES = {"a": pa.int64(), "b": pa.int64(), "links": pa.int64()}


def _small_groups(rows: DataFrame) -> DataFrame:
    """Links of groups that fit a tile; rows (root, cls, n, copies, s) stream by group."""

    def run(batches):
        now, held = None, []

        def flush():
            owners = np.array([h[0] for h in held], np.int64)
            out = _found(owners, *compare(owners, np.array([h[1] for h in held], np.int64), [h[2] for h in held], 0))
            return pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in _FOUND_TYPES.items()], names=list(out))

        for batch in batches:
            for root, own, copies, s in zip(*(batch.column(c).to_pylist() for c in ("root", "cls", "copies", "s"))):
                if root != now:
                    if len(held) > 1:
                        yield flush()
                    now, held = root, []
                if held and held[-1][0] == own:
                    continue
                held.append((own, copies, np.frombuffer(s, np.uint64)))
        if len(held) > 1:
            yield flush()

    return rows.repartition("root").sortWithinPartitions("root", "n", "cls").mapInArrow(run, _FOUND)


def _tiled_groups(rows: DataFrame) -> DataFrame:
    """Links of larger groups: tiles of a size band against tiles of the bands that a link can reach."""
    banded = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) * 2).cast("int"))
    bands = banded.groupBy("root", "band").agg(
        F.ceil(F.greatest(F.count("*") / TILE_SETS, F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles")
    )
    tiles = bands.select("root", "band", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    x, y = tiles.alias("x"), tiles.alias("y")
    # sizes a link allows differ by a factor of 1.25, two bands; one more absorbs rounding at a band's edge
    near = (F.col("x.root") == F.col("y.root")) & (
        ((F.col("x.band") == F.col("y.band")) & (F.col("x.tile") <= F.col("y.tile")))
        | ((F.col("x.band") < F.col("y.band")) & (F.col("y.band") <= F.col("x.band") + 3))
    )
    pairs = x.join(y, near).select(
        F.col("x.root").alias("root"), F.struct("x.band", "x.tile").alias("left"), F.struct("y.band", "y.tile").alias("right"),
    ).withColumn("pair", F.struct("root", "left", "right"))
    sides = pairs.select("pair", "root", F.col("left").alias("place"), F.lit(0).alias("side")).union(
        pairs.where("left <> right").select("pair", "root", F.col("right").alias("place"), F.lit(1).alias("side"))
    )
    placed = banded.join(bands, ["root", "band"]).select(
        "root", "cls", "n", "copies", "s",
        F.struct("band", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int").alias("tile")).alias("place"),
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("n", "ascending"), ("cls", "ascending")])
        owners = table.column("cls").to_numpy()  # a class has one tile, so a repeat follows its like
        table = table.filter(pa.array(np.append(True, owners[1:] != owners[:-1])))
        owners, copies = table.column("cls").to_numpy(), table.column("copies").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("s").to_pylist()]
        split, pair = int((table.column("side").to_numpy() == 0).sum()), table.column("pair")[0].as_py()
        if pair["left"] == pair["right"]:
            split = 0
        elif split in (0, len(sets)):  # the other tile got no set
            return pa.table({c: pa.array([], t) for c, t in _FOUND_TYPES.items()})
        out = _found(owners, *compare(owners, copies, sets, split))
        return pa.table({c: pa.array(out[c], t) for c, t in _FOUND_TYPES.items()})

    return placed.join(sides, ["root", "place"]).select("pair", "side", "cls", "n", "copies", "s").groupBy("pair").applyInArrow(run, _FOUND)


def join_rows(docs: DataFrame, text_column: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(row, id, n_shingles, component_id, n_links) for docs (row, id, text). ``row`` numbers the rows once read."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = scratch.save(set_rows(docs, text_column), "rows")
    classes = scratch.save(
        rows.where("n > 0").groupBy("f1", "f2").agg(
            F.min("id").alias("least"), F.count("*").alias("copies"),
            F.first("n").alias("n"), F.first("low").alias("low"),
        ).withColumn("cls", F.monotonically_increasing_id()), "classes",
    )
    total = rows.agg(F.sum("low")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_HASHES))

    shared = shared_counts(docs, text_column, buckets)
    able = scratch.save(
        classes.join(shared, "f1", "left").where("coalesce(shared, 0) >= low - floor(n / 5)").select(
            "f1", "f2", "cls", "least", "copies"
        ), "able",
    )
    n_able = able.count()

    def sets(batch):
        own = shingle_sets(batch["t"])
        prints = [_fingerprint(s) for s in own]
        yield {"f1": [p[0] for p in prints], "f2": [p[1] for p in prints], "n": [len(s) for s in own], "s": [s.tobytes() for s in own]}

    # by id, which the data hold; rows that share a class's id and set are taken once when sets are compared
    wanted = broadcast_if_small(able.select("least"), n_able, broadcast_rows)
    read = arrow_rows(
        docs.join(wanted, docs["id"].eqNullSafe(wanted["least"]), "left_semi").select(text_bytes(text_column).alias("t")),
        sets, "f1 bigint, f2 bigint, n bigint, s binary",
    )
    held = scratch.save(
        read.join(broadcast_if_small(able.drop("least"), n_able, broadcast_rows), ["f1", "f2"]).select("cls", "n", "copies", "s"),
        "sets",
    )
    edges = prefix_edges(held, frequency_sketch(held), buckets)
    roots = components(spark, edges, scratch, "groups")
    grouped = scratch.save(held.join(roots.withColumnRenamed("node", "cls"), "cls"), "grouped")
    sizes = grouped.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    large = scratch.save(sizes.where(f"sets > {TILE_SETS} or shingles > {TILE_SHINGLES}").select("root"), "large")
    few = broadcast_if_small(large, large.count(), broadcast_rows)
    found = scratch.save(
        _small_groups(grouped.join(few, "root", "left_anti")).union(_tiled_groups(grouped.join(few, "root", "left_semi"))),
        "found",
    )
    joined = components(spark, found.where("b is not null").select("a", "b"), scratch, "links")
    least = joined.join(classes.select(F.col("cls").alias("node"), "least"), "node")
    ids = least.join(least.groupBy("root").agg(F.min("least").alias("id")), "root").select(F.col("node").alias("cls"), "id")
    links = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    told = classes.join(ids, "cls", "left").join(links, "cls", "left").select(
        "f1", "f2", F.coalesce("id", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    ).where("n_links > 0")
    told = scratch.save(told, "told")
    out = rows.join(broadcast_if_small(told, told.count(), broadcast_rows), ["f1", "f2"], "left")
    linked = F.col("n_links").isNotNull() & (F.col("n") > 0)
    return out.select(
        "row", "id", F.col("n").alias("n_shingles"),
        F.when(linked, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("bigint").alias("n_links"),
    )


def jaccard_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_links): every document's set size, class and number of linked documents.

    Words are split at white space with A-Z lower-cased; a set holds the distinct 5-word shingles, fewer words are
    one shingle, and null texts and those without words are empty and linked with nothing. Two documents link at a
    Jaccard similarity of 0.8 or more; ``component_id`` is the smallest id reachable. Repeated rows are documents
    that link. Null ids are never the smallest while another id is there. Other columns are ignored; an empty table
    gives no rows. Shingles are compared by 64-bit hashes.
    """
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text_column).alias("text")
    )
    return join_rows(numbered).select(F.col("id").alias(id_column), "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without all but one of each group of linked ones: the first row of the smallest id stays.

    Ties between rows of one id are broken by the row's place in the numbered copy that is written first, so the result
    does not depend on how ``docs`` is split when it is read again. Nulls, empty texts, repeated rows and empty tables are
    treated as in ``jaccard_join``; all columns are kept, and any name but ``_bg_row`` may be one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard-keep")
    numbered = scratch.save(docs.withColumn("_bg_row", F.monotonically_increasing_id()), "numbered")
    own = numbered.select(F.col("_bg_row").alias("row"), F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = scratch.save(join_rows(own), "rows").where("n_links > 0")
    first = rows.where("id <=> component_id").groupBy("component_id").agg(F.min("row").alias("row"))
    gone = scratch.save(rows.join(first.select("row"), "row", "left_anti").select(F.col("row").alias("_bg_row")), "gone")
    return numbered.join(broadcast_if_small(gone, gone.count()), "_bg_row", "left_anti").select(*docs.columns)
