"""Merkle manifest of a dataset by bitmap ranks.

Every row becomes a digest. Per group, compressed bitmaps of the ids, made by the tasks and merged bucket by bucket, with
directories of their popcounts answer rank queries: a rank is the leaf's coordinate, without sorting the rows. Nodes then
go to slot arrays keyed by (group, coordinate / slots); an array reduces its levels by index, and only its top node goes
on. Groups' roots are reduced likewise. Proofs are read from the same arrays on the way back down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballgraph.session import Scratch

#: Ids of one bitmap, and of one 64-bit word of it.
BUCKET_BITS = 12
#: Nodes of a slot array.
SLOT_BITS = 10
#: Bitmaps with fewer ids are kept as 16-bit offsets.
SPARSE = (1 << BUCKET_BITS) // 16
#: Ids that a task gathers before it writes bitmaps.
GATHER = 2_000_000
#: Buckets below one entry of the upper directory.
SUPER_BITS = 10

LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, leaf, forged): a row's digest, and the digest of its forged copy if it is one of the probed rows.

    ``grp`` is '0' for a null language and '1' before any other, so that byte order puts null first.
    """
    def digest(n_chars: Column) -> Column:
        cells = [n_chars if c == "n_chars" else F.col(c) for c in LEAF_COLUMNS]
        return F.unhex(F.sha2(F.concat(*map(_field, cells)).cast("binary"), 256))

    probed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0")).alias("grp"),
        F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("n_chars")).alias("leaf"),
        F.when(probed, digest(F.col("n_chars").cast("decimal(20,0)") + 1)).alias("forged"),
    )


# --- compressed bitmaps -----------------------------------------------------------------------------------------------


def pack_bitmap(offsets: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """(bitmap, repeats) of sorted distinct offsets; repeats are (offset, further rows) of offsets with several rows."""
    if len(offsets) < SPARSE:
        body = b"\0" + offsets.astype(np.uint16).tobytes()
    else:
        bits = np.zeros(1 << BUCKET_BITS, np.uint8)
        bits[offsets] = 1
        body = b"\1" + np.packbits(bits, bitorder="little").tobytes()
    more = counts > 1
    return body, np.stack([offsets[more], counts[more] - 1]).astype(np.int64).tobytes()


def unpack_bitmap(body: bytes, repeats: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bits, rows) over all offsets of a bucket: whether an id is there, and in how many rows."""
    if body[:1] == b"\0":
        bits = np.zeros(1 << BUCKET_BITS, np.int64)
        bits[np.frombuffer(body, np.uint16, offset=1)] = 1
    else:
        bits = np.unpackbits(np.frombuffer(body, np.uint8, offset=1), bitorder="little").astype(np.int64)
    rows = bits.copy()
    if repeats:
        at, n = np.frombuffer(repeats, np.int64).reshape(2, -1)
        rows[at] += n
    return bits, rows


def _split(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids >> BUCKET_BITS, ids & ((1 << BUCKET_BITS) - 1)


def bitmaps(leaves: DataFrame) -> DataFrame:
    """(grp, bucket, body, repeats, n): one compressed bitmap for each bucket of ids that a group has; n counts rows."""

    def packed(grp: str, ids: np.ndarray) -> Iterator[tuple]:
        ids, counts = np.unique(ids, return_counts=True)
        bucket, offset = _split(ids)
        cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
        for a, b in zip(cuts, np.append(cuts[1:], len(ids))):
            yield (grp, int(bucket[a]), *pack_bitmap(offset[a:b], counts[a:b]), int(counts[a:b].sum()))

    def rows(parts: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*parts) if parts else [[]] * 5, kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["grp", "bucket", "body", "repeats", "n"])

    def gather(batches):
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush():
            every = [r for g, ids in held.items() for r in packed(g, np.concatenate(ids))]
            held.clear()
            for at in range(0, len(every), 10_000):
                yield rows(every[at:at + 10_000])

        for batch in batches:
            names = batch.column(0).dictionary_encode()
            ids, codes = batch.column(1).to_numpy(), names.indices.to_numpy()
            for code, name in enumerate(names.dictionary.to_pylist()):
                held.setdefault(name, []).append(ids[codes == code])
            size += len(ids)
            if size >= GATHER:
                yield from flush()
                size = 0
        yield from flush()

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for body, repeats in zip(table.column("body").to_pylist(), table.column("repeats").to_pylist()):
            total += unpack_bitmap(body, repeats)[1]
        at = np.flatnonzero(total)
        body, repeats = pack_bitmap(at, total[at])
        first = (table.column("grp")[0].as_py(), table.column("bucket")[0].as_py())
        return pa.Table.from_batches([rows([(*first, body, repeats, int(total.sum()))])])

    schema = "grp string, bucket bigint, body binary, repeats binary, n bigint"
    own = leaves.where("doc_id IS NOT NULL").select("grp", F.col("doc_id").cast("bigint")).mapInArrow(gather, schema)
    return own.groupBy("grp", "bucket").applyInArrow(merge, schema)


def directory(index: DataFrame, nulls: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The index with ``base``, the rows of the group before each bucket, and (grp, total) of all groups.

    Sums run over buckets within an upper entry, and over upper entries within a group. Rows without an id come first.
    """
    wide = index.withColumn("up", F.shiftright("bucket", SUPER_BITS))
    upper = wide.groupBy("grp", "up").agg(F.sum("n").alias("n")).join(
        nulls.select(F.col("grp").alias("g"), F.col("n").alias("nulls")), F.col("grp") == F.col("g"), "left"
    )
    before = Window.partitionBy("grp").orderBy("up").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("grp", "up").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.select(
        "grp", "up", (F.coalesce(F.sum("n").over(before), F.lit(0)) + F.coalesce("nulls", F.lit(0))).alias("above")
    )
    wide = wide.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(upper, ["grp", "up"])
    found = scratch.save(wide.select("grp", "bucket", "body", "repeats", (F.col("above") + F.col("within")).alias("base")), "index")
    sizes = index.select("grp", "n").union(nulls.select("grp", "n")).groupBy("grp").agg(F.sum("n").alias("total"))
    return found, sizes


def ranks(ids: DataFrame, index: DataFrame) -> DataFrame:
    """(grp, doc_id, coord, many) for distinct (grp, doc_id): rows of the group before an id's first row, and its rows."""

    def look_up(key, rows: pa.Table, found: pa.Table) -> pa.Table:
        doc = rows.column("doc_id").to_numpy()
        first = found.slice(0, 1).to_pylist()[0]
        _, n = unpack_bitmap(first["body"], first["repeats"])
        before = np.cumsum(n) - n
        at = _split(doc)[1]
        return rows.select(["grp", "doc_id"]).append_column("coord", pa.array(first["base"] + before[at])).append_column(
            "many", pa.array(n[at])
        ).append_column("leaf", rows.column("leaf")).append_column("forged", rows.column("forged"))

    keyed = ids.withColumn("bucket", F.shiftright("doc_id", BUCKET_BITS))
    return keyed.groupBy("grp", "bucket").cogroup(index.groupBy("grp", "bucket")).applyInArrow(
        look_up, "grp string, doc_id bigint, coord bigint, many bigint, leaf binary, forged binary"
    )


def repeated_rows(leaves: DataFrame, starts: DataFrame) -> DataFrame:
    """(grp, doc_id, coord, leaf, forged) of rows that share their id with others or have none, in order of their digests.

    Equal rows are counted, the rest is counted by the first 16 bits of the digests, so an id that a third of all rows
    have is ordered by many tasks. ``starts`` has (grp, doc_id, coord): the coordinate of an id's first row.
    """
    same = leaves.groupBy("grp", "doc_id", "leaf", "forged").agg(F.count("*").alias("m")).withColumn(
        "head", F.hex(F.substring("leaf", 1, 2))
    )
    heads = same.groupBy("grp", "doc_id", "head").agg(F.sum("m").alias("n"))
    before = Window.partitionBy("grp", "doc_id").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("above", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    renamed = lambda df, *names: df.select(*[F.col(c).alias(f"_{c}") for c in names], *[c for c in df.columns if c not in names])
    id_is = F.col("grp").eqNullSafe(F.col("_grp")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    heads = renamed(heads, "grp", "doc_id", "head")
    inside = Window.partitionBy("grp", "doc_id", "head").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    placed = same.withColumn("within", F.coalesce(F.sum("m").over(inside), F.lit(0)))
    placed = placed.join(heads, id_is & (F.col("head") == F.col("_head"))).drop("_grp", "_doc_id", "_head")
    placed = placed.join(renamed(starts, "grp", "doc_id"), id_is).drop("_grp", "_doc_id")
    first = F.col("coord") + F.col("above") + F.col("within")
    chunk = 1 << 16  # many equal rows come out in two steps, so that no array holds them all
    return placed.select(
        "grp", "doc_id", "leaf", "forged", "m", first.alias("first"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / chunk))).alias("c"),
    ).select(
        "grp", "doc_id", "leaf", "forged",
        F.explode(F.sequence(F.col("first") + F.col("c") * chunk, F.col("first") + F.least(F.col("m"), (F.col("c") + 1) * chunk) - 1)).alias("coord"),
    ).select("grp", "doc_id", "coord", "leaf", "forged")


def coordinates(leaves: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Written (grp, doc_id, coord, leaf, forged), coord gapless from 0 per group, and (grp, total)."""
    nulls = leaves.where("doc_id IS NULL").groupBy("grp").agg(F.count("*").alias("n"))
    index, sizes = directory(scratch.save(bitmaps(leaves), "bitmaps"), scratch.save(nulls, "nulls"), scratch)
    sizes = scratch.save(sizes, "sizes")
    listed = index.where(F.length("repeats") > 0).select("grp", F.col("bucket").alias("b"), "repeats")

    def offsets(batches):
        for batch in batches:
            for g, b, packed in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.frombuffer(packed, np.int64).reshape(2, -1)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * len(at), pa.string()), pa.array((b << BUCKET_BITS) + at)], names=["_grp", "_doc_id"]
                )

    repeated = scratch.save(listed.mapInArrow(offsets, "_grp string, _doc_id bigint"), "repeated")
    n_repeated, n_nulls = repeated.count(), scratch.spark.read.parquet(scratch.path("nulls")).count()
    if not n_repeated and not n_nulls:  # ids are unique, as they should be
        placed = ranks(leaves, index).drop("many")
        return scratch.save(placed.select("grp", "doc_id", "coord", "leaf", "forged"), "placed"), sizes
    is_it = (F.col("grp") == F.col("_grp")) & (F.col("doc_id") == F.col("_doc_id"))
    single = leaves.where("doc_id IS NOT NULL").join(repeated, is_it, "left_anti")
    starts = ranks(repeated.select(
        F.col("_grp").alias("grp"), F.col("_doc_id").alias("doc_id"), F.lit(None).cast("binary").alias("leaf"),
        F.lit(None).cast("binary").alias("forged"),
    ), index).select("grp", "doc_id", "coord")
    empty = scratch.spark.read.parquet(scratch.path("nulls")).select(
        "grp", F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("coord")
    )
    several = leaves.join(repeated, is_it, "left_semi").union(leaves.where("doc_id IS NULL"))
    rest = repeated_rows(several, scratch.save(starts.union(empty), "starts"))
    placed = ranks(single, index).select("grp", "doc_id", "coord", "leaf", "forged").union(rest)
    return scratch.save(placed, "placed"), sizes


# --- slot arrays ------------------------------------------------------------------------------------------------------


def _hash(*digests: bytes) -> bytes:
    """SHA-256 of the digests' hexadecimal text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def reduce_slots(slots: list[bytes], total: int) -> list[list[bytes]]:
    """The levels of one slot array, of a tree level with ``total`` nodes; the last has the array's top node."""
    levels = [slots]
    for _ in range(SLOT_BITS):
        if total == 1:
            break
        now = levels[-1]
        levels.append([_hash(*now[i:i + 2]) for i in range(0, len(now), 2)])
        total = (total + 1) // 2
    return levels


def sibling_path(levels: list[list[bytes]], at: int) -> bytes:
    """33 bytes a level: 0 for a node alone in its run, 1 or 2 for a sibling on its left or right, and the sibling."""
    out = []
    for level in levels[:-1]:
        if at % 2:
            out.append(b"\1" + level[at - 1])
        elif at + 1 < len(level):
            out.append(b"\2" + level[at + 1])
        else:
            out.append(b"\0" * 33)
        at //= 2
    return b"".join(out)


def fold_path(digest: bytes, path: bytes) -> bytes:
    for i in range(0, len(path), 33):
        side, other = path[i], path[i + 1:i + 33]
        digest = _hash(other, digest) if side == 1 else _hash(digest, other) if side == 2 else _hash(digest)
    return digest


def path_siblings(path: bytes) -> list[bytes]:
    return [path[i + 1:i + 33] for i in range(0, len(path), 33) if path[i]]


def _in_slots(table: pa.Table, column: str) -> tuple[np.ndarray, list[bytes]]:
    """Slots of the rows and the array: each node goes to its place, nothing is sorted."""
    at = table.column("coord").to_numpy() & ((1 << SLOT_BITS) - 1)
    slots: list = [None] * (int(at.max()) + 1)
    for i, digest in zip(at.tolist(), table.column(column).to_pylist()):
        slots[i] = digest
    return at, slots


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("coord", SLOT_BITS))


def reduced(nodes: DataFrame) -> DataFrame:
    """(grp, coord, digest, total): the top nodes of the slot arrays of (grp, coord, digest, total)."""

    def top(table: pa.Table) -> pa.Table:
        total = table.column("total")[0].as_py()
        levels = reduce_slots(_in_slots(table, "digest")[1], total)
        return pa.table({
            "grp": table.column("grp").slice(0, 1), "coord": table.column("block").slice(0, 1),
            "digest": pa.array([levels[-1][0]], pa.binary()),
            "total": pa.array([-(-total // (1 << SLOT_BITS))], pa.int64()),
        })

    return _blocked(nodes).groupBy("grp", "block").applyInArrow(top, "grp string, coord bigint, digest binary, total bigint")


def _along(nodes: DataFrame, paths: DataFrame, emit: Callable, schema: str) -> DataFrame:
    """``emit(rows, levels, slots of the rows, path of the array's top node)`` for each slot array."""

    def run(key, rows: pa.Table, above: pa.Table) -> pa.Table:
        at, slots = _in_slots(rows, "digest")
        levels = reduce_slots(slots, rows.column("total")[0].as_py())
        return emit(rows, levels, at, above)

    above = paths.withColumnRenamed("coord", "block")
    return _blocked(nodes).groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(run, schema)


def tree(nodes: DataFrame, scratch: Scratch, label: str) -> tuple[list[DataFrame], DataFrame]:
    """All written levels of slot arrays above (grp, coord, digest, total), and the groups' top nodes (grp, digest)."""
    levels = [nodes]
    while levels[-1].where("total > 1").limit(1).count():
        levels.append(scratch.save(reduced(levels[-1]), f"{label}-{len(levels)}"))
    return levels, levels[-1].select("grp", "digest")


def paths_down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(grp, coord, path, subroot) of the lowest level, from (grp, coord, path, subroot) of the top nodes."""

    def emit(rows, arrays, at, above):
        top = above.slice(0, 1).to_pylist()[0]
        return pa.table({
            "grp": rows.column("grp"), "coord": rows.column("coord"),
            "path": pa.array([sibling_path(arrays, i) + top["path"] for i in at.tolist()], pa.binary()),
            "subroot": pa.array([top["subroot"]] * len(at), pa.binary()),
        })

    now = tops
    for nodes in reversed(levels[:-1]):
        now = _along(nodes, now, emit, "grp string, coord bigint, path binary, subroot binary")
    return now


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, coord, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A row's digest covers its id, source, language, length and text; nulls have a digest of their own. In a language rows
    ascend by id, null ids first; rows that share an id ascend by digest, and equal rows count as often as they occur. Very
    long texts are hashed by the JVM and do not move. An empty table gives no rows. Other columns are ignored.
    Rows whose id's checksum is divisible by 7 are forged: they are proved with the digest of a changed length.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "manifest")
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    leaves = scratch.save(leaf_rows(docs), "leaves")
    placed, sizes = coordinates(leaves, scratch)
    named = sizes.select(F.col("grp").alias("_grp"), "total")
    nodes = placed.withColumnRenamed("leaf", "digest").join(named, F.col("grp") == F.col("_grp")).drop("_grp")
    levels, subroots = tree(nodes.select("grp", "coord", "digest", "total"), scratch, "level")

    # the groups in byte order: a range sort, numbered by what the tasks before a task hold
    ordered = scratch.save(
        subroots.repartitionByRange("grp").sortWithinPartitions("grp").withColumn("part", F.spark_partition_id())
        .withColumn("nth", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("bigint"), 33)), "groups",
    )
    counts = {r["part"]: r["count"] for r in ordered.groupBy("part").count().collect()}  # a row for each task
    starts, n = [], 0
    for part in range(max(counts, default=-1) + 1):
        starts.append(n)
        n += counts.get(part, 0)
    schema = f"doc_id {kind}, lang string, coord bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if n == 0:
        return spark.createDataFrame([], schema)
    first = F.element_at(F.array(*map(F.lit, starts)), F.col("part") + 1).cast("bigint")
    groups = scratch.save(ordered.select(
        F.lit("").alias("grp"), (first + F.col("nth")).alias("coord"), "digest", F.lit(n).cast("bigint").alias("total"),
        F.col("grp").alias("name"),
    ), "roots")
    group_levels, top = tree(groups.select("grp", "coord", "digest", "total"), scratch, "root")
    root = top.first()["digest"]
    one = F.lit(0).cast("bigint")
    group_paths = paths_down(group_levels, top.select("grp", one.alias("coord"), F.lit(b"").alias("path"), F.lit(b"").alias("subroot")))
    tops = group_paths.select("coord", "path").join(groups.select("coord", "digest", "name"), "coord").select(
        F.col("name").alias("grp"), one.alias("coord"), "path", F.col("digest").alias("subroot")
    )
    above = scratch.save(paths_down(levels[1:], tops) if len(levels) > 1 else tops, "paths")

    def prove(rows, arrays, at, above):
        up = above.slice(0, 1).to_pylist()[0]
        rest, tail = up["path"], path_siblings(up["path"])
        proofs, folded = [], []
        for i, leaf, forged in zip(at.tolist(), rows.column("digest").to_pylist(), rows.column("forged").to_pylist()):
            own = sibling_path(arrays, i)
            proofs.append(_hash(*path_siblings(own), *tail).hex())
            folded.append(fold_path(fold_path(forged or leaf, own), rest))
        n = len(at)
        grp = rows.column("grp")[0].as_py()
        return pa.table({
            "doc_id": rows.column("doc_id"), "lang": pa.array([grp[1:] if grp[0] == "1" else None] * n, pa.string()),
            "coord": rows.column("coord"), "leaf": pa.array([d.hex() for d in rows.column("digest").to_pylist()]),
            "subroot": pa.array([up["subroot"].hex()] * n), "root": pa.array([root.hex()] * n),
            "proof_sha256": pa.array(proofs), "folded_root": pa.array([d.hex() for d in folded]),
            "verified": pa.array([d == root for d in folded]),
        })

    if len(levels) == 1:  # one row in every group
        above = above.withColumn("coord", one)
    return _along(nodes, above, prove, schema.replace(f"doc_id {kind}", "doc_id bigint")).withColumn(
        "doc_id", F.col("doc_id").cast(kind)
    )
