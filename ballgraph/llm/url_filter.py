"""URL verdicts from host/path rules and a Bloom filter cascade.

The first level encodes the listed keys, the next one the unlisted keys of the corpus that pass it, the next one the
listed keys that pass that, and so on until no key of the universe is wrong. Membership of every key of the universe
is then exact and needs no join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballgraph.session import Scratch

#: Bits a key takes in a level, and tests made for it.
BITS_PER_KEY = 12
TESTS = 8
#: Largest list whose cascade is sent to all tasks (about 2 MB for a million keys); a longer one is joined.
BROADCAST_KEYS = 20_000_000
#: Two keys with equal hashes would never be told apart.
MAX_LEVELS = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: up to ``/``, ``?``, ``#`` (A-Z lower-cased), then up to ``?`` or ``#``; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting ``host/path`` rule, or nulls. Ties go to the longer host."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"), r[1]))
    for says, text in ordered:  # the last one asked first
        name, start = text[: text.index("/")], text[text.index("/"):]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_keys(host: Column) -> Column:
    """The host and its parent domains; no keys for an empty host."""
    labels = F.split(host, "\\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        )
    )


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit(1)).alias("b")]


class Level:
    """One Bloom filter as an array of 64-bit words."""

    def __init__(self, n_bits: int, words: np.ndarray):
        self.n_bits, self.words = n_bits, words

    def passes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        first, step = np.mod(a, self.n_bits), np.mod(b, self.n_bits)
        out = np.ones(len(a), bool)
        for i in range(TESTS):
            at = (first + i * step) % self.n_bits
            out &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out

    @classmethod
    def build(cls, keys: DataFrame, n: int, level: int) -> Level:
        """From (a, b) hashes. Bits of a word are merged in tasks; at most one row per word comes back.

        Each level has a size of its own, so keys that look alike in one differ in another.
        """
        n_bits = 64 * (math.ceil(n * BITS_PER_KEY / 64) + 3) - (2 * level + 1)
        at = F.expr(f"explode(transform(sequence(0L, {TESTS - 1}L), i -> (pmod(a, {n_bits}L) + i * pmod(b, {n_bits}L)) % {n_bits}L))")
        rows = keys.select(at.alias("at")).select(
            F.expr("at div 64").alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit")
        )
        found = rows.groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
        words = np.zeros(-(-n_bits // 64), np.uint64)
        words[found["w"].to_numpy("int64")] = found["bits"].to_numpy("int64").view(np.uint64)
        return cls(n_bits, words)


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether keys are listed; exact for every key of the universe."""
        out, open_ = np.zeros(len(a), bool), np.arange(len(a))
        for n, level in enumerate(self.levels):
            passed = level.passes(a[open_], b[open_])
            out[open_] = passed == (n % 2 == 0)  # what a later level does not correct
            open_ = open_[passed]
        return out


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(sent.value.passes(batch.column("a").to_numpy(), batch.column("b").to_numpy())))

    return keys.mapInArrow(run, "a bigint, b bigint")


def build_cascade(listed: DataFrame, universe: DataFrame, scratch: Scratch) -> Cascade:
    """From one-column tables of keys. Listed keys outside the universe are encoded as well."""
    names = [F.col(f.columns[0]).alias("key") for f in (listed, universe)]
    wanted = listed.select(names[0]).where("key is not null").distinct().select(*_hashes(F.col("key")))
    every = universe.select(names[1]).where("key is not null").distinct().select(*_hashes(F.col("key")))
    own = scratch.save(wanted.distinct(), "level-own")
    n = own.count()
    if not n:
        return Cascade([])
    levels = [Level.build(own, n, 0)]
    other = scratch.save(_passing(every, levels[0]).join(own, ["a", "b"], "left_anti"), "level-1")
    while (n := other.count()) > 0:
        if len(levels) == MAX_LEVELS:
            raise ValueError("the cascade does not end: a listed and an unlisted key have equal hashes")
        levels.append(Level.build(other, n, len(levels)))
        own, other = other, scratch.save(_passing(own, levels[-1]), f"level-{len(levels)}")
    return Cascade(levels)


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame | None = None, listed_labels: tuple[str, ...] = (),
    id_column: str = "page_id", url_column: str = "url", broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """(id, host, path, rule, verdict, listed) of every url.

    Without a fitting rule a url is blocked if its host or a parent domain is listed: a key of the one-column table
    ``listed``, or a key of the corpus whose first label is in ``listed_labels``. Null urls and those without ``://``
    have an empty host and path, no keys and no rule, and are allowed. Every row is judged, repeated rows alike; other
    columns are ignored; an empty table gives no rows. A list of more than ``broadcast_keys`` keys is joined instead.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    host, path = host_and_path(F.col(url_column).cast("string"))
    rows = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    hosts = rows.select("host").distinct()
    universe = scratch.save(hosts.select(F.explode(host_keys(F.col("host"))).alias("key")).distinct(), "universe")
    wanted = universe.where(F.substring_index("key", ".", 1).isin(*listed_labels)) if listed_labels else universe.limit(0)
    if listed is not None:
        wanted = wanted.union(listed.select(F.col(listed.columns[0]).alias("key"))).distinct()
    wanted = scratch.save(wanted, "listed")
    if wanted.count() <= broadcast_keys:
        cascade = build_cascade(wanted, universe, scratch)
        sent = spark.sparkContext.broadcast(cascade)

        def run(batches):
            for batch in batches:
                lists = batch.column("a")
                a, b = lists.flatten().to_numpy(), batch.column("b").flatten().to_numpy()
                owner = pa.compute.list_parent_indices(lists).to_numpy()
                hit = np.zeros(len(batch), bool)
                hit[owner[sent.value.listed(a, b)]] = True
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(hit)], names=["id", "host", "path", "listed"]
                )

        import pyarrow.compute  # noqa: F401  the submodule is not loaded by itself

        keyed = rows.withColumn("keys", host_keys(F.col("host"))).select(
            "id", "host", "path", F.transform("keys", lambda k: _hashes(k)[0]).alias("a"),
            F.transform("keys", lambda k: _hashes(k)[1]).alias("b"),
        )
        kind = rows.schema["id"].dataType.simpleString()
        judged = keyed.mapInArrow(run, f"id {kind}, host string, path string, listed boolean")
    else:
        bad = hosts.select("host", F.explode(host_keys(F.col("host"))).alias("key")).join(wanted, "key")
        judged = rows.join(
            bad.select("host", F.lit(True).alias("listed")).distinct(), "host", "left"
        ).withColumn("listed", F.coalesce("listed", F.lit(False)))
    rule, says = rule_columns(F.col("host"), F.col("path"), rules)
    return judged.select(
        F.col("id").alias(id_column), "host", "path", rule.alias("rule"),
        F.coalesce(says, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed",
    )
