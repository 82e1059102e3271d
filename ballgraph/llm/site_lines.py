"""Site-relative line frequency: lines on too large a share of a host's pages are boilerplate.

DataFrame functions only. A line is known by two 64-bit hashes of its bytes; a hot host or line is summed inside tasks
before the shuffle, and texts are rewritten row by row without being shuffled while the boilerplate list is short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballgraph.llm.common import BROADCAST_ROWS
from ballgraph.session import Scratch

#: Share of a host's pages above which a line is boilerplate, and pages it must be on at least.
RATIO = 0.08
MIN_PAGES = 5
#: Parts into which a hot line's rows are dealt when the boilerplate list is too long to broadcast.
SALTS = 16


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def _has_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def boilerplate_lines(
    docs: DataFrame, host: str, text: str, ratio: float, min_pages: int, distinct: bool = True
) -> DataFrame:
    """(h, k, pages, share): lines on more than ``ratio`` of the pages of host ``h`` and on ``min_pages`` at least.

    With ``distinct``, pages of a host that are equal byte by byte are one page; line keys, not texts, are shuffled.
    """
    if distinct:
        own = docs.select(F.col(host).alias("h"), _key(F.col(text)).alias("page"), F.col(text).alias("t"))
        keys = F.transform(F.filter(F.array_distinct(F.split("t", "\n")), _has_word), _key)
        lines = own.groupBy("h", "page").agg(F.first(keys).alias("keys")).select("h", F.explode("keys").alias("k"))
        pages = own.select("h", "page").distinct()
    else:
        rows = docs.select(F.col(host).alias("h"), F.split(F.col(text), "\n").alias("lines"))
        lines = rows.select("h", F.explode(F.array_distinct("lines")).alias("line")).where(
            _has_word(F.col("line"))
        ).select("h", _key(F.col("line")).alias("k"))
        pages = docs.select(F.col(host).alias("h"))
    found = lines.groupBy("h", "k").agg(F.count("*").alias("pages"))
    totals = pages.groupBy("h").agg(F.count("*").alias("total"))
    found = found.where(F.col("pages") >= min_pages).alias("f").join(
        totals.alias("t"), F.col("f.h").eqNullSafe(F.col("t.h"))
    )
    return found.where(F.col("pages") > ratio * F.col("total")).select(
        "f.h", "k", "pages", (F.col("pages") / F.col("total")).alias("share")
    )


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    counts: bool = False, broadcast_rows: int = BROADCAST_ROWS, distinct: bool = True,
) -> DataFrame:
    """The documents without their host's boilerplate lines; all columns and rows stay.

    A page counts once for a line it repeats. Lines are the parts between line feeds; lines without a word are never
    boilerplate. A null host is a host of its own, a null text stays null and counts as a page, and an empty table
    stays empty. ``counts`` adds ``n_lines`` and ``n_dropped``, replacing
    columns of that name. With more than ``broadcast_rows`` boilerplate lines, lines are joined in salted parts.
    Equal texts of a host count as one page, in a line's pages and in the host's, so a page does not lose its text to its
    own copies; without ``distinct`` every row is a page, and one that many copies hold can be emptied. A text is split and
    hashed in its row, so a very long one costs memory for its lines once.
    """
    scratch = Scratch(docs.sparkSession, "site-lines")
    bad = scratch.save(boilerplate_lines(docs, host, text, ratio, min_pages, distinct).select("h", "k"), "bad")
    columns = docs.columns
    if bad.count() <= broadcast_rows:
        lists = bad.groupBy(F.col("h").alias("_bg_h")).agg(F.collect_list("k").alias("_bg_bad"))
        out = docs.join(F.broadcast(lists), F.col(host).eqNullSafe(F.col("_bg_h")), "left").withColumn(
            "_bg_lines", F.split(F.col(text), "\n")
        )
        out = out.withColumn(
            "_bg_kept",
            F.when(F.col("_bg_bad").isNull(), F.col("_bg_lines")).otherwise(
                F.filter("_bg_lines", lambda x: ~(F.array_contains(F.col("_bg_bad"), _key(x)) & _has_word(x)))
            ),
        ).withColumn("_bg_text", F.array_join("_bg_kept", "\n")).select(
            *[F.col("_bg_text").alias(c) if c == text else F.col(c) for c in columns],
            F.greatest(F.size("_bg_lines"), F.lit(0)).cast("bigint").alias("_bg_n"),
            F.coalesce(F.size("_bg_lines") - F.size("_bg_kept"), F.lit(0)).cast("bigint").alias("_bg_d"),
        )
    else:
        rows = docs.select(
            F.monotonically_increasing_id().alias("_bg_row"), F.col(host).alias("_bg_h"),
            F.struct(*columns).alias("_bg_doc"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("_bg_lines"),
        )
        lines = rows.select(
            "_bg_row", "_bg_h", F.posexplode("_bg_lines").alias("pos", "line"),
            "_bg_doc",
        ).select(
            "_bg_row", "_bg_h", "pos", "line", F.when(F.col("pos") == 0, F.col("_bg_doc")).alias("doc"),
            F.when(_has_word(F.col("line")), _key(F.col("line"))).alias("k"),
            F.pmod(F.xxhash64("_bg_row", "pos"), F.lit(SALTS)).alias("salt"),
        )
        salted = bad.select(
            F.col("h").alias("bad_h"), F.col("k").alias("bad_k"),
            F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("bad_salt"),
        )
        joined = lines.join(
            salted,
            (F.col("k") == F.col("bad_k")) & (F.col("salt") == F.col("bad_salt"))
            & F.col("_bg_h").eqNullSafe(F.col("bad_h")), "left",
        )
        whole = joined.groupBy("_bg_row").agg(
            F.max_by("doc", F.col("doc").isNotNull()).alias("doc"), F.count("*").alias("n"),
            F.count("bad_k").alias("d"),
            F.sort_array(F.collect_list(F.when(F.col("bad_k").isNull(), F.struct("pos", "line")))).alias("kept"),
        )
        new = F.when(
            F.col(f"doc.{text}").isNotNull(), F.array_join(F.transform("kept", lambda x: x["line"]), "\n")
        )
        out = whole.select(
            *[new.alias(c) if c == text else F.col("doc")[c].alias(c) for c in columns],
            F.when(F.col(f"doc.{text}").isNull(), F.lit(0)).otherwise(F.col("n")).cast("bigint").alias("_bg_n"),
            F.col("d").alias("_bg_d"),
        )
    if not counts:
        return out.select(*columns)
    others = [c for c in columns if c not in ("n_lines", "n_dropped")]
    return out.select(*others, F.col("_bg_n").alias("n_lines"), F.col("_bg_d").alias("n_dropped"))
