"""Quality rules: divergence of a document's histograms from its language's references.

DataFrame functions only. Per document, a histogram over character classes and one over common words are compared by
Jensen-Shannon divergence with those of all documents of the same declared language. Documents shorter than the
minimum length are not judged by their characters; words are judged at every length, against a threshold that widens as
texts get shorter. Counting rules on words, lines and repeats come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.llm.common import SPACE_CLASS, broadcast_if_small
from ballgraph.session import Scratch

#: Frequent words of the languages; each is a bin of the word histogram.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was",
    "der", "die", "und", "den", "von", "zu", "das", "mit",
    "de", "la", "le", "et", "les", "des", "en", "un", "que", "el", "y", "los",
)

#: Character classes counted by pattern; white space and all other characters are two more bins.
CLASSES = ("[^A-Z]+", "[^0-9]+", "[^#*$%&|<>]+", "[^!\"'()+,./:;=?@\\[\\]^_`{}~\\\\-]+")

#: Verdict: divergence in bits above which a document is rejected, and the least length that is judged.
MAX_CHAR_DIVERGENCE = 0.08
MIN_CHARS = 300
MAX_WORD_DIVERGENCE = 0.06
#: Chance is allowed this over the number of words if that is more than MAX_WORD_DIVERGENCE: the divergence of a sample
#: of n words from its source falls as 1 / n.
WORD_NOISE = 9.0

VERDICTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_divergence", "word_divergence",
    "base_failed", "kept",
)

#: Beyond so many repeated windows, a sort by window replaces a search in their list.
SEARCHED = 48


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def histograms(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Adds ``_bg_*`` columns: text, words, lengths and the two histograms."""
    bins = len(COMMON_WORDS)
    words = ", ".join(_quoted(w) for w in COMMON_WORDS)
    kept = [f"char_length(regexp_replace(_bg_t, {_quoted(c)}, ''))" for c in CLASSES]
    out = docs.withColumn("_bg_t", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn(
        "_bg_lang", F.col(lang)
    ).withColumn("_bg_w", F.array_remove(F.split("_bg_t", SPACE_CLASS + "+"), ""))
    out = out.withColumns({
        "_bg_n": F.expr("cast(size(_bg_w) as bigint)"),
        "_bg_chars": F.expr("cast(char_length(_bg_t) as bigint)"),
        "_bg_word_chars": F.expr("cast(char_length(array_join(_bg_w, '')) as bigint)"),
        # every bin once after the words' bins: a bin's count is the gap between two changes in sorted order
        "_bg_at": F.expr(
            f"sort_array(concat(transform(_bg_w, w -> array_position(array({words}), w)),"
            f" sequence(0L, {bins + 1}L)))"
        ),
        "_bg_classes": F.expr(f"array({', '.join(f'cast({k} as bigint)' for k in kept)})"),
    })
    out = out.withColumn(
        "_bg_ends", F.expr("filter(sequence(1, size(_bg_at) - 1), i -> _bg_at[i] <> _bg_at[i - 1])")
    )
    return out.withColumns({
        "_bg_hw": F.expr(
            f"transform(sequence(0, {bins}), k -> cast(_bg_ends[k] - if(k = 0, 0, _bg_ends[k - 1]) - 1 as bigint))"
        ),
        "_bg_hc": F.expr(
            "concat(_bg_classes, array(_bg_chars - _bg_word_chars,"
            " _bg_word_chars - aggregate(_bg_classes, 0L, (a, x) -> a + x)))"
        ),
    })


def language_references(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(ref_lang, ref_w, ref_c): summed histograms of all documents of each declared language."""
    rows = histograms(docs.select(text, lang), text, lang)
    wide = {f"w{i}": F.sum(F.col("_bg_hw")[i]) for i in range(len(COMMON_WORDS) + 1)}
    wide |= {f"c{i}": F.sum(F.col("_bg_hc")[i]) for i in range(len(CLASSES) + 2)}
    sums = rows.groupBy(F.col("_bg_lang").alias("ref_lang")).agg(*[v.alias(k) for k, v in wide.items()])
    return sums.select(
        "ref_lang", F.array(*[k for k in wide if k[0] == "w"]).alias("ref_w"),
        F.array(*[k for k in wide if k[0] == "c"]).alias("ref_c"),
    )


def _divergence(own: str, reference: str) -> str:
    """SQL text of the Jensen-Shannon divergence in bits of two arrays of counts; 0 if either is empty."""
    total = "aggregate({0}, 0L, (a, x) -> a + x)"
    share = "transform({0}, x -> cast(x as double) / " + total + ")"
    part = "if(x > 0, x * log2(2 * x / (x + y)), 0D) + if(y > 0, y * log2(2 * y / (x + y)), 0D)"
    return (
        f"if({reference} is null or {total.format(own)} = 0 or {total.format(reference)} = 0, 0D, "
        f"aggregate(zip_with({share.format(own)}, {share.format(reference)}, (x, y) -> {part}), 0D,"
        f" (a, x) -> a + x) / 2)"
    )


def repeated_windows(rows: DataFrame) -> DataFrame:
    """Adds ``_bg_repeat``: words of ``_bg_w`` inside 3-word windows that occur more than once."""
    out = rows.withColumn("_bg_tri", F.expr(
        "if(_bg_n < 3, array(cast(null as bigint)),"
        " transform(sequence(0, cast(_bg_n as int) - 3), i -> xxhash64(_bg_w[i], _bg_w[i + 1], _bg_w[i + 2])))"
    ))
    out = out.withColumn("_bg_sorted", F.expr(
        "if(size(array_distinct(_bg_tri)) = size(_bg_tri), cast(array() as array<bigint>), sort_array(_bg_tri))"
    ))
    out = out.withColumn(
        "_bg_dup", F.expr("array_distinct(filter(_bg_sorted, (x, i) -> i > 0 and x = _bg_sorted[i - 1]))")
    )
    out = out.withColumn("_bg_pairs", F.expr(
        f"if(size(_bg_dup) <= {SEARCHED}, cast(array() as array<struct<h: bigint, i: int>>),"
        " sort_array(transform(_bg_tri, (x, i) -> struct(x as h, i as i))))"
    ))
    out = out.withColumn("_bg_at", F.expr(f"""case
        when size(_bg_dup) = 0 then cast(array() as array<int>)
        when size(_bg_dup) <= {SEARCHED} then filter(
            transform(_bg_tri, (x, i) -> if(array_contains(_bg_dup, x), i, -1)), i -> i >= 0)
        else sort_array(transform(filter(_bg_pairs, (x, i) ->
            (i > 0 and _bg_pairs[i - 1].h = x.h) or (i < size(_bg_pairs) - 1 and _bg_pairs[i + 1].h = x.h)), x -> x.i))
        end"""))
    return out.withColumn("_bg_repeat", F.expr(
        "aggregate(_bg_at, struct(0L as n, 0 as past), (a, i) ->"
        " struct(a.n + i + 3 - greatest(i, a.past) as n, i + 3 as past), a -> a.n)"
    ))


def _judged(docs: DataFrame, text: str, lang: str, keep: list[str]) -> DataFrame:
    """``keep`` as ``_bg_keep0``, ``_bg_keep1`` and so on, with the counts, the divergences and the verdicts."""
    held = Scratch(docs.sparkSession, "quality").save(language_references(docs, text, lang), "references")
    names = [f"_bg_keep{i}" for i in range(len(keep))]
    rows = histograms(docs.select(
        *[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("_bg_text"), F.col(lang).alias("_bg_own")
    ), "_bg_text", "_bg_own")
    rows = repeated_windows(rows).withColumn("_bg_lines", F.expr(
        "filter(split(_bg_t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    ))
    rows = rows.select(
        *names, "_bg_lang", "_bg_hw", "_bg_hc", F.col("_bg_n").alias("n_words"),
        F.col("_bg_word_chars").alias("word_chars"), F.col("_bg_classes")[2].alias("n_symbols"),
        F.expr("cast(size(_bg_lines) - size(array_distinct(_bg_lines)) as bigint)").alias("n_dup_lines"),
        F.col("_bg_repeat").cast("bigint").alias("n_repeat_words"),
    )
    rows = rows.join(  # one row per language
        broadcast_if_small(held, held.count()), F.col("_bg_lang").eqNullSafe(F.col("ref_lang")), "left"
    )
    rows = rows.withColumns({
        "char_divergence": F.expr(f"round({_divergence('_bg_hc', 'ref_c')}, 6)"),
        "word_divergence": F.expr(f"round({_divergence('_bg_hw', 'ref_w')}, 6)"),
        "base_failed": F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"),
        "_bg_all": F.expr("aggregate(_bg_hc, 0L, (a, x) -> a + x)"),
    })
    odd_words = (
        f"n_words > 0 and word_divergence > greatest({MAX_WORD_DIVERGENCE}D, {WORD_NOISE}D / greatest(n_words, 1))"
    )
    # one sum instead of a conjunction: a filter on the verdict stays above the join and what is computed for it
    return rows.withColumn("kept", F.expr(
        f"cast(base_failed as int) + if(_bg_all >= {MIN_CHARS} and char_divergence > {MAX_CHAR_DIVERGENCE}, 1, 0)"
        f" + if({odd_words}, 1, 0) = 0"
    )).select(*names, *VERDICTS)


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id") -> DataFrame:
    """The id with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the divergences and verdicts.

    Null texts have no words and fail the base rules, as empty ones do. Null languages are a language of their own.
    Every row is judged by itself, repeated rows alike; the references cover all rows. Other columns are ignored; an
    empty table gives no rows. A very long text costs its task memory for its words and windows at once.
    """
    return _judged(docs, text, lang, [id_column]).withColumnRenamed("_bg_keep0", id_column)


def drop_rejected(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that ``quality`` keeps, with all their columns, whatever these are named.

    Null and empty texts go, null languages are one language, repeated rows stay or go together, an empty table stays
    empty.
    """
    names = [F.col(f"_bg_keep{i}").alias(c) for i, c in enumerate(docs.columns)]
    return _judged(docs, text, lang, docs.columns).where("kept").select(*names)
