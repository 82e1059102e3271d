"""Text to weighted terms: tokens, vocabulary, TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballgraph.session import Scratch

TOKEN = r"[\p{L}\p{N}_]{2,}"
BROADCAST_BYTES = 64 << 20   # largest vocabulary that is broadcast
ROW_BYTES = 48               # of a vocabulary row besides its term

# Common English function words, the default stop list.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being "
    "below between both but by can cannot could did do does doing down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it "
    "its itself me more most my myself no nor not of off on once only or other ought our ours "
    "ourselves out over own same she should so some such than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were "
    "what when where which while who whom why with would you your yours yourself yourselves"
).split()


def tokens(docs: DataFrame, text: str = "text", stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(id, term) for every lower-cased run of two or more word characters that is no stop word."""
    words = docs.select(
        "id", F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(0))).alias("term")
    )
    return words.where(~F.col("term").isin(list(stop_words))) if stop_words else words


def term_counts(token_rows: DataFrame) -> DataFrame:
    """(id, term, tf); counted inside each task before the shuffle."""
    return token_rows.groupBy("id", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, min_df: int = 2, max_features: int | None = None) -> DataFrame:
    """(term, df, total): terms in ``min_df`` documents, then the most frequent ``max_features``."""
    vocab = counts.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("total")
    ).where(F.col("df") >= min_df)
    if max_features is not None:
        vocab = vocab.orderBy(F.desc("total"), "term").limit(max_features)
    return vocab


def tfidf(
    counts: DataFrame, n_docs: int, min_df: int = 2, max_features: int | None = None
) -> DataFrame:
    """(id, term, value): tf * (ln((1+n)/(1+df)) + 1), each document scaled to length 1.

    The counts are written once and read by both passes. The vocabulary is written too, and goes to
    the tasks if its measured size allows; a term of every document then makes no hot join key.
    """
    scratch = Scratch(counts.sparkSession, "tfidf")
    counts = scratch.save(counts.select("id", "term", "tf"), "counts")
    vocab = scratch.save(vocabulary(counts, min_df, max_features).select("term", "df"), "vocabulary")
    size = vocab.agg(F.sum(F.octet_length("term") + F.lit(ROW_BYTES))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        vocab = F.broadcast(vocab)
    idf = F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    raw = counts.join(vocab, "term").select("id", "term", (F.col("tf") * idf).alias("raw"))
    # A document's rows are its distinct kept terms, so one document is never a large window.
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
    return raw.select("id", "term", (F.col("raw") / length).alias("value"))


def vectorize(
    df: DataFrame, col: str, stop_words: list[str] = STOP_WORDS, min_df: int = 2,
    max_features: int | None = 200_000,
) -> DataFrame:
    """Text columns become TF-IDF terms; numeric arrays pass through as terms named by position."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.StringType):
        docs = df.select("id", F.col(col).alias("text")).where(F.col("text").isNotNull())
        return tfidf(term_counts(tokens(docs, "text", stop_words)), docs.count(), min_df, max_features)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        cells = df.select("id", F.posexplode(col).alias("pos", "value"))
        return cells.where(F.col("value") != 0).select(
            "id", F.col("pos").cast("string").alias("term"), F.col("value").cast("double")
        )
    raise TypeError(f"{col} is {kind.simpleString()}; need text or an array of numbers")
