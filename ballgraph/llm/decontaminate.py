"""Benchmark decontamination: BM25 over an inverted index of test items, queried by every training passage.

Passages overlap so that every item lies whole inside one. Block maxima bound the score of a passage for each block of
items, for many passages at once; passages that can reach the threshold go through block-max WAND, which retrieves all
items above it. Retrieved items are verified by the overlap of their question's and answer's word 5-grams.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.llm.common import arrow_rows, groups_of, text_bytes
from ballgraph.session import Scratch

#: Items whose texts take more bytes than this are indexed and searched in parts.
INDEX_BYTES = 16_000_000
#: Items in a block, and texts searched together.
BLOCK = 4
STEP_BYTES = 1_000_000

#: BM25, the share of an item's own score that a passage must reach, and the verified overlap.
K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5

_WORDS = bytearray(range(256))
for _c in range(128):
    if chr(_c).isupper():
        _WORDS[_c] = _c + 32
    elif not chr(_c).isalnum():
        _WORDS[_c] = 32
_WORDS = bytes(_WORDS)
_ENDS = re.compile(r"(?<=[.!?])\s+")


def words_of(text: bytes) -> list[bytes]:
    """Words without ASCII case and punctuation."""
    return text.translate(_WORDS).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's last sentence is its answer, what comes before its question; one sentence is a question."""
    parts = [words_of(p.encode()) for p in _ENDS.split(text.strip())]
    parts = [p for p in parts if p]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingles(words: list[bytes]) -> set[tuple]:
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE))))


def found_share(wanted: set[tuple], passage: list[bytes]) -> float:
    """Share of an item's shingles in a passage; 1 for none."""
    if not wanted:
        return 1.0
    sizes = {len(s) for s in wanted}
    have = {s for n in sizes for s in zip(*(passage[i:] for i in range(n)))}
    return len(wanted & have) / len(wanted)


class Index:
    """Postings of BM25 impacts, each a share of its item's own score, with their maxima by block of items."""

    def __init__(self, items: list[tuple], n_items: int, mean_words: float, frequency: dict[bytes, int]):
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        self.shingles = [(shingles(q), shingles(a)) for q, a in self.parts]
        self.longest = max((len(q) + len(a) for q, a in self.parts), default=0)
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for at, (q, a) in enumerate(self.parts):
            size = len(q) + len(a)
            impact = {}
            for word, tf in Counter(q + a).items():
                df = frequency[word]
                idf = math.log(1 + (n_items - df + 0.5) / (df + 0.5))
                impact[word] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean_words))
            own = sum(impact.values())
            for word, x in impact.items():
                postings.setdefault(word, []).append((at, x / own))
        self.terms = {w: n for n, w in enumerate(postings)}
        self.blocks: list[dict[int, tuple[list[int], list[float], float]]] = []  # of a term: items, impacts, maximum
        for entries in postings.values():
            blocks: dict[int, tuple[list[int], list[float]]] = {}
            for at, x in entries:
                docs, impacts = blocks.setdefault(at // BLOCK, ([], []))
                docs.append(at)
                impacts.append(x)
            self.blocks.append({b: (d, x, max(x)) for b, (d, x) in blocks.items()})
        self.first = np.zeros(len(self.terms) + 1, np.int64)
        np.cumsum([len(t) for t in self.blocks], out=self.first[1:])
        self.block_of = np.array([b for t in self.blocks for b in t], np.int64)
        self.block_top = np.array([x[2] for t in self.blocks for x in t.values()])
        self.n_blocks = -(-len(items) // BLOCK)

    def bounded(self, passage: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) of passages 0..n-1 whose bound reaches the threshold, given their distinct terms."""
        many = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
        bound = np.bincount(
            np.repeat(passage, many) * self.n_blocks + self.block_of[at], self.block_top[at], n * self.n_blocks
        )
        reached = np.flatnonzero(bound >= THRESHOLD - 1e-9)
        return reached // self.n_blocks, reached % self.n_blocks

    def retrieve(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """WAND within a block by its maxima: (item, score) of at least the threshold for distinct terms."""
        limit = THRESHOLD - 1e-9
        lists = [p for t in terms if (p := self.blocks[t].get(block))]
        cursors = [[p[0][0], n, 0] for n, p in enumerate(lists)]
        out = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for at, (doc, n, _) in enumerate(cursors):
                bound += lists[n][2]
                if bound >= limit:
                    pivot = doc
                    break
            if pivot is None:
                break
            while at + 1 < len(cursors) and cursors[at + 1][0] == pivot:
                at += 1
            moved, goal = cursors[: at + 1], pivot
            if cursors[0][0] == pivot:
                score = sum(lists[n][1][p] for _, n, p in moved)
                if score >= limit:
                    out.append((pivot, score))
                goal = pivot + 1
            for cursor in moved:
                docs, p = lists[cursor[1]][0], cursor[2]
                while p < len(docs) and docs[p] < goal:
                    p += 1
                cursor[2] = p
                cursor[0] = docs[p] if p < len(docs) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def search(self, texts: list[bytes]) -> list[dict]:
        """Per text, {item: (passage, score, question overlap, answer overlap)} of verified items."""
        found: list[dict] = [{} for _ in texts]
        step = self.longest
        if not step or not self.terms:
            return found
        words = [words_of(t) for t in texts]
        get = self.terms.get
        counts = np.array([len(w) for w in words], np.int64)
        term = np.array([get(w, -1) for ws in words for w in ws], np.int64)
        begin = np.cumsum(counts) - counts
        n_passages = np.maximum(1, -(-counts // step) - 1)
        first = np.cumsum(n_passages) - n_passages
        owner = np.repeat(np.arange(len(texts)), counts)
        known = np.flatnonzero(term >= 0)
        doc = owner[known]
        at = (known - begin[doc]) // step
        last = n_passages[doc] - 1
        passage = np.concatenate((first[doc] + np.minimum(at, last), first[doc] + np.clip(at - 1, 0, last)))
        n, width = int(n_passages.sum()), len(self.terms)
        pairs = np.unique(passage * width + np.concatenate((term[known], term[known])))
        passage, term = pairs // width, pairs % width
        edges = np.searchsorted(passage, np.arange(n + 1))
        of = np.repeat(np.arange(len(texts)), n_passages)
        for p, block in zip(*self.bounded(passage, term, n)):
            d = int(of[p])
            nth = int(p - first[d])
            own = words[d][nth * step:(nth + 2) * step]
            for item, score in self.retrieve(term[edges[p]:edges[p + 1]].tolist(), int(block)):
                question, answer = (found_share(s, own) for s in self.shingles[item])
                if question >= OVERLAP and answer >= OVERLAP:
                    match = (nth, round(score, 6), question, answer)
                    if item not in found[d] or match[1] > found[d][item][1]:
                        found[d][item] = match
        return found


def _terms(items: DataFrame) -> DataFrame:
    def run(batch):
        lists = [sorted(set(words_of(t))) for t in batch["t"]]
        yield {"part": [p for p, ws in zip(batch["part"], lists) for _ in ws], "w": [w for ws in lists for w in ws]}

    return arrow_rows(items.select("part", "t"), run, "part int, w binary")


def build_indexes(
    benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text", index_bytes: int = INDEX_BYTES
) -> list[Index]:
    """Indexes of at most about ``index_bytes`` of item texts each; their statistics cover all items.

    Items without a word are not indexed. Repeated items are indexed as often as they occur.
    """
    scratch = Scratch(benchmark.sparkSession, "decontaminate")
    items = benchmark.select(F.col(item_column).alias("item"), text_bytes(text_column).alias("t"))
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = -(-size // index_bytes) or 1
    items = scratch.save(items.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int")), "items")

    def lengths(batch):
        yield {"n": [len(words_of(t)) for t in batch["t"]]}

    total = arrow_rows(items.select("t"), lengths, "n bigint").where("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not total[0]:
        return []
    terms = _terms(items)
    frequency = terms.groupBy("w").agg(F.count("*").alias("df"))
    out = []
    for part in range(parts):
        rows = items.where(F.col("part") == part).select("item", "t").collect()  # bounded by index_bytes
        own = terms.where(F.col("part") == part).select("w").distinct() if parts > 1 else None
        df = frequency if own is None else frequency.join(own, "w")
        out.append(Index(
            sorted(((r["item"], bytes(r["t"]).decode()) for r in rows if words_of(bytes(r["t"]))), key=repr),
            total[0], total[1] / total[0], {bytes(r["w"]): r["df"] for r in df.collect()},
        ))
    return [i for i in out if i.ids]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, item_id, passage, score, question_overlap, answer_overlap): test items found in documents.

    One row per document row and item, of its best passage. Null and empty texts hold no items; repeated rows are
    searched row by row; other columns are ignored; empty tables give no rows.
    """
    schema = docs.select(id_column).schema[0].dataType.simpleString()
    kind = benchmark.select("item_id").schema[0].dataType.simpleString()
    fields = (
        f"id {schema}, item_id {kind}, passage bigint, score double, question_overlap double, answer_overlap double"
    )
    rows = docs.select(F.col(id_column).alias("id"), text_bytes(text_column).alias("t"))
    out = None
    for index in build_indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch, sent=sent):
            ids, texts = batch["id"], batch["t"]
            for begin, stop in groups_of(texts, STEP_BYTES):
                hits = [
                    (doc, sent.value.ids[item], *match)
                    for doc, items in zip(ids[begin:stop], sent.value.search(texts[begin:stop]))
                    for item, match in items.items()
                ]
                if hits:
                    yield dict(zip(("id", "item_id", "passage", "score", "question_overlap", "answer_overlap"), zip(*hits)))

        found = arrow_rows(rows, run, fields)
        out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], fields)
    return out.withColumnRenamed("id", id_column)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents that hold no test item, with all their columns; nothing is shuffled."""
    place = docs.columns.index(text_column)
    for index in build_indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for batch in batches:
                texts = [(t or "").encode() for t in batch.column(place).cast(pa.string()).to_pylist()]
                clean = []
                for begin, stop in groups_of(texts, STEP_BYTES):
                    clean += [not hits for hits in sent.value.search(texts[begin:stop])]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
