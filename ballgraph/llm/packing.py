"""Best-fit packing planned on the length histogram.

Documents become token ids inside tasks; only lengths and checksums leave them. Best-fit decreasing runs over the
counts of the at most ``size`` lengths, not over documents. Pieces then take the planned places by joining on their
rank within their length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballgraph.llm.common import arrow_rows, text_bytes
from ballgraph.llm.tokens import read_tokenizer
from ballgraph.session import Scratch

#: Memory bound of a worker's memo of encoded chunks, the longest chunk it keeps, and texts encoded together.
MEMO_CHUNKS = 1_000_000
MEMO_CHARS = 64
STEP_BYTES = 4_000_000
ENCODED = 5_000
#: Plain chunks that are encoded as one text.
JOINED = 250

_RUN = re.compile(r"\s[ \n]\s")
_PLAIN = re.compile(r"[^\s<]+")
#: Fixed value: the letter in which the vocabulary spells a space.
SPACE_LETTER = "\u0120"


class ChunkIds:
    """Token ids of texts from memoised ids of their chunks.

    The vocabulary's pre-tokens start at white space that follows other text, and only the last character of a run of
    white space can join what follows. So a text may be cut before any space or line feed unless that character has
    white space on both sides; a text with such a run is encoded whole.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.known: dict[str, bytes] = {}  # by the chunk without the space in front of it
        self.opening: dict[str, bytes] = {}  # chunks that open a text, with no space in front
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.spaced[[n for token, n in vocabulary.items() if token.startswith(SPACE_LETTER)]] = True

    def _encode(self, chunks: list[str]) -> list[bytes]:
        return [
            array("I", e.ids).tobytes()
            for at in range(0, len(chunks), ENCODED)  # an encoding holds much more than its ids
            for e in self.tokenizer.encode_batch_fast(chunks[at:at + ENCODED], add_special_tokens=False)
        ]

    def _encode_spaced(self, chunks: list[str]) -> list[bytes]:
        """Ids of plain chunks with a space in front of each: encoded as one text, they begin where a token with a space
        does. Lots in which that does not give as many chunks are encoded one by one."""
        out: list[bytes] = []
        for at in range(0, len(chunks), ENCODED):
            some = chunks[at:at + ENCODED]
            lines = [some[k:k + JOINED] for k in range(0, len(some), JOINED)]
            joined = self.tokenizer.encode_batch_fast([" " + " ".join(x) for x in lines], add_special_tokens=False)
            for line, e in zip(lines, joined):
                ids = np.array(e.ids, np.uint32)
                begin = np.flatnonzero(self.spaced[ids])
                if len(begin) != len(line) or (len(begin) and begin[0]):
                    out.extend(self._encode([" " + p for p in line]))
                    continue
                packed, cuts = ids.tobytes(), (np.append(begin, len(ids)) * 4).tolist()
                out.extend(packed[x:y] for x, y in zip(cuts, cuts[1:]))
        return out

    def _spaced_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks from the memo, which learns those it lacks."""
        found = list(map(self.known.get, chunks))
        lacking = [n for n, b in enumerate(found) if b is None]
        plain = [n for n in lacking if _PLAIN.fullmatch(chunks[n])]
        # a line feed opens a chunk as a space does, and stays in it
        odd = [n for n in lacking if not _PLAIN.fullmatch(chunks[n])]
        learnt = self._encode_spaced([chunks[n] for n in plain])
        learnt += self._encode([chunks[n] if chunks[n][:1] == "\n" else " " + chunks[n] for n in odd])
        if len(self.known) + len(learnt) > MEMO_CHUNKS:
            self.known.clear()
        for n, ids in zip(plain + odd, learnt):
            found[n] = ids
            if len(chunks[n]) <= MEMO_CHARS:
                self.known[chunks[n]] = ids
        return found

    def _opening_ids(self, chunks: list[str]) -> list[bytes]:
        lacking = [p for p in chunks if p not in self.opening]
        learnt = dict(zip(lacking, self._encode(lacking)))
        found = [self.opening.get(p) or learnt.get(p, b"") for p in chunks]
        if len(self.opening) + len(learnt) > MEMO_CHUNKS // 8:
            self.opening.clear()
        self.opening.update((p, ids) for p, ids in learnt.items() if len(p) <= MEMO_CHARS)
        return found

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The 32-bit ids of the texts one after the other, ``end`` behind each, and where each text begins."""
        runs = [n for n, t in enumerate(texts) if _RUN.search(t)]
        apart = set(runs)
        cut = pa.array([t if n not in apart else "" for n, t in enumerate(texts)], pa.large_string())
        lists = pc.split_pattern(pc.replace_substring(cut, "\n", " \n"), " ")
        offsets = lists.offsets.to_numpy()
        flat = lists.flatten().dictionary_encode()
        chunks = flat.dictionary.to_pylist()
        opening = [chunks[n] for n in flat.indices.to_numpy()[offsets[:-1]].tolist()] if len(texts) else []
        distinct = list(dict.fromkeys(opening))
        # what a place in the texts can be: a chunk, a first chunk, a text encoded whole, the end
        first = {p: len(chunks) + n for n, p in enumerate(distinct)}
        blobs = self._spaced_ids(chunks) + self._opening_ids(distinct)
        whole = len(blobs)
        blobs += self._encode([texts[n] for n in runs]) + [array("I", [end]).tobytes()]
        places = flat.indices.to_numpy().astype(np.int64)
        places[offsets[:-1]] = [first[p] for p in opening]
        places[offsets[runs]] = whole + np.arange(len(runs))
        places = np.insert(places, offsets[1:], len(blobs) - 1)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        pool, at = np.frombuffer(b"".join(blobs), np.uint32), np.cumsum(sizes) - sizes
        n = sizes[places]
        ends = np.cumsum(n)
        ids = pool[np.repeat(at[places] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        begins = np.append(0, ends[offsets[1:] + np.arange(len(texts))])
        return ids, begins


_WORKER: dict[int, ChunkIds] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and ``end_id``, cut if longer than ``size``."""
    spec = open(tokenizer_path, encoding="utf-8").read()  # on the driver; tasks get the text
    sent = docs.sparkSession.sparkContext.broadcast((zlib.crc32(spec.encode()), spec))

    def run(batch):
        from ballgraph.llm.common import groups_of

        key, text = sent.value
        if key not in _WORKER:
            _WORKER[key] = ChunkIds(read_tokenizer(text))
        docs, raw = batch["id"], batch["t"]
        for begin, stop in groups_of(raw, STEP_BYTES):
            out = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            ids, begins = _WORKER[key].encode([t.decode("utf-8") for t in raw[begin:stop]], end_id)
            packed = memoryview(ids.astype("<u4", copy=False)).cast("B")
            for doc, low, high in zip(docs[begin:stop], begins.tolist(), begins[1:].tolist()):
                total = high - low
                first = (total - 1) % size + 1
                for piece, (at, to) in enumerate(
                    zip([0, *range(first, total, size)], range(first, total + 1, size))
                ):
                    out["doc_id"].append(doc)
                    out["piece"].append(piece)
                    out["start"].append(at)
                    out["length"].append(to - at)
                    out["ids_crc32"].append(zlib.crc32(packed[(low + at) * 4:(low + to) * 4]))
            yield out

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return arrow_rows(
        docs.select(F.col("doc_id").alias("id"), text_bytes().alias("t")), run,
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint",
    )


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many, first sequence, offset): best-fit decreasing over the histogram.

    Equal sequences are kept as one entry with a multiplicity. A sequence takes as many pieces of a length as fit,
    which is what placing them one by one in the fullest sequence with room does.
    """
    room: dict[int, list] = {}  # free tokens -> entries [multiplicity, [(length, offset, nth of its length)...]]
    order: list[int] = []  # the keys of room, sorted
    done: list = []

    def put(free: int, entry) -> None:
        if free == 0:
            done.append(entry)
            return
        if free not in room:
            room[free] = []
            bisect.insort(order, free)
        room[free].append(entry)

    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        left = counts[length]
        while left > 0:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                free = order[at]
                many, items = room[free].pop()
                if not room[free]:
                    del room[free]
                    order.pop(at)
            else:
                free, many, items = size, None, []
            fit = free // length
            if left < fit:
                take, each = 1, left
            else:
                take, each = (left // fit if many is None else min(many, left // fit)), fit
            if many is not None and many > take:
                put(free, [many - take, items])
            used = size - free
            put(free - each * length, [take, items + [(length, used + k * length) for k in range(each)]])
            left -= take * each
    done.extend(entry for free in order for entry in room[free])
    ranks, sequence, plan = {}, 0, []
    for many, items in done:
        for length, offset in items:
            first = ranks.get(length, 0)
            plan.append((length, first, many, sequence, offset))
            ranks[length] = first + many
        sequence += many
    return plan


def pack_pieces(pieces: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """Adds (sequence_id, offset) to written pieces with a ``length``."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit_plan(counts, size)  # at most ``size`` lengths
    names = ["length", "first", "many", "sequence", "offset"]
    table = pd.DataFrame(plan, columns=names, dtype="int64").sort_values(["length", "first"])
    sent = pieces.sparkSession.sparkContext.broadcast({n: table[n].to_numpy() for n in names})

    # A length can hold a third of all pieces: ranks are counted in salted parts, then shifted.
    salts = max(16, min(1024, sum(counts.values()) // 50_000))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = salted.withColumn("nth", F.row_number().over(within)).join(
        F.broadcast(shift) if len(counts) * salts <= 1_048_576 else shift, ["length", "salt"]
    ).withColumn("rank", F.col("nth") - 1 + F.col("shift"))

    schema = f"{pieces.schema.simpleString()[7:-1]},sequence_id:bigint,offset:bigint".replace(":", " ")
    width = len(pieces.columns)

    def place(batches):
        plan = sent.value
        key = (plan["length"] << 40) + plan["first"]
        for batch in batches:
            rank = batch.column(width).to_numpy()
            at = np.searchsorted(key, (batch.column("length").to_numpy() << 40) + rank, side="right") - 1
            more = [plan["sequence"][at] + rank - plan["first"][at], plan["offset"][at]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], *map(pa.array, more)],
                names=[*batch.schema.names[:width], "sequence_id", "offset"],
            )

    return ranked.select(*pieces.columns, F.col("rank").cast("bigint")).mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document's place in sequences of ``size``.

    A null or empty text is its end token alone. Only documents longer than ``size`` are cut; their first piece is the
    shorter one. Repeated rows are packed as often as they occur, ties are ordered by all columns, other columns are
    ignored, and an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    return pack_pieces(scratch.save(token_pieces(docs, tokenizer_path, size, end_id), "pieces"), size, scratch)
