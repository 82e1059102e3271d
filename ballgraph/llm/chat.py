"""Chat formatting at token level.

Each turn's text is escaped and encoded by itself; reserved ids beyond the vocabulary are spliced in for role and end of
turn, so no text can produce them. Prefix sums of segment lengths place a conversation's tokens and its loss mask. The
formatted string is what the ids render to; control strings in texts are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballgraph.llm.tokens import read_tokenizer

#: The template: reserved tokens, in the order of their ids, and what they render to.
ROLES = ("system", "user", "assistant")
TRAINED = "assistant"
RESERVED = tuple(f"### {r.capitalize()}: " for r in ROLES) + ("### Role ", ": ", "</turn>\n")
OTHER, COLON, END = 3, 4, 5

#: A backslash is put before these in a text, and taken away again: none of ``###``, ``</turn>``, ``<|`` stays bare.
_ESCAPE = re.compile(r"(\\|#(?=##)|</turn>|<\|)")
_UNESCAPE = re.compile(r"\\(\\|#|</turn>|<\|)")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Template:
    def __init__(self, spec: str):
        self.tokenizer = read_tokenizer(spec)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.base = self.tokenizer.get_vocab_size()

    def encode(self, turns: list[tuple[str, str]]) -> list[tuple[list[int], int, int]]:
        """Per (role, text): ids, and the begin and end of the text among them."""
        texts = self.tokenizer.encode_batch_fast([escape(t) for _, t in turns], add_special_tokens=False)
        out = []
        for (role, _), text in zip(turns, texts):
            if role in ROLES:
                head = [self.base + ROLES.index(role)]
            else:
                name = self.tokenizer.encode(escape(role), add_special_tokens=False).ids
                head = [self.base + OTHER, *name, self.base + COLON]
            out.append((head + text.ids + [self.base + END], len(head), len(head) + len(text.ids)))
        return out

    def render(self, ids: np.ndarray) -> str:
        """The formatted string of any stretch of ids."""
        parts, begin = [], 0
        for at in [*np.flatnonzero(ids >= self.base), len(ids)]:
            if at > begin:
                parts.append(self.tokenizer.decode(ids[begin:at].tolist(), skip_special_tokens=False))
            if at < len(ids):
                parts.append(RESERVED[ids[at] - self.base])
            begin = at + 1
        return "".join(parts)

    def read(self, ids: np.ndarray) -> tuple[str, str, int, int, int]:
        """(role, escaped text, its begin and end among the ids, characters of the rendered turn)."""
        marks = np.flatnonzero(ids >= self.base)
        head = ids[0] - self.base
        begin, end = int(marks[0 if head < OTHER else 1]) + 1, int(marks[-1])
        text = self.render(ids[begin:end])
        name = "" if head < OTHER else self.render(ids[1:begin - 1])
        role = ROLES[head] if head < OTHER else unescape(name)
        shown = sum(len(RESERVED[ids[m] - self.base]) for m in marks) + len(name) + len(text)
        return role, text, begin, end, shown


_WORKER: dict[int, Template] = {}


def _template(sent) -> Template:
    key, spec = sent.value
    if key not in _WORKER:
        _WORKER[key] = Template(spec)
    return _WORKER[key]


def _send(df: DataFrame, tokenizer_path: str):
    spec = open(tokenizer_path, encoding="utf-8").read()  # on the driver; tasks get the text
    return df.sparkSession.sparkContext.broadcast((zlib.crc32(spec.encode()), spec))


def format_turns(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """(conv_id, nth, ids, start, loss_begin, loss_end): each turn's tokens and its place in its conversation.

    ``start`` is the prefix sum of the lengths before it; tokens from ``loss_begin`` to ``loss_end`` of the
    conversation are trained on (an empty range for other roles). Turns are ordered by turn (null first), role and
    text; repeated turns stay. Null roles and texts are empty, a null conversation is one of its own. Roles beyond
    system, user and assistant are written out. Other columns are ignored; an empty table gives no rows.
    """
    sent = _send(conversations, tokenizer_path)
    kinds = {f.name: f.dataType.simpleString() for f in conversations.select("conv_id", "turn").schema}
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def encode(batches):
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            done = _template(sent).encode(list(zip(roles, texts)))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array([x[0] for x in done], pa.list_(pa.int32())),
                    pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64()),
                ],
                names=[*batch.schema.names, "ids", "b", "e"],
            )

    coded = rows.mapInArrow(
        encode, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, ids array<int>, b bigint, e bigint"
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    ends = F.sum(F.size("ids")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    start = ends - F.size("ids")
    return coded.select(
        "conv_id", F.row_number().over(order).alias("nth"), "ids", start.cast("bigint").alias("start"),
        (start + F.col("b")).alias("loss_begin"),
        (start + F.when(F.col("role") == TRAINED, F.col("e")).otherwise(F.col("b"))).alias("loss_end"),
    )


def read_back(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from ``format_turns`` rows.

    Turns of a conversation stream through one task in order, since a digest needs them so; no conversation is
    held whole.
    """
    sent = _send(formatted, tokenizer_path)
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def read(batches):
        template, now = _template(sent), None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = None

        def row(state):
            return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]]

        for batch in batches:
            types = types or [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done = []
            cells = [batch.column(c).to_pylist() for c in ("conv_id", "start", "loss_begin", "loss_end")]
            ids = batch.column("ids")
            flat, cuts = ids.flatten().to_numpy(), np.cumsum([0, *map(len, ids)])
            for n, (conv, start, begin, end) in enumerate(zip(*cells)):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(row(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                own = flat[cuts[n]:cuts[n + 1]]
                role, text, first, last, shown = template.read(own)
                plain = unescape(text)
                now[1] += 1
                now[2].update(f"{role}\n{plain}\n".encode())
                if end > begin:
                    same = (begin - start, end - start) == (first, last)
                    trained = plain if same else unescape(template.render(own[begin - start:end - start]))
                    now[3] += len(trained)
                    now[4].update(trained.encode())
                now[5] += shown
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row(now), types)], names=names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "nth")
    return ordered.mapInArrow(
        read, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
