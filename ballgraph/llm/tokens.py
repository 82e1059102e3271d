"""Token counts with a whole-token shortcut.

A vocabulary string that encodes alone as one token is proved once, on the driver, by encoding all vocabulary
strings. A pre-token found in that set counts as one; only the rest goes through the merges.
"""

from __future__ import annotations

import os
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.llm.common import arrow_rows, text_bytes

#: Memory bound of a worker's memo of counted words, and the longest word it keeps.
MEMO_WORDS = 400_000
MEMO_CHARS = 64

#: Fixed value: how the vocabulary splits a word without white space into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_PLAIN = re.compile("[\x21-\x7eÀ-ÿ]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space for str.split, not for the vocabulary's pattern


def byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies spell bytes: printable bytes themselves, others from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(other)}


def read_tokenizer(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one thread
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text)


def whole_tokens(tokenizer, word_end: str = "</w>") -> list[str]:
    """Vocabulary strings proved to encode alone as exactly their one token."""
    import regex

    letters, found = byte_letters(), {}
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if token.endswith(word_end) and all(c in letters for c in token[: -len(word_end)]):
            spelled = bytes(letters[c] for c in token[: -len(word_end)])
            try:
                found[spelled.decode("utf-8")] = number
            except UnicodeDecodeError:
                continue
    pattern = regex.compile(PRE_TOKENS)
    names = [s for s in found if pattern.fullmatch(s) and _PLAIN.fullmatch(s)]
    encoded = tokenizer.encode_batch(names, add_special_tokens=False)
    return sorted(s for s, e in zip(names, encoded) if e.ids == [found[s]])


class WordCounts(dict):
    """Tokens of a word, as (tokens, tokens by the shortcut) packed in one integer."""

    def __init__(self, tokenizer, whole):
        import regex

        super().__init__()
        self.tokenizer, self.whole = tokenizer, frozenset(whole)
        self.split = regex.compile(PRE_TOKENS).findall

    def library(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def __missing__(self, word: str) -> int:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            parts = self.split(word.lower())
            alone = sum(p in self.whole for p in parts)
            rest = [p for p in parts if p not in self.whole]
            value = alone + sum(map(self.library, rest)) + (alone << 32)
        else:
            value = self.library(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = value
        return value

    def text(self, text: str) -> tuple[int, int]:
        """(tokens, those by the shortcut) of a whole text. No pre-token spans white space, so words add up."""
        if _SEPARATORS.search(text):
            return self.library(text), 0
        total = sum(map(self.__getitem__, text.split()))
        return total & 0xFFFFFFFF, total >> 32


_WORKER: dict[int, WordCounts] = {}


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, n_whole, over_limit): tokens of every whole text.

    ``n_whole`` counts tokens found by the shortcut. Null and empty texts have 0 bytes and 0 tokens. Repeated rows
    are counted row by row, a null id is kept, other columns are ignored. An empty table gives an empty table.
    """
    spec = open(tokenizer_path, encoding="utf-8").read()  # on the driver; tasks get the text
    whole = whole_tokens(read_tokenizer(spec))
    sent = docs.sparkSession.sparkContext.broadcast((zlib.crc32(spec.encode()), spec, whole))
    schema = docs.select(id_column).schema[0].dataType.simpleString()

    def run(batch):
        key, text, names = sent.value
        if key not in _WORKER:
            _WORKER[key] = WordCounts(read_tokenizer(text), names)
        count = _WORKER[key].text
        raw = batch["t"]
        pairs = [count(t.decode("utf-8")) for t in raw]
        yield {
            "id": batch["id"], "n_bytes": [len(t) for t in raw],
            "n_tokens": [p[0] for p in pairs], "n_whole": [p[1] for p in pairs],
        }

    rows = arrow_rows(
        docs.select(F.col(id_column).alias("id"), text_bytes(text_column).alias("t")), run,
        f"id {schema}, n_bytes bigint, n_tokens bigint, n_whole bigint",
    )
    return rows.select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens", "n_whole", (F.col("n_tokens") > limit).alias("over_limit")
    )
