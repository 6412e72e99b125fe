"""Counting greedy word pieces with a longest-match automaton, in time linear in the text.

The vocabulary is a trie. Where a node has no child for the next symbol, its failure link leads to the
node of what is left once the longest pieces are taken off its string, and the number of pieces so
taken is known beforehand; a word's count is a sum of such numbers, and no piece is ever built.

Words are what the vocabulary's splitting rule gives on the lower-cased text; their symbols are UTF-8
bytes and an end mark. A word that the vocabulary can't cover counts as one unknown piece.

Defined cases: null and empty texts have no words; texts of any length are read whole; rows that
repeat count alike; an empty table gives an empty result; other columns do no harm.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from stellara.llm.common import ship, table

END = 256
ROOT = 0
NONE = -1
MAX_WORDS = 500_000
WORD_BYTES = 64
#: How the vocabulary file splits text, and how it marks a word's end.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
END_MARK = "</w>"


def byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, others as U+0100 onwards."""
    own = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def parse_vocabulary(data: bytes) -> list[tuple[int, ...]]:
    """Pieces as symbols; special tokens, which no text gives, are left out."""
    whole = json.loads(data)
    special = {t["content"] for t in whole.get("added_tokens", [])}
    sign = byte_of_sign()
    out = []
    for piece in whole["model"]["vocab"]:
        if piece in special:
            continue
        body = piece.removesuffix(END_MARK)
        out.append((*(sign[c] for c in body), *((END,) if body != piece else ())))
    return out


class Automaton:
    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        self.child: dict[int, int] = {}
        above, symbol, self.is_piece = [NONE], [NONE], [False]
        for piece in pieces:
            node = ROOT
            for s in piece:
                key = node * 257 + s
                if key not in self.child:
                    self.child[key] = len(above)
                    above.append(node)
                    symbol.append(s)
                    self.is_piece.append(False)
                node = self.child[key]
            self.is_piece[node] = node != ROOT
        depth = [0] * len(above)
        for node in range(1, len(above)):
            depth[node] = depth[above[node]] + 1
        self.fail, self.popped = [NONE] * len(above), [0] * len(above)
        for node in sorted(range(1, len(above)), key=depth.__getitem__):
            if self.is_piece[node]:
                self.fail[node], self.popped[node] = ROOT, 1
            else:
                self.fail[node], self.popped[node] = self.follow(self.fail[above[node]], self.popped[above[node]], symbol[node])

    def follow(self, node: int, pops: int, symbol: int) -> tuple[int, int]:
        """From a node, through failure links, over a symbol; pops grows by what they take off."""
        while node != NONE and (to := self.child.get(node * 257 + symbol)) is None:
            pops += self.popped[node]
            node = self.fail[node]
        return (NONE, 0) if node == NONE else (to, pops)

    def count(self, symbols: Iterable[int]) -> int:
        """Pieces of a word by greedy longest match; 1 if it has no such split."""
        node, pops = ROOT, 0
        for s in symbols:
            node, pops = self.follow(node, pops, s)
            if node == NONE:
                return 1
        while node != ROOT:
            pops += self.popped[node]
            node = self.fail[node]
            if node == NONE:
                return 1
        return pops


class Counts(dict):
    def __init__(self, machine: Automaton):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        data = word.encode()
        n = self.machine.count((*data, END))
        if len(data) <= WORD_BYTES and len(self) < MAX_WORDS:
            self[word] = n
        return n


_counts: dict[bytes, Counts] = {}


def counts(data: bytes) -> Counts:
    """One automaton a worker process and vocabulary."""
    key = hashlib.sha256(data).digest()
    if key not in _counts:
        _counts[key] = Counts(Automaton(parse_vocabulary(data)))
    return _counts[key]


def count_pieces(docs: DataFrame, vocabulary: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_pieces of every whole text."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(key, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, split = counts(held.value), regex.compile(PATTERN).findall
        for batch in batches:
            words, pieces = [], []
            for x in batch.column(1):
                found = split((x.as_py() or "").lower())
                words.append(len(found))
                pieces.append(sum(map(own.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(pieces, pa.int64())], [key, "n_words", "n_pieces"])

    return rows.mapInArrow(run, f"{key} {rows.schema[0].dataType.simpleString()}, n_words long, n_pieces long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_pieces(table(spark, sf_dir, "documents"), Path(public_tokenizers.path("word_bpe_49k.json")).read_bytes())
