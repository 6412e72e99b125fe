"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Merging a piece of text by ranks gives the only split into vocabulary tokens in which each two
neighbours are stable: merging their joined bytes gives the same two tokens back. So a machine reads bytes from left to
right and keeps all vocabulary-trie nodes where a token could still be open. Such a set is a state; states and
transitions are made when first met (there are at most as many as trie nodes). Where tokens end, the one that is
stable after the token before it is noted. Tokens leave once all open nodes agree on them, so the lookahead is at
most a longest token's length; short pieces are read whole, and walked back from their ends.

All different pieces of a slab of text are read abreast, byte by byte, in numpy: what a worker holds is bounded by
the vocabulary, the slab and the longest piece, not by how many words it has met.

Decoding goes token by token through an incremental UTF-8 state machine, which holds back the bytes of
a character that is not complete yet.

Defined cases: null and empty texts have no tokens; texts of any length are read whole; rows that
repeat are encoded alike; an empty table gives an empty result; other columns, whatever their names, do no harm.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from stellara.llm.common import ship, table

#: Characters of a slab; pieces of a group that go abreast; below FEW pieces, the rest go one by one.
SLAB, ABREAST, FEW = 3 << 19, 1 << 16, 24
#: Bytes after which a piece that goes alone gives away what is certain.
STRETCH = 1 << 16
#: Pairs of tokens whose stability is remembered, as a power of 2.
MEMO_BITS = 20
ROOT, NEVER = 0, (1 << 31) - 1
#: The splitting rule that `pieces` follows without a regular expression.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, OTHER, SPACE, END = range(5)
END_SIGN = 0x110000
ODD = 0x9E3779B97F4A7C15


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge_by_rank(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """The definition: again and again, join the neighbours whose join has the lowest rank, leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
        if best == NEVER:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    total = np.cumsum(count, dtype=np.int32)
    out = np.repeat((first - total + count).astype(np.int32), count)
    out += np.arange(len(out), dtype=np.int32)
    return out


class Growing:
    """A flat array of numbers that is appended to."""

    def __init__(self) -> None:
        self.data, self.n = np.empty(1 << 12, np.int32), 0

    def add(self, values: Sequence[int]) -> int:
        at, self.n = self.n, self.n + len(values)
        if self.n > len(self.data):
            self.data = np.concatenate((self.data, np.empty(self.n + len(self.data), np.int32)))
        self.data[at : self.n] = values
        return at


class Stability:
    """Whether two tokens, side by side, stay as they are when their joined bytes are merged."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.vocabulary = ranks, {i: b for b, i in ranks.items()}
        self.start = max(ranks.values(), default=-1) + 1
        pairs = [(ranks[b[:k]], ranks[b[k:]], i) for b, i in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks]
        a, b, joined = np.array(pairs, np.int64).reshape(-1, 3).T
        order = np.argsort(key := self.key(a, b))
        self.pair, self.joined = np.append(key[order], 1 << 62), np.append(joined[order], NEVER).astype(np.int32)
        self.first = np.full(self.start + 1, -1, np.int32)
        self.rank, self.head, self.tail = Growing(), Growing(), Growing()
        self.memo = np.full(1 << MEMO_BITS, -1)
        self.put(self.start, [NEVER], [self.start], [self.start])

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) * (self.start + 1) + b

    def put(self, token: int, ranks: list[int], heads: list[int], tails: list[int]) -> None:
        self.first[token] = self.rank.add(ranks)
        self.head.add(heads)
        self.tail.add(tails)

    def tell(self, token: int) -> None:
        """How merging builds a token: the rank of each merge (NEVER at the end), its first and its last part
        before it. A token that merging doesn't build is never stable: its first merge has rank -1."""
        piece, ranks = self.vocabulary[token], self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        steps: list[tuple[int, int, int]] = []
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if best == NEVER:
                return self.put(token, [-1], [0], [0])
            steps.append((best, ranks[parts[0]], ranks[parts[-1]]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        steps.append((NEVER, token, token))
        return self.put(token, *map(list, zip(*steps, strict=True)))

    def over(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the token that two neighbours join to."""
        key = self.key(a, b)
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.joined[at], NEVER)

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair: no merge over the border ever comes before those on both sides of it."""
        for token in np.unique(np.concatenate((left, right))).tolist():
            if self.first[token] < 0:
                self.tell(token)
        i, j, out, at = self.first[left], self.first[right], np.ones(len(left), bool), np.arange(len(left))
        improper = (self.rank.data[i] < 0) | (self.rank.data[j] < 0)
        out[improper] = False
        at = at[~improper]
        while len(at):
            a, b = self.rank.data[i[at]], self.rank.data[j[at]]
            over = self.over(self.tail.data[i[at]], self.head.data[j[at]])
            crossed = (over < a) & (over <= b) & (over != NEVER)
            out[at[crossed]] = False
            goes = ~crossed & ~((a == NEVER) & (b == NEVER))
            by_left = (a <= b)[goes]
            at = at[goes]
            i[at[by_left]] += 1
            j[at[~by_left]] += 1
        return out

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The same, remembered: a slot holds 2 * key + answer of the last pair that fell into it."""
        key = self.key(left, right)
        slot = (key.view(np.uint64) * np.uint64(ODD) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        held = self.memo[slot]
        out = (held & 1).astype(bool)
        if len(lost := np.flatnonzero(held >> 1 != key)):
            keys, back = np.unique(key[lost], return_inverse=True)
            told = self.apart(keys // (self.start + 1), keys % (self.start + 1))
            out[lost] = told[back]
            self.memo[slot[lost]] = key[lost] * 2 + out[lost]
        return out


class Transducer:
    """States are numbered from 1 on, when met; 0 in the table is a transition not made yet."""

    def __init__(self, ranks: dict[bytes, int]):
        self.lacks = frozenset(b for b in range(256) if bytes([b]) not in ranks)
        self.ranks, self.stable = ranks, Stability(ranks)
        self.child: dict[int, int] = {}
        token, depth = [-1], [0]
        for piece, rank in ranks.items():
            node = ROOT
            for k, byte in enumerate(piece):
                to = self.child.get(node << 8 | byte, 0)
                if not to:
                    to = self.child[node << 8 | byte] = len(token)
                    token.append(-1)
                    depth.append(k + 1)
                node = to
            token[node] = rank
        self.token, self.depth = token, depth
        self.length = np.zeros(self.stable.start + 1, np.int32)
        for piece, rank in ranks.items():
            self.length[rank] = len(piece)
        self.lengths, self.known = self.length.tolist(), {}
        self.table = np.zeros((len(token) + 1, 256), np.int32)
        self.open: list[tuple[int, ...]] = [(), ()]
        self.number = {ROOT: 1}
        self.first, self.count, self.ends = np.zeros(len(token) + 1, np.int32), np.zeros(len(token) + 1, np.int32), Growing()

    def determinise(self, state: int, byte: int) -> None:
        """Make a transition: all open nodes and the root go down by the byte; the deepest that can names the state."""
        child = self.child
        live = tuple(to for node in (*self.open[state], ROOT) if (to := child.get(node << 8 | byte)))
        name = live[0] if live else ROOT
        to = self.number.get(name)
        if to is None:
            to = self.number[name] = len(self.open)
            self.open.append(live)
            ends = [t for node in live if (t := self.token[node]) >= 0]
            self.first[to], self.count[to] = self.ends.add(ends), len(ends)
        self.table[state, byte] = to

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = self.table[state, byte]
        if not out.all():
            for key in np.unique((state.astype(np.int64) << 8 | byte)[out == 0]).tolist():
                self.determinise(key >> 8, key & 255)
            out = self.table[state, byte]
        return out

    def last_tokens(self, data: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces data[first : first + count], abreast: after each byte, the last token of the stable split so far.
        Piece k has count[k] + 1 places from first[k] + k on. Also, which pieces have no unique stable split."""
        last = np.full(len(data) + len(first), self.stable.start, np.int32)
        odd = np.zeros(len(first), bool)
        order = np.argsort(-count, kind="stable")
        longest, place, at = -count[order], (first + np.arange(len(first), dtype=np.int32))[order], first[order]
        state, i = np.ones(len(first), np.int32), 0
        while (n := int(np.searchsorted(longest, -i))) > 0 and (n >= FEW or i < 64):
            state = self.step(state[:n], data[at[:n] + i])
            ends, here = self.count[state], place[:n] + (i + 1)
            token = self.ends.data[spans(self.first[state], ends)]
            here = np.repeat(here, ends)
            fits = self.stable(last[here - self.length[token]], token)
            here = here[fits]
            last[here] = token[fits]
            if len(here) != n or (here[1:] == here[:-1]).any():
                odd[order[:n]] |= np.bincount(np.repeat(np.arange(n), ends)[fits], minlength=n) != 1
            i += 1
        for k in order[:n].tolist():
            odd[k] = True  # goes alone, see encode
        return last, odd

    def encode_all(self, data: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has."""
        last, odd = self.last_tokens(data, first, count)
        alone = {int(k): np.array(self.encode(data[first[k] : first[k] + count[k]].tobytes()), np.int32) for k in np.flatnonzero(odd)}
        place = first + np.arange(len(first), dtype=np.int32)
        size, at, pos = np.zeros(len(first), np.int32), np.flatnonzero(~odd & (count > 0)), count.copy()
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at):
            token = last[place[at] + pos[at]]
            taken.append((at, token))
            size[at] += 1
            pos[at] -= self.length[token]
            at = at[pos[at] > 0]
        for k, ids in alone.items():
            size[k] = len(ids)
        after = np.cumsum(size)
        out = np.empty(int(after[-1]) if len(after) else 0, np.int32)
        for back, (row, token) in enumerate(taken):
            out[after[row] - 1 - back] = token
        for k, ids in alone.items():
            out[after[k] - len(ids) : after[k]] = ids
        return out, size

    def encode(self, piece: bytes) -> list[int]:
        """One piece by itself: what is certain is given away at every STRETCH."""
        if self.lacks and not self.lacks.isdisjoint(piece):
            raise ValueError("the vocabulary has no token for a byte of the text")
        out = self.walk(piece)
        return merge_by_rank(self.ranks, piece) if out is None else out

    def walk(self, piece: bytes) -> list[int] | None:
        """The ids of one piece, byte by byte; None if the split isn't unique."""
        out: list[int] = []
        last, state, known = [self.stable.start], 1, self.known
        length, start, table = self.lengths, self.stable.start + 1, self.table
        begun = 0  # bytes whose tokens have been given away; last[0] is the token before them
        for i, byte in enumerate(piece):
            to = int(table[state, byte])
            if not to:
                self.determinise(state, byte)
                to = int(table[state, byte])
            state = to
            hit = -1
            for node in self.open[state]:
                token = self.token[node]
                if token < 0 or i + 1 - length[token] < begun:
                    continue
                left = last[i + 1 - begun - length[token]]
                fits = known.get(left * start + token)
                if fits is None:
                    if len(known) >= 1 << MEMO_BITS:
                        known.clear()
                    fits = known[left * start + token] = bool(self.stable(np.array([left]), np.array([token]))[0])
                if fits:
                    if hit >= 0:
                        return None
                    hit = token
            if hit < 0:
                return None
            last.append(hit)
            if len(last) > STRETCH + 1:
                sure = self.certain(last, self.open[state], length)
                out += self.back(last, sure, length)
                begun += sure
                last = last[sure:]
        return out + self.back(last, len(last) - 1, length)

    def certain(self, last: list[int], live: tuple[int, ...], length: list[int]) -> int:
        """How many bytes lie before a border that the splits up to all places where a token could be open have in common."""
        at = {len(last) - 1} | {len(last) - 1 - self.depth[node] for node in live}
        while len(at) > 1:
            far = max(at)
            at.remove(far)
            if far > 0:
                at.add(far - length[last[far]])
        return max(at.pop(), 0)

    @staticmethod
    def back(last: list[int], end: int, length: list[int]) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= length[last[end]]
        return out[::-1]


def classes() -> np.ndarray:
    """The class of each character in the splitting rule."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, END_SIGN)]))
    out = np.full(END_SIGN + 1, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), "<u4")] = kind
    out[END_SIGN] = END
    return out


def pieces(signs: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the splitting rule's pieces begin, ends of texts included, in characters (of class `kind`).

    A piece is a run of one class; of the white space before another run, the last sign stands alone or, if it is
    a space, with that run. An apostrophe that begins a piece takes one of seven endings with it.
    """
    n = len(signs)
    begins = np.ones(n + 1, bool)
    begins[1:n] = kind[1:] != kind[:-1]
    if n > 1:
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
        begins[last] = True
        begins[last + 1] = signs[last] != 0x20
    own = np.flatnonzero((signs == 0x27) & begins[:n])
    if len(own):
        one, two = signs[np.minimum(own + 1, n - 1)], signs[np.minimum(own + 2, n - 1)]
        size = np.zeros(len(own), np.int64)
        for ending in ("s", "t", "re", "ve", "m", "ll", "d"):
            holds = one == ord(ending[0])
            if len(ending) > 1:
                holds &= two == ord(ending[1])
            size[holds & (size == 0)] = len(ending)
        own, size = own[size > 0], size[size > 0]
        begins[own + 1] = False
        begins[own + 1 + size] = True
    return np.flatnonzero(begins[:n])


#: Nothing open: bytes held, bytes missing, bounds of the next byte.
WHOLE = (0, 0, 0, 255)


def utf8_step(state: tuple[int, int, int, int], byte: int) -> tuple[int, int, int, int]:
    """The UTF-8 state machine. A byte that can't follow ends what is open, itself opening anew."""
    held, missing, low, high = state
    if missing and low <= byte <= high:
        return (held + 1, missing - 1, 0x80, 0xBF) if missing > 1 else WHOLE
    if 0xC2 <= byte <= 0xDF:
        return (1, 1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (1, 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (1, 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return WHOLE


class StreamDecoder:
    """Bytes of complete characters as soon as their tokens are in; finish() gives what is left."""

    def __init__(self, codec: Codec):
        self.codec, self.state, self.open = codec, WHOLE, b""

    def feed(self, ids: np.ndarray) -> bytes:
        codec, n = self.codec, len(ids)
        data = self.open + codec.blob[spans(codec.begins[ids], codec.lengths[ids])].tobytes()
        last = -1 if self.state != WHOLE else -2
        for i in np.flatnonzero(codec.broken[ids]).tolist():
            if i != last + 1:
                self.state = WHOLE
            self.state = codec.after(self.state, int(ids[i]))
            last = i
        if n and last != n - 1:
            self.state = WHOLE
        held = self.state[0]
        self.open = data[len(data) - held :]
        return data[: len(data) - held]

    def finish(self) -> bytes:
        rest, self.open, self.state = self.open, b"", WHOLE
        return rest


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.pattern = pattern
        self.kinds = classes() if pattern == RULE else None
        self.split = regex.compile(pattern).findall
        self.power = np.cumprod(np.full(1 << 16, ODD, np.uint64))
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int32)
        self.begins, self.blob = np.cumsum(self.lengths, dtype=np.int32) - self.lengths, np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.jumps: dict[tuple[tuple[int, int, int, int], int], tuple[int, int, int, int]] = {}
        self.broken = np.array([not self.is_whole(b) for b in self.bytes_of], dtype=bool)

    @staticmethod
    def is_whole(data: bytes) -> bool:
        try:
            data.decode()
        except UnicodeDecodeError:
            return False
        return True

    def after(self, state: tuple[int, int, int, int], token: int) -> tuple[int, int, int, int]:
        """Where a token takes the UTF-8 machine; each answer is kept (states are few)."""
        if (to := self.jumps.get((state, token))) is None:
            to = state
            for byte in self.bytes_of[token]:
                to = utf8_step(to, byte)
            self.jumps[state, token] = to
        return to

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The UTF-8 bytes of all texts, where pieces begin in them, how long they are, and how many each text has."""
        if self.kinds is None:
            found = [[p.encode() for p in self.split(t)] for t in texts]
            data = np.frombuffer(b"".join(p for own in found for p in own), np.uint8)
            count = np.array([len(p) for own in found for p in own], np.int32)
            return data, np.cumsum(count, dtype=np.int32) - count, count, np.array([len(own) for own in found], np.int64)
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        signs = np.full(int(ends[-1]) + 1, END_SIGN, np.uint32)
        inside = np.ones(len(signs), bool)
        inside[ends] = False
        signs[inside] = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        kind = self.kinds[signs]
        begin = pieces(signs, kind)
        if len(data) == int(sizes.sum()):
            before = begin - np.searchsorted(ends, begin)
        else:
            width = 1 + (signs >= 0x80).astype(np.uint8) + (signs >= 0x800) + (signs >= 0x10000)
            width[ends] = 0
            before = (np.cumsum(width, dtype=np.int32) - width)[begin]
        first = before.astype(np.int32)
        count = np.append(first[1:], np.int32(len(data))) - first
        real = kind[begin] != END
        begin, first, count = begin[real], first[real], count[real]
        return data, first, count, np.diff(np.searchsorted(begin, ends), prepend=0)

    def distinct(self, data: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that stand for all equal ones, and which of them stands for each. Hashes propose, bytes decide."""
        n = len(data)
        while len(self.power) < n + 1:
            self.power = np.concatenate((self.power, self.power * self.power[-1]))
        power = self.power[: n + 1]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        mark = (sums[first + count] - sums[first]) * power[n - first] ^ count.astype(np.uint64)
        _, one, back = np.unique(mark, return_index=True, return_inverse=True)
        stands = one[back]
        same = count == count[stands]
        if same.all():
            unlike = data != data[spans(first[stands], count)]
            if unlike.any():
                same[np.repeat(np.arange(len(first)), count)[unlike]] = False
        else:
            same[:] = stands == np.arange(len(first))
        if not same.all():
            alone = np.flatnonzero(~same)
            back[alone] = len(one) + np.arange(len(alone))
            one = np.concatenate((one, alone))
        return one, back

    def encode_slab(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and how many each has."""
        data, first, count, per_text = self.cut(texts)
        if not len(first):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int32)
        one, back = self.distinct(data, first, count)
        ids, sizes = [], []
        for at in range(0, len(one), ABREAST):
            own = one[at : at + ABREAST]
            packed = data[spans(first[own], count[own])]
            got, size = self.machine.encode_all(packed, np.cumsum(count[own], dtype=np.int32) - count[own], count[own])
            ids.append(got)
            sizes.append(size)
        size = np.concatenate(sizes)
        begin = np.cumsum(size, dtype=np.int32) - size
        out = np.concatenate(ids)[spans(begin[back], size[back])]
        total = np.concatenate(([0], np.cumsum(size[back])))
        ends = np.cumsum(per_text)
        return out, total[ends] - total[ends - per_text]

    def slabs(self, text: str) -> Iterator[str]:
        """A long text in slabs that end before white space after something else, where a piece ends in any case."""
        at = 0
        border = regex.compile(r"(?<=\S)(?=\s)")
        while len(text) - at > SLAB:
            found = border.search(text, at + SLAB) if self.kinds is not None else None
            end = found.start() if found else len(text)
            yield text[at:end]
            at = end
        yield text[at:]

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids (little-endian, 32 bits) of each text; short texts go abreast."""
        held: list[str] = []
        size = 0

        def settle() -> Iterator[np.ndarray]:
            if held:
                ids, counts = self.encode_slab(held)
                yield from np.split(ids.astype("<u4"), np.cumsum(counts)[:-1])
                held.clear()

        for text in texts:
            text = text or ""
            if len(text) > SLAB:
                yield from settle()
                size = 0
                yield np.concatenate([self.encode_slab([part])[0].astype("<u4") for part in self.slabs(text)])
                continue
            if size + len(text) > SLAB:
                yield from settle()
                size = 0
            held.append(text)
            size += len(text)
        yield from settle()

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_many([text])).tobytes()

    def decode(self, ids: np.ndarray, step: int = 1 << 16) -> Iterator[bytes]:
        stream = StreamDecoder(self)
        for i in range(0, len(ids), step):
            yield stream.feed(ids[i : i + step])
        yield stream.finish()


_codecs: dict[tuple[bytes, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """One codec a worker process: the last vocabulary that was asked for."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(parse_ranks(data), pattern)
    return _codecs[key]


def vocabulary() -> tuple[bytes, str]:
    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes(), public_tokenizers.PATTERN


def digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held.value, pattern)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for ids in own.encode_many(x.as_py() for x in batch.column(1)):
                sha = hashlib.sha256()
                for piece in own.decode(ids):
                    sha.update(piece)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", tokens: str = "token_ids") -> DataFrame:
    """The columns of `docs` but the text, and its ids as array<int>; a column called like `tokens` is replaced."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    kept = [c for c in docs.columns if c not in (text, tokens)]
    schema = StructType([*docs.select(*kept).schema.fields, StructField(tokens, ArrayType(IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held.value, pattern)
        for batch in batches:
            found, done, size = [], 0, 0

            def part(found: list[np.ndarray], rows: pa.RecordBatch) -> pa.RecordBatch:
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                values = pa.array(np.concatenate([np.zeros(0, "<i4"), *(f.view("<i4") for f in found)]))
                return pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], pa.ListArray.from_arrays(pa.array(ends), values)], [*kept, tokens])

            for ids in own.encode_many(x.as_py() for x in batch.column(len(kept))):
                found.append(ids)
                size += len(ids)
                if size > SLAB:
                    yield part(found, batch.slice(done, len(found)))
                    found, done, size = [], done + len(found), 0
            yield part(found, batch.slice(done, len(found)))

    return docs.select(*kept, text).mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = vocabulary()
    return digests(table(spark, sf_dir, "documents"), ranks, pattern)
