"""Byte-level BPE by prefix dynamic programming.

A text is cut into the pieces of the public pattern (``public_tokenizers.PATTERN``); each
piece is encoded by itself.  Of every byte prefix of a piece only one thing is
stored: the last token of the prefix's encoding.  It is unique, because an
encoding is right exactly if each of its tokens encodes to itself and each two
neighbours, encoded together, stay these two.  So the last token of prefix
``i`` is the one token that ends there and fits the stored last token of the
prefix before it; following the stored tokens back gives the encoding.  A pair's
verdict is found once by merging its bytes in rank order.  Pieces new to a task
are encoded together, one prefix length at a time: a trie gives the tokens that
end there (an Aho-Corasick scan for single and for very long pieces).

The stored prefixes stay right when bytes are appended (``Prefixes.extend``),
and an edit leaves the ones before it and, as splitting forgets what lies
before a piece, the pieces after the first common boundary (``edited``;
``re_encode`` applies both to a table of earlier encodings).

Rank files may hold tokens that no merges reach; like the library that reads
such files, a piece equal to such a token is that token.  The classes of
characters (letter, number, space) are read from that library once on the driver, so
both know the same Unicode version; the table (1.1 MB) and the vocabulary (a
file named by the caller) are the only broadcasts, and neither depends on the data.

Scale: encoding and decoding run in the scan; there is no shuffle.  A task
keeps a bounded number of distinct pieces and pairs and handles texts in runs of
about 256 KB; a text longer than that is a run of its own.

Defined cases: null and empty texts have no ids and decode to no bytes; rows
are handled one by one, so repeated rows, null ids and an empty table need no rule;
new columns take a free name, other columns pass through; bytes that are not UTF-8
are read as U+FFFD; a byte that the vocabulary lacks raises ``ValueError``; ids that
it lacks raise ``KeyError`` in decoding.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tempora.llm import bytewords as bw

PIECES = 120_000
PAIRS = 150_000
TABLE_BITS = 18
LONG = 64
BATCH_ROWS = 512
START = -2
NEVER = 1 << 62
OTHER, LETTER, NUMBER, SPACE = range(4)
#: fixed values: the contractions of the public pattern, in its order
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@dataclass
class Vocabulary:
    """Token bytes and their ranks, the pattern, and the class of every code point."""
    ranks: dict[bytes, int]
    pattern: str
    classes: np.ndarray = field(repr=False)
    key: str = ""

    def __post_init__(self):
        """``key`` names the contents: workers keep one encoder for it, whatever copy they are sent."""
        told = b"".join(b"%d %d " % (r, len(t)) + t for t, r in self.ranks.items())
        self.key = hashlib.sha256(told + self.pattern.encode() + self.classes.tobytes()).hexdigest()


def load(path: str) -> Vocabulary:
    """A rank file: one base64 token and its rank a line."""
    import public_tokenizers
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Vocabulary(ranks, public_tokenizers.PATTERN, character_classes(public_tokenizers.PATTERN))


def character_classes(pattern: str) -> np.ndarray:
    """Class of every code point, as tiktoken's pattern engine has it.

    After a letter, a digit or a mark a character joins the piece only if it is
    of that class; a vocabulary of bytes and of pairs (probe, first byte) shows it.
    """
    import tiktoken
    out = np.zeros(0x110000, np.uint8)
    for cls, p in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        out[[c for c in range(128) if regex.match(p, chr(c))]] = cls
    ranks = {bytes([b]): b for b in range(256)}
    for k, probe in enumerate(b"a1!"):
        ranks |= {bytes([probe, b]): 256 * (k + 1) + b for b in range(256)}
    engine = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    # planes 4 to 13 are unassigned; 14 holds tags and selectors, 15 and 16 are for private use: all OTHER
    points = np.concatenate((np.arange(0x80, 0xD800), np.arange(0xE000, 0x40000)))
    for part in np.array_split(points, 8):
        ids = np.array(engine.encode_ordinary("".join(f"a{c}\n1{c}\n!{c}\n" for c in map(chr, part.tolist()))))
        probe = np.isin(ids, np.frombuffer(b"a1!", np.uint8)) | (ids >= 256)
        letter, number, other = (ids[probe] >= 256).reshape(-1, 3).T
        out[part] = np.select([letter, number, other], [LETTER, NUMBER, OTHER], SPACE)
    return out


def merged(ranks: dict[bytes, int], data: bytes) -> list[bytes]:
    """Tokens of some bytes by merging the neighbours of lowest rank, leftmost first."""
    parts = [data[i:i + 1] for i in range(len(data))]
    pairs = [ranks.get(data[i:i + 2], NEVER) for i in range(len(data) - 1)]
    while pairs and (best := min(pairs)) < NEVER:
        i = pairs.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
    return parts


class Trie:
    """Vocabulary tokens as arrays: every token that begins at any position of some texts, all positions in step."""

    def __init__(self, tokens: dict[bytes, int]):
        nodes, token = {b"": 1}, [-1, -1]       # node 0: none
        for t, rank in tokens.items():
            for k in range(1, len(t) + 1):
                if t[:k] not in nodes:
                    nodes[t[:k]] = len(token)
                    token.append(-1)
            token[nodes[t]] = rank
        inner = np.zeros(len(token), np.int32)      # row of a node's children; row 0 has none
        parents = {t[:-1] for t in nodes if t}
        for row, t in enumerate(parents, 1):
            inner[nodes[t]] = row
        child = np.zeros((len(parents) + 1, 256), np.int32)
        for t, node in nodes.items():
            if t:
                child[inner[nodes[t[:-1]]], t[-1]] = node
        self.inner, self.child, self.token = inner, child, np.array(token, np.int64)

    def matches(self, data: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, token); ``limit`` is the end of each byte's text."""
        at, row, out = np.arange(len(data)), np.full(len(data), self.inner[1]), []
        for k in range(len(data)):
            node = self.child[row, data[at + k]]
            token = self.token[node]
            hit = token >= 0
            out.append((at[hit], np.full(int(hit.sum()), k + 1), token[hit]))
            row = self.inner[node]
            go = (row > 0) & (at + k + 1 < limit[at])
            at, row = at[go], row[go]
            if not len(at):
                break
        return tuple(np.concatenate(x) for x in zip(*out))


class Prefixes:
    """The last token of every prefix of a growing byte string."""

    __slots__ = ("encoder", "data", "last")

    def __init__(self, encoder: "Encoder", data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", []
        self.extend(data)

    def extend(self, more: bytes) -> "Prefixes":
        """Append bytes; the stored prefixes stay as they are."""
        if more:
            first = len(self.data)
            self.data += more
            self.encoder.fill(self.data, self.last, first)
        return self

    def cut(self, size: int) -> "Prefixes":
        """Keep the first ``size`` bytes."""
        self.data = self.data[:size]
        del self.last[size:]
        return self

    def ids(self) -> list[int]:
        return self.encoder.ids_of(self.data, self.last)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.ranks, self.classes = vocabulary.ranks, vocabulary.classes
        self.pattern = regex.compile(vocabulary.pattern)
        self.size = {r: len(t) for t, r in self.ranks.items()}
        self.token = {r: t for t, r in self.ranks.items()}
        self.base = max(self.token, default=0) + 1
        #: tokens that merging reaches; only they occur inside an encoding
        self.reached = {t for t in self.ranks if merged(self.ranks, t) == [t]}
        self.longest = max(map(len, self.reached), default=1)
        self.pairs: dict[int, bool] = {}
        # the same in arrays: token sizes, ends of tokens, and a table of pairs met before
        self.sizes = np.zeros(self.base, np.int64)
        self.sizes[list(self.size)] = list(self.size.values())
        self.ends = ahocorasick.Automaton()
        for t in self.reached:
            self.ends.add_word(t.decode("latin-1"), self.ranks[t])
        if self.reached:
            self.ends.make_automaton()
        self.trie = Trie({t: self.ranks[t] for t in self.reached})
        self.table, self.verdict = np.full(1 << TABLE_BITS, -1, np.int64), np.zeros(1 << TABLE_BITS, bool)
        self.forget()

    def forget(self) -> None:
        """Empty the pool of encoded pieces."""
        self.index: dict[bytes, int] = {}
        self.pool, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens stay as they are when their bytes are encoded together."""
        key = a * self.base + b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            x, y = self.token[a], self.token[b]
            ok = self.pairs[key] = merged(self.ranks, x + y) == [x, y]
        return ok

    def fill(self, data: bytes, last: list, first: int) -> None:
        """Last tokens of the prefixes of more than ``first`` bytes; ``last`` holds the others."""
        n, done, pairs, base = len(data), first, self.pairs, self.base
        back = max(0, first - self.longest + 1)
        last.extend([-1] * (n - first))
        for end, token in self.ends.iter(data[back:].decode("latin-1")):   # by end, longest first
            end += back
            if end < done:
                continue
            before = end - self.size[token]
            if before >= 0:
                a = last[before]
                ok = pairs.get(a * base + token)
                if not (self.fits(a, token) if ok is None else ok):
                    continue
            last[end] = token
            done = end + 1
        if -1 in last[first:]:
            raise ValueError("the vocabulary has no token for a byte")

    def ids_of(self, data: bytes, last: list) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        out, at = [], len(last) - 1
        while at >= 0:
            out.append(last[at])
            at -= self.size[last[at]]
        return out[::-1]

    def piece(self, data: bytes) -> tuple:
        """Ids of one piece."""
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        last: list[int] = []
        self.fill(data, last, 0)
        return tuple(self.ids_of(data, last))

    def verdicts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fits`` for many pairs; ``START`` fits everything."""
        key = a * self.base + b
        slot = (key.astype(np.uint64) * np.uint64(bw.BYTE_BASE) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        ok = (a == START) | ((self.table[slot] == key) & self.verdict[slot])
        unknown = np.flatnonzero((self.table[slot] != key) & (a != START))
        if len(unknown):
            keys, where = np.unique(key[unknown], return_inverse=True)
            found = np.array([self.fits(*divmod(k, self.base)) for k in keys.tolist()])[where]
            ok[unknown], self.table[slot[unknown]], self.verdict[slot[unknown]] = found, key[unknown], found
        return ok

    def batch(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of pieces of at most ``LONG`` bytes: all take their next byte together."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.cumsum(size) - size
        begin, length, token = self.trie.matches(np.frombuffer(b"".join(pieces), np.uint8), np.repeat(start + size, size))
        order = np.argsort((begin + length) * (LONG + 1) - length, kind="stable")      # by end, longest first
        begin, length, token = begin[order], length[order], token[order]
        end = begin + length
        owner = np.repeat(np.arange(len(pieces)), size)
        step, begin, end = end - start[owner[begin]], begin + owner[begin], end + owner[begin]
        head = np.flatnonzero(np.diff(end, prepend=-1))
        turn = np.arange(len(end)) - np.repeat(head, np.diff(head, append=len(end)))
        turns = int(turn.max(initial=0)) + 1
        turn += step * turns
        order = np.argsort(turn.astype(np.uint16) if (LONG + 1) * turns < 1 << 16 else turn, kind="stable")
        groups = np.flatnonzero(np.diff(turn[order], prepend=-1)).tolist()
        # last[start + owner + i]: last token of the piece's first i bytes
        first = start + np.arange(len(pieces))
        last = np.full(int(size.sum()) + len(pieces), -1, np.int64)
        last[first] = START
        for lo, hi in zip(groups, [*groups[1:], len(order)]):
            at = order[lo:hi]
            at = at[last[end[at]] == -1]
            at = at[self.verdicts(last[begin[at]], token[at])]
            last[end[at]] = token[at]
        if (last == -1).any():
            raise ValueError("the vocabulary has no token for a byte")
        at, rows, taken, count = first + size, np.arange(len(pieces)), [], np.zeros(len(pieces), np.int64)
        while len(rows):
            t = last[at]
            taken.append((rows, t))
            count[rows] += 1
            at = at - self.sizes[t]
            go = at > first[rows]
            rows, at = rows[go], at[go]
        ends = np.cumsum(count)
        ids = np.zeros(int(count.sum()), np.int32)
        for k, (rows, t) in enumerate(taken):
            ids[ends[rows] - 1 - k] = t
        return ids, ends

    def learn(self, keys: list) -> None:
        """Encode distinct new pieces into the pool; a key is a piece or, up to seven bytes, its number."""
        pieces = [k if isinstance(k, bytes) else (k & (1 << 56) - 1).to_bytes(7, "little")[:k >> 56] for k in keys]
        whole = [len(p) > LONG or p in self.ranks for p in pieces]
        short = [p for p, w in zip(pieces, whole) if not w]
        ids, ends = self.batch(short) if short else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        more = [self.piece(p) for p, w in zip(pieces, whole) if w]
        sizes = np.concatenate((np.diff(ends, prepend=0), np.fromiter(map(len, more), np.int64, len(more))))
        order = [k for k, w in zip(keys, whole) if not w] + [k for k, w in zip(keys, whole) if w]
        have = len(self.first) - 1
        self.index.update(zip(order, range(have, have + len(order))))
        self.pool = np.concatenate((self.pool, ids, np.fromiter(chain.from_iterable(more), np.int32)))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(sizes)))

    def encoded(self, raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, end of each piece's); distinct ones are encoded once."""
        data, size = np.frombuffer(raw, np.uint8), np.diff(starts, append=len(raw))
        short = size <= 7
        begin, width = starts[short], size[short]
        number = width.astype(np.uint64) << np.uint64(56)
        for k in range(7):
            has = width > k
            number[has] |= data[begin[has] + k].astype(np.uint64) << np.uint64(8 * k)
        distinct, where = np.unique(number, return_inverse=True)
        keys = distinct.tolist()
        long = [raw[a:b] for a, b in zip(starts[~short].tolist(), (starts + size)[~short].tolist())]
        new = [k for k in chain(keys, set(long)) if k not in self.index]
        if len(self.index) + len(new) > PIECES:
            self.forget()
            new = [*keys, *set(long)]
        if new:
            self.learn(new)
        at = np.zeros(len(starts), np.int64)
        at[short] = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))[where]
        at[~short] = np.fromiter(map(self.index.__getitem__, long), np.int64, len(long))
        size = self.first[at + 1] - self.first[at]
        ends = np.cumsum(size)
        where = np.arange(int(size.sum())) + np.repeat(self.first[at] - ends + size, size)
        return self.pool[where], ends

    def boundaries(self, text: str, offsets: np.ndarray | None = None) -> np.ndarray:
        """Character positions where pieces begin, for texts one after another.

        ``offsets`` are the texts' ends in characters (default: one text).
        """
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        cls = self.classes[points]
        first = np.zeros(n + 1, bool)           # where a text begins; the end counts too
        first[0] = first[n] = True
        if offsets is not None:
            first[offsets] = True
        new = first.copy()                      # where a run of one class begins
        new[1:n] |= cls[1:] != cls[:-1]
        begins = new[:n].copy()
        space = cls == SPACE
        blank = points == 0x20
        # the last of some spaces before another class in its text
        final = space & new[1:] & ~first[1:]
        begins |= final
        at = np.flatnonzero(final & blank) + 1
        begins[at] = False                      # a blank goes with what follows
        quote = np.flatnonzero((points == 0x27) & new[:n])
        quote = quote[first[quote] | ~blank[quote - 1]]
        if len(quote):
            room = np.searchsorted(np.flatnonzero(first), quote, "right")
            end = np.flatnonzero(first)[room]
            padded = np.concatenate((points, [0, 0, 0]))
            one, two = padded[quote + 1], padded[quote + 2]
            found = np.zeros(len(quote), np.int64)
            for c in CONTRACTIONS:
                hit = (one == ord(c[0])) & (quote + len(c) < end)
                if len(c) == 2:
                    hit &= two == ord(c[1])
                found[hit & (found == 0)] = len(c)
            quote, found = quote[found > 0], found[found > 0]
            begins[quote + 1] = False
            after = quote + 1 + found
            begins[after[after < n]] = True
        return np.flatnonzero(begins)

    def run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a run, end of each text's ids)."""
        raw = data.tobytes()
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:])]
            raw = b"".join(texts)
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            data, text = np.frombuffer(raw, np.uint8), raw.decode()
        if len(text) == len(raw):
            starts = self.boundaries(text, offsets[:-1])
        else:
            lead = np.flatnonzero((data & 0xC0) != 0x80)        # byte position of each character
            starts = lead[self.boundaries(text, np.searchsorted(lead, offsets[:-1]))]
        ids, ends = self.encoded(raw, starts)
        return ids, np.concatenate(([0], ends))[np.searchsorted(starts, offsets[1:])]

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text."""
        raw = (text or "").encode("utf-8", "replace")
        return self.run(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()

    def edited(self, old: str, ids: list[int], new: str) -> list[int]:
        """Ids of ``new`` from those of ``old``; only pieces near their differences are encoded."""
        head = _common(old, new)
        tail = _common(old[head:][::-1], new[head:][::-1])
        # pieces of the old text: what ends well before the edit was decided without it
        raw, keep_ids, keep_at = old.encode(), 0, 0
        ends, at, byte_at = [], 0, 0
        sizes = np.cumsum([self.size[i] for i in ids])
        for m in self.pattern.finditer(old):
            byte_at += len(m.group().encode())
            upto = int(np.searchsorted(sizes, byte_at)) + 1
            ends.append((m.start(), m.end(), upto))
        assert byte_at == len(raw)
        for start, end, upto in ends:
            if end >= head or start > head - 4:
                break
            keep_at, keep_ids = end, upto
        shift = len(new) - len(old)
        known = {end + shift: upto for _, end, upto in ends if end >= len(old) - tail}
        out, pieces = list(ids[:keep_ids]), []
        rest: list[int] = []
        grown = next((e for e in ends if e[0] == keep_at), None)
        for m in self.pattern.finditer(new, keep_at):
            piece = m.group().encode()
            if grown is not None and m.start() == keep_at:
                # the first piece may have grown: its unchanged prefix keeps its last tokens
                before = old[grown[0]:grown[1]].encode()
                same = len(old[grown[0]:max(grown[0], min(head, grown[1], m.end()))].encode())
                state = Prefixes(self, before).cut(same).extend(piece[same:])
                pieces.append(tuple(state.ids()))
            else:
                pieces.append(self.piece(piece))
            if m.end() in known:
                rest = ids[known[m.end()]:]
                break
        return out + list(chain.from_iterable(pieces)) + list(rest)


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


_WORKER: dict = {}


def _encoder(shared) -> Encoder:
    """A worker's encoder; it outlives a task, so later tasks find its pieces."""
    vocabulary = shared.value
    if vocabulary.key not in _WORKER:
        _WORKER.clear()
        _WORKER[vocabulary.key] = Encoder(vocabulary)
    return _WORKER[vocabulary.key]


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", name: str = "ids") -> tuple[DataFrame, str]:
    """All columns and the ids of each text; returns (table, name of the new column)."""
    shared, name = docs.sparkSession.sparkContext.broadcast(vocabulary), bw.fresh(docs, name)

    def make():
        encoder = _encoder(shared)

        def run(column):
            ids, sizes, done = [], [np.zeros(1, np.int64)], 0
            for _, _, data, off in bw.runs(column):
                got, ends = encoder.run(data, off)
                ids.append(got)
                sizes.append(ends + done)
                done += len(got)
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            return [pa.ListArray.from_arrays(pa.array(np.concatenate(sizes), pa.int32()), pa.array(values, pa.int32()))]
        return run
    return bw.append_columns(docs, text_col, [T.StructField(name, T.ArrayType(T.IntegerType()))], make, BATCH_ROWS), name


def decode(table: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", name: str = "bytes") -> tuple[DataFrame, str]:
    """All columns and the bytes that the ids stand for (null ids: none); returns (table, name)."""
    tokens = sorted((r, t) for t, r in vocabulary.ranks.items())
    shared, name = table.sparkSession.sparkContext.broadcast(tokens), bw.fresh(table, name)

    def make():
        token = shared.value
        rank = np.array([r for r, _ in token] + [-1])
        size = np.array([len(t) for _, t in token])
        first = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(t for _, t in token), np.uint8)

        def some(ids):
            at = np.searchsorted(rank[:-1], ids)
            if (rank[at] != ids).any():
                raise KeyError(f"the vocabulary has no token {ids[rank[at] != ids][0]}")
            n = size[at]
            return pool[np.arange(int(n.sum())) + np.repeat(first[at] - np.cumsum(n) + n, n)].tobytes()

        def run(column):
            return [pa.array([some(ids) for ids in _lists(column)], pa.binary())]
        return run
    return bw.append_columns(table, ids_col, [T.StructField(name, T.BinaryType())], make, BATCH_ROWS), name


def _lists(column: pa.Array):
    """The lists of a column as arrays; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pa.array([x or [] for x in column.to_pylist()], column.type)
    values, off = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip(off[:-1], off[1:]):
        yield values[a:b]


def re_encode(table: DataFrame, vocabulary: Vocabulary, old_col: str, ids_col: str, new_col: str, name: str = "new_ids") -> tuple[DataFrame, str]:
    """All columns and the ids of ``new_col``, found from the earlier text and its ids."""
    shared, name = table.sparkSession.sparkContext.broadcast(vocabulary), bw.fresh(table, name)
    schema = T.StructType(table.schema.fields + [T.StructField(name, T.ArrayType(T.IntegerType()))])
    at = [table.columns.index(c) for c in (old_col, ids_col, new_col)]

    def run(batches):
        encoder = _encoder(shared)
        for b in batches:
            old, ids, new = (b.column(i).to_pylist() for i in at)
            got = [encoder.edited(o or "", i or [], n or "") if o is not None and i is not None else encoder.encode(n)
                   for o, i, n in zip(old, ids, new)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.int32()))], names=schema.names)
    return table.mapInArrow(run, schema), name
