"""Byte-level BPE encoding and decoding by backtracking over longest matches.

The bytes of a piece are read as Latin-1 so that pyahocorasick, which works on characters, can find
every vocabulary entry in one pass.  Encoding walks from the left with the longest entry, keeps it if
it may stand next to the token before it, else tries the entry's longest proper prefix in the
vocabulary, else gives up the token before.  Two tokens may be neighbours if plain merging of their
joint bytes gives just these two; that test is memoised.  A position found to be a dead end is never
entered again, so the walk is linear in the piece, and the result equals that of applying the merges
by rank.

Of a batch of texts each different stretch between two spaces is encoded once, where the pattern cuts at
the spaces; equal stretches are found by hashes of 64 bits.

Nulls count as empty texts (no token); texts of any length are encoded whole.  Rows that repeat an id are
encoded one by one.  Other columns are not looked at.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from provena.llm.common import id_text, map_arrow, span_hashes, table, text_buffer

#: Half the chunks, of at most 64 characters, that a worker remembers in each of two generations; some 250 bytes each, 200 MB in all.
CACHE = 200_000
#: Token pairs that a worker remembers, some 150 bytes each.
PAIRS = 200_000
_UNEVEN = re.compile(r"\s | \s|^ | $").search


class Remembered(dict):
    """make(key) for each key, kept in two generations so that memory is bounded and frequent keys stay."""

    def __init__(self, make, most: int = CACHE):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > 64:
                return got
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got

    def many(self, keys: list, make) -> list:
        """The values of keys; make(missing keys) gives those that are not remembered, in order."""
        got = [self.get(k) or self.old.get(k) for k in keys]
        gone = [i for i, x in enumerate(got) if x is None]
        for i, x in zip(gone, make([keys[i] for i in gone]), strict=True):
            got[i] = x
            if len(keys[i]) <= 64:
                if len(self) >= self.most:
                    self.old = dict(self)
                    self.clear()
                self[keys[i]] = x
        return got


def chunks_apart(text: str) -> bool:
    """Whether no piece of the pattern crosses a cut before a space.

    A space before a non-space always begins a piece; beside other white space it need not."""
    return not _UNEVEN(text)


def chunks(text: str) -> list[str] | None:
    """text cut before each space, without the spaces, if pieces stay whole; else None."""
    return text.split(" ") if chunks_apart(text) else None


def repeated_chunks(texts: list[str], arrow: pa.Array, fair: list[bool]) -> tuple[list[str], np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The different chunks of the fair texts, for each whether it begins a text, which chunk stands where, and the
    range of places of each text.

    Found by hashes of all chunks at once, so that a chunk is looked up once for a batch of texts."""
    buf, off = text_buffer(arrow)
    spaces = np.flatnonzero(buf == 32)
    count = np.searchsorted(spaces, off[1:]) - np.searchsorted(spaces, off[:-1]) + 1
    starts, ends = np.sort(np.r_[off[:-1], spaces + 1]), np.sort(np.r_[spaces, off[1:]])
    begin = np.cumsum(count) - count
    first = np.zeros(len(starts), bool)
    first[begin] = True
    use = np.repeat(np.array(fair, bool), count)
    starts, ends, first = starts[use], ends[use], first[use]
    _, at, which = np.unique(span_hashes(buf, starts, ends) + first.astype(np.uint64), return_index=True, return_inverse=True)
    raw = buf.tobytes()
    made = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
    last = np.cumsum(np.where(fair, count, 0))
    return made, first[at], which, list(zip((last - np.where(fair, count, 0)).tolist(), last.tolist(), strict=True))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteCoder:
    """Encoder and decoder for one table of ranks, in which every single byte has a rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.words = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.found = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.found.add_word(b.decode("latin-1"), i)
        self.found.make_automaton()
        size = max(ranks.values()) + 1
        self.lengths, self.prefixes = np.zeros(size + 1, np.int64), np.full(size + 1, -2, np.int64)
        self.lengths[list(self.length)] = list(self.length.values())
        #: Recent answers of may_meet, one for each slot of a hash.
        self.asked, self.answers = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self._halves: dict[int, tuple[int, int]] = {}
        self._shorter: dict[int, int] = {}
        self._may_meet: dict[tuple[int, int], bool] = {}
        self.spaced = Remembered(lambda s: tuple(self.pieces(" " + s)))

    def merged(self, data: bytes, below: int) -> list[int]:
        """Plain merging of single bytes by ranks under ``below``; only used on vocabulary entries."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge into this one joins; the token twice if it has none."""
        got = self._halves.get(token)
        if got is None:
            parts = self.merged(self.words[token], token) if self.length[token] > 1 else [token]
            got = self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else (token, token)
        return got

    def shorter(self, token: int) -> int:
        """The longest vocabulary entry that is a proper prefix, or -1."""
        got = self._shorter.get(token)
        if got is None:
            b = self.words[token]
            got = self._shorter[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), -1)
        return got

    def may_meet(self, left: int, right: int) -> bool:
        """Whether merging keeps these neighbours apart.

        Undo the merges on both sides of the border, the latest first, and ask each time whether the
        two tokens at the border would have merged before that."""
        key = (left, right)
        got = self._may_meet.get(key)
        if got is not None:
            return got
        if len(self._may_meet) >= PAIRS:
            self._may_meet.clear()
        a, b, bound, words, ranks = left, right, 1 << 60, self.words, self.ranks
        ok = True
        while True:
            if ranks.get(words[a] + words[b], bound) < bound:
                ok = False
                break
            ha, hb = self.halves(a), self.halves(b)
            whole_a, whole_b = ha[0] == a, hb[0] == b
            if whole_a and whole_b:
                break
            if not whole_a and (whole_b or a > b):
                bound, a = a, ha[1]
            else:
                bound, b = b + 1, hb[0]  # a merge on the left of the same rank comes first
        self._may_meet[key] = ok
        return ok

    def walk(self, data: bytes) -> list[int]:
        """The tokens of one piece."""
        n, length = len(data), self.length
        longest = [-1] * n
        for end, token in self.found.iter(data.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # later ends are longer
        dead = bytearray(n + 1)
        known, prefix = self._may_meet.get, self._shorter.get
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            before = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                ok = not dead[end]
                if ok and before >= 0:
                    ok = known((before, token))
                    if ok is None:
                        ok = self.may_meet(before, token)
                if ok:
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                less = prefix(token)
                token = self.shorter(token) if less is None else less
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("a byte is missing from the vocabulary")
                last = out.pop()
                at -= length[last]
                token = self.shorter(last)
        return out

    def meet_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """may_meet of many neighbours."""
        key = left << 24 | right
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        new = np.unique(key[self.asked[slot] != key])
        if len(new):
            told = np.array([self.may_meet(k >> 24, k & 0xFFFFFF) for k in new.tolist()])
            out = np.where(self.asked[slot] == key, self.answers[slot], False)
            miss = np.flatnonzero(self.asked[slot] != key)
            out[miss] = told[np.searchsorted(new, key[miss])]
            self.asked[slot[miss]], self.answers[slot[miss]] = key[miss], out[miss]
            return out
        return self.answers[slot]

    def shorter_many(self, token: np.ndarray) -> np.ndarray:
        for t in np.unique(token[self.prefixes[token] == -2]).tolist():
            self.prefixes[t] = self.shorter(t)
        return self.prefixes[token]

    def walk_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """walk() of many pieces, step by step together: all tokens in order, and how many each piece has."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        end = np.cumsum(size)
        begin, data = end - size, b"".join(pieces)
        owner, length = np.repeat(np.arange(len(pieces)), size), self.lengths
        found = np.fromiter(chain.from_iterable(self.found.iter(data.decode("latin-1"))), np.int64).reshape(-1, 2)
        last, token = found[:, 0], found[:, 1]
        start = last + 1 - length[token]
        own = owner[start] == owner[last]  # in one piece
        longest = np.full(len(data) + 1, -1)
        longest[start[own]] = token[own]  # later ends are longer
        dead, ending = np.zeros(len(data) + 1, bool), np.full(len(data) + 1, -1)
        at, token, before = begin.copy(), longest[begin], np.full(len(pieces), -1)
        live = np.flatnonzero(size)
        while len(live):
            t, b, p = token[live], before[live], at[live]
            has = t >= 0
            e = np.where(has, p + length[t], p)
            ok = has & ~dead[e]
            ask = np.flatnonzero(ok & (b >= 0))
            ok[ask] = self.meet_many(b[ask], t[ask])
            i, e, t = live[ok], e[ok], t[ok]
            ending[e], at[i], before[i], token[i] = t, e, t, longest[e]
            no = has & ~ok
            token[live[no]] = self.shorter_many(token[live[no]])
            if not has.all():
                i, p, b = live[~has], p[~has], b[~has]
                if (b < 0).any():
                    raise ValueError("a byte is missing from the vocabulary")
                dead[p] = True
                at[i] = p - length[b]
                token[i] = self.shorter_many(b)
                before[i] = np.where(at[i] > begin[i], ending[at[i]], -1)
            live = live[at[live] < end[live]]
        chosen, live = np.full(len(data) + 1, -1), np.flatnonzero(size)
        while len(live):  # back along the tokens
            t = ending[end[live]]
            end[live] -= length[t]
            chosen[end[live]] = t
            live = live[end[live] > begin[live]]
        where = np.flatnonzero(chosen >= 0)
        return chosen[where], np.bincount(owner[where], minlength=len(pieces))

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """encode() of many short texts: all tokens in order, and how many each text has."""
        cut = [self.find(t) for t in texts]
        data = [s.encode("utf-8", "surrogatepass") for c in cut for s in c]
        whole = np.fromiter((self.ranks.get(d, -1) for d in data), np.int64, len(data))
        part = np.flatnonzero(whole < 0)
        tokens, n = self.walk_many([data[i] for i in part.tolist()])
        count = np.ones(len(data), np.int64)
        count[part] = n
        out = np.repeat(whole, count)
        out[out < 0] = tokens
        ends = np.r_[0, np.cumsum(count)][np.cumsum([0, *map(len, cut)])]
        return out, np.diff(ends)

    def pieces(self, text: str) -> list[int]:
        """Each match of the pattern by itself; one that is a vocabulary entry is that entry."""
        out: list[int] = []
        for s in self.find(text):
            data = s.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            out += self.walk(data) if whole is None else (whole,)
        return out

    def encode(self, text: str) -> list[int]:
        cut = chunks(text)
        if cut is None:
            return self.pieces(text)
        out = self.pieces(cut[0])
        out.extend(chain.from_iterable(map(self.spaced.__getitem__, cut[1:])))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


@contextmanager
def no_cycles():
    """No search for cycles where none are made, which would take a third of the time; on again after."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteCoder:
    return ByteCoder(read_ranks(path), pattern)


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded (binary, made from the ids) of every row; one row each.

    Rows that repeat an id stay separate.  An empty or null text has no ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in it:
            ids = [c.encode(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(i) for i in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return map_arrow(id_text(df, id_col, text_col), run, "doc_id long, ids array<int>, decoded binary")


class Digests:
    """(tokens, their names joined by spaces, their bytes) of texts, a chunk at a time."""

    def __init__(self, c: ByteCoder):
        self.c, self.names = c, {i: str(i).encode() for i in c.words}
        self.spaced = Remembered(None, 2 * CACHE)

    def many(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        ids, n = self.c.encode_many(texts)
        names, words = (list(map(of.__getitem__, ids.tolist())) for of in (self.names, self.c.words))
        ends = np.cumsum(n).tolist()
        return [(j - i, b" ".join(names[i:j]), b"".join(words[i:j])) for i, j in zip([0, *ends], ends, strict=False)]

    def __call__(self, arrow: pa.Array) -> Iterator[tuple[int, str, str]]:
        texts = arrow.to_pylist()
        fair = [chunks_apart(t) for t in texts]
        made, first, which, ranges = repeated_chunks(texts, arrow, fair)
        known: list = [None] * len(made)
        for begins, make in ((False, lambda keys: self.many([" " + k for k in keys])), (True, None)):
            at = np.flatnonzero(first == begins).tolist()
            keys = [made[i] for i in at]
            for i, x in zip(at, self.many(keys) if begins else self.spaced.many(keys, make), strict=True):
                known[i] = x
        counts, names, raw = ([k[i] for k in known] for i in range(3))
        tokens = np.r_[0, np.cumsum(np.array(counts, np.int64)[which])] if len(which) else np.zeros(1, np.int64)
        places = which.tolist()
        for t, ok, (i, j) in zip(texts, fair, ranges, strict=True):
            if ok:
                n, one, two = int(tokens[j] - tokens[i]), b" ".join(map(names.__getitem__, places[i:j])), b"".join(map(raw.__getitem__, places[i:j]))
            else:
                ((n, one, two),) = self.many([t])
            yield n, hashlib.sha256(one).hexdigest(), hashlib.sha256(two).hexdigest()


@lru_cache(maxsize=2)
def digests(path: str, pattern: str) -> Digests:
    return Digests(coder(path, pattern))


def encode_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents, but only count and digests leave the worker."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = digests(path, pattern)
        for b in it:
            with no_cycles():
                count, one, two = zip(*make(b["text"]), strict=True)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(count, pa.int64()), pa.array(one), pa.array(two)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(id_text(df, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
