"""Language-model scoring with a log-frequency Bloom filter.

The model has words, pairs and triples.  Pairs and triples enter with a count of at least ``least``: 1 in
op1_lm, so all of them; ``LEAST`` if fit() is not told.  A count is kept as its level, by its power of two,
and stands for the mean of the counts of that level.  The filter holds (n-gram, 1) .. (n-gram, level); a
query probes level after level until one is missing, so a count is found by repeated membership probes and
only errs upwards.  An entry is four bits in each of two words of 64 bits, so a probe reads two places.

Probabilities are Witten-Bell smoothed, with quantised counts throughout so that they sum to one:
P(w|h) = (m(h,w) + t(h) P(w|h')) / (s(h) + t(h)), where m is the mean count of the n-gram's level, 0 if it is
not kept, s(h) the sum of m over the kept followers of h, t(h) their number, and h' is h without its first
word.  Without kept followers P(w|h) = P(w|h').  A word has (c + 0.5) / (n + 0.5 (v + 1)) with its exact
count; all unknown words are one event.  The end of a text is a word, and each text begins after an end.
A context with one kept follower has its level in the filter, and a second entry against false
positives; s and t of the others are beside the filter, exact.  What is left of error is the filter's:
an n-gram that is not kept passes with a rate of some 5e-4.

Training gathers word, pair and triple counts of all training documents, pre-aggregated in each task, in
buckets whose number follows the size of the text.  A context goes to one bucket by its hash, or, if its
words are so frequent that it might fill more than one, to as many as it needs, by its followers.  Triples
are only gathered if both their pairs are kept.  A bucket yields its slice of the filter.

op1_lm trains and scores in one go by ``score_table``: slices stay in their buckets, and texts ask them.  In
LogFrequencyModel slices are broadcast in portions of at most ``MAX_BROADCAST`` bytes.  What a portion knows
of a token is added to what the others know, so the number of portions changes no score; it is one until a
model outgrows a portion.

Nulls and empty texts are the end token alone.  Rows that repeat an id are scored one by one, and each
counts in training; rows without an id are training rows.  Long texts are hashed in tiles and scored
whole.  Other columns are not looked at.
"""

from __future__ import annotations

import gc
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import id_text, map_arrow, mix, packed, power_of_two, saved, shared_dir, table, unpacked, word_hashes

LEAST = 2  # count from which pairs and triples enter, unless fit() is told another
BITS = 20  # of the filter for each entry
MAX_BROADCAST = 256 << 20
FLUSH = 1 << 20
#: Bytes of training text for each bucket, as a power of 2.
BUCKET_BYTES = 22
#: Tokens for each bucket of score_table(), as a power of 2.
BUCKET_TOKENS = 21
#: Tokens of a table from which finished shuffles are deleted at once.
FORGET_TOKENS = 1 << 24
END = np.uint64(0x45F0C6D3A1B2E4D7)
_PAIR, _CONTEXT, _CHECK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_NO_KEYS, _NO_COUNTS = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with the end of each text, token offsets of the texts)."""
    h, woff, *_ = word_hashes(texts, lower=True)
    n = len(woff) - 1
    off = woff + np.arange(n + 1)
    out = np.empty(len(h) + n, np.uint64)
    out[off[1:] - 1] = END
    inner = np.ones(len(out), bool)
    inner[off[1:] - 1] = False
    out[inner] = h
    return out, off


def before(t: np.ndarray, off: np.ndarray) -> np.ndarray:
    """What stands before each token; the last entry of t, an end, before the first of a text."""
    p = np.empty_like(t)
    if len(t):
        p[1:] = t[:-1]
        p[off[:-1]] = t[-1]
    return p


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * _PAIR + w)


def level(count: np.ndarray, least: int = LEAST) -> np.ndarray:
    """0 below ``least``, 1 or 2, then from 1 on a level for each power of 2: floor(log2 count), or one more with 1."""
    return np.where(count >= least, np.frexp(np.maximum(count, 1).astype(np.float64))[1] + 1 - least, 0).astype(np.int64)


def middle(lv: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The mean count of a level."""
    return np.where(lv > 0, 1.5 * np.exp2(lv + (least - 2)) - 0.5, 0.0)


def entry(key: np.ndarray, lv: int) -> np.ndarray:
    return mix(key + np.uint64(lv * 0xD1342543DE82EF95 % (1 << 64)))


def spot(e: np.ndarray, size, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first or second word of an entry, among ``size``, and its bits there."""
    one, low = np.uint64(1), np.uint64(63)
    h = mix(e ^ np.uint64(0xA5A5A5A5A5A5A5A5)) if k else e
    bits = one << (h & low)
    for n in (6, 12, 18):
        bits |= one << (h >> np.uint64(n) & low)
    return ((h >> np.uint64(32)) * size >> np.uint64(32)).astype(np.int64), bits


def filter_bits(entries: list[np.ndarray], bits: int = BITS) -> bytes:
    """The words that hold the given entries."""
    e = np.concatenate([_NO_KEYS, *entries])
    flat = np.zeros(max(64, -(-len(e) * bits // 64)), np.uint64)
    for k in (0, 1):
        at, mask = spot(e, np.uint64(len(flat)), k)
        order = np.argsort(at)
        at, mask = at[order], mask[order]
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
        if len(at):
            flat[at[new]] |= np.bitwise_or.reduceat(mask, new)
    return flat.tobytes()


def filter_entries(key: np.ndarray, lv: np.ndarray, one: np.ndarray, one_level: np.ndarray) -> list[np.ndarray]:
    """Of n-grams with their levels, and of contexts with one follower with its level."""
    out = [entry(key[lv >= j], j) for j in range(1, int(lv.max(initial=0)) + 1)]
    return [*out, mix(one ^ _CHECK), *(entry((one ^ _CONTEXT)[one_level >= j], j) for j in range(1, int(one_level.max(initial=0)) + 1))]


class LogFilter:
    """The slices of some buckets in one array of words; buckets without one hold nothing."""

    def __init__(self, sizes: dict[int, int], buckets: int):
        self.sizes, self.starts = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        at = 0
        for b in sorted(sizes):
            self.sizes[b], self.starts[b] = sizes[b] // 8, at
            at += sizes[b] // 8
        self.words = np.zeros(max(1, at), np.uint64)

    def put(self, bucket: int, part: bytes) -> LogFilter:
        self.words[self.starts[bucket] : self.starts[bucket] + len(part) // 8] = np.frombuffer(part, np.uint64)
        return self

    def holds(self, e: np.ndarray, size: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Positions of the entries that are there, in slices of these sizes and starts."""
        there = np.arange(len(e))
        for k in (0, 1):
            at, mask = spot(e[there], size[there].astype(np.uint64), k)
            there = there[self.words[start[there] + at] & mask == mask]
        return there

    def levels(self, key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The level of each key: levels are probed in turn while they are found; 0 without a slice."""
        out = np.zeros(len(key), np.int64)
        live = np.flatnonzero(self.sizes[bucket])
        size, start, j = self.sizes[bucket[live]], self.starts[bucket[live]], 0
        while len(live) and j < 64:
            j += 1
            there = self.holds(entry(key[live], j), size, start)
            live, size, start = live[there], size[there], start[there]
            out[live] = j
        return out

    def contexts(self, key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The level of the only follower of each context that has one; its second entry is asked first."""
        out = np.zeros(len(key), np.int64)
        live = np.flatnonzero(self.sizes[bucket])
        live = live[self.holds(mix(key[live] ^ _CHECK), self.sizes[bucket[live]], self.starts[bucket[live]])]
        out[live] = self.levels(key[live] ^ _CONTEXT, bucket[live])
        return out


class Layout:
    """Which bucket holds what: contexts by hash, those of frequent words in several buckets by follower."""

    def __init__(self, buckets: int, words: np.ndarray = _NO_KEYS, counts: np.ndarray = _NO_COUNTS, total: int = 1):
        self.buckets, self.shift = buckets, np.uint64(65 - buckets.bit_length())
        self.hot, self.splits = words, -(-counts * buckets // max(1, total))

    def base(self, key: np.ndarray) -> np.ndarray:
        return (key >> self.shift).astype(np.int64) if self.buckets > 1 else np.zeros(len(key), np.int64)

    def split(self, word: np.ndarray) -> np.ndarray:
        """Buckets over which the followers of a word are spread."""
        if not len(self.hot):
            return np.ones(len(word), np.int64)
        at = np.minimum(np.searchsorted(self.hot, word), len(self.hot) - 1)
        return np.where(self.hot[at] == word, self.splits[at], 1)

    def bucket(self, context: np.ndarray, rest: np.ndarray, split: np.ndarray) -> np.ndarray:
        return (self.base(context) + (rest % split.astype(np.uint64)).astype(np.int64)) % self.buckets


def rest_of(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """40 bits that, with the context, tell an n-gram."""
    return pair_key(context, word) >> np.uint64(24)


def gram_key(context: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return mix(context ^ (rest * _CONTEXT))


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else _NO_COUNTS
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _cuts(bucket: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    """The buckets of a sorted array and the range of each."""
    have, at = np.unique(bucket, return_index=True)
    return have.tolist(), list(zip(at.tolist(), [*at[1:].tolist(), len(bucket)], strict=False))


def _flushed(it: Iterator[pa.RecordBatch], some, out) -> Iterator[pa.RecordBatch]:
    """out(concatenated arrays) of some(batch) -> arrays, at FLUSH entries and at the end."""
    held, n = [], 0
    for b in it:
        held.append(some(b))
        n += len(held[-1][0])
        if n >= FLUSH:
            yield from out(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield from out(*map(np.concatenate, zip(*held, strict=True)))


def _binary(x) -> pa.Array:
    return pa.array(x, pa.binary())


def gather_words(docs: DataFrame, layout: Layout) -> DataFrame:
    """Of each bucket its words, sorted, and their exact counts."""

    def out(t: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield word_rows(layout, *np.unique(t, return_counts=True))

    return word_sums(map_arrow(docs, lambda it: _flushed(it, lambda b: (tokens(b["text"])[0],), out), _WORD_ROWS))


_WORD_ROWS = "bucket int, words binary, counts binary"


def word_rows(layout: Layout, words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    have, cut = _cuts(layout.base(words))
    return pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), _binary([packed(words[i:j], rising=True) for i, j in cut]), _binary([packed(n[i:j].astype(np.int64)) for i, j in cut])], ["bucket", "words", "counts"])


def word_sums(rows: DataFrame) -> DataFrame:
    def build(t: pa.Table) -> pa.Table:
        words, n = _sums(np.concatenate([unpacked(x, np.uint64, rising=True) for x in t["words"].to_pylist()]), np.concatenate([unpacked(x, np.int64) for x in t["counts"].to_pylist()]))
        return pa.table({"bucket": pa.array([t["bucket"][0].as_py()], pa.int32()), "n_tokens": [int(n.sum())], "n_types": [len(words)], "words": _binary([packed(words, rising=True)]), "counts": _binary([zlib.compress(packed(n), 1)])})

    return rows.groupBy("bucket").applyInArrow(build, "bucket int, n_tokens long, n_types long, words binary, counts binary")


def spread_layout(words: DataFrame, buckets: int) -> tuple[Layout, int, int]:
    """From the words of all buckets: a layout with the frequent ones, the number of tokens and that of different words."""
    n, v = words.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_types"), F.lit(0))).first()

    def frequent(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for x, y in zip(b["words"].to_pylist(), b["counts"].to_pylist(), strict=True):
                w, c = unpacked(x, np.uint64, rising=True), unpacked(zlib.decompress(y), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(w[c * buckets > n].view(np.int64)), pa.array(c[c * buckets > n])], ["word", "n"])

    # fewer than ``buckets`` words can have a bucket's share of the tokens
    hot = sorted((r.word % (1 << 64), r.n) for r in words.mapInArrow(frequent, "word long, n long").collect())
    return Layout(buckets, np.array([h for h, _ in hot], np.uint64), np.array([c for _, c in hot], np.int64), n), n, v


def gather_grams(docs: DataFrame, layout: Layout, pairs=None, bits: int = BITS, least: int = LEAST) -> DataFrame:
    """Of each bucket its slice of the filter over kept n-grams and contexts, and heads: contexts with s and t.

    pairs: None for pairs; for triples a broadcast LogFilter of pairs, whose empty slices let all through."""

    def some(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        t, off = tokens(b["text"])
        p = before(t, off)
        if pairs is None:
            return p, t, layout.split(p)
        flt, o = pairs.value, before(p, off)
        split = layout.split(p)
        rest = rest_of(p, t)
        bucket = layout.bucket(p, rest, split)
        kept = (flt.sizes[bucket] == 0) | (flt.levels(gram_key(p, rest), bucket) > 0)
        first = np.zeros(len(t), bool)
        first[off[:-1]] = True
        use = np.flatnonzero(kept[1:] & kept[:-1] & ~first[1:]) + 1  # both pairs, not across texts
        return pair_key(o[use], p[use]) ^ _CHECK, t[use], np.minimum(layout.split(o[use]), split[use])

    def out(context: np.ndarray, word: np.ndarray, split: np.ndarray) -> Iterator[pa.RecordBatch]:
        rest = rest_of(context, word)
        bucket = layout.bucket(context, rest, split)
        # one sort key of bucket, context and rest; full values tell equals apart
        free = 64 - layout.buckets.bit_length()
        own = (context << np.uint64(layout.buckets.bit_length() - 1)) >> np.uint64(64 - free // 2)
        order = np.argsort(bucket.astype(np.uint64) << np.uint64(free) | own << np.uint64(free - free // 2) | rest >> np.uint64(40 - (free - free // 2)))
        context, rest, bucket, split = context[order], rest[order], bucket[order], split[order]
        new_context = np.r_[True, (context[1:] != context[:-1]) | (bucket[1:] != bucket[:-1])]
        at = np.flatnonzero(new_context | np.r_[True, rest[1:] != rest[:-1]])
        n = np.diff(np.r_[at, len(rest)])
        rest, bucket, context, split, new = rest[at], bucket[at], context[at], split[at], np.flatnonzero(new_context[at])
        length = np.diff(np.r_[new, len(rest)])
        have, cut = _cuts(bucket)
        heads = [(int(np.searchsorted(new, i)), int(np.searchsorted(new, j))) for i, j in cut]
        blobs = [_binary([packed(context[new][i:j], rising=True) for i, j in heads]), _binary([packed(length[i:j].astype(np.uint32)) for i, j in heads]), _binary([np.packbits(split[new][i:j] > 1).tobytes() for i, j in heads])]
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), *blobs, _binary([packed(rest[i:j], 5) for i, j in cut]), _binary([packed(n[i:j].astype(np.uint32)) for i, j in cut])], ["bucket", "contexts", "lengths", "spread", "rests", "counts"])

    def build(t: pa.Table) -> pa.Table:
        lengths = [unpacked(x, np.uint32) for x in t["lengths"].to_pylist()]
        each = lambda name, read: np.concatenate([np.repeat(read(x, len(k)), k) for x, k in zip(t[name].to_pylist(), lengths, strict=True)])
        context = each("contexts", lambda x, _: unpacked(x, np.uint64, rising=True))
        rest = np.concatenate([unpacked(x, np.uint64, 5) for x in t["rests"].to_pylist()])
        n = np.concatenate([unpacked(x, np.uint32) for x in t["counts"].to_pylist()]).astype(np.int64)
        order = np.argsort(gram_key(context, rest))
        context, rest, n = context[order], rest[order], n[order]
        at = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (rest[1:] != rest[:-1])])
        n = np.add.reduceat(n, at)
        at, n = at[n >= least], n[n >= least]
        spread = each("spread", lambda x, k: np.unpackbits(np.frombuffer(x, np.uint8), count=k).astype(bool))[order][at]
        context, rest, lv = context[at], rest[at], level(n, least)
        by = np.argsort(context, kind="stable")
        heads = np.flatnonzero(np.r_[True, context[by][1:] != context[by][:-1]]) if len(by) else _NO_COUNTS
        types = np.diff(np.r_[heads, len(by)])
        sums = np.add.reduceat(middle(lv[by], least), heads) if len(heads) else np.zeros(0)
        lone = (types == 1) & ~spread[by][heads]
        one, one_level, more = context[by][heads][lone], lv[by][heads][lone], heads[~lone]
        entries = filter_entries(gram_key(context, rest), lv, one, one_level)
        cols = [packed(context[by][more], rising=True), packed(sums[~lone]), packed(types[~lone].astype(np.uint32))]
        return pa.table({"bucket": pa.array([t["bucket"][0].as_py()], pa.int32()), "bits": _binary([filter_bits(entries, bits) if any(map(len, entries)) else b""]), **{c: _binary([x]) for c, x in zip(("heads", "s", "t"), cols, strict=True)}})

    rows = map_arrow(docs, lambda it: _flushed(it, some, out), "bucket int, contexts binary, lengths binary, spread binary, rests binary, counts binary")
    return rows.groupBy("bucket").applyInArrow(build, "bucket int, bits binary, heads binary, s binary, t binary")


def in_buckets(df: DataFrame, buckets: list[int]) -> DataFrame:
    return df.filter(F.col("bucket").between(buckets[0], buckets[-1])) if buckets else df.limit(0)


class Grams:
    """Pairs or triples of some buckets: the filter and the contexts beside it."""

    def __init__(self, layout: Layout, flt: LogFilter, heads: np.ndarray, s: np.ndarray, t: np.ndarray, least: int = LEAST):
        self.layout, self.filter, self.heads, self.s, self.t, self.least = layout, flt, heads, s, t, least

    @classmethod
    def read(cls, part: DataFrame, layout: Layout, least: int = LEAST) -> Grams:
        sizes = part.select("bucket", F.length("bits").alias("n")).collect()
        flt = LogFilter({r.bucket: r.n for r in sizes if r.n}, layout.buckets)
        heads, s, t = [_NO_KEYS], [np.zeros(0)], [np.zeros(0, np.uint32)]
        for r in part.toLocalIterator():  # some buckets at a time
            flt.put(r.bucket, bytes(r.bits))
            heads.append(unpacked(bytes(r.heads), np.uint64, rising=True))
            s.append(unpacked(bytes(r.s), np.float64))
            t.append(unpacked(bytes(r.t), np.uint32))
        heads, inverse = np.unique(np.concatenate(heads), return_inverse=True)  # contexts that are spread add up
        return cls(layout, flt, heads, *(np.bincount(inverse, np.concatenate(x), len(heads)) for x in (s, t)), least)

    def contexts(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """s and t of each context, 0 if it has no kept follower here."""
        lv = self.filter.contexts(key, self.layout.base(key))
        s, t = middle(lv, self.least), (lv > 0).astype(np.float64)
        if len(self.heads):
            at = np.minimum(np.searchsorted(self.heads, key), len(self.heads) - 1)
            hit = self.heads[at] == key
            s[hit], t[hit] = self.s[at[hit]], self.t[at[hit]]
        return s, t

    def means(self, context: np.ndarray, word: np.ndarray, split: np.ndarray) -> np.ndarray:
        rest = rest_of(context, word)
        return middle(self.filter.levels(gram_key(context, rest), self.layout.bucket(context, rest, split)), self.least)


class Words:
    """Words of some buckets, sorted, and their exact counts."""

    def __init__(self, part: DataFrame):
        sizes = {r.bucket: r.n_types for r in part.select("bucket", "n_types").collect()}
        ends = dict(zip(sorted(sizes), np.cumsum([sizes[b] for b in sorted(sizes)]).tolist(), strict=True))
        self.words, self.counts = np.zeros(sum(sizes.values()), np.uint64), np.zeros(sum(sizes.values()), np.uint32)
        for r in part.select("bucket", "words", "counts").toLocalIterator():
            mine, n = slice(ends[r.bucket] - sizes[r.bucket], ends[r.bucket]), unpacked(zlib.decompress(bytes(r.counts)), np.int64)
            if n.max() >= 1 << 32:
                self.counts = self.counts.astype(np.int64)
            self.words[mine], self.counts[mine] = unpacked(bytes(r.words), np.uint64, rising=True), n


class Portion:
    """What some buckets of the model know."""

    def __init__(self, words: Words, pairs: Grams, triples: Grams):
        self.layout, self.words, self.counts, self.pairs, self.triples = pairs.layout, words.words, words.counts, pairs, triples

    def known(self, u: np.ndarray, w: np.ndarray, p: np.ndarray, o: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """For each token seven rows: its count; m, s, t of its pair; m, s, t of its triple.

        u: sorted distinct hashes; w, p, o: the token, the one before and the one before that, as places in u;
        inner: whether o, p, w is a triple of one text."""
        out = np.zeros((7, len(w)))
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, u), len(self.words) - 1)
            out[0] = np.where(self.words[at] == u, self.counts[at], 0)[w]
        split, n = self.layout.split(u), len(u)
        s, t = self.pairs.contexts(u)
        out[2], out[3] = s[p], t[p]
        key, back = np.unique(p * n + w, return_inverse=True)
        a, b = key // n, key % n
        out[1] = self.pairs.means(u[a], u[b], split[a])[back]
        at = np.flatnonzero(inner)
        key, back = np.unique(o[at] * n + p[at], return_inverse=True)
        a, b = key // n, key % n
        context = pair_key(u[a], u[b]) ^ _CHECK
        s, t = self.triples.contexts(context)
        out[5, at], out[6, at] = s[back], t[back]
        out[4, at] = self.triples.means(context[back], u[w[at]], np.minimum(split[a], split[b])[back])
        return out


def log_probabilities(known: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's probability by its count alone, and by the model."""
    c, m2, s2, t2, m3, s3, t3 = known
    one = (c + 0.5) / (n + 0.5 * (v + 1))
    over = lambda m, s, t, p: np.where(t > 0, (m + t * p) / np.where(t > 0, s + t, 1), p)
    return np.log10(one), np.log10(over(m3, s3, t3, over(m2, s2, t2, one)))


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class LogFrequencyModel:
    """Built by fit(); score() gives one row for each document."""

    def __init__(self, spark: SparkSession, parts: tuple[DataFrame, DataFrame, DataFrame], layout: Layout, n: int, v: int, least: int = LEAST):
        self.spark, self.parts, self.layout, self.n, self.v, self.least = spark, parts, layout, n, v, least

    @classmethod
    def fit(cls, docs: DataFrame, bits: int = BITS, bucket_bytes: int = BUCKET_BYTES, max_broadcast: int = MAX_BROADCAST, least: int = LEAST) -> LogFrequencyModel:
        """least: 1 for all pairs and triples, 2 to leave out those that occur once."""
        spark = docs.sparkSession
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
        buckets = power_of_two(max(4, size >> bucket_bytes))
        words = saved(gather_words(docs, Layout(buckets)))
        layout, n, v = spread_layout(words, buckets)
        pairs = saved(gather_grams(docs, layout, None, bits, least))
        model = cls(spark, (words, pairs, pairs.limit(0)), layout, n, v, least)
        # all pairs of a triple are kept with 1: a filter without slices lets all through
        sifting = in_buckets(pairs, model._portions(max_broadcast)[0] if least > 1 else [])
        known = spark.sparkContext.broadcast(Grams.read(sifting, layout, least).filter)
        model.parts = (words, pairs, saved(gather_grams(docs, layout, known, bits, least)))
        known.unpersist()
        return model

    def _portions(self, most: int) -> list[list[int]]:
        """Buckets in runs of at most ``most`` bytes, or of one bucket."""
        sized = [p.select("bucket", sum((F.length(c) for c in p.columns if dict(p.dtypes)[c] == "binary"), F.lit(0)).alias("size")) for p in self.parts]
        sizes = sized[0].unionByName(sized[1]).unionByName(sized[2]).groupBy("bucket").agg(F.sum("size").alias("size")).orderBy("bucket").collect()
        out, room = [[]], most
        for r in sizes:
            if r.size > room and out[-1]:
                out.append([])
                room = most
            out[-1].append(r.bucket)
            room -= r.size
        return out

    def _read(self, buckets: list[int]) -> Iterator[Words | Grams]:
        """The parts of a portion one after the other: the driver holds one at a time."""
        words, pairs, triples = (in_buckets(p, buckets) for p in self.parts)
        yield Words(words)
        yield Grams.read(pairs, self.layout, self.least)
        yield Grams.read(triples, self.layout, self.least)

    def _portion(self, buckets: list[int]) -> Portion:
        return Portion(*self._read(buckets))

    def _sent(self, buckets: list[int]) -> list:
        return list(map(self.spark.sparkContext.broadcast, self._read(buckets)))

    def score(self, docs: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
        docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
        portions, n, v = self._portions(max_broadcast), self.n, self.v
        if len(portions) == 1:
            held = self._sent(portions[0])

            def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                portion = Portion(*(h.value for h in held))
                for b in it:
                    t, off = tokens(b["text"])
                    yield _scored(b, off, known_tokens(portion, t, off), n, v)

            return map_arrow(docs, run, _OUT)
        rows = saved(docs.withColumn("row", F.monotonically_increasing_id()))
        known = None
        for buckets in portions:
            held = self._sent(buckets)

            def part(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                portion = Portion(*(h.value for h in held))
                for b in it:
                    t, off = tokens(b["text"])
                    x, at = known_tokens(portion, t, off), off.tolist()
                    yield pa.RecordBatch.from_arrays([b["row"], _binary([zlib.compress(x[:, i:j].tobytes(), 1) for i, j in zip(at, at[1:], strict=False)])], ["row", "known"])

            one = saved(map_arrow(rows, part, "row long, known binary"))
            for h in held:
                h.unpersist()
            known = one if known is None else known.unionByName(one)

        def finish(t: pa.Table) -> pa.Table:
            x = sum(np.frombuffer(zlib.decompress(k), np.float64).reshape(7, -1) for k in t["known"].to_pylist())
            cols = ["doc_id", "held_out"]
            return pa.Table.from_batches([_scored({c: t[c].combine_chunks()[:1] for c in cols}, np.array([0, x.shape[1]]), x, n, v)])

        return known.join(rows.select("row", "doc_id", "held_out"), "row").groupBy("row").applyInArrow(finish, _OUT)


def known_tokens(portion: Portion, t: np.ndarray, off: np.ndarray) -> np.ndarray:
    u, w = np.unique(t, return_inverse=True)
    if not len(t):
        return np.zeros((7, 0))
    p = before(w, off)
    inner = np.ones(len(t), bool)
    inner[off[:-1]] = False
    return portion.known(u, w, p, before(p, off), inner)


def _scored(b, off: np.ndarray, known: np.ndarray, n: int, v: int) -> pa.RecordBatch:
    at = off[:-1]
    base, score = log_probabilities(known, n, v)
    total = lambda x: np.add.reduceat(x, at) if len(at) else np.zeros(0, x.dtype)  # noqa: E731  every text has its end token
    return pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(np.diff(off)), pa.array(total((known[0] > 0).astype(np.int64))), pa.array(np.full(len(at), n, np.int64)), pa.array(total(base)), pa.array(total(score))], [x.split()[0] for x in _OUT.split(", ")])


def chunked(docs: DataFrame) -> DataFrame:
    """docs in chunks of about FLUSH tokens: ids, train and lengths of the texts, the different words, and each token as a place in them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in it:
            t, off = tokens(b["text"])
            held.append((t, np.diff(off), b["doc_id"], b["train"], b["row"][0].as_py()))
            n += len(t)
            if n >= FLUSH:
                yield one(*zip(*held, strict=True))
                held, n = [], 0
        if n:
            yield one(*zip(*held, strict=True))

    def one(t, lengths, ids, train, row) -> pa.RecordBatch:
        u, w = np.unique(np.concatenate(t), return_inverse=True)
        lists = [pa.ListArray.from_arrays(pa.array([0, sum(map(len, x))], pa.int32()), pa.concat_arrays(x)) for x in (ids, train)]
        blobs = [packed(np.concatenate(lengths).astype(np.uint32)), packed(u, rising=True), zlib.compress(packed(w.astype(np.uint32)), 1)]
        return pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([len(w)]), *lists, *(_binary([x]) for x in blobs)], ["chunk", "n_tokens", "ids", "train", "lengths", "words", "places"])

    # a chunk is called by its first row: tasks of coalesced partitions share their number
    return map_arrow(docs.withColumn("row", F.monotonically_increasing_id()), run, "chunk long, n_tokens long, ids array<long>, train array<boolean>, lengths binary, words binary, places binary")


class Asked:
    """The different n-grams of a chunk by bucket and context: what buckets are asked, and where answers belong.

    contexts rise; a, b: context and word of each n-gram as places in contexts and words."""

    def __init__(self, layout: Layout, contexts: np.ndarray, split: np.ndarray, a: np.ndarray, words: np.ndarray, b: np.ndarray, train: np.ndarray):
        key, back = np.unique(a * len(words) + b, return_inverse=True)
        a, b = key // max(1, len(words)), key % max(1, len(words))
        rest = rest_of(contexts[a], words[b])
        bucket = layout.bucket(contexts[a], rest, split[a])
        order = np.argsort(bucket, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.back, self.a, self.b, self.rest = place[back], a[order], b[order], rest[order]
        self.n, self.held = (np.bincount(self.back[x], minlength=len(key)) for x in (train, ~train))
        self.contexts, self.spread = contexts, split > 1
        self.have, self.cut = _cuts(bucket[order])
        cuts = np.zeros(len(key), bool)
        cuts[[i for i, _ in self.cut]] = True
        self.heads = np.flatnonzero(cuts | np.r_[True, self.a[1:] != self.a[:-1]][: len(key)])
        self.of_cut = list(zip(*(np.searchsorted(self.heads, np.array(x, np.int64)).tolist() for x in zip(*self.cut, strict=True)), strict=True)) if self.cut else []

    def rows(self, chunk: int) -> pa.RecordBatch:
        head, length = self.a[self.heads], np.diff(np.r_[self.heads, len(self.a)]).astype(np.uint32)
        context, spread, n, held = self.contexts[head], self.spread[head], self.n.astype(np.uint32), self.held.astype(np.uint32)
        by_head = [[packed(context[i:j], rising=True) for i, j in self.of_cut], [packed(length[i:j]) for i, j in self.of_cut], [np.packbits(spread[i:j]).tobytes() for i, j in self.of_cut]]
        by_gram = [[packed(self.rest[i:j], 5) for i, j in self.cut], [packed(n[i:j]) for i, j in self.cut], [packed(held[i:j]) for i, j in self.cut]]
        return pa.RecordBatch.from_arrays([pa.array([chunk] * len(self.have), pa.int64()), pa.array(self.have, pa.int32()), *map(_binary, by_head + by_gram)], [x.split()[0] for x in _ASKED.split(", ")])

    def answers(self, blobs: dict[int, bytes], sums: Sums) -> tuple[np.ndarray, ...]:
        """The level of each n-gram; c, s and t of each context."""
        lv, found = np.zeros(len(self.a), np.int64), np.zeros((3, len(self.contexts)))
        for k, (i, j), (x, y) in zip(self.have, self.cut, self.of_cut, strict=True):
            raw = zlib.decompress(blobs[k])
            lv[i:j] = np.frombuffer(raw[: j - i], np.uint8)
            found[:, self.a[self.heads[x:y]]] = unpacked(raw[j - i :], np.int64).reshape(3, -1)
        at = np.flatnonzero(self.spread)
        found[:, at] = sums.of(self.contexts[at])
        return lv, found[0], found[1] / 2, found[2]

    def alone(self, blobs: dict[int, bytes]) -> np.ndarray:
        """Which n-grams occur once in all chunks."""
        bits = [np.unpackbits(np.frombuffer(blobs[k], np.uint8), count=j - i) for k, (i, j) in zip(self.have, self.cut, strict=True)]
        return np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)


_ASKED = "chunk long, bucket int, contexts binary, lengths binary, spread binary, rests binary, counts binary, held binary"
_ANSWERS = "chunk long, bucket int, alone binary, answer binary"


class Sums:
    """c, 2s and t of the contexts that are spread over buckets."""

    def __init__(self, answers: DataFrame):
        parts = [np.zeros((4, 0), np.int64)]
        for r in answers.filter("chunk < 0").select("answer").toLocalIterator():
            parts.append(unpacked(zlib.decompress(bytes(r.answer)), np.int64).reshape(4, -1))
        key, *x = np.concatenate(parts, axis=1)
        self.keys, at = np.unique(key.view(np.uint64), return_inverse=True)
        self.sums = np.array([np.bincount(at, y, len(self.keys)) for y in x])

    def of(self, key: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((3, len(key)))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.sums[:, at], 0)


def answer(t: pa.Table, bits: int) -> pa.Table:
    """A bucket counts what chunks sent, makes its slice of the filter of it, and answers every chunk from that.

    A row without a chunk (-1) has the bucket's part of the sums of contexts that are spread."""
    read = lambda name, *how, **more: [unpacked(x, *how, **more) for x in t[name].to_pylist()]
    lengths = read("lengths", np.uint32)
    head_ends = np.cumsum([0, *map(len, lengths)]).tolist()
    ends = np.cumsum([0, *(int(x.sum()) for x in lengths)]).tolist()
    spread = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(t["spread"].to_pylist(), lengths, strict=True)])
    heads, of_head = np.unique(np.concatenate(read("contexts", np.uint64, rising=True)), return_inverse=True)
    of_gram = np.repeat(of_head, np.concatenate(lengths))
    key = gram_key(heads[of_gram], np.concatenate(read("rests", np.uint64, 5)))
    order = np.argsort(key)
    new = np.r_[True, key[order][1:] != key[order][:-1]][: len(key)]
    first, back = order[new], np.empty_like(order)
    key, back[order] = key[first], np.cumsum(new) - 1
    n = np.concatenate(read("counts", np.uint32))
    total = np.bincount(back, n, len(key)).astype(np.int64)
    alone = (total + np.bincount(back, np.concatenate(read("held", np.uint32)), len(key)) == 1)[back]
    context, lv = of_gram[first], level(total, 1)
    c, s, types = (np.bincount(context, x, len(heads)) for x in (total, middle(lv, 1), total > 0))
    wide = np.zeros(len(heads), bool)
    wide[of_head] = spread
    lone, more = np.flatnonzero((types == 1) & ~wide), (types > 0) & ((types > 1) | wide)
    one_level = np.bincount(context, lv, len(heads))[lone].astype(np.int64)
    entries = filter_entries(key[lv > 0], lv[lv > 0], heads[lone], one_level)
    bloom = filter_bits(entries, bits) if any(map(len, entries)) else b""
    flt = LogFilter({0: len(bloom)} if bloom else {}, 1)
    own = Grams(Layout(1), flt.put(0, bloom) if bloom else flt, heads[more], s[more], types[more], 1)
    lv = flt.levels(key, np.zeros(len(key), np.int64)).astype(np.uint8)[back]
    found = np.array([c, *own.contexts(heads)]) * [[1], [2], [1]]
    found = found.astype(np.int64)[:, of_head]
    blob = lambda x: packed(np.ascontiguousarray(x).ravel())
    answers = [zlib.compress(lv[i:j].tobytes() + blob(found[:, x:y]), 1) for i, j, x, y in zip(ends, ends[1:], head_ends, head_ends[1:], strict=False)]
    once = [np.packbits(alone[i:j]).tobytes() for i, j in zip(ends, ends[1:], strict=False)]
    chunk = t["chunk"].to_pylist()
    if wide.any():
        chunk.append(-1)
        once.append(b"")
        answers.append(zlib.compress(blob(np.array([heads[wide].view(np.int64), c[wide].astype(np.int64), (2 * s[wide]).astype(np.int64), types[wide].astype(np.int64)])), 1))
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "bucket": pa.array([t["bucket"][0].as_py()] * len(chunk), pa.int32()), "alone": _binary(once), "answer": _binary(answers)})


def answered(asked: DataFrame, bits: int) -> DataFrame:
    return asked.groupBy("bucket").applyInArrow(lambda t: answer(t, bits), _ANSWERS)


class Chunk:
    """A row of chunked(), its tokens as places in u, and what it asks."""

    def __init__(self, t: pa.Table | pa.RecordBatch, layout: Layout):
        cell = lambda name: t[name][0]
        self.layout, self.chunk, self.ids = layout, cell("chunk").as_py(), cell("ids").values
        self.texts = cell("train").values.to_numpy(zero_copy_only=False)
        self.u = unpacked(cell("words").as_py(), np.uint64, rising=True)
        self.w = unpacked(zlib.decompress(cell("places").as_py()), np.uint32).astype(np.int64)
        lengths = unpacked(cell("lengths").as_py(), np.uint32)
        self.off, self.train = np.r_[0, np.cumsum(lengths, dtype=np.int64)], np.repeat(self.texts, lengths)
        self.inner = np.ones(len(self.w), bool)
        self.inner[self.off[:-1]] = False
        self.split = layout.split(self.u)

    def pairs(self) -> Asked:
        self.p = before(self.w, self.off)
        return Asked(self.layout, self.u, self.split, self.p, self.u, self.w, self.train)

    def triples(self, pairs: Asked, alone: np.ndarray) -> tuple[np.ndarray, Asked]:
        """Tokens whose two words before occur together elsewhere too, and their triples; of the others all is known here."""
        at = np.flatnonzero(self.inner)
        at = at[~alone[pairs.back[at - 1]]]
        pair, back = np.unique(pairs.back[at - 1], return_inverse=True)
        a, b = pairs.a[pair], pairs.b[pair]
        context = pair_key(self.u[a], self.u[b]) ^ _CHECK
        order = np.argsort(context)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        return at, Asked(self.layout, context[order], np.minimum(self.split[a], self.split[b])[order], rank[back], self.u, self.w[at], self.train[at])


def _blobs(t: pa.Table, of: str) -> dict[int, bytes]:
    return dict(zip(t["bucket"].to_pylist(), t[of].to_pylist(), strict=True))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df saved in parts by key, which Spark knows, so that it is not shuffled again to meet others by that key.

    An adaptive plan would not tell how its rows lie, so this one step goes without."""
    spark = df.sparkSession
    shared_dir(spark)
    # with fewer parts than a shuffle has, Spark would deal both sides anew
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(parts, key).checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def forget(spark: SparkSession, n_tokens: int) -> None:
    """Spark deletes the shuffle files of what is saved by now when the driver collects its garbage: at once, not some time.

    For small tables they may stay."""
    for _ in range(2 if n_tokens >= FORGET_TOKENS else 0):  # the first round lets go of the frames, the second of what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def score_table(docs: DataFrame, train: Column, bits: int = BITS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """LogFrequencyModel.fit(docs where train, least=1).score(docs), for models that outgrow a broadcast.

    No slice of the filter leaves its bucket; what contexts that are spread sum up to is all that is broadcast.  A chunk of texts sends its different n-grams to their buckets
    once, for training and as questions alike, and gets levels and sums back in the order in which it sent.
    A pair that occurs once in all of docs has one follower that nobody else can ask for: its triple stays in
    the chunk.  What is sent and answered grows with the text, and no step with the model's size."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    chunks = dealt(chunked(docs), "chunk")
    size = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    buckets = power_of_two(max(4, size >> bucket_tokens))
    each = lambda it, layout: (Chunk(b.slice(k, 1), layout) for b in it for k in range(b.num_rows))

    def words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(buckets)
        for c in each(it, layout):
            n = np.bincount(c.w[c.train], minlength=len(c.u))
            yield word_rows(layout, c.u[n > 0], n[n > 0])

    layout, n, v = spread_layout(saved(word_sums(chunks.mapInArrow(words, _WORD_ROWS))), buckets)

    def ask_pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in each(it, layout):
            yield c.pairs().rows(c.chunk)

    def ask_triples(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left, layout)
        pairs = c.pairs()
        return pa.Table.from_batches([c.triples(pairs, pairs.alone(_blobs(right, "alone")))[1].rows(c.chunk)])

    forget(spark, size)
    pair_answers = saved(answered(chunks.mapInArrow(ask_pairs, _ASKED), bits))
    forget(spark, size)
    # a chunk meets its answers
    meet = lambda answers, fn, schema: chunks.groupBy("chunk").cogroup(answers.filter("chunk >= 0").groupBy("chunk")).applyInArrow(fn, schema)
    triple_answers = saved(answered(meet(pair_answers.select("chunk", "bucket", "alone"), ask_triples, _ASKED), bits))
    forget(spark, size)
    sums = spark.sparkContext.broadcast((Sums(pair_answers), Sums(triple_answers)))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        c, for_triples = Chunk(left, layout), right["triples"].to_numpy()
        two, three = right.filter(pa.array(~for_triples)), right.filter(pa.array(for_triples))
        pairs = c.pairs()
        alone = pairs.alone(_blobs(two, "alone"))
        at, triples = c.triples(pairs, alone)
        known = np.zeros((7, len(c.w)))
        lv, count, s, t = pairs.answers(_blobs(two, "answer"), sums.value[0])
        known[0], known[1], known[2], known[3] = count[c.w], middle(lv, 1)[pairs.back], s[c.p], t[c.p]
        known[4:, c.inner & c.train] = 1  # the only follower of its context, unless asked for
        lv, _, s, t = triples.answers(_blobs(three, "answer"), sums.value[1])
        context = triples.a[triples.back]
        known[4, at], known[5, at], known[6, at] = middle(lv, 1)[triples.back], s[context], t[context]
        return pa.Table.from_batches([_scored({"doc_id": c.ids, "held_out": pa.array(~c.texts)}, c.off, known, n, v)])

    both = pair_answers.withColumn("triples", F.lit(False)).unionByName(triple_answers.withColumn("triples", F.lit(True)))
    return meet(both, finish, _OUT)


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_text(table(spark, sf_dir, "documents"))
    return score_table(docs, ~held_out(F.col("doc_id")))
