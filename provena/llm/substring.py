"""Substring dedup over a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one document.  A word goes if a window that covers it also
starts earlier: in a document of smaller id, or before it in the same document.

Documents arrive in batches of rising ids.  The index is a folder of immutable runs, one or more a level:

* ``keys``: sorted fingerprints by bucket.  A fingerprint is the hash of ``GRAM`` words that is the least
  among those inside some window, so equal windows have equal fingerprints and about one word in seven
  has one;
* ``windows``: sorted segments, each of one task, of all window hashes under their fingerprints.

A new batch does this, and never reads the text of earlier ones:

1. its fingerprints, sorted by bucket, are merge-joined with the keys of each run: a fingerprint is
   *shared* if a run has it or the batch has it twice;
2. only windows on shared fingerprints are verified: those of the batch, hashed again, and those of the
   runs, read from their segments, meet by fingerprint and hash of the whole window, 112 bits in all
   of which 96 are compared, and the earliest one of each stays;
3. the batch becomes a run.  When a level has ``FANOUT`` runs, their keys are merged into one run of the
   next level, which also takes over their segments.

Shared fingerprints are sent to workers as a bitmap of bounded size that has no false negatives; a
filled bitmap lets more windows be verified and changes no result.  Tasks first settle repeats among
their own windows, so a passage that a third of all documents hold adds one row a task.  Texts that lose
nothing are never shuffled.

Nulls and empty texts have no words.  Documents under ``WINDOW`` words lose none.  Rows of one doc_id and
one text are one document; further texts of that id are documents of their own, in an order that a hash
of the text gives.  Rows without a doc_id are in no batch: they lose nothing and nothing is removed for their sake.  Very long texts
are hashed in tiles and are never cut.  Other columns pass through.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import MOST_BITS, delete_folder, few_files, free_name, id_text, map_arrow, mix, packed, power_of_two, saved, shared_dir, span_hashes, table, text_buffer, unpacked, window_hashes, window_mask, word_hashes

WINDOW, GRAM, FANOUT = 20, 8, 2
#: Entries that a task holds before it hands them on.
FLUSH = 1 << 19
#: Batches that the query cuts a table into: enough that the third meets a compacted run.
BATCHES = 3
#: Bits of the broadcast bitmap of shared fingerprints, 32 MB.
MAX_BITMAP = 1 << 28
#: Bytes of text for each bucket of the index, and for each block of texts that lose words, as powers of 2.
BUCKET_BYTES, BLOCK_BYTES = 24, 22
_LOW48 = np.uint64((1 << 48) - 1)


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each n consecutive entries, by doubling."""
    width, out = 1, x
    while 2 * width <= n:
        out = best(out[:-width], out[width:])
        width *= 2
    if width < n:
        out = best(out[: len(out) - (n - width)], out[n - width :])
    return out


def window_minima(h: np.ndarray, woff: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, least gram hash of each window, which windows lie in one text)."""
    g = window_hashes(h, gram, salt=1)
    m = _sliding(g, window - gram + 1, np.minimum)
    return g, m, window_mask(woff, window, len(m))


def selected(g: np.ndarray, m: np.ndarray, ok: np.ndarray, span: int) -> np.ndarray:
    """Fingerprints: grams that are the least of some window in one text; repeats included."""
    if not ok.any():
        return np.zeros(0, np.uint64)
    pad = np.zeros(span - 1, np.uint64)
    top = _sliding(np.r_[pad, np.where(ok, m, np.uint64(0)), pad], span, np.maximum)
    return mix(g[(top == g[: len(top)]) & (top > 0)])


def _buckets(sorted_keys: np.ndarray, count: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the top bits; count is a power of two."""
    shift = np.uint64(64 - (count.bit_length() - 1)) if count > 1 else None
    if shift is None:
        return [(0, 0, len(sorted_keys))] if len(sorted_keys) else []
    edges = np.searchsorted(sorted_keys, np.arange(1, count, dtype=np.uint64) << shift)
    cuts = np.r_[0, edges, len(sorted_keys)].tolist()
    return [(b, cuts[b], cuts[b + 1]) for b in range(count) if cuts[b + 1] > cuts[b]]


def _count_sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted x, and whether each comes more than once."""
    if not len(x):
        return x, np.zeros(0, bool)
    first = np.r_[True, x[1:] != x[:-1]]
    at = np.flatnonzero(first)
    return x[at], np.diff(np.r_[at, len(x)]) > 1


def fingerprints(docs: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """bucket, keys (sorted distinct), twice: what each task has gathered."""

    def out(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, twice = _count_sorted(np.sort(np.concatenate(held)))
        cut = _buckets(keys, buckets)
        if cut:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, *_ in cut], pa.int32()), pa.array([packed(keys[i:j], rising=True) for _, i, j in cut], pa.binary()), pa.array([np.packbits(twice[i:j]).tobytes() for _, i, j in cut], pa.binary())], ["bucket", "keys", "twice"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in it:
            h, woff, *_ = word_hashes(b["text"])
            if len(h) < window:
                continue
            g, m, ok = window_minima(h, woff, window, gram)
            held.append(selected(g, m, ok, window - gram + 1))
            n += len(held[-1])
            if n >= FLUSH:
                yield from out(held)
                held, n = [], 0
        if n:
            yield from out(held)

    return map_arrow(docs, run, "bucket int, keys binary, twice binary")


def _windows(texts: pa.Array, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint of each window that lies in one text, its hash of 48 bits, its first word, word offsets of the texts)."""
    h, woff, *_ = word_hashes(texts)
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), woff
    _, m, ok = window_minima(h, woff, window, gram)
    at = np.flatnonzero(ok)
    return mix(m[at]), window_hashes(h, window, salt=2)[at] & _LOW48, at, woff


def segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """All windows of each task: keys (sorted fingerprints), whether each is at several places there, the number of
    windows of each, and their hashes."""

    def out(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        f, h, places = (np.concatenate([x[k] for x in held]) for k in range(3))
        _, twice = _count_sorted(np.sort(places))
        order = np.lexsort((h, f))
        f, h = f[order], h[order]
        new = np.r_[True, (f[1:] != f[:-1]) | (h[1:] != h[:-1])]
        f, h = f[new], h[new]
        at = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
        ends = np.r_[at, len(f)]
        for i in range(0, len(at), 1 << 14):  # rows of some hundred kilobytes
            mine = ends[i : i + (1 << 14) + 1]
            blobs = (zlib.compress(packed(f[mine[:-1]], rising=True), 1), np.packbits(twice[i : i + len(mine) - 1]).tobytes(), zlib.compress(packed(np.diff(mine).astype(np.uint32)), 1), packed(h[mine[0] : mine[-1]], 6))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blobs], ["keys", "twice", "counts", "hashes"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in it:
            h, woff, *_ = word_hashes(b["text"])
            if len(h) < window:
                continue
            g, m, ok = window_minima(h, woff, window, gram)
            at = np.flatnonzero(ok)
            held.append((mix(m[at]), window_hashes(h, window, salt=2)[at] & _LOW48, selected(g, m, ok, window - gram + 1)))
            n += len(at)
            if n >= FLUSH:
                yield from out(held)
                held, n = [], 0
        if n:
            yield from out(held)

    return map_arrow(docs, run, "keys binary, twice binary, counts binary, hashes binary")


def keys_of_segments(rows: DataFrame, buckets: int) -> DataFrame:
    """What fingerprints() gives, from stored segments instead of texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for blob, bits in zip(b["keys"].to_pylist(), b["twice"].to_pylist(), strict=True):
                keys = unpacked(zlib.decompress(blob), np.uint64, rising=True)
                twice = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(keys)).astype(bool)
                cut = _buckets(keys, buckets)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, *_ in cut], pa.int32()), pa.array([packed(keys[i:j], rising=True) for _, i, j in cut], pa.binary()), pa.array([np.packbits(twice[i:j]).tobytes() for _, i, j in cut], pa.binary())], ["bucket", "keys", "twice"])

    return map_arrow(rows.select("keys", "twice"), run, "bucket int, keys binary, twice binary")


def shared_bitmap(shared: DataFrame, buckets: int, most: int = MAX_BITMAP) -> tuple[np.ndarray, int]:
    """One bit for each slice of the fingerprint space that has a shared one; ``most`` bits, or 8 a bucket."""
    n = shared.select(F.coalesce(F.sum(F.length("shared")), F.lit(0)) / 8).first()[0]
    bits = 1 << max(16, min(most.bit_length() - 1, int(16 * n).bit_length()))
    bits = max(bits, 8 * buckets)
    shift, each = np.uint64(64 - (bits.bit_length() - 1)), bits // buckets

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k, blob in zip(b["bucket"].to_pylist(), b["shared"].to_pylist(), strict=True):
                flat = np.zeros(each, bool)
                flat[(unpacked(blob, np.uint64, rising=True) >> shift).astype(np.int64) - k * each] = True
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(flat).tobytes()], pa.binary())], ["bucket", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    for r in shared.mapInArrow(run, "bucket int, bits binary").toLocalIterator():
        out[r.bucket * each // 8 : (r.bucket + 1) * each // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return out, int(shift)


_CAND = "bucket int, kind int, k binary, c binary, doc binary, pos binary"
_BATCH, _HISTORY, _REMOVED = range(3)


def _joint(f: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of fingerprint and window hash together, and 32 of the window hash."""
    return mix(f + h * np.uint64(0xC2B2AE3D27D4EB4F)), h.astype(np.uint32)


def _shared(bits: np.ndarray, f: np.ndarray, shift: int) -> np.ndarray:
    p = (f >> np.uint64(shift)).astype(np.int64)
    return (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 > 0


def _cand_rows(kind: int, buckets: int, key: np.ndarray, k=None, c=None, doc=None, pos=None) -> Iterator[pa.RecordBatch]:
    """Rows by bucket of the sorted key; arrays that are not given are empty."""
    cut = _buckets(key, buckets)
    if cut:
        part = lambda x, rising=False: pa.array([packed(x[i:j], rising=rising) if x is not None else b"" for _, i, j in cut], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([b for b, *_ in cut], pa.int32()), pa.array([kind] * len(cut), pa.int32()), part(k, True), part(c), part(doc), part(pos)], [x.split()[0] for x in _CAND.split(", ")])


def text_tags(texts: pa.Array, tagged: bool) -> np.ndarray:
    """What tells apart texts of one id, above the 32 bits of a place; 0 if no id repeats."""
    if not tagged:
        return np.zeros(len(texts), np.int64)
    buf, off = text_buffer(texts)
    return (span_hashes(buf, off[:-1], off[1:]) >> np.uint64(33)).astype(np.int64) << 32


def candidate_windows(docs: DataFrame, bitmap, shift: int, buckets: int, window: int, gram: int, tagged: bool) -> DataFrame:
    """Windows of the batch on shared fingerprints, the first of each in its task; and those that repeat one there."""

    def out(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        k, c, doc, pos = (np.concatenate([x[i] for x in held]) for i in range(4))
        order = np.lexsort((pos, doc))
        order = order[np.argsort(k[order], kind="stable")]
        k, c, doc, pos = k[order], c[order], doc[order], pos[order]
        first = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
        yield from _cand_rows(_BATCH, buckets, k[first], k[first], c[first], doc[first], pos[first])
        # a repeat at the very place of the first one (rows that repeat an id) is no repeat
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        again = ~first & ((doc != doc[lead]) | (pos != pos[lead]))
        key = mix(doc[again].view(np.uint64))
        o = np.argsort(key, kind="stable")
        yield from _cand_rows(_REMOVED, buckets, key[o], doc=doc[again][o], pos=pos[again][o])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, n = bitmap.value, [], 0
        for b in it:
            f, h, at, woff = _windows(b["text"], window, gram)
            hit = np.flatnonzero(_shared(bits, f, shift))
            if not len(hit):
                continue
            at = at[hit]
            owner = np.searchsorted(woff, at, side="right") - 1
            held.append((*_joint(f[hit], h[hit]), np.asarray(b["doc_id"])[owner], at - woff[owner] + text_tags(b["text"], tagged)[owner]))
            n += len(hit)
            if n >= FLUSH:
                yield from out(held)
                held, n = [], 0
        if n:
            yield from out(held)

    return map_arrow(docs, run, _CAND)


def stored_windows(rows: DataFrame, bitmap, shift: int, buckets: int) -> DataFrame:
    """Windows of stored segments on shared fingerprints; no text is read."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for b in it:
            for keys, counts, hashes in zip(*(b[c].to_pylist() for c in ("keys", "counts", "hashes")), strict=True):
                f, n = unpacked(zlib.decompress(keys), np.uint64, rising=True), unpacked(zlib.decompress(counts), np.uint32)
                hit = _shared(bits, f, shift)
                if not hit.any():
                    continue
                k, c = _joint(np.repeat(f[hit], n[hit]), unpacked(hashes, np.uint64, 6)[np.repeat(hit, n)])
                order = np.argsort(k)
                yield from _cand_rows(_HISTORY, buckets, k[order], k[order], c[order])

    return map_arrow(rows.select("keys", "counts", "hashes"), run, _CAND)


def block_of(doc, blocks: int):
    """The block of a doc_id, alike for columns and for arrays."""
    if isinstance(doc, np.ndarray):
        return (doc ^ (doc.view(np.uint64) >> np.uint64(20)).view(np.int64)) % blocks
    return F.pmod(doc.bitwiseXOR(F.shiftrightunsigned(doc, 20)), F.lit(blocks))


def removed_windows(cands: DataFrame, blocks: int) -> DataFrame:
    """block, docs, pos: the windows of the batch that start earlier elsewhere."""

    def settle(t: pa.Table) -> pa.Table:
        kinds = t["kind"].to_pylist()

        def take(name: str, of: type, *which: int) -> np.ndarray:
            got = [unpacked(x, of, rising=name == "k") for w in which for x, kind in zip(t[name].to_pylist(), kinds, strict=True) if kind == w]
            return np.concatenate([*got, np.zeros(0, of)])

        k, c = take("k", np.uint64, _HISTORY, _BATCH), take("c", np.uint32, _HISTORY, _BATCH)
        doc, pos = take("doc", np.int64, _BATCH), take("pos", np.int64, _BATCH)
        old = len(k) - len(doc)  # history comes first, then the batch by place
        by_place = np.lexsort((pos, doc))
        order = np.r_[np.arange(old), old + by_place]
        order = order[np.argsort(k[order], kind="stable")]
        k, c = k[order], c[order]
        doc, pos = np.r_[np.zeros(old, np.int64), doc][order], np.r_[np.full(old, -1, np.int64), pos][order]
        first = np.ones(len(k), bool)
        first[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(k) else np.zeros(0, np.int64)
        gone = ~first & (order >= old) & ((doc != doc[lead]) | (pos != pos[lead]))
        doc, pos = np.r_[doc[gone], take("doc", np.int64, _REMOVED)], np.r_[pos[gone], take("pos", np.int64, _REMOVED)]
        block = block_of(doc, blocks)
        order = np.lexsort((pos, doc, block))
        block, doc, pos = block[order], doc[order], pos[order]
        have, at = np.unique(block, return_index=True)
        cut = list(zip(at.tolist(), [*at[1:].tolist(), len(block)], strict=False))  # none if nothing goes
        blobs = lambda x: pa.array([zlib.compress(packed(x[i:j]), 1) for i, j in cut], pa.binary())
        return pa.table({"block": pa.array(have, pa.int64()), "docs": blobs(doc), "pos": blobs(pos)})

    return cands.groupBy("bucket").applyInArrow(settle, "block long, docs binary, pos binary")


class SubstringIndex:
    """Runs in a folder that driver and executors share; create or open it, then append batches.

    A manifest names the runs of each level; it is written after the files of a run, and the files that a
    compaction replaces go after that, so a lost append leaves the index as it was."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.version, self.buckets, self.window, self.gram, self.fanout = -1, 1, WINDOW, GRAM, FANOUT
        self.levels: list[list[tuple[str, list[str]]]] = []

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT) -> SubstringIndex:
        index = cls(spark, path)
        index.buckets, index.window, index.gram, index.fanout = power_of_two(buckets), window, gram, fanout
        index._commit()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SubstringIndex:
        index = cls(spark, path)
        about = spark.read.parquet(f"{index.path}/about")
        rows = about.filter(F.col("version") == about.agg(F.max("version")).first()[0]).orderBy("level", "place").collect()
        index.version, index.buckets, index.window, index.gram, index.fanout = (rows[0][c] for c in ("version", "buckets", "window", "gram", "fanout"))
        for r in rows:
            if r.level >= 0:
                index._level(r.level).append((r.keys, list(r.windows)))
        return index

    def _level(self, k: int) -> list[tuple[str, list[str]]]:
        while len(self.levels) <= k:
            self.levels.append([])
        return self.levels[k]

    def _commit(self) -> None:
        self.version += 1
        own = (self.version, self.buckets, self.window, self.gram, self.fanout)
        rows = [(*own, -1, 0, "", [])] + [(*own, k, i, *run) for k, level in enumerate(self.levels) for i, run in enumerate(level)]
        self.spark.createDataFrame(rows, "version int, buckets int, window int, gram int, fanout int, level int, place int, keys string, windows array<string>").coalesce(1).write.mode("append").parquet(f"{self.path}/about")

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{name}" for name in names])

    def _delete(self, name: str = "") -> None:
        delete_folder(self.spark, f"{self.path}/{name}".rstrip("/"))

    def _write(self, df: DataFrame, name: str) -> None:
        # the blobs are compressed already, or cannot be
        few_files(df).write.option("compression", "uncompressed").parquet(f"{self.path}/{name}")

    def merged(self, new: DataFrame, keep: bool) -> DataFrame:
        """bucket, the batch's sorted fingerprints (if kept), and those that are shared.  new: as fingerprints() gives it."""
        rows = new.withColumn("run", F.lit(-1))
        for k, (keys, _) in enumerate(r for level in self.levels for r in level):
            rows = rows.unionByName(self._read([keys]).select("bucket", "keys", F.lit(None).cast("binary").alias("twice"), F.lit(k).alias("run")))

        def join(t: pa.Table) -> pa.Table:
            runs, keys, twice = np.asarray(t["run"]), t["keys"].to_pylist(), t["twice"].to_pylist()
            mine = np.flatnonzero(runs < 0).tolist()
            k = [unpacked(keys[i], np.uint64, rising=True) for i in mine]
            more = [np.unpackbits(np.frombuffer(twice[i], np.uint8), count=len(x)).astype(bool) for i, x in zip(mine, k, strict=True)]
            k, more = np.concatenate([*k, np.zeros(0, np.uint64)]), np.concatenate([*more, np.zeros(0, bool)])
            run, again = _count_sorted(np.sort(k))
            again[np.searchsorted(run, k[more])] = True
            for i in np.flatnonzero(runs >= 0).tolist():  # each run is sorted: a merge join by binary search
                old = unpacked(zlib.decompress(keys[i]), np.uint64, rising=True)
                at = np.searchsorted(old, run)
                at[at == len(old)] = 0
                again |= old[at] == run if len(old) else False
            return pa.table({"bucket": pa.array([t["bucket"][0].as_py()], pa.int32()), "keys": pa.array([zlib.compress(packed(run, rising=True), 1) if keep else b""], pa.binary()), "shared": pa.array([packed(run[again], rising=True)], pa.binary())})

        return rows.groupBy("bucket").applyInArrow(join, "bucket int, keys binary, shared binary")

    def append(self, docs: DataFrame, blocks: int, keep: bool = True, most_bits: int = MAX_BITMAP, tagged: bool = True) -> DataFrame | None:
        """block, docs, pos: the windows of docs (doc_id, text) that start earlier, in the index or in docs.

        All documents in the index count as earlier.  docs become a run, unless keep is false.  tagged: whether
        an id may come more than once; places then have a hash of the text above their 32 low bits."""
        name = f"run-{uuid.uuid4().hex}"
        if keep:
            self._write(segments(docs, self.window, self.gram), f"{name}/windows")
            self._write(self.merged(keys_of_segments(self._read([f"{name}/windows"]), self.buckets), True), f"{name}/keys")
            got = self._read([f"{name}/keys"])
        else:
            got = saved(self.merged(fingerprints(docs, self.buckets, self.window, self.gram), False))
        flat, shift = shared_bitmap(got.select("bucket", "shared"), self.buckets, most_bits)
        gone = None
        if flat.any():
            held = self.spark.sparkContext.broadcast(flat)
            cands = candidate_windows(docs, held, shift, self.buckets, self.window, self.gram, tagged)
            stored = [x for level in self.levels for _, names in level for x in names]
            if stored:
                cands = cands.unionByName(stored_windows(self._read(stored), held, shift, self.buckets))
            gone = saved(removed_windows(cands, blocks))
            held.unpersist()
        if keep:
            self._level(0).append((f"{name}/keys", [f"{name}/windows"]))
            replaced = self._compact()
            self._commit()
            for old in replaced:
                self._delete(old)
        return gone

    def _compact(self) -> list[str]:
        """Merges levels that are full, from the lowest; the key folders that are replaced."""
        replaced, k = [], 0
        while k < len(self.levels):
            full = self.levels[k]
            if len(full) >= self.fanout:
                name = f"run-{uuid.uuid4().hex}/keys"
                self._write(self._read([keys for keys, _ in full]).select("bucket", "keys").groupBy("bucket").applyInArrow(self._one, "bucket int, keys binary"), name)
                replaced += [keys for keys, _ in full]
                self.levels[k] = []
                self._level(k + 1).append((name, [x for _, names in full for x in names]))
            k += 1
        return replaced

    @staticmethod
    def _one(t: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([unpacked(zlib.decompress(x), np.uint64, rising=True) for x in t["keys"].to_pylist()]))
        return pa.table({"bucket": pa.array([t["bucket"][0].as_py()], pa.int32()), "keys": pa.array([zlib.compress(packed(keys, rising=True), 1)], pa.binary())})


def kept_words(text: bytes, starts: np.ndarray, window: int) -> tuple[int, int, bytes]:
    """Number of words, number removed, the rest joined by one space."""
    words = text.split()
    if not len(starts):
        return len(words), 0, b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    keep = np.cumsum(cover[:-1]) == 0
    return len(words), int(len(words) - keep.sum()), b" ".join(compress(words, keep.tolist()))


def affected(gone: DataFrame, n_docs: int, most: int):
    """(broadcast bitmap of the documents that lose words, its number of bits): 16 bits a document, ``most`` in all."""
    bits = 1 << max(15, min(most.bit_length() - 1, (16 * n_docs).bit_length()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(bits // 8, np.uint8)
        for b in it:
            for blob in b["docs"].to_pylist():
                p = mix(np.unique(unpacked(zlib.decompress(blob), np.int64)).view(np.uint64)) & np.uint64(bits - 1)
                np.bitwise_or.at(flat, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        pieces = flat.reshape(-1, 4096)
        full = np.flatnonzero(pieces.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([pieces[k].tobytes() for k in full], pa.binary())], ["piece", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    for r in gone.select("docs").mapInArrow(run, "piece long, bits binary").groupBy("piece").agg(F.expr("bitmap_or_agg(bits)").alias("bits")).collect():
        out[r.piece * 4096 : (r.piece + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return gone.sparkSession.sparkContext.broadcast(out), bits


def _apply(docs: DataFrame, gone: DataFrame | None, blocks: int, make, schema: str, n_docs: int, most: int, tagged: bool) -> DataFrame:
    """make(texts, window starts to remove of each) -> arrays; only texts that lose words, and a few by chance, are moved."""
    whole = lambda it: (pa.RecordBatch.from_struct_array(t.to_struct_array().combine_chunks()) for b in it for t in [make(pa.Table.from_batches([b]), [_NONE] * b.num_rows)])
    if gone is None:
        return map_arrow(docs, whole, schema)

    held, bits = affected(gone, n_docs, most)
    block = free_name(docs, "block")

    def pick(hit: bool):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                p = mix(np.asarray(b["doc_id"].fill_null(0)).view(np.uint64)) & np.uint64(bits - 1)
                found = (held.value[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
                b = b.filter(pa.array((found & np.asarray(b["doc_id"].is_valid())) == hit))
                if b.num_rows:
                    yield b

        return run

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        read = lambda name, of: np.concatenate([*(unpacked(zlib.decompress(x), of) for x in right[name].to_pylist()), np.zeros(0, of)])
        doc, pos = read("docs", np.int64), read("pos", np.int64)
        order = np.argsort(doc, kind="stable")
        doc, pos = doc[order], pos[order]
        mine = np.asarray(left["doc_id"])
        lo, hi = np.searchsorted(doc, mine), np.searchsorted(doc, mine, side="right")
        tags = text_tags(left["text"], tagged).tolist()
        starts = [pos[a:b][pos[a:b] >> 32 == tag >> 32] - tag for a, b, tag in zip(lo.tolist(), hi.tolist(), tags, strict=True)]
        return make(left, [np.unique(x) for x in starts])

    same = map_arrow(docs, lambda it: whole(pick(False)(it)), schema)
    moved = map_arrow(docs, pick(True), docs.schema).withColumn(block, block_of(F.col("doc_id"), blocks))
    return same.unionByName(moved.groupBy(block).cogroup(gone.groupBy("block")).applyInArrow(both, schema))


_NONE = np.zeros(0, np.int64)


def _prime(n: int) -> int:
    """The least prime from n on."""
    while n < 2 or any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def remove_repeats(docs: DataFrame, make, schema: str, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: SubstringIndex | None = None, most_bits: tuple[int, int] = (MAX_BITMAP, MOST_BITS)) -> DataFrame:
    """Runs docs (doc_id, text, ...) through an index, batch by batch in order of ids.

    Without an index a new one serves for this call alone.  A given one has earlier data, which counts as
    earlier whatever its ids, and gains the new batches."""
    if index is not None and (index.window, index.gram) != (window, gram):
        raise ValueError("the index has other windows")
    spark = docs.sparkSession
    told = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    blocks = _prime(8 + (told.size >> BLOCK_BYTES))
    own, gones = index is None, []
    tagged = not docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()
    if told.lo is not None:
        if index is None:
            shared_dir(spark)
            index = SubstringIndex.create(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/substring-{uuid.uuid4().hex}", max(8, told.size >> BUCKET_BYTES), window, gram)
        ends = docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
        cuts = sorted({told.lo, told.hi + 1, *(min(max(int(x), told.lo), told.hi) for x in ends)})
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            batch = docs.filter((F.col("doc_id") >= lo) & (F.col("doc_id") < hi)).select("doc_id", "text")
            gone = index.append(batch, blocks, not own or hi <= told.hi, most_bits[0], tagged)
            if gone is not None:
                gones.append(gone)
        if own:
            index._delete()
    gone = gones[0] if gones else None
    for more in gones[1:]:
        gone = gone.unionByName(more)
    return _apply(docs, gone, blocks, make, schema, told.n, most_bits[1], tagged)


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(t: pa.Table, starts: list[np.ndarray]) -> pa.Table:
        rows = [kept_words(x.encode(), s, WINDOW) for x, s in zip(t["text"].to_pylist(), starts, strict=True)]
        return pa.table({"doc_id": t["doc_id"], "n_words": pa.array([r[0] for r in rows], pa.int64()), "n_removed": pa.array([r[1] for r in rows], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())})

    return remove_repeats(id_text(table(spark, sf_dir, "documents")), digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_from_documents(docs: DataFrame, index: SubstringIndex | None = None) -> DataFrame:
    """docs with repeated passages cut out of ``text``; a text that loses nothing stays byte for byte.

    Words that stay are joined by one space in texts that lose some; ``n_chars``, if there, is set anew."""
    names, schema = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def cut(t: pa.Table, starts: list[np.ndarray]) -> pa.Table:
        old = t["text"].to_pylist()
        new = [kept_words(x.encode(), s, WINDOW)[2].decode() if x is not None and len(s) else x for x, s in zip(old, starts, strict=True)]
        cols = {c: t[c] for c in names}
        cols["text"] = pa.array(new, pa.string())
        if "n_chars" in cols:
            cols["n_chars"] = pa.array([len(x) if x is not y and x is not None else n for x, y, n in zip(new, old, t["n_chars"].to_pylist(), strict=True)], t.schema.field("n_chars").type)
        return pa.table(cols)

    return remove_repeats(docs.withColumn("doc_id", F.col("doc_id").cast("long")), cut, schema, index=index)
