"""Shared pieces of the training-data operators: Arrow maps, word hashing over raw bytes, checkpoints.

A word is ``[^\\x20\\x09-\\x0D]+``.  Words are hashed without being built as Python objects: a batch
of texts stays one byte buffer, a prefix sum of ``value[byte] * P**i`` over tiles of fixed size gives
each word's 64-bit hash in a few vector passes.  Two different words share a hash with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text per Arrow batch: some MB of text, whatever the length of the table.
BATCH_ROWS = 1024
#: Bytes of text that a worker takes in hand at once; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20
#: Bytes, or words, that are hashed at once; longer runs go through in tiles, so scratch memory is fixed.
TILE = 1 << 16
#: Bits of the broadcast bitmap of ids, 8 MB; a fuller one lets more rows through to the join behind it.
MOST_BITS = 1 << 26
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    plain = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    lower = plain.copy()
    lower[65:91] = plain[97:123]
    return plain, lower


_PLAIN, _LOWER = _byte_values()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=32)
def _powers(base: int, extra: int = 0) -> np.ndarray:
    """base**0 .. base**(TILE + extra - 1) modulo 2**64: half a megabyte, however long the texts are."""
    have = np.ones(1, dtype=np.uint64)
    while len(have) < TILE + extra:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    return have[: TILE + extra].copy()


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array (null: empty) and the n+1 offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(offsets):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and the n+1 word offsets of the texts."""
    n = len(buf)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(offsets), dtype=np.int64)
    solid = np.empty(n + 1, dtype=bool)
    solid[:n] = ~_SPACE[buf]
    solid[n] = False
    edge = np.empty(n + 1, dtype=bool)  # a word begins here
    edge[0] = solid[0]
    np.greater(solid[1:], solid[:-1], out=edge[1:])
    last = np.empty(n + 1, dtype=bool)  # a word ends before here
    last[0] = False
    np.less(solid[1:], solid[:-1], out=last[1:])
    inner = offsets[(offsets > 0) & (offsets < n)]
    joined = inner[solid[inner] & solid[inner - 1]]
    edge[joined] = True
    last[joined] = True
    starts, ends = np.flatnonzero(edge), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans rise and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    value, up, down = _LOWER if lower else _PLAIN, _powers(_BASE), _powers(_BASE_INV)
    total = np.zeros(TILE + 1, dtype=np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(ends, a + TILE, side="right"))
        if j > i:
            n = int(ends[j - 1]) - a
            np.cumsum(value[buf[a : a + n]] * up[:n], out=total[1 : n + 1])
            lo = starts[i:j] - a
            out[i:j] = (total[ends[i:j] - a] - total[lo]) * down[lo]
            i = j
        else:  # a span longer than a tile
            h = 0
            for at in range(a, int(ends[i]), TILE):
                part = value[buf[at : min(at + TILE, int(ends[i]))]]
                h += int((part * up[: len(part)]).sum()) * pow(_BASE, at - a, 1 << 64)
            out[i] = h % (1 << 64)
            i += 1
    return mix(out + (ends - starts).astype(np.uint64))


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, word offsets of the texts, byte starts, byte ends, bytes)."""
    buf, offsets = text_buffer(texts)
    starts, ends, woff = word_spans(buf, offsets)
    return span_hashes(buf, starts, ends, lower), woff, starts, ends, buf


def window_hashes(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of n consecutive entries of h; len(h) - n + 1 of them, order matters."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    base = (_BASE + 2 * salt * 0x632BE59BD9B4E019) & ((1 << 64) - 1) | 1
    up, down = _powers(base, n), _powers(pow(base, -1, 1 << 64))
    out, total = np.empty(count, dtype=np.uint64), np.zeros(TILE + n, dtype=np.uint64)
    for at in range(0, count, TILE):
        k = min(TILE, count - at)
        np.cumsum(h[at : at + k + n - 1] * up[: k + n - 1], out=total[1 : k + n])
        out[at : at + k] = mix((total[n : k + n] - total[:k]) * down[:k])
    return out


def window_mask(woff: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which of the ``count`` windows of n words lie in one text."""
    if count <= 0:
        return np.zeros(0, dtype=bool)
    crossing = np.zeros(count + 1, dtype=np.int32)
    ends = woff[1:-1]
    ends = ends[(ends > 0) & (ends < woff[-1])]
    lo, hi = np.clip(ends - n + 1, 0, count), np.clip(ends, 0, count)
    np.add.at(crossing, lo, 1)
    np.add.at(crossing, hi, -1)
    return np.cumsum(crossing[:-1]) == 0


def doc_of(woff: np.ndarray) -> np.ndarray:
    """Text index of each word."""
    return np.repeat(np.arange(len(woff) - 1), np.diff(woff))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, unless the session already asks for smaller ones.

    Only queries and pipeline stages call this; operators leave the session as it is and cut what they get."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))  # else 4096 texts at once on the heap


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id, as a long, and the text, null as empty: other columns never reach a shuffle."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores behind it, so that df has no such column in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(x: np.ndarray, width: int | None = None, rising: bool = False) -> bytes:
    """x byte plane by byte plane, so that planes of zeros compress; only the low ``width`` bytes; rising: as steps."""
    if rising:
        x = np.diff(x, prepend=x.dtype.type(0))
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T[:width]).tobytes()


def unpacked(blob: bytes, of: type, width: int | None = None, rising: bool = False) -> np.ndarray:
    size = np.dtype(of).itemsize
    planes = np.frombuffer(blob, np.uint8).reshape(width or size, -1)
    x = np.zeros((planes.shape[1], size), np.uint8)
    x[:, : width or size] = planes.T
    x = x.view(of).ravel()
    return np.cumsum(x, dtype=of) if rising else x


def power_of_two(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def row_bytes(b: pa.RecordBatch) -> np.ndarray:
    """Bytes of strings and binaries in each row, and some for the rest."""
    size = np.full(b.num_rows, 64, np.int64)
    for c in b.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            size += np.asarray(pc.fill_null(pc.binary_length(c), 0), dtype=np.int64)
    return size


def batches(it: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes and BATCH_ROWS rows, or of one longer row."""
    for b in it:
        total = np.cumsum(row_bytes(b))
        i = 0
        while i < b.num_rows:
            before = int(total[i - 1]) if i else 0
            j = min(max(i + 1, int(np.searchsorted(total, before + limit, side="right"))), i + BATCH_ROWS)
            yield b.slice(i, j - i)
            i = j


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow over batches of bounded size."""
    return df.mapInArrow(lambda it: fn(batches(it)), schema)


def shared_dir(spark: SparkSession) -> None:
    """checkpoint() needs a shared folder: the session's own setting, or one of this machine in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if told is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import atexit
        import shutil
        import tempfile

        told = tempfile.mkdtemp(prefix="provena_checkpoints_")
        atexit.register(shutil.rmtree, told, ignore_errors=True)
    sc.setCheckpointDir(told)


def few_files(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df in at most four partitions a core, and one for each 50,000 rows if their number is known, so that a
    write does not make thousands of small files."""
    most = max(16, 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.coalesce(most if rows is None else min(most, 1 + rows // 50_000))


def saved(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, computed once and kept as files in the shared folder; survives lost executors.  rows: about how many, if known."""
    shared_dir(df.sparkSession)
    return few_files(df, rows).checkpoint(eager=True)


def id_bitmap(wanted: DataFrame, most: int = MOST_BITS):
    """(broadcast bitmap of hashed ids, its number of bits): 16 bits an id, ``most`` in all."""
    count = wanted.count()
    bits = 1 << max(15, min(most.bit_length() - 1, (16 * count).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    # Spark numbers bits from 1, in buckets of 32768 that are numbered from 1 too
    rows = wanted.select((place + 1).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect()
    flat = np.zeros(bits // 8, np.uint8)
    for r in rows:
        flat[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return wanted.sparkSession.sparkContext.broadcast(flat), bits


def in_bitmap(flat: np.ndarray, place: pa.Array) -> np.ndarray:
    """Which places are set; a null place counts as 0."""
    p = np.asarray(place.fill_null(0))
    return (flat[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0


def delete_folder(spark: SparkSession, path: str) -> None:
    """Through Spark's own file systems, so wherever the folder is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as the queries read it."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
