"""Packing token sequences by first-fit decreasing, with a tournament tree over bin capacities.

Each document's ids, with the end id, are cut into full sequences and one rest.  Rests are dealt into
random groups by a hash of the id; a group holds some thousand rests however many documents there
are, so groups pack independently and in parallel; full sequences need no group and no shuffle.  Within a group rests go from long to short, each
into the first bin that has room; the tournament tree finds that bin in log(bins) steps.  Only ids,
lengths and checksums are shuffled, never tokens.

An empty or null text is its end id alone.  Rows that repeat an id are packed one by one.  A very long
text yields many full sequences and one rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.bpe import read_ranks
from provena.llm.common import id_text, map_arrow, saved, table

SEQUENCE = 2048
END_ID = 1
#: Rests that a group holds on average.
GROUP = 4096


class FirstFit:
    """Bins of one size; put(n) gives the first bin with room for n, and the place in it."""

    def __init__(self, size: int, most_bins: int):
        self.size, self.leaves = size, 1
        while self.leaves < max(1, most_bins):
            self.leaves *= 2
        self.room = [size] * (2 * self.leaves)

    def put(self, n: int) -> tuple[int, int]:
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < n:
                i += 1
        place = self.size - room[i]
        room[i] -= n
        found = i - self.leaves
        while i > 1:
            i //= 2
            best = max(room[2 * i], room[2 * i + 1])
            if room[i] == best:
                break
            room[i] = best
        return found, place


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, all between 1 and size; ties keep their order."""
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = FirstFit(size, len(lengths))
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i], places[i] = tree.put(int(lengths[i]))
    return bins, places


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})


class IdBytes:
    """A text's ids as little-endian 32-bit integers.

    The tokenizer file and the rank file hold one vocabulary; the merges run by rank over whole texts, and
    texts that name a special token go through the tokenizer file itself."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        self.json_path, self.encode, self.whole = json_path, _encoder(ranks_path, pattern).encode_to_numpy, None

    def __call__(self, text: str) -> bytes:
        if "<|" not in text:
            return self.encode(text).astype("<u4", copy=False).tobytes()
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.json_path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def _id_bytes(json_path: str, ranks_path: str, pattern: str) -> IdBytes:
    return IdBytes(json_path, ranks_path, pattern)


_CUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(df: DataFrame, json_path: str, ranks_path: str, pattern: str, size: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: full sequences, then the rest; with their ids if keep_ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _id_bytes(json_path, ranks_path, pattern)
        for b in it:
            rows: list[tuple] = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                data = ids_of(text) + end
                n = len(data) // 4
                for at in range(0, n, size):
                    part = data[4 * at : 4 * (at + size)]
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), n) + ((np.frombuffer(part, "<u4").astype(np.int32),) if keep_ids else ()))
            cols = list(zip(*rows, strict=True))
            out = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.list_(pa.int32())) for c in cols[5:]]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids)

    return map_arrow(df, run, _CUT + ", ids array<int>" * keep_ids)


def pack_pieces(pieces: DataFrame, size: int = SEQUENCE, group: int = GROUP, seed: int = 7) -> DataFrame:
    """pieces (doc_id, start, length, ...) with sequence_id and offset added.

    Full pieces are sequences of their own, numbered where they are: odd numbers, by partition and place
    in it.  Rests go to their group; sequences there have even numbers, by group and bin."""
    n = pieces.filter(F.col("length") < size).count()
    groups = max(1, -(-n // group))
    ties = [c for c in ("ids_crc32", "doc_tokens") if c in pieces.columns]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", *ties], kind="stable").reset_index(drop=True)
        bins, places = first_fit_decreasing(pdf["length"].to_numpy(), size)
        number = pdf.pop("pack_group").to_numpy()
        return pdf.assign(sequence_id=2 * (bins * groups + number), offset=places)

    # hash_group is uniform, so no group outgrows the mean by more than chance
    rests = pieces.filter(F.col("length") < size).withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", F.lit(seed)), F.lit(groups)))
    packed = rests.groupBy("pack_group").applyInPandas(pack, f"{schema}, sequence_id long, offset long")
    full = pieces.filter(F.col("length") >= size)
    return full.withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long")).unionByName(packed)


def pack_documents(df: DataFrame, json_path: str, ranks_path: str, pattern: str, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset: one row for each piece."""
    pieces = saved(cut_documents(id_text(df, id_col, text_col), json_path, ranks_path, pattern, size, keep_ids=keep_ids))
    return pack_pieces(pieces, size)


def documents_packed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers as p

    return pack_documents(docs, p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_packed(spark, table(spark, sf_dir, "documents"))
