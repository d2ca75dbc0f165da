"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are turned by a fixed random rotation and split into blocks of ``BLOCK`` coordinates.  A
pair within squared distance e has a block within its proportional share e * BLOCK / dim, so it is
enough to range-join each block under that share and to verify the union of candidates by cosine in
double precision.  Vectors are dealt into chunks of about ``CHUNK`` by a hash; a cell holds one pair of
chunks, range-joins all blocks there in tiles, and verifies each candidate once.  So a vector is sent
once for each chunk of the table, whatever the number of blocks.  Cells return link counts and spanning
edges, never pairs.

Low-dimensional cells of space cannot replace chunks here: at cosine 0.9 the radius of a block is
1.3 to 1.8 standard deviations of its coordinates, so a grid on k coordinates sends a vector to 3**k
cells to leave out a share of 1 - 0.75**k of the pairs (see the README for figures).

Equal vectors form one class that is compared once.  Vectors that are null, empty, zero, or hold a null
or non-finite component link with nothing; vectors of different lengths do not link.  Rows that repeat
a vec_id count as further vectors of that id.  Rows without a vec_id count as vectors, link others and
are linked, but give no component its name.  Ties at the threshold link.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import saved, table
from provena.llm.graph import Sets, components

COSINE, BLOCK, CHUNK, TILE = 0.9, 16, 16384, 512


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(17).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _spans(dim: int) -> list[tuple[int, int]]:
    return [(a, min(dim, a + BLOCK)) for a in range(0, dim, BLOCK)]


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


_CLASS = "vec_id long, dim int, d1 long, d2 long, vec binary"


def read_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, and of usable vectors the length, digest and components in double; else nulls."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            dim, d1, d2, vec = [], [], [], []
            for x in b["v"]:
                v = None
                if x.is_valid and len(x.values) and not x.values.null_count:
                    v = x.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zero
                    if not np.isfinite(v).all() or not v.any():
                        v = None
                if v is None:
                    for c in (dim, d1, d2, vec):
                        c.append(None)
                    continue
                raw = v.tobytes()
                h = hashlib.blake2b(raw, digest_size=16).digest()
                dim.append(len(v))
                d1.append(int.from_bytes(h[:8], "little", signed=True))
                d2.append(int.from_bytes(h[8:], "little", signed=True))
                vec.append(raw)
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(dim, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(vec, pa.binary())], ["vec_id", "dim", "d1", "d2", "vec"])

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).mapInArrow(run, _CLASS)


def linked(u: np.ndarray, home: np.ndarray, away: np.ndarray | None, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of u, one of home and one of away (None: two of home), within the cosine."""
    dim, turned, other = u.shape[1], u @ rotation(u.shape[1]), home if away is None else away
    left, right, least = [], [], []
    for lo, hi in _spans(dim):  # x y - x x / 2 - y y / 2, minus half a squared distance, as one product
        x = turned[:, lo:hi].astype(np.float32)
        half = (x * x).sum(1, keepdims=True) / 2
        one = np.ones_like(half)
        left.append(np.hstack([x, -half, one]))
        right.append(np.hstack([x, one, -half]))
        least.append(-np.float32((1 - cosine) * (hi - lo) / dim + 1e-5))
    for s in range(0, len(home), TILE):
        mine = home[s : s + TILE]
        for t in range(s if away is None else 0, len(other), 4 * TILE):
            theirs = other[t : t + 4 * TILE]
            near = np.zeros((len(mine), len(theirs)), bool)
            for x, y, k in zip(left, right, least, strict=True):
                near |= x[mine] @ y[theirs].T >= k
            if away is None:
                near &= (s + np.arange(len(mine)))[:, None] < (t + np.arange(len(theirs)))[None]
            found = int(near.sum())
            if 16 * found > near.size:  # many candidates: all cosines of the tile at once
                i, j = np.nonzero(near & (u[mine] @ u[theirs].T >= cosine))
            elif found:
                i, j = np.nonzero(near)
                close = np.einsum("ij,ij->i", u[mine[i]], u[theirs[j]]) >= cosine
                i, j = i[close], j[close]
            if found and len(i):
                yield mine[i], theirs[j]


_ROW = "dim int, c1 int, c2 int, side int, rep long, mult long, vec binary"


def _join(reps: DataFrame, cosine: float, chunk: int) -> DataFrame:
    """kind 0: (class, number of linked vectors in other classes); kind 1: (class, class) spanning edges."""
    parts = {r.dim: -(-r["count"] // chunk) for r in reps.groupBy("dim").count().collect()}
    number = F.element_at(F.create_map(*[F.lit(x) for k, v in parts.items() for x in (k, v)]), F.col("dim")) if parts else F.lit(1)
    c, n = F.col("c"), F.col("parts")
    dealt = reps.withColumn("parts", number).withColumn("c", F.pmod(F.xxhash64("rep"), n).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)))
    dealt = dealt.select("dim", F.least("c", "o").alias("c1"), F.greatest("c", "o").alias("c2"), (c > F.col("o")).cast("int").alias("side"), "rep", "mult", "vec")

    def compare(t: pa.Table) -> pa.Table:
        same = t["c1"][0].as_py() == t["c2"][0].as_py()
        u = unit(np.frombuffer(b"".join(t["vec"].to_pylist()), np.float64).reshape(-1, t["dim"][0].as_py()))
        side, rep, mult = (np.asarray(t[c].combine_chunks()) for c in ("side", "rep", "mult"))
        order = np.argsort(rep, kind="stable")
        u, side, rep, mult = u[order], side[order], rep[order], mult[order]
        sets, links = Sets(len(u)), np.zeros(len(u))
        for a, b in linked(u, np.flatnonzero(side == 0), None if same else np.flatnonzero(side == 1), cosine):
            links += np.bincount(a, mult[b], len(u)) + np.bincount(b, mult[a], len(u))
            sets.join(a, b)
        n, e = np.flatnonzero(links), np.flatnonzero(sets.lead != np.arange(len(u)))
        return pa.table({"kind": pa.array(np.r_[np.zeros(len(n), np.int32), np.ones(len(e), np.int32)], pa.int32()), "a": np.r_[rep[n], rep[e]], "b": np.r_[links[n].astype(np.int64), rep[sets.lead[e]]]})

    return dealt.select(*[x.split()[0] for x in _ROW.split(", ")]).groupBy("dim", "c1", "c2").applyInArrow(compare, "kind int, a long, b long")


def near_vectors(df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept, class_id (smallest vec_id of an equal vector; null if unusable)."""
    rows = saved(read_vectors(df, id_col, vec_col))
    key = ["d1", "d2"]
    # a class is known by its digest; its name, the smallest id, comes back at the end
    reps = saved(rows.filter("vec is not null").groupBy(*key).agg(F.min("vec_id").alias("name"), F.count("*").alias("mult"), F.first("dim").alias("dim"), F.first("vec").alias("vec")).withColumn("rep", F.xxhash64(*key)))
    found = saved(_join(reps.select("rep", "mult", "dim", "vec"), cosine, chunk))
    links = found.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    comps = components(found.filter("kind = 1").select("a", "b")).select(F.col("node").alias("rep"), "component")
    classes = saved(reps.select(*key, "rep", "name", "mult").join(links, "rep", "left").join(comps, "rep", "left").select(*key, "name", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "rep").alias("component")))
    names = classes.groupBy("component").agg(F.min("name").alias("component_id"))
    classes = classes.join(names, "component").select(*key, F.col("name").alias("class_id"), "links", "component_id")
    out = rows.select("vec_id", *key).join(classes, key, "left")
    comp = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("vec_id"), F.lit(False)).alias("kept"), "class_id")


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
