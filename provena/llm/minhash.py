"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. One pass over the texts: each document's distinct word shingles, their number, a digest of the set,
   ``HASHES`` minima of which 2 low bits are packed into four longs, and keys of ``BANDS`` bands of
   ``ROWS`` full minima.  Documents with equal sets form a class; the rest works on one
   representative a class, so thousands of copies cost one row.
2. Band keys propose links: first each representative with the smallest one of its bucket, so a bucket
   of n gives n-1 links.  Links whose sizes, or whose similarity as estimated by bit counts and
   corrected for chance agreement, exclude the threshold fall out; the others are confirmed on the
   full sets.
3. Buckets whose members are by then all connected are done.  In the others the largest component is
   set against the rest, and the rest against itself, in cells of bounded size.  First with signatures
   alone: a representative goes on if some other component has one that it may link with and that it
   meets in no earlier band.  Only for those are sets made and sent; a cell confirms the pairs and
   returns spanning edges, never pairs.
4. Components of confirmed links.

A pair at the threshold shares no band with probability (1 - t**ROWS)**BANDS, 4e-7 at 0.85, and the
estimate errs by over five standard deviations below ``t - SLACK``.

Texts without a word, and nulls, have the empty set and link with nothing.  Texts with fewer words
than a shingle have one shingle, the whole sequence.  Rows that repeat a doc_id are one document: they
share its component and are linked by the text of any of them.  Rows without a doc_id link with
nothing: their component is null and they are not kept.  Other columns of the table are not looked at.
A long text is hashed in tiles; its memory is some eight times its words, at eight bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.llm.common import MOST_BITS, free_name, id_bitmap, id_text, in_bitmap, map_arrow, mix, saved, table, window_hashes, window_mask, word_hashes
from provena.llm.graph import Sets, components

HASHES, BANDS, ROWS, SLACK = 128, 25, 5, 0.2
#: Representatives on each side of a cell while only signatures are compared, and shingles while sets are.
CELL_ROWS, CELL_ITEMS = 8192, 1 << 20
_RNG = np.random.default_rng(20240601)
_A = (_RNG.integers(1, 1 << 31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of 54 bits, sorted within each text; offsets of the texts), of up to 1024 texts."""
    h, woff, *_ = word_hashes(texts, lower=True)
    count = len(woff) - 1
    words = np.diff(woff)
    key = window_hashes(h, n)
    key = mix(key[window_mask(woff, n, len(key))])
    key >>= np.uint64(10)
    key |= np.repeat(np.arange(count, dtype=np.uint64) << np.uint64(54), np.maximum(words - n + 1, 0))
    for k in range(1, n):  # whole sequences shorter than a shingle
        few = np.flatnonzero(words == k)
        if len(few):
            x = np.full(len(few), k, np.uint64)
            for j in range(k):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[woff[few] + j])
            key = np.r_[key, few.astype(np.uint64) << np.uint64(54) | mix(x) >> np.uint64(10)]
    key.sort()
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    inner = np.searchsorted(key, np.arange(1, count, dtype=np.uint64) << np.uint64(54)) if count > 1 else []
    return key & np.uint64((1 << 54) - 1), np.r_[[0], inner, [len(key)] * min(count, 1)].astype(np.int64)


def minima(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HASHES minima of each non-empty set, as rows of uint32; empty sets have the largest value."""
    n = len(offsets) - 1
    out = np.full((n, HASHES), 0xFFFFFFFF, np.uint32)
    x = mix(sets).astype(np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    i = 0
    while i < len(full):
        j = i + 1
        while j < len(full) and offsets[full[j] + 1] - offsets[full[i]] <= 32768:
            j += 1
        some = full[i:j]
        part = x[offsets[some[0]] : offsets[some[-1] + 1]]
        cut = offsets[some] - offsets[some[0]]
        got = np.empty((HASHES, len(some)), np.uint32)
        for k in range(HASHES):
            got[k] = np.minimum.reduceat(part * _A[k] + _B[k], cut)
        out[some] = got.T
        i = j
    return out


def packed_bits(m: np.ndarray) -> np.ndarray:
    """The 2 low bits of 128 minima as four unsigned longs a row."""
    bits = (m & np.uint32(3)).astype(np.uint64).reshape(len(m), 4, 32)
    return (bits << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(2, dtype=np.uint64)


def band_keys(m: np.ndarray) -> np.ndarray:
    keys = np.empty((len(m), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(m), b + 1, np.uint64)
        for r in range(ROWS):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + m[:, b * ROWS + r])
        keys[:, b] = x
    return keys


_SIG = "doc_id long, n long, d1 long, d2 long, s0 long, s1 long, s2 long, s3 long, bands array<long>"


def digests(sets: np.ndarray, off: np.ndarray, salt: int) -> np.ndarray:
    """A signed 64-bit sum of each set's mixed entries."""
    total = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(mix(sets ^ np.uint64(salt * 0x100000001B3 % (1 << 64))), out=total[1:])
    return (total[off[1:]] - total[off[:-1]]).view(np.int64)


def signatures(df: DataFrame, words: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets, off = shingle_sets(b["text"], words)
            sums = [pa.array(digests(sets, off, salt)) for salt in (0x51ED270B, 0x2545F491)]
            m = minima(sets, off)
            sig = packed_bits(m).view(np.int64)
            keys = band_keys(m).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.diff(off), pa.int64()), *sums, *[pa.array(np.ascontiguousarray(sig[:, k])) for k in range(4)], bands], [c.split()[0] for c in _SIG.split(", ")])

    return map_arrow(df, run, _SIG)


def agreement(x: str, y: str) -> Column:
    """Similarity from the number of equal 2-bit fields, corrected for the quarter that agree by chance."""
    differ = None
    for k in range(4):
        d = F.col(f"{x}s{k}").bitwiseXOR(F.col(f"{y}s{k}"))
        d = F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        differ = d if differ is None else differ + d
    return ((1 - differ / HASHES) - 0.25) / 0.75


def may_link(x: str, y: str, percent: int) -> Column:
    small, large = F.least(f"{x}n", f"{y}n"), F.greatest(f"{x}n", f"{y}n")
    return (small * 100 >= large * percent) & (agreement(x, y) >= percent / 100 - SLACK)


def sets_of(df: DataFrame, wanted: DataFrame, words: int, most: int = MOST_BITS) -> DataFrame:
    """rep, digest and items (sorted shingles) of the wanted ids, one row for each different set.

    A bitmap of the ids, of bounded size, goes to all tasks and keeps most other texts from being cut
    into shingles; ids that pass it by chance fall out by the join."""
    held, bits = id_bitmap(wanted, most)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            take = np.flatnonzero(in_bitmap(held.value, b["p"]))
            if not len(take):
                continue
            b = b.take(pa.array(take))
            sets, off = shingle_sets(b["text"], words)
            at = off.tolist()
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(digests(sets, off, 0x51ED270B)), pa.array([sets[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())], ["rep", "digest", "items"])

    rows = map_arrow(df.filter("doc_id is not null").withColumn("p", place), run, "rep long, digest long, items binary")
    return rows.join(wanted.select(F.col("doc_id").alias("rep")), "rep", "left_semi").dropDuplicates(["rep", "digest"])


def common_items(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Size of the intersection of each pair of sorted sets; up to 1024 pairs."""
    size = np.array([(len(a) + len(b)) // 8 for a, b in zip(x, y, strict=True)])
    owner = np.repeat(np.arange(len(x), dtype=np.uint64), size)
    key = np.frombuffer(b"".join(v for pair in zip(x, y, strict=True) for v in pair), np.uint64) | owner << np.uint64(54)
    key.sort()
    return np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(54)).astype(np.int64), minlength=len(x))


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough."""
    ids = saved(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    sets = saved(sets_of(docs, ids, words).select("rep", "items"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, y = b["x"].to_pylist(), b["y"].to_pylist()
            common = common_items(x, y)
            union = np.array([(len(v) + len(w)) // 8 for v, w in zip(x, y, strict=True)]) - common
            yield b.select(["a", "b"]).filter(pa.array(common * 100 >= union * percent))

    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("items").alias("y")), "b")
    return map_arrow(both.select("a", "b", "x", "y"), run, "a long, b long")


def in_cells(rows: DataFrame, most: int) -> DataFrame:
    """rows (band, rep, component, weight, ...) of buckets with several components, dealt to cells.

    Side 0 of a cell is a chunk of the members outside the bucket's largest component, side 1 a chunk of
    the largest one (c2 < 0), or another chunk of the others; the cells of one bucket cover all pairs
    across components.  A bucket in one cell shares its ``task`` with other such buckets."""
    by_component = rows.groupBy("band", "component").agg(F.sum("weight").alias("weight"))
    told = by_component.groupBy("band").agg(F.max(F.struct("weight", "component")).alias("top"), F.sum("weight").alias("all")).filter(F.col("all") > F.col("top.weight"))
    told = told.select("band", F.col("top.component").alias("anchor"), F.ceil((F.col("all") - F.col("top.weight")) / most).cast("int").alias("others"), F.ceil(F.col("top.weight") / most).cast("int").alias("tops"))
    top = F.col("component") == F.col("anchor")
    x = rows.join(told, "band").withColumn("c", F.pmod(F.xxhash64("rep", F.lit(1)), F.when(top, F.col("tops")).otherwise(F.col("others"))).cast("int"))
    cell = lambda c1, c2, side: F.struct(c1.cast("int").alias("c1"), c2.cast("int").alias("c2"), side.cast("int").alias("side"))
    c = F.col("c")
    with_top = F.transform(F.sequence(F.lit(0), F.col("tops") - 1), lambda k: cell(c, -1 - k, F.lit(0)))
    with_others = F.transform(F.filter(F.sequence(F.lit(0), F.col("others") - 1), lambda o: o != c), lambda o: cell(F.least(c, o), F.greatest(c, o), c > o))
    as_top = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: cell(o, -1 - c, F.lit(1)))
    x = x.withColumn("cell", F.explode(F.when(top, as_top).otherwise(F.concat(with_top, with_others)))).select("*", "cell.c1", "cell.c2", "cell.side")
    alone = (F.col("others") == 1) & (F.col("tops") == 1)
    total = rows.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    shared = F.pmod(F.xxhash64("band"), F.lit(1 + 2 * total // most))
    return x.withColumn("task", F.when(alone, shared).otherwise(F.xxhash64("band", "c1", "c2"))).drop("cell", "c", "others", "tops", "anchor")


_CELL = ("task", "band", "c1", "c2", "side", "rep", "component", "n", "s0", "s1", "s2", "s3", "bands")


class Cells:
    """The cells of one task: rows sorted by cell, side and representative."""

    def __init__(self, t: pa.Table, percent: int):
        col = lambda c: np.asarray(t[c].combine_chunks())
        self.band, self.c1, self.c2, self.side, self.rep, self.comp, self.n = map(col, ("band", "c1", "c2", "side", "rep", "component", "n"))
        self.percent = percent
        self.order = np.lexsort((self.rep, self.side, self.c2, self.c1, self.band))
        for k in ("band", "c1", "c2", "side", "rep", "comp", "n"):
            setattr(self, k, getattr(self, k)[self.order])
        self.sig = np.stack([col(f"s{k}") for k in range(4)], 1).view(np.uint64)[self.order]
        self.keys = np.asarray(t["bands"].combine_chunks().flatten()).reshape(-1, BANDS)[self.order]

    def __iter__(self) -> Iterator[tuple[int, int]]:
        new = (np.diff(self.band) != 0) | (np.diff(self.c1) != 0) | (np.diff(self.c2) != 0)
        cuts = np.r_[0, np.flatnonzero(new) + 1, len(self.rep)].tolist()
        yield from zip(cuts, cuts[1:], strict=False)

    def pairs(self, a: int, z: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of the cell a..z that may link and share no earlier band, some at a time."""
        rep, comp, n, sig, keys, percent = self.rep, self.comp, self.n, self.sig, self.keys, self.percent
        home = a + int((self.side[a:z] == 0).sum())
        inner = int(self.c2[a]) == -1  # the cell that also compares its side 0 with itself
        here = int(np.flatnonzero(keys[a] == self.band[a])[0])
        step = max(1, (1 << 17) // (z - a))
        for s in range(a, home, step):
            i, j = np.arange(s, min(home, s + step)), np.arange(s + 1 if inner else home, z)
            ok = comp[i][:, None] != comp[j][None]
            if inner:
                ok &= i[:, None] < j[None]
            x, y = n[i][:, None] * 100, n[j][None] * 100
            ok &= (x >= n[j][None] * percent) & (y >= n[i][:, None] * percent)
            p, q = np.nonzero(ok)
            p, q = i[p], j[q]
            d = sig[p] ^ sig[q]
            differ = np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(1, dtype=np.int64)
            near = np.flatnonzero(((1 - differ / HASHES) - 0.25) / 0.75 >= percent / 100 - SLACK)
            p, q = p[near], q[near]
            first = ~(keys[p, :here] == keys[q, :here]).any(1)
            if first.any():
                yield p[first], q[first]


def survivors(rows: DataFrame, percent: int, most: int = CELL_ROWS) -> DataFrame:
    """Of rows (band, rep, component, n, s0.., bands): band and rep of those in a pair that may link."""

    def run(t: pa.Table) -> pa.Table:
        cells = Cells(t, percent)
        hit = np.zeros(len(cells.rep), bool)
        for a, z in cells:
            for p, q in cells.pairs(a, z):
                hit[p] = hit[q] = True
        return pa.table({"band": cells.band[hit], "rep": cells.rep[hit]})

    dealt = in_cells(rows.withColumn("weight", F.lit(1)), most)
    return dealt.select(*_CELL).groupBy("task").applyInArrow(run, "band long, rep long").distinct()


def across(rows: DataFrame, docs: DataFrame, words: int, percent: int, cell_rows: int = CELL_ROWS, cell_items: int = CELL_ITEMS) -> DataFrame:
    """Spanning edges (a, b) of confirmed links between different components of the same bucket."""
    found = saved(survivors(rows, percent, cell_rows))
    ids = saved(found.select(F.col("rep").alias("doc_id")).distinct())
    items = saved(sets_of(docs, ids, words).select("rep", "items"))
    dealt = in_cells(rows.join(found, ["band", "rep"], "left_semi").withColumn("weight", F.col("n")), cell_items)

    def run(t: pa.Table) -> pa.Table:
        cells = Cells(t, percent)
        lists = t["items"].combine_chunks().take(pa.array(cells.order))
        size = np.asarray(pc.binary_length(lists)).astype(np.int64) // 8
        end = np.cumsum(size)
        begin = end - size
        _, local = np.unique(np.frombuffer(b"".join(lists.to_pylist()), np.uint64), return_inverse=True)
        mark = np.zeros(int(local.max(initial=-1)) + 1, np.int32)
        a_, b_ = [], []
        for a, z in cells:
            sets, comp = Sets(z - a), cells.comp[a:z]
            _, lead, which = np.unique(comp, return_index=True, return_inverse=True)
            sets.join(np.arange(z - a), lead[which])
            for p, q in cells.pairs(a, z):
                for i in np.unique(p).tolist():
                    j = q[p == i]
                    j = j[sets.lead[j - a] != sets.lead[i - a]]
                    if not len(j):
                        continue
                    mine = local[begin[i] : end[i]]
                    mark[mine] = 1
                    k = 0
                    while k < len(j):  # some hundred thousand items at a time
                        m = k + max(1, int(np.searchsorted(np.cumsum(size[j[k:]]), 300_000)))
                        some, starts = j[k:m], np.r_[0, np.cumsum(size[j[k:m]])[:-1]]
                        at = np.repeat(begin[some] - starts, size[some]) + np.arange(size[some].sum())
                        common = np.add.reduceat(mark[local[at]], starts)
                        some = some[common * 100 >= (size[i] + size[some] - common) * percent]
                        sets.join(np.full(len(some), i - a), some - a)
                        k = m
                    mark[mine] = 0
            e = np.flatnonzero(comp[sets.lead] != comp)  # edges between components that this cell has joined
            a_.append(cells.rep[a:z][e])
            b_.append(cells.rep[a:z][sets.lead[e]])
        return pa.table({"a": np.concatenate(a_), "b": np.concatenate(b_)})

    return dealt.join(items, "rep").select(*_CELL, "items").groupBy("task").applyInArrow(run, "a long, b long").groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS, cell_items: int = CELL_ITEMS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id (smallest doc_id with an equal set; null if empty)."""
    docs = id_text(df, id_col, text_col)
    sigs = saved(signatures(docs, words))
    key = ["d1", "d2", "n"]
    reps = sigs.filter("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("s0", "s1", "s2", "s3", "bands")])
    reps = saved(reps)
    small = reps.select("rep", "n", "s0", "s1", "s2", "s3")
    rows = reps.select("rep", F.explode("bands").alias("band"))
    shared = saved(rows.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least <> most"))
    # members of buckets with more than one
    members = saved(rows.join(shared.select("band", "least"), "band"))

    def side(name: str, prefix: str) -> DataFrame:
        return small.select(F.col("rep").alias(name), *[F.col(c).alias(f"{prefix}{c}") for c in ("n", "s0", "s1", "s2", "s3")])

    stars = members.filter("rep <> least").groupBy("least", "rep").agg(F.lit(1).alias("one")).select(F.col("least").alias("a"), F.col("rep").alias("b"))
    stars = saved(stars.join(side("b", "y_"), "b").join(side("a", "x_"), "a").filter(may_link("x_", "y_", percent)).select("a", "b"))
    links = saved(confirmed(stars, docs, words, percent))
    comps = saved(components(links))
    # buckets that hold more than one component
    placed = members.select("band", "rep").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = saved(placed)
    open_ = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band")
    rest = saved(placed.join(open_, "band", "left_semi").join(reps.select("rep", "n", "s0", "s1", "s2", "s3", "bands"), "rep"))
    more = saved(across(rest, docs, words, percent, cell_rows, cell_items))
    edges = comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    twice = saved(sigs.filter("n > 0").groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"))
    if not twice.isEmpty():  # an id ties the classes of its texts
        edges = edges.unionByName(sigs.join(twice, "doc_id").join(reps.select(*key, "rep"), key).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    final = saved(components(edges))
    classes = reps.select(*key, "rep").join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
    classes = saved(classes.select(*key, F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component")))
    out = sigs.select("doc_id", *key).join(classes, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"), "class_id")


def one_of_each(docs: DataFrame, found: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """docs less the rows that found (doc_id, kept) does not keep; of rows that repeat an id the least text stays.

    A bitmap of the ids concerned, of bounded size, lets all other texts pass without a shuffle; only rows
    that hit it, those concerned and a few by chance, are joined with the ids.  Rows without an id stay."""
    told = saved(found.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("rows"), F.max("kept").alias("kept")).filter("not kept or rows > 1"))
    schema = docs.schema
    held, bits = id_bitmap(told.select("doc_id"), most)
    name, known = free_name(docs, "place"), free_name(docs, "known_id")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))

    def pick(hit: bool):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                found = in_bitmap(held.value, b[name]) & np.asarray(b["doc_id"].is_valid())
                yield b.drop_columns([name]).filter(pa.array(found == hit))

        return run

    placed = docs.withColumn(name, place)
    maybe = map_arrow(placed, pick(True), schema)
    gone = told.filter("not kept").select(F.col("doc_id").alias(known))
    left = maybe.join(gone, F.col("doc_id").cast("long") == F.col(known), "left_anti")
    twice = told.filter("kept").select(F.col("doc_id").alias(known))
    if not twice.isEmpty():
        rank = free_name(docs, "rank_")
        match = F.col("doc_id").cast("long") == F.col(known)
        among = left.join(twice, match).withColumn(rank, F.row_number().over(Window.partitionBy(known).orderBy("text")))
        left = left.join(twice, match, "left_anti").unionByName(among.filter(F.col(rank) == 1).select(*docs.columns))
    return map_arrow(placed, pick(False), schema).unionByName(left)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
