"""Operator 8: exact n-gram Jaccard join in metric regions, and its connected components.

The method is a metric-space join: pivots make regions, the triangle inequality bounds who
must be replicated across a border, regions join recursively. With whole documents as first
pivots it cannot work on text: nearly every two documents share no 5-word shingle, all lie at
distance 1 from all pivots, and a window of twice the threshold copies every document to
every region (README has figures). So the first pivots are single shingles. The distance of
a document to {s} is least for its own shingles; ties go to the rarest, and a document is
replicated to each region where a partner within the threshold can share its nearest common
pivot: its n - ceil(0.75 n) + 1 rarest shingles. Inside a region the pivots are documents:

1. every member is compared with the pivot; links join components, never all pairs;
2. a large region with several components left is cut into bands of distance to its pivot, as
   wide as the threshold, and of size; a member also goes to the next band, as two documents
   within the threshold are in one band or two neighbouring ones, and each band takes a pivot of
   its own, from what is not in its commonest component;
3. small regions and bands compare what is in different components.

Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkeda.llm import kernels as K
from sparkeda.llm.graph import components
from sparkeda.llm.shared import NO_ID, discard, keyed_texts, real_id, stored

#: Counters of the sketch of shingle frequencies; it only orders shingles, so errors cost time, not results.
SKETCH_BITS = 20
#: Bits of the filter that keeps sets of documents without a partner out of the shuffle; it has no false negatives.
FILTER_BITS = 26
PIECES = 16
#: Sets up to which a region compares all that can link, and members up to which it compares those in different components.
TINY, SMALL = 8, 4096
DEPTH = 3


def sets_of(w: K.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all documents one after another, first of each and the end)."""
    n_docs, counts = len(w.first) - 1, w.counts
    at, h = K.windows(w, k)
    rows = w.rows()[at]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        order = np.argsort(np.concatenate([rows, short]), kind="stable")
        h = np.concatenate([h, K.span_hashes(w.hash, w.first[short], w.first[short + 1])])[order]
        rows = np.concatenate([rows, short])[order]
    bounds = np.searchsorted(rows, np.arange(n_docs + 1)).tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[new], np.searchsorted(rows[new], np.arange(n_docs + 1))


def parity_bits(values: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A bitmap of each set, of a power of two of bits, its size or more: the parity of the hashes that fall on each bit.

    Bits in which two such maps differ are at most the elements in which the sets differ.
    """
    n = np.diff(first)
    bits = np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(bits)])
    row = np.repeat(np.arange(len(n)), n)
    place = (values >> np.uint64(24)).astype(np.int64) & (bits[row] - 1)
    raw = np.packbits((np.bincount(at[row] + place, minlength=at[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[a // 8 : b // 8] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def folded_difference(a: bytes, b: bytes) -> int:
    """Bits in which two parity maps differ, the longer one folded onto the shorter."""
    one, two = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(one) < len(two):
        one, two = two, one
    while len(one) > len(two):
        one = one[: len(one) // 2] ^ one[len(one) // 2 :]
    return int(np.bitwise_count(one ^ two).sum())


def digests(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return K.as_long(K.span_hashes(values, first[:-1], first[1:], 5))


def _blocks(batches: Iterator[pa.RecordBatch], k: int, n_carried: int = 0) -> Iterator[tuple]:
    """(doc_ids, *carried columns, shingle hashes of all documents, first of each and the end)."""
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for part, data, offsets in K.text_blocks(batch.column(1)):
            carried = [batch.column(2 + i).slice(part.start, part.stop - part.start) for i in range(n_carried)]
            yield keys[part], *carried, *sets_of(K.words(data, offsets, True), k)


def _pieces(table: np.ndarray) -> pa.RecordBatch:
    """A fixed-size table as rows (piece, bytes), all-zero pieces left out."""
    parts = table.reshape(PIECES, -1)
    use = np.flatnonzero(parts.any(1))
    return pa.RecordBatch.from_arrays([pa.array(use.astype(np.int32)), pa.array([parts[i].tobytes() for i in use], pa.binary())], names=["piece", "bytes"])


def merged(rows: DataFrame, dtype: str, how: str) -> dict[int, np.ndarray]:
    """Merge fixed-size tables, streaming, a piece in a task; what reaches the driver is one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, dtype)
                x = x.astype(np.uint64) if how == "sum" else x
                held[piece] = x if piece not in held else held[piece] + x if how == "sum" else held[piece] | x
        if how == "sum":  # only the order of magnitude is used
            held = {p: np.ceil(np.log2(x + np.uint64(1))).astype(np.uint8) for p, x in held.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["piece", "bytes"])

    found = rows.select("piece", "bytes").repartition(PIECES, "piece").mapInArrow(run, "piece int, bytes binary").collect()
    return {r["piece"]: np.frombuffer(r["bytes"], np.uint8) for r in found}


def whole(pieces: dict[int, np.ndarray], size: int) -> np.ndarray:
    out = np.zeros((PIECES, size // PIECES), np.uint8)
    for piece, x in pieces.items():
        out[piece] = x
    return out.reshape(-1)


def profiles(rows: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, dg, bits, carried columns) of every document, dg naming its set, and the order of magnitude of each shingle counter."""
    carried = rows.schema.fields[2:]
    names = ["doc_id", "n", "dg", "piece", "bytes", *(f.name for f in carried)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        kinds = None
        for keys, *more, values, first in _blocks(batches, k, len(carried)):
            sketch += np.bincount((values & np.uint64(len(sketch) - 1)).astype(np.int64), minlength=len(sketch))
            kinds = [c.type for c in more]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.diff(first), pa.int32()), pa.array(digests(values, first)), pa.nulls(len(keys), pa.int32()), pa.array(parity_bits(values, first), pa.binary()), *more], names=names)
        if kinds is not None:
            got = _pieces(np.minimum(sketch, 65535).astype("<u2"))
            m = len(got)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), got.column(0), got.column(1), *(pa.nulls(m, t) for t in kinds)], names=names)

    schema = "doc_id long, n int, dg long, piece int, bytes binary" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in carried)
    both = stored(rows.mapInArrow(run, schema), "jaccard-profiles")
    ranks = whole(merged(both.where("piece is not null"), "<u2", "sum"), 1 << SKETCH_BITS)
    return both.where("piece is null").select("doc_id", "n", "dg", F.col("bytes").alias("bits"), *(f.name for f in carried)), ranks


def memberships(rows: DataFrame, ranks, k: int, percent: int) -> DataFrame:
    """(c, x, n, i): set x of n shingles has shingle c at place i of its order; regions of one set are still there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        for _, values, first in _blocks(batches, k):
            dg, n = digests(values, first), np.diff(first)
            use = np.zeros(len(n), bool)
            use[np.unique(dg, return_index=True)[1]] = True
            use &= n > 0
            row = np.repeat(np.arange(len(n)), n)
            mine = use[row]
            h, row = values[mine], row[mine]
            start = np.concatenate([[0], np.cumsum(np.where(use, n, 0))])
            # by rank, then by hash: a stable sort of sorted hashes
            key = (rank[(h & np.uint64(len(rank) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (h >> np.uint64(6))
            bounds = start.tolist()
            order = np.concatenate([np.argsort(key[a:b], kind="stable") + a for a, b in zip(bounds[:-1], bounds[1:], strict=True)] or [np.zeros(0, np.int64)])
            h = h[order]
            place = np.arange(len(h)) - start[row]
            keep = place < (n - (percent * n + 99) // 100 + 1)[row]
            h, row, place = h[keep], row[keep], place[keep]
            yield pa.RecordBatch.from_arrays([pa.array(K.as_long(h)), pa.array(dg[row]), pa.array(n[row], pa.int32()), pa.array(place, pa.int32())], names=["c", "x", "n", "i"])

    return rows.mapInArrow(run, "c long, x long, n int, i int")


PAIR, MEMBER = 0, 1


def reach(n, i, m, j, percent: int):
    """Whether sets of n and m shingles can link if the shingle at places i and j is the first they share.

    What they share is then among the rest of both, and a link needs percent / (100 + percent) of n + m.
    A pair that links does so at its first common shingle, so it is enough to test pairs in regions that pass.
    """
    return ((100 + percent) * np.minimum(n - i, m - j) >= percent * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs, the smaller one first."""
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)


def with_pivots(regions: DataFrame, percent: int) -> DataFrame:
    """Regions (c, x, n, i) of two or more sets: kind PAIR (p, x) of those up to TINY sets, else MEMBER (c, p, pn, pi, x, n, i).

    The pivot p is the first set by (o, i, x); it has no row of its own. The set with the fewest rarer
    shingles is the one nearest to what the others have in common: of edited copies, the original.
    Streams through regions of any size.
    """
    names = ["kind", "c", "p", "pn", "pi", "x", "n", "i"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = open_run = last = None  # rows of an unfinished tiny run; (c, p, pn, pi) of an unfinished larger one; its last x

        def members(cols, p) -> pa.RecordBatch:
            c, x, n, i = cols
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(c), MEMBER, np.int8)), pa.array(c), pa.array(p[0]), pa.array(p[1]), pa.array(p[2]), pa.array(x), pa.array(n), pa.array(i)], names=names)

        def tiny(cols, start, size) -> Iterator[pa.RecordBatch]:
            _, x, n, i = cols
            n, i, found = n.astype(np.int64), i.astype(np.int64), []
            for m in range(2, TINY + 1):
                first = start[size == m]
                if len(first):
                    for a in range(m):
                        for b in range(a + 1, m):
                            u, v = first + a, first + b
                            ok = reach(n[u], i[u], n[v], i[v], percent)
                            if ok.any():
                                found.append(_pairs(x[u[ok]], x[v[ok]]))
            if found:
                two = np.unique(np.concatenate(found), axis=0)
                m = len(two)
                none, nil = pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, PAIR, np.int8)), nil, pa.array(two[:, 0].copy()), none, none, pa.array(two[:, 1].copy()), none, none], names=names)

        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(4)]
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            c, x = cols[:2]
            if not len(c):
                continue
            fresh = np.ones(len(c), bool)
            fresh[1:] = (c[1:] != c[:-1]) | (x[1:] != x[:-1])
            fresh[0] = open_run is None or (open_run[0], last) != (c[0], x[0])
            cols = [v[fresh] for v in cols]
            c, x, n, i = cols
            if not len(c):
                continue
            start = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            size = np.diff(np.append(start, len(c)))
            goes_on = open_run is not None and open_run[0] == c[0]
            large = size > TINY
            large[0] |= goes_on
            tail_open = not large[-1]
            done = np.flatnonzero(~large[: len(size) - tail_open])
            yield from tiny(cols, start[done], size[done])
            if large.any():
                head = [v[start].copy() for v in (x, n, i)]
                if goes_on:
                    for v, was in zip(head, open_run[1:], strict=True):
                        v[0] = was
                rows = np.repeat(large, size)
                pivots = [np.repeat(v, size) for v in head]
                rows[start[1:] if goes_on else start] = False
                yield members([v[rows] for v in cols], [v[rows] for v in pivots])
                open_run = (c[-1], *(v[-1] for v in head)) if large[-1] else None
            else:
                open_run = None
            last = x[-1]
            held = [v[start[-1] :] for v in cols] if tail_open else None
        if held is not None:
            yield from tiny(held, np.zeros(1, np.int64), np.array([len(held[0])]))

    ordered = regions if "o" in regions.columns else regions.withColumn("o", F.lit(0))
    return ordered.select("c", "x", "n", "i", "o").repartition("c").sortWithinPartitions("c", "o", "i", "x").select("c", "x", "n", "i").mapInArrow(run, "kind byte, c long, p long, pn int, pi int, x long, n int, i int")


def wanted_sets(spark: SparkSession, rows: DataFrame, reps: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(dg, body): the sets that pairs name, each from the smallest doc_id that has it."""
    reps = reps.select("rep", "dg")
    ids = pairs.select(F.col("x").alias("dg")).unionByName(pairs.select(F.col("p").alias("dg"))).distinct().join(reps, "dg").select("rep")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[K.mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(len(bits) - 1)] = True
        yield _pieces(np.packbits(bits))

    held = spark.sparkContext.broadcast(whole(merged(ids.mapInArrow(mark, "piece int, bytes binary"), "u1", "or"), 1 << (FILTER_BITS - 3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask = held.value, np.uint64((1 << FILTER_BITS) - 1)

        def marked() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = (K.mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) & mask).astype(np.int64)
                yield batch.filter(pa.array(((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)))

        for keys, values, first in _blocks(marked(), k):
            use = np.flatnonzero(np.diff(first) > 0)
            body = [values[first[i] : first[i + 1]].tobytes() for i in use]
            yield pa.RecordBatch.from_arrays([pa.array(keys[use]), pa.array(digests(values, first)[use]), pa.array(body, pa.binary())], names=["rep", "dg", "body"])

    found = rows.mapInArrow(run, "rep long, dg long, body binary")
    return stored(found.join(reps, ["rep", "dg"], "left_semi").select("dg", "body").dropDuplicates(["dg"]), "jaccard-sets")


def possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose parity maps allow the threshold; none that reaches it is lost."""
    a, b = (reps.select(F.col("dg").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"b_{name}")) for name in ("x", "p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, x, n_p, n_x, left, right = (batch.column(i) for i in range(6))
            total = (n_p.to_numpy() + n_x.to_numpy()).astype(np.int64)
            differ = np.fromiter((folded_difference(left[i].as_py(), right[i].as_py()) for i in range(len(p))), np.int64, len(p))
            # sets that differ in s elements have (total - s) / 2 in common and (total + s) / 2 in all
            keep = pa.array(100 * (total - differ) >= percent * (total + differ))
            yield pa.RecordBatch.from_arrays([p.filter(keep), x.filter(keep)], names=["p", "x"])

    joined = pairs.join(a, "x").join(b, "p").where(f"100 * least(n_x, n_p) >= {percent} * greatest(n_x, n_p)")
    return joined.select("p", "x", "n_p", "n_x", "b_x", "b_p").mapInArrow(run, "p long, x long")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(p, x, inter, total): sizes of intersection and union of two sets, exactly."""
    a, b = (sets.select(F.col("dg").alias(name), F.col("body").alias(f"s_{name}")) for name in ("x", "p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, x, left, right = (batch.column(i) for i in range(4))
            inter, total = np.zeros(len(p), np.int32), np.zeros(len(p), np.int32)
            for i in range(len(p)):
                one, two = (np.frombuffer(s[i].as_buffer(), np.uint64) for s in (left, right))
                if len(one) > len(two):
                    one, two = two, one
                inter[i] = np.count_nonzero(two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one)
                total[i] = len(one) + len(two) - inter[i]
            yield pa.RecordBatch.from_arrays([p, x, pa.array(inter), pa.array(total)], names=["p", "x", "inter", "total"])

    joined = pairs.join(a, "x").join(b, "p").select("p", "x", "s_x", "s_p")
    return joined.mapInArrow(run, "p long, x long, inter int, total int")


def size_bands(percent: int, most: int = 2**40) -> list[int]:
    """Ascending sizes so that two sets within the threshold lie in one band or two neighbouring ones."""
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
    return edges


def banded(rows: DataFrame, distance: DataFrame, percent: int) -> DataFrame:
    """Cut regions (c, p, x, n, i, label) with several labels into bands of distance (p, x, d) to the pivot and of size.

    Where no distance is known it is above the threshold: such a member goes to all bands it can be in. In the
    result o is 0 for members whose label is not the commonest one, so that a pivot comes from them.
    """
    several = rows.groupBy("c").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("c")
    left = rows.join(several, "c", "left_semi").join(distance, ["p", "x"], "left")
    step = (100 - percent) / 100
    far = F.floor(F.col("d") / step + 1e-9).cast("int")
    fars = F.when(F.col("d").isNull(), F.sequence(F.lit(1), F.lit(math.ceil(1 / step)))).otherwise(F.sequence(far, far + 1))
    edges = F.array(*[F.lit(e) for e in size_bands(percent)])
    size = F.size(F.filter(edges, lambda e: e <= F.col("n")))
    cut = left.withColumn("far", F.explode(fars)).withColumn("size", F.explode(F.sequence(size, size + 1)))
    cut = cut.select(F.xxhash64("c", "far", "size").alias("c"), "x", "n", "i", "label")
    labels = cut.groupBy("c", "label").agg(F.count("*").alias("m"))
    common = labels.groupBy("c").agg(F.max_by("label", F.struct("m", "label")).alias("common"), F.count("*").alias("k")).where("k > 1").select("c", "common")
    return cut.join(common, "c").select("c", "x", "n", "i", (F.col("label") == F.col("common")).cast("int").alias("o"))


def resolved(rows: DataFrame, percent: int, last: bool) -> DataFrame:
    """What is left to do in regions (c, p, x, n, i, label): kind PAIR (p, x) or MEMBER (all columns).

    A region of one label is done. One of up to SMALL members gives its pairs in different components
    that can link; a larger one its members (with `last`, its pairs too, by blocks).
    """
    names = ["kind", "c", "p", "x", "n", "i", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large, pairs = None, None, []

        def members(cols, keep) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), MEMBER, np.int8)), *(pa.array(v[keep]) for v in cols)], names=names)

        def flush() -> pa.RecordBatch:
            two = np.unique(np.concatenate(pairs), axis=0)
            pairs.clear()
            m = len(two)
            nil, none = pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(np.full(m, PAIR, np.int8)), nil, pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), none, none, nil], names=names)

        def runs(cols, bounds) -> Iterator[pa.RecordBatch]:
            """Pairs of whole regions."""
            _, _, x, n, i, label = cols
            n, i = n.astype(np.int64), i.astype(np.int64)
            lo, hi = np.minimum.reduceat(label, bounds[:-1]), np.maximum.reduceat(label, bounds[:-1])
            for k in np.flatnonzero(lo != hi).tolist():
                a, b = bounds[k], bounds[k + 1]
                for u in range(a, b, 1024):
                    s = slice(u, min(u + 1024, b))
                    for v in range(u, b, 1024):
                        t = slice(v, min(v + 1024, b))
                        one, two = np.nonzero((label[s, None] != label[None, t]) & reach(n[s, None], i[s, None], n[None, t], i[None, t], percent))
                        if len(one):
                            pairs.append(_pairs(x[one + u], x[two + v]))
                if sum(map(len, pairs)) > 500_000:
                    yield flush()

        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(6)]
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            c = cols[0]
            if not len(c):
                continue
            bounds = np.append(np.flatnonzero(np.append(True, c[1:] != c[:-1])), len(c))
            size = np.diff(bounds)
            big = np.zeros(len(size), bool) if last else size > SMALL
            if large is not None and c[0] == large:
                big[0] = True
            out = np.repeat(big, size)
            if out.any():
                yield members(cols, out)
            large = c[-1] if big[-1] else None
            held = None if big[-1] else [v[bounds[-2] :] for v in cols]
            if (~big[:-1]).any():
                keep = np.append(~out[: bounds[-2]], np.zeros(len(c) - bounds[-2], bool))
                yield from runs([v[keep] for v in cols], np.append(0, np.cumsum(size[:-1][~big[:-1]])))
        if held is not None:
            yield from runs(held, np.array([0, len(held[0])]))
        if pairs:
            yield flush()

    return rows.select("c", "p", "x", "n", "i", "label").repartition("c").sortWithinPartitions("c").mapInArrow(run, "kind byte, c long, p long, x long, n int, i int, label long")


def linked(found: DataFrame, percent: int) -> DataFrame:
    return found.where(F.col("inter") * 100 >= F.col("total") * percent).select(F.col("p").alias("a"), F.col("x").alias("b"))


def cluster(docs: DataFrame, k: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Components of the exact join: documents link when 100 * intersection >= percent * union of their sets.

    A document's set: distinct k-word shingles of its words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased);
    with fewer words the whole sequence as one; without words empty and linked with nothing (null
    text too). Returns doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own
    included). Equal sets are one class from the start, so copies cost no pairs. A null doc_id
    counts as the smallest and comes back as null; each input row has its row, also where rows repeat
    a doc_id (their texts are then documents of their own, which share its number). An empty table gives
    an empty one. With `carry`, these columns and group_id follow: one number for each component.
    """
    spark = docs.sparkSession
    keyed = keyed_texts(docs, doc_id, text, carry)
    rows = keyed.select("doc_id", "text")
    docs_of, ranks = profiles(keyed, k)
    reps = stored(docs_of.where("n > 0").groupBy("dg").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")), "jaccard-reps")
    work = stored(with_pivots(memberships(rows, spark.sparkContext.broadcast(ranks), k, percent), percent), "jaccard-work")

    def exact(pairs: DataFrame) -> DataFrame:
        left = stored(possible(pairs.distinct(), reps, percent), "jaccard-pairs")
        sets = wanted_sets(spark, rows, reps, left, k)
        out = stored(compared(left, sets), "jaccard-compared")
        discard(left, sets)
        return out

    links, pairs, labels = None, None, None
    for depth in range(DEPTH):
        members = work.where(F.col("kind") == MEMBER)
        near = members.where(f"{100 + percent} * least(n - i, pn - pi) >= {percent} * (n + pn) AND 100 * least(n, pn) >= {percent} * greatest(n, pn)")
        star = exact(near.select("p", "x").unionByName(work.where(F.col("kind") == PAIR).select("p", "x")))
        links = linked(star, percent) if links is None else links.unionByName(linked(star, percent))
        discard(labels)
        labels = components(links)
        own = members.join(labels.withColumnRenamed("node", "x"), "x", "left").select("c", "p", "x", "n", "i", F.coalesce("label", "x").alias("label"))
        # regions that the pivot has made one component need no task that sees them whole
        several = stored(own.groupBy("c").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("c"), "jaccard-several")
        left = stored(resolved(own.join(several, "c", "left_semi"), percent, depth == DEPTH - 1), "jaccard-left")
        discard(several, work)
        found = left.where(F.col("kind") == PAIR).select("p", "x")
        pairs = found if pairs is None else pairs.unionByName(found)
        large = left.where(F.col("kind") == MEMBER)
        if large.isEmpty():
            break
        distance = star.select("p", "x", ((F.col("total") - F.col("inter")) / F.col("total")).alias("d"))
        work = stored(with_pivots(banded(large, distance, percent), percent), "jaccard-work")
    # components found since then leave fewer pairs
    for side in ("p", "x"):
        pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")), side, "left")
    pairs = pairs.where(~F.coalesce("label_p", "p").eqNullSafe(F.coalesce("label_x", "x"))).select("p", "x")
    links = links.unionByName(linked(exact(pairs), percent))
    labels = components(links)
    least = labels.join(reps, labels["node"] == reps["dg"]).groupBy("label").agg(F.min("rep").alias("component_id"))
    found = labels.join(least, "label").select(F.col("node").alias("dg"), "component_id", "label")
    named = reps.join(found, "dg", "left").select("dg", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("label", "dg").alias("group_id"))
    out = docs_of.drop("bits").join(named, "dg", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select(real_id(), F.col("n").cast("long").alias("n_shingles"), real_id("component_id"), *(["group_id", *carry] if carry else []))
