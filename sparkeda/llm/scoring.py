"""Operator 10: scoring texts with a log-bilinear model trained by noise-contrastive estimation (NCE) in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeda.llm import kernels as K
from sparkeda.llm import lbl
from sparkeda.llm.shared import NO_ID, discard, keyed_texts, real_id, stored

#: Most frequent tokens that are classes of their own, and classes of the other words by their ending.
HEAD, TAILS = 319, 192
END_CLASS = HEAD + TAILS
CLASSES = HEAD + TAILS + 1
#: Bound on the most frequent words whose counts every worker holds (16 bytes each); the others meet theirs in a join.
FREQUENT = 100_000
#: Most frequent words that have a context vector of their own; the others share one by ending.
INPUTS = 8191
#: Tokens of a unit of training: what one model copy goes through before copies are averaged.
UNIT = 2_000_000
#: Pieces in which sums of models are added up.
PIECES = 128
END = np.uint64(0x9AE16A3B2F90404F)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def endings(w: K.Words) -> np.ndarray:
    """Class of each word by its last three bytes."""
    key = np.zeros(len(w.end), np.uint64)
    for k in range(1, 4):
        at = w.end - k
        key = key * np.uint64(256) + np.where(at >= w.start, w.data[np.maximum(at, 0)], 0).astype(np.uint64)
    return (K.mix(key, 3) % np.uint64(TAILS)).astype(np.int16)


class Lookup:
    """Exact lookup of 64-bit keys in a sorted array."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Index of each key in the array given, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(x), -1)
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        return np.where(self.keys[at] == x, self.order[at], -1)


@dataclass
class Words:
    """The most frequent words (hash, count, ending) by falling count; the first HEAD are classes, the first INPUTS inputs of their own."""

    hash: np.ndarray
    n: np.ndarray
    ending: np.ndarray

    @property
    def n_inputs(self) -> int:
        return min(INPUTS, len(self.hash))

    @property
    def stop(self) -> int:
        """The input of the end of a text."""
        return self.n_inputs + TAILS

    def class_of(self) -> np.ndarray:
        """Class of each input: words of their own, endings, the end."""
        k = np.arange(self.n_inputs)
        return np.concatenate([np.where(k < HEAD, k, HEAD + self.ending[: self.n_inputs]), HEAD + np.arange(TAILS), [END_CLASS]]).astype(np.int64)


def sequences(w: K.Words, look: Lookup, n_inputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(input and class of each token with an end after each document, place among the words of look or -1, the end's places)."""
    ends = w.first[1:] + np.arange(len(w.first) - 1)
    tail = endings(w).astype(np.int64)
    found = look(w.hash)
    ids = np.insert(np.where((found >= 0) & (found < n_inputs), found, n_inputs + tail), w.first[1:], n_inputs + TAILS)
    cls = np.insert(np.where((found >= 0) & (found < HEAD), found, HEAD + tail), w.first[1:], END_CLASS)
    return ids.astype(np.int16), cls, np.insert(found, w.first[1:], -1), ends


def learns(keys: np.ndarray, folds: int, fold: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"None" if k == NO_ID else b"%d" % k) % folds != fold for k in keys.tolist()), bool, len(keys))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, K.Words]]:
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for part, data, offsets in K.text_blocks(batch.column(1)):
            yield keys[part], K.words(data, offsets, True)


def training_units(rows: DataFrame, top: Words, train_tokens: int, folds: int, fold: int) -> DataFrame:
    """(ids): the inputs of all training texts as 16-bit numbers, in units of about UNIT tokens.

    Texts are dealt by a hash of their own, in an order of their own, so units do not depend on how the input
    is cut; a hot row fills several units.
    """
    held = rows.sparkSession.sparkContext.broadcast((top.hash, top.n_inputs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, n_inputs = Lookup(held.value[0]), held.value[1]
        for keys, w in blocks(batches):
            ids, _, _, ends = sequences(w, look, n_inputs)
            use = np.flatnonzero(learns(keys, folds, fold))
            first = np.append(0, ends[:-1] + 1) if len(ends) else ends
            yield pa.RecordBatch.from_arrays([pa.array(keys[use]), pa.array([ids[first[i] : ends[i] + 1].tobytes() for i in use], pa.binary())], names=["doc_id", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in batch.column(1).to_pylist():
                held.append(x)
                size += len(x) // 2
                if size >= UNIT:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["ids"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["ids"])

    dealt = rows.mapInArrow(run, "doc_id long, ids binary").repartition(max(1, -(-train_tokens // UNIT)), F.xxhash64("doc_id", "ids")).sortWithinPartitions("doc_id", "ids")
    return stored(dealt.mapInArrow(pack, "ids binary"), "lm-units")


def trained(units: DataFrame, model: lbl.Model, class_of: np.ndarray, stop: int, seed: int) -> lbl.Model:
    """The mean of copies of the model that each go through some units; sums of copies are added a piece in a task."""
    held = units.sparkSession.sparkContext.broadcast((model, class_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, class_of = held.value
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                got = lbl.weighed(*lbl.train_unit(model, np.frombuffer(raw, np.int16), class_of, stop, seed))
                total = got if total is None else total + got
        if total is not None:
            parts = np.array_split(total, PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["piece", "bytes"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, np.float64)
                sums[piece] = sums[piece] + x if piece in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["piece", "bytes"])

    schema = "piece int, bytes binary"
    got = {r["piece"]: np.frombuffer(r["bytes"], np.float64) for r in units.mapInArrow(run, schema).repartition(PIECES, "piece").mapInArrow(add, schema).collect()}
    return lbl.averaged(model, np.concatenate([got[k] for k in range(PIECES)])) if got else model


@dataclass
class Fitted:
    """All that scoring needs but the counts of rare words, which are the table `counts` (h, n)."""

    top: Words
    model: lbl.Model
    log_mass: np.ndarray  # log10 of a class of endings' tokens and words and one
    log_end: float
    log_all: float
    end_count: int
    train_tokens: int
    counts: DataFrame


def fit(rows: DataFrame, folds: int = 7, fold: int = 2) -> Fitted:
    """Counts and model from the rows (doc_id, text) whose crc32(doc_id as text) modulo `folds` is not `fold`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate([x[0] for x in held])
            h, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            n = np.bincount(inverse, np.concatenate([x[2] for x in held])).astype(np.int64)
            k = np.concatenate([x[1] for x in held])[at]
            return pa.RecordBatch.from_arrays([pa.array(K.as_long(h)), pa.array(k, pa.int32()), pa.array(n)], names=["h", "k", "n"])

        for keys, w in blocks(batches):
            use = learns(keys, folds, fold)
            mine = np.repeat(use, w.counts)
            h, at, n = np.unique(w.hash[mine], return_index=True, return_counts=True)
            held.append((np.append(h, END), np.append(endings(w)[mine][at], TAILS).astype(np.int32), np.append(n, use.sum())))
            size += len(h)
            if size > 500_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counts = stored(rows.mapInArrow(count, "h long, k int, n long").groupBy("h", "k").agg(F.sum("n").alias("n")).where("n > 0"), "lm-counts")
    # the counts from which on at most FREQUENT words have one: by 16 bins an octave, so that the driver gets no more than it keeps
    octave = F.floor(F.log2("n") * 16).cast("int")
    words = counts.where(F.col("k") < TAILS).withColumn("bin", octave)
    least, total = 1 << 30, 0
    for r in sorted(words.groupBy("bin").agg(F.count("*").alias("m")).collect(), reverse=True):
        total += r["m"]
        if total > FREQUENT:
            break
        least = r["bin"]
    top = words.where(F.col("bin") >= least).select("h", "n", "k").toPandas().sort_values(["n", "h"], ascending=[False, True])
    top = Words(top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), top["k"].to_numpy(np.int64))
    by_class = {r["k"]: (r["n"], r["v"]) for r in counts.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    train_tokens, distinct = sum(n for n, _ in by_class.values()), sum(v for _, v in by_class.values())
    end_count = by_class.get(TAILS, (0, 0))[0]
    mass = np.array([by_class.get(k, (0, 0)) for k in range(TAILS)], np.int64).reshape(TAILS, 2)
    np.subtract.at(mass, top.ending[:HEAD], np.stack([top.n[:HEAD], np.ones(len(top.n[:HEAD]), np.int64)], 1))
    log_mass = np.log10(mass.sum(1) + 1.0)
    class_counts = np.concatenate([np.pad(top.n[:HEAD], (0, HEAD - len(top.n[:HEAD]))), mass[:, 0], [end_count]])
    units = training_units(rows, top, train_tokens, folds, fold)
    class_of = top.class_of()
    start = lbl.initial(len(class_of), class_counts)
    # one unit first, so that the copies start from the same side; then every unit
    model = trained(units.orderBy(F.crc32("ids"), "ids").limit(1), start, class_of, top.stop, 0)
    model = trained(units, model, class_of, top.stop, 1)
    discard(units)
    return Fitted(top, model, log_mass, float(np.log10(end_count + 1.0)), float(np.log10(train_tokens + distinct + 1.0)), end_count, train_tokens, counts)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """Score all whole texts; learn from those whose crc32(doc_id as text) modulo `folds` is not `fold`.

    Tokens: words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end. base_score: sum over tokens of
    log10((c + 1) / (N + V + 1)) with training counts. score: sum of log10 of P(class | the three tokens
    before) by the log-bilinear model and of P(word | class): 1 for the HEAD most frequent words, which are
    classes of their own, else (c + 1) / (N of the class + V of the class + 1). So it is a normalised
    distribution in which each ending class keeps one place for words never seen.

    Counts are over every training token, and the model goes through every training token, in units
    of UNIT tokens whose model copies are averaged. The driver gets the FREQUENT most frequent words,
    sums by class and one model. Other words reach their counts by a join on their hash. Returns
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null text is empty (the end
    alone); a null doc_id counts as the text 'None'. Rows that repeat a doc_id give one row with the
    sums of all of them; ties in frequency are ordered by hash. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = keyed_texts(docs, doc_id, text)
    known = fit(rows, folds, fold)
    top, counts, end_count, train_tokens = known.top, known.counts, known.end_count, known.train_tokens
    log_mass, log_end, log_all = known.log_mass, known.log_end, known.log_all
    held = spark.sparkContext.broadcast((top, known.model))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, model = held.value
        look, class_of, log_top = Lookup(top.hash), top.class_of(), np.log10(top.n + 1.0)
        for keys, w in blocks(batches):
            ids, cls, at, ends = sequences(w, look, top.n_inputs)
            docs_n = len(keys)
            row = np.repeat(np.arange(docs_n), w.counts + 1)
            is_end = np.zeros(len(cls), bool)
            is_end[ends] = True
            lone = at >= 0
            log_c = np.where(lone, log_top[np.maximum(at, 0)] if len(log_top) else 0.0, 0.0)
            log_c[is_end] = log_end
            base = np.bincount(row, log_c, docs_n) - (w.counts + 1) * log_all
            tail = (cls >= HEAD) & ~is_end
            inside = np.where(tail, log_c - log_mass[np.where(tail, cls - HEAD, 0)], 0.0)
            model_score = np.bincount(row, lbl.log10_probabilities(model, ids, class_of, top.stop) + inside, docs_n)
            known = np.bincount(row, lone, docs_n).astype(np.int64) + int(end_count > 0)
            rest = ~lone & ~is_end
            words_at = np.insert(w.hash, w.first[1:], END)[rest]
            pair = np.lexsort((words_at, row[rest]))
            r, h = row[rest][pair], words_at[pair]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
            start = np.flatnonzero(new)
            times = np.diff(np.append(start, len(r)))
            zero, m = np.zeros(len(start)), len(start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([keys, keys[r[new]]])), pa.array(np.concatenate([np.zeros(docs_n, np.int8), np.ones(m, np.int8)])), pa.array(K.as_long(np.concatenate([K.mix(keys.astype(np.int64).view(np.uint64)), h[new]]))), pa.array(np.concatenate([w.counts + 1, times]), pa.int64()), pa.array(np.concatenate([known, zero.astype(np.int64)])), pa.array(np.concatenate([base, zero])), pa.array(np.concatenate([model_score, zero]))],
                names=["doc_id", "kind", "h", "n", "known", "base", "model"],
            )

    parts = rows.mapInArrow(apply, "doc_id long, kind byte, h long, n long, known long, base double, model double")
    rare = counts.select("h", F.col("n").alias("c"), F.lit(1).cast("byte").alias("kind"))
    joined = parts.join(rare, ["h", "kind"], "left")
    gain = F.when(F.col("c").isNotNull(), F.col("n") * F.log10(F.col("c") + 1.0)).otherwise(0.0)
    out = joined.groupBy("doc_id").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("n_tokens"), F.sum(F.col("known") + F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + gain).alias("base_score"), F.sum(F.col("model") + gain).alias("score"),
    )
    key = F.when(F.col("doc_id") == NO_ID, F.lit("None")).otherwise(F.col("doc_id").cast("string"))
    return out.select(
        real_id(), (F.crc32(key.cast("binary")) % folds == fold).alias("held_out"), "n_tokens", "n_known",
        F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
