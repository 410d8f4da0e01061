"""Operator 3: exact substring deduplication by level-wise doubling.

Lengths double from a quarter of the wanted one (4, 8, 13 words for 13). At each length below
the wanted one a full window is stood for by its anchor: of its windows of that length the one with
the smallest hash. Equal full windows have equal anchors, so none is lost, and only a part of all
words carry one. Anchors that two documents share survive; of the full windows only those whose
anchor did are looked at in the next, doubled length, and a document without any is not read again.
The last level hashes what is left of the full windows with two hashes (96 bits), and those seen
in an earlier document cover the words to remove. No pair of documents is ever made: each level
keeps the smallest doc_id of a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeda.llm import kernels as K
from sparkeda.llm.shared import keyed_texts, real_id



#: Bits of an anchor's hash. Anchors that meet by chance cost time, not results.
ANCHOR_BITS = 48


def lengths(size: int) -> list[int]:
    """Lengths of the levels: a quarter of the wanted one, doubled until it is reached."""
    out, n = [], -(-size // 4)
    while n < size:
        out.append(n)
        n *= 2
    return [*out, size]


def _anchors(w: K.Words, length: int, full: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each full window, hash of its anchor, document of the window)."""
    at, h = K.windows(w, length)
    rows = w.rows()
    by_word = np.zeros(len(w.hash), np.uint64)
    by_word[at] = h >> np.uint64(64 - ANCHOR_BITS)
    first = np.flatnonzero(np.arange(len(w.hash)) + full <= w.first[1:][rows]) if len(rows) else at
    least = by_word[first]
    for k in range(1, full - length + 1):
        least = np.minimum(least, by_word[first + k])
    return first, least, rows[first]


def _pairs(rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash); equal anchors of neighbouring windows go first."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    rows, h = rows[new], h[new]
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], h[new]


def _among(h: np.ndarray, row: np.ndarray, wanted: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which (document, hash) are among the wanted hashes of that document."""
    return np.isin(K.mix(h) ^ K.mix(row.astype(np.uint64), 1), K.mix(wanted) ^ K.mix(of.astype(np.uint64), 1))


def _lists(column: pa.ListArray, part: slice) -> tuple[np.ndarray, np.ndarray]:
    """(values as hashes, document of each) of a column of lists; null is empty."""
    held = column.slice(part.start, part.stop - part.start)
    sizes = [x or 0 for x in pa.compute.list_value_length(held).to_pylist()]
    return held.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(held)), sizes)


def deduplicate(docs: DataFrame, size: int = 13, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """Remove every word covered by a window of `size` words that also starts in a document with a smaller doc_id.

    Words are [^\\x20\\x09-\\x0D]+, unchanged, of whole texts; a null text has none. Windows are judged
    on the input. Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one
    space) and, with keep_text, kept_text. A null doc_id counts as the smallest; rows that repeat a
    doc_id are one document's rows for the comparison (none is earlier than the other) and each has
    its row. Texts shorter than a window are kept, an empty table gives an empty one. Memory: one Arrow
    batch and its block of text (a longer text is a block by itself).
    """
    *short, size = lengths(size)
    rows_in = keyed_texts(docs, doc_id, text)

    def anchored(length: int, before: int | None):
        """Anchors (h, doc_id) of windows whose anchor of the level before is among the document's own (column 2)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                for part, data, offsets in K.text_blocks(batch.column(1)):
                    w = K.words(data, offsets, False)
                    _, h, row = _anchors(w, length, size)
                    if before is not None:
                        keep = _among(_anchors(w, before, size)[1], row, *_lists(batch.column(2), part))
                        h, row = h[keep], row[keep]
                    row, h = _pairs(row, h)
                    yield pa.RecordBatch.from_arrays([pa.array(K.as_long(h)), pa.array(keys[part][row])], names=["h", "doc_id"])

        return run

    def shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (h, doc_id): keep those whose h two documents have. A run may be of any length."""
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # the first row of the run at the end, if not known to be shared
        last = None  # (h, shared) of the run at the end
        for batch in batches:
            h = np.concatenate([held[0], batch.column(0).to_numpy()])
            d = np.concatenate([held[1], batch.column(1).to_numpy()])
            if not len(h):
                continue
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = np.diff(np.append(start, len(h)))
            shared = d[start] != d[start + size - 1]
            if last is not None and last[1] and last[0] == h[0]:
                shared[0] = True
            keep = np.repeat(shared, size)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(d[keep])], names=["h", "doc_id"])
            last, tail = (h[-1], bool(shared[-1])), slice(len(h), None) if shared[-1] else slice(start[-1], None)
            held = (h[tail][:1], d[tail][:1])  # rows of one document in a run are alike

    texts = rows_in.repartition("doc_id")
    alive, before = None, None
    for length in short:
        source = rows_in if alive is None else texts.join(alive.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "anchors")
        rows = source.mapInArrow(anchored(length, before), "h long not null, doc_id long not null").repartition("h").sortWithinPartitions("h", "doc_id")
        alive = rows.mapInArrow(shared_runs, "h long, doc_id long not null").groupBy("doc_id").agg(F.collect_set("h").alias("anchors"))
        before = length

    def whole_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, wanted = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for part, data, offsets in K.text_blocks(batch.column(1)):
                w = K.words(data, offsets, False)
                first, least, row = _anchors(w, before, size)
                mine, of = _lists(wanted, part)
                keep = _among(least, row, mine, of)
                first, row = first[keep], row[keep]
                h, g = K.span_hashes(w.hash, first, first + size), K.span_hashes(K.other_hashes(w), first, first + size, 7)
                order = np.lexsort((h, row))  # a window that a document repeats is one row
                new = np.ones(len(h), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
                h, g, row = h[order][new], g[order][new], row[order][new]
                yield pa.RecordBatch.from_arrays([pa.array(K.as_long(h)), pa.array(g.astype(np.uint32).view(np.int32)), pa.array(keys[part][row])], names=["h", "g", "doc_id"])

    def later_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (h, g, doc_id): keep those after the smallest doc_id of their window."""
        last = (None, None, None)
        for batch in batches:
            h, g, d = (batch.column(k).to_numpy() for k in range(3))
            if not len(h):
                continue
            new = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
            new[0] = last[:2] != (h[0], g[0])
            start = np.flatnonzero(new)
            low = np.append(last[2] if last[2] is not None else 0, d[start])[np.cumsum(new)]
            keep = d > low
            last = (h[-1], g[-1], low[-1])
            yield pa.RecordBatch.from_arrays([pa.array(d[keep]), pa.array(h[keep])], names=["doc_id", "h"])

    full = texts.join(alive.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "anchors").mapInArrow(whole_windows, "h long, g int, doc_id long")
    later = full.repartition("h", "g").sortWithinPartitions("h", "g", "doc_id").mapInArrow(later_rows, "doc_id long not null, h long")
    later = later.groupBy("doc_id").agg(F.collect_set("h").alias("cut"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, cut = batch.column(0), batch.column(2)
            for part, data, offsets in K.text_blocks(batch.column(1)):
                w = K.words(data, offsets, False)
                gone = np.zeros(len(w.hash) + 1, np.int64)
                mine, of = _lists(cut, part)
                if len(mine):
                    at, h = K.windows(w, size)
                    row = w.rows()[at]
                    some = np.isin(row, of)
                    at = at[some][_among(h[some], row[some], mine, of)]
                    gone[at] += 1
                    gone[at + size] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                n = w.counts
                kept = np.add.reduceat(np.append(keep, False), w.first[:-1], dtype=np.int64) * (n > 0)
                # kept words with one space after each, as one buffer
                start, length = w.start[keep], w.end[keep] - w.start[keep] + 1
                to = np.cumsum(length)
                src = np.arange(to[-1] if len(to) else 0) + np.repeat(start - (to - length), length)
                out = np.append(w.data, np.uint8(32))[np.minimum(src, len(w.data))]
                out[to - 1] = 32
                ends = np.concatenate([[0], to])[np.concatenate([[0], np.cumsum(kept)])]
                raw = out.tobytes()
                joined = [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                cols = [keys.slice(part.start, part.stop - part.start), pa.array(n, pa.int64()), pa.array(n - kept, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in joined])]
                if keep_text:
                    cols.append(pa.array(joined, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(cols)])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    result = texts.join(later.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "cut").mapInArrow(apply, schema)
    return result.withColumn("doc_id", real_id())
