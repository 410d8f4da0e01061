"""Operator 1: token ids as directly addressable codes (DAC) in binary files.

An id is split into 8-bit chunks, low chunk first. Level k holds chunk k of every
id that has one, a bitmap says which of them continue at level k + 1, and a rank
directory counts the set bits before every 512th. The chunk of token i at the next
level stands at rank(i), so any token is read without decoding the ones before it.

File layout (little-endian), one file for each range of ascending doc_id:
    magic "DAC1", u32 levels, u64 documents, u64 tokens
    i64[documents] doc_id, u64[documents + 1] first token of each document
    for each level: u64 entries, u8[entries] chunks,
        u64[ceil(entries / 64)] bitmap, u64[ceil(entries / 512) + 1] rank directory
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkeda.llm.shared import NO_ID, fresh, keyed_texts, stored

MAGIC = b"DAC1"
RANK_EVERY = 512
#: Chunks of text (between blanks) whose ids a worker remembers at once; then it starts anew.
MEMO = 1_000_000


class Dac:
    """Directly addressable codes of one id sequence."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def encode(cls, ids: np.ndarray) -> Dac:
        rest, levels = np.asarray(ids, np.uint32), []
        while True:
            more = rest > 255
            bits = np.packbits(more, bitorder="little")
            bitmap = np.frombuffer(bits.tobytes() + b"\0" * (-len(bits) % 8), "<u8")
            counts = np.add.reduceat(more, np.arange(0, len(more), RANK_EVERY), dtype=np.uint64) if len(more) else []
            levels.append((rest.astype(np.uint8), bitmap, np.concatenate([[0], np.cumsum(counts)]).astype("<u8")))
            if not more.any():
                return cls(levels)
            rest = rest[more] >> np.uint32(8)

    def _bits(self, level: int, a: int, b: int) -> np.ndarray:
        bitmap = self.levels[level][1].view(np.uint8)
        return np.unpackbits(bitmap[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)

    def rank(self, level: int, i: int) -> int:
        """Set bits before bit i: one directory entry and at most RANK_EVERY bits."""
        block = i // RANK_EVERY
        return int(self.levels[level][2][block]) + int(np.count_nonzero(self._bits(level, block * RANK_EVERY, i)))

    def slice(self, a: int, b: int) -> np.ndarray:
        """ids a to b (b excluded), reading only their own entries of each level."""
        out = self.levels[0][0][a:b].astype(np.uint32)
        at, level = np.arange(b - a), 0
        while len(at):
            more = self._bits(level, a, b)
            if not more.any():
                break
            a, at = self.rank(level, a), at[more]
            b, level = a + len(at), level + 1
            out[at] |= self.levels[level][0][a:b].astype(np.uint32) << np.uint32(8 * level)
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])


def pack(doc_ids: np.ndarray, first: np.ndarray, ids: np.ndarray) -> bytes:
    dac = Dac.encode(ids)
    parts = [MAGIC, struct.pack("<IQQ", len(dac.levels), len(doc_ids), len(ids)), np.asarray(doc_ids, "<i8").tobytes(), np.asarray(first, "<u8").tobytes()]
    for chunks, bitmap, ranks in dac.levels:
        parts += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bitmap.tobytes(), ranks.tobytes()]
    return b"".join(parts)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, Dac]:
    """(doc_ids, first token of each document and the end, codes): views of the bytes, nothing is decoded."""
    if blob[:4] != MAGIC:
        raise ValueError("not a DAC file")
    n_levels, docs, _ = struct.unpack_from("<IQQ", blob, 4)
    at = 24

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, n, at)
        at += out.nbytes
        return out

    doc_ids, first, levels = take("<i8", docs), take("<u8", docs + 1).astype(np.int64), []
    for _ in range(n_levels):
        n = int(take("<u8", 1)[0])
        levels.append((take("u1", n), take("<u8", -(-n // 64)), take("<u8", -(-n // RANK_EVERY) + 1)))
    return doc_ids, first, Dac(levels)


class Encoder:
    """ids of whole texts by the tokenizers library.

    Blanks and line ends part the tokenizer's words, so the chunk between two of them always has
    the same ids and is encoded once. Chunks share their core: A-Z of an ASCII chunk is lower-cased (as
    the tokenizer does), and a last full stop or comma after a letter is a token run of its own.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        probe = ("Abc Def", "ab\ncd", "ab.", "cd,", "Zürich.")
        one = self._library(list(probe))
        parts = self._library(["abc", "def", "ab", "cd", ".", ",", "Zürich"])
        if one != [parts[0] + parts[1], parts[2] + parts[3], parts[2] + parts[4], parts[3] + parts[5], parts[6] + parts[4]]:
            raise ValueError("this tokenizer does not part words at blanks or keeps case")
        self.marks = {".": parts[4], ",": parts[5]}
        # matched by the library in the text as it stands: what is one of them in lower case alone has other ids
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        # the byte-level alphabet: printable bytes stand for themselves, the others for 256, 257 .. in order
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.alphabet = {b: 256 + i for i, b in enumerate(odd)}
        self.clear()

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used, self.known = np.zeros(1 << 16, np.uint32), 0, 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _store(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, k, total = self.known, len(keys), len(ids)
        while n + k > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + total] = ids
        self.size[n : n + k] = sizes
        self.start[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.used, self.known = self.used + total, n + k
        self.index.update(zip(keys, range(n, n + k), strict=True))

    def _gather(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all entries one after another, end of each)."""
        size = self.size[code]
        to = np.cumsum(size)
        return self.flat[np.arange(to[-1] if len(to) else 0) + np.repeat(self.start[code] - (to - size), size)], to

    def _learn(self, new: list[str]) -> None:
        """Store chunks that are not in the index: first their cores, then those with a mark; other spellings share a core's entry."""
        index, marks = self.index, self.marks
        same: list[tuple[str, str]] = []
        ended: dict[str, list[tuple[str, str]]] = {m: [] for m in marks}
        cores: dict[str, None] = {}
        for w in new:
            c = w.lower() if w.isascii() else w
            if c != w and any(t in c for t in self.added):
                cores[w] = None
                continue
            m = c[-1:]
            if m in marks and c[-2:-1].lower().isalpha():
                c = c[:-1]
                ended[m].append((w, c))
            elif c is not w and c != w:
                same.append((w, c))
            if c not in index:
                cores[c] = None
        # lower-case letters in normal form are one word to the model; its alphabet stands for bytes
        easy = [c for c in cores if c.isalpha() and c == c.lower() and is_normalized("NFC", c) and "\u03c2" not in c]
        done = {c: [t.id for t in self.model.tokenize(c if c.isascii() else c.encode().decode("latin-1").translate(self.alphabet))] for c in easy}
        hard = [c for c in cores if c not in done]
        done.update(zip(hard, self._library(hard), strict=True))
        sizes = np.fromiter(map(len, done.values()), np.int64, len(done))
        self._store(list(done), np.fromiter(chain.from_iterable(done.values()), np.uint32, int(sizes.sum())), sizes)
        for m, pairs in ended.items():
            if pairs:
                ids, to = self._gather(np.fromiter((index[c] for _, c in pairs), np.int64, len(pairs)))
                sizes = np.diff(to, prepend=0) + len(marks[m])
                self._store([w for w, _ in pairs], np.insert(ids, np.repeat(to, len(marks[m])), np.tile(np.array(marks[m], np.uint32), len(pairs))), sizes)
        for w, c in same:
            index[w] = index[c]

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id after each, first id of each and the end)."""
        if len(self.index) > MEMO:
            self.clear()
        chunks = "\n".join(texts).replace("\n", " ").split(" ")
        code = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        unseen = np.flatnonzero(code < 0)
        if len(unseen):
            missing = [chunks[i] for i in unseen.tolist()]
            self._learn(list(dict.fromkeys(missing)))
            code[unseen] = np.fromiter(map(self.index.__getitem__, missing), np.int64, len(missing))
        ids, to = self._gather(code)
        last = np.cumsum([t.count(" ") + t.count("\n") + 1 for t in texts]) - 1
        stop = to[last]
        return np.insert(ids, stop, end), np.concatenate([[0], stop + np.arange(1, len(texts) + 1)])


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(vocabulary: str) -> Encoder:
    """The worker's encoder; a worker keeps it, and what it remembers, from task to task."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _write(folder: str, blob: bytes) -> str:
    """Under a name of its own: a lost or repeated attempt leaves a file that no table names."""
    files, at = _filesystem(folder)
    name = f"{uuid.uuid4().hex}.dac"
    with files.open_output_stream(f"{at}/{name}", compression=None) as out:
        out.write(blob)
    return f"{folder}/{name}"


def encode_to_files(docs: DataFrame, folder: str, vocabulary: str, end: int = 1, doc_id: str = "doc_id", text: str = "text", file_bytes: int = 8 << 20) -> DataFrame:
    """Encode every whole text and write DAC files whose documents ascend by doc_id.

    Returns one row per file: path, at (range partition), no (file within it), n_docs, n_tokens.
    Null or empty texts have the end id alone. A null doc_id comes first and is kept as the
    smallest long. Rows that repeat a doc_id are kept as rows of their own, ordered by a hash of the
    text, so that they need not meet in one task. An empty table gives no file.
    A file holds about file_bytes of text (a longer document is a file by itself), so memory
    is bounded by the longest document.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = keyed_texts(docs, doc_id, text)
    rows = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_for(vocabulary)
        at, no = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, no
            ids = np.concatenate([h[1] for h in held])
            n = np.cumsum([0] + [len(h[1]) for h in held])
            first = np.concatenate([h[2][:-1] + k for h, k in zip(held, n[:-1], strict=True)] + [n[-1:]])
            keys = np.concatenate([h[0] for h in held])
            path = _write(folder, pack(keys, first, ids))
            held, size, no = [], 0, no + 1
            return pa.RecordBatch.from_pydict({"path": [path], "at": pa.array([at], pa.int32()), "no": pa.array([no - 1], pa.int32()), "n_docs": pa.array([len(keys)], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64())})

        for batch in batches:
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for k in range(0, len(keys), 256):
                part = texts.slice(k, 256)
                ids, first = encoder.encode(part.to_pylist(), end)
                held.append((keys[k : k + 256], ids, first))
                size += part.nbytes
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(run, "path string, at int, no int, n_docs long, n_tokens long")


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Read DAC files back: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32.

    The files are those of encode_to_files; a file's first token follows from the sums of
    the partitions before it (one row each) and of the files before it in its partition.
    """
    from pyspark.sql import Window

    sums = files.groupBy("at").agg(F.sum("n_tokens").alias("n"))
    bases = sums.select("at", (F.sum("n").over(Window.orderBy("at")) - F.col("n")).alias("base"))
    before = F.sum("n_tokens").over(Window.partitionBy("at").orderBy("no")) - F.col("n_tokens")
    located = files.withColumn("before", before).join(F.broadcast(bases), "at").select("path", (F.col("base") + F.col("before")).alias("start"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = _filesystem(path)
                with fs.open_input_file(at) as f:
                    keys, first, dac = unpack(f.read())
                crc = [zlib.crc32(dac.slice(a, b).astype("<u4").tobytes()) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, mask=keys == NO_ID), "start": pa.array(start + first[:-1], pa.int64()), "n_tokens": pa.array(np.diff(first), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return located.repartition(parts).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, vocabulary: str, end: int = 1, folder: str | None = None, **columns: str) -> DataFrame:
    """encode_to_files and read_files in one: the files are written when this is called."""
    spark = docs.sparkSession
    folder = folder or fresh(spark, "dac")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    return read_files(spark, stored(encode_to_files(docs, folder, vocabulary, end, **columns), "dac-files"))
