import struct
import zlib

import numpy as np

from sparkeda import api
from sparkeda.operators import images


def png(px: np.ndarray) -> bytes:
    h, w = px.shape[:2]
    color = 2 if px.ndim == 3 else 0
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + row.tobytes() for row in px.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_folder(spark, tmp_path):
    rng = np.random.default_rng(1)
    px = lambda: rng.integers(0, 256, (64, 64, 3))
    a, b = px(), np.zeros((64, 64, 3))
    near = a.copy()
    near[0, 0] = 255 - near[0, 0]
    for name, body in {"train/cat/a.png": png(a), "val/cat/a.png": png(a), "train/dog/near.png": png(near), "train/dog/dark.png": png(b), "train/cat/wrong.jpg": png(px()), "train/cat/cut.jpg": b"\xff\xd8\xff\xe0abc", "train/cat/junk.png": b"no image", "train/cat/grey.png": png(np.repeat(rng.integers(0, 256, (32, 32, 1)), 3, 2))}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    r = api.profile_images(str(tmp_path))
    titles = [f.title for f in r.findings]
    assert not r.failures
    for t in ("Unreadable image files", "Duplicate images span train and evaluation splits", "Truncated image files", "File extensions do not match the actual encoding", "Basic image quality flags", "Channel layout is inconsistent"):
        assert t in titles
    rec = images.records(images.read_folder(spark, str(tmp_path))).persist()
    assert {(r["label"], r["split"]) for r in rec.collect()} == {("cat", "train"), ("cat", "val"), ("dog", "train")}
    pairs = {(x["first"].rsplit("/", 1)[1], x["second"].rsplit("/", 1)[1]) for x in images.near_duplicate_pairs(rec).collect()}
    assert ("a.png", "near.png") in pairs or ("near.png", "a.png") in pairs
    assert (images.decode_png(png(a)) == a).all()


def test_filtered_rows_decode():
    px = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    rows, before = [], np.zeros(12, np.int64)
    for y in range(4):
        line = px[y].reshape(-1).astype(np.int64)
        left = np.concatenate([[0] * 3, line[:-3]])
        rows.append(bytes([y % 4]) + ((line - [0 * line, left, before, (left + before) // 2][y % 4]) % 256).astype(np.uint8).tobytes())
        before = line
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0" * 4
    raw = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 4, 4, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(rows))) + part(b"IEND", b"")
    assert (images.decode_png(raw) == px).all()
