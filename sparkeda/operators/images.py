"""Image folders (I1-I16): one record per file from binaryFile, decoded in batches."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folder names of splits and suffixes of images.
SPLITS = ("dev", "eval", "evaluation", "holdout", "test", "testing", "train", "training", "val", "valid", "validation")
SUFFIXES = ("bmp", "gif", "jpeg", "jpg", "png", "tif", "tiff", "webp")


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """path, length, content, format suffix, label (first folder that is no split), split."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    raw = raw.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))).where(F.col("suffix").isin(*SUFFIXES))
    base = root.rstrip("/").split("/")[-1]
    folders = F.split(F.regexp_extract("path", rf"/{base}/(.*/)?[^/]+$", 1), "/")
    names = F.filter(folders, lambda x: x != "")
    is_split = lambda x: F.lower(x).isin(*SPLITS)
    return raw.select("path", "length", "content", "suffix", F.get(F.filter(names, lambda x: ~is_split(x)), F.lit(0)).alias("label"), F.lower(F.get(F.filter(names, is_split), F.lit(0))).alias("split"))


def magic(content) -> F.Column:
    """Format by the first bytes."""
    h = F.hex(F.substring(content, 1, 12))
    return F.when(h.startswith("89504E47"), "png").when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("47494638"), "gif").when(h.startswith("424D"), "bmp").when(h.startswith("49492A00") | h.startswith("4D4D002A"), "tiff").when(h.startswith("52494646") & h.endswith("57454250"), "webp")


def decode_png(raw: bytes) -> np.ndarray | None:
    """Pixels of an 8-bit, non-interlaced PNG (grey, RGB, with alpha), None if it is none of these or broken."""
    try:
        at, idat, head = 8, b"", None
        while at < len(raw):
            size, kind = struct.unpack(">I4s", raw[at : at + 8])
            body = raw[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"IDAT":
                idat += body
            at += 12 + size
        w, h, depth, color, _, _, inter = head
        ch = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
        if depth != 8 or inter or ch is None:
            return None
        flat = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(h, w * ch + 1)
        out = np.zeros((h, w * ch), np.uint8)
        before = np.zeros(w * ch, np.int64)
        for y in range(h):
            f, line = flat[y, 0], flat[y, 1:].astype(np.int64)
            if f == 1:
                line = np.cumsum(line.reshape(-1, ch), 0).reshape(-1) & 255
            elif f == 2:
                line = (line + before) & 255
            elif f in (3, 4):
                for i in range(w * ch):
                    a, b, c = (line[i - ch] if i >= ch else 0), before[i], (before[i - ch] if i >= ch else 0)
                    if f == 3:
                        p = (a + b) // 2
                    else:
                        e = a + b - c
                        p = min((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - c), 2, c))[2]
                    line[i] = (line[i] + p) & 255
            out[y] = line
            before = line
        return out.reshape(h, w, ch)
    except Exception:
        return None


def orientation(raw: bytes) -> int | None:
    """EXIF orientation of a JPEG (1 is upright; 5 to 8 swap the sides); None without one."""
    at = 2
    while raw[:2] == b"\xff\xd8" and at + 4 <= len(raw) and raw[at] == 0xFF:
        kind, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        if kind == 0xE1 and body[:6] == b"Exif\0\0":
            tiff = body[6:]
            order = "little" if tiff[:2] == b"II" else "big"
            number = lambda a, n: int.from_bytes(tiff[a : a + n], order)
            first = number(4, 4)
            for k in range(min(number(first, 2), 200)):
                entry = first + 2 + 12 * k
                if number(entry, 2) == 0x0112:
                    return number(entry + 8, 2) or None
            return None
        if kind == 0xDA:
            break
        at += 2 + size
    return None


def shrink(grey: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means over an h x w grid of cells."""
    rows = np.linspace(0, grey.shape[0], h + 1).astype(int)
    cols = np.linspace(0, grey.shape[1], w + 1).astype(int)
    return np.array([[grey[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(cols[:-1], cols[1:], strict=True)] for a, b in zip(rows[:-1], rows[1:], strict=True)])


def measure(raw: bytes) -> dict:
    px = decode_png(raw)
    if px is None:
        return {"width": None, "height": None, "brightness": None, "contrast": None, "sharpness": None, "entropy": None, "grey_as_rgb": None, "alpha_used": None, "ahash": None, "dhash": None}
    rgb = px[..., :3] if px.shape[2] >= 3 else np.repeat(px[..., :1], 3, 2)
    grey = rgb.astype(float) @ [0.299, 0.587, 0.114] / 255
    small = shrink(grey, min(128, grey.shape[0]), min(128, grey.shape[1]))
    hist = np.bincount((small * 255).astype(int).ravel(), minlength=256) / small.size
    a, d = shrink(grey, 8, 8), shrink(grey, 8, 9)
    bits = lambda m: int(np.packbits(m.ravel()).view(">u8")[0].astype(np.int64))
    gy, gx = np.gradient(small) if min(small.shape) > 1 else (np.zeros(1), np.zeros(1))
    return {
        "width": px.shape[1], "height": px.shape[0], "brightness": float(small.mean()), "contrast": float(small.std()), "sharpness": float((gx**2).mean() + (gy**2).mean()),
        "entropy": float(-(hist[hist > 0] * np.log2(hist[hist > 0])).sum()), "grey_as_rgb": bool(px.shape[2] >= 3 and (px[..., 0] == px[..., 1]).all() and (px[..., 1] == px[..., 2]).all()),
        "alpha_used": bool(px.shape[2] in (2, 4) and px[..., -1].min() < 255), "ahash": bits(a >= a.mean()), "dhash": bits(d[:, 1:] > d[:, :-1]),
    }


RECORD = "path string, label string, split string, suffix string, format string, length long, sha256 string, truncated boolean, width int, height int, brightness double, contrast double, sharpness double, entropy double, grey_as_rgb boolean, alpha_used boolean, ahash long, dhash long, orientation int, valid boolean"


def records(files: DataFrame) -> DataFrame:
    """One record per file. Pixels are decoded for PNG; other formats have facts of their bytes alone and count as valid by their header."""
    tail = F.hex(F.substring("content", -12, 12))
    fmt = magic(F.col("content"))
    cut = F.when(fmt == "jpeg", ~tail.endswith("FFD9")).when(fmt == "png", ~tail.contains("49454E44")).otherwise(False)
    facts = files.select("path", "label", "split", "suffix", fmt.alias("format"), "length", F.sha2("content", 256).alias("sha256"), cut.alias("truncated"), "content")

    def run(batches):
        for pdf in batches:
            got = pd.DataFrame([measure(c) for c in pdf["content"]], index=pdf.index)
            out = pd.concat([pdf.drop(columns="content"), got], axis=1)
            out["orientation"] = pd.array([orientation(c) for c in pdf["content"]], dtype="Int32")
            out["valid"] = out["format"].notna() & ~((out["format"] == "png") & out["width"].isna())
            for c in ("width", "height"):
                out[c] = out[c].astype("Int32")
            for c in ("ahash", "dhash"):
                out[c] = out[c].astype("Int64")
            yield out

    return facts.mapInPandas(run, RECORD)


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """Contents that occur more than once, with the number of splits and labels they cross."""
    return rows.groupBy(F.col("sha256").alias("content")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("n_splits"), F.count_distinct("label").alias("n_labels")).where("n > 1")


def near_duplicate_pairs(rows: DataFrame, threshold: int = 4) -> DataFrame:
    """Pairs (first, second, distance) whose smaller Hamming distance of the two hashes is at most the threshold.

    Bands: with more bands than bits may differ, two such hashes agree in one band at least, so the
    join on bands loses no pair; equal contents are joined through one representative.
    """
    bands = threshold + 1
    one = rows.where("ahash IS NOT NULL").groupBy("sha256").agg(F.min("path").alias("path"), F.first("ahash").alias("ahash"), F.first("dhash").alias("dhash"))
    width = 64 // bands

    def cut(h: str):
        part = lambda b: F.shiftrightunsigned(F.col(h), b * width).bitwiseAND(F.lit((1 << width) - 1 if b < bands - 1 else -1))
        return [F.struct(F.lit(f"{h}{b}").alias("band"), part(b).alias("part")) for b in range(bands)]

    keyed = one.select("path", "ahash", "dhash", F.inline(F.array(*cut("ahash"), *cut("dhash"))))
    a, b = keyed, keyed.select(F.col("path").alias("path2"), F.col("ahash").alias("ahash2"), F.col("dhash").alias("dhash2"), "band", "part")
    d = F.least(F.bit_count(F.col("ahash").bitwiseXOR(F.col("ahash2"))), F.bit_count(F.col("dhash").bitwiseXOR(F.col("dhash2"))))
    return a.join(b, ["band", "part"]).where("path < path2").select(F.col("path").alias("first"), F.col("path2").alias("second"), d.alias("distance")).where(F.col("distance") <= threshold).distinct()


def quality_flags(rows: DataFrame) -> DataFrame:
    """path and flag: dark, bright, flat, blurred, plain."""
    flags = {"dark": F.col("brightness") <= 0.08, "bright": F.col("brightness") >= 0.92, "flat": F.col("contrast") <= 0.035, "blurred": F.col("sharpness") <= 0.0008, "plain": F.col("entropy") <= 2.0}
    return rows.select("path", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in flags.items()]))).alias("flag"))


def loader_traps(rows: DataFrame) -> DataFrame:
    """path and trap: a suffix that is not the format, truncation, grey stored as colour, used alpha, a turned orientation."""
    same = F.when(F.col("suffix") == "jpg", "jpeg").when(F.col("suffix") == "tif", "tiff").otherwise(F.col("suffix"))
    traps = {"extension": F.col("format").isNotNull() & (same != F.col("format")), "truncated": F.col("truncated"), "grey_as_colour": F.col("grey_as_rgb"), "alpha": F.col("alpha_used"), "orientation": F.col("orientation") > 1, "undecodable": ~F.col("valid")}
    return rows.select("path", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in traps.items()]))).alias("trap"))


def label_profiles(rows: DataFrame) -> DataFrame:
    """Per label: files, median megapixels, mean brightness and sharpness."""
    return rows.where("valid").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.percentile(F.col("width") * F.col("height") / 1e6, 0.5).alias("megapixels"), F.round(F.avg("brightness"), 6).alias("brightness"), F.round(F.avg("sharpness"), 8).alias("sharpness"))


def outliers(rows: DataFrame, least: float = 4.5) -> DataFrame:
    """path, column, value, z: files whose size in bytes, shape or grey metrics lie far from the others'."""
    from sparkeda.operators.anomaly import univariate_outliers

    facts = rows.where("valid").select("path", F.col("length").cast("double").alias("length"), (F.col("width") / F.col("height")).alias("aspect"), "brightness", "contrast", "sharpness", "entropy")
    return univariate_outliers(facts, "path", facts.columns[1:]).where(F.abs("z") >= least).orderBy(F.desc(F.abs("z")), "path")


def deviating_labels(profiles: list[dict], least: float = 3.5) -> list[dict]:
    """Labels whose median size or mean brightness or sharpness is far from that of the other labels; needs 4 labels."""
    out = []
    for metric in ("megapixels", "brightness", "sharpness"):
        have = [(p["label"], p[metric]) for p in profiles if p[metric] is not None]
        if len(have) < 4:
            continue
        x = np.array([v for _, v in have], float)
        middle = np.median(x)
        mad = np.median(np.abs(x - middle))
        out += [{"label": label, "metric": metric, "value": v, "median": float(middle), "z": round(float(0.6745 * (v - middle) / mad), 4)} for label, v in have if mad > 0 and abs(0.6745 * (v - middle) / mad) >= least]
    return out


def manifest(rows: DataFrame) -> DataFrame:
    """Files, bytes and unreadable files by split, label and format."""
    return rows.groupBy("split", "label", "format").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.count_if(~F.col("valid")).alias("n_invalid"))
