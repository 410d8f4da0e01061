"""Sources: DataFrames, mappings, files, lists of files, folders (IO1-IO10)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fnmatch import fnmatch
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sparkeda.functions.columns import normalise
from sparkeda.model import DataLoadError, UnsupportedSourceError

FORMATS = {".csv": "csv", ".parquet": "parquet", ".orc": "orc", ".json": "json", ".xlsx": "excel", ".xlsm": "excel", ".xls": "excel"}


def session() -> SparkSession:
    active = SparkSession.getActiveSession()
    return active or SparkSession.builder.appName("sparkeda").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def format_options(kind: str, read_options: Mapping[str, Any] | None) -> dict[str, Any]:
    """Options of one format. Once any format is named in read_options, formats that are not named get none."""
    options = dict(read_options or {})
    named = set(FORMATS.values()) & set(options)
    return dict(options.get(kind, {})) if named else options


def table_name(path: str, names: Mapping[str, str] | None) -> str:
    p = Path(path)
    for key in (path, p.name, p.stem):
        if names and key in names:
            return names[key]
    return p.stem


def discover(folder: str, recursive: bool = False, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """Files of known formats in a folder, each a table of its own; a Parquet folder counts as one file."""
    def matches(p: Path, patterns: Sequence[str]) -> bool:
        return any(fnmatch(p.name, x) or fnmatch(str(p), x) for x in patterns)

    found = sorted(Path(folder).rglob("*") if recursive else Path(folder).iterdir())
    inside = [p for p in found if p.is_dir() and p.suffix in FORMATS]
    keep = [p for p in found if p.suffix.lower() in FORMATS and not any(d in p.parents for d in inside)]
    return [str(p) for p in keep if (not include or matches(p, include)) and not matches(p, exclude)]


def read(path: str, read_options: Mapping[str, Any] | None = None, spark: SparkSession | None = None) -> DataFrame:
    spark, kind = spark or session(), FORMATS.get(Path(path).suffix.lower())
    if kind is None:
        raise UnsupportedSourceError(f"no reader for {path}; known: {', '.join(FORMATS)}")
    options = format_options(kind, read_options)
    try:
        if kind == "csv":
            return spark.read.csv(path, **{"header": True, "inferSchema": True, **options})
        if kind == "excel":
            frame = pd.read_excel(path, **options)
            if isinstance(frame, dict):
                raise DataLoadError(f"{path} gives several sheets; name one with sheet_name")
            return spark.createDataFrame(frame)
        return getattr(spark.read.options(**{k: str(v) for k, v in options.items()}), kind)(path)
    except ImportError as error:
        raise DataLoadError(f"reading {path} needs an Excel engine: {error}") from error
    except DataLoadError:
        raise
    except Exception as error:
        raise DataLoadError(f"{path} cannot be read: {error}") from error


def validate(name: str, frame: DataFrame) -> DataFrame:
    low = [c.lower() for c in frame.columns]
    twice = sorted({c for c in low if low.count(c) > 1})
    if twice:
        raise DataLoadError(f"table {name} has columns of one name: {', '.join(twice)}")
    return normalise(frame)


def load_tables(source: Any, *, recursive: bool = False, include: Sequence[str] = (), exclude: Sequence[str] = (), names: Mapping[str, str] | None = None, read_options: Mapping[str, Any] | None = None, spark: SparkSession | None = None) -> dict[str, DataFrame]:
    """{name: DataFrame} of a Spark or pandas DataFrame (named table), a mapping, a path, paths or a folder."""
    spark = spark or session()
    if isinstance(source, pd.DataFrame):
        if source.columns.duplicated().any():
            raise DataLoadError("table table has columns of one name")
        source = spark.createDataFrame(source)
    if isinstance(source, DataFrame):
        return {"table": validate("table", source)}
    if isinstance(source, Mapping):
        out = {}
        for name, item in source.items():
            out[str(name)] = next(iter(load_tables(item, read_options=read_options, spark=spark).values()))
        if not out:
            raise DataLoadError("the source is empty")
        return out
    if isinstance(source, (str, Path)):
        path = str(source)
        source = discover(path, recursive, include, exclude) if "://" not in path and Path(path).is_dir() and Path(path).suffix not in FORMATS else [path]
    if not isinstance(source, Sequence):
        raise UnsupportedSourceError(f"cannot load a {type(source).__name__}")
    out = {}
    for path in map(str, source):
        name = table_name(path, names)
        if name in out:
            raise DataLoadError(f"two sources are named {name}; set names=")
        out[name] = validate(name, read(path, read_options, spark))
    if not out:
        raise DataLoadError("the source has no table")
    return out
