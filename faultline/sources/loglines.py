"""Log files as a data source: spark.read.format("loglines").option("paths", ...).load()

Plain, gzip, bzip2, xz, lzma and zip files (each member its own entry), directories (only what looks like a log) and globs. One partition per file; rows are
Arrow batches of src, entry, origin, line_no, text. A damaged file keeps the lines read before the damage and adds a row of the origin `<warning>`, as does a pattern without a match;
read_logs() leaves these out, log_warnings() gives them.
"""

from __future__ import annotations

import bz2
import glob
import gzip
import io
import lzma
import os
import re
import sys
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Endings of log files and archives, and names of system logs, which have none.
LOG_ENDINGS = (".log", ".txt", ".json", ".jsonl", ".ndjson", ".out", ".err")
ARCHIVE_ENDINGS = (".gz", ".bz2", ".xz", ".lzma", ".zip")
SYSTEM_LOGS = set("messages syslog secure auth cron mail kern daemon debug dmesg boot user console audit".split())
SCHEMA = "src int, entry int, origin string, line_no bigint, text string"
_ARROW = pa.schema([("src", pa.int32()), ("entry", pa.int32()), ("origin", pa.string()), ("line_no", pa.int64()), ("text", pa.string())])


def looks_like_log(name: str) -> bool:
    """Whether a file found in a directory is a log by its name: an ending, a rotation number after one, or the name of a system log."""
    base = name.lower()
    for e in ARCHIVE_ENDINGS:
        base = base[:-len(e)] if base.endswith(e) else base
    plain = re.sub(r"\.\d+$", "", base)
    rotated = plain != base
    return plain.endswith(LOG_ENDINGS) or plain in SYSTEM_LOGS or ("." not in plain and plain.endswith("log")) or (rotated and plain.endswith(LOG_ENDINGS)) \
        or (name.lower().endswith(ARCHIVE_ENDINGS) and base != name.lower())


def expand(patterns: list[str]) -> tuple[list[str], list[str]]:
    """(files, patterns without a match): directories are walked in order of name, globs may be recursive."""
    files, missing = [], []
    for p in patterns:
        hits = sorted(glob.glob(p, recursive=True)) if glob.has_magic(p) else [p] if os.path.exists(p) else []
        if not hits:
            missing.append(p)
        for h in hits:
            if os.path.isdir(h):
                for root, dirs, names in os.walk(h):
                    dirs.sort()
                    files += [os.path.join(root, n) for n in sorted(names) if looks_like_log(n)]
            else:
                files.append(h)
    return files, missing


def _streams(path: str) -> Iterator[tuple[str, io.BufferedIOBase]]:
    base, low = os.path.basename(path), path.lower()
    if low.endswith(".zip"):
        with zipfile.ZipFile(path) as z:
            for info in z.infolist():
                if not info.is_dir():
                    with z.open(info) as f:
                        yield f"{base}!{info.filename}", f
        return
    opener = gzip.open if low.endswith(".gz") else bz2.open if low.endswith(".bz2") else lzma.open if low.endswith((".xz", ".lzma")) else open
    with opener(path, "rb") as f:
        yield base, f


def read_lines(path: str, encoding: str = "utf-8", max_chars: int = 0) -> Iterator[tuple[int, str, int, str]]:
    """(entry, origin, line_no, text) of one file; undecodable bytes are replaced, lines are cut at `max_chars` if given."""
    entry = -1
    try:
        for entry, (origin, f) in enumerate(_streams(path)):
            for n, raw in enumerate(f, 1):
                yield entry, origin, n, raw.decode(encoding, "replace").rstrip("\r\n")[:max_chars or None]
    except (OSError, EOFError, lzma.LZMAError, zipfile.BadZipFile) as e:
        yield max(entry, 0), "<warning>", 0, f"{os.path.basename(path)}: {type(e).__name__}: {e}"


class _File(InputPartition):
    def __init__(self, src: int, path: str):
        self.src, self.path = src, path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.patterns = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.encoding, self.max_chars = options.get("encoding", "utf-8"), int(options.get("maxlinechars", 0))

    def partitions(self):
        files, missing = expand(self.patterns)
        return [_File(i, p) for i, p in enumerate(files)] + [_File(-1, p) for p in missing] or [_File(0, "")]

    def read(self, partition):
        rows: list[tuple] = []
        if partition.src < 0:
            rows.append((-1, 0, "<warning>", 0, f"{partition.path}: no such file"))
        elif partition.path:
            for entry, origin, n, text in read_lines(partition.path, self.encoding, self.max_chars):
                rows.append((partition.src, entry, origin, n, text))
                if len(rows) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


class LogLines(DataSource):
    @classmethod
    def name(cls):
        return "loglines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader({k.lower(): v for k, v in self.options.items()})


def _load(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    from faultline.session import prepare

    prepare(spark)
    spark.dataSource.register(LogLines)
    return spark.read.format("loglines").option("paths", ",".join(paths)).option("encoding", encoding).load()


def read_logs(spark: SparkSession, paths: list[str], encoding: str = "utf-8", max_lines: int = 0) -> DataFrame:
    """Lines of the files, `-` being standard input; the first `max_lines` of all together, in the order of the files, if given."""
    files = [p for p in paths if p != "-"]
    out = _load(spark, files, encoding).where("origin <> '<warning>'") if files else None
    if "-" in paths:
        given = from_text(spark, sys.stdin.read().split("\n")).withColumn("src", F.lit(1 << 30))
        out = given if out is None else out.unionByName(given)
    if max_lines:
        # one row per file: lines that come before it
        sizes = sorted((r["src"], r["entry"], r["n"]) for r in out.groupBy("src", "entry").agg(F.max("line_no").alias("n")).collect())
        before, keep = 0, []
        for src, entry, n in sizes:
            if before < max_lines:
                keep.append((src, entry, min(n, max_lines - before)))
            before += n
        out = out.join(F.broadcast(spark.createDataFrame(keep, "src int, entry int, most bigint")), ["src", "entry"]).where("line_no <= most").drop("most")
    return out


def log_warnings(spark: SparkSession, paths: list[str], encoding: str = "utf-8") -> DataFrame:
    """text of each warning: damaged files and patterns without a match."""
    return _load(spark, [p for p in paths if p != "-"], encoding).where("origin = '<warning>'").select("text")


def labelled(spark: SparkSession, sources: list[str], encoding: str = "utf-8") -> DataFrame:
    """Lines of sources given as label=path (or a path, whose name is the label), with a column `service`."""
    out = None
    for i, s in enumerate(sources):
        label, _, path = s.partition("=") if "=" in s else (os.path.splitext(os.path.basename(s))[0], "", s)
        # files of one source keep different numbers
        df = read_logs(spark, [path], encoding).withColumn("src", F.col("src") * len(sources) + i).withColumn("service", F.lit(label))
        out = df if out is None else out.unionByName(df)
    return out


def from_text(spark: SparkSession, lines: list[str], origin: str = "<stdin>") -> DataFrame:
    """Lines held by the driver, such as standard input."""
    return spark.createDataFrame([(0, 0, origin, i, x.rstrip("\r\n")) for i, x in enumerate(lines, 1)], SCHEMA)
