"""A source repository: its code lines, commits, blame."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

# Endings of code files, folders that hold none of our own.
CODE_ENDINGS = (".py", ".java", ".kt", ".scala", ".js", ".jsx", ".ts", ".tsx", ".go", ".rb", ".php", ".cs", ".rs", ".c", ".cc", ".cpp", ".h", ".hpp", ".sql", ".yaml", ".yml", ".json", ".xml",
                ".properties", ".conf", ".toml", ".ini", ".sh", ".tf")
SKIP_FOLDERS = {".git", "node_modules", "venv", ".venv", "env", "__pycache__", "dist", "build", "target", ".idea", ".gradle", "vendor", "coverage", ".next", ".tox", ".mypy_cache", ".pytest_cache"}
MOST_BYTES = 2 << 20
#: git processes an investigation may start for blame and history.
GIT_CALLS = 12


def code_files(root: str) -> Iterator[str]:
    """Paths of code files below `root`, relative, in order; folders with a leading dot and large files left out."""
    for at, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in SKIP_FOLDERS and not d.startswith("."))
        for n in sorted(names):
            p = os.path.join(at, n)
            if n.endswith(CODE_ENDINGS) and os.path.getsize(p) <= MOST_BYTES:
                yield os.path.relpath(p, root)


def read_code(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files: path; lines: path, line_no, text). Paths are listed by the driver, contents read by the executors."""
    paths = list(code_files(root))
    files = spark.createDataFrame([(p,) for p in paths], "path string")

    def run(batches):
        for b in batches:
            rows = []
            for p in b["path"]:
                with open(os.path.join(root, p), encoding="utf-8", errors="replace") as f:
                    rows += [(p, i, x.rstrip("\r\n")) for i, x in enumerate(f, 1)]
            yield pd.DataFrame(rows, columns=["path", "line_no", "text"])

    import pandas as pd

    return files, files.repartition(max(1, len(paths) // 200)).mapInPandas(run, "path string, line_no bigint, text string")


def _git(root: str, *args: str) -> str:
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=30).stdout
    except (OSError, subprocess.TimeoutExpired):
        return ""


def commits(spark: SparkSession, root: str, since: str | None = None, path: str | None = None) -> DataFrame:
    """hash, at (UTC, to the minute), author, subject of all commits, or of those after `since`. Empty where there is no repository."""
    out = _git(root, "log", "--date=iso-strict", "--pretty=%H%x1f%cd%x1f%an%x1f%s", *([f"--since={since}"] if since else []), *(["--", path] if path else []))
    rows = []
    for line in out.split("\n"):
        parts = line.split("\x1f")
        if len(parts) == 4:
            at = datetime.fromisoformat(parts[1].replace("Z", "+00:00")).astimezone(timezone.utc).replace(tzinfo=None, second=0, microsecond=0)
            rows.append((parts[0], at, parts[2], parts[3]))
    return spark.createDataFrame(rows, "hash string, at timestamp_ntz, author string, subject string")


def touched_files(spark: SparkSession, root: str) -> DataFrame:
    """hash, at (UTC), path of every file that every commit changed. Empty where there is no repository."""
    rows, head = [], None
    for line in _git(root, "log", "--date=iso-strict", "--pretty=%x1f%H%x1f%cd", "--name-only").split("\n"):
        if line.startswith("\x1f"):
            _, h, at = line.split("\x1f")
            head = (h, datetime.fromisoformat(at.replace("Z", "+00:00")).astimezone(timezone.utc).replace(tzinfo=None, second=0, microsecond=0))
        elif line.strip() and head:
            rows.append((*head, line.strip()))
    return spark.createDataFrame(rows, "hash string, at timestamp_ntz, path string")


class History:
    """Blame and history of files, at most GIT_CALLS processes, repeated questions answered from memory."""

    def __init__(self, root: str, calls: int = GIT_CALLS):
        self.root, self.left, self.known = root, calls, {}

    def _ask(self, *args: str) -> str:
        if args not in self.known:
            if self.left <= 0:
                return ""
            self.left -= 1
            self.known[args] = _git(self.root, *args)
        return self.known[args]

    def touched(self, path: str, since: str | None = None) -> list[str]:
        """Hashes of the commits that changed a file, all or those after a day."""
        return [x for x in self._ask("log", "--pretty=%H", *([f"--since={since} 23:59:59"] if since else []), "--", path).split("\n") if x]

    def blame(self, path: str, line: int) -> dict[str, str]:
        """hash, author and summary of the commit that last changed a line."""
        text = self._ask("blame", "-L", f"{line},{line}", "--porcelain", "--", path)
        m = re.match(r"([0-9a-f]{7,40}) ", text)
        field = lambda k: (re.search(rf"(?m)^{k} (.*)$", text) or [None, ""])[1]
        return {"hash": m.group(1), "author": field("author"), "summary": field("summary")} if m else {}

    def last(self, path: str, most: int = 3) -> list[str]:
        """Subjects of the newest commits of a file."""
        return [x for x in self._ask("log", f"-n{most}", "--pretty=%h %s", "--", path).split("\n") if x]
