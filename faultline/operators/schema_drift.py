"""Payloads whose layout drifts between files: path statistics, changes, one consistent table.

A payload is loaded as a map from leaf path to raw type and value. Statistics are aggregated by feed, file and
path with map-side combining; changes compare neighbouring files of a feed on those small statistics. The table has a
typed column for every path, one for all paths that renames link, and reports each value that did not fit.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from faultline.session import cut

_TYPES = {str: "string", bool: "boolean", int: "number", float: "number"}
LEAVES = "feed_id bigint, file_no int, path string, kind string, value string, form string, n bigint"
_WHOLE, _LONG = re.compile(r"[+-]?\d{1,18}"), re.compile(r"[+-]?\d{16,}")
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|NaN|-?Infinity")


def leaves(payload: str | None) -> list[tuple[str, str | None, str | None]]:
    """(path, raw type, value text) of each leaf, in the order written. Keys are joined by '.', an array is marked
    by [] after its key. A null leaf has a null type; equal numbers have equal texts. Null, blank and broken
    payloads, and payloads that are no object or array, have none."""
    try:
        root = json.loads(payload) if payload else None
    except (ValueError, RecursionError):
        return []
    out: list[tuple[str, str | None, str | None]] = []
    if not isinstance(root, (dict, list)):
        return out
    stack = [("[]" if isinstance(root, list) else "", root)]
    while stack:
        path, x = stack.pop()
        if isinstance(x, dict):
            stack.extend((f"{path}.{k}" if path else k, v) for k, v in reversed(x.items()))
        elif isinstance(x, list):
            path = path if path == "[]" and x is root else path + "[]"
            stack.extend((path, v) for v in reversed(x))
        elif x is None:
            out.append((path, None, None))
        elif isinstance(x, float) and x.is_integer() and abs(x) < 1e15:
            out.append((path, "number", str(int(x))))
        else:
            out.append((path, _TYPES[type(x)], x if isinstance(x, str) else json.dumps(x)))
    return out


def _form(value: str | None) -> str:
    """Comma-separated: whole (fits bigint), long (too long for double), number (any other); empty for text."""
    if value is None or not _NUMBER.fullmatch(value):
        return ""
    return ",".join(["whole" if _WHOLE.fullmatch(value) else "number"] + ["long"] * bool(_LONG.fullmatch(value)))


def _load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = Counter()  # one row per distinct leaf of a file in this batch: combining starts before the shuffle
        for feed, file, payload in zip(b["feed_id"], b["file_no"], b["payload"]):
            for path, kind, value in leaves(payload):
                rows[feed, file, path, kind, value] += 1
        yield pd.DataFrame([(*k, _form(k[4]), n) for k, n in rows.items()], columns=["feed_id", "file_no", "path", "kind", "value", "form", "n"], dtype=object)


def path_values(alerts: DataFrame) -> DataFrame:
    """feed_id, file_no, path, kind, form, h (hash of kind and value, null for a null leaf), n: the distinct leaves within each batch of `alerts` and how often
    each stood there. Payloads of an unknown feed or file are among them."""
    return alerts.select("feed_id", "file_no", "payload").mapInPandas(_load, LEAVES).select(
        "feed_id", "file_no", "path", "kind", "form", F.when(F.col("kind").isNotNull(), F.xxhash64("kind", "value")).alias("h"), "n")


def path_statistics(values: DataFrame) -> DataFrame:
    """One row per feed_id, file_no, path of path_values(): kind (null if every value is null; 'string' if several kinds meet)."""
    return values.where("feed_id is not null and file_no is not null").groupBy("feed_id", "file_no", "path").agg(
        F.expr("if(min(kind) = max(kind), min(kind), if(count(kind) = 0, null, 'string'))").alias("kind"))


def schema_changes(alerts: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """feed_id, file_no, change_kind, old_path, new_path of each change from file_no - 1 to file_no.

    A file whose predecessor is missing has no changes; so has the first file of a feed. A path that is only null
    has no kind and is never retyped. A file without any readable payload has no paths and is treated as missing.
    Every vanished and appeared path that share a value are a rename, also if several do.

    The neighbours of a path's statistics in its feed tell whether it stayed, vanished or appeared, in one ordered pass. Values are looked at only for paths
    that vanished or appeared; they meet by hash, so no path's values are gathered. `values` is path_values(alerts), where it is at hand."""
    v = cut(path_values(alerts)) if values is None else values
    s = path_statistics(v)
    files = s.select("feed_id", "file_no").distinct()
    by_file = Window.partitionBy("feed_id").orderBy("file_no")
    files = files.select("feed_id", "file_no", (F.lag("file_no").over(by_file) == F.col("file_no") - 1).alias("after"), (F.lead("file_no").over(by_file) == F.col("file_no") + 1).alias("before"))
    by_path = Window.partitionBy("feed_id", "path").orderBy("file_no")
    s = s.withColumns({"was": F.when(F.lag("file_no").over(by_path) == F.col("file_no") - 1, F.struct(F.lag("kind").over(by_path).alias("kind"))), "stays": F.coalesce(F.lead("file_no").over(by_path) == F.col("file_no") + 1, F.lit(False))})
    s = cut(s.join(files, ["feed_id", "file_no"]).select(
        "feed_id", "file_no", "path", F.expr("coalesce(was.kind <> kind, false)").alias("retyped"), F.expr("coalesce(after, false) and was is null").alias("new"), F.expr("coalesce(before, false) and not stays").alias("gone"))
        .where("retyped or new or gone"))
    retyped = s.where("retyped").select("feed_id", "file_no", F.lit("retyped").alias("change_kind"), F.col("path").alias("old_path"), F.col("path").alias("new_path"))
    # a path may appear in one file and be gone from the next: one row for each step in which it takes part
    ends = s.select("feed_id", "file_no", "path", F.explode(F.array_compact(F.array(F.when(F.col("new"), F.struct(F.col("file_no").alias("step"), F.lit(True).alias("come"))), F.when(
        F.col("gone"), F.struct((F.col("file_no") + 1).alias("step"), F.lit(False).alias("come")))))).alias("x")).select("feed_id", "file_no", "path", "x.step", "x.come")
    # vanished and appeared paths meet on a shared value, never all with all; an entry of the array is a path, so it is as short as a payload is narrow
    meet = v.where("h is not null").select("feed_id", "file_no", "path", "h").join(ends, ["feed_id", "file_no", "path"]).groupBy("feed_id", "step", "h").agg(
        F.collect_set(F.when(~F.col("come"), F.col("path"))).alias("old"), F.collect_set(F.when(F.col("come"), F.col("path"))).alias("new"))
    renamed = meet.where("size(old) > 0 and size(new) > 0").select("feed_id", F.col("step").alias("file_no"), F.lit("renamed").alias("change_kind"), F.explode("old").alias("old_path"), "new").select(
        "feed_id", "file_no", "change_kind", "old_path", F.explode("new").alias("new_path")).distinct()
    paired = renamed.select("feed_id", "file_no", F.explode(F.array(F.struct(F.lit(False).alias("come"), F.col("old_path").alias("path")), F.struct(F.lit(True).alias("come"), F.col("new_path").alias("path")))).alias("x"), F.lit(1).alias("paired"))
    alone = ends.select("feed_id", F.col("step").alias("file_no"), F.struct("come", "path").alias("x"), F.lit(0).alias("paired")).unionByName(paired).groupBy("feed_id", "file_no", "x").agg(F.max("paired").alias("paired")).where("paired = 0")
    alone = alone.select("feed_id", "file_no", F.expr("if(x.come, 'added', 'removed')").alias("change_kind"), F.expr("if(x.come, '', x.path)").alias("old_path"), F.expr("if(x.come, x.path, '')").alias("new_path"))
    return retyped.unionByName(renamed).unionByName(alone)


#: Paths a table can have; more is an error, never a loss.
MOST_PATHS = 20_000


class TableColumn(NamedTuple):
    """A column of the whole table: its name, the type of its elements and the paths that carry it."""

    name: str
    type: str
    paths: list[str]


def _linked(paths: list[str], renames: list[tuple[str, str]]) -> list[list[str]]:
    """The paths in groups that renames link, whatever the direction and number of steps."""
    up = {p: p for p in paths}

    def top(p: str) -> str:
        while up[p] != p:
            up[p] = p = up[up[p]]
        return p

    for a, b in renames:
        up[top(a)] = top(b)
    groups: dict[str, list[str]] = {}
    for p in sorted(paths):
        groups.setdefault(top(p), []).append(p)
    return list(groups.values())


def _type(n: Counter) -> str:
    """The type of most values, string on a tie; numbers are bigint if all that read as numbers fit, and string if double would change them."""
    kinds = Counter()
    for (kind, _), k in n.items():
        if kind:
            kinds[kind] += k
    forms = {x for _, f in n for x in f.split(",") if x}
    kind = max(kinds, key=lambda k: (kinds[k], k == "string", k), default="string")
    if kind != "number":
        return kind
    return "bigint" if "number" not in forms else "string" if "long" in forms else "double"


def table_columns(alerts: DataFrame) -> list[TableColumn]:
    """One column for each group of paths that renames link, named by the path with most values; all paths are covered, also those that are only null.

    Payloads are read once; counts and renames come from the same path values."""
    values = cut(path_values(alerts))
    counted = values.groupBy("path", "kind", "form").agg(F.sum("n").alias("n")).limit(12 * MOST_PATHS + 1).collect()
    by_path: dict[str, Counter] = {}
    for r in counted:
        by_path.setdefault(r["path"], Counter())[r["kind"], r["form"]] += r["n"]
    if len(by_path) > MOST_PATHS or len(counted) > 12 * MOST_PATHS:
        raise ValueError(f"payloads have more than {MOST_PATHS} paths")
    links = schema_changes(alerts, values).where("change_kind = 'renamed'").select("old_path", "new_path").distinct().limit(MOST_PATHS * 10 + 1).collect()
    if len(links) > MOST_PATHS * 10:
        raise ValueError(f"payloads have more than {MOST_PATHS * 10} renames")
    groups = sorted((max(ps, key=lambda p: by_path[p].total()), ps) for ps in _linked(list(by_path), [tuple(r) for r in links]))
    used, out = {"delivery_id", "feed_id", "file_no", "failed", "payload"}, []
    for main, ps in groups:
        base = name = re.sub(r"\W+", "_", main).strip("_") or "value"
        k = 1
        while name.casefold() in used:
            k += 1
            name = f"{base}_{k}"
        used.add(name.casefold())
        out.append(TableColumn(name, _type(sum((by_path[p] for p in ps), Counter())), ps))
    return out


def whole_table(alerts: DataFrame, columns: list[TableColumn] | None = None) -> DataFrame:
    """delivery_id, feed_id, file_no, an array of typed values per column of table_columns() and `failed`: the column of each value that did not fit.

    An array holds every value of the payload at the column's paths, in the order written, also those of all array elements; a null leaf and a value that did
    not fit are null elements. The column is null where the payload has no such path. Every delivery gives one row."""
    columns = table_columns(alerts) if columns is None else columns
    at = {p: i for i, c in enumerate(columns) for p in c.paths}
    names = [f"c{i}" for i in range(len(columns))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got: list[list] = [[None] * len(b) for _ in names]
            for row, payload in enumerate(b["payload"]):
                for path, _, value in leaves(payload):
                    x = got[at[path]]
                    if x[row] is None:
                        x[row] = []
                    x[row].append(value)
            keys = b.drop(columns=["payload"])
            yield pd.concat([keys, pd.DataFrame(dict(zip(names, got)), index=keys.index, columns=names, dtype=object)], axis=1)

    df = alerts.select("delivery_id", "feed_id", "file_no", "payload").mapInPandas(
        run, "delivery_id bigint, feed_id bigint, file_no int" + "".join(f", {n} array<string>" for n in names))
    typed = [(F.col(n) if c.type == "string" else F.expr(f"transform({n}, x -> try_cast(x as {c.type}))")).alias(c.name) for n, c in zip(names, columns)]
    failed = [F.array_repeat(F.lit(c.name), F.expr(f"coalesce(size(filter({n}, x -> x is not null and try_cast(x as {c.type}) is null)), 0)"))
              for n, c in zip(names, columns) if c.type != "string"]
    return df.select("delivery_id", "feed_id", "file_no", *typed, F.concat(F.expr("cast(array() as array<string>)"), *failed).alias("failed"))


def cast_report(table: DataFrame) -> DataFrame:
    """feed_id, file_no, column_name, n_failed: values of the table that did not fit, by file and column."""
    return table.select("feed_id", "file_no", F.explode("failed").alias("column_name")).groupBy(
        "feed_id", "file_no", "column_name").agg(F.count(F.lit(1)).alias("n_failed"))
