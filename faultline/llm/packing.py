"""Items of varying length into containers of fixed capacity by minimum bin slack.

One container at a time is filled: the largest item that is left opens it, and a subset-sum dynamic programme over the lengths that are
left, kept as one bitset, finds the total closest to the capacity; the counts of each length are traced back. Lengths enter the programme
from long to short and it ends as soon as the capacity is met exactly, so long items go first and short ones stay to fill gaps.

Items are distributed at random over windows of a bounded size, each packed by one task; items of containers that stayed short of full
are packed again in windows of their own kind, so the loss at the end of a window is not repeated in each.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from faultline.session import cut

#: Items per window; bounds the memory and time of one task.
WINDOW_ITEMS = 6000


def fill_one(counts: dict[int, int], order: list[int], capacity: int) -> list[tuple[int, int]]:
    """[(length, how many)] for one container from the lengths left. `order` lists the lengths from long to short; the first with a count
    opens the container."""
    first = next(x for x in order if counts[x])
    room = capacity - first
    if not room:
        return [(first, 1)]
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for x in order:
        n = counts[x] - (x == first)
        if x > room or n <= 0:
            continue
        n, k = min(n, room // x), 1
        while n > 0:
            k = min(k, n)
            steps.append((x, k, reach))
            reach |= reach << x * k & mask
            n, k = n - k, k * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, defaultdict(int)
    used[first] = 1
    for x, k, before in reversed(steps):
        if not before >> at & 1:
            at -= x * k
            used[x] += k
    return list(used.items())


def pack_window(lengths: list[int], capacity: int) -> list[int]:
    """Container number of each item. Items of length 0 go into the first container; no length may exceed `capacity`."""
    by: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        by[lengths[i]].append(i)
    out = [0] * len(lengths)
    by.pop(0, None)
    order = sorted(by, reverse=True)
    counts = {x: len(v) for x, v in by.items()}
    left, number = sum(counts.values()), 0
    while left:
        for x, n in fill_one(counts, order, capacity):
            for _ in range(n):
                out[by[x].pop()] = number
            counts[x] -= n
            left -= n
        if number % 64 == 0:
            order = [x for x in order if counts[x]]
        number += 1
    return out


def _pack(items: DataFrame, round_no: int, window_items: int) -> DataFrame:
    sizes = items.groupBy("spec_id").count().collect()  # one row per container specification
    windows = F.create_map(*[F.lit(x) for r in sizes for x in (r["spec_id"], max(1, -(-r["count"] // window_items)))]) if sizes else F.lit(None)
    df = items.withColumn("window", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(round_no)), windows[F.col("spec_id")].cast("long")).cast("long") if sizes
                          else F.lit(0).cast("long"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
        bins = pack_window(g["n_tokens"].tolist(), int(g["capacity"].iloc[0]))
        g["container_id"] = [f"r{round_no}-{w}-{b}" for w, b in zip(g["window"], bins)]
        g["fill"] = g.groupby("container_id")["n_tokens"].transform("sum")
        return g[["spec_id", "capacity", "container_id", "doc_id", "piece_no", "token_start", "n_tokens", "fill"]]

    return df.groupBy("spec_id", "window").applyInPandas(
        one, "spec_id int, capacity int, container_id string, doc_id bigint, piece_no int, token_start bigint, n_tokens bigint, fill bigint")


def pack(sizes: DataFrame, specs: DataFrame, window_items: int = WINDOW_ITEMS, most_specs: int = 1000) -> DataFrame:
    """spec_id, container_id, doc_id, piece_no, token_start, n_tokens, fill: where each piece of each document goes, for each row (spec_id, capacity)
    of `specs` (at most `most_specs`).

    `sizes` holds (doc_id, n_tokens) with unique doc_id. A document longer than the capacity is split into pieces of exactly the capacity, each in a
    container of its own, and a rest that is packed like any document; no other document is split. Documents of no tokens (null and empty texts, null
    sizes) take no room and go into a first container. Ties in length go by doc_id, so the result is the same every time. Capacities below 1 are left out."""
    rows = specs.where("capacity > 0").select("spec_id", "capacity").limit(most_specs + 1).collect()
    if len(rows) > most_specs:
        raise ValueError("too many container specifications")
    kinds = F.array(*[F.struct(F.lit(int(r["spec_id"])).cast("int").alias("spec_id"), F.lit(int(r["capacity"])).cast("int").alias("capacity")) for r in rows]) \
        if rows else F.expr("cast(array() as array<struct<spec_id int, capacity int>>)")
    each = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n"), F.explode(kinds).alias("k")).select("doc_id", "n", "k.spec_id", "k.capacity")
    whole = each.where("n > capacity").withColumn("piece_no", F.explode(F.expr("sequence(0, cast(n div capacity as int) - 1)"))).select(
        "spec_id", "capacity", F.concat(F.lit("f-"), "doc_id", F.lit("-"), "piece_no").alias("container_id"), "doc_id", "piece_no",
        (F.col("piece_no").cast("long") * F.col("capacity")).alias("token_start"), F.col("capacity").cast("long").alias("n_tokens"), F.col("capacity").cast("long").alias("fill"))
    rest = each.where("n <= capacity or n % capacity > 0").select(
        "spec_id", "capacity", "doc_id", F.expr("if(n > capacity, cast(n div capacity as int), 0)").alias("piece_no"),
        F.expr("if(n > capacity, (n div capacity) * capacity, 0L)").alias("token_start"), F.expr("if(n > capacity, n % capacity, n)").alias("n_tokens"))
    first = cut(_pack(rest, 1, window_items))
    again = first.where("fill < capacity").drop("container_id", "fill")
    second = _pack(again, 2, window_items)
    cols = ["spec_id", "container_id", "doc_id", "piece_no", "token_start", "n_tokens", "fill"]
    return whole.select(*cols).unionByName(first.where("fill = capacity").select(*cols)).unionByName(second.select(*cols))


def packing_report(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, capacity, containers, tokens, fewest (containers that the tokens need at least) and full (share of room used)."""
    used = placed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t")).groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    return used.join(specs.select("spec_id", "capacity"), "spec_id").select(
        "spec_id", "capacity", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("full"))
