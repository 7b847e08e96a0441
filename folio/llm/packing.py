"""Problem 6: filling containers of fixed capacity with whole texts.

Only the histogram of token counts, at most ``capacity`` rows, reaches the driver.  There the plan is made:

1. lengths above the window are packed largest first, with the largest that still fits, many equal containers
   at a time;
2. the rest fills windows (a whole fraction of the capacity): all combinations of up to three length classes
   that fill a window are enumerated, and non-negative least squares against the histogram gives how often
   each is to be used; the counts are rounded within what is there;
3. what remains is packed as in 1, whole windows going into containers beside it.

The plan is a list of intervals per length: items of that length, numbered by id, from a to b go into containers
from c on, m in each.  Items look their container up in it, so no task ever holds a container's neighbours.

Defined results: NULL and empty texts take no room and get no row; a text above the capacity fills containers
of its own and leaves its remainder as an item; equal texts under several ids are items of their own; a row that
comes twice is two items, numbered one after the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import FOLDER, VOCABULARY, counted

WINDOW = 512
CLASSES = 128
BUCKET_ROWS = 100_000


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 with least ||a x - b||, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram_b = a.T @ b
    tol = 1e-9 * max(1.0, np.abs(gram_b).max(initial=0))
    for _ in range(rounds or 3 * a.shape[0]):
        gain = gram_b - a.T @ (a @ x)
        gain[passive] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] <= tol:
            break
        passive[k] = True
        while True:
            idx = np.flatnonzero(passive)
            sub = a[:, idx]
            z = np.linalg.lstsq(sub, b, rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[idx] = z
                break
            bad = z <= 1e-12
            step = np.min(x[idx][bad] / np.maximum(x[idx][bad] - z[bad], 1e-300))
            x[idx] += step * (z - x[idx])
            passive[idx[x[idx] <= 1e-12]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def combinations(window: int, classes: int, depth: int = 3) -> list[tuple[int, ...]]:
    """All non-increasing tuples of up to depth classes (1 .. classes, of window/classes tokens) that fill the window."""
    out: list[tuple[int, ...]] = [(classes,)]
    if depth > 1:
        out += [(classes - k, k) for k in range(1, classes // 2 + 1)]
    if depth > 2:
        out += [(i, j, classes - i - j) for i in range(1, classes) for j in range(1, i + 1) if 1 <= classes - i - j <= j]
    return out


class Plan:
    """Containers made so far: intervals (length, first number, container, items of the length in each)."""

    def __init__(self, histogram: dict[int, int]):
        self.left = dict(histogram)
        self.used = dict.fromkeys(histogram, 0)
        self.rows: list[tuple[int, int, int, int]] = []
        self.containers = 0

    def take(self, length: int, count: int, container: int, each: int) -> None:
        self.rows.append((length, self.used[length], container, each))
        self.used[length] += count
        self.left[length] -= count


def _greedy(available: dict[int, int], capacity: int, only_above: int = 0):
    """(combination as {length: how many}, how often), largest first; stops when no length above only_above is left."""
    while lengths := sorted(n for n, c in available.items() if c > 0):
        if lengths[-1] <= only_above:
            return
        room, combo, top = capacity, {}, len(lengths)
        while room and top:
            top = int(np.searchsorted(lengths, room, "right"))
            while top and combo.get(lengths[top - 1], 0) >= available[lengths[top - 1]]:
                top -= 1
            if top:
                n = lengths[top - 1]
                combo[n] = combo.get(n, 0) + 1
                room -= n
        often = min(available[n] // m for n, m in combo.items())
        for n, m in combo.items():
            available[n] -= often * m
        yield combo, often


def make_plan(histogram: dict[int, int], capacity: int, window: int = WINDOW, classes: int = CLASSES) -> Plan:
    """A packing of all items of the histogram (length: count), each length at most capacity."""
    plan = Plan({n: c for n, c in histogram.items() if c > 0})
    if any(not 0 < n <= capacity for n in plan.left):
        raise ValueError("lengths must be from 1 to capacity")
    parts = max(1, capacity // window) if capacity > window else 1
    window = capacity // parts
    unit = -(-window // classes)
    classes = window // unit

    def place(combo: dict[int, int], often: int) -> None:
        for n, m in combo.items():
            plan.take(n, often * m, plan.containers, m)
        plan.containers += often

    if parts > 1:
        for combo, often in _greedy(dict(plan.left), capacity, window):
            place(combo, often)
    # windows: groups of items of the same combination of classes, kept as (lengths, how often)
    groups: list[tuple[tuple[int, ...], int]] = []
    left = dict(plan.left)
    by_class: dict[int, list[int]] = {}
    for n in sorted(left):
        if left[n] > 0 and (k := -(-n // unit)) <= classes:
            by_class.setdefault(k, []).append(n)
    if by_class:
        combos = combinations(window, classes)
        a = np.zeros((classes, len(combos)))
        for k, combo in enumerate(combos):
            for c in combo:
                a[c - 1, k] += 1
        b = np.array([sum(left[n] for n in by_class.get(c, ())) for c in range(1, classes + 1)], float)
        x = nnls(a, b)
        for k in sorted(np.flatnonzero(x > 0.5), key=lambda k: (-x[k], k)):
            combo, want = combos[k], int(np.rint(x[k]))
            while want > 0:
                lengths, taken = [], {}
                for c in combo:  # the longest of each class that is still there
                    n = next((n for n in reversed(by_class.get(c, ())) if left[n] > taken.get(n, 0)), None)
                    if n is None:
                        break
                    lengths.append(n)
                    taken[n] = taken.get(n, 0) + 1
                if len(lengths) < len(combo):
                    break
                often = min([want, *(left[n] // m for n, m in taken.items())])
                for n, m in taken.items():
                    left[n] -= often * m
                groups.append((tuple(lengths), often))
                want -= often
    # whole windows into containers, windows of one kind next to each other
    at, open_parts = plan.containers * parts, 0
    for lengths, often in groups:
        for n in set(lengths):
            m = lengths.count(n)
            # windows at .. at+often lie in containers at//parts ..; intervals that start within a container first
            done, w = 0, at
            while done < often:
                inside = w % parts
                if inside or often - done < parts:
                    step = min(often - done, parts - inside)
                    plan.take(n, step * m, w // parts, step * m)
                else:
                    step = (often - done) // parts * parts
                    plan.take(n, step * m, w // parts, parts * m)
                done, w = done + step, w + step
        at += often
    open_parts = -at % parts if groups else 0
    plan.containers = -(-at // parts)
    if open_parts:  # the last container has windows free
        room = open_parts * window
        for combo, _ in _greedy({n: c for n, c in plan.left.items() if n <= room}, room):
            for n, m in combo.items():
                plan.take(n, m, plan.containers - 1, m)
            break
    for combo, often in _greedy(dict(plan.left), capacity):
        place(combo, often)
    return plan


def numbered(items: DataFrame, keys: list[str], order: list[str], buckets: int = 64) -> DataFrame:
    """items with ``number``, from 0 within equal keys; a hot key is numbered in buckets whose sizes are added up."""
    salted = items.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = salted.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return salted.withColumn("_own", own).join(offsets, [*keys, "_bucket"]).withColumn("number", F.col("_own") + F.col("_offset")).drop("_own", "_offset", "_bucket")


def pack(sizes: DataFrame, capacity: int, window: int = WINDOW) -> DataFrame:
    """(container, doc_id, part, tokens) for sizes (doc_id, tokens): every item of at most capacity whole in one container."""
    items = sizes.where("tokens > 0")
    whole = items.select("doc_id", F.lit(0).alias("part"), "tokens").where(F.col("tokens") <= capacity)
    over = items.where(F.col("tokens") > capacity)
    full = over.select("doc_id", F.explode(F.sequence(F.lit(0), F.expr(f"cast(tokens div {capacity} as int)") - 1)).alias("part"), F.lit(capacity).cast("long").alias("tokens"))
    rest = over.where(F.col("tokens") % capacity > 0).select("doc_id", F.expr(f"cast(tokens div {capacity} as int)").alias("part"), (F.col("tokens") % capacity).alias("tokens"))
    every = whole.unionByName(full).unionByName(rest)
    histogram = {int(r[0]): int(r[1]) for r in every.groupBy("tokens").agg(F.count("*")).collect()}  # at most capacity rows
    plan = make_plan(histogram, capacity, window)
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 4)
    shared = sizes.sparkSession.sparkContext.broadcast(rows)  # at most capacity plans of at most sqrt(2 capacity) lengths

    def run(batches):
        plan_rows = shared.value
        big = int(plan_rows[:, 1].max(initial=0)) + 2
        keys = plan_rows[:, 0] * big + plan_rows[:, 1]
        for batch in batches:
            n, number = batch.column("tokens").to_numpy(), batch.column("number").to_numpy()
            at = np.searchsorted(keys, n * big + np.minimum(number, big - 1), "right") - 1
            container = plan_rows[at, 2] + (number - plan_rows[at, 1]) // plan_rows[at, 3]
            yield pa.RecordBatch.from_arrays([pa.array(container), batch.column("doc_id"), batch.column("part"), batch.column("tokens")], ["container", "doc_id", "part", "tokens"])

    return numbered(every, ["tokens"], ["doc_id", "part"], 1 + max(histogram.values(), default=0) // BUCKET_ROWS).select("doc_id", "part", "tokens", F.col("number").cast("long").alias("number")).mapInArrow(run, "container long, doc_id long, part int, tokens long")


def pack_texts(docs: DataFrame, capacities: list[int], folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(capacity, container, doc_id, part, tokens): the packing of the texts of docs for each capacity."""
    sizes = counted(docs, folder, vocabulary).persist()
    out = None
    for capacity in capacities:
        one = pack(sizes, capacity).select(F.lit(capacity).alias("capacity"), "container", "doc_id", "part", "tokens")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no capacity given")
    return out
