"""Mixing sources to target weights by Pfair scheduling of source blocks."""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OTHER = "*"
PERIOD = 1000
BLOCK_ROWS = 64
#: Target weights of the query over ``documents``; sources that are not named share OTHER.
TARGETS = {f"src{k}": 1.0 / (k + 2) for k in range(20)} | {OTHER: 0.05}
_LEAST_BUCKET = 1024
#: Blocks of a source in one row of the schedule.
_RUN = 256


def quotas(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of each source in a period: at least one each, in all exactly ``period``, by largest remainders."""
    if len(weights) > period or any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive, and no more of them than slots in a period")
    total = sum(weights.values())
    exact = {s: w / total * (period - len(weights)) for s, w in weights.items()}
    share = {s: 1 + math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s))[: period - sum(share.values())]:
        share[s] += 1
    return share


def edf_period(share: dict[str, int], period: int) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period.

    Block k (from 0) of a source with q slots is released at floor(k * period / q) and due at
    ceil((k + 1) * period / q). The earliest deadline goes first among released blocks. As the quotas fill the
    period, every block runs within its window, so a source never strays a whole block from its target.
    """
    releases = sorted((k * period // q, -(-(k + 1) * period // q), s, k) for s, q in share.items() for k in range(q))
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [0] * q for s, q in share.items()}
    at = 0
    for slot in range(period):
        while at < len(releases) and releases[at][0] <= slot:
            _, due, s, k = releases[at]
            heapq.heappush(ready, (due, s, k))
            at += 1
        due, s, k = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        slots[s][k] = slot
    return slots


def exact(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers of exactly the same proportions, in lowest terms."""
    if any(not (w > 0 and math.isfinite(w)) for w in weights.values()):
        raise ValueError("weights must be positive")
    whole = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in whole.values()))
    own = {s: int(w * scale) for s, w in whole.items()}
    part = math.gcd(*own.values())
    return {s: n // part for s, n in own.items()}


def edf(weights: dict[str, float]) -> Iterator[str]:
    """The source of each slot, without end.

    Block k (from 0) of a source with the share w of all weights is released at floor(k / w) and due at
    ceil((k + 1) / w), in exact arithmetic; the earliest deadline goes first among released blocks. So each source is
    less than one block from its target weight after any number of slots.
    """
    share = exact(weights)
    total = sum(share.values())
    ready: list[tuple[int, str, int]] = []
    later = [(0, s, 0) for s in sorted(share)]
    slot = 0
    while True:
        while later and later[0][0] <= slot:
            _, s, k = heapq.heappop(later)
            heapq.heappush(ready, (-(-(k + 1) * total // share[s]), s, k))
        due, s, k = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        heapq.heappush(later, ((k + 1) * total // share[s], s, k + 1))
        yield s
        slot += 1


def phases(weights: dict[str, float], blocks: dict[str, int], period: int = PERIOD) -> dict[str, list[dict]]:
    """By source: for each phase its number, first block, blocks, quota, first slot and slots of one period.

    In a phase all its sources have blocks left and follow their exact weights; when one runs dry the rest share its
    weight, so no block is ever left out. A phase is one period, however long: ``slots`` has a number for each block.
    Where ``period`` is a multiple of the sum of the whole weights, quotas are exact and one period of slots is
    repeated instead.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    plan: dict[str, list[dict]] = {s: [] for s in left}
    done = dict.fromkeys(left, 0)
    base = number = 0
    while left:
        whole = exact({s: weights[s] for s in left})
        total = sum(whole.values())
        cycle: list[str] = list(itertools.islice(edf(whole), period)) if period % total == 0 else []
        rest, slots, length = dict(left), {s: [] for s in left}, 0
        for s in itertools.cycle(cycle) if cycle else edf(whole):
            slots[s].append(length)
            rest[s] -= 1
            length += 1
            if not rest[s]:
                break
        for s, own in slots.items():
            q = whole[s] * (period // total) if cycle else max(1, len(own))
            plan[s].append({"phase": number, "first": done[s], "n": len(own), "q": q, "base": base, "slots": own[:q]})
            done[s] += len(own)
        left = {s: n for s, n in rest.items() if n > 0}
        base += length
        number += 1
    return plan


def _schedule(plan: dict[str, list[dict]], period: int) -> pa.Table:
    """Phases and slots of the blocks of each source, _RUN of them a row."""
    rows = []
    for s, own in plan.items():
        phase = np.repeat(np.asarray([p["phase"] for p in own], np.int32), [p["n"] for p in own])
        slot = np.concatenate([np.empty(0, np.int64), *(p["base"] + np.arange(p["n"]) // p["q"] * period + np.resize(np.asarray(p["slots"], np.int64), p["n"]) for p in own)])
        rows += [(s, k // _RUN, phase[k : k + _RUN], slot[k : k + _RUN]) for k in range(0, len(slot), _RUN)]
    kinds = {"__s": pa.string(), "__c": pa.int64(), "__phases": pa.list_(pa.int32()), "__slots": pa.list_(pa.int64())}
    return pa.table({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(kinds.items())})


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD, seed: int = 0, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """docs with their place in the mix: mix_source, block, phase, slot and position (all rows, in no order).

    Rows of a source are put in an order by hash (seed, id, source), cut into blocks of ``block_rows``, and block
    slots come from the schedule; sorting by position gives the mix. A null source, or one without a weight, counts
    as OTHER, which has the weight 1 % of the named ones if none is given. Rows alike in id and source are
    interchangeable; an empty table stays empty; input columns with the names of the new ones are replaced.

    Ranks are counted in hash buckets of about the root of the row count, so a source that holds most rows is
    spread over many tasks. Rows without an id go to buckets by all their other columns (maps apart), so that a source
    with many of them is spread too, unless they are alike in everything. One row for each weight goes to the driver; back comes the schedule, as a
    broadcast of two numbers a block (not a row).
    """
    spark = docs.sparkSession
    targets = dict(TARGETS if weights is None else weights)
    targets.setdefault(OTHER, 0.01 * sum(targets.values()))
    new = ("mix_source", "block", "phase", "slot", "position")
    keep = [c for c in docs.columns if c not in new]
    named = F.col(source_col).cast("string")
    others = [f.name for f in docs.schema if f.name in keep and f.name != id_col and "map<" not in f.dataType.simpleString()]
    by_id = F.xxhash64(F.lit(seed), F.col(id_col), named)
    whole = F.when(F.col(id_col).isNull(), F.xxhash64(by_id, *others)).otherwise(by_id)
    hashed = docs.select(*keep, F.when(named.isin(*[s for s in targets if s != OTHER]), named).otherwise(OTHER).alias("__s"), by_id.alias("__h"), whole.alias("__g"))
    rows = docs.select(F.count(F.lit(1))).first()[0]
    buckets = max(1, rows // max(_LEAST_BUCKET, math.isqrt(rows)))
    hashed = hashed.withColumn("__b", F.pmod(F.col("__g"), F.lit(buckets)).cast("int"))
    sizes = hashed.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__s", "__b", (F.sum("__n").over(Window.partitionBy("__s").orderBy("__b")) - F.col("__n")).alias("__before"))
    totals = {r["__s"]: r["n"] for r in sizes.groupBy("__s").agg(F.sum("__n").alias("n")).collect()}  # one row a weight
    plan = phases({s: targets[s] for s in totals}, {s: -(-n // block_rows) for s, n in totals.items()}, period)
    schedule = spark.createDataFrame(_schedule(plan, period))
    ranked = hashed.withColumn("__k", F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__h", id_col, "__g")) - 1)
    ranked = ranked.join(before, ["__s", "__b"]).withColumn("__r", F.col("__before") + F.col("__k"))
    placed = ranked.withColumn("__j", F.floor(F.col("__r") / block_rows)).withColumn("__c", F.floor(F.col("__j") / _RUN)).join(F.broadcast(schedule), ["__s", "__c"])
    own = lambda c: F.get(c, (F.col("__j") % _RUN).cast("int"))
    placed = placed.select(*keep, "__s", "__j", "__r", own("__phases").alias("__phase"), own("__slots").alias("__slot"))
    return placed.select(
        *keep, F.col("__s").alias("mix_source"), F.col("__j").alias("block"), F.col("__phase").alias("phase"),
        F.col("__slot").alias("slot"), (F.col("__slot") * block_rows + F.col("__r") % block_rows).alias("position"),
    )
