"""N-gram Jaccard join by a token-group matrix, and the components of its links."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Ids that are broadcast at most, to pick texts; more are shuffled.
MOST_BROADCAST = 500_000
#: Cells in which shingles are counted to find the common ones (by their first bits), and cells in a row of counts.
CELL_BITS, CHUNK = 22, 1 << 16
#: Prefix shingles in a row of the packed exchange and in one of its buckets (about), and nodes in a block of a group.
PACKED, BLOCK = 1 << 20, 1024
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_power = (np.empty(0, np.uint64), np.empty(0, np.uint64))
_GOLD, _MUL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _stir(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x * _GOLD
    x = (x ^ (x >> np.uint64(29))) * _MUL
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base and of its inverse, n at least."""
    global _power
    if len(_power[0]) < n:
        size = 1 << max(14, n.bit_length())
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _power = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _power


def tokens(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``width``-word shingles of a text, A-Z lower-cased.

    Fewer words are one shingle, none give none. A word's hash is a polynomial in its bytes, from running sums over
    the whole text.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers(len(raw))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)))
    hashed = _stir((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    take = min(width, len(hashed))
    made = np.full(len(hashed) - take + 1, take, np.uint64)
    for k in range(take):
        made = _stir(made + hashed[k : len(hashed) - take + 1 + k])
    return np.unique(made)


def least_overlap(n: int, percent: int) -> int:
    """Elements that a set of n shares at least with any set that it links with."""
    return -(-percent * n // 100)


def least_shared(n: int, percent: int) -> int:
    """Prefix elements that two linked sets of n or more elements share at least."""
    return 1 + n * (100 - percent) // 200


def prefix(own: np.ndarray, percent: int, rank: np.ndarray) -> np.ndarray:
    """The first elements of a set in the common order: by how common their cell is, then by value.

    A set of n shares at least ``least_overlap(n)`` elements with a linked one, so each of the two has all but
    ``n - least_overlap(n)`` of its own in common. With ``least_shared(n)`` elements more than those it can differ in,
    the prefixes of two linked sets share as many as the smaller one's ``least_shared``, whatever the order is.
    """
    n = len(own)
    if n < -(-percent // (100 - percent)):  # smaller sets have no partner but themselves
        return np.empty(0, np.int64)
    order = np.argsort(rank[(own >> np.uint64(64 - CELL_BITS)).astype(np.int64)], kind="stable")
    return own[order[: n - least_overlap(n, percent) + least_shared(n, percent)]].view(np.int64)


def _digest(own: np.ndarray) -> bytes | None:
    return hashlib.md5(own.tobytes()).digest() if len(own) else None


def _bits(own: np.ndarray) -> bytes:
    """A bit for each element, in as many as the size of the set, as a power of two of 64 at least.

    Sets differ in no fewer elements than their bits do, whatever elements share a bit.
    """
    size = max(64, 1 << max(0, len(own) - 1).bit_length())
    out = np.zeros(size, np.uint8)
    out[(own & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _node(digest: Column) -> Column:
    """The first 60 bits of a digest. Sets that share them are candidates together; whole digests tell them apart."""
    return F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("bigint")


def components(edges: DataFrame) -> DataFrame:
    """node -> root, one node of its component, for all nodes with links (a, b).

    Each round puts the nodes in order of their links, most first and equals at random, hangs every node on the first
    of its neighbours and itself, then on that one's, and contracts the links. What is left are nodes that come before
    all their neighbours, and as these have no more links each, they are no fewer: at least half of the nodes goes each
    time, and of a star all but one. A round is a few pre-aggregated shuffles; its result is kept in the shared folder
    and replaces the last one's.
    """
    scratch = Scratch(edges.sparkSession)
    left = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = scratch.keep(both.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    turn = 0
    while not left.isEmpty():
        turn += 1
        place = lambda n, c: F.struct((-F.col(n)).alias("n"), F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        up = both.join(degree.select(F.col("a").alias("b"), "n"), "b").groupBy("a").agg(F.min(place("n", "b")).alias("first"), F.count(F.lit(1)).alias("own"))
        up = up.select(F.col("a").alias("x"), F.least(place("own", "a"), "first")["v"].alias("y"))
        jump = scratch.keep(up.join(up.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").select("x", "z"))
        moved = scratch.keep(roots.join(jump, roots["root"] == jump["x"], "left").select("node", F.coalesce("z", "root").alias("root")))
        ends = left.join(jump.select(F.col("x").alias("a"), F.col("z").alias("za")), "a").join(jump.select(F.col("x").alias("b"), F.col("z").alias("zb")), "b")
        fewer = scratch.keep(ends.where("za <> zb").select(F.least("za", "zb").alias("a"), F.greatest("za", "zb").alias("b")).distinct())
        scratch.drop(roots, jump, left)
        roots, left = moved, fewer
    scratch.drop(left)
    return roots


def _profiled(width: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Size and digest of each set; then the task's counts of all cells, CHUNK of them a row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << CELL_BITS, np.int32)
        for b in batches:
            sizes, digests, cells = [], [], []
            for text in b["text"]:
                own = tokens(text, width)
                sizes.append(len(own))
                digests.append(_digest(own))
                cells.append((own >> np.uint64(64 - CELL_BITS)).astype(np.int32))
            for lo in range(0, len(cells), 1000):
                at, n = np.unique(np.concatenate(cells[lo : lo + 1000]), return_counts=True)
                seen[at] += n.astype(np.int32)
            yield pd.DataFrame({"id": b["id"], "h": b["h"], "n": sizes, "digest": digests, "chunk": -1, "counts": None, "total": 0})
        if not seen.any():
            return
        for k, part in enumerate(seen.reshape(-1, CHUNK)):
            yield pd.DataFrame({"id": [None], "h": [0], "n": [0], "digest": [None], "chunk": [k], "counts": [zlib.compress(part.tobytes(), 1)], "total": [int(part.sum(dtype=np.int64))]})

    return run


def _classes(docs: DataFrame, width: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray, int]:
    """id, h, n (set size) and digest of each row, the rank of each cell, and the number of shingles of all rows.

    The rank orders shingles by how common their cell is: how far its count is over what chance gives an average one.
    It is one byte for each of a fixed number of cells.
    """
    every = scratch.keep(docs.mapInPandas(_profiled(width), "id string, h bigint, n bigint, digest binary, chunk int, counts binary, total bigint"))
    rank = np.zeros(1 << CELL_BITS, np.uint8)
    total = every.agg(F.sum("total")).first()[0] or 0
    mean = total / (1 << CELL_BITS)
    limit = mean + 6 * math.sqrt(mean) + 8

    def summed(parts: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(CHUNK, np.int64)
        for x in parts["counts"]:
            n += np.frombuffer(zlib.decompress(x), np.int32)
        often = np.flatnonzero(n >= limit)
        return pd.DataFrame({"cell": int(parts["chunk"].iloc[0]) * CHUNK + often, "n": n[often]})

    often = every.where("chunk >= 0").select("chunk", "counts").groupBy("chunk").applyInPandas(summed, "cell bigint, n bigint").toArrow()  # some of the cells
    rank[often["cell"].to_numpy()] = np.frexp((often["n"].to_numpy() - mean) / limit)[1].clip(-6, 60) + 8
    return every.where("chunk < 0").select("id", "h", "n", "digest"), rank, total


def _packed(width: int, percent: int, rank, buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Prefix shingles and nodes of texts, PACKED of them at a time, dealt to buckets by shingle.

    Of the nodes with the same shingle two go to its bucket; the others are shared for sure and go to any bucket, so
    a shingle that a great many texts have does not fill one.
    """
    def dealt(sigs: list[np.ndarray], nodes: list[int]) -> pd.DataFrame:
        node = np.repeat(np.asarray(nodes, np.int64), [len(s) for s in sigs])
        sig = _stir(np.concatenate(sigs).view(np.uint64))
        order = np.argsort(sig)
        sig, node = sig[order], node[order]
        bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        key = (sig & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        sure = np.concatenate((np.zeros(min(2, len(sig)), bool), sig[2:] == sig[:-2]))
        rows = []
        edges = np.searchsorted(bucket[~sure], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edges)):
            rows.append((int(k), False, key[~sure][edges[k] : edges[k + 1]].tobytes(), node[~sure][edges[k] : edges[k + 1]].tobytes()))
        whole = bucket[sure] << 32 | key[sure].astype(np.int64)
        for k in range(0, len(whole), PACKED // 64):
            rows.append((int(node[sure][k] % buckets), True, whole[k : k + PACKED // 64].tobytes(), node[sure][k : k + PACKED // 64].tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "sure", "sigs", "nodes"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, sigs, held = {}, [], 0
        for b in batches:
            for text in b["text"]:
                own = tokens(text, width)
                first = prefix(own, percent, rank.value)
                node = int.from_bytes(_digest(own)[:8], "big") >> 4 if len(first) else -1
                if len(first) and node not in seen:
                    seen[node] = len(sigs)
                    sigs.append(first)
                    held += len(first)
                if held >= PACKED:
                    yield dealt(sigs, list(seen))
                    seen, sigs, held = {}, [], 0
        if sigs:
            yield dealt(sigs, list(seen))

    return run


def _several(rows: pd.DataFrame) -> pd.DataFrame:
    """(sig, node) of the shingles of a bucket that several nodes have, and of those that came as shared."""
    key, node, whole, more = [], [], [], []
    for bucket, sure, s, n in zip(rows["bucket"], rows["sure"], rows["sigs"], rows["nodes"], strict=True):
        (whole if sure else key).append(np.frombuffer(s, np.int64) if sure else (bucket << 32) + np.frombuffer(s, np.uint32).astype(np.int64))
        (more if sure else node).append(np.frombuffer(n, np.int64))
    if key:
        k, n = np.concatenate(key), np.concatenate(node)
        order = np.lexsort((n, k))
        k, n = k[order], n[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])))
        k, n = k[new], n[new]
        again = k[1:] == k[:-1]
        shared = np.concatenate((again, [False])) | np.concatenate(([False], again))
        whole.append(k[shared])
        more.append(n[shared])
    return pd.DataFrame({"sig": np.concatenate(whole), "node": np.concatenate(more)})


def _shared_tokens(docs: DataFrame, width: int, percent: int, rank: np.ndarray, total: int) -> DataFrame:
    """(sig, node) of the prefix shingles that more than one node has."""
    spark = docs.sparkSession
    share = (100 - percent) * 3 / 200
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * share) // PACKED + 1)
    made = docs.select("text").mapInPandas(_packed(width, percent, spark.sparkContext.broadcast(rank), buckets), "bucket bigint, sure boolean, sigs binary, nodes binary")
    return made.groupBy("bucket").applyInPandas(_several, "sig bigint, node bigint").distinct()


def _token_sets(docs: DataFrame, wanted: DataFrame, classes: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """digest, node, n, w (rows with the set), tokens and bits of the sets of wanted nodes, each from one document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [tokens(t, width) for t in b["text"]]
            yield pd.DataFrame({"digest": [_digest(t) for t in made], "tokens": [t.view(np.int64) for t in made], "bits": [_bits(t) for t in made]})

    few = classes.where("n > 0").groupBy("digest").agg(F.min("id").alias("label"), F.first("n").alias("n"), F.count(F.lit(1)).alias("w"))
    few = scratch.keep(few.withColumn("node", _node(F.col("digest"))).join(wanted, "node", "left_semi"))
    ids = few.select("label").distinct()
    ids = F.broadcast(ids) if few.count() <= MOST_BROADCAST else ids
    texts = docs.join(ids, docs["id"].eqNullSafe(F.col("label")), "left_semi")
    made = texts.select("text").mapInPandas(run, "digest binary, tokens array<bigint>, bits binary")
    sets = made.groupBy("digest").agg(F.first("tokens").alias("tokens"), F.first("bits").alias("bits")).join(few.drop("label"), "digest")
    sets = scratch.keep(sets)
    scratch.drop(few)
    return sets


def _opened(docs: DataFrame, width: int, percent: int, classes: DataFrame, rank: np.ndarray, total: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets and the groups to open for them: leader, digest, n, w, member, a, more, less; the token sets; the leaders'.

    Groups: each node that shares a prefix shingle goes to the group of the leader it shares most of them with; the
    leader of a shingle is the node most of whose shingles are shared. The matrix has, for each group, the union of
    its members' prefix shingles. A query (every such node) and a group qualify if this union holds as many of the
    query's shingles as it shares with any set it links with. ``more`` is how many the set has that the leader lacks,
    ``less`` the contrary; ``a`` is positive by as much as the set is nearer to the leader than half the limit.
    """
    need = 1 + F.floor(F.floor((F.col("n") * percent + 99) / 100) * (100 - percent) / 200)
    shared = scratch.keep(_shared_tokens(docs, width, percent, rank, total))
    sizes = classes.where("n > 0").select(_node(F.col("digest")).alias("node"), "n").groupBy("node").agg(F.min("n").alias("n"))
    for _ in range(2):  # a node with fewer shared shingles than any link needs has none, nor do its shingles count for others
        able = shared.groupBy("node").agg(F.count(F.lit(1)).alias("k")).join(sizes, "node").where(F.col("k") >= need).select("node")
        some = shared.join(able, "node", "left_semi")
        several = some.groupBy("sig").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("sig")
        fewer = scratch.keep(some.join(several, "sig", "left_semi"))
        scratch.drop(shared)
        shared = fewer
    counted = shared.groupBy("node").agg(F.count(F.lit(1)).alias("c")).join(sizes, "node").select("node", (F.col("c") / F.col("n")).alias("central"))
    led = shared.join(counted, "node").groupBy("sig").agg(F.max(F.struct("central", (-F.col("node")).alias("minus"))).alias("top")).select("sig", (-F.col("top.minus")).alias("leader"))
    home = shared.join(led, "sig").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("k"))
    home = scratch.keep(home.groupBy("node").agg(F.max(F.struct("k", (-F.col("leader")).alias("minus"))).alias("top")).select("node", (-F.col("top.minus")).alias("home")))
    matrix = shared.join(home, "node").select("sig", F.col("home").alias("leader")).distinct()
    found = shared.join(matrix, "sig").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("k"))
    opened = found.join(sizes, "node").where(F.col("k") >= need).select("node", "leader")
    opened = scratch.keep(opened.unionAll(home.select("node", F.col("home").alias("leader"))).distinct())
    wanted = opened.select("node").unionAll(opened.select(F.col("leader").alias("node"))).distinct()
    sets = _token_sets(docs, wanted, classes, width, scratch)
    first = sets.groupBy("node").agg(F.min("digest").alias("first")).join(opened.select(F.col("leader").alias("node")).distinct(), "node", "left_semi")
    lead = scratch.keep(sets.join(first, "node").where("digest = first").select(F.col("node").alias("leader"), F.col("tokens").alias("lt")))
    each = opened.join(home, "node").join(sets, "node").join(lead, "leader").withColumn("same", F.size(F.array_intersect("tokens", "lt")))
    a = (100 - percent) * F.col("n") - (100 + percent) * (F.size("tokens") + F.size("lt") - 2 * F.col("same"))
    each = scratch.keep(each.select("leader", "digest", "n", "w", (F.col("home") == F.col("leader")).alias("member"), a.alias("a"), (F.size("tokens") - F.col("same")).alias("more"), (F.size("lt") - F.col("same")).alias("less")))
    scratch.drop(shared, home, opened)
    return each, sets, lead


def _block_pairs(opened: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """What to compare: leader, block of queries, block of members, query, digest, n, w, a; and the tables it is read from.

    Two sets with a_q + a_m >= 0 link for sure. Blocks hold about BLOCK sets of a group with similar ``a``, so only
    those pairs of blocks are made that hold a pair which is not sure. A set is left out where no other of the group
    has enough that the leader lacks: of what it has beyond the leader it must share all but what it can differ in.
    Sets and pairs of blocks are kept, as each is used several times: one plan of it all has each of them as often.
    """
    differ = opened.withColumn("d", F.col("more") + F.col("less")).where("d > 0")
    # a pair needs 2 * (100 + percent) * overlap >= -(a + a'), and no set overlaps by more than its own difference
    reach = 2 * (100 + percent) * F.col("d") + F.col("a")
    top = differ.groupBy("leader").agg(F.min("a").alias("low"), F.max("a").alias("high"), F.max(F.struct("more", "digest")).alias("top"))
    near = differ.join(top, "leader")
    next_most = near.where("digest <> top.digest").groupBy("leader").agg(F.max("more").alias("second"))
    near = near.join(next_most, "leader").withColumn("others", F.when(F.col("digest") == F.col("top.digest"), F.col("second")).otherwise(F.col("top.more")))
    fits = (F.col("a") + F.col("low") < 0) & (reach + F.col("high") >= 0) & (F.col("others") >= F.col("more") - F.floor(F.col("n") * (100 - percent) / 100))
    unsure = scratch.keep(near.where(fits).select("leader", "digest", "n", "w", "member", "a"))

    def blocked(rows: DataFrame) -> DataFrame:
        """rows with their block: sets in order of a; equal values are dealt by digest where they are many."""
        sizes = rows.groupBy("leader", "a").agg(F.count(F.lit(1)).alias("c"))
        before = F.sum("c").over(Window.partitionBy("leader").orderBy("a")) - F.col("c")
        sizes = sizes.select("leader", "a", F.floor(before / BLOCK).alias("first"), F.ceil(F.col("c") / BLOCK).alias("span"))
        return rows.join(sizes, ["leader", "a"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("digest"), F.col("span"))).drop("first", "span")

    queries, members = scratch.keep(blocked(unsure)), scratch.keep(blocked(unsure.where("member")))
    scratch.drop(unsure)
    q = queries.groupBy("leader", "block").agg(F.min("a").alias("qa")).withColumnRenamed("block", "qb")
    m = members.groupBy("leader", "block").agg(F.min("a").alias("ma")).withColumnRenamed("block", "mb")
    pairs = scratch.keep(q.join(m, "leader").where("qa + ma < 0").select("leader", "qb", "mb"))
    cols = ["leader", "qb", "mb", "query", "digest", "n", "w", "a"]
    left = queries.withColumnRenamed("block", "qb").join(pairs, ["leader", "qb"]).withColumn("query", F.lit(True))
    right = members.withColumnRenamed("block", "mb").join(pairs, ["leader", "mb"]).withColumn("query", F.lit(False))
    return left.select(cols).unionAll(right.select(cols)), [queries, members, pairs]


def _postings(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(arrays) if arrays else np.empty(0, np.int64)), np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])


def _overlaps(q: list[np.ndarray], m: list[np.ndarray]) -> np.ndarray:
    """How many values each two arrays of q and m share."""
    t, row = _postings(q)
    u, col = _postings(m)
    out = np.zeros((len(q), len(m)), np.int32)
    order = np.argsort(u, kind="stable")
    u, col = u[order], col[order]
    lo, hi = np.searchsorted(u, t, "left"), np.searchsorted(u, t, "right")
    hit = np.flatnonzero(hi > lo)
    for part in np.split(hit, np.searchsorted(np.cumsum((hi - lo)[hit]), np.arange(1 << 22, int((hi - lo)[hit].sum()), 1 << 22))):
        n = (hi - lo)[part]
        ends = np.cumsum(n)
        at = np.repeat(lo[part] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        out += np.bincount(np.repeat(row[part], n) * len(m) + col[at], minlength=out.size).reshape(out.shape).astype(np.int32)
    return out


def _words(bits: list[bytes], size: int) -> np.ndarray:
    """Bits of several sets as rows of 64-bit words, folded to size bits."""
    rows = np.stack([np.frombuffer(b, np.uint64) for b in bits])
    while rows.shape[1] * 64 > size:
        half = rows.shape[1] // 2
        rows = rows[:, :half] | rows[:, half:]
    return rows


def _able(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The rows of two blocks that may have an unsure link with a row of the other: their bits do not differ too much."""
    q, m = rows[rows["query"]].reset_index(drop=True), rows[~rows["query"]].reset_index(drop=True)
    keep_q, keep_m = np.zeros(len(q), bool), np.zeros(len(m), bool)
    sizes = [x["bits"].map(len).to_numpy() * 8 for x in (q, m)]
    for sq in np.unique(sizes[0]):
        for sm in np.unique(sizes[1]):
            if max(sq, sm) > 2 * min(sq, sm):  # sets of so different sizes do not link
                continue
            i, j = np.flatnonzero(sizes[0] == sq), np.flatnonzero(sizes[1] == sm)
            wq, wm = _words(list(q["bits"].iloc[i]), min(sq, sm)), _words(list(m["bits"].iloc[j]), min(sq, sm))
            n, a, digest = m["n"].to_numpy()[j], m["a"].to_numpy()[j], m["digest"].to_numpy()[j]
            for k, own in zip(i, wq, strict=True):
                apart = np.bitwise_count(wm ^ own).sum(axis=1, dtype=np.int64)
                near = ((100 + percent) * apart <= (100 - percent) * (n + q["n"].iat[k])) & (a + q["a"].iat[k] < 0) & (digest != q["digest"].iat[k])
                keep_q[k] |= near.any()
                keep_m[j] |= near
    return pd.concat((q[keep_q], m[keep_m]))[["leader", "qb", "mb", "query", "digest", "n", "w", "a"]]


def _compare(rows: pd.DataFrame, percent: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, bytes]]]:
    """Links of the queries of two blocks that are not sure ones, counted, and a spanning part of them.

    The token union of the members' block bounds what a query can share with any of them; only queries that qualify
    are compared.
    """
    q, m = rows[rows["query"]], rows[~rows["query"]]
    if not len(q) or not len(m):
        return [], []
    union = np.unique(np.concatenate(list(m["more"])))
    more = list(q["more"])
    t, row = _postings(more)
    extra = np.bincount(row, np.isin(t, union), minlength=len(q)).astype(np.int64)
    size = np.asarray([len(x) for x in more])
    q = q[(q["n"].to_numpy() - size + extra) * 100 >= percent * q["n"].to_numpy()]
    if not len(q):
        return [], []
    over = _overlaps(list(q["more"]), list(m["more"])) + _overlaps(list(q["less"]), list(m["less"]))
    a = q["a"].to_numpy()[:, None] + m["a"].to_numpy()[None, :]
    qd, md = q["digest"].to_numpy(), m["digest"].to_numpy()
    at = {d: k for k, d in enumerate(md)}
    linked = (a < 0) & (a + 2 * (100 + percent) * over >= 0)
    for k, d in enumerate(qd):
        if (j := at.get(d)) is not None:
            linked[k, j] = False
    counts = linked @ m["w"].to_numpy()
    up = list(range(len(qd) + len(md)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    edges = []
    for i in np.flatnonzero(linked.any(axis=1)):
        for j in np.flatnonzero(linked[i]):
            if (x := top(i)) != (y := top(len(qd) + int(j))):
                up[x] = y
                edges.append((qd[i], md[j]))
    return [(d, int(c)) for d, c in zip(qd, counts, strict=True) if c], edges


def _by_key(work: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """work on the rows of each key (leader, qb, mb) of sorted rows; a key's rows may lie in several batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat((rest, b), ignore_index=True)
            key = b[["leader", "qb", "mb"]].to_numpy()
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))) if len(b) else np.empty(0, int)
            if len(new) > 1:
                yield pd.concat([work(b.iloc[lo:hi]) for lo, hi in zip(new[:-1], new[1:], strict=True)])
            rest = b.iloc[new[-1] :] if len(new) else None
        if rest is not None:
            yield work(rest)

    return run


def _compared(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def made(rows: pd.DataFrame) -> pd.DataFrame:
        counts, edges = _compare(rows, percent)
        return pd.DataFrame([(d, None, c) for d, c in counts] + [(x, y, 0) for x, y in edges], columns=["a", "b", "links"])

    return made


def _links(opened: DataFrame, sets: DataFrame, lead: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links of sets: how many rows other than its copies each set links with (digest, links), and edges (a, b) that span all links.

    Each pair of a query and a member is met once, in the member's own group. Sure links are counted from the
    members' values of ``a``, without the pairs, and all lead to the set of the group with the greatest ``a``; the
    others come from comparisons of blocks, first of a few bits of each set, then of what is left with whole sets.
    """
    value = F.col("a").alias("key")
    points = opened.where("member").groupBy("leader", value).agg(F.sum("w").alias("w")).unionAll(opened.select("leader", (-F.col("a")).alias("key")).distinct().withColumn("w", F.lit(0).cast("bigint")))
    points = points.groupBy("leader", "key").agg(F.sum("w").alias("w")).withColumn("w", F.sum("w").over(Window.partitionBy("leader").orderBy(F.desc("key"))))
    sure = opened.select("leader", "digest", "member", "w", "a", (-F.col("a")).alias("key")).join(points.withColumnRenamed("w", "links"), ["leader", "key"])
    sure = sure.select("digest", (F.col("links") - F.when(F.col("member") & (F.col("a") >= 0), F.col("w")).otherwise(0)).alias("links"))
    tops = opened.groupBy("leader").agg(F.max(F.struct("a", "digest")).alias("top"))
    star = opened.select("leader", "digest", "a").join(tops, "leader").where((F.col("a") + F.col("top.a") >= 0) & (F.col("digest") != F.col("top.digest"))).select(F.col("digest").alias("a"), F.col("top.digest").alias("b"))
    keys, parts = ["leader", "qb", "mb"], int(opened.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as the rows are few for the work they make
    pairs, read = _block_pairs(opened, percent, scratch)
    blocks = pairs.join(sets.select("digest", "bits"), "digest").repartition(parts, *keys).sortWithinPartitions(*keys)
    blocks = scratch.keep(blocks.select(*keys, "query", "digest", "n", "w", "a", "bits").mapInPandas(_by_key(lambda rows: _able(rows, percent)), "leader bigint, qb bigint, mb bigint, query boolean, digest binary, n bigint, w bigint, a bigint"))
    scratch.drop(*read)
    differ = blocks.select("leader", "digest").distinct().join(sets.select("digest", "tokens"), "digest").join(lead, "leader")
    differ = differ.select("leader", "digest", F.array_except("tokens", "lt").alias("more"), F.array_except("lt", "tokens").alias("less"))
    dealt = blocks.join(differ, ["leader", "digest"]).repartition(parts, *keys).sortWithinPartitions(*keys)
    compared = scratch.keep(dealt.mapInPandas(_by_key(_compared(percent)), "a binary, b binary, links bigint"))
    scratch.drop(blocks, sets, lead)
    edges = star.unionAll(compared.where("b is not null").select("a", "b"))
    counts = sure.where("links > 0").unionAll(compared.where("b is null").select(F.col("a").alias("digest"), "links")).groupBy("digest").agg(F.sum("links").alias("links"))
    return counts, edges


def _grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """id, h, n, digest and group (one for each component; null without shingles) of each row of docs (id, h, text), and the links of each digest."""
    if not 50 <= percent < 100:
        raise ValueError("percent must be from 50 to 99")
    scratch = Scratch(docs.sparkSession)
    classes, rank, total = _classes(docs, width, scratch)
    opened, sets, lead = _opened(docs, width, percent, classes, rank, total, scratch)
    counts, edges = _links(opened, sets, lead, percent, scratch)
    roots = components(edges)
    rows = classes.join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("id", "h", "n", "digest", F.when(F.col("n") > 0, F.coalesce("root", "digest")).alias("group"))
    return rows, counts


def join(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, component_id and n_links.

    Documents link when ``100 * intersection >= percent * union`` of their sets of ``width``-word shingles (words
    ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; fewer words are one shingle). component_id is the smallest id that
    links lead to, the document's own included; n_links is how many other rows the row links with. Null and blank
    texts have no shingles and link with nothing. Rows with a null id count for links, but not as ids. Rows repeat as
    they come; no rows, no result; other columns are not read. Equal sets are one node, so copies are never paired;
    sets are 64-bit hashes of shingles. Links of near copies are counted, but pairs are never rows.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]
    own = F.col("id").cast(kind)
    rows, counts = _grouped(docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")), width, percent)
    tops = rows.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(own).alias("top"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    copies = rows.where("n > 0").groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    linked = copies.join(counts, "digest", "full").select("digest", (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.join(tops, "group", "left").join(linked, "digest", "left")
    return out.select(own.alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("top", own).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one with the smallest id (null last), by text hash among equal ids.

    Texts without shingles all stay. Of rows alike in id and text one stays.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]
    scratch = Scratch(docs.sparkSession)
    rows, _ = _grouped(docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")), width, percent)
    rows = scratch.keep(rows.where(F.col("group").isNotNull()).select("group", F.struct(F.col("id").isNull().alias("none"), F.col("id").cast(kind).alias("id"), "h").alias("key")))
    first = rows.groupBy("group").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    several = scratch.keep(rows.join(first, "group").groupBy("key").agg(F.max(F.col("key") == F.col("first")).alias("stays"), F.count(F.lit(1)).alias("rows")))
    scratch.drop(rows)

    def held(keys: DataFrame, how: str, of: DataFrame) -> DataFrame:
        side = keys.select(F.col("key.id").alias("__kid"), F.col("key.h").alias("__kh"))
        side = F.broadcast(side) if keys.count() <= MOST_BROADCAST else side
        return of.join(side, of[id_col].eqNullSafe(F.col("__kid")) & (F.xxhash64(of[text_col]) == F.col("__kh")), how)

    kept = held(several.where("not stays"), "left_anti", docs)
    twins = several.where("stays and rows > 1")
    if twins.isEmpty():
        return kept
    alike = held(twins, "left_semi", kept).withColumn("__kh", F.xxhash64(text_col)).dropDuplicates([id_col, "__kh"]).drop("__kh")
    return held(twins, "left_anti", kept).unionByName(alike)
