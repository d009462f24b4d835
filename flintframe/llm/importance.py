"""Resampling of documents towards a target distribution by importance weights of hashed n-grams."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

BUCKETS, LONGEST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bits of a digit of the radix selection: a pass brings at most 2 ** DIGIT_BITS counts to the driver.
DIGIT_BITS = 12
#: Bytes of text that are taken apart at once (more where one text is longer), and the length from which a word is hashed alone.
PIECE, LONG = 1 << 22, 48

_byte = np.arange(256)
_LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
_IN_WORD = (_byte >= 0x80) | (_byte >= 0x30) & (_byte <= 0x39) | (_byte >= 0x61) & (_byte <= 0x7A)
_TABLE = _byte.astype(np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, _TABLE >> 1 ^ np.uint32(0xEDB88320), _TABLE >> 1)


def _crc(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of each span."""
    order = np.argsort(-length, kind="stable")
    state, start, length = state[order], start[order], length[order]
    alone = int(np.searchsorted(-length, -LONG))  # so many are longer
    for k in range(alone):
        state[k] = zlib.crc32(data[start[k] : start[k] + length[k]].tobytes(), int(state[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    state, start, left = state, start, length.copy()
    left[:alone] = 0
    n = len(left)
    for k in range(int(left.max(initial=0))):
        n = int(np.searchsorted(-left[alone:], -k)) + alone
        own = slice(alone, n)
        state[own] = _TABLE[(state[own] ^ data[start[own] + k]) & 255] ^ state[own] >> 8
    out = np.empty_like(state)
    out[order] = state
    return out


def _pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in pieces of about PIECE bytes: number of the first text, lower-cased bytes, offsets."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        yield at, _LOWER[data[offsets[at] : offsets[end]]], offsets[at : end + 1] - offsets[at]
        at = end


def hashed(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and bucket of each run of 1 to ``longest`` words, and the words of each text.

    data: bytes in which A-Z are lower-cased; the words of text t lie from offsets[t] to offsets[t + 1]. All separators
    are single bytes, so words are found in the bytes of all texts at once.
    """
    inside = _IN_WORD[data]
    before, after = np.append(False, inside[:-1])[: len(data)], np.append(inside[1:], False)[: len(data)]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    before[edges] = False
    after[edges - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    state = _crc(np.full(len(start), 0xFFFFFFFF, np.uint32), data, start, end - start)
    texts, crcs = [text], [state ^ np.uint32(0xFFFFFFFF)]
    for n in range(1, longest):
        state = state[: len(start) - n]
        state = _crc(_TABLE[(state ^ 0x20) & 255] ^ state >> 8, data, start[n:], (end - start)[n:])
        same = text[n:] == text[: len(start) - n]
        texts.append(text[n:][same])
        crcs.append((state ^ np.uint32(0xFFFFFFFF))[same])
    return np.concatenate(texts), np.concatenate(crcs).astype(np.int64) % buckets, np.bincount(text, minlength=len(offsets) - 1)


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all whole texts by bucket. A task sends on a count for each bucket, and as many sums reach the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in _pieces(batch.column(0)):
                seen += np.bincount(hashed(data, offsets, longest, buckets)[1], minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": seen[at]})

    found = texts.select(F.col(text_col).cast("string")).mapInArrow(counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket: a thousand times the log of how much likelier it is in the target, with one added to each count, floored."""
    size, s, t = len(own), int(own.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + size) / ((a + 1) * (t + size)))) for a, b in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST_RUN) -> DataFrame:
    """id, n_words, n_features and weight of each document: the floored mean of the gains of its features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, words, total = np.zeros((3, batch.num_rows), np.int64)
            for first, data, offsets in _pieces(batch.column(1)):
                text, bucket, said = hashed(data, offsets, longest, len(gain))
                own = slice(first, first + len(said))
                words[own], n[own] = said, np.bincount(text, minlength=len(said))
                np.add.at(total, first + text, gain[bucket])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], [id_col, "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A thousandfold draw from the standard Gumbel distribution, floored, that depends on the seed and the id only."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


_SIGN = -(1 << 63)


def kth(rows: DataFrame, parts: list[tuple[str, bool]], k: int, digit_bits: int = DIGIT_BITS) -> list[int] | None:
    """The k-th smallest key (from 1) of rows with whole numbers as key parts, each (column, whether greater comes first).

    A most significant digit first radix selection: a pass counts the rows that share the digits found so far by their
    next digit and settles it; digits in which least and greatest value of a part agree need no pass. It ends early
    where all rows that are left belong to the first k; the parts not settled then are as late as can be. So nothing is sorted and
    no pass brings more than 2 ** digit_bits counts to the driver. None if there are fewer than k rows, or k is 0.
    """
    ends = rows.agg(F.count(F.lit(1)), *[f(c) for c, _ in parts for f in (F.min, F.max)]).first()
    if not 0 < k <= ends[0]:
        return None
    key, left, same = [], k, ends[0]
    settled = F.lit(True)  # what the rows that are left have in common
    for p, (column, falling) in enumerate(parts):
        lo, hi = (x - _SIGN for x in ends[1 + 2 * p : 3 + 2 * p])  # as unsigned numbers, in the same order
        bits = (lo ^ hi).bit_length()
        found = lo >> bits << bits
        raised, prefix = F.col(column).bitwiseXOR(F.lit(_SIGN)), settled
        while bits and same > left:
            shift = max(0, bits - digit_bits)
            digit = F.shiftrightunsigned(raised, shift).bitwiseAND(F.lit((1 << (bits - shift)) - 1))
            counts = {r["digit"]: r["n"] for r in rows.where(prefix).groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()}
            for value in sorted(counts, reverse=falling):
                same = counts[value]
                if left <= same:
                    break
                left -= same
            found |= value << shift
            bits = shift
            if bits:
                prefix = settled & (F.shiftrightunsigned(raised, bits) == F.lit(found >> bits))
        if bits and not falling:  # all that share these digits are among the first k
            found |= (1 << bits) - 1
        key.append(found + _SIGN)
        settled &= F.col(column) == F.lit(key[-1])
        if same == left:
            return key + [_SIGN if late else -_SIGN - 1 for _, late in parts[p + 1 :]]
    return key


def upto(parts: list[tuple[str, bool]], key: list[int]) -> Column:
    """Whether a row's key comes no later than ``key``."""
    made = F.lit(True)
    for (c, falling), v in reversed(list(zip(parts, key, strict=True))):
        first = F.col(c) > F.lit(v) if falling else F.col(c) < F.lit(v)
        made = first | (F.col(c) == F.lit(v)) & made
    return made


def ranked(rows: DataFrame, parts: list[tuple[str, bool]]) -> DataFrame:
    """rows with ``rank``, their place (from 1) in the order of their keys: dealt by ranges of the key, sorted within, and numbered from where a range begins."""
    order = [F.col(c).desc() if falling else F.col(c).asc() for c, falling in parts]
    placed = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33).alias("__p")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))  # a row a range
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("__p", part).join(before, "__p").withColumn("rank", place).select(*rows.columns, "rank")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = LONGEST_RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """Every document's id, n_features, weight, score and rank: ``percent`` of those with ``least_words`` words are drawn without replacement.

    Weight: how much likelier the document's features are in the target than in all documents, on average, from counts
    of all whole texts by hash bucket. Score: weight plus Gumbel noise of the seed and the id, so that the highest
    scores are a sample by weight. Drawn ones have their rank, others null. Ids are whole numbers; ties go to the smaller one, a
    null id counts as the greatest; rows alike in score and id are drawn in the order in which they lie. Null and blank texts have no
    feature and weigh 0; very long texts count whole; without documents there are no rows, without a target all
    weights come from the documents alone; other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text_col, longest, buckets))
    made = weighed(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), gain, "__id", "__text", longest)
    made = made.withColumn("score", F.col("weight") + gumbel(F.col("__id"), seed)).withColumn("__key", F.coalesce("__id", F.lit((1 << 63) - 1))).withColumn("__row", F.monotonically_increasing_id())
    scored = durable(made)
    fit = F.col("n_words") >= least_words
    parts = [("score", True), ("__key", False), ("__row", False)]
    key = kth(scored.where(fit), parts, percent * scored.where(fit).count() // 100)
    out = [F.col("__id").alias(id_col), "n_features", "weight", "score"]
    if key is None:
        return scored.select(*out, F.lit(None).cast("bigint").alias("rank"))
    drawn = fit & upto(parts, key)
    first = ranked(scored.where(drawn), parts)
    return first.select(*out, "rank").unionByName(scored.where(~drawn).select(*out, F.lit(None).cast("bigint").alias("rank")))
