"""SimHash fingerprints and exact near-duplicate components, candidates pruned by pigeonring filtering.

A fingerprint is 64 bits on a ring of 16 segments of 4 bits. If two fingerprints differ in at most
d = 2 bits, then from some segment on every chain of l consecutive segments has at most
floor(l * d / 16) differences: none in the first 7, at most one in the first 15, at most two in all.
So each fingerprint is filed 16 times, turned so that a chain starts on top, by its first 7 segments
(28 bits); within a bucket the longer chains are held to their budgets, then the whole distance.

Equal fingerprints are one node. A bucket of more than `hot` fingerprints isn't paired: its members
name the 65 points within one bit of them instead, and all that share a point are linked through
its smallest. Two fingerprints are within two bits iff they share such a point, so nothing is lost,
and no group has more than 65 members.

Null texts and texts without words have fingerprint zero and are linked like any other. Rows with a
null id get a fingerprint and the component of their group; repeated rows stay repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidelog.llm.common import map_batches, only, written
from tidelog.llm.graph import components

SEED = 42
SEGMENTS, DISTANCE = 16, 2
HOT_BUCKET = 48
#: Texts of more bytes than this are worked through a block of words at a time.
BLOCK_BYTES, BLOCK_WORDS = 8 << 20, 200_000
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _word_blocks(data: bytes, size: int) -> Iterator[list[bytes]]:
    """Blocks of words, each starting with the last size - 1 words of the one before."""
    if len(data) <= BLOCK_BYTES:
        yield data.split()
        return
    found, kept = WORD.finditer(data), []
    while more := [m[0] for m in islice(found, BLOCK_WORDS)]:
        yield kept + more
        kept = (kept + more)[1 - size :] if size > 1 else []


def _bit_counts(words: list[bytes], size: int) -> tuple[np.ndarray, int]:
    n = max(1, len(words) - size + 1)
    line = b" ".join(words)
    if len(words) <= size:
        hashes = [xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: n - 1])).tolist()
        hashes = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64), n


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the word shingles, as an unsigned number."""
    data = (text or "").encode("utf-8").lower()  # bytes: A-Z only
    total, n = np.zeros(64, np.int64), 0
    for words in _word_blocks(data, size):
        if words and not (n and len(words) < size):
            counts, k = _bit_counts(words, size)
            total, n = total + counts, n + k
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each whole text, as a signed long."""
    docs = only(docs, id_col, text_col)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=[id_col, "fp"])

    return map_batches(docs, run, f"`{id_col}` {docs.schema[0].dataType.simpleString()}, fp long")


def links(fps: DataFrame, hot: int = HOT_BUCKET) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of the distinct fingerprints within DISTANCE bits.

    Pairs from buckets of up to `hot` members are all there; those of larger buckets are joined through shared points.
    """
    width = 64 // SEGMENTS
    exact = (SEGMENTS - 1) // DISTANCE  # the longest chain with budget zero
    turns = [
        F.struct(
            F.lit(t).alias("t"),
            (F.shiftleft("fp", width * t).bitwiseOR(F.shiftrightunsigned("fp", 64 - width * t)) if t else F.col("fp")).alias("r"),
        )
        for t in range(SEGMENTS)
    ]
    filed = fps.select("fp", F.explode(F.array(*turns)).alias("x")).select(
        (F.shiftrightunsigned("x.r", 64 - width * exact) * SEGMENTS + F.col("x.t")).alias("k"), F.col("x.r").alias("r"), "fp"
    )
    shared = filed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k").alias("k2"), "n")
    live = filed.join(shared, F.col("k") == F.col("k2")).select("k", "r", "fp", "n")
    live = written(live, "buckets")
    few = live.where(F.col("n") <= hot)
    other = few.select(F.col("k").alias("k2"), F.col("r").alias("r2"), F.col("fp").alias("b"))
    x = F.col("r").bitwiseXOR(F.col("r2"))
    chains = F.lit(True)
    for spent in range(1, DISTANCE):  # the longest chain of each further budget
        longest = ((spent + 1) * SEGMENTS - 1) // DISTANCE
        chains = chains & (F.bit_count(F.shiftrightunsigned(x, 64 - width * longest)) <= spent)
    close = chains & (F.bit_count(x) <= DISTANCE)
    pairs = few.join(other, (F.col("k") == F.col("k2")) & (F.col("fp") > F.col("b")) & close)
    pairs = pairs.select(F.col("fp").alias("a"), "b")

    points = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    near = live.where(F.col("n") > hot).select("fp").distinct().select("fp", F.explode(points).alias("point"))
    meet = near.groupBy("point").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = meet.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a != b")
    return pairs.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id that can be reached by links, the row's own included."""
    fps = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min(f"`{id_col}`").alias("least")), "nodes")
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", F.col("root").alias("r")).join(linked, F.col("r") == F.col("root"))
    named = named.select(F.col("fp").alias("f"), "component_id")
    return fps.join(named, F.col("fp") == F.col("f")).select(id_col, "fp", "component_id")
