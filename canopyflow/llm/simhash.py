"""SimHash near-duplicates, found by multi-index hashing.

A fingerprint has two 32-bit segments.  Fingerprints at three or fewer differing
bits agree in one of the segments but for at most one bit, so each segment is
looked up with its Hamming ball of radius one and every match is verified over
all 64 bits.  Two values one bit apart differ in parity, so only those of odd
parity enumerate their ball.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow.llm.common import ids_of, stored, utf8
from canopyflow.llm.linked import components

SEED = 42
MAX_BITS = 3
#: Fingerprints compared with each other in one step.
BLOCK = 1024


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text, 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    n = words_per_shingle
    shingles = map(b" ".join, zip(*(words[k:] for k in range(n)))) if len(words) >= n else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 32_768):
        ones += np.unpackbits(hashes[at:at + 32_768], axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits).  Null or blank text: 0."""

    def hashed(batches):
        for batch in batches:
            flat, offsets = utf8(batch.column(1))
            flat = flat.tobytes()
            found = np.array([fingerprint(flat[a:b], words_per_shingle) for a, b in zip(offsets[:-1], offsets[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(hashed, "doc_id long, fp long")


def _lowest_linked(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric closeness matrix, the first row connected with it."""
    label = np.arange(len(near))
    while True:
        lower = np.where(near, label[None, :], len(near)).min(1)
        lower = np.minimum(lower, label)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def bucket_links(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever pairs of distinct ``fps`` within ``max_bits`` connect.

    Not all pairs are listed: a block gives each fingerprint one link at most, so
    a dense bucket stays small.  Buckets beyond one block are split by each of
    four 16-bit parts, one of which is equal in any pair that counts.
    """
    if len(fps) <= BLOCK:
        first = _lowest_linked(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits)
        rest = first != np.arange(len(fps))
        return [(fps[rest], fps[first[rest]])]
    out = []
    for part in range(4):
        value = fps >> np.uint64(16 * part) & np.uint64(0xFFFF)
        order = np.argsort(value, kind="stable")
        edges = np.flatnonzero(np.diff(value[order])) + 1
        for own in np.split(fps[order], edges):
            if 2 <= len(own) <= BLOCK:
                out += bucket_links(own, max_bits)
            elif len(own) > BLOCK:
                for i in range(0, len(own), BLOCK // 2):
                    for j in range(i, len(own), BLOCK // 2):
                        pair = np.concatenate([own[i:i + BLOCK // 2], own[j:j + BLOCK // 2]]) if j > i else own[i:i + BLOCK // 2]
                        out += bucket_links(pair, max_bits)
    return out


def _match(batches):
    """Links of each bucket from rows that come sorted by bucket."""
    kept_bucket, kept_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(bucket, fp):
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
        length = np.diff(np.r_[start, len(bucket)])
        two = start[length == 2]
        a, b = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
        close = (np.bitwise_count(a ^ b) <= MAX_BITS) & (a != b)
        found = [(a[close], b[close])]
        for s, n in zip(start[length > 2], length[length > 2]):
            found += bucket_links(np.unique(fp[s:s + n]).view(np.uint64))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        bucket = np.concatenate([kept_bucket, batch.column(0).to_numpy()])
        fp = np.concatenate([kept_fp, batch.column(1).to_numpy()])
        if not len(bucket):
            continue
        last = int(np.searchsorted(bucket, bucket[-1], "left"))
        kept_bucket, kept_fp = bucket[last:], fp[last:]
        yield links(bucket[:last], fp[:last])
    yield links(kept_bucket, kept_fp)


def links_of(fps: DataFrame) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints of ``fps(fp)`` at three or fewer differing bits."""
    halves = fps.select("fp", F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("part"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("half")),
        F.struct(F.lit(1).cast("long").alias("part"), F.shiftrightunsigned("fp", 32).alias("half")))).alias("s")).select("fp", "s.*")
    ball = F.expr("""concat(array(half), if(bit_count(half) % 2 = 1,
        transform(sequence(0, 31), k -> half ^ shiftleft(1L, k)), cast(array() as array<bigint>)))""")
    looked_up = halves.select(F.explode(ball).alias("value"), "part", "fp").select(
        (F.shiftleft("part", 32) + F.col("value")).alias("bucket"), "fp")
    return (looked_up.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(_match, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Words are split at ASCII white space after lower-casing A-Z; fewer words than
    a shingle make one shingle, none give fingerprint zero, linked like any
    other.  ``component_id`` is the smallest doc_id reachable over links of three
    or fewer differing bits.  A null doc_id stays null and is never the smallest;
    repeated rows are all returned; extra columns are not read.
    """
    hashed = stored(fingerprints(docs, words_per_shingle), "fingerprints")
    distinct = stored(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    label = components(links_of(distinct))
    of = distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "least")
    lowest = of.groupBy("label").agg(F.min("least").alias("component_id"))
    named = stored(stored(of, "labelled").join(lowest, "label").select("fp", "component_id"), "named")
    return hashed.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
