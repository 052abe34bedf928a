"""Near copies at a word-shingle similarity, by multi-index hashing of wide SimHashes.

Two texts whose sets of five-word shingles have a Jaccard similarity of 0.8 differ
in about 39 of 256 fingerprint bits (deviation 6), too many for the 64-bit form in
``simhash``, where three bits stand for all but equal texts.  Here twelve segments
of 20 bits are looked up: both sides enumerate their Hamming ball of radius one,
so fingerprints at two or fewer bits in any segment meet.  Pairs within
``MAX_BITS`` are candidates only; each is verified on the two shingle sets, and
those at ``SIMILARITY`` or more are linked.

By the binomial law a pair of long texts at similarity 0.8 is a candidate with
probability 0.998, one of some ten words with 0.97 (an even number of shingles
shifts the majority); both rise quickly above 0.8.  Nothing below 0.8 is linked.
Links join to components, so a text may go for one that went itself.  Pairs
inside a component need no look: a first pass gives every node few of those that
share a whole segment with it, which links most of a large group, and the second
looks up all balls for what is left between components of the first.
In both, rows with few partners in a bucket give pairs; of the others only a
spanning forest leaves the bucket, so what is sent grows with the rows.  The trees
make clusters, whose shingle sets are compared block by block inside tasks; what
the first pass has put into a cluster needs no second look there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow.llm.common import stored, text_key, utf8
from canopyflow.llm.linked import components

WORDS = 5
SEED = 42
BYTES = 32
#: A text as a node: its fingerprint, a hash of its shingle set, its number of shingles.
NODE_BYTES = BYTES + 8 + 4
#: A node with a number that is equal for nodes known to be linked.
ROW_BYTES = NODE_BYTES + 8
#: Bits up to which a pair is a candidate, and up to which it most likely links.
MAX_BITS, LIKELY_BITS = 72, 39
#: Least share of common shingles of a link, as a fraction.
SIMILARITY = (4, 5)
SEGMENTS, SEGMENT_BITS = 12, 20
#: Partners in a bucket up to which a row gives pairs; beyond, its cluster is compared.
FEW = 3
#: Texts and shingles of a block of a cluster, on average.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 20
#: Texts with a shingle up to which its pairs are counted one by one.
RARE = 32
#: Shingles whose columns are multiplied at once.
COLUMNS = 4096
#: Rows of a bucket up to which each is compared with all that follow it.
SMALL = 64
#: Fingerprints of a larger bucket that are compared in one step.
BLOCK = 512
#: Shingles whose bits are counted at once.
STEP = 8192


def spread(x: np.ndarray) -> np.ndarray:
    """Another 64 even bits of each value (multipliers are fixed values)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_hashes(text: bytes, words_per_shingle: int = WORDS) -> np.ndarray:
    """Hashes of the distinct word shingles, sorted; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = words_per_shingle
    shingles = map(b" ".join, zip(*(words[k:] for k in range(n)))) if len(words) >= n else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint64))


def fingerprint(hashes: np.ndarray) -> bytes:
    """SimHash of shingle hashes; all zero without any."""
    lanes = np.arange(1, BYTES // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(8 * BYTES, np.int64)
    for at in range(0, len(hashes), STEP):
        bits = spread(hashes[at:at + STEP, None] + lanes)
        ones += np.unpackbits(bits.view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def node(text: bytes, words_per_shingle: int = WORDS) -> bytes:
    hashes = shingle_hashes(text, words_per_shingle)
    return fingerprint(hashes) + xxhash.xxh64_digest(hashes.tobytes(), SEED) + len(hashes).to_bytes(4, "little")


def _texts(column: pa.Array):
    flat, offsets = utf8(column)
    flat = flat.tobytes()
    return (flat[a:b] for a, b in zip(offsets[:-1], offsets[1:]))


def nodes(docs: DataFrame, words_per_shingle: int = WORDS) -> DataFrame:
    """``doc_id, tag, fp`` (binary): the node of each text, and a key of the text."""

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1),
                 pa.array([node(t, words_per_shingle) for t in _texts(batch.column(2))], pa.binary())], ["doc_id", "tag", "fp"])

    return docs.select("doc_id", text_key().alias("tag"), "text").mapInArrow(hashed, "doc_id long, tag long, fp binary")


def shingle_sets(docs: DataFrame, words_per_shingle: int = WORDS) -> DataFrame:
    """``fp, hashes`` of each text of ``docs(fp, text)``."""

    def hashed(batches):
        for batch in batches:
            for k, text in enumerate(_texts(batch.column(1))):
                hashes = pa.array(shingle_hashes(text, words_per_shingle).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), pa.ListArray.from_arrays(pa.array([0, len(hashes)], pa.int32()), hashes)], ["fp", "hashes"])

    return docs.select("fp", "text").mapInArrow(hashed, "fp binary, hashes array<bigint>")


def segments(fps: np.ndarray) -> np.ndarray:
    """Segment values of each row of ``fps``."""
    bits = np.unpackbits(fps[:, :SEGMENTS * SEGMENT_BITS // 8], axis=1).reshape(-1, SEGMENTS, SEGMENT_BITS)
    return bits.astype(np.int64) @ (1 << np.arange(SEGMENT_BITS, dtype=np.int64))


def buckets(fps: np.ndarray) -> np.ndarray:
    """Bucket numbers of each row of ``fps`` (uint8): for each segment its value and
    those one bit away."""
    value = segments(fps)
    ball = np.r_[0, 1 << np.arange(SEGMENT_BITS, dtype=np.int64)]
    return ((value[:, :, None] ^ ball) + (np.arange(SEGMENTS, dtype=np.int64)[:, None] << SEGMENT_BITS)).reshape(len(fps), -1)


def own_buckets(fps: np.ndarray) -> np.ndarray:
    """Bucket numbers of the segment values alone."""
    return segments(fps) + (np.arange(SEGMENTS, dtype=np.int64) << SEGMENT_BITS)


def _fps(column: pa.Array) -> np.ndarray:
    """Rows of bytes of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros((0, ROW_BYTES), np.uint8)
    where = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[where[0]:where[-1]].reshape(-1, ROW_BYTES)


def _finder(balls: bool):
    def looked_up(batches):
        for batch in batches:
            fps = _fps(batch.column(0))
            for at in range(0, len(fps), 1024):
                part = fps[at:at + 1024]
                found = buckets(part) if balls else own_buckets(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.ravel()), _binary(np.repeat(part, found.shape[1], axis=0))], ["bucket", "fp"])

    return looked_up


def _binary(fps: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    offsets = np.arange(len(fps) + 1, dtype=np.int32) * fps.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(fps), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(fps))])


def _large(words: np.ndarray):
    """The close row pairs of a large bucket, a pair of blocks at a time."""
    for i in range(0, len(words), BLOCK):
        for j in range(i, len(words), BLOCK):
            above, below = words[i:i + BLOCK], words[j:j + BLOCK]
            far = sum(np.bitwise_count(above[:, None, k] ^ below[None, :, k]).astype(np.int16) for k in range(words.shape[1]))
            a, b = np.nonzero(np.triu(far <= MAX_BITS, 1) if i == j else far <= MAX_BITS)
            yield a + i, b + j


def close_pairs(bucket: np.ndarray, fps: np.ndarray):
    """Steps of the row pairs of each bucket within ``MAX_BITS``; rows come sorted by bucket."""
    words = np.ascontiguousarray(fps[:, :BYTES]).view(np.uint64)
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
    length = np.diff(np.r_[start, len(bucket)])
    size = np.repeat(length, length)
    small = np.flatnonzero((size > 1) & (size <= SMALL))
    end = np.repeat(start + length, length)
    for lag in range(1, SMALL):
        small = small[small + lag < end[small]]
        if not len(small):
            break
        close = np.bitwise_count(words[small] ^ words[small + lag]).sum(1) <= MAX_BITS
        yield small[close], small[close] + lag
    for s, n in zip(start[length > SMALL], length[length > SMALL]):
        for a, b in _large(words[s:s + n]):
            yield s + a, s + b


def linked_rows(bucket: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All row pairs of ``close_pairs``."""
    a, b = (np.concatenate(x) for x in zip((np.zeros(0, int), np.zeros(0, int)), *close_pairs(bucket, fps)))
    return a, b


def eligible_pairs(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a pair has different labels and may reach ``SIMILARITY`` by its numbers of shingles."""
    n = np.ascontiguousarray(fps[:, BYTES + 8:NODE_BYTES]).view(np.uint32).ravel().astype(np.int64)
    p, q = SIMILARITY
    label = np.ascontiguousarray(fps[:, NODE_BYTES:]).view(np.uint64).ravel()
    return (label[a] != label[b]) & (q * np.minimum(n[a], n[b]) >= p * np.maximum(n[a], n[b]))


def home_pairs(bucket: np.ndarray, value: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a pair meets in this bucket's segment first (and, with equal values, in
    the bucket of the value)."""
    near = np.bitwise_count(value[a] ^ value[b]) <= 2
    at = bucket[a] >> SEGMENT_BITS
    own = value[a, at]
    home = (own != value[b, at]) | (own == bucket[a] & (1 << SEGMENT_BITS) - 1)
    return (near.argmax(1) == at) & home


def wanted_pairs(bucket: np.ndarray, fps: np.ndarray, value: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a pair is eligible and at home in this bucket: each is in one only."""
    return home_pairs(bucket, value, a, b) & eligible_pairs(fps, a, b)


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the smallest row of each row's tree) after the trees of all pairs are joined."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


class Dense:
    """Takes the pairs of rows with more than ``FEW`` partners in their bucket out of
    steps of row pairs and keeps a spanning forest of them."""

    def __init__(self, n: int):
        self.partners, self.root = np.zeros(n, np.int64), np.arange(n)

    def rest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.root)
        self.partners += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        dense = (self.partners[a] > FEW) | (self.partners[b] > FEW)
        self.root = joined(self.root, a[dense], b[dense])
        return a[~dense], b[~dense]

    def trees(self) -> tuple[np.ndarray, np.ndarray]:
        far = np.flatnonzero(self.root != np.arange(len(self.root)))
        return far, self.root[far]


def few(bucket: np.ndarray, fps: np.ndarray):
    """Row pairs of each bucket: each row with its first partner, among all and among
    the likely ones, and trees over rows with many partners (``kind`` 0 and 1).  Rows
    stand in the same order in every bucket, so a node finds the same first partners
    again and again."""
    words = np.ascontiguousarray(fps[:, :BYTES]).view(np.uint64)
    none, dense = len(fps), Dense(len(fps))
    first = [np.full(none, none), np.full(none, none)]
    for a, b in close_pairs(bucket, fps):
        fit = eligible_pairs(fps, a, b)
        a, b = a[fit], b[fit]
        likely = np.bitwise_count(words[a] ^ words[b]).sum(1) <= LIKELY_BITS
        for best, of in zip(first, (slice(None), likely)):
            np.minimum.at(best, a[of], b[of])
            np.minimum.at(best, b[of], a[of])
        dense.rest(a, b)
    x = np.concatenate([np.flatnonzero(best < none) for best in first])
    y = np.concatenate([best[best < none] for best in first])
    pairs = np.unique(np.minimum(x, y) * max(none, 1) + np.maximum(x, y))
    yield pairs // max(none, 1), pairs % max(none, 1), 0
    yield *dense.trees(), 1


def parted(bucket: np.ndarray, fps: np.ndarray):
    """Row pairs of each bucket: pairs of rows with few partners, and trees over all
    others (``kind`` 0 and 1).  Each eligible pair is one of the first in its home
    bucket, or its rows are in one tree there."""
    value, dense = segments(fps), Dense(len(fps))
    for a, b in close_pairs(bucket, fps):
        fit = eligible_pairs(fps, a, b)
        a, b = dense.rest(a[fit], b[fit])
        home = home_pairs(bucket, value, a, b)
        yield a[home], b[home], 0
    yield *dense.trees(), 1


def _matcher(every: bool):
    def links(bucket, fps):
        order = np.lexsort((np.ascontiguousarray(fps[:, BYTES:BYTES + 8]).view(np.uint64).ravel(), bucket))
        bucket, fps = bucket[order], fps[order]
        for a, b, kind in (parted if every else few)(bucket, fps):
            if len(a):
                yield pa.RecordBatch.from_arrays([_binary(fps[a, :NODE_BYTES]), _binary(fps[b, :NODE_BYTES]),
                                                  pa.array(np.full(len(a), kind, np.int32))], ["a", "b", "kind"])

    def match(batches):
        kept_bucket, kept = np.zeros(0, np.int64), np.zeros((0, ROW_BYTES), np.uint8)
        for batch in batches:
            bucket = np.concatenate([kept_bucket, batch.column(0).to_numpy()])
            fps = np.concatenate([kept, _fps(batch.column(1))])
            if not len(bucket):
                continue
            last = int(np.searchsorted(bucket, bucket[-1], "left"))
            kept_bucket, kept = bucket[last:], fps[last:]
            yield from links(bucket[:last], fps[:last])
        yield from links(kept_bucket, kept)

    return match


def candidates(labelled: DataFrame, every: bool) -> DataFrame:
    """Pairs ``a, b, kind`` (a < b) of close nodes of ``labelled(fp, label)`` with different
    labels: few of each node that shares a segment, or every one that any ball finds.
    In place of pairs among many partners stand trees of ``kind`` 1."""
    rows = labelled.select(F.concat("fp", F.unhex(F.lpad(F.hex(F.xxhash64("label")), 16, "0"))).alias("fp"))
    return (rows.mapInArrow(_finder(every), "bucket long, fp binary")
            .repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(_matcher(every), "a binary, b binary, kind int")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind").distinct())


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` whose sets of ``sets(fp, hashes)`` have at least ``SIMILARITY`` in common."""
    both = (pairs.join(sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x")), "a")
            .join(sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y")), "b"))
    p, q = SIMILARITY
    common = F.size(F.array_intersect("x", "y"))
    return (both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("total"))
            .where(f"{q} * common >= {p} * (total - common)").select("a", "b"))


def common_shingles(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """The number of shingles that each two of ``n`` texts share; ``rows`` names the text of each hash."""
    order = np.argsort(hashes, kind="stable")
    rows, hashes = rows[order], hashes[order]
    start = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, int)
    length = np.diff(np.r_[start, len(hashes)])
    end, size = np.repeat(start + length, length), np.repeat(length, length)
    common = np.zeros(n * n, np.int64)
    rare = np.flatnonzero((size > 1) & (size <= RARE))
    for lag in range(1, RARE):
        rare = rare[rare + lag < end[rare]]
        if not len(rare):
            break
        common += np.bincount(rows[rare] * n + rows[rare + lag], minlength=n * n)
    common = common.reshape(n, n)
    common += common.T
    frequent = size > RARE
    rows, column = rows[frequent], np.repeat(np.cumsum(length > RARE) - 1, length)[frequent]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((n, COLUMNS), np.float32)
        has[rows[a:b], column[a:b] - at] = 1
        common += (has @ has.T).astype(np.int64)
    return common


def _block_links(table: pa.Table) -> pa.Table:
    """Trees over the texts of two blocks that are linked and have different labels."""
    sets = table.column("hashes").combine_chunks()
    n = len(table)
    counts = np.diff(sets.offsets.to_numpy())
    common = common_shingles(np.repeat(np.arange(n), counts), sets.flatten().to_numpy(), n)
    label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    p, q = SIMILARITY
    linked = q * common >= p * (counts[:, None] + counts - common)
    a, b = np.nonzero(np.triu(linked & (label[:, None] != label), 1))
    root = joined(np.arange(n), a, b)
    far = np.flatnonzero(root != np.arange(n))
    fp = table.column("fp").combine_chunks()
    return pa.table({"a": fp.take(pa.array(far)), "b": fp.take(pa.array(root[far]))})


def cluster_links(clusters: DataFrame, labelled: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: trees over the texts of each cluster of ``clusters(fp, cluster)`` that
    are linked by ``SIMILARITY`` and differ in the label of ``labelled(fp, label)``.

    A cluster is dealt over blocks by the hash of its texts, and a task compares two
    blocks, so its memory has a bound whatever the size of the cluster.  Texts of the
    most frequent label have blocks of their own, which are compared only with the
    others: a cluster that is almost linked as a whole costs little more than its rows.
    """
    member = stored(clusters.join(labelled, "fp").join(sets.select("fp", F.size("hashes").alias("n")), "fp"), "wide-members")
    sizes = member.groupBy("cluster", "label").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    main = (sizes.groupBy("cluster").agg(F.max(F.struct("texts", "label")).alias("m"), F.count("*").alias("labels"))
            .where("labels > 1").select("cluster", F.col("m.label").alias("main")))
    in_main = F.col("label") == F.col("main")
    texts = F.greatest(F.col("texts") / BLOCK_TEXTS, F.col("n") / BLOCK_SHINGLES)
    blocks = sizes.join(main, "cluster").groupBy("cluster", "main").agg(
        F.ceil(F.sum(F.when(in_main, texts))).alias("own"), F.ceil(F.sum(F.when(~in_main, texts))).alias("others"))
    deal = lambda n: F.pmod(F.xxhash64("fp"), F.col(n))
    # blocks of the others come first; those of the main label meet these only
    dealt = (member.join(blocks, "cluster")
             .withColumn("at", F.when(in_main, F.col("others") + deal("own")).otherwise(deal("others")))
             .withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.when(in_main, F.col("others")).otherwise(
                 F.col("others") + F.col("own")) - 1)))
             .join(sets, "fp"))
    return (dealt.select("cluster", F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j"), "fp", "label", "hashes")
            .groupBy("cluster", "i", "j").applyInArrow(_block_links, "a binary, b binary"))


def near_copies(docs: DataFrame, words_per_shingle: int = WORDS) -> DataFrame:
    """``doc_id, component_id`` for every row of ``docs``: the smallest doc_id reachable
    over links, itself included.

    Texts with equal shingle sets are one node before any look-up.  Fewer words
    than a shingle make one shingle; null and blank texts are copies of each other.
    A null doc_id stays null and is never the smallest; repeated rows are all
    returned; an empty table gives an empty one; extra columns are not read.
    """
    hashed = stored(nodes(docs, words_per_shingle), "wide-nodes")
    distinct = stored(hashed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("tag").alias("tag")), "wide-distinct")

    def sets_of(wanted: DataFrame) -> DataFrame:
        # only texts with a candidate are read again, each once
        texts = (docs.select(text_key().alias("tag"), "text").join(distinct.join(wanted, "fp").select("fp", "tag"), "tag")
                 .dropDuplicates(["fp"]))
        return stored(shingle_sets(texts, words_per_shingle), "wide-sets")

    def labels(links: DataFrame, name: str) -> DataFrame:
        return (distinct.join(components(links).withColumnRenamed("node", "fp"), "fp", "left")
                .select("fp", F.coalesce("label", "fp").alias(name)))

    first = stored(candidates(distinct.select("fp", F.col("fp").alias("label")), False), "wide-candidates")
    pairs, trees = (first.where(F.col("kind") == kind).select("a", "b") for kind in (0, 1))
    sets = sets_of(ends(pairs))
    links = stored(verified(pairs, sets), "wide-links")
    labelled = stored(labels(links, "label"), "wide-labels")
    known = links.union(trees)
    found = stored(candidates(stored(labels(known, "label"), "wide-labels"), True), "wide-found")
    sets = sets.union(sets_of(ends(found).join(sets, "fp", "left_anti")))
    between, more = (found.where(F.col("kind") == kind).select("a", "b") for kind in (0, 1))
    near = stored(verified(between.join(pairs, ["a", "b"], "left_anti"), sets), "wide-links")
    clustered = cluster_links(labels(known.union(more), "cluster"), labelled, sets)
    label = components(links.union(near).union(stored(clustered, "wide-links")))
    of = stored(distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left")
                .select("fp", F.coalesce("label", "fp").alias("label"), "least"), "wide-labelled")
    lowest = of.groupBy("label").agg(F.min("least").alias("component_id"))
    named = stored(of.join(lowest, "label").select("fp", "component_id"), "wide-named")
    return hashed.join(named, "fp").select("doc_id", "component_id")
