"""Best-fit packing of token sequences by a configuration linear program.

The pieces' length histogram has at most ``capacity`` entries whatever the
corpus, so the program over it is solved on the driver: lengths are put into
classes, multiplicative weights price patterns with a knapsack dynamic program,
pattern counts are rounded down, and best fit places what is left into the room
of these and new sequences.  Texts are tokenised, ranked and placed by Spark.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow.llm.common import ranked, slices, stored, worker_cache

CAPACITY = 4096
END_ID = 1
#: Words whose ids a task keeps at hand; more only cost time.
KNOWN_WORDS = 600_000
#: Text whose words are looked up at once.
STEP_CHARS = 3_000_000
#: Marks that the vocabulary's rules part from a letter before them.
ENDS = ".,;:!?"
#: What the vocabulary's special tokens begin with.
SPECIAL = "<|"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of texts, word by word: the vocabulary never joins across white
    space, so words met before need not be tokenised again.  It lower-cases, and
    keeps letters apart from marks, so ASCII case and a last mark after an ASCII
    letter are taken off before.  Special tokens are found before lower-casing, so
    words that may hold one keep their case."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        known, tokenize, cores = self.known, self.tokenizer.model.tokenize, {}
        for word in set().union(*split):
            if word in known:
                continue
            core, end = word.lower() if word.isascii() and SPECIAL not in word else word, ""
            if len(core) > 1 and core[-1] in ENDS and core[-2].isalpha() and core[-2].isascii():
                core, end = core[:-1], core[-1]
            if core not in known and core.isascii() and core.isalpha():
                # one word of plain letters: neither normalised nor split
                found = [t.id for t in tokenize(core)]
                known[core] = struct.pack(f"<{len(found)}I", *found)
            if core != word:
                cores[word] = core, end
            elif core not in known:
                cores[word] = core, ""
        other = [c for c in {c for both in cores.values() for c in both} if c not in known]
        fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        for at in range(0, len(other), 20_000):
            part = other[at:at + 20_000]
            for word, coded in zip(part, fast(part, add_special_tokens=False)):
                known[word] = struct.pack(f"<{len(coded.ids)}I", *coded.ids)
        for word, (core, end) in cores.items():
            known[word] = known[core] + known[end] if end else known[core]
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's token ids.

    A null or empty text is the end id alone; a null doc_id stays null; rows
    that repeat an id each have their pieces; other columns are not read.
    """
    path = tokenizer or default_tokenizer()

    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = worker_cache(("word ids", path), lambda: WordIds(path))
        for batch in batches:
            ids, every = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(np.cumsum([0, *map(len, every)]), STEP_CHARS):
                rows = []
                for doc, coded in zip(ids[a:b], coder.encode(every[a:b])):
                    coded += END_ID.to_bytes(4, "little")
                    for piece, start in enumerate(range(0, len(coded) // 4, capacity)):
                        part = coded[4 * start:4 * (start + capacity)]
                        rows.append((doc, piece, start, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, room: int) -> np.ndarray:
    """How often each size belongs into ``room`` for the highest worth (unbounded knapsack)."""
    best, chosen = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(sizes, kind="stable")
    sorted_sizes, sorted_worth = sizes[order], worth[order]
    for c in range(1, room + 1):
        fits = int(np.searchsorted(sorted_sizes, c, "right"))
        best[c] = best[c - 1]
        if fits:
            total = best[c - sorted_sizes[:fits]] + sorted_worth[:fits]
            k = int(total.argmax())
            if total[k] > best[c]:
                best[c], chosen[c] = total[k], order[k]
    taken, c = np.zeros(len(sizes), int), room
    while c > 0:
        if chosen[c] < 0:
            c -= 1
        else:
            taken[chosen[c]] += 1
            c -= sizes[chosen[c]]
    return taken


def fractional_patterns(tops: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 250,
                        eagerness: float = 20.0, cells: int = 512) -> list[tuple[np.ndarray, float]]:
    """Patterns over length classes and their (fractional) counts that cover the demand.

    Multiplicative weights: a class is worth its length, less by an exponential
    of the share of its demand that the patterns so far cover.
    """
    unit = max(1, capacity // cells)
    sizes, found = -(-tops // unit), {}
    step = max(1.0, float((tops * demand).sum()) / capacity / rounds)
    covered = np.zeros(len(tops))
    for _ in range(2 * rounds):
        if (covered >= demand).all():
            break
        taken = _best_pattern(sizes, tops * np.exp(-eagerness * covered / demand), capacity // unit)
        if not taken.any():
            break
        covered += step * taken
        found[tuple(taken)] = found.get(tuple(taken), 0.0) + step
    return [(np.array(k), n) for k, n in sorted(found.items(), key=lambda x: -x[1])]


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = 96,
                   small: int | None = None) -> list[tuple[int, dict[int, int]]]:
    """``(how many sequences, {length: pieces in each})`` that hold the histogram exactly."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    small = capacity // 16 if small is None else small
    rooms: list[list[tuple[int, dict[int, int]]]] = [[] for _ in range(capacity + 1)]

    def put(n: int, held: dict[int, int]) -> None:
        rooms[capacity - sum(t * k for t, k in held.items())].append((n, held))

    if left[capacity]:
        put(int(left[capacity]), {capacity: 1})
        left[capacity] = 0
    large = np.flatnonzero(left[small + 1:]) + small + 1
    if len(large):
        # classes of about equal tokens; the longest length stands for the class
        share = np.cumsum((large * left[large])[::-1])[::-1]
        group = np.minimum((share * classes / (share[0] + 1)).astype(int), classes - 1)
        members = [[[int(t), int(left[t])] for t in large[group == g][::-1]] for g in np.unique(group)[::-1]]
        tops = np.array([m[0][0] for m in members])
        stock = np.array([sum(n for _, n in m) for m in members])
        for taken, count in fractional_patterns(tops, stock.astype(float), capacity):
            used = np.flatnonzero(taken)
            n = min(int(count), int((stock[used] // taken[used]).min()))
            if n <= 0:
                continue
            runs = []
            for k in (k for k in used for _ in range(taken[k])):
                stock[k], need, run = stock[k] - n, n, []
                while need:
                    t, have = members[k][0]
                    got = min(need, have)
                    run.append([t, got])
                    left[t] -= got
                    need -= got
                    members[k][0][1] -= got
                    if not members[k][0][1]:
                        members[k].pop(0)
                runs.append(run)
            while runs[0]:
                same, held = min(r[0][1] for r in runs), {}
                for r in runs:
                    held[r[0][0]] = held.get(r[0][0], 0) + 1
                    r[0][1] -= same
                    if not r[0][1]:
                        r.pop(0)
                put(same, held)
    open_rooms = np.array([bool(r) for r in rooms])
    for t in range(capacity, 0, -1):
        n = int(left[t])
        while n:
            at = t + int(open_rooms[t:].argmax())
            if at <= capacity and open_rooms[at]:
                bins, held = rooms[at].pop()
            else:
                at, bins, held = capacity, -(-n // (capacity // t)), {}
            fit = at // t
            filled = min(bins, n // fit)
            if filled:
                rooms[at - fit * t].append((filled, held | {t: held.get(t, 0) + fit}))
                open_rooms[at - fit * t] = True
                n, bins = n - filled * fit, bins - filled
            if n and bins:
                rooms[at - n * t].append((1, held | {t: held.get(t, 0) + n}))
                open_rooms[at - n * t] = True
                n, bins = 0, bins - 1
            if bins and held:
                rooms[at].append((bins, held))
            open_rooms[at] = bool(rooms[at])
    return [x for r in rooms for x in r]


def places(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length, which ranks go where; sorted by length and first rank."""
    rows, used, sequence = [], {}, 0
    for n, held in plan:
        offset = 0
        for t, k in held.items():
            rows.append((t, used.get(t, 0), sequence, k, offset))
            used[t] = used.get(t, 0) + n * k
            offset += t * k
        sequence += n
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "sequence", "each", "offset"), columns))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: each sequence is gapless
    from 0 and holds at most ``capacity`` tokens.  An empty table stays empty."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = spark.sparkContext.broadcast(places(plan_sequences(histogram, capacity)))

    def place(batches):
        at = where.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            key = at["length"] << 44 | at["first"]
            row = np.searchsorted(key, length << 44 | rank, "right") - 1
            past = rank - at["first"][row]
            sequence = at["sequence"][row] + past // at["each"][row]
            offset = at["offset"][row] + past % at["each"][row] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    numbered = ranked(pieces.select(*names), "length", ["doc_id", "piece", "start", "ids_crc32"], "rank")
    return numbered.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut at ``capacity`` and pack whole documents; see ``token_pieces`` for odd rows."""
    return pack(stored(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)
