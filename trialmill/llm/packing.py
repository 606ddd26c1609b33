"""Best-fit packing by bin completion over a histogram of piece lengths.

Documents become pieces of at most ``capacity`` tokens (only longer documents are cut;
the first piece takes the odd remainder).  How many pieces there are of each length is a
table of at most ``capacity`` rows, whatever the input's size, so the search runs on that
table alone: take the longest remaining piece, enumerate the undominated fillings of what
is left beside it, prune those whose waste exceeds what the best known packing allows, and
use the chosen filling as many times as the counts permit.  The incumbent is best-fit
decreasing; the search stops as soon as a packing meets the lower bound.

The plan is then read back by arithmetic: a piece's rank among the pieces of its length
names its sequence and its offset.  Ranks come from counts per (length, bucket), so no
length, however common, meets in one task.

Defined results: null text is empty (one piece of one token, the end mark); repeated rows are
packed as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import library_ids
from .common import cut, slices

CAPACITY = 2048
END_ID = 0
#: Bytes of text that are encoded at a time: an Arrow batch, unless its texts are long.
ENCODED_BYTES = 4_000_000
#: Rows of one (length, bucket) rank window, about.
BUCKET_ROWS = 5_000
#: Fillings looked at around one longest piece, and bins that the search fills in all its dives together.
FILLINGS = 2_000
SEARCHED_BINS = 60_000


def fillings(room: int, sizes: list[int], counts: dict[int, int], waste: int, limit: int = FILLINGS, enough: int = 0) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` from the given sizes (descending), least waste first.

    Depth first, longest pieces first.  A filling is dominated if one of its pieces could
    be swapped for a longer free piece that still fits; such fillings are skipped.  Branches
    that cannot come below ``waste`` unused tokens are pruned, and the first filling that
    leaves at most ``enough`` ends the enumeration.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    smallest = sizes[-1] if sizes else room + 1
    best = waste
    looked = 0
    used: dict[int, int] = {}
    stack: list[int] = []

    # Explicit frames [next size, room left, whether a piece fitted]: a bin may take as many pieces as it has tokens.
    frames: list[list] = []
    start, left = 0, room
    while True:
        # A new node: a leaf ends in ``stop``, any other node gets a frame.
        looked += 1
        stop = False
        if left < smallest or start == len(sizes):
            if left <= best:
                # Dominated if the last (shortest) piece can grow into the unused room.
                if not (left and stack and any(counts[s] > used.get(s, 0) for s in range(stack[-1] + 1, stack[-1] + left + 1) if s in counts)):
                    best = min(best, left)
                    found.append((left, tuple(stack)))
                    stop = left <= enough or looked > limit
            else:
                stop = left <= enough or looked > limit
            leaf = True
        else:
            # Binary search for the first size that fits.
            lo, hi = start, len(sizes)
            while lo < hi:
                mid = (lo + hi) // 2
                if sizes[mid] > left:
                    lo = mid + 1
                else:
                    hi = mid
            frames.append([lo, left, False])
            leaf = False
        # Go on to the next child, back to parents whose sizes are used up.
        while frames:
            frame = frames[-1]
            if leaf:
                s = stack.pop()
                used[s] -= 1
                if stop or looked > limit:
                    frames.clear()
                    break
            k = frame[0]
            while k < len(sizes) and counts[sizes[k]] <= used.get(sizes[k], 0):
                k += 1
            if k < len(sizes):
                s = sizes[k]
                frame[0], frame[2] = k + 1, True
                used[s] = used.get(s, 0) + 1
                stack.append(s)
                start, left = k, frame[1] - s
                break
            frames.pop()
            leaf, stop = True, False
            if not frame[2] and frame[1] <= best:
                best = frame[1]
                found.append((frame[1], tuple(stack)))
                stop = frame[1] <= enough
            if not frames:
                break
        if not frames:
            break

    found.sort(key=lambda f: (f[0], tuple(-s for s in f[1])))
    return [f for _, f in found]


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing as (times, sizes) runs: equal pieces are placed many at a time."""
    gaps: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # room left -> bins (times, sizes) with that room
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = min((r for r in gaps if r >= size), default=None)
            if room is None:
                per = capacity // size
                if full := left // per:
                    gaps.setdefault(capacity - per * size, []).append((full, (size,) * per))
                if rest := left % per:
                    gaps.setdefault(capacity - rest * size, []).append((1, (size,) * rest))
                break
            times, sizes = gaps[room].pop()
            per = room // size
            whole = min(times, left // per)
            if whole:
                gaps.setdefault(room - per * size, []).append((whole, sizes + (size,) * per))
                left -= whole * per
                times -= whole
            elif left:
                gaps.setdefault(room - left * size, []).append((1, sizes + (size,) * left))
                times, left = times - 1, 0
            if times:
                gaps[room].append((times, sizes))
            if not gaps[room]:
                del gaps[room]
    return [b for bins in gaps.values() for b in bins]


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: total length, tightened by pieces that cannot share a bin."""
    total = math.ceil(sum(s * n for s, n in histogram.items()) / capacity)
    best = total
    over_half = {s: n for s, n in histogram.items() if s > capacity // 2}
    for k in sorted({s for s in histogram if s <= capacity // 2} | {0}):
        large = sum(n for s, n in over_half.items() if s > capacity - k)
        middle = [(s, n) for s, n in histogram.items() if capacity // 2 < s <= capacity - k]
        small = sum(s * n for s, n in histogram.items() if k <= s <= capacity // 2)
        free = sum((capacity - s) * n for s, n in middle)
        best = max(best, large + sum(n for _, n in middle) + max(0, math.ceil((small - free) / capacity)))
    return best


def complete_bins(histogram: dict[int, int], capacity: int, choice: int = 0, most: int | None = None, other: int = 1, share: float = 0.0) -> list[tuple[int, tuple[int, ...]]] | None:
    """One dive of the branch and bound; None if its waste passes what ``most`` bins allow.

    ``choice`` names one branching point where the search takes the ``other``-th alternative.
    ``share`` of the waste allowed per remaining bin is spent freely: a filling of few long
    pieces then goes before a tighter one of many short pieces, which fit anywhere later.
    """
    counts = {s: n for s, n in histogram.items() if n}
    total = sum(s * n for s, n in counts.items())
    allowed = most * capacity - total if most is not None else None
    runs, wasted, step = [], 0, 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        if not counts[longest]:
            del counts[longest]
        sizes = sorted(counts, reverse=True)
        room = capacity - longest
        waste = room if allowed is None else min(room, allowed - wasted)
        enough = 0
        if share and allowed is not None:
            left_bins = max(1, most - sum(t for t, _ in runs))
            enough = int(share * (allowed - wasted) / left_bins)
        found = fillings(room, sizes, counts, waste, enough=enough) if sizes and sizes[-1] <= room else [()] if room <= waste else []
        if not found:
            return None
        pick = found[min(len(found) - 1, other)] if choice and step == choice - 1 else found[0]
        step += 1
        bin_ = (longest, *pick)
        need: dict[int, int] = {}
        for s in bin_:
            need[s] = need.get(s, 0) + 1
        counts[longest] = counts.get(longest, 0) + 1
        times = min(counts[s] // k for s, k in need.items())
        unused = capacity - sum(bin_)
        if allowed is not None and unused:
            times = max(1, min(times, (allowed - wasted) // unused))
        for s, k in need.items():
            counts[s] -= k * times
            if not counts[s]:
                del counts[s]
        wasted += unused * times
        runs.append((times, bin_))
    return runs


def plan(histogram: dict[int, int], capacity: int = CAPACITY, searched: int = SEARCHED_BINS) -> list[tuple[int, tuple[int, ...]]]:
    """(times, sizes) runs that hold every piece of the histogram in few bins.

    The incumbent is best-fit decreasing.  Dives that must beat it follow the least
    wasteful completion everywhere but at one branching point, where they take another.
    The search ends at the lower bound or after ``searched`` bins; the incumbent stands if
    no dive is better.
    """
    histogram = {s: n for s, n in histogram.items() if n}
    if not histogram:
        return []
    incumbent = best_fit(histogram, capacity)
    used = sum(t for t, _ in incumbent)
    bound = lower_bound(histogram, capacity)
    first = complete_bins(histogram, capacity) if used > bound else None
    if first is not None and (n := sum(t for t, _ in first)) < used:
        incumbent, used = first, n
    runs = max(1, len(first or incumbent))
    shares = [(0, 1, s) for s in (1.0, 0.5, 2.0, 0.25, 4.0)]
    dives = itertools.chain(shares, ((choice, other, 0.0) for other in range(1, 6) for choice in range(1, runs + 1)))
    for choice, other, share in itertools.islice(dives, max(len(shares), searched // runs)):
        if used <= bound:
            break
        dive = complete_bins(histogram, capacity, choice, used - 1, other, share)
        if dive is not None:
            incumbent, used = dive, sum(t for t, _ in dive)
    return incumbent


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text", ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each document's token ids, ended and cut."""
    kind = docs.schema[id_column].dataType
    names = ["id", "piece", "start", "length", "ids_crc32"] + (["ids"] if ids else [])

    def run(batches):
        library = library_ids(path)
        end = int(end_id).to_bytes(4, "little")
        for b in slices(batches, 1, ENCODED_BYTES):
            rows = [[] for _ in names]
            keep = []
            for i, encoded in enumerate(library.encode(b.column(1).to_pylist())):
                tokens = encoded + end
                n = len(tokens) // 4
                first = n - (math.ceil(n / capacity) - 1) * capacity
                starts = [0, *range(first, n, capacity)]
                for k, s in enumerate(starts):
                    e = starts[k + 1] if k + 1 < len(starts) else n
                    part = tokens[4 * s : 4 * e]
                    keep.append(i)
                    for to, value in zip(rows[1:], (k, s, e - s, zlib.crc32(part), part), strict=False):
                        to.append(value)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [b.column(0).take(pa.array(keep, pa.int64()))] + [pa.array(r, t) for r, t in zip(rows[1:], types, strict=False)]
            yield pa.RecordBatch.from_arrays(columns, names)

    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = f"id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else "")
    return plain.mapInArrow(run, schema)


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds (sequence_id, offset) to a written table of pieces with a ``length`` column."""
    spark = cut_pieces.sparkSession
    order = [c for c in cut_pieces.columns if c != "ids"]
    # The histogram has at most ``capacity`` rows.
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    n_rows = sum(histogram.values())
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for times, sizes in plan(histogram, capacity):
        at = 0
        for s in sizes:
            # Ranks [from, from + times) of this length stand at offset ``at`` of sequences base...
            slots.setdefault(s, []).append((taken.get(s, 0), base, at))
            taken[s] = taken.get(s, 0) + times
            at += s
        base += times
    # At most a few runs per length, so at most a few times ``capacity`` entries.
    table = {s: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for s, v in slots.items()}
    shared = spark.sparkContext.broadcast(table)

    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    keyed = cut_pieces.withColumn("_b", F.pmod(F.xxhash64("id", "piece", "start"), F.lit(buckets)).cast("int"))
    if buckets > 1:
        counts = keyed.groupBy("length", "_b").agg(F.count("*").alias("_n"))
        before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        firsts = counts.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
        keyed = keyed.join(firsts, ["length", "_b"])
    else:
        keyed = keyed.withColumn("_first", F.lit(0).cast("long"))
    within = Window.partitionBy("length", "_b").orderBy(*[F.col(c) for c in order])
    ranked = keyed.withColumn("_rank", F.col("_first") + F.row_number().over(within) - 1).select(*cut_pieces.columns, "_rank")

    names = cut_pieces.columns

    def run(batches):
        slots_of = shared.value
        for b in batches:
            length = np.asarray(b.column("length"))
            rank = np.asarray(b.column("_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                froms, bases, offsets = slots_of[int(s)]
                k = np.searchsorted(froms, rank[at], side="right") - 1
                sequence[at] = bases[k] + rank[at] - froms[k]
                offset[at] = offsets[k]
            columns = [b.column(c) for c in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text", ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and its ids if asked for)."""
    written = cut(pieces(docs, path, capacity, end_id, id_column, text_column, ids), "pieces")
    return pack(written, capacity).withColumnRenamed("id", id_column)
