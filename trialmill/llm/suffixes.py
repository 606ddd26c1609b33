"""Repeated passages by interval trees of enhanced suffix arrays.

A passage is a byte string of at least ``length`` bytes that starts at two places or more, in
one text or in several.  Two equal strings of ``length`` bytes share an anchor: the
``GRAM``-byte stretch with the smallest hash among those inside them.  Texts send only
their anchors; anchors seen once are dropped.

What decides about a place is its context, the bytes around the anchor that a passage can reach.  Places
of one anchor and equal context are counted and go on as one, before any of their bytes are sent: a context that occurs
twice repeats as a whole, and only anchors with different contexts compare them.  A run of one
byte has equal contexts all along and goes as one place.

Per anchor a suffix array (contexts sorted by what follows) with its common-prefix lengths is
scanned with a stack, which visits every interval of the prefix tree once, deepest first.
Within an interval the contexts are ordered by what precedes them, read backwards, and the same scan over
these finds where left extensions differ.  Each pair of intervals is a maximal repeat with all of its
places, not only neighbours; those long enough mark their bytes.

Anchors with more than ``GROUP_ROWS`` different contexts are not collected.  For them windows around the anchor
become keys, and the outermost windows counted twice mark their bytes; the result is the same.

Passages of a second, shorter length can be found in the same pass (``shorter``): anchors are then laid for
the shorter length and contexts for the longer, and each pair of intervals is held against both.

Either every occurrence of a passage counts (``repeated_bytes``), or all but the first in the order of (text
key, place), so that one copy stays (``without_repeats(..., keep_first=True)``).

Defined results: null text is empty; texts shorter than ``length`` lose nothing; repeated
rows count as repeated texts, so a long one loses all its bytes in every row, or with ``keep_first``
in every row but those of the smallest id; a null id is an id like any other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import Scratch, cut, mix64, slices, text_batches

LENGTH = 400
#: Bytes of a repeated passage: fifty words of prose and their blanks are 250 bytes and more.
PASSAGE = 250
#: Places of one anchor that a task collects: with their contexts about 100 MB at most.
GROUP_ROWS = 100_000
#: Bytes hashed at a time; longer texts are cut into overlapping slices.
SLICE = 400_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_EMPTY = hashlib.sha256(b"").hexdigest()


def gram_of(length: int) -> int:
    return length // 2


# Anchors


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, SLICE * 2), base, np.uint64)
        steps[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(steps)
    return known[:n]


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of ``width`` values, by doubling."""
    span = 1
    while span * 2 <= width:
        x = op(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(raws: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, hash) of every anchor: the smallest stretch hash of some window, ties included."""
    gram = gram_of(length)
    width = length - gram + 1
    parts, owners, offsets = [], [], []
    for i, raw in enumerate(raws):
        for at in range(0, max(1, len(raw) - length + 1), SLICE - length + 1):
            piece = raw[at : at + SLICE]
            if len(piece) >= length:
                parts.append(piece)
                owners.append(i)
                offsets.append(at)
    none = np.zeros(0, np.int64)
    if not parts:
        return none, none, np.zeros(0, np.uint64)
    b = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    n = len(b)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[b] * _powers(_BASE, n), out=sums[1:])
        h = mix64((sums[gram:] - sums[:-gram]) * _powers(_INVERSE, n - gram + 1))
    least = _slide(h, width, np.minimum)  # window t covers stretches t .. t + width - 1
    for end in ends[:-1]:  # windows over two texts
        least[max(0, end - length + 1) : end] = 0
    padded = np.zeros(len(h) + width - 1, np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    chosen = np.flatnonzero(_slide(padded, width, np.maximum) == h)
    which = np.searchsorted(ends, chosen, side="right")
    place = chosen - (ends - sizes)[which] + np.array(offsets)[which]
    owner = np.array(owners)[which]
    hashes = h[chosen]
    if len(set(owners)) < len(owners):  # slices of one text may both choose a place
        _, first = np.unique(np.stack([owner, place]), axis=1, return_index=True)
        owner, place, hashes = owner[first], place[first], hashes[first]
    return owner, place, hashes


# Suffix arrays of one anchor's places


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low + 1 < high:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def intervals(prefixes: list[int]):
    """(length, first, last) of every interval with a common prefix, deepest first.

    ``prefixes[i]`` is what rows i and i + 1 of the array share.  Intervals of length 0 (the
    root) are included where all rows share nothing more.
    """
    stack: list[tuple[int, int]] = []
    for i, shared in enumerate([*prefixes, -1]):
        first = i
        while stack and stack[-1][0] > shared:
            length, first = stack.pop()
            yield length, first, i
        if shared >= 0 and (not stack or stack[-1][0] < shared):
            stack.append((shared, first))


def tree(left: list[bytes], right: list[bytes], need: int):
    """(right length, places in left order, left prefixes between them) of each right interval.

    ``left`` is read backwards from the anchor.  Intervals that no left extension can
    bring to ``need`` are skipped.
    """
    rows = sorted(range(len(right)), key=right.__getitem__)
    prefixes = [common(right[a], right[b]) for a, b in zip(rows, rows[1:], strict=False)]
    ranks = {p: r for r, p in enumerate(sorted(range(len(left)), key=left.__getitem__))}
    for length, first, last in intervals(prefixes):
        members = sorted(rows[first : last + 1], key=ranks.__getitem__)
        yield length, members, [common(left[a], left[b]) for a, b in zip(members, members[1:], strict=False)]


def _prefixes(sides: list[bytes]):
    """``common`` of two of the sides by their numbers: the sides become whole numbers, the highest byte first."""
    sizes = [len(s) for s in sides]
    width = max(sizes, default=0)
    values = [int.from_bytes(s.ljust(width, b"\0"), "big") for s in sides]

    def shared(a: int, b: int) -> int:
        return min(sizes[a], sizes[b], width - ((values[a] ^ values[b]).bit_length() + 7) // 8)

    return shared


def neighbours(left: list[bytes], right: list[bytes]):
    """(right length, place, place, left length) of places that become neighbours in left order as the right intervals grow.

    Each interval's places stand in left order.  An interval takes over the list of its largest part and the
    places of the others are put in; neighbours that a part had already share as much there, and to the right more.  So a place
    is put in once for each doubling of its interval, and not once for each interval around it.
    """
    if len(left) < 2:
        return
    rows = sorted(range(len(right)), key=right.__getitem__)
    by_left = sorted(range(len(left)), key=left.__getitem__)
    rank = {p: r for r, p in enumerate(by_left)}
    on_left, on_right = _prefixes(left), _prefixes(right)

    def join(a: list[int], b: list[int], length: int):
        if len(a) < len(b):
            a, b = b, a
        for r in b:
            k, p = bisect(a, r), by_left[r]
            for near in a[max(k - 1, 0) : k + 1]:
                found.append((length, by_left[near], p, on_left(by_left[near], p)))
            a.insert(k, r)
        return a

    stack: list[tuple[int, list[int]]] = []
    for i, own in enumerate(rows):
        shared = on_right(own, rows[i + 1]) if i + 1 < len(rows) else -1
        held, found = [rank[own]], []
        while stack and stack[-1][0] >= max(shared, 0):
            length, members = stack.pop()
            held = join(members, held, length)
        if shared >= 0:
            stack.append((shared, held))
        yield from found


def _nearest_earlier(shared: list[int], order: list) -> list[int]:
    """For each member the longest prefix that it shares with an earlier one, -1 without one.

    ``shared[i]`` is what members i and i + 1 have in common.  Of the earlier members on a side the
    nearest shares most; a stack of rising orders finds it.
    """

    def one_side(shared, order):
        best, stack = [], []
        for k, own in enumerate(order):
            if stack:
                stack[-1][1] = min(stack[-1][1], shared[k - 1])
            while stack and stack[-1][0] > own:
                gap = stack.pop()[1]
                if stack:
                    stack[-1][1] = min(stack[-1][1], gap)
            best.append(stack[-1][1] if stack else -1)
            stack.append([own, 1 << 62])
        return best

    after = one_side(shared[::-1], order[::-1])[::-1]
    return [max(a, b) for a, b in zip(one_side(shared, order), after, strict=True)]


def reaches(left: list[bytes], right: list[bytes], needs: list[int], order: list | None = None) -> list[list[tuple[int, int] | None]]:
    """For each need, how far each context's repeats extend to the left and right of the anchor; None without one.

    A repeat is long enough if both extensions reach the need together.  With ``order`` only
    repeats of earlier contexts count.  Contexts are different from each other.
    """
    most = [[[-1, -1] for _ in left] for _ in needs]
    least = min(needs)

    def note(m: int, to_left: int, length: int):
        for best, need in zip(most, needs, strict=True):
            if length + to_left >= need:
                best[m] = [max(best[m][0], to_left), max(best[m][1], length)]

    if order is None:
        for length, a, b, to_left in neighbours(left, right):
            if length + to_left >= least:
                note(a, to_left, length)
                note(b, to_left, length)
    elif len(left) > 1:
        for length, members, shared in tree(left, right, least):
            for m, to_left in zip(members, _nearest_earlier(shared, [order[m] for m in members]), strict=True):
                if to_left >= 0 and length + to_left >= least:
                    note(m, to_left, length)
    return [[(a, b) if a >= 0 else None for a, b in best] for best in most]


def reach(left: list[bytes], right: list[bytes], need: int, order: list | None = None) -> list[tuple[int, int] | None]:
    """``reaches`` for one need."""
    return reaches(left, right, [need], order)[0]


def maximal_repeats(left: list[bytes], right: list[bytes], need: int):
    """(left length, right length, places) of every maximal repeat around one anchor.

    A left interval inside a right interval is maximal if its places differ in the byte
    before it and in the byte after it; both hold where the intervals' lengths are exact.
    """
    for length, members, shared in tree(left, right, need):
        for to_left, first, last in intervals(shared):
            if to_left + length < need:
                continue
            places = members[first : last + 1]
            after = {right[p][length : length + 1] for p in places}
            if len(after) > 1 or after == {b""}:
                yield to_left, length, sorted(places)


# Spark side


def _raw(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def text_key(text: Column) -> Column:
    """128 bits of the text's sha256: rows with equal keys hold equal texts."""
    return F.substring(F.unhex(F.sha2(_raw(text), 256)), 1, 16)


def _stretches(raw: bytes, places: list[int], hashes: list[int], gram: int, need: int):
    """(anchor, place, span, context, left size, right size) of a text's anchors.

    Neighbouring places with one hash hold one byte throughout; those whose context lies within
    such a run have equal contexts and go as one stretch of ``span`` places.
    """
    i, n = 0, len(places)
    while i < n:
        j = i + 1
        while j < n and places[j] == places[j - 1] + 1 and hashes[j] == hashes[i]:
            j += 1
        inner = (i + need, j - need) if j - i > 2 * need + 1 else (j, j)
        k = i
        while k < j:
            at = places[k]
            left, right = raw[max(0, at - need) : at], raw[at + gram : at + gram + need]
            span = inner[1] - k if k == inner[0] else 1
            yield hashes[k], at, span, xxh3_64_intdigest(b"%d:%b|%b" % (len(left), left, right)) - (1 << 63), len(left), len(right)
            k += span
        i = j


def anchor_rows(docs: DataFrame, length: int, text_column: str, shorter: int | None = None) -> DataFrame:
    """(key, size, found) of each row's text: its anchors and their contexts.  No shuffle."""
    least = shorter or length
    gram = gram_of(least)
    need = length - gram
    kind = pa.struct([("anchor", pa.int64()), ("place", pa.int64()), ("span", pa.int64()), ("context", pa.int64()), ("nl", pa.int16()), ("nr", pa.int16())])

    def run(batches):
        for b in batches:
            texts = b.column(0)
            for lo, hi in text_batches(texts, SLICE):
                raws = [(t or "").encode() for t in texts.slice(lo, hi - lo).to_pylist()]
                owner, place, h = anchors(raws, least)
                cuts = np.searchsorted(owner, np.arange(len(raws) + 1)).tolist()
                rows, ends = [], [0]
                for raw, first, last in zip(raws, cuts, cuts[1:], strict=False):
                    rows += _stretches(raw, place[first:last].tolist(), h[first:last].view(np.int64).tolist(), gram, need)
                    ends.append(len(rows))
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                found = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([hashlib.sha256(r).digest()[:16] for r in raws], pa.binary()),
                        pa.array([len(r) for r in raws], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found),
                    ],
                    ["key", "size", "found"],
                )

    item = "struct<anchor: long, place: long, span: long, context: long, nl: smallint, nr: smallint>"
    return docs.select(F.col(text_column).alias("text")).mapInArrow(run, f"key binary, size long, found array<{item}>")


def contexts(docs: DataFrame, wanted: DataFrame, length: int, text_column: str, shorter: int | None = None) -> DataFrame:
    """(anchor, kinds, context, key, place, left, right): the bytes around each wanted place; left is reversed."""
    gram = gram_of(shorter or length)
    need = length - gram

    def run(batches):
        for b in batches:
            for lo, hi in text_batches(b.column(1)):
                part = b.slice(lo, hi - lo)
                row, named, left, right = [], [], [], []
                for i, (text, found) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    raw = (text or "").encode()
                    for f in found:
                        at = f["place"]
                        row.append(i)
                        named.append((f["anchor"], f["kinds"], f["context"], at))
                        left.append(raw[max(0, at - need) : at][::-1])
                        right.append(raw[at + gram : at + gram + need])
                    if len(row) > 20_000 or (row and i + 1 == part.num_rows):
                        anchor, kinds, context, place = (pa.array(c, pa.int64()) for c in zip(*named, strict=True))
                        keys = part.column(0).take(pa.array(row, pa.int64()))
                        yield pa.RecordBatch.from_arrays(
                            [anchor, kinds, context, keys, place, pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                            ["anchor", "kinds", "context", "key", "place", "left", "right"],
                        )
                        row, named, left, right = [], [], [], []

    # One row of each distinct text; its shuffle also serves the join.
    texts = docs.select(text_key(F.col(text_column)).alias("key"), F.col(text_column).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    kinds = "anchor long, kinds long, context long, key binary, place long, left binary, right binary"
    return texts.join(wanted, "key").select("key", "text", "found").mapInArrow(run, kinds)


def _groups(batches):
    """Whole groups of equal ``anchor`` from a partition sorted by it, many at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = np.asarray(b.column(0))
        cut_at = int(np.searchsorted(ids, ids[-1]))
        if held and (cut_at or ids[0] != np.asarray(held[-1].column(0))[-1]):
            whole = pa.Table.from_batches([*held, b.slice(0, cut_at)])
            yield whole
            held = [b.slice(cut_at)]
        elif cut_at:
            yield pa.Table.from_batches([b.slice(0, cut_at)])
            held = [b.slice(cut_at)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _by_tree(batches, needs: list[int], keep_first: bool):
    """(anchor, context, left0, right0, left1, ...): ``reaches`` of the contexts that repeat, null where one need is not met."""
    for t in _groups(batches):
        if not t.num_rows:
            continue
        ids, contexts_ = np.asarray(t.column("anchor")), np.asarray(t.column("context"))
        left, right = t.column("left").to_pylist(), t.column("right").to_pylist()
        order = list(zip(t.column("key").to_pylist(), t.column("place").to_pylist(), strict=True)) if keep_first else None
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]).tolist()
        at, sides = [], [[] for _ in range(2 * len(needs))]
        for lo, hi in zip(starts, [*starts[1:], len(ids)], strict=True):
            for i, *found in zip(range(lo, hi), *reaches(left[lo:hi], right[lo:hi], needs, order and order[lo:hi]), strict=True):
                if any(found):
                    at.append(i)
                    for to, value in zip(sides, (side for f in found for side in f or (None, None)), strict=True):
                        to.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[at], pa.int64()), pa.array(contexts_[at], pa.int64()), *[pa.array(v, pa.int64()) for v in sides]],
            ["anchor", "context", *_sides(needs)],
        )


def _sides(needs: list[int]) -> list[str]:
    return [f"{side}{i}" for i in range(len(needs)) for side in ("left", "right")]


#: Neighbouring windows of a large group that are first judged by what all of them share.
CELL = 16


def _cells(batches, needs: list[int]):
    """(member, kind, cell, core): the hash of the bytes that all windows of a cell share, per place and need.

    Window j takes j bytes to the left of the anchor and need - j to the right; cell c holds
    windows c * CELL up to the next cell.  A window can repeat only if its cell's core does.
    """
    for b in batches:
        member, kinds, cells, cores = [], [], [], []
        rows = zip(b.column("member").to_pylist(), b.column("anchor").to_pylist(), b.column("left").to_pylist(), b.column("right").to_pylist(), strict=True)
        for m, anchor, left, right in rows:
            for i, need in enumerate(needs):
                for c in range(need // CELL + 1):
                    low, high = c * CELL, min(need, (c + 1) * CELL - 1)
                    if len(left) >= low and len(right) >= need - high:
                        member.append(m)
                        kinds.append(i)
                        cells.append(c)
                        cores.append(xxh3_64_intdigest(b"%d:%d:%d:%b|%b" % (anchor, need, c, left[:low], right[: need - high])) - (1 << 63))
        columns = [pa.array(member, pa.int64()), pa.array(kinds, pa.int32()), pa.array(cells, pa.int32()), pa.array(cores, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["member", "kind", "cell", "core"])


def _windows(batches, needs: list[int]):
    """(member, kind, to_left, window) of the windows in the wanted cells of each place."""
    for b in batches:
        member, kinds, lefts, hashes = [], [], [], []
        rows = zip(b.column("member").to_pylist(), b.column("anchor").to_pylist(), b.column("left").to_pylist(), b.column("right").to_pylist(), b.column("cells").to_pylist(), strict=True)
        for m, anchor, left, right, cells in rows:
            for cell in cells:
                i, c = cell["kind"], cell["cell"]
                need = needs[i]
                for j in range(max(c * CELL, need - len(right)), min(need, len(left), (c + 1) * CELL - 1) + 1):
                    member.append(m)
                    kinds.append(i)
                    lefts.append(j)
                    hashes.append(xxh3_64_intdigest(b"%d:%d:%b|%b" % (anchor, j, left[:j], right[: need - j])) - (1 << 63))
        columns = [pa.array(member, pa.int64()), pa.array(kinds, pa.int32()), pa.array(lefts, pa.int32()), pa.array(hashes, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["member", "kind", "to_left", "window"])


def _by_windows(hot: DataFrame, needs: list[int], keep_first: bool, tables: Scratch) -> DataFrame:
    """``reaches`` of the contexts of anchors that have too many to collect: (anchor, context, left0, right0, left1, ...).

    Only a context's outermost repeated windows matter.  Cells whose core is unique hold none; all others
    are opened at once, for every need, so that the number of jobs and of their plans, which the driver holds, does not
    follow the data.  A cell is opened for every context that has its core, so counts are whole.  Where the
    first copy stays, members are numbered in the order of their places, and a window counts for all but the first that has it.
    """
    if keep_first:
        hot = hot.orderBy("key", "place")
    hot = tables.cut(hot.select("anchor", "context", "left", "right").withColumn("member", F.monotonically_increasing_id()), "hot")
    sides = hot.select("member", "anchor", "left", "right")
    cells = tables.cut(sides.mapInArrow(lambda b: _cells(b, needs), "member long, kind int, cell int, core long"), "cells")
    shared = cells.groupBy("core").agg(F.count("*").alias("_n")).where("_n > 1").select("core")
    opened = cells.join(shared, "core").groupBy("member").agg(F.collect_list(F.struct("kind", "cell")).alias("cells"))
    # contexts pack so well that their table looks small enough to be sent to all: both sides are sorted instead
    windows = sides.join(opened.hint("merge"), "member").mapInArrow(lambda b: _windows(b, needs), "member long, kind int, to_left int, window long")
    windows = tables.cut(windows, "windows")
    tables.drop("cells")
    twice = windows.groupBy("window").agg(F.count("*").alias("_n"), F.min("member").alias("_first")).where("_n > 1").select("window", "_first")
    hits = windows.join(twice, "window").where("member > _first" if keep_first else "true")
    ends = []
    for i, need in enumerate(needs):
        own = F.when(F.col("kind") == i, F.col("to_left").cast("long"))
        ends += [F.max(own).alias(f"left{i}"), (F.lit(need) - F.min(own)).alias(f"right{i}")]
    found = tables.cut(hits.groupBy("member").agg(*ends), "hits")
    tables.drop("windows")
    return hot.join(found.hint("merge"), "member").select("anchor", "context", *_sides(needs))


def _distinct_contexts(rows: DataFrame, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """(places, contexts): the places of repeated anchors, and each of these anchors' contexts with copies, first place and kinds.

    ``rows`` is a written table with a row number.
    """
    # One row per distinct text; equal texts have equal anchors.  Only keys of repeated texts are joined.
    numbered = rows.groupBy("key").agg(F.count("*").alias("_n"), F.min("number").alias("_least")).where("_n > 1").select("key", "_least")
    once = rows.where(F.size("found") > 0).join(numbered, "key", "left").where("_least IS NULL OR number = _least")
    each = once.select("key", F.inline("found"))
    repeated = each.groupBy("anchor").agg(F.sum("span").alias("n")).where("n > 1").select("anchor")
    places = tables.cut(each.join(repeated, "anchor", "left_semi"), "places")
    tables.drop("anchors")
    # Copies of a context are counted before anything of them is sent.
    contexts_ = places.groupBy("anchor", "context").agg(
        F.sum("span").alias("copies"), F.min(F.struct("key", "place")).alias("first"), F.first("nl").alias("nl"), F.first("nr").alias("nr")
    )
    contexts_ = tables.cut(contexts_, "counted")
    kinds = contexts_.groupBy("anchor").agg(F.count("*").alias("kinds"))
    repeated_ = tables.cut(contexts_.join(kinds, "anchor"), "repeated")
    tables.drop("counted")
    return places.select("key", "anchor", "place", "span", "context"), repeated_


def _numbered_rows(docs: DataFrame, length: int, text_column: str, tables: Scratch, shorter: int | None = None) -> DataFrame:
    """``anchor_rows`` as a written table with a number for each row."""
    return tables.cut(anchor_rows(docs, length, text_column, shorter).withColumn("number", F.monotonically_increasing_id()), "anchors")


def covered(
    docs: DataFrame,
    tables: Scratch,
    length: int = LENGTH,
    text_column: str = "text",
    group_rows: int = GROUP_ROWS,
    keep_first: bool = False,
    shorter: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(copies, spans): (key, size, copies) of each repeated text, and (key, kind, start, end) of repeated bytes; both read ``tables``.

    Spans of kind 0 are covered by repeats of ``length`` bytes, those of kind 1 by repeats of ``shorter`` bytes.
    """
    gram = gram_of(shorter or length)
    needs = [n - gram for n in (length, shorter) if n]
    rows = _numbered_rows(docs, length, text_column, tables, shorter)
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"), F.max("size").alias("size"))
    copies = tables.cut(copies.where("copies > 1"), "copies")
    each, repeated = _distinct_contexts(rows, tables)
    # A context that occurs twice repeats as a whole; different ones of an anchor are compared, one place of each.
    wanted = repeated.where("kinds > 1").groupBy("first.key").agg(F.collect_list(F.struct("anchor", "kinds", "context", "first.place")).alias("found"))
    around = contexts(docs, wanted, length, text_column, shorter)
    hot = repeated.where(F.col("kinds") > group_rows).limit(1).count() > 0
    if hot:
        around = tables.cut(around, "contexts")
    usual = around.where(F.col("kinds") <= group_rows).repartition("anchor").sortWithinPartitions("anchor")
    sides = ", ".join(f"{c} long" for c in _sides(needs))
    compared = usual.mapInArrow(lambda batches: _by_tree(batches, needs, keep_first), f"anchor long, context long, {sides}")
    if hot:
        compared = compared.unionByName(_by_windows(around.where(F.col("kinds") > group_rows), needs, keep_first, tables))
    enough = [(F.col("copies") > 1) & (F.col("nl") + F.col("nr") >= need) for need in needs]
    judged = repeated.select("anchor", "context", "first", "nl", "nr", *[e.alias(f"whole{i}") for i, e in enumerate(enough)])
    # the shortest need is the first to be met
    last = len(needs) - 1
    judged = judged.join(compared, ["anchor", "context"], "left").where(f"whole{last} OR left{last} IS NOT NULL")
    marked = each.join(judged, ["anchor", "context"])
    nl, nr, place = F.col("nl").cast("long"), F.col("nr").cast("long"), F.col("place")
    own = F.struct("key", "place") == F.col("first")

    def found(i: int) -> Column:
        whole, left, right = F.col(f"whole{i}"), F.col(f"left{i}"), F.col(f"right{i}")

        def stretch(first: Column, to_left: Column, to_right: Column, span: Column) -> Column:
            return F.struct(F.lit(i).alias("kind"), (first - to_left).alias("start"), (place + span - 1 + gram + to_right).alias("end"))

        full = stretch(place, nl, nr, F.col("span"))
        if not keep_first:
            return F.array(F.when(whole, full).when(left.isNotNull(), stretch(place, left, right, F.col("span"))))
        # The first place of a context is repeated only as far as an earlier context goes; the rest of its run is a copy.
        rest = F.when(whole & (F.col("span") > 1), stretch(place + 1, nl, nr, F.col("span")))
        only = F.when(left.isNotNull(), stretch(place, left, right, F.lit(1)))
        none = F.array().cast("array<struct<kind: int, start: long, end: long>>")
        return F.when(own, F.array(only, rest)).when(whole, F.array(full)).otherwise(none)

    return copies, marked.select("key", F.inline(F.array_compact(F.concat(*[found(i) for i in range(len(needs))]))))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for s in sorted((s["start"], s["end"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def _finish(docs: DataFrame, length: int, id_column: str, text_column: str, keep: list[str], digest: bool, group_rows: int, keep_first: bool = False, shorter: int | None = None):
    """The rows of ``docs`` with what is left of each text."""
    tables = Scratch(docs.sparkSession)
    copies, spans = covered(docs, tables, length, text_column, group_rows, keep_first, shorter)
    per_text = spans.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_spans"))
    # Equal texts of ``length`` bytes or more lose everything, or all but those of the smallest id do.
    whole = copies.where(F.col("size") >= (shorter or length)).select("key", F.lit(True).alias("_whole"))
    if keep_first:
        ids = docs.select(text_key(F.col(text_column)).alias("key"), F.col(id_column).alias("_id")).groupBy("key").agg(F.min("_id").alias("_least"))
        whole = whole.join(ids, "key")
    removed = cut(per_text.join(whole, "key", "full"), "spans")
    tables.drop()  # only the spans are read from here on
    # Numbered names inside, so that columns of any name pass through.
    outside = [id_column, *keep]
    names = [f"_c{i}" for i in range(len(outside))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(outside, names, strict=True)], F.col(text_column).alias("_text"), text_key(F.col(text_column)).alias("key"))
    gone = F.col("_whole") & ~F.col("_c0").eqNullSafe(F.col("_least")) if keep_first else F.col("_whole")
    joined = rows.join(removed, "key", "left").select(*names, "_text", "_spans", gone.alias("_whole"))
    types = [docs.schema[c].dataType.simpleString() for c in outside]

    def run(batches):
        for b in slices(batches, len(names)):
            n = [[], [], [], [], []]
            passages = [[], [], []]
            left = []  # a character that a cut leaves in part goes as a whole
            for text, found, all_ in zip(b.column("_text").to_pylist(), b.column("_spans").to_pylist(), b.column("_whole").to_pylist(), strict=True):
                raw = (text or "").encode()
                runs = [(0, len(raw))] if all_ and len(raw) >= length else merged([s for s in found or [] if s["kind"] == 0])
                kept, at = [], 0
                for start, end in runs:
                    kept.append(raw[at:start])
                    at = end
                rest = b"".join([*kept, raw[at:]]) if runs else raw
                if digest:
                    for to, value in zip(n, (len(raw), len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), [{"start": a, "end": e} for a, e in runs]), strict=True):
                        to.append(value)
                if shorter:
                    runs_ = [(0, len(raw))] if all_ else merged([s for s in found or [] if s["kind"] == 1])
                    for to, value in zip(passages, (sum(e - a for a, e in runs_), len(runs_), [{"start": a, "end": e} for a, e in runs_]), strict=True):
                        to.append(value)
                left.append(rest.decode("utf-8", "ignore") if runs or digest else text)
            head = [b.column(i) for i in range(len(names))]
            if digest:
                ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), ranges]
                values = [*[pa.array(v, k) for v, k in zip(n, kinds, strict=True)], pa.array(left, pa.string())]
                if shorter:
                    values += [pa.array(v, k) for v, k in zip(passages, (pa.int64(), pa.int64(), ranges), strict=True)]
                yield pa.RecordBatch.from_arrays([*head, *values], [*names, *measures])
            else:
                yield pa.RecordBatch.from_arrays([*head, pa.array(left, pa.string())], [*names, "_left"])

    head = ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))
    ranges = "array<struct<start: long, end: long>>"
    measures = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "spans": ranges, "text": "string"}
    if shorter:
        measures |= {"n_passage_bytes": "long", "n_passages": "long", "passages": ranges}
    tail = ", ".join(f"{n} {t}" for n, t in measures.items()) if digest else "_left string"
    out = joined.mapInArrow(run, f"{head}, {tail}")
    return out.select(*[F.col(n).alias(c) for c, n in zip(outside, names, strict=True)], *[c for c in out.columns if c not in names])


def repeated_bytes(
    docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", group_rows: int = GROUP_ROWS, shorter: int | None = None
) -> DataFrame:
    """Per row: size, bytes covered by repeats of ``length`` bytes, their maximal runs, the digest of the rest, the rest as text.

    With ``shorter``, also the bytes covered by repeats of ``shorter`` bytes and their maximal runs, which stay in the text.
    """
    if shorter is not None and not 1 < shorter <= length:
        raise ValueError("the shorter length is between 2 and the length")
    return _finish(docs, length, id_column, text_column, [], True, group_rows, shorter=shorter)


def without_repeats(
    docs: DataFrame, length: int = LENGTH, text_column: str = "text", group_rows: int = GROUP_ROWS, keep_first: bool = False
) -> DataFrame:
    """The same rows and columns with repeated bytes taken out of the text; with ``keep_first`` one copy stays.

    A character that a cut leaves in part goes as a whole.  The first column other than the text is the id.
    """
    first, *keep = [c for c in docs.columns if c != text_column]
    rest = _finish(docs, length, first, text_column, keep, False, group_rows, keep_first)
    return rest.select(*[F.col("_left").alias(c) if c == text_column else F.col(c) for c in docs.columns])


def repeat_groups(docs: DataFrame, length: int = LENGTH, text_column: str = "text") -> DataFrame:
    """(anchor, to_left, size, group, key, start, span) of every place of every maximal repeat.

    Rows with equal (anchor, to_left, size, group) are the places of one repeat; ``key`` names the text (``text_key``) and ``span``
    counts neighbouring starts, more than one in a run of one byte.  Places with equal contexts share every repeat: they are
    compared as one and joined back as rows.  A repeat longer than twice ``length`` shows once per anchor
    in it, with the extent visible from there.
    """
    gram = gram_of(length)
    need = length - gram
    tables = Scratch(docs.sparkSession)
    each, repeated = _distinct_contexts(_numbered_rows(docs, length, text_column, tables), tables)
    wanted = repeated.where("kinds > 1").groupBy("first.key").agg(F.collect_list(F.struct("anchor", "kinds", "context", "first.place")).alias("found"))
    around = contexts(docs, wanted, length, text_column).repartition("anchor").sortWithinPartitions("anchor")

    def run(batches):
        for t in _groups(batches):
            ids, named = np.asarray(t.column("anchor")), np.asarray(t.column("context"))
            left, right = t.column("left").to_pylist(), t.column("right").to_pylist()
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]).tolist() if len(ids) else []
            out = [[], [], [], [], []]
            for lo, hi in zip(starts, [*starts[1:], len(ids)], strict=True):
                for to_left, to_right, members in maximal_repeats(left[lo:hi], right[lo:hi], need):
                    for m in members:
                        for to, value in zip(out, (ids[lo], to_left, to_right, named[lo + members[0]], named[lo + m]), strict=True):
                            to.append(int(value))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["anchor", "to_left", "to_right", "group", "context"])

    several = around.mapInArrow(run, "anchor long, to_left long, to_right long, group long, context long")
    alone = repeated.where((F.col("copies") > 1) & (F.col("nl") + F.col("nr") >= need)).select(
        "anchor", F.col("nl").cast("long").alias("to_left"), F.col("nr").cast("long").alias("to_right"), F.col("context").alias("group"), "context"
    )
    # a context that another one continues is in that repeat already
    several = cut(several, "several")
    alone = alone.join(several, ["anchor", "to_left", "to_right", "context"], "left_anti")
    groups = several.unionByName(alone).join(each.select("anchor", "context", "key", "place", "span"), ["anchor", "context"])
    size = F.col("to_left") + gram + F.col("to_right")
    return groups.select("anchor", "to_left", size.alias("size"), "group", "key", (F.col("place") - F.col("to_left")).alias("start"), "span")
