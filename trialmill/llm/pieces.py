"""SentencePiece BPE: vectorised merge rounds and an offset-table decoder.

A text is read as words: a run of word marks (each blank is one) and what follows up to the next
mark.  No piece of such a vocabulary holds a mark behind another character, so no merge crosses
a word's start and every distinct word is encoded once a batch.

All words of a batch stand in flat numpy arrays, one symbol a character.  A round takes the
lowest pair rank of each word, merges all its places at once, the leftmost first where places
overlap, and compacts the arrays; words without a pair leave.  This is the library's order of
merges except where a merge opens a pair that ranks no later than the merge itself and
further places of the word wait: such a word merges its leftmost place alone in that round.

Two things keep the rounds few.  Where two neighbouring symbols stand side by side in no piece,
nothing ever merges across, so a long word is cut there as it goes.  A long run of blanks
is cut into the chunks that leftmost merging gives.  Both are exact.

Decoding gathers piece bytes from one buffer through a table of offsets.

Defined results: null text counts as empty (no ids, decoded text empty).  Characters that are no
piece become their bytes' pieces.  Control strings inside a text are plain text.  Repeated
rows and ids give repeated results; extra columns are ignored.  The vocabulary must be of
the BPE kind with byte pieces, a dummy prefix and no character map; another one is refused.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MARK = "▁"
#: Words of one generation in a worker's memory; longer words than ``KEPT_CHARS`` are not remembered.
CACHE_WORDS = 400_000
KEPT_CHARS = 64
#: Words of a text that are looked up at a time.
TEXT_WORDS = 200_000
#: Symbols from which a word is cut at neighbours that no piece holds.
LONG = 192
_NEVER = np.iinfo(np.int64).max
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

# The piece types of the model file format.
NORMAL, USER_DEFINED, BYTE, UNUSED = 1, 4, 6, 5


def _words(text: str):
    """The words of a text in stretches, which bounds what a very long text holds in memory."""
    if len(text) <= TEXT_WORDS:
        yield _WORD.findall(text)
        return
    found = _WORD.finditer(text)
    while words := [m.group() for m in islice(found, TEXT_WORDS)]:
        yield words


class _Memory:
    """Encoded words in two generations: a full young one becomes the old one, and words used again move back."""

    def __init__(self, limit: int = CACHE_WORDS):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, words: set[str]) -> list[str]:
        """The words not yet encoded; all others are in the young generation afterwards."""
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = []
        for word in words:
            if word not in young:
                found = old.get(word)
                if found is None:
                    out.append(word)
                else:
                    young[word] = found
        return out


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece.sentencepiece_model_pb2 as model_format

        model = model_format.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if (
            model.trainer_spec.model_type != 2
            or not model.trainer_spec.byte_fallback
            or rules.precompiled_charsmap
            or not rules.add_dummy_prefix
            or rules.remove_extra_whitespaces
            or kinds & {USER_DEFINED, UNUSED}
        ):
            raise ValueError(f"not a plain byte-fallback BPE model: {path}")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError(f"a piece holds a word mark inside: {path}")
        self.n = len(model.pieces)
        score = {p: model.pieces[i].score for p, i in self.ids.items()}
        # Equal scores are equal ranks.
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.symbol = np.full(0x110000, -1, np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        # Every way to put a piece together from two.
        made = []
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    made.append((a * self.n + b, order[score[piece]], i))
        table = np.array(sorted(made) or [(-1, 0, 0)], np.int64)
        self._pairs, self._ranks, self._wholes = (np.ascontiguousarray(c) for c in table.T)
        self._side_by_side = None
        self._byte = np.zeros(256, np.uint32)
        surface = [b""] * self.n
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                value = int(p.piece[1:-1], 16)
                self._byte[value] = i
                surface[i] = bytes([value])
            elif p.type == NORMAL:
                surface[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == 2:
                surface[i] = model.trainer_spec.unk_surface.encode()
        self._is_byte = np.array([p.type == BYTE for p in model.pieces])
        self.offsets = np.zeros(self.n + 1, np.int64)
        np.cumsum([len(s) for s in surface], out=self.offsets[1:])
        self.buffer = np.frombuffer(b"".join(surface), np.uint8)
        self.decimal = [str(i) for i in range(self.n)]
        self._memory = _Memory()
        self._run = self._blank_chunk(order, score)

    def _blank_chunk(self, order: dict[float, int], score: dict[str, float]) -> int:
        """Length of the chunks that a long run of blanks ends in, or 0 where runs are not cut.

        Runs are cut only if all their pieces share the last rank and no other piece begins with two marks:
        then a run is merged after everything else, from the left, and its first chunk
        depends on nothing that follows a few chunks later.
        """
        runs = [p for p in self.ids if not p.strip(MARK)]
        longest = max(map(len, runs), default=0)
        last = len(order) - 1
        if longest < 2 or any(order[score[p]] != last for p in runs) or any(p.startswith(MARK * 2) for p in self.ids if p.strip(MARK)):
            return 0
        sizes = self._merge_words([MARK * (longest * n) for n in (4, 5)])
        head = [[self._size(i) for i in np.frombuffer(ids, "<u4")[:2]] for ids in sizes]
        same = head[0][0] == head[0][1] == head[1][0] == head[1][1]
        return head[0][0] if same else 0

    def _size(self, piece: int) -> int:
        return int(self.offsets[piece + 1] - self.offsets[piece])

    # Encoding

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of neighbours; rank ``_NEVER`` where no piece is made of the two."""
        key = left * self.n + right
        at = np.searchsorted(self._pairs, key)
        at[at == len(self._pairs)] = 0
        hit = (self._pairs[at] == key) & (left < self.n) & (right < self.n)
        return np.where(hit, self._ranks[at], _NEVER), self._wholes[at]

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where no piece holds the two symbols side by side: no merge ever crosses such a place."""
        if self._side_by_side is None:
            keys = set()
            for piece in self.ids:
                for i in range(len(piece)):
                    for j in range(i + 2, len(piece) + 1):
                        for k in range(i + 1, j):
                            a, b = self.ids.get(piece[i:k]), self.ids.get(piece[k:j])
                            if a is not None and b is not None:
                                keys.add(a * self.n + b)
            self._side_by_side = np.array(sorted(keys), np.int64)
        key = left * self.n + right
        at = np.searchsorted(self._side_by_side, key)
        at[at == len(self._side_by_side)] = 0
        return (self._side_by_side[at] != key) | (left >= self.n) | (right >= self.n)

    def _rounds(self, sym: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, place of each symbol's first character) after all merges.

        ``ends`` marks the last symbol of each word.
        """
        start = np.arange(len(sym))
        ends = ends.copy()
        rank, whole = np.full(len(sym), _NEVER), np.zeros(len(sym), np.int64)

        def renew(at: np.ndarray) -> None:
            """Read the pairs (at, at + 1) anew."""
            rank[at] = _NEVER
            at = at[~ends[at]]
            rank[at], whole[at] = self._lookup(sym[at], sym[at + 1])

        def cut_long(at: np.ndarray) -> None:
            """Ends long words between symbols that no piece holds side by side."""
            first, size = segments()
            long = np.repeat(size >= LONG, size)
            at = at[long[at] & ~ends[at]]
            if len(at):
                gap = at[self._apart(sym[at], sym[at + 1])]
                ends[gap] = True
                rank[gap] = _NEVER

        def segments() -> tuple[np.ndarray, np.ndarray]:
            last = np.flatnonzero(ends)
            first = np.concatenate([[0], last[:-1] + 1])
            return first, last + 1 - first

        done: list[tuple[np.ndarray, np.ndarray]] = []
        everything = np.arange(len(sym))
        renew(everything)
        cut_long(everything)
        while len(sym):
            first, size = segments()
            low = np.repeat(np.minimum.reduceat(rank, first), size)
            going = low != _NEVER
            if not going.all():
                done.append((sym[~going], start[~going]))
                sym, start, ends, rank, whole, low = (x[going] for x in (sym, start, ends, rank, whole, low))
                if not len(sym):
                    break
                first, size = segments()
            place = np.flatnonzero(rank == low)
            # In a run of overlapping places every second one counts, from the run's start.
            opens = np.concatenate([[True], np.diff(place) != 1])
            behind = np.arange(len(place)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
            place = place[behind % 2 == 0]
            word = np.searchsorted(first, place, "right") - 1
            several = np.bincount(word, minlength=len(first))[word] > 1
            if several.any():
                place = self._in_order(sym, ends, low, whole, place, word, several)
            sym[place] = whole[place]
            ends[place] = ends[place + 1]
            stays = np.ones(len(sym), bool)
            stays[place + 1] = False
            sym, start, ends, rank, whole = (x[stays] for x in (sym, start, ends, rank, whole))
            new = place - np.arange(len(place))
            before = new[new > 0] - 1
            changed = np.zeros(len(sym), bool)
            changed[new] = True
            changed[before[~ends[before]]] = True
            touched = np.flatnonzero(changed)
            renew(touched)
            if size.max() >= LONG:
                cut_long(touched)
        if not done:
            return sym, start
        sym, start = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(start, kind="stable")
        return sym[order], start[order]

    def _in_order(self, sym, ends, low, whole, place, word, several) -> np.ndarray:
        """The places that may be merged at once.

        Merging a word's places from left to right is what one merge after another gives as long as no pair opened
        by a merge (with the left neighbour as merged, or the right one as yet unmerged) has the word's
        rank or a lower one.  Where one has, the word keeps its leftmost place only.
        """
        at = place[several]
        merged = np.full(len(sym), -1, np.int64)
        merged[place] = whole[place]
        bad = np.zeros(len(at), bool)
        left = np.flatnonzero((at > 0) & ~ends[np.maximum(at - 1, 0)])
        p = at[left]
        by_merge = (p > 1) & (merged[np.maximum(p - 2, 0)] >= 0) & ~ends[np.maximum(p - 2, 0)]
        neighbour = np.where(by_merge, merged[np.maximum(p - 2, 0)], sym[p - 1])
        bad[left] |= self._lookup(neighbour, whole[p])[0] <= low[p]
        right = np.flatnonzero(~ends[at + 1])
        p = at[right]
        bad[right] |= self._lookup(whole[p], sym[p + 2])[0] <= low[p]
        if not bad.any():
            return place
        alone = np.isin(word, np.unique(word[several][bad]))
        leftmost = np.concatenate([[True], word[1:] != word[:-1]])
        return place[~alone | leftmost]

    def _merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.array([len(w) for w in words])
        stops = np.cumsum(sizes)
        sym = self.symbol[points]
        sym = np.where(sym < 0, self.n + points, sym)
        ends = np.zeros(len(sym), bool)
        ends[stops - 1] = True
        sym, start = self._rounds(sym, ends)
        cuts = np.searchsorted(start, stops)
        unknown = np.flatnonzero(sym >= self.n)
        if len(unknown):
            raw = [chr(c).encode() for c in (sym[unknown] - self.n).tolist()]
            width = np.ones(len(sym), np.int64)
            width[unknown] = [len(r) for r in raw]
            grown = np.repeat(sym, width)
            grown[np.repeat(sym >= self.n, width)] = self._byte[np.frombuffer(b"".join(raw), np.uint8)]
            cuts = np.concatenate([[0], np.cumsum(width)])[cuts]
            sym = grown
        ids, cuts = sym.astype("<u4").tobytes(), (4 * cuts).tolist()
        return [ids[lo:hi] for lo, hi in zip([0, *cuts], cuts, strict=False)]

    def _shortened(self, word: str) -> tuple[int, str]:
        """How many whole chunks of blanks a word starts with, and the rest."""
        if self._run and word.startswith(MARK * (self._run * 4)):
            blanks = len(word) - len(word.lstrip(MARK))
            chunks = blanks // self._run - 3
            return chunks, word[chunks * self._run :]
        return 0, word

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit numbers."""
        out = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        held = 0

        def flush() -> None:
            found = {}
            missing = self._memory.missing(set().union(*(w for _, w in waiting))) if waiting else []
            if missing:
                cut = [self._shortened(w) for w in missing]
                for word, (chunks, _), ids in zip(missing, cut, self._merge_words([w for _, w in cut]), strict=True):
                    if chunks:
                        ids = np.full(chunks, self.ids[MARK * self._run], "<u4").tobytes() + ids
                    (self._memory.young if len(word) <= KEPT_CHARS else found)[word] = ids
            young = self._memory.young
            for at, words in waiting:
                if found:
                    out[at].append(b"".join([found.get(w) or young[w] for w in words]))
                else:
                    out[at].append(b"".join(map(young.__getitem__, words)))
            waiting.clear()

        for at, text in enumerate(texts):
            if not text:
                continue
            for words in _words(MARK + text.replace(" ", MARK)):
                waiting.append((at, words))
                held += len(words)
                if held >= TEXT_WORDS:
                    flush()
                    held = 0
        flush()
        return [b"".join(parts) for parts in out]

    # Decoding

    def decode(self, ids: bytes) -> bytes:
        """The text, in UTF-8, of little-endian 32-bit ids."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        out = []
        for k in range(0, len(tokens), 65_536):  # bounds the index arrays of one very long text
            part = tokens[k : k + 65_536]
            starts = self.offsets[part]
            sizes = self.offsets[part + 1] - starts
            ends = np.cumsum(sizes)
            index = np.arange(int(ends[-1]), dtype=np.int64) + np.repeat(starts - ends + sizes, sizes)
            out.append(self.buffer[index].tobytes())
        text = b"".join(out)
        # The dummy prefix: the first piece with a text gives up one blank, unless bytes come before it.
        if text.startswith(b" ") and not self._is_byte[tokens[np.argmax(self.offsets[tokens + 1] > self.offsets[tokens])]]:
            text = text[1:]
        try:
            text.decode()
        except UnicodeDecodeError:
            text = _repaired(text)
        return text


def _repaired(text: bytes) -> bytes:
    """Each byte that starts no valid character becomes a replacement character of its own."""
    out, at = [], 0
    while at < len(text):
        try:
            text[at:].decode()
            out.append(text[at:])
            break
        except UnicodeDecodeError as e:
            out += [text[at : at + e.start], "�".encode()]
            at += e.start + 1
    return b"".join(out)


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The codec of a model file, built once in each Python worker."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids binary): the piece ids of each whole text, little-endian 32-bit."""

    def run(batches):
        c = codec(path)
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.encode_batch(b.column(1).to_pylist()), pa.binary())], ["id", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return plain.mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_column)


def decode(df: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, text): the text of each row's ids; null ids count as none."""

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [c.decode(i or b"").decode() for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = df.schema[id_column].dataType.simpleString()
    plain = df.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids"))
    return plain.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id count, sha256 of the decimal ids, sha256 of the decoded text.  No shuffle."""

    def run(batches):
        c = codec(path)
        for b in slices(batches, 1):
            n, first, second = [], [], []
            for ids in c.encode_batch(b.column(1).to_pylist()):
                numbers = np.frombuffer(ids, "<u4").tolist()
                n.append(len(numbers))
                first.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, numbers)).encode()).hexdigest())
                second.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return plain.mapInArrow(run, schema).withColumnRenamed("id", id_column)
