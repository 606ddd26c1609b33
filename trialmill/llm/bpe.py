"""Byte-level BPE: backtracking encoder and offset-table decoder.

Encoding takes the longest vocabulary token at a position (all matches come from one
Aho-Corasick pass) and accepts it only if it may follow the token before it.  Two tokens
may stand side by side exactly when merging their joint text by rank gives these two
tokens back; that is read from the merge table and remembered per pair.  If no token
fits, the encoder steps back by one token and takes its next shorter prefix.  A position
found impossible is never tried again, so the work is linear in the text and the ids are
those of the rank-by-rank merge.

Decoding gathers token bytes from one buffer through a table of offsets.

Defined results: null text counts as empty (no ids, decoded text empty).  A special
token's string inside a text is the special id, as the tokenizers library reads it.
Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import slices

#: Words of one generation in a worker's memory of encoded words.
CACHE_WORDS = 400_000
#: Pairs of tokens that a worker remembers.
CACHE_PAIRS = 500_000
#: Longest word that is remembered by ``LibraryIds``, new words that one call of the library takes, and longest stretch that it takes.
REMEMBERED, CALL_WORDS, LONGEST = 64, 10_000, 100_000
#: Short words that stand in one string.
TOGETHER = 200
#: Ids of one generation in the memory of ``LibraryIds``, and words whose ids are gathered at a time.
CACHE_IDS, GATHERED = 8_000_000, 500_000

# The split pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A single blank between two visible characters always starts a new pretoken.
_SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Remembers what ``make`` gives for a word.

    Two generations: when the young one is full it becomes the old one, and words used
    again move back, so rare words fall out and memory stays bounded.
    """

    def __init__(self, make, limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        found = self.old.pop(word, self)
        self[word] = found = self.make(word) if found is self else found
        return found


class Codec:
    """Encoder and decoder of one vocabulary file."""

    _NONE = (1 << 20) - 1

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        to_char = byte_alphabet()
        to_byte = {c: b for b, c in to_char.items()}
        self._latin = str.maketrans({chr(b): c for b, c in to_char.items()})
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._pattern = regex.compile(PATTERN)
        self.vocab = vocab
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        # Parts of each token and its merge rank; single bytes have no parts and come first.
        self.rank = dict.fromkeys(vocab.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.joins: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            whole = vocab[a + b]
            self.joins[vocab[a], vocab[b]] = whole
            if self.rank[whole] < 0:
                self.rank[whole] = r
                self.parts[whole] = (vocab[a], vocab[b])
        self._fits: dict[int, bool] = {}
        automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            automaton.add_word(token, i)
        automaton.make_automaton()
        self._automaton = automaton
        n_ids = max([*vocab.values(), *self.added.values()]) + 1
        self.size = [0] * n_ids
        # The longest token that is a proper prefix of a token, or -1.
        self.shorter = [-1] * n_ids
        for token, i in vocab.items():
            self.size[i] = len(token)
            self.shorter[i] = next((vocab[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in vocab), -1)
        pieces = [b""] * n_ids
        for token, i in vocab.items():
            pieces[i] = bytes(to_byte[c] for c in token)
        for token, i in self.added.items():
            pieces[i] = token.encode()
        self.offsets = np.zeros(n_ids + 1, np.int64)
        np.cumsum([len(p) for p in pieces], out=self.offsets[1:])
        self.buffer = np.frombuffer(b"".join(pieces), np.uint8)
        self.decimal = [str(i) for i in range(n_ids)]
        self._pieces = _Words(self._encode_pretoken, 100_000)
        self._packed = [i.to_bytes(4, "little") for i in range(n_ids)]
        self._space = to_char[32]
        self._blank = _Words(self._after_blank)

    # Encoding

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the joint text of ``a`` and ``b`` ends in exactly these two tokens.

        Undo the merges of both tokens from the latest back.  If, before some merge of
        either side, the facing inner tokens could be joined by an earlier merge, that
        join would have come first.
        """
        rank, parts, joins = self.rank, self.parts, self.joins
        left, right, answer = a, b, True
        # Merges of rank below ``before_cross`` are done while left and right face each other.
        limit = len(joins)
        while True:
            joined = joins.get((left, right))
            if joined is not None and rank[joined] < limit:
                answer = False
                break
            left_parts, right_parts = parts.get(left), parts.get(right)
            if left_parts is None and right_parts is None:
                break
            # A tie (the same merge on both sides) is done left to right: the right side is undone first.
            if right_parts is None or (left_parts is not None and rank[left] > rank[right]):
                limit = rank[left]
                left = left_parts[1]
            else:
                limit = rank[right] + 1
                right = right_parts[0]
        return answer

    def _encode_pretoken(self, text: str) -> list[int]:
        """Ids of one pretoken, already in the vocabulary's alphabet."""
        whole = self.vocab.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        sizes, known, shorter = self.size, self._fits, self.shorter
        longest = [0] * n
        at = [0] * n
        for end, token in self._automaton.iter(text):
            size = sizes[token]
            start = end - size + 1
            if size > longest[start]:
                longest[start], at[start] = size, token
        possible = bytearray(b"\x01") * (n + 1)
        tokens = [self._NONE]
        position, token = 0, at[0]
        while True:
            last = tokens[-1]
            while token >= 0:
                end = position + sizes[token]
                if possible[end]:
                    pair = last << 20 | token
                    fit = known.get(pair)
                    if fit is None:
                        if len(known) >= CACHE_PAIRS:
                            known.clear()
                        fit = known[pair] = last == self._NONE or self.fits(last, token)
                    if fit:
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                position = end
                if position == n:
                    del tokens[0]
                    return tokens
                token = at[position]
            else:
                possible[position] = 0
                token = tokens.pop()
                position -= sizes[token]
                token = shorter[token]

    def _split_encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a stretch that starts and ends at a pretoken's border."""
        ids: list[int] = []
        for piece in self._pattern.findall(text):
            ids += self._pieces[piece.encode().decode("latin-1").translate(self._latin)]
        return b"".join(map(self._packed.__getitem__, ids))

    def _after_blank(self, word: str) -> bytes | None:
        """Ids of a blank and a word, or None where the blank may belong to a longer run of white space.

        A word of letters alone is one pretoken, and so is what a last mark leaves.
        """
        body, mark = word, ""
        if not word.isalpha():
            if word.strip() != word or not word:
                return None
            body, mark = word[:-1], word[-1:]
            if mark not in ",.;:!?" or not body.isalpha():
                return self._split_encode(" " + word)
        if not body.isascii():
            body = body.encode().decode("latin-1").translate(self._latin)
        ids = self._encode_pretoken(self._space + body)
        if mark:
            ids = ids + self._pieces[mark]
        return b"".join(map(self._packed.__getitem__, ids))

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, *words = text.split(" ")
        if first and first.strip() == first:
            found = list(map(self._blank.__getitem__, words))
            if None not in found:
                return self._split_encode(first) + b"".join(found)
        # Runs of white space: cut only where a single blank stands between two visible characters.
        first, *words = _SAFE_BLANK.split(text)
        return self._split_encode(first) + b"".join([self._blank[w] or self._split_encode(" " + w) for w in words])

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self._added is None or not any(t in text for t in self.added):
            return self._plain(text)
        out = []
        for part in self._added.split(text):
            if part in self.added:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            else:
                out.append(self._plain(part))
        return b"".join(out)

    # Decoding

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids; broken UTF-8 becomes replacement characters."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        out = []
        for k in range(0, len(tokens), 65_536):  # bounds the index arrays of one very long text
            part = tokens[k : k + 65_536]
            starts = self.offsets[part]
            sizes = self.offsets[part + 1] - starts
            ends = np.cumsum(sizes)
            index = np.arange(int(ends[-1]), dtype=np.int64) + np.repeat(starts - ends + sizes, sizes)
            out.append(self.buffer[index].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, built once in each Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


class _Memory:
    """Numbers of known words, and their ids one after the other."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.upto = np.zeros(1, np.int64)  # where the ids of each number start, and where the last ones end
        self.ids = np.zeros(0, "<u4")

    def add(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        first = len(self.upto) - 1
        self.number.update(zip(words, range(first, first + len(words)), strict=True))
        self.upto = np.concatenate([self.upto, self.upto[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])

    def numbers(self, words: list[str]) -> np.ndarray:
        """-1 for a word that is not known."""
        if not self.number:
            return np.full(len(words), -1)
        return np.fromiter(map(self.number.get, words, itertools.repeat(-1)), np.int64, len(words))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of these words has (none if not known), and all their ids in a row."""
        known = numbers >= 0
        starts = self.upto[numbers] * known
        sizes = (self.upto[numbers + 1] - starts) * known
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)
        return sizes, self.ids[at]


class LibraryIds:
    """Ids by the ``tokenizers`` library, which is given each word once and not each time it occurs.

    Texts are cut at single blanks between visible characters, where a pretoken starts in any case.  What a blank and a
    word become is remembered, in two generations as in ``_Words``; the new words of all texts of a call go to the library
    together, in strings of many, whose ids part where a token starts with a blank.  Arrow parts the texts and numbers their
    different words, so Python looks up each of these once a call; ids are gathered from one array.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self._path, self._library = path, Tokenizer.from_file(path)
        self._library.no_padding()
        self._library.no_truncation()
        added = {t.content: i for i, t in self._library.get_added_tokens_decoder().items()}
        self._added = {t: i.to_bytes(4, "little") for t, i in added.items()}
        self._cuts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        vocab = self._library.get_vocab()
        blank = byte_alphabet()[32]
        self._blank = np.zeros(max(vocab.values()) + 1, bool)
        self._blank[[i for t, i in vocab.items() if t[0] == blank and t not in added]] = True
        # Only words without a blank may stand in one string; no added token may span two of them.
        self._together = not any(" " in t for t in added)
        self._known, self._old = _Memory(), _Memory()
        self._long: list[str] = []

    def _ids(self, stretches: list[str]) -> list[bytes]:
        """Ids of stretches that start and end at a pretoken's border; very long ones in the codec, which holds less of them."""
        out = []
        for k in range(0, len(stretches), CALL_WORDS):
            part = stretches[k : k + CALL_WORDS]
            found = self._library.encode_batch_fast([s if len(s) <= LONGEST else "" for s in part], add_special_tokens=False)
            out += [np.array(e.ids, "<u4").tobytes() if len(s) <= LONGEST else codec(self._path).encode(s) for s, e in zip(part, found, strict=True)]
        return out

    def _add(self, words: list[str]) -> None:
        """Remembers a blank and each of these words, one by one."""
        ids = self._ids([" " + w for w in words])
        self._known.add(words, np.array([len(i) // 4 for i in ids], np.int64), np.frombuffer(b"".join(ids), "<u4"))

    def _add_together(self, words: list[str]) -> None:
        """As ``_add``, for short words without blanks, which the library is given in one string."""
        for lo in range(0, len(words), CALL_WORDS):
            groups = [words[k : k + TOGETHER] for k in range(lo, min(lo + CALL_WORDS, len(words)), TOGETHER)]
            found = self._library.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)
            ids = np.fromiter(itertools.chain.from_iterable([e.ids for e in found]), "<u4")
            starts = np.flatnonzero(self._blank[ids])
            part = words[lo : lo + CALL_WORDS]
            if len(starts) == len(part) and starts[0] == 0:
                self._known.add(part, np.diff(starts, append=len(ids)), ids)
            else:
                self._add(part)

    def _learn(self, words: list[str]) -> np.ndarray:
        """Numbers of a blank and each word, now remembered; -1 where the blank may belong to a longer run of white space."""
        numbers = self._old.numbers(words)
        again = np.flatnonzero(numbers >= 0)
        new = [i for i in np.flatnonzero(numbers < 0).tolist() if (w := words[i]) and w.strip() == w]
        short = [i for i in new if len(words[i]) <= REMEMBERED and self._together and " " not in words[i]]
        done = set(short)
        other = [i for i in new if i not in done] if len(short) < len(new) else []
        order = [*again.tolist(), *short, *other]
        first = len(self._known.upto) - 1
        self._known.add([words[i] for i in again.tolist()], *self._old.take(numbers[again]))
        self._add_together([words[i] for i in short])
        if other:
            self._add([words[i] for i in other])
            self._long += [words[i] for i in other if len(words[i]) > REMEMBERED]
        numbers[order] = first + np.arange(len(order))
        return numbers

    def _joined(self, words: pa.Array, sizes: np.ndarray, skipped: int = 0) -> list[bytes | None]:
        """Ids of the words of each text but for its first ``skipped`` ones, None where a word cannot be remembered."""
        upto = np.r_[0, np.cumsum(sizes)]
        coded = words.dictionary_encode()
        codes, different = np.asarray(coded.indices), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        wanted = np.ones(len(codes), bool)
        if skipped:
            wanted[upto[:-1][sizes > 0]] = False
        numbers = self._known.numbers(different)
        asked = np.zeros(len(different), bool)
        asked[codes[wanted]] = True
        new = np.flatnonzero(asked & (numbers < 0)).tolist()
        if new:
            numbers[new] = self._learn([different[i] for i in new])
        numbers[~asked] = -1
        # A stretch of words at a time bounds the index arrays of one very long text.
        parts, ends = [], [np.zeros(1, np.int64)]
        for k in range(0, len(codes), GATHERED):
            part = np.where(wanted[k : k + GATHERED], numbers[codes[k : k + GATHERED]], -1)
            lengths, ids = self._known.take(part)
            parts.append(ids.tobytes())
            ends.append(ends[-1][-1] + np.cumsum(lengths))
        ids, ends = b"".join(parts), 4 * np.concatenate(ends)[upto]
        unknown = np.r_[0, np.cumsum(wanted & (numbers[codes] < 0))][upto]
        borders = zip(ends[:-1].tolist(), ends[1:].tolist(), (np.diff(unknown) > 0).tolist(), strict=True)
        return [None if odd else ids[lo:hi] for lo, hi, odd in borders]

    def _plain(self, texts: list[str]) -> list[bytes]:
        if len(self._known.number) >= CACHE_WORDS or len(self._known.ids) >= CACHE_IDS:
            self._known, self._old = _Memory(), self._known
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        sizes = np.asarray(split.value_lengths()).astype(np.int64)
        words = split.flatten()
        firsts = words.take(pa.array(np.cumsum(sizes) - sizes)).to_pylist()
        out = self._joined(words, sizes, 1)
        odd = [k for k, first in enumerate(firsts) if out[k] is None or first.strip() != first or not first]
        if odd:
            # Runs of white space: cut only where a single blank stands between two visible characters.
            cut = [_SAFE_BLANK.split(texts[k]) for k in odd]
            # White space at the end makes the last stretch one that is not remembered.
            inner = [words[1:-1] for words in cut]
            found = self._joined(pa.array([w for words in inner for w in words], pa.string()), np.array([len(words) for words in inner]))
            for k, words, ids in zip(odd, cut, found, strict=True):
                firsts[k] = words[0]
                out[k] = ids + b"".join(self._ids([" " + w for w in words[1:][-1:]]))
        out = [first + ids for first, ids in zip(self._ids(firsts), out, strict=True)]
        for w in self._long:
            self._known.number.pop(w, None)
        self._long.clear()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit numbers."""
        parts = [self._cuts.split(t) if t and any(a in t for a in self._added) else [t or ""] for t in texts]
        ids = iter(self._plain([p for ps in parts for p in ps if p not in self._added]))
        return [b"".join([self._added[p] if p in self._added else next(ids) for p in ps]) for ps in parts]


_LIBRARIES: dict[str, LibraryIds] = {}


def library_ids(path: str) -> LibraryIds:
    """The library's encoder of a vocabulary file, built once in each Python worker."""
    if path not in _LIBRARIES:
        _LIBRARIES[path] = LibraryIds(path)
    return _LIBRARIES[path]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids binary): the token ids of each whole text, little-endian 32-bit."""

    def run(batches):
        c = codec(path)
        for b in slices(batches, 1):
            ids = [c.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return plain.mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_column)


def decode(df: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, text): the text of each row's ids."""

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [c.decode(i or b"") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = df.schema[id_column].dataType.simpleString()
    plain = df.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids"))
    return plain.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: token count, sha256 of the decimal ids, sha256 of the decoded text.  No shuffle."""

    def run(batches):
        c = codec(path)
        for b in slices(batches, 1):
            n, first, second = [], [], []
            for text in b.column(1).to_pylist():
                ids = c.encode(text)
                numbers = np.frombuffer(ids, "<u4").tolist()
                n.append(len(numbers))
                first.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, numbers)).encode()).hexdigest())
                second.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return plain.mapInArrow(run, schema).withColumnRenamed("id", id_column)
