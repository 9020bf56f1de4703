"""Byte-pair encoding by longest matches with backtracking, decoding by an offset table.

The encoder walks a word once. At each place it takes the longest token that starts there, found by
one Aho-Corasick pass over the word. A token may follow another only if merging the two texts together
would leave the border between them; the table of such compatible pairs is worked out from the merge
list, pair by pair, and kept. If no token fits, the last one is taken back and its place is not tried
again, so the work is linear in the word and the result is the one the merge rules give.

Ids index a table of token texts laid end to end; decoding copies the slices between offsets.

Words are cut as the tokenizer file says: special strings first, then its normaliser and its splitting
pattern. Since no pattern reaches over white space, a piece between blanks is encoded alone and kept in
a bounded table.

Defined results: a null or empty text, or one of blanks only, has no ids and decodes to the empty
text. Repeated rows get one result each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import release_memory, slices, strings

END = "</w>"
KEPT_PIECES = 250_000  # pieces, and words, in each half of what a task keeps
PIECE_BYTES, WORD_BYTES = 48 << 20, 24 << 20  # their bounds by bytes: 144 MB in all
ENTRY_BYTES = 190  # what an entry of a table takes besides its letters
PAIR_SLOTS = 1 << 20  # answers of the pair table that are kept, 8 bytes each
# White space as the splitting pattern sees it.
_BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")
# Pieces whose normal form is their lower case, and the splitting pattern for them; others go
# through the library's own normaliser and splitter.
_USUAL = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ]+")
_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where it is printable in Latin-1,
    else the next free one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in own}
    for place, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + place)
    return letters


class Vocabulary:
    """Tokens in merge order, their parts, and which pairs may stand side by side."""

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]], size: int) -> None:
        self.by_text = {self._signs(t): i for t, i in tokens.items()}
        # A token without parts is its own left and right part.
        self.left, self.right = list(range(size)), list(range(size))
        self.rank = [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            i, j, made = tokens[a], tokens[b], tokens[a + b]
            self.left[made], self.right[made], self.rank[made] = i, j, rank
            self.merged[i, j] = made
        self.matcher = ahocorasick.Automaton()
        self.length = [0] * size
        for signs, i in self.by_text.items():
            self.matcher.add_word(signs, i)
            self.length[i] = len(signs)
        self.matcher.make_automaton()
        self.shorter = self._prefixes(size)
        self.pairs = array("q", bytes(8 * PAIR_SLOTS))

    @staticmethod
    def _signs(token: str) -> str:
        """One sign per symbol: a letter that ends a word is another symbol than the same letter."""
        if token.endswith(END):
            body = token[: -len(END)]
            return body[:-1] + chr(ord(body[-1]) + 0x10000)
        return token

    def _prefixes(self, size: int) -> list[int]:
        """For each token the longest other token that it begins with, or -1."""
        shorter = [-1] * size
        for signs, i in self.by_text.items():
            for cut in range(len(signs) - 1, 0, -1):
                found = self.by_text.get(signs[:cut])
                if found is not None:
                    shorter[i] = found
                    break
        return shorter

    def compatible(self, a: int, b: int) -> bool:
        # One answer per slot: the pair, moved up by a place that tells the answer, and one more for "empty".
        pair = (a << 31 | b) + 1
        slot = (a * 40503 + b) % PAIR_SLOTS
        kept = self.pairs[slot]
        if kept >> 1 != pair:
            kept = self.pairs[slot] = pair << 1 | self._border_stays(a, b)
        return bool(kept & 1)

    def _border_stays(self, a: int, b: int) -> bool:
        """Whether no merge across the border comes before the merges that make ``a`` and ``b``.

        Undo the later of the two last merges, step by step: the symbols at the border at the time
        of each merge are what is left on either side.
        """
        before = len(self.rank)
        while True:
            made = self.merged.get((a, b))
            if made is not None and self.rank[made] < before:
                return False
            left_rank, right_rank = self.rank[a], self.rank[b]
            if left_rank < 0 and right_rank < 0:
                return True
            # Equal merges go from left to right, so on a tie the right one is undone first.
            if left_rank > right_rank:
                before = left_rank
                a = self.right[a]
            else:
                # A merge across the border with this rank would come first: it lies further left.
                before = right_rank + 1
                b = self.left[b]

    def encode(self, signs: str) -> list[int]:
        whole = self.by_text.get(signs)
        if whole is not None:
            # The vocabulary's tokens are what the merges make of their own text.
            return [whole]
        length, size = self.length, len(signs)
        best = [-1] * (size + 1)
        # Matches come by their end, so the last one from a place is the longest.
        for end, token in self.matcher.iter(signs):
            best[end + 1 - length[token]] = token
        tokens: list[int] = []
        at, last, token = 0, -1, best[0]
        refused: set[int] = set()
        while at < size:
            while token >= 0:
                end = at + length[token]
                if (last < 0 or self.compatible(last, token)) and end not in refused:
                    break
                token = self.shorter[token]
            if token >= 0:
                tokens.append(token)
                last, at, token = token, end, best[end]
            else:
                if not tokens:
                    raise ValueError("the vocabulary does not cover the text")
                refused.add(at)
                token = tokens.pop()
                at -= length[token]
                last = tokens[-1] if tokens else -1
        return tokens


class Recent:
    """A table that keeps what was asked for lately: two halves, the older one dropped. A half is bounded by
    entries and by bytes."""

    def __init__(self, half: int, half_bytes: int = 1 << 30) -> None:
        self.half, self.half_bytes = half, half_bytes
        self.clear()

    def clear(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        size = ENTRY_BYTES + len(key) + len(value)
        if size > self.half_bytes:
            return
        if len(self.new) >= self.half or self.size + size > self.half_bytes:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[key] = value
        self.size += size


class Codec:
    """A tokenizer file of words with end marks, as encoder and decoder."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model = said["model"]
        if model["end_of_word_suffix"] != END or said["decoder"] is not None:
            raise ValueError("a vocabulary with end marks and without a decoder is needed")
        library = Tokenizer.from_file(path)
        self._normal, self._cut = library.normalizer, library.pre_tokenizer
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        specials = {t["content"]: t["id"] for t in said["added_tokens"]}
        size = max([*model["vocab"].values(), *specials.values()]) + 1
        self.vocabulary = Vocabulary(model["vocab"], merges, size)
        self._special = {s: np.array([i], "<u4").tobytes() for s, i in specials.items()}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")")
        self._letters = _byte_letters()
        self._ids = [np.array([i], "<u4").tobytes() for i in range(size)]
        self._pieces, self._known = Recent(KEPT_PIECES, PIECE_BYTES), Recent(KEPT_PIECES, WORD_BYTES)
        # Decoding joins token texts with a blank.
        texts = [b" "] * size
        for token, i in [*model["vocab"].items(), *specials.items()]:
            texts[i] = token.encode() + b" "
        self._bytes = np.frombuffer(b"".join(texts), np.uint8)
        self._offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)

    def _words(self, piece: str) -> list[str]:
        """The words of a piece as signs of the vocabulary, still without the mark of the end."""
        if _USUAL.fullmatch(piece):
            return [w.encode().decode("latin-1").translate(self._letters) for w in _CUT.findall(piece.lower())]
        return [word for word, _ in self._cut.pre_tokenize_str(self._normal.normalize_str(piece))]

    def _word(self, word: str) -> bytes:
        ids = self._ids
        found = b"".join([ids[i] for i in self.vocabulary.encode(word[:-1] + chr(ord(word[-1]) + 0x10000))])
        self._known.put(word, found)
        return found

    def forget(self) -> None:
        """Drop what was kept; workers outlive a task."""
        self._pieces.clear()
        self._known.clear()

    def _piece(self, piece: str) -> bytes:
        found = self._pieces.get(piece)
        if found is None:
            found = b"".join([self._known.get(w) or self._word(w) for w in self._words(piece)])
            self._pieces.put(piece, found)
        return found

    def _plain(self, text: str) -> bytes:
        known = self._pieces.new.get
        return b"".join([known(p) or self._piece(p) for p in _BLANKS.split(text) if p])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if "<|" not in text:
            return self._plain(text)
        return b"".join(self._special.get(part) or self._plain(part) for part in self._split.split(text))

    def decode(self, ids: bytes) -> bytes:
        """The text in UTF-8."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        if not tokens.size:
            return b""
        starts = self._offsets[tokens]
        sizes = self._offsets[tokens + 1] - starts
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        return self._bytes[places[:-1]].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@contextmanager
def task_codec(path: str) -> Iterator[Codec]:
    """The codec for one partition; what it kept of the texts goes when the partition ends."""
    coder = codec(path)
    try:
        yield coder
    finally:
        coder.forget()
        release_memory()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every text, four bytes per id."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_codec(path) as coder:
            for batch in (b for part in parts for b in slices(part, 512)):
                ids = [coder.encode(t) for t in strings(batch, "text")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"]
                )

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, rows.drop("text").schema.add("ids", "binary"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``ids`` turned back into ``text``, beside ``doc_id``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_codec(path) as coder:
            for batch in (b for part in parts for b in slices(part, 512)):
                texts = [coder.decode(ids or b"") for ids in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "text"],
                )

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, rows.drop("ids").schema.add("text", "string"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Token count and the digests of the ids and of the text they decode to, in one pass."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_codec(path) as coder:
            for batch in (b for part in parts for b in slices(part, 512)):
                n, coded, decoded = [], [], []
                for text in strings(batch, "text"):
                    ids = coder.encode(text)
                    n.append(len(ids) // 4)
                    coded.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()),
                     pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select("doc_id", F.col("text"))
    schema = rows.drop("text").schema
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)
