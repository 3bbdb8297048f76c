"""Byte-level BPE by monoid tree reduction.

The encodings of texts form a monoid: two neighbours are joined by encoding a window around
their boundary anew and keeping the tokens outside it. A text is halved down to leaves, leaves
are encoded, and neighbours are joined up the tree. A window grows until the tokens outside are
proven to be those of the whole:

* At text level, a window ends at *safe points*. Between a character that is not white space and
  one that is, and between ASCII characters of different classes (letter, digit, other; an
  apostrophe is left out for the contractions), no match of the pattern reaches across, whatever
  stands around. The pattern looks at nothing before a match, so the split of the text restarts
  there and the tokens on either side are the same in the half and in the whole.
* Inside one long match (a run without safe points), a window ends where the pairs of tokens at
  its ends encode to themselves. If every neighbouring pair of a token sequence is the encoding of
  its own bytes, the sequence is the encoding of the whole: the first merge across a boundary
  would also be made when the pair is encoded alone.

Decoding looks tokens up at the leaves and concatenates up the tree.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.arrow import map_rows

_SPACE = r"\p{White_Space}"
_SAFE = "|".join(
    (
        rf"[^{_SPACE}]{_SPACE}",
        r"[A-Za-z][!-@\[-`{-~]",
        r"[0-9][!-/:-~]",
        r"[!-&(-/:-@\[-`{-~][A-Za-z0-9]",
        r"[一-龥][、。，！：；？]",
        r"[、。，！：；？][一-龥]",
    )
)
_NEXT, _LAST = regex.compile(_SAFE), regex.compile(f"(?r)(?:{_SAFE})")


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of byte strings and the pattern that splits texts; sent to executors by broadcast."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as file:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, pattern)


class TreeCoder:
    """Encoder and decoder over a vocabulary. Sizes: leaves and windows in characters or bytes."""

    def __init__(self, vocabulary: Vocabulary, leaf: int = 1024, window: int = 16, run: int = 4096, piece_leaf: int = 256):
        self.leaf, self.window, self.run, self.piece_leaf = max(leaf, 2), max(window, 2), max(run, 4), max(piece_leaf, 4)
        self.base = tiktoken.Encoding("tree", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
        self.vocabulary, self.ranks = vocabulary, vocabulary.ranks
        # White space as tiktoken has it: the regex module's \s also takes some control characters.
        self.split = regex.compile(vocabulary.pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.bytes_of = [b""] * (max(vocabulary.ranks.values()) + 1)
        for token, rank in vocabulary.ranks.items():
            self.bytes_of[rank] = token
        self.length = [len(t) for t in self.bytes_of]
        self.pairs: dict[tuple[int, int], bool] = {}

    # Text level

    def encode(self, text: str) -> list[int]:
        return self._span(text, 0, len(text))

    def _span(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self.base.encode_ordinary(text[start:end])
        middle = (start + end) // 2
        left, right = self._span(text, start, middle), self._span(text, middle, end)
        return self._join(text, start, middle, end, left, right)

    def _join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text[start:end] from those of its halves."""
        before, after, reach = None, None, self.window
        while before is None or after is None:
            if before is None:
                lowest = max(start, middle - reach)
                found = _LAST.search(text, lowest, middle)
                before = found.start() + 1 if found else start if lowest == start else None
            if after is None:
                highest = min(end, middle + reach)
                found = _NEXT.search(text, middle, highest)
                after = found.start() + 1 if found else end if highest == end else None
            reach *= 2
        keep = self._cut(left, len(text[before:middle].encode()), from_end=True)
        drop = self._cut(right, len(text[middle:after].encode()), from_end=False)
        return left[:keep] + self._window(text[before:after]) + right[drop:]

    def _cut(self, tokens: list[int], size: int, from_end: bool) -> int:
        """Where ``size`` bytes from an end of the tokens begin or end; a token boundary is there."""
        k = len(tokens) if from_end else 0
        while size > 0:
            k -= from_end
            size -= self.length[tokens[k]]
            k += not from_end
        if size:
            raise AssertionError("a window does not end between tokens")
        return k

    def _window(self, text: str) -> list[int]:
        if len(text) <= self.run:
            return self.base.encode_ordinary(text)
        out: list[int] = []
        for match in self.split.finditer(text):
            out += self._piece(match.group().encode())
        return out

    # Inside one match of the pattern

    def _piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return self._merge(data)

    def _merge(self, data: bytes) -> list[int]:
        if len(data) <= self.piece_leaf:
            return self._small(data)
        middle = len(data) // 2
        return self._join_tokens(self._merge(data[:middle]), self._merge(data[middle:]))

    def _small(self, data: bytes) -> list[int]:
        return self.base._core_bpe.encode_single_piece(data) if data else []

    def _fits(self, a: int, b: int) -> bool:
        """Whether the two tokens are the encoding of their bytes together."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= 200_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self._small(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        k, j = 1, 1
        while True:
            k, j = min(k, len(left)), min(j, len(right))
            middle = self._small(b"".join([self.bytes_of[t] for t in left[len(left) - k :] + right[:j]]))
            good_left = k == len(left) or self._fits(left[-k - 1], middle[0])
            good_right = j == len(right) or self._fits(middle[-1], right[j])
            if good_left and good_right:
                return left[: len(left) - k] + middle + right[j:]
            k, j = k if good_left else 2 * k, j if good_right else 2 * j

    # Decoding

    def decode(self, tokens: list[int]) -> bytes:
        if len(tokens) <= 4 * self.leaf:
            return b"".join([self.bytes_of[t] for t in tokens])
        middle = len(tokens) // 2
        return self.decode(tokens[:middle]) + self.decode(tokens[middle:])


_CODERS: dict[int, TreeCoder] = {}


def coder(vocabulary: Vocabulary) -> TreeCoder:
    """The coder of a vocabulary, made once in each Python worker."""
    if (key := id(vocabulary)) not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = TreeCoder(vocabulary)
    return _CODERS[key]


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> Vocabulary:
    """A vocabulary of the public tokenizers package, read on the driver."""
    import public_tokenizers

    return Vocabulary.load(public_tokenizers.path(name), public_tokenizers.PATTERN)


def encode_documents(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids array<int>): the token ids of every whole text; null is empty, without ids.

    Rows are independent, so there is no shuffle and repeated rows get equal ids; a batch of
    Arrow is encoded text by text, and a long text needs its own tokens in memory only.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        own = coder(shared.value)
        return {"doc_id": batch.column(0), "ids": [own.encode(t or "") for t in batch.column(1).to_pylist()]}

    narrow = documents.select(F.col("doc_id").cast("long"), "text")
    return map_rows(narrow, ["doc_id", "text"], "doc_id long, ids array<int>", work, out)


def op6_bpe_tree(documents: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Digests of ids and of the bytes decoded from them, for every document.

    doc_id, n_tokens long, ids_sha256 (ids as little-endian unsigned 32-bit integers),
    decoded_sha256. A null text is empty: no tokens, digests of nothing.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary or public_vocabulary())
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        own = coder(shared.value)
        columns: dict[str, list] = {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for value in batch.column(1):
            ids = own.encode(value.as_py() or "")
            columns["n_tokens"].append(len(ids))
            columns["ids_sha256"].append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
            columns["decoded_sha256"].append(hashlib.sha256(own.decode(ids)).hexdigest())
        return columns

    narrow = documents.select(F.col("doc_id").cast("long"), "text")
    return map_rows(narrow, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work, out)
