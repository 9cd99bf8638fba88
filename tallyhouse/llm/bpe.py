"""Byte-level BPE of whole corpora with a public vocabulary, by a pair occurrence index.

Texts are cut into pieces by the vocabulary's pattern.  The pieces of a batch that are new to a worker are encoded together:
an index maps each pair of neighbouring symbols to all its positions, the ranks that occur are applied in ascending order to
all their positions at once, and the lists of the pairs that arise are extended.  A piece met before costs one lookup.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

TOKENIZER_DIR = os.environ.get("TALLYHOUSE_TOKENIZERS", "/opt/tokenizers")
DEFAULT_VOCABULARY = f"{TOKENIZER_DIR}/byte_bpe_50k.json"

#: Fixed value: the cut into pieces that byte-level vocabularies of this family are made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces that a worker remembers; beyond them it forgets all and starts again.
REMEMBERED = 150_000

_SHIFT = 20  # a pair of ids is one integer


def _byte_names() -> dict[str, int]:
    """The printable stand-ins for bytes in vocabulary files: printable Latin-1 stands for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Byte ids and merges of a byte-level BPE file; small enough to send to every worker (its size is the file's)."""

    def __init__(self, byte_ids: list[int], merges: dict[int, int], tokens: dict[int, bytes] | None = None) -> None:
        self.byte_ids, self.merges, self.tokens = byte_ids, merges, tokens

    @classmethod
    def load(cls, path: str = DEFAULT_VOCABULARY) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, names = model["vocab"], _byte_names()
        byte_ids = [0] * 256
        for name, b in names.items():
            byte_ids[b] = vocab[name]
        merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges.setdefault(vocab[a] << _SHIFT | vocab[b], rank << _SHIFT | vocab[a + b])
        tokens = {i: bytes(names[c] for c in t) for t, i in vocab.items() if all(c in names for c in t)}
        return cls(byte_ids, merges, tokens)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of every piece; all pieces are merged together, rank by rank."""
    byte_ids, merges = vocabulary.byte_ids, vocabulary.merges
    symbol: list[int] = []
    after: list[int] = []  # index of the next live symbol of the piece, -1 at its end
    before: list[int] = []
    starts: list[int] = []
    positions: dict[int, list[int]] = {}
    for piece in pieces:
        at = len(symbol)
        starts.append(at)
        ids = [byte_ids[b] for b in piece]
        n = len(ids)
        symbol += ids
        after += range(at + 1, at + n + 1)
        before += range(at - 1, at + n - 1)
        if n:
            after[-1] = -1
            before[at] = -1
        for i in range(n - 1):
            pair = ids[i] << _SHIFT | ids[i + 1]
            if pair in merges:
                if pair in positions:
                    positions[pair].append(at + i)
                else:
                    positions[pair] = [at + i]
    low = (1 << _SHIFT) - 1
    active = [(merges[p] >> _SHIFT, p) for p in positions]
    heapq.heapify(active)
    while active:
        _, pair = heapq.heappop(active)
        left, right, made = pair >> _SHIFT, pair & low, merges[pair] & low
        for i in sorted(positions.pop(pair)):
            j = after[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue  # an earlier merge took part of it
            k, h = after[j], before[i]
            symbol[i], symbol[j] = made, -1
            after[i] = k
            if k >= 0:
                before[k] = i
                new = made << _SHIFT | symbol[k]
                if new in merges:
                    if new in positions:
                        positions[new].append(i)
                    else:
                        positions[new] = [i]
                        heapq.heappush(active, (merges[new] >> _SHIFT, new))
            if h >= 0:
                new = symbol[h] << _SHIFT | made
                if new in merges:
                    if new in positions:
                        positions[new].append(h)
                    else:
                        positions[new] = [h]
                        heapq.heappush(active, (merges[new] >> _SHIFT, new))
    out = []
    for piece, at in zip(pieces, starts):
        ids, i = [], at if piece else -1
        while i >= 0:
            ids.append(symbol[i])
            i = after[i]
        out.append(ids)
    return out


class Encoder:
    """Encodes texts; remembers pieces between batches."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED) -> None:
        import regex

        self.vocabulary, self.remembered = vocabulary, remembered
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > self.remembered:
            self.known = {}
            new = list(pieces)
        # A lone surrogate can't come from a valid string column; it would be written as the replacement character.
        coded = encode_pieces([p.encode("utf-8", "replace") for p in new], self.vocabulary)
        self.known.update(zip(new, coded))

    def __call__(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text; null and empty texts give an empty list."""
        cut = [self.cut(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        known = self.known
        for pieces in cut:
            yield list(chain.from_iterable([known[p] for p in pieces]))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, shared) -> Encoder:  # noqa: ANN001
    """The worker's encoder for a vocabulary, kept between tasks."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(shared.value)
    return _ENCODERS[name]


def _slices(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text; a longer text is a part of its own, whole."""
    sizes = [len(x) if x is not None else 0 for x in batch.column(text).cast(pa.large_binary()).to_pylist()]
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def encode_column(
    df: DataFrame, text: str, *, out: str = "ids", vocabulary: str = DEFAULT_VOCABULARY, lengths_only: bool = False, drop_text: bool = True
) -> DataFrame:
    """``df`` with ``out``: the token ids of ``text`` as array<int>, or with ``lengths_only`` their number.

    Null and empty texts give an empty list (0).  Strings that look like special tokens are ordinary text.  Texts are
    encoded whole, however long.  ``text`` itself is dropped unless ``drop_text`` is false.  No shuffle.
    """
    if out in df.columns and not (out == text and drop_text):
        raise ValueError(f"the table has a column {out} already")
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))
    kept = [c for c in df.columns if c != text or not drop_text]
    schema = StructType(
        [df.schema[c] for c in kept]
        + [StructField(out, IntegerType() if lengths_only else ArrayType(IntegerType(), False))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, shared)
        for whole in batches:
            for batch in _slices(whole, text, 4_000_000):
                coded = encode(batch.column(text).to_pylist())
                if lengths_only:
                    made = pa.array((len(x) for x in coded), pa.int32())
                else:
                    lists = list(coded)
                    ends = [0]
                    for x in lists:
                        ends.append(ends[-1] + len(x))
                    flat = pa.array(chain.from_iterable(lists), pa.int32(), size=ends[-1])
                    made = pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()), flat, type=pa.list_(pa.field("element", pa.int32(), nullable=False))
                    )
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], made], names=[*kept, out])

    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])]).mapInArrow(run, schema)
