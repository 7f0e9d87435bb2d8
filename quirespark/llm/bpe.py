"""Byte-level BPE with a segment tree over the byte positions of a piece.

A leaf of the tree stands for the pair that starts at a byte position and holds
the rank of the token which that pair would become; an inner node holds the
least rank below it. The least, leftmost pair is found by one walk from the root;
a merge changes the leaves of the merged pair, of its live neighbour on the left
and of the pair that vanished, each in a logarithmic number of node updates. A
piece of n bytes therefore takes O(n log n) steps, however long it is. Short pieces
that are new to a worker are merged side by side, one merge of each at a time, with
their trees as the rows of an array.

Edge cases. A null text is an empty one and has no ids. Texts are encoded whole,
whatever their length; equal texts have equal ids. An empty table gives an empty
table. Columns besides the id and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, RELEASED, int_lists, records, tidy

#: No pair: larger than any rank.
NONE = (1 << 31) - 1
#: Bytes, about, of the pieces and ids that a worker remembers while tasks of this operator follow one another; at that many it starts anew. This bounds memory only.
MEMO = 48 << 20
#: Pairs of the widest tree that is merged beside others, and characters of texts that are encoded together.
WIDEST, TOGETHER = 32, 1 << 20

_codecs: dict[int, "Codec"] = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Ranks and pattern, with a bounded memo of pieces."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.held = 0
        self.size = len(self.tokens)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.pairs = np.array(sorted(pairs) or [-1], np.int64)
        self.merged = np.array([pairs[k] for k in sorted(pairs)] or [NONE], np.int64)
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece, by merging the least, leftmost pair until none is left."""
        ranks, n = self.ranks, len(piece)
        if n < 2:
            return [ranks[piece]] if n else []
        if piece in ranks:
            return [ranks[piece]]
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NONE] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = ranks.get(piece[i : i + 2], NONE)
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a <= b else b
        end = list(range(1, n + 1))  # where the token that starts here ends
        before = list(range(-1, n))  # where the live token on the left starts

        def put(i: int, rank: int) -> None:
            node = width + i
            tree[node] = rank
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a <= b else b
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        while tree[1] != NONE:
            node, least = 1, tree[1]
            while node < width:
                node *= 2
                if tree[node] != least:
                    node += 1
            i = node - width
            gone = end[i]
            after = end[i] = end[gone]
            before[after] = i
            if gone < n - 1:
                put(gone, NONE)
            put(i, ranks.get(piece[i : end[after]], NONE) if after < n else NONE)
            if (left := before[i]) >= 0:
                put(left, ranks.get(piece[left:after], NONE))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs of ids would become."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], NONE)

    def merge_beside(self, pieces: list[bytes], width: int) -> list[bytes]:
        """:meth:`merge` for pieces of 2 to ``width + 1`` bytes, one merge of each at a time."""
        rows = len(pieces)
        length = np.array([len(p) for p in pieces], np.int64)
        spot = np.arange(width + 1)
        data = np.frombuffer(b"".join(p.ljust(width + 1, b"\0") for p in pieces), np.uint8).reshape(rows, width + 1)
        ids = np.where(spot < length[:, None], self.single[data], -1)
        tree = np.full((rows, 2 * width + 1), NONE, np.int64)  # the last column takes what has no leaf
        tree[:, width : 2 * width] = np.where(spot[:-1] < length[:, None] - 1, self.joined(ids[:, :-1], ids[:, 1:]), NONE)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        end = np.tile(np.arange(1, width + 3), (rows, 1))
        before = np.tile(np.arange(-1, width + 2), (rows, 1))
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            least, node = tree[live, 1], np.ones(len(live), np.int64)
            while node[0] < width:
                node = 2 * node
                node += tree[live, node] != least
            at = node - width
            gone = end[live, at]
            after = end[live, gone]
            ids[live, at], ids[live, gone] = least, -1
            end[live, at], before[live, after] = after, at
            tree[live, width + gone] = NONE
            more = after < length[live]
            tree[live, width + at] = np.where(more, self.joined(least, ids[live, np.minimum(after, width)]), NONE)
            left = before[live, at]
            some = left >= 0
            beside = np.where(some, left, at)
            tree[live, width + beside] = np.where(some, self.joined(ids[live, beside], least), tree[live, width + at])
            touched = [width + at, width + beside, np.minimum(width + gone, 2 * width - 1)]
            step = width
            while step > 1:
                step //= 2
                for k in range(3):
                    touched[k] = up = touched[k] >> 1
                    tree[live, up] = np.minimum(tree[live, 2 * up], tree[live, 2 * up + 1])
            live = live[tree[live, 1] != NONE]
        kept = ids >= 0
        flat = ids[kept].astype("<i4").tobytes()
        ends = np.cumsum(kept.sum(1)).tolist()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Puts the ids of pieces that are new into the memo."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode("utf-8", "replace")
            if data in self.ranks or not 2 <= len(data) <= WIDEST + 1:
                self.memo[piece] = array("i", self.merge(data)).tobytes()
            else:
                groups.setdefault(1 << (len(data) - 2).bit_length(), []).append((piece, data))
        for width, group in groups.items():
            for at in range(0, len(group), 8192):
                some = group[at : at + 8192]
                self.memo.update(zip([p for p, _ in some], self.merge_beside([d for _, d in some], width), strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        pieces = [self.find(text) for text in texts]
        if self.held > MEMO:
            self.forget()
        new = set().union(*pieces) - self.memo.keys()
        self.learn(new)
        memo = self.memo
        self.held += sum(240 + len(piece) + len(memo[piece]) for piece in new)  # two objects and their place in the table
        ids = memo.__getitem__
        return [b"".join(map(ids, found)) for found in pieces]

    def forget(self) -> None:
        self.memo.clear()
        self.held = 0

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_all([text])[0]).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def forget() -> None:
    for own in _codecs.values():
        own.forget()


RELEASED.append(forget)


def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    key = hash((ranks, pattern))
    if key not in _codecs:
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def encode_decode(df: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>, decoded binary)`` of every row; ``decoded`` is made from ``ids`` alone.

    The vocabulary is broadcast: its size is that of a tokenizer's file and doesn't grow with the data.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)

        def batch(rows):
            ids = own.encode_all([text for _, text in rows])
            decoded = [own.decode(array("i", x)) for x in ids]
            return pa.RecordBatch.from_arrays([pa.array([key for key, _ in rows], pa.int64()), int_lists(ids), pa.array(decoded, pa.binary())], names=["key", "ids", "decoded"])

        kept, held = [], 0
        for key, text in records(batches):
            kept.append((key, text or ""))
            held += len(text or "")
            if held >= TOGETHER or len(kept) >= BATCH_BYTES >> 10:
                yield batch(kept)
                kept, held = [], 0
        if kept:
            yield batch(kept)

    kind = df.schema[id_col].dataType
    mapped = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).mapInArrow(tidy(run, forget), "key long, ids array<int>, decoded binary")
    return mapped.select(F.col("key").cast(kind).alias(id_col), "ids", "decoded")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and SHA-256 digests of what :func:`encode_decode` returns."""
    return encoded.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
