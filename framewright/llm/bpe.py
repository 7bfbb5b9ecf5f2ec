"""Byte-level BPE by a reduction over a tree of text halves.

Texts: a long text is halved, each half is split by the pattern on its own, and halves are
joined. A match depends on no character after the one behind its end (nor on more than
``LOOK`` characters from its start), so all matches of the left half that keep clear of the
cut stand. The text from there is matched again, further and further, until a match begins
where one of the right half does; from there on the right half's matches stand.

Pieces: a token sequence is the encoding of its bytes exactly if every two neighbours, encoded
together, give themselves again. Halves of a long piece are joined by encoding a window round
the cut again, doubled until its neighbours on both sides pass that test.

Decoding concatenates up the same tree. A null text is empty; repeated rows are coded each.
The vocabulary (a file of ranks) is broadcast; its size does not depend on the data.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import Memo, text_batches

LEAF_CHARS = 1 << 16
LEAF_BYTES = 40
LEAF_TOKENS = 1 << 14
LOOK = 3


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {v: k for k, v in ranks.items()}
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        self.pieces = Memo(lambda piece: self.piece(piece.encode("utf-8", "surrogatepass")))
        self.stable = Memo(lambda pair: self.merged(self.token[pair[0]] + self.token[pair[1]]) == [*pair])

    def merged(self, raw: bytes) -> list[int]:
        """Plain merging, the lowest rank first and of equal ones the leftmost."""
        ranks, none = self.ranks, 1 << 60
        if len(raw) <= 4 * self.leaf_bytes:
            parts = [raw[i : i + 1] for i in range(len(raw))]
            pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
            while pairs and (rank := min(pairs)) < none:
                at = pairs.index(rank)
                part = parts[at] + parts[at + 1]
                parts[at : at + 2] = [part]
                del pairs[at]
                if at:
                    pairs[at - 1] = ranks.get(parts[at - 1] + part, none)
                if at < len(pairs):
                    pairs[at] = ranks.get(part + parts[at + 1], none)
            return [ranks[p] for p in parts]
        after = list(range(1, len(raw) + 1))  # where the part that starts here ends; 0: no part starts here
        before = list(range(-1, len(raw) - 1))
        queue = [(r, i, i + 2) for i in range(len(raw) - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, end = heapq.heappop(queue)
            middle = after[i]
            if not middle or middle >= len(raw) or after[middle] != end:
                continue  # one of the two parts has changed since
            after[i], after[middle] = end, 0
            if end < len(raw):
                before[end] = i
                if (r := ranks.get(raw[i : after[end]])) is not None:
                    heapq.heappush(queue, (r, i, after[end]))
            if i and (r := ranks.get(raw[before[i] : end])) is not None:
                heapq.heappush(queue, (r, before[i], end))
        out, at = [], 0
        while at < len(raw):
            out.append(ranks[raw[at : after[at]]])
            at = after[at]
        return out

    def piece(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self.halves(raw)

    def halves(self, raw: bytes) -> list[int]:
        if len(raw) <= self.leaf_bytes:
            return self.merged(raw)
        cut = len(raw) // 2
        return self.joined(self.halves(raw[:cut]), self.halves(raw[cut:]))

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        low, high, grow, window = len(left), 0, 1, []
        while True:
            front = not low or self.stable[left[low - 1], window[0] if window else right[0]]
            back = high == len(right) or self.stable[window[-1] if window else left[-1], right[high]]
            if front and back:
                return left[:low] + window + right[high:]
            low = low if front and window else max(0, low - grow)
            high = high if back and window else min(len(right), high + grow)
            grow *= 2
            window = self.merged(b"".join(map(self.token.__getitem__, left[low:] + right[:high])))

    def split(self, text: str, start: int = 0, end: int | None = None) -> list[str]:
        """The pattern's matches over text[start:end] taken on its own."""
        end = len(text) if end is None else end
        if end - start <= self.leaf_chars:
            return self.pattern.findall(text[start:end])
        cut = (start + end) // 2
        left, right = self.split(text, start, cut), self.split(text, cut, end)
        at = cut
        while left and (at >= cut or at - len(left[-1]) + LOOK > cut):
            at -= len(left.pop())
        window, place, k = [], cut, 0
        for match in self.pattern.finditer(text, at, end):
            while place < match.start() and k < len(right):
                place += len(right[k])
                k += 1
            if match.start() >= cut and place == match.start():
                break
            window.append(match.group())
        else:
            k = len(right)
        return left + window + right[k:]

    def encode(self, text: str | None) -> np.ndarray:
        pieces = self.pieces
        return np.fromiter(chain.from_iterable(map(pieces.__getitem__, self.split(text or ""))), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.token.__getitem__, ids))
        cut = len(ids) // 2
        return self.decode(ids[:cut]) + self.decode(ids[cut:])


_CODECS: dict[tuple, Codec] = {}


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def codec(raw: bytes, pattern: str) -> Codec:
    """One codec a worker process for each vocabulary."""
    key = (len(raw), hash(raw), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(read_ranks(raw), pattern)
    return _CODECS[key]


def coders(df: DataFrame, vocabulary: str, pattern: str):
    """Column functions: a text to its ids, ids to their bytes, and a text to both."""
    text_batches(df.sparkSession)
    with open(vocabulary, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(shared.value, pattern)
        for texts in batches:
            yield lists([own.encode(t) for t in texts.to_pylist()])

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(shared.value, pattern)
        for ids in batches:
            flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
            yield pa.array([own.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.binary())

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(shared.value, pattern)
        for texts in batches:
            parts = [own.encode(t) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([lists(parts), pa.array([own.decode(p.tolist()) for p in parts], pa.binary())], ["ids", "decoded"])

    return encode.asNondeterministic(), decode.asNondeterministic(), both.asNondeterministic()


def coded(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` of every text and the bytes ``decoded`` from them (columns of these names are replaced).

    Both come from one Python node, so a task keeps one worker.
    """
    both = coders(docs, vocabulary, pattern)[2]
    rest = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    own = "coded"
    while own in rest:
        own += "_"
    return docs.select(*(F.col(c) for c in rest), both(F.col(text)).alias(own)).select(*(F.col(c) for c in rest), f"{own}.ids", f"{own}.decoded")


def digest(ids: Column) -> Column:
    return F.sha2(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").cast("binary"), 256)
