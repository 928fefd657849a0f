"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

Instead of word by word, merges are applied to all distinct words of a batch together: an
inverted index maps each possible merge to the word positions where its pair stands, and the
merges are replayed in rank order.  Applying one touches the merged positions and their two
neighbours only.  Pairs that spell the same token share its rank and so its index entry.
"""

from __future__ import annotations

import base64
import bisect
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from evistrata.llm.base import map_batches, texts, worker_state
from evistrata.llm.tokens import ChunkEncoder, gather, pieces_to_chunks, split_pieces


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class _Merges(dict):
    """Left token << 20 | right token to the rank of the token they spell, or -1; filled on demand."""

    def __init__(self, ranks: dict[bytes, int], spelling: dict[int, bytes]):
        super().__init__()
        self.ranks, self.spelling = ranks, spelling

    def __missing__(self, pair: int) -> int:
        rank = self.ranks.get(self.spelling[pair >> 20] + self.spelling[pair & 0xFFFFF], -1)
        if len(self) < 2_000_000:
            self[pair] = rank
        return rank


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= 1 << 20:
            raise ValueError("ranks must be below 2**20")
        self.spelling = {rank: token for token, rank in ranks.items()}
        self.merges = _Merges(ranks, self.spelling)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        bytes_of = [bytes([b]) for b in range(256)]
        self.byte_pairs = np.array([[ranks.get(a + b, -1) for b in bytes_of] for a in bytes_of], np.int64)
        size = max(ranks.values()) + 1
        lengths = np.zeros(size + 1, np.int64)
        for rank, token in self.spelling.items():
            lengths[rank + 1] = len(token)
        self.starts = np.cumsum(lengths)
        self.letters = np.frombuffer(b"".join(self.spelling[rank] for rank in sorted(self.spelling)), np.uint8)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word.

        Always the lowest rank first; among equal ranks of a word the leftmost first.
        """
        if not words:
            return []
        # every word is followed by a stop (-1), and one more closes the whole
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        raw = np.full(starts[-1], -1, np.int64)
        inside = np.ones(starts[-1], bool)
        inside[starts[1:] - 1] = False
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        token = np.where(inside, self.of_byte[raw], -1).tolist()
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        token.append(-1)
        merges, index = self.merges, {}
        pairs = np.flatnonzero(inside[:-1] & inside[1:])
        ranks = self.byte_pairs[raw[pairs], raw[pairs + 1]]
        pairs, ranks = pairs[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        pairs, ranks = pairs[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for part in np.split(np.arange(len(ranks)), cuts) if len(ranks) else []:
            index[int(ranks[part[0]])] = pairs[part].tolist()
        heap = list(index)
        heapify(heap)
        ends = starts[1:].tolist()
        while heap:
            rank = heappop(heap)
            positions = index.pop(rank, None)
            if positions is None:
                continue
            positions.sort()
            wait = -1
            for p in positions:
                left = token[p]
                q = after[p]
                right = token[q]
                if left < 0 or right < 0 or merges[left << 20 | right] != rank:
                    continue
                if p < wait:  # a lower rank has come up in this word: that one goes first
                    if rank not in index:
                        index[rank] = []
                        heappush(heap, rank)
                    index[rank].append(p)
                    continue
                token[p] = rank
                token[q] = -1
                r = after[p] = after[q]
                right = token[r]
                if right >= 0:
                    before[r] = p
                    new = merges[rank << 20 | right]
                    if new >= 0:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heappush(heap, new)
                        if new < rank:
                            wait = ends[bisect.bisect_right(ends, p)]
                s = before[p]
                left = token[s]  # position -1 is the closing stop
                if left >= 0:
                    new = merges[left << 20 | rank]
                    if new >= 0:
                        if new in index:
                            index[new].append(s)
                        else:
                            index[new] = [s]
                            heappush(heap, new)
                        if new < rank:
                            wait = ends[bisect.bisect_right(ends, p)]
        left = np.array(token[:n], np.int64)
        alive = left >= 0
        counts = np.diff(np.concatenate([[0], np.cumsum(alive)])[starts])
        ids, at, out = left[alive].tolist(), 0, []
        for count in counts.tolist():
            out.append(ids[at : at + count])
            at += count
        return out

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that lists of ids (end to end, with the number in each) spell, end to end, and where each list ends."""
        sizes = self.starts[ids + 1] - self.starts[ids]
        spelled, ends = gather(self.letters, self.starts[ids], sizes)
        return spelled, np.concatenate([[0], ends])[np.cumsum(lengths)]


def encoder(path: str, pattern: str) -> tuple[MergeReplay, ChunkEncoder]:
    """Replay and chunk cache of a rank file, kept by the worker process."""
    import regex

    state = worker_state("tokens", f"ranks:{path}")
    if "replay" not in state:
        state["replay"] = MergeReplay(load_ranks(path))
    replay = state["replay"]
    # the pattern's white space is Unicode's White_Space property
    split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return pieces_to_chunks(split_pieces(chunks, split.findall), lambda pieces: replay.encode([p.encode() for p in pieces]))

    return replay, ChunkEncoder(f"{path}:{pattern}", encode, special=False)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every whole text; null and empty texts have none.

    ``path`` is a rank file that every executor can open; ``pattern`` cuts a text into the
    words inside which merges happen.
    """

    def make():
        _, run = encoder(path, pattern)

        def work(batch):
            ids, lengths = run(batch.column("text").to_pylist())
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            return {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))}

        return work

    rows = texts(docs)
    return map_batches(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded``, the bytes that the ids spell (null ids: none)."""

    def make():
        replay, _ = encoder(path, pattern)

        def work(batch):
            ids = batch.column("ids")
            lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            spelled, ends = replay.decode(ids.flatten().to_numpy(zero_copy_only=False), lengths)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32)).buffers()[1]
            decoded = pa.Array.from_buffers(pa.binary(), len(ids), [None, offsets, pa.py_buffer(spelled)])
            return {"doc_id": batch.column("doc_id"), "ids": ids, "decoded": decoded}

        return work

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_batches(encoded.select("doc_id", "ids"), make, f"doc_id {kind}, ids array<int>, decoded binary")
