"""Fast exact encoding of whole texts by caching the ids of their chunks.

Tokenizers that split a text at white space before merging give the same ids chunk by chunk.
A chunk is a run without white space together with the one space before it.  A worker keeps
the ids of the chunks that it has met, up to a bound in bytes, after which it starts anew; the
ids never depend on what is kept.  White space other than single spaces and line ends is cut
by the same rule as in the tokenizer; a text with any further kind of white space, or with the
start of a special token, is one chunk.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable
from itertools import chain

import numpy as np

from evistrata.llm.base import worker_state

#: A chunk; a run of white space but its last character, or all of it at the end; a single one.
CHUNK = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]")
LITERAL = "\x00"


def chunk_keys(text: str, special: bool) -> list[str]:
    """Cache keys of the chunks of a text.

    A key is the chunk without its leading space; ``LITERAL`` marks a chunk that has none.  A
    line end keeps its place at the head of the key.
    """
    if not text:
        return []
    if special and "<|" in text or not text.replace("\n", "").isprintable():
        return [LITERAL + text]
    if not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n"):
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = LITERAL + keys[0]
        return keys
    return [c[1:] if c[0] == " " and len(c) > 1 and c[1] not in " \n" else LITERAL + c for c in CHUNK.findall(text)]


def chunk_of(key: str) -> str:
    return key[1:] if key[0] == LITERAL else key if key[0] == "\n" else " " + key


class _Index(dict):
    """Place of each chunk; a chunk asked for the first time gets the next place and is noted as new."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        place = self[key] = len(self)
        self.new.append(key)
        return place


class _Store:
    """Ids of the known chunks, end to end, with the place of each chunk."""

    def __init__(self) -> None:
        self.index = _Index()
        self.ids = np.empty(1 << 16, np.int32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.bytes = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of the new chunks."""
        count = len(self.index) - len(self.index.new)
        used = self.ends[count]
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while len(self.index) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[used : used + len(ids)] = ids
        self.ends[count + 1 : len(self.index) + 1] = used + np.cumsum(lengths)
        self.bytes += 190 * len(lengths) + sum(map(len, self.index.new)) + 4 * len(ids)
        self.index.new = []


class ChunkEncoder:
    """Encodes lists of texts.  ``encode`` maps chunks to their ids end to end and the number of each."""

    def __init__(self, name: str, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: bool, bound: int = 320 << 20):
        self.encode, self.special, self.bound, self.state = encode, special, bound, worker_state("tokens", "chunks:" + name)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end and the number of each text.

        Nothing here makes reference cycles, so the collector would only walk millions of
        short-lived lists for nothing; it rests meanwhile.
        """
        running = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if running:
                gc.enable()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        store = self.state.get("store")
        if store is None or store.bytes > self.bound:
            store = self.state["store"] = _Store()
        keys: list[str] = []
        counts = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = chunk_keys(text, self.special)
            keys += own
            counts[i] = len(own)
        place = np.fromiter(map(store.index.__getitem__, keys), np.int64, len(keys))
        if store.index.new:
            try:
                store.add(*self.encode([chunk_of(key) for key in store.index.new]))
            except BaseException:
                del self.state["store"]  # it names chunks that have no ids
                raise
        starts = store.ends[place]
        lengths = store.ends[place + 1] - starts
        ids, ends = gather(store.ids, starts, lengths)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(bounds)


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``values[start : start + length]`` end to end, and where each ends."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], ends


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(lengths.sum())), lengths


def split_pieces(chunks: list[str], findall: Callable[[str], list[str]]) -> list[list[str]]:
    """Pieces of each chunk; a word, alone or before one comma or full stop, needs no pattern."""
    out = []
    for chunk in chunks:
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():
            out.append([chunk])
        elif chunk[-1] in ",." and word[:-1].isalpha():
            out.append([chunk[:-1], chunk[-1]])
        else:
            out.append(findall(chunk))
    return out


def pieces_to_chunks(chunks: list[list[str]], encode_pieces: Callable[[list[str]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids per chunk from the ids of its pieces; each distinct piece is encoded once."""
    distinct = list(set(chain.from_iterable(chunks)))
    known = dict(zip(distinct, encode_pieces(distinct)))
    return flat([known[chunk[0]] if len(chunk) == 1 else [i for piece in chunk for i in known[piece]] for chunk in chunks])


def _halves(merge) -> tuple[str, ...]:
    """Both sides of a merge, which files give as a pair or with a space between."""
    return tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge)


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a ``tokenizers`` file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


def library_encoder(path: str) -> ChunkEncoder:
    """Encoder with the ``tokenizers`` library, ``add_special_tokens=False``, for a BPE file.

    Chunks go through the file's whole pipeline, except those of letters, digits and ASCII
    punctuation: their pieces are cut here by the file's pattern and go to its merges directly,
    which skips the library's alignment work.
    """
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import regex
    from tokenizers import Tokenizer, models

    def load():
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        whole = Tokenizer.from_file(path)
        bare = Tokenizer.from_file(path)
        bare.pre_tokenizer = None
        bare.normalizer = None
        lower = spec["normalizer"] is not None
        if lower:
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        else:
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return whole, bare, lower, regex.compile(pattern), spec

    state = worker_state("tokens", "library:" + path)
    if "loaded" not in state:
        state["loaded"] = load()
    whole, bare, lower, pattern, spec = state["loaded"]
    alphabet = byte_alphabet() | {0: LITERAL}
    # composed Latin letters and ASCII: neither changed by NFC nor by context when lower-cased
    plain = regex.compile(r"[ \n!-~À-ÖØ-öø-įĲ-ňŊ-ž]*")

    # pieces around it never merge with it, and no text holds its byte
    model, stop = spec["model"], alphabet[0xFF]
    standing = not (lower or model["dropout"] or model["continuing_subword_prefix"] or model["end_of_word_suffix"] or model.get("ignore_merges"))
    standing = standing and stop in model["vocab"] and not any(stop in pair[0] or stop in pair[-1] for pair in map(_halves, model["merges"]))
    together = alphabet | {0: stop}

    def merges(pieces: list[str]) -> list[list[int]]:
        if not pieces:
            return []
        shown = LITERAL.join(pieces).encode().decode("latin-1").translate(alphabet).split(LITERAL)
        return [e.ids for e in bare.encode_batch_fast(shown, add_special_tokens=False)]

    def merged_together(chunks: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids per chunk from its pieces, which go to the library side by side with a stop after each."""
        pieces = list(chain.from_iterable(chunks))
        runs = [LITERAL.join(pieces[i : i + 512]) + LITERAL for i in range(0, len(pieces), 512)]
        shown = [run.encode().decode("latin-1").translate(together) for run in runs]
        parts = [np.array(e.ids, np.int32) for e in bare.encode_batch_fast(shown, add_special_tokens=False)]
        ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        stops = ids == model["vocab"][stop]
        last = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks))) - 1  # piece that ends each chunk
        ends = np.flatnonzero(stops)[last] - last
        return ids[~stops], np.diff(ends, prepend=0)

    def easy_chunks(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if lower:  # white space never joins a piece
            chunks = [chunk.lower().lstrip() or "\n" for chunk in chunks]
        pieces = split_pieces(chunks, pattern.findall)
        return merged_together(pieces) if standing else pieces_to_chunks(pieces, merges)

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(chunks)
        if plain.fullmatch(joined) and "<|" not in joined:
            return easy_chunks(chunks)
        easy = [bool(plain.fullmatch(c)) and "<|" not in c for c in chunks]
        hard = iter(whole.encode_batch([c for c, ok in zip(chunks, easy) if not ok], add_special_tokens=False))
        ids, lengths = easy_chunks([c for c, ok in zip(chunks, easy) if ok])
        parts = iter(np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else [])
        return flat([next(parts).tolist() if ok else next(hard).ids for ok in easy])

    return ChunkEncoder(path, encode, special=True)
