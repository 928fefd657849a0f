"""Line-first cleaning.

Every line is judged on its own: terminal punctuation, navigation, boilerplate, symbols,
shouting and stutter.  Failing lines go.  A document that loses too much of its text with them
is rejected, and so is one that fails the base statistics (too few words, too many repeated).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from evistrata.llm.base import map_batches, texts

# Phrases of site chrome, compared in lower case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "javascript is disabled",
    "log in to", "lorem ipsum", "privacy policy", "read more", "sign in to", "sign up for", "skip to content",
    "subscribe to our newsletter", "terms of service", "terms of use", "use of cookies", "we use cookies",
)
SYMBOLS = "#*$%&|<>"
TERMINAL = tuple(".!?…。！？:;\"'”’»›)]")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEPARATOR = frozenset("|>»›·•/")
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """A line of under ``cut_words`` words fails when it does not end like a sentence (a longer
    one is text that was cut off).  Any line fails when at least ``separators`` of its
    words are bare separators, when over ``symbol_share`` of its words hold a symbol, when over
    ``upper_share`` of its letters are capitals and it has at least ``shout_words`` words, when
    a word follows itself ``stutter`` times, or when it holds a boilerplate phrase.  A document
    needs ``min_kept`` of its word characters in the lines that stay."""

    cut_words: int = 20
    separators: int = 2
    symbol_share: float = 0.3
    upper_share: float = 0.7
    shout_words: int = 3
    stutter: int = 4
    min_kept: float = 0.5


def split_words(text: str) -> list[str]:
    return WORD.findall(text)


def line_fails(line: str, rules: Rules = Rules()) -> bool:
    words = split_words(line)
    if not words or len(words) < rules.cut_words and not words[-1].endswith(TERMINAL):
        return True
    if sum(word in SEPARATOR for word in words) >= rules.separators:
        return True
    if any(c in line for c in SYMBOLS) and sum(any(c in word for c in SYMBOLS) for word in words) > rules.symbol_share * len(words):
        return True
    if len(words) >= rules.shout_words and not line.islower():
        letters = sum(map(str.isalpha, line))
        if sum(map(str.isupper, line)) > rules.upper_share * letters:
            return True
    run = 0
    for left, right in zip(words, words[1:]):
        run = run + 1 if left == right else 0
        if run >= rules.stutter:
            return True
    lower = line.lower()
    return any(phrase in lower for phrase in BOILERPLATE)


def repeated_words(words: list[str]) -> int:
    """Words inside ``WINDOW``-word windows that occur at least twice, each word counted once.

    Windows are compared by a hash first; those whose hash repeats are compared word by word.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    suspects = np.zeros(n, bool)
    suspects[order[1:][same]] = True
    suspects[order[:-1][same]] = True
    seen: dict[tuple[str, ...], int] = {}
    starts = np.flatnonzero(suspects).tolist()
    for start in starts:
        key = tuple(words[start : start + WINDOW])
        seen[key] = seen.get(key, 0) + 1
    edges = np.zeros(len(words) + 1, np.int64)
    for start in starts:
        if seen[tuple(words[start : start + WINDOW])] > 1:
            edges[start] += 1
            edges[start + WINDOW] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def judge(text: str, rules: Rules = Rules()) -> tuple:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_chars, cleaned``."""
    words = split_words(text)
    word_chars = sum(map(len, words))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    good: list[str] = []
    n_dup_lines = kept_chars = 0
    for line in text.split("\n"):
        if not line or not WORD.search(line):
            continue
        if line in seen:
            n_dup_lines += 1
        seen.add(line)
        if not line_fails(line, rules):
            good.append(line)
            kept_chars += len(SPACE.sub("", line))
    n_repeat = repeated_words(words)
    base_failed = len(words) < 20 or 100 * n_repeat > 30 * len(words)
    kept = not base_failed and kept_chars >= rules.min_kept * word_chars
    return len(words), word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, kept, kept_chars, "\n".join(good)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars", "cleaned")


def clean(docs: DataFrame, rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """Statistics, verdict and (``with_text``) the text of the lines that stay, per row.

    Null and empty texts have no words and fail the base statistics.  A line equal to an
    earlier one counts in ``n_dup_lines``, the first does not; repeated rows are judged alike.
    """

    def make():
        def work(batch):
            columns = dict(zip(COLUMNS, zip(*[judge(text, rules) for text in batch.column("text").to_pylist()])))
            return {"doc_id": batch.column("doc_id"), **columns}

        return work

    rows = texts(docs)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, kept_chars long"
    return map_batches(rows, make, schema + ", cleaned string" * with_text)
