"""Language identification by compression.

One zstandard dictionary per language holds raw text of that language.  A text belongs to the
language whose dictionary compresses it best.  The margin over the second best says how clear
that is; a narrow margin rejects the text.  Texts are lower-cased and reduced to their letters
before, so that capitals, digits and symbols neither help nor hurt.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from zstandard import DICT_TYPE_RAWCONTENT, ZstdCompressionDict, ZstdCompressor

from evistrata.llm.base import filter_texts, labelled_sample, map_batches, texts

NOT_LETTERS = re.compile(r"[\W\d_]+")
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """``sample_docs`` and ``sample_chars`` bound what training reads on the driver (documents
    of a language, and length of one); ``dictionary_bytes`` bounds a dictionary.  Texts are
    compressed in blocks of ``block_bytes`` so that the dictionary is equally near everywhere.
    A margin under ``min_margin`` (share of the compressed size), under ``min_bytes``, or under
    ``slack`` times the ``quantile`` of the margins of sampled rows of about the same length
    rejects; lengths (bytes of letters) are split at ``lengths``, and fewer than ``least_rows``
    rows of a length tell nothing."""

    sample_docs: int = 400
    sample_chars: int = 20_000
    dictionary_bytes: int = 256 << 10
    block_bytes: int = 8 << 10
    level: int = 6
    min_margin: float = 0.001
    min_bytes: int = 2
    quantile: float = 0.01
    slack: float = 0.5
    lengths: tuple[int, ...] = (200, 1000)
    least_rows: int = 30


class Dictionaries(dict):
    """A dictionary per label, and the least margin per class of length that their sample suggests."""

    floors: tuple[float, ...] = ()


def letters(text: str) -> str:
    return NOT_LETTERS.sub(" ", text.lower()).strip()


def learn(docs: DataFrame, label: str = "lang", settings: Settings = Settings()) -> Dictionaries:
    """A dictionary per label, from a bounded sample of the rows (``doc_id``, ``text``, label).

    Each half of the sample is also judged by dictionaries of the other half; the margins of the
    rows that come out right show how narrow a margin a clean text may have.  Rows without label or
    letters, and texts of over ``sample_chars`` characters, teach nothing.  Of rows that share an
    id any may be drawn, by a hash of their values.  Labels without any usable row are not learned.
    """
    usable = texts(docs, label).filter(F.length("text") <= settings.sample_chars)
    found: dict[str, dict[str, None]] = {}
    for row in labelled_sample(usable, label, settings.sample_docs):
        if text := letters(row["text"]):
            found.setdefault(str(row[label]), {})[text] = None
    def join(lines: list[str]) -> bytes:
        return "\n".join(lines).encode()[: settings.dictionary_bytes]

    learned = Dictionaries((name, join(list(lines))) for name, lines in sorted(found.items()))
    learned.floors = _floors({name: list(lines) for name, lines in found.items()}, join, settings)
    return learned


def _length_class(size: int, settings: Settings) -> int:
    return bisect_right(settings.lengths, size)


def _floors(found: dict[str, list[str]], join, settings: Settings) -> tuple[float, ...]:
    """Per class of length, ``slack`` times the ``quantile`` of the margins of rows judged right by the other half."""
    margins: list[list[float]] = [[] for _ in range(len(settings.lengths) + 1)]
    for half in (0, 1):
        judge = _judge({name: join(lines[1 - half :: 2]) for name, lines in found.items() if lines[1 - half :: 2]}, settings)
        for name, lines in found.items():
            for text in lines[half::2]:
                best, _, margin, _ = judge(text)
                if best == name:
                    margins[_length_class(len(text.encode()), settings)].append(margin)
    return tuple(
        max(settings.min_margin, settings.slack * sorted(rows)[int(settings.quantile * len(rows))]) if len(rows) >= settings.least_rows else settings.min_margin
        for rows in margins
    )


def _judge(dictionaries: dict[str, bytes], settings: Settings):
    """The function from a text to language, score, margin and acceptance."""
    names, block = sorted(dictionaries), settings.block_bytes
    floors = getattr(dictionaries, "floors", ()) or (settings.min_margin,) * (len(settings.lengths) + 1)
    tools = []
    for name in names:
        raw = ZstdCompressionDict(dictionaries[name], dict_type=DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=settings.level)
        tools.append(ZstdCompressor(dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False))

    def judge(text: str) -> tuple[str, float, float, bool]:
        data = letters(text)
        if not tools or not any(map(str.isalpha, data)):
            return UNDETERMINED, 0.0, 0.0, False
        data = data.encode()
        blocks = [data[i : i + block] for i in range(0, len(data), block)]
        ranked = sorted((sum(len(tool.compress(b)) for b in blocks), name) for tool, name in zip(tools, names))
        if len(ranked) == 1:
            return names[0], 1.0, 1.0, True
        margin = 1.0 - ranked[0][0] / ranked[1][0]
        floor = max(floors[_length_class(len(data), settings)], settings.min_bytes / ranked[1][0])
        return ranked[0][1], margin / (margin + floor) if margin else 0.0, margin, margin >= floor

    return judge


def identify(docs: DataFrame, dictionaries: dict[str, bytes], settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``accepted`` per row.

    A text without letters (also null or empty) is ``und``, score 0, not accepted.  Equal
    sizes go to the first language in alphabetical order, with margin 0.  ``score`` is
    ``m / (m + f)`` of the margin ``m`` and the narrowest accepted margin ``f`` at the text's length.  With
    a single language every text with letters is accepted as that language, score 1; with
    none every text is ``und``.
    """

    def make():
        judge = _judge(dictionaries, settings)

        def work(batch):
            lang, score, margin, accepted = zip(*map(judge, batch.column("text").to_pylist()))
            return {"doc_id": batch.column("doc_id"), "lang_pred": lang, "score": score, "margin": margin, "accepted": accepted}

        return work

    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, make, f"doc_id {kind}, lang_pred string, score double, margin double, accepted boolean")


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose language is clear, with all their columns, in one pass."""
    return filter_texts(docs, lambda: lambda rows, judge=_judge(dictionaries, settings): [judge(text)[3] for text in rows])
