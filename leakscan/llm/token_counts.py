"""Exact token counts of every prefix of every text, by prefix dynamic programming.

A text is cut into units whose tokens don't depend on their surroundings. One pass over a unit finds the
last token, and so the count, of each of its prefixes; units that come again are looked up. The counts
of a text are stored as one signed byte per character: the change of the count. A sum over the first k bytes
is the exact count of the first k characters, and the last place where the running sum is within a
budget is where to truncate; neither needs the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leakscan.llm.bpe import UnitBytes, Vocabulary, cut_specials
from leakscan.llm.common import per_process

LIMIT = 512


def _steps(counts: list[int]) -> bytes:
    return bytes([b - a & 255 for a, b in zip(counts, counts[1:], strict=False)])


class PrefixCounter:
    """Count changes per character of a text, with the library's default handling of special strings: each is one token."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known = UnitBytes(lambda unit: _steps(self.vocabulary.unit_counts(unit)))

    def steps(self, text: str) -> bytes:
        pieces = cut_specials(text, self.vocabulary.specials)
        if len(pieces) == 1:
            return self.known.of(text)
        out = []
        for ordinary, special in zip(pieces[::2], [*pieces[1::2], None], strict=True):
            found = self.known.split(ordinary)
            if special is not None:  # its prefixes are ordinary text that goes on after the last unit
                last = found.pop() if found else ""
            out += map(self.known.by_unit.__getitem__, found)
            if special is not None:
                out.append(_steps(self._up_to_special(last, special)))
        return b"".join(out)

    def _up_to_special(self, last: str, special: str) -> list[int]:
        counts = [0]
        for end in range(1, len(last) + len(special)):
            units = self.known.split((last + special)[:end]) if end > len(last) else [last[:end]]
            counts.append(sum(self.vocabulary.unit_counts(u)[-1] for u in units))
        return [*counts, counts[len(last)] + 1]


def tokens_in_prefix(steps: bytes, characters: int) -> int:
    """Tokens of the first so many characters."""
    return int(np.frombuffer(steps, np.int8, min(characters, len(steps))).sum(dtype=np.int64))


def longest_prefix(steps: bytes, budget: int) -> int:
    """The most characters from the start whose tokens are within the budget."""
    counts = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def prefix_token_counts(docs: DataFrame, path: str, limit: int = LIMIT, keep_steps: bool = True) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``, ``fit_chars`` and ``steps``.

    ``fit_chars`` is the length of the longest prefix with at most ``limit`` tokens; ``steps`` the count changes per
    character. ``path`` is a byte-level tokenizers file. A null text counts as empty; every row is counted by itself.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_process("counter", path, PrefixCounter)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                steps = counter.steps(text)
                tokens = tokens_in_prefix(steps, len(steps))
                rows.append((len(text.encode()), tokens, tokens > limit, longest_prefix(steps, limit), steps if keep_steps else None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "steps"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, steps binary"
    counted = docs.select("doc_id", "text").mapInArrow(count, schema)
    return counted if keep_steps else counted.drop("steps")


def token_count_report(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """The counts without the stored prefixes."""
    return prefix_token_counts(docs, path, limit, keep_steps=False)
