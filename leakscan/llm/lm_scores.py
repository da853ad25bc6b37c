"""Stupid-backoff scores of documents by a language model of the whole corpus.

The count tables of n-grams are partitioned by hash. The n-grams of a batch of documents are exploded, counted
once per batch and joined to those tables through packed messages; the totals come back to the batch
and are summed per document. A document's own counts are taken off, so no document vouches for itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leakscan.llm.common import materialize
from leakscan.llm.exchange import answer, answers_of, ask, ranges_for, text_batches, unpack_table
from leakscan.llm.shingles import WordHashes, scramble, word_hashes

ORDER = 2
BACKOFF = 0.4
_WORDS = 0


def _grams(table: pa.Table, order: int):
    """Lengths of the texts in words, and per n the hash of the n-gram that ends at each word; 0 where the text is not that long yet."""
    cache = WordHashes()
    texts = [word_hashes(x, cache, lower=False) for x in table.column("text").to_pylist()]
    lengths = np.array([len(x) for x in texts], np.int64)
    words = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    found, running = {}, np.zeros(len(words), np.uint64)
    for n in range(1, order + 1):
        before = np.concatenate([np.zeros(1, np.uint64), running[:-1]]) if len(words) else running
        running = scramble((before if n > 1 else 0) * np.uint64(0xD6E8FEB86659FD93) + words + np.uint64(n))
        running[running == 0] = 1
        found[n] = np.where(place >= n - 1, running, np.uint64(0))
        running = found[n]
    return lengths, found


def _counted(order: int):
    def count(table: pa.Table):
        lengths, found = _grams(table, order)
        keys = {_WORDS: (np.zeros(1, np.uint64), np.array([lengths.sum()], np.uint64))}
        for n, hashes in found.items():
            names, counts = np.unique(hashes[hashes > 0], return_counts=True)
            keys[n] = (names, counts.astype(np.uint64))
        return keys

    return count


def _summed(kind: int, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    _, where = np.unique(keys, return_inverse=True)
    totals = np.zeros(where.max() + 1, np.uint64)
    np.add.at(totals, where, values)
    return totals[where]


def _others(hashes: np.ndarray, keys: np.ndarray, totals: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per word: how often other documents have the n-gram that ends there."""
    at = np.where(hashes > 0, np.searchsorted(keys, hashes), len(keys))
    _, where, own = np.unique(doc * np.int64(len(keys) + 1) + at, return_inverse=True, return_counts=True)
    return np.where(hashes > 0, np.append(totals, 0.0)[at] - own[where], 0)


def _scored(order: int, backoff: float):
    def score(left, right):
        out = []
        for data in left.column("data"):
            table = unpack_table(data.as_py())
            lengths, found = _grams(table, order)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            total = float(answers_of(right, _WORDS)[0]) - lengths[doc]
            others = {n: _others(h, np.unique(h[h > 0]), answers_of(right, n).astype(np.float64), doc) for n, h in found.items()}
            chance = np.where(others[1] > 0, others[1], 1) / np.where(others[1] > 0, total, total + 1)
            longest = (others[1] > 0).astype(np.int64)
            for n in range(2, order + 1):
                history = np.concatenate([[0.0], others[n - 1][:-1]]) if len(doc) else others[n - 1]
                seen, there = others[n] > 0, found[n] > 0
                chance = np.where(there, np.where(seen, others[n] / np.where(seen, history, 1), backoff * chance), chance)
                longest = np.where(seen, n, longest)
            logs = np.bincount(doc, np.log(chance), len(lengths))
            full = np.bincount(doc, longest == order, len(lengths)).astype(np.int64)
            unseen = np.bincount(doc, longest == 0, len(lengths)).astype(np.int64)
            mean = [None if n == 0 else float(x) / int(n) for x, n in zip(logs, lengths, strict=True)]
            out.append(pa.table({
                "doc_id": table.column("doc_id"), "n_words": lengths, "n_full": full, "n_unseen": unseen, "log_score": pa.array(logs, pa.float64()), "mean_score": pa.array(mean, pa.float64()),
            }))
        return pa.concat_tables(out)

    return score


def backoff_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """Per row of ``docs``: ``n_words``, the sum ``log_score`` and mean ``mean_score`` of the words' log scores, how many
    words were seen elsewhere with their full history (``n_full``) and how many not at all (``n_unseen``).

    A word is scored by the longest history with which other documents have it, times ``backoff`` for every shorter step; an unseen word
    counts as one in all words but one's own and one more. Words are runs of anything but white space, as they are written. Null and empty
    texts have no words, score 0 and no mean. Repeated rows are documents of their own and vouch for each other.
    N-grams are told apart by 64-bit hash.
    """
    batches = text_batches(docs)
    answers = materialize(answer(ask(batches, ranges_for(batches), _counted(order)), _summed), "answers", "zstd")
    schema = "doc_id long, n_words long, n_full long, n_unseen long, log_score double, mean_score double"
    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_scored(order, backoff), schema)
