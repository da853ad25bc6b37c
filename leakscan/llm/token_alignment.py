"""Tokens of two tokenizers over the same text, linked where their bytes overlap.

Both token sequences cover the same bytes. Their incidence with the bytes are sparse matrices in compressed rows, A (tokens of the first
tokenizer by bytes) and B; the entries of A·Bᵀ say how many bytes each pair of tokens shares, so they are the overlap links.
Where tokens of both end at the same byte, both sequences are cut into groups; G·Hᵀ of their incidences with the
groups gives the pairs that share a group. Products are taken row by row (Gustavson): each entry of a row adds a row of the other matrix.

A text is cut at single spaces between other characters, where both tokenizers cut it too. A stretch that comes again is looked up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leakscan.llm.bpe import PRETOKEN, UNEVEN, Vocabulary
from leakscan.llm.common import materialize
from leakscan.llm.sentence_pieces import PieceModel
from leakscan.operators.lookup import lookup_join

PIECE_CUT = re.compile(r"(?<=\S) (?=\S)")
BATCH_BYTES = 1 << 20
PRODUCT_ENTRIES = 1 << 20
UNITS = 300_000
#: The table of id pairs is broadcast up to this many rows, each of two ids, a count and a flag: about 100 MB.
BROADCAST_PAIRS = 2_000_000

PAIRS = "array<struct<a:int,b:int,n:int>>"


@dataclass(frozen=True)
class Rows:
    """A sparse matrix in compressed rows: row i has entries ``starts[i]`` to ``starts[i + 1]``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def of_spans(cls, starts: np.ndarray, width: int) -> Rows:
        """Row i has a one in each column from ``starts[i]`` to ``starts[i + 1]``."""
        return cls(starts, np.arange(starts[0], starts[-1]), np.ones(starts[-1] - starts[0], np.int64), width)

    def transposed(self) -> Rows:
        row = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Rows(starts, row[order], self.values[order], len(self.starts) - 1)


def row_products(left: Rows, right: Rows) -> Rows:
    """``left`` times ``right``: entry (i, k) of a row adds row k of ``right``; columns of a row ascend.

    Rows are taken in blocks, so that the added entries held at a time are bounded unless one row has more.
    """
    sizes = np.diff(right.starts)[left.columns]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    by_row, count = upto[left.starts], len(left.starts) - 1
    lengths, columns, values, row = [], [], [], 0
    while row < count:
        stop = max(row + 1, int(np.searchsorted(by_row, by_row[row] + PRODUCT_ENTRIES, side="right")) - 1)
        low, high = left.starts[row], left.starts[stop]
        many, total = sizes[low:high], int(upto[high] - upto[low])
        place = np.arange(total) - np.repeat(upto[low:high] - upto[low], many) + np.repeat(right.starts[left.columns[low:high]], many)
        of_row = np.repeat(np.repeat(np.arange(stop - row), np.diff(left.starts[row : stop + 1])), many)
        key, added = of_row * right.width + right.columns[place], np.repeat(left.values[low:high], many) * right.values[place]
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, added = key[order], added[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if total else np.zeros(0, np.int64)
        lengths.append(np.bincount(key[first] // right.width, minlength=stop - row))
        columns.append(key[first] % right.width)
        values.append(np.add.reduceat(added, first) if total else added)
        row = stop
    joined = [np.concatenate(part) if part else np.zeros(0, np.int64) for part in (lengths, columns, values)]
    return Rows(np.concatenate([[0], np.cumsum(joined[0])]).astype(np.int64), joined[1], joined[2], right.width)


@dataclass(frozen=True)
class Alignment:
    """Two cuts of the same bytes: where their tokens and groups end, and the links as (token of A, token of B) pairs."""

    ends: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    links: Rows

    @classmethod
    def of(cls, lengths_a: np.ndarray, lengths_b: np.ndarray) -> Alignment:
        starts_a, starts_b = (np.concatenate([[0], np.cumsum(n)]).astype(np.int64) for n in (lengths_a, lengths_b))
        width = int(starts_a[-1])
        links = row_products(Rows.of_spans(starts_a, width), Rows.of_spans(starts_b, width).transposed())
        ends = np.intersect1d(starts_a[1:], starts_b[1:], assume_unique=True)
        return cls(ends, np.searchsorted(ends, starts_a[1:]), np.searchsorted(ends, starts_b[1:]), links)

    def group_incidence(self) -> tuple[Rows, Rows]:
        width = len(self.ends)
        return tuple(Rows(np.arange(len(g) + 1), g, np.ones(len(g), np.int64), width) for g in (self.group_a, self.group_b))

    def shared_group_links(self) -> Rows:
        """The pairs of tokens that share a group; as many as a group's tokens of A times those of B."""
        ours, theirs = self.group_incidence()
        return row_products(ours, theirs.transposed())

    def shared_group_sizes(self) -> np.ndarray:
        """How many tokens of B share a group with each token of A: the row lengths of that product, without its entries."""
        ours, theirs = self.group_incidence()
        return np.diff(theirs.transposed().starts)[ours.columns]


class TokenPair:
    """Both tokenizers: a byte-level tokenizers file (A) and a piece model (B), special strings being ordinary text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        vocabulary = Vocabulary(path_a)
        if vocabulary.ordered:  # the ids are ranks, which the faster library takes
            self.first = tiktoken.Encoding("ids", pat_str=PRETOKEN, mergeable_ranks=vocabulary.ids, special_tokens={}).encode_ordinary
        else:
            library = Tokenizer.from_file(path_a)
            library.encode_special_tokens = True
            self.first = lambda text: library.encode(text, add_special_tokens=False).ids
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        model = PieceModel(path_b)
        self.bytes_a = [vocabulary.bytes.get(i, b"") for i in range(max(vocabulary.bytes) + 1)]
        self.bytes_b, self.cuts = model.token_bytes(), model.cuts
        self.size_a, self.size_b = (np.array([len(b) for b in table], np.int64) for table in (self.bytes_a, self.bytes_b))

    def units(self, text: str) -> list[str]:
        """Space and text in stretches whose tokens don't depend on their surroundings."""
        if not text:
            return []
        if not self.cuts:
            return [" " + text]
        if UNEVEN.search(text) or text[0] == " " or text[-1] == " ":
            return [" " + unit if i else unit for i, unit in enumerate(PIECE_CUT.split(" " + text))]
        return [" " + unit for unit in text.split(" ")]

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both tokenizers for a text that begins with a space; None unless both give it back byte by byte."""
        found = self.first(text), self.pieces.encode(text[1:])
        raw = text.encode()
        for ids, table in zip(found, (self.bytes_a, self.bytes_b), strict=True):
            if b"".join(map(table.__getitem__, ids)) != raw:
                return None
        return tuple(np.array(ids, np.int64) for ids in found)


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")


class Aligner:
    """Aligned units in columns: counts, groups as text with a semicolon behind each, and a number per link, id of A times ids of B plus id of B."""

    def __init__(self, tokens: TokenPair):
        self.tokens = tokens
        names_a, names_b = ([str(i) for i in range(len(table))] for table in (tokens.bytes_a, tokens.bytes_b))
        #: How an id is written: first where another one of its group and tokenizer follows, then where none does.
        self.written_a = np.array([n + "," for n in names_a] + [n + "|" for n in names_a], object)
        self.written_b = np.array([n + "," for n in names_b] + [n + ";" for n in names_b], object)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.good = np.zeros(0, bool)
        self.counts = np.zeros((0, len(COUNTS)), np.int64)
        self.groups: list[str] = []
        self.starts, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def learn(self, units: list[str]) -> None:
        """Align distinct new units. Those that stand alone between single spaces are strung together and encoded in one go."""
        for part in _parts(units):
            alone = [self.tokens.cuts and len(u) > 1 and not u[1].isspace() and not u[-1].isspace() for u in part]
            strung = [u for u, a in zip(part, alone, strict=True) if a]
            ids = self.tokens.ids("".join(strung)) if strung else None
            found = {} if ids is None else {"".join(strung): (strung, ids)}
            for unit in part if ids is None else [u for u, a in zip(part, alone, strict=True) if not a]:
                found[unit] = [unit], self.tokens.ids(unit)
            whole = [(names, ids) for names, ids in found.values() if ids is not None]
            if whole:
                both = zip(*[ids for _, ids in whole], strict=True)
                self._add([name for names, _ in whole for name in names], tuple(np.concatenate(ids) for ids in both))
            self._add([names[0] for names, ids in found.values() if ids is None], None)

    def _add(self, units: list[str], ids: tuple[np.ndarray, np.ndarray] | None) -> None:
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        self.good = np.concatenate([self.good, np.full(len(units), ids is not None)])
        if ids is None:
            self.counts = np.concatenate([self.counts, np.zeros((len(units), len(COUNTS)), np.int64)])
            self.groups += [""] * len(units)
            self.starts = np.concatenate([self.starts, np.full(len(units), self.starts[-1])])
            return
        ids_a, ids_b = ids
        found = Alignment.of(self.tokens.size_a[ids_a], self.tokens.size_b[ids_b])
        ends = np.cumsum([len(u.encode()) for u in units])
        group = np.concatenate([[0], np.searchsorted(found.ends, ends) + 1])
        first_a, first_b = (np.searchsorted(of, np.arange(len(found.ends) + 1)) for of in (found.group_a, found.group_b))
        a, b = first_a[group], first_b[group]
        link, shared = found.links.starts, np.concatenate([[0], np.cumsum(found.shared_group_sizes())])
        self.counts = np.concatenate([self.counts, np.stack([np.diff(x) for x in (a, b, group, link[a], shared[a])], axis=1)])
        self.pairs = np.concatenate([self.pairs, np.repeat(ids_a, np.diff(link)) * len(self.tokens.bytes_b) + ids_b[found.links.columns]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + link[a[1:]]])
        # a group's tokens of A, then those of B
        text = np.empty(len(ids_a) + len(ids_b), object)
        ends_a, ends_b = (np.append(of[1:] != of[:-1], True) for of in (found.group_a, found.group_b))
        text[np.arange(len(ids_a)) + first_b[found.group_a]] = self.written_a[ids_a + ends_a * len(self.tokens.bytes_a)]
        text[np.arange(len(ids_b)) + first_a[found.group_b + 1]] = self.written_b[ids_b + ends_b * len(self.tokens.bytes_b)]
        text, cuts = text.tolist(), (a + b).tolist()
        self.groups += ["".join(text[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]

    def of_texts(self, texts: list[str]) -> Aligned:
        cut = [self.tokens.units(text) for text in texts]
        if len(self.known) > UNITS or len(self.pairs) > 8 * UNITS:
            self.clear()
        self.learn(list({unit: None for units in cut for unit in units if unit not in self.known}))
        unit = np.fromiter((i for units in cut for i in map(self.known.__getitem__, units)), np.int64)
        text = np.repeat(np.arange(len(texts)), [len(units) for units in cut])
        whole = np.ones(len(texts), bool)
        whole[text[~self.good[unit]]] = False
        unit, text = unit[whole[text]], text[whole[text]]
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        sums = np.concatenate([np.zeros((1, len(COUNTS)), np.int64), np.cumsum(self.counts[unit], axis=0)])
        names = list(map(self.groups.__getitem__, unit.tolist()))
        groups = ["".join(names[i:j])[:-1] for i, j in zip(bounds, bounds[1:], strict=False)]
        many = self.counts[unit, COUNTS.index("n_links")]
        place = np.arange(int(many.sum())) + np.repeat(self.starts[unit] - (np.cumsum(many) - many), many)
        return Aligned(np.diff(sums[bounds], axis=0), groups, np.repeat(text, many), self.pairs[place])


@dataclass(frozen=True)
class Aligned:
    """Texts with their counts (one column per name in COUNTS), groups, and links as (number of the text, number of the pair)."""

    counts: np.ndarray
    groups: list[str]
    text: np.ndarray
    pair: np.ndarray

    def as_batch(self, ids: pa.Array, width: int) -> pa.RecordBatch:
        """Counts, groups and distinct id pairs with their number, per text; ``width`` is the number of ids of B."""
        top = int(self.pair.max(initial=0)) + 1
        key = np.sort(self.text * top + self.pair)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        number, key = np.diff(np.append(first, len(key))), key[first]
        starts = np.searchsorted(key, np.arange(len(self.groups) + 1) * top)
        parts = [pa.array(x.astype(np.int32)) for x in (key % top // width, key % top % width, number)]
        lists = pa.ListArray.from_arrays(starts.astype(np.int32), pa.StructArray.from_arrays(parts, ["a", "b", "n"]))
        sums = [pa.array(np.ascontiguousarray(column)) for column in self.counts.T]
        return pa.RecordBatch.from_arrays([ids, *sums, pa.array(self.groups, pa.string()), lists], ["doc_id", *COUNTS, "groups", "pairs"])


def _parts(units: list[str]) -> Iterator[list[str]]:
    part, held = [], 0
    for unit in units:
        part.append(unit)
        held += len(unit)
        if held >= BATCH_BYTES // 2:
            yield part
            part, held = [], 0
    if part:
        yield part


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_group_links``, ``groups`` and ``pairs``.

    Space and text are encoded by a byte-level tokenizers file (A), the text by a piece model (B), which puts the space first.
    ``groups`` has the ids in order, as in ``a1,a2|b1;a3|b2,b3``; ``pairs`` the distinct linked id pairs with their number of links.
    Null and empty texts, and those that a tokenizer does not give back byte by byte, have no tokens: zeros, an empty text, no
    pairs. A null id stays null, rows that come again are aligned one by one, an empty table gives no rows, other columns are not read.
    """

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(TokenPair(path_a, path_b))
        for batch in batches:
            start, texts, held = 0, [], 0
            for row in range(batch.num_rows):
                texts.append(batch.column("text")[row].as_py() or "")
                held += len(texts[-1])
                if held >= BATCH_BYTES or row + 1 == batch.num_rows:
                    yield aligner.of_texts(texts).as_batch(batch.column("doc_id").slice(start, len(texts)), len(aligner.tokens.bytes_b))
                    start, texts, held = row + 1, [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups string, pairs {PAIRS}"
    return docs.select("doc_id", "text").mapInArrow(aligned, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Links of each id pair over all rows of ``aligned`` as ``total``; ``best`` says whether no pair with that id of B has more."""
    counts = aligned.selectExpr("inline(pairs)").groupBy("a", "b").agg(F.sum("n").alias("total"))
    counts = materialize(counts, "pair_counts")
    most = counts.groupBy("b").agg(F.max("total").alias("most"))
    return counts.join(most, "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))


def scored(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` without ``pairs``, with ``n_best`` (links whose pair has the highest count for its id of B) and ``count_sum``.

    Counts are made over all rows. Their table is counted; beyond ``broadcast_pairs`` rows it is joined by a
    shuffle in which frequent pairs are salted.
    """
    rows = materialize(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned", "zstd")
    counts = materialize(pair_counts(rows), "counts")
    size, links = counts.agg(F.count("*"), F.sum("total")).first()
    held = rows.selectExpr("_row", "inline(pairs)")
    if size <= broadcast_pairs:
        held = held.join(F.broadcast(counts), ["a", "b"])
    else:
        held = lookup_join(held, counts, ["a", "b"], "inner", "total", links, 0)
    sums = held.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs").join(sums, "_row", "left").drop("_row").withColumns({name: F.coalesce(name, zero) for name in ("n_best", "count_sum")})


def alignment_report(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``scored`` rows with a digest instead of the groups; empty where there are no tokens."""
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups"), 256))
    return scored(aligned.withColumn("groups_sha256", digest).drop("groups"), broadcast_pairs).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"
    )


__all__ = ["Aligned", "Aligner", "Alignment", "Rows", "TokenPair", "align_tokens", "alignment_report", "pair_counts", "row_products", "scored"]
