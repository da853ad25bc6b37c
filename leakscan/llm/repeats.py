"""Repeated passages: every byte in a 50-byte string that also starts in a document with a smaller id.

Windows of 50 bytes are dealt out by their anchor: the 20-byte string in them with the smallest hash. Equal windows
have equal anchors, so all copies of a window meet at one anchor, and the windows of an anchor form one
fragment of at most 80 bytes. Anchors that only one text has are dropped at once. Fragments that are equal
byte for byte are settled by the smallest id among their holders. Different fragments of one anchor, that is copies with
changes, go into run-length indexes: the Burrows-Wheeler transform of the fragments in id order, as runs,
with the position and match length sampled at the ends of runs. Matching statistics stream out of the
samples alone, in text order; where they reach 50, rows of the transform with equal windows form an interval,
and the smallest id in the interval owns the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from leakscan.llm.common import grouped, materialize
from leakscan.llm.exchange import answer, answers_of, ask, ranges_for, text_batches, unpack_table
from leakscan.scratch import discard

WINDOW = 50
ANCHOR = 20
#: Fragments in one index; an anchor with more of them is settled window by window.
INDEX_FRAGMENTS = 20_000
_SPAN = WINDOW - ANCHOR + 1
_LONGEST = WINDOW + _SPAN - 1
#: Windows of a text that are hashed at a time, and fragments in one record batch.
_SLICE = 1 << 18
_ROWS = 20_000
_P = np.uint64(0x9E3779B97F4A7C15)
_TEXTS, _ANCHORS = 0, 1


def _powers(n: int) -> np.uint64:
    return np.uint64(pow(int(_P), n, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ANCHOR-byte string."""
    one = data.astype(np.uint64) + np.uint64(1)
    two = one[:-1] * _P + one[1:]
    four = two[:-2] * _powers(2) + two[2:]
    eight = four[:-4] * _powers(4) + four[4:]
    sixteen = eight[:-8] * _powers(8) + eight[8:]
    count = len(data) - ANCHOR + 1
    all_ = sixteen[:count] * _powers(4) + four[16 : 16 + count]
    all_ ^= all_ >> np.uint64(32)
    all_ *= np.uint64(0xD6E8FEB86659FD93)
    return all_ ^ (all_ >> np.uint64(29))


def fragments(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each fragment of a text.

    The order among strings of a window is that of 40 bits of their hashes, then of their places, so it depends on the window alone.
    """
    found = []
    for start in range(0, len(text) - WINDOW + 1, _SLICE):
        data = np.frombuffer(text, np.uint8)[start : start + _SLICE + WINDOW - 1]
        hashes = gram_hashes(data)
        low = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while width * 2 <= _SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = _SPAN - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(place, prepend=-1))
        # the smallest of many hashes are small numbers: spread over all 64 bits, key ranges hold equal shares of them
        found.append((hashes[place[cuts]] * _P, cuts + start, np.diff(cuts, append=len(place))))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _text_name(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")


def _batch_texts(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
    return table.column("doc_id").to_pylist(), [x or b"" for x in table.column("text").to_pylist()]


def _found(table: pa.Table) -> tuple[list[int], dict[int, tuple]]:
    """Names of the texts of a batch, and the fragments of each text that can have windows."""
    names, found = [], {}
    for doc_id, text in zip(*_batch_texts(table), strict=True):
        usable = doc_id is not None and len(text) >= WINDOW
        names.append(_text_name(text) if usable else None)
        if usable and names[-1] not in found:
            found[names[-1]] = fragments(text)
    return names, found


def _anchors(found: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of a batch, and whether several of its texts have them."""
    anchors, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.unique(f[0]) for f in found.values()]]), return_counts=True)
    return anchors, (counts > 1).astype(np.uint64)


def _keys(table: pa.Table):
    """Names of texts with the smallest id that has them here, and anchors with a number for the texts that have them."""
    names, found = _found(table)
    first: dict[int, int] = {}
    for name, doc_id in zip(names, table.column("doc_id").to_pylist(), strict=True):
        if name is not None:
            first[name] = min(doc_id, first.get(name, doc_id))
    order = np.array(sorted(first), np.uint64)
    return {_TEXTS: (order, np.array([first[int(x)] for x in order], np.int64).view(np.uint64)), _ANCHORS: _anchors(found)}


def _merged(kind: int, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The smallest id with a text; whether an anchor is in more than one text."""
    unique, where = np.unique(keys, return_inverse=True)
    if kind == _TEXTS:
        least = np.full(len(unique), np.iinfo(np.int64).max)
        np.minimum.at(least, where, values.view(np.int64))
        return least[where].view(np.uint64)
    several = np.bincount(where, minlength=len(unique)) > 1
    several |= np.bincount(where, weights=values.astype(float), minlength=len(unique)) > 0
    return several[where].astype(np.uint64)


_SHARED = pa.schema({"anchor": pa.int64(), "digest": pa.int64(), "doc_id": pa.int64(), "batch": pa.int64(), "place": pa.int32(), "first": pa.int64(), "windows": pa.int32(), "bytes": pa.binary()})


def _shared_of_text(text: bytes, found: tuple, shared: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor, digest, first window and number of windows of the fragments of a text that have a shared anchor."""
    anchors, first, windows = found
    at = np.searchsorted(shared, anchors)
    at[at == len(shared)] = 0
    hit = np.flatnonzero(shared[at] == anchors)
    first, windows = first[hit], windows[hit].astype(np.int64)
    stops = first + windows + (WINDOW - 1)
    digests = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(first.tolist(), stops.tolist(), strict=True)), np.uint64, len(hit))
    return anchors[hit], digests, first, windows


def _shared_fragments(left, right):
    """Fragments with a shared anchor, of texts that no smaller id has in full, in record batches of bounded size."""
    out = []
    for batch, data in zip(left.column("batch").to_pylist(), left.column("data"), strict=True):
        table = unpack_table(data.as_py())
        (names, found), (ids, texts) = _found(table), _batch_texts(table)
        owner = dict(zip(sorted(found), answers_of(right, _TEXTS).view(np.int64).tolist(), strict=True))
        shared = _anchors(found)[0][answers_of(right, _ANCHORS) > 0]
        if not len(shared):
            continue
        places = [p for p, name in enumerate(names) if name is not None and owner[name] >= ids[p]]
        parts = [_shared_of_text(texts[p], found[names[p]], shared) for p in places]
        if not parts:
            continue
        place = np.repeat(np.array(places, np.int32), [len(part[0]) for part in parts])
        anchor, digest, first, windows = (np.concatenate(column) for column in zip(*parts, strict=True))
        del parts, found
        order = np.lexsort((digest, anchor))  # stable: of equal fragments the first one comes first
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(anchor[order]) != 0) | (np.diff(digest[order]) != 0)
        fresh = np.zeros(len(order), bool)  # the bytes of a fragment go once per batch
        fresh[order[new]] = True
        doc_ids = np.array([0 if i is None else i for i in ids], np.int64)
        for at in range(0, len(place), _ROWS):
            part = slice(at, at + _ROWS)
            spans = zip(place[part].tolist(), first[part].tolist(), windows[part].tolist(), fresh[part].tolist(), strict=True)
            content = [texts[p][a : a + n + WINDOW - 1] if sent else None for p, a, n, sent in spans]
            columns = anchor[part].view(np.int64), digest[part].view(np.int64), doc_ids[place[part]], np.full(len(content), batch), place[part], first[part], windows[part].astype(np.int32), content
            out.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SHARED, strict=True)], schema=_SHARED))
    return pa.Table.from_batches(out, _SHARED)


class RunIndex:
    """Run-length index of some fragments: suffix order, runs of the transform, samples at the ends of runs."""

    def __init__(self, pieces: list[bytes]):
        self.text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)  # 0xFF never occurs in UTF-8
        size = len(self.text)
        ends = np.flatnonzero(self.text == 255)
        self.piece = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
        self.left = ends[self.piece] - np.arange(size)  # bytes before the end of the piece
        self.order = self._suffix_order()
        before = self.text[self.order - 1]  # the transform
        # end marks differ from each other, so each is a run of its own
        self.heads = np.flatnonzero((np.diff(before.astype(np.int16), prepend=-1) != 0) | (before == 255))
        self.run_bytes = before[self.heads]
        # samples at run ends: where the first suffix of a run starts, and how far it matches the last one of the run before
        self.sample_place = self.order[self.heads]
        self.sample_match = self._common(self.order[self.heads - 1], self.sample_place)
        self.sample_match[self.heads == 0] = 0

    def _suffix_order(self) -> np.ndarray:
        """Suffixes of pieces by doubling; equal ones stand in text order, as if each piece had an end mark of its own."""
        size = len(self.text)
        padded = np.concatenate([self.text, np.zeros(8, np.uint8)])
        key = np.zeros(size, np.uint64)
        for i in range(8):
            byte = np.where(self.left >= i, padded[i : i + size], 0).astype(np.uint64)
            key = (key << np.uint64(8)) | byte
        rank, width = np.unique(key, return_inverse=True)[1], 8
        while width < _LONGEST + 1:
            further = np.zeros(size, np.int64)
            inside = np.flatnonzero(self.left >= width)
            further[inside] = rank[inside + width] + 1
            rank = np.unique(rank * (size + 1) + further, return_inverse=True)[1]
            width *= 2
        return np.argsort(rank, kind="stable")

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of common prefixes of suffixes, up to the ends of their pieces."""
        room, out = np.minimum(self.left[a], self.left[b]), np.zeros(len(a), np.int64)
        padded = np.concatenate([self.text, np.zeros(_LONGEST + 1, np.uint8)])
        span = np.arange(_LONGEST + 1)
        for at in range(0, len(a), 16_384):
            x, y = a[at : at + 16_384, None] + span, b[at : at + 16_384, None] + span
            differ = padded[x] != padded[y]
            differ[:, -1] = True
            out[at : at + 16_384] = differ.argmax(axis=1)
        return np.minimum(out, room)

    def matching(self) -> np.ndarray:
        """For each place of the text, the length that it has in common with the suffix before it in order.

        Inside a run the value is that of the place before, less one, so all follow from the samples: streaming
        through the text, the farthest end that a sample has reached is carried along.
        """
        reach = np.zeros(len(self.text), np.int64)
        reach[self.sample_place] = self.sample_match + self.sample_place
        return np.maximum(np.maximum.accumulate(reach) - np.arange(len(self.text)), 0)

    def owners(self, ids: np.ndarray) -> np.ndarray:
        """For each place that starts a window, the smallest id of a piece with the same window; else the largest number."""
        long = np.minimum(self.matching(), self.left)[self.order] >= WINDOW
        interval = np.cumsum(~long) - 1
        own = np.where(self.left[self.order] >= WINDOW, ids[self.piece[self.order]], np.iinfo(np.int64).max)
        least = np.minimum.reduceat(own, np.flatnonzero(~long))
        out = np.empty(len(self.text), np.int64)
        out[self.order] = least[interval]
        return out


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each different fragment: a bit per window that a smaller id owns."""
    for table in grouped(batches, ("shard",)):
        ids = table.column("owner").to_numpy()
        table, ids = table.take(pa.array(np.argsort(ids, kind="stable"))), np.sort(ids)
        pieces = table.column("bytes").to_pylist()
        index = RunIndex(pieces)
        taken = index.owners(ids) < ids[index.piece]
        starts = np.cumsum([0, *[len(p) + 1 for p in pieces[:-1]]])
        masks = [sum(1 << i for i in np.flatnonzero(taken[s : s + len(p) - WINDOW + 1]).tolist()) for s, p in zip(starts.tolist(), pieces, strict=True)]
        yield pa.RecordBatch.from_pydict({"anchor": table.column("anchor").combine_chunks(), "digest": table.column("digest").combine_chunks(), "mask": pa.array(masks, pa.int64())})


def _masks(shared: DataFrame) -> DataFrame:
    """``anchor``, ``digest``, ``owner``, ``mask``: for each different fragment the windows that a smaller id than its owner has."""
    owned = materialize(shared.groupBy("anchor", "digest").agg(F.min("doc_id").alias("owner")), "owned", "zstd")
    # which fragments are needed is settled first, without their bytes; so the bytes are shuffled once, alone
    counts = owned.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    several = materialize(owned.join(counts, "anchor"), "several", "zstd")
    sent = shared.where("bytes is not null").select("anchor", "digest", "bytes").join(several, ["anchor", "digest"])
    joined = sent.groupBy("anchor", "digest").agg(F.any_value("bytes").alias("bytes"), F.min("owner").alias("owner"), F.min("n").alias("n"))
    joined = materialize(joined, "different", "zstd")
    total = several.count()
    discard(several)
    shards = max(1, -(-total // max(1, INDEX_FRAGMENTS // 4)))
    dealt = joined.where(F.col("n") <= INDEX_FRAGMENTS).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    dealt = dealt.select("shard", "anchor", "digest", "owner", "bytes").repartition("shard").sortWithinPartitions("shard")
    indexed = dealt.mapInArrow(_indexed, "anchor long, digest long, mask long")
    # anchors with very many different fragments: window by window
    bits = F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - WINDOW))
    single = joined.where(F.col("n") > INDEX_FRAGMENTS).withColumn("bit", bits)
    single = single.withColumn("window", F.sha2(F.substr("bytes", F.col("bit") + 1, F.lit(WINDOW)), 256))
    least = single.groupBy("anchor", "window").agg(F.min("owner").alias("least"))
    marked = single.join(least, ["anchor", "window"]).where("least < owner").groupBy("anchor", "digest").agg(
        F.sum(F.expr("shiftleft(1L, bit)")).alias("mask")
    )
    masks = materialize(indexed.unionByName(marked).where("mask <> 0"), "masks")
    discard(joined)
    return owned.select("anchor", "digest", "owner").join(masks, ["anchor", "digest"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def _covered(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by runs of windows (first, count)."""
    spans: list[list[int]] = []
    for first, count in sorted(windows):
        stop = first + count + WINDOW - 1
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], stop)
        else:
            spans.append([first, stop])
    return [(a, b) for a, b in spans]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lost windows of each document as runs in one message, or in several if its rows are in several batches; ``range`` is its place."""
    for rows in batches:
        if not rows.num_rows:
            continue
        batch, place, first, lost = (rows.column(c).to_numpy() for c in ("batch", "place", "first", "lost"))
        starts = np.concatenate([[0], np.flatnonzero((np.diff(batch) != 0) | (np.diff(place) != 0)) + 1])
        doc = np.zeros(len(batch), np.int64)
        doc[starts[1:]] = 1
        doc = np.cumsum(doc)
        row, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(lost, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        window, owner = first[row] + bit, doc[row]
        heads = np.flatnonzero((np.diff(window, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0))
        runs = np.stack([window[heads], np.diff(heads, append=len(window))], axis=1).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner[heads], minlength=len(starts)))]).astype(np.int32) * np.int32(16)
        packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(runs.tobytes())])
        yield pa.RecordBatch.from_arrays(
            [pa.array(batch[starts], pa.int64()), pa.nulls(len(starts), pa.int32()), pa.array(place[starts], pa.int32()), packed], ["batch", "kind", "range", "answers"]
        )


def _result(keep_text: bool):
    def finish(left, found):
        rows = []
        for data in left.column("data"):
            table = unpack_table(data.as_py())
            names, (ids, texts) = _keys_of_texts(table), _batch_texts(table)
            answers = found.filter(pa.compute.is_valid(found.column("kind")))
            owner = dict(zip(names.tolist(), answers_of(answers, _TEXTS).view(np.int64).tolist(), strict=True))
            windows: dict[int, list] = {}
            marks = found.filter(pa.compute.is_null(found.column("kind")))
            for place, packed in zip(marks.column("range").to_pylist(), marks.column("answers").to_pylist(), strict=True):
                windows.setdefault(place, []).extend(map(tuple, np.frombuffer(packed, np.int64).reshape(-1, 2).tolist()))
            for place, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
                if doc_id is not None and len(text) >= WINDOW and owner[_text_name(text)] < doc_id:
                    spans = [(0, len(text))]
                else:
                    spans = _covered(windows.get(place, []))
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                rest = b"".join([*kept, text[at:]])
                rows.append((doc_id, len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest if keep_text else None, [{"start": a, "stop": b} for a, b in spans]))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return finish


def _keys_of_texts(table: pa.Table) -> np.ndarray:
    ids, texts = _batch_texts(table)
    return np.array(sorted({_text_name(t) for i, t in zip(ids, texts, strict=True) if i is not None and len(t) >= WINDOW}), np.uint64)


def repeated_spans(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept`` (bytes) and ``spans``.

    Texts are taken as UTF-8; null counts as empty. Rows without id keep everything and no other row loses anything to
    them. Rows with one id are not smaller than each other. Texts and fragments are compared by 64-bit digest.
    Cuts may fall inside a character, so ``kept`` is binary.
    """
    batches = text_batches(docs)
    answers = materialize(answer(ask(batches, ranges_for(batches), _keys), _merged), "answers")
    schema = "anchor long, digest long, doc_id long, batch long, place int, first long, windows int, bytes binary"
    shared = batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_shared_fragments, schema)
    shared = materialize(shared, "shared", "zstd")
    masks = _masks(shared)
    marked = shared.select("anchor", "digest", "doc_id", "batch", "place", "first", "windows").join(masks, ["anchor", "digest"])
    full = F.expr("shiftleft(1L, windows) - 1")
    lost = marked.withColumn("lost", F.when(F.col("owner") < F.col("doc_id"), full).otherwise(F.col("mask"))).where("lost <> 0")
    by_doc = lost.select("batch", "place", "first", "lost").repartition("batch", "place").sortWithinPartitions("batch", "place", "first")
    per_doc = materialize(by_doc.mapInArrow(_runs, "batch long, kind int, range int, answers binary"), "lost", "zstd")
    discard(shared)
    told = answers.where(F.col("kind") == _TEXTS).unionByName(per_doc)
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, stop: long>>"
    return batches.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_result(keep_text), result)


def repeat_report(docs: DataFrame) -> DataFrame:
    return repeated_spans(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
