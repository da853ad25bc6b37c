"""Near-duplicate documents: MinHash signatures joined through inverted lists of their coordinates.

Every distinct shingle set is posted under its coordinate-value pairs. Prefix merging: pairs
must match in MATCHES of COORDINATES places, so a set leaves out its MATCHES - 1 most common pairs and
pairs that no other set has; sets with no more shared pairs than that are posted nowhere. Skip merging: of two
sets that meet in a short list the other coordinates are compared straight away, so long lists are skipped.
Retained pairs are confirmed on the full shingle sets of the whole texts.

A list of thousands of near copies is never expanded into its pairs. First every set meets
the pivot of each of its lists and is compared with the best of them; confirmed links give components. Only lists
that still span components are then compared, in blocks: pairs across components that match often
enough, each in the first list that it shares, name the sets whose texts are fetched and confirmed together.
Only a spanning forest of the links leaves a task. Each step is exact, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from leakscan.llm.common import among, attach, grouped, materialize
from leakscan.llm.components import components
from leakscan.llm.shingles import COORDINATES, WordHashes, set_name, shared, shingle_set, signature

#: Two sets of similarity 0.75 match in fewer coordinates once in twenty million times.
MATCHES = 19
PERCENT = 75
SIGNATURE_BLOCK = 4096
TEXT_BLOCK = 256
_FEATURES = "n_shingles long, name binary, tokens array<long>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        sizes, names, tokens = [], [], []
        for text in batch.column("text").cast(pa.binary()):
            found = shingle_set(text.as_py(), cache)
            sizes.append(len(found))
            names.append(set_name(found) if len(found) else None)
            tokens.append(signature(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))],
            [*batch.schema.names, "n_shingles", "name", "tokens"],
        )


def _text_apart(docs: DataFrame) -> bool:
    """Whether the features hold the text as it is, so that rows need no second copy of it."""
    return docs.schema["text"].dataType == T.StringType()


def _whole(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` from its features."""
    apart = _text_apart(docs)
    return [F.col("text") if apart and name == "text" else F.col("row")[name].alias(name) for name in docs.columns]


def _with_features(docs: DataFrame, keep_row: bool) -> DataFrame:
    # the text is written once, not again in its row
    packed = docs.drop("text") if keep_row and _text_apart(docs) else docs
    frame = docs.select(
        *([F.struct(*[docs[f"`{name}`"] for name in packed.columns]).alias("row")] if keep_row else []),
        F.monotonically_increasing_id().alias("row_id"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"),
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return materialize(frame.mapInArrow(_features, f"{kinds}, {_FEATURES}"), "features", "zstd")


def _classes(features: DataFrame) -> DataFrame:
    """One row per distinct set: its first row stands for it."""
    own = features.where("n_shingles > 0").groupBy("name").agg(
        F.min("row_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("first"), F.count("*").alias("copies")
    )
    return materialize(own, "classes")


def _posted(signatures: DataFrame) -> DataFrame:
    """``rep`` and the tokens it is posted under: its prefix. Counts decide the order only, never whether a pair is found."""
    entries = signatures.select("rep", F.explode("tokens").alias("token"))
    lists = entries.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    met = entries.join(lists, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("met"))
    kept = F.slice("met", 1, F.size("met") - (MATCHES - 1))
    return materialize(met.where(F.size("met") >= MATCHES).select("rep", F.transform(kept, lambda x: x["token"]).alias("posted")), "posted")


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matching coordinates of two signatures, for pairs with enough of them and sizes that allow the similarity."""
    for batch in batches:
        count = batch.num_rows
        left, right = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(count, COORDINATES) for c in ("left_tokens", "right_tokens"))
        equal = (left == right).sum(axis=1) if count else np.zeros(0, np.int64)
        kept = pa.array(equal >= MATCHES)
        yield pa.RecordBatch.from_arrays(
            [batch.column("left").filter(kept), batch.column("right").filter(kept), pa.array(equal, pa.int64()).filter(kept)], ["left", "right", "matches"]
        )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache, last = WordHashes(), (None, None)
    for batch in batches:
        kept = []
        lefts, rights = batch.column("left_text").cast(pa.binary()), batch.column("right_text").cast(pa.binary())
        for i, right in enumerate(batch.column("right").to_pylist()):
            if right != last[0]:
                last = (right, shingle_set(rights[i].as_py(), cache))
            a, b = shingle_set(lefts[i].as_py(), cache), last[1]
            both = shared(a, b)
            kept.append(100 * both >= PERCENT * (len(a) + len(b) - both))
        mask = pa.array(kept, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("left").filter(mask), batch.column("right").filter(mask)], ["u", "v"])


def _sizes_fit(a: str, b: str):
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _compared(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (left, right) whose signatures match often enough, with the number of matches."""
    side = lambda name: signatures.select(F.col("rep").alias(name), F.col("tokens").alias(f"{name}_tokens"), F.col("n_shingles").alias(f"{name}_n"))
    joined = pairs.join(side("left"), "left").join(side("right"), "right").where(_sizes_fit("left_n", "right_n"))
    return joined.select("left", "right", "left_tokens", "right_tokens").mapInArrow(_matches, "left long, right long, matches long")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v): pairs whose full sets are similar enough."""
    text = lambda name: texts.select(F.col("rep").alias(name), F.col("text").alias(f"{name}_text"))
    joined = pairs.select("left", "right").join(text("left"), "left").join(text("right"), "right")
    return joined.mapInArrow(_confirm, "u long, v long")


def _labelled(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """Postings with the component of each set so far, of lists that span more than one."""
    labelled = postings.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("rep", "token", F.coalesce("root", "rep").alias("root"))
    spans = labelled.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("token", "n")
    return labelled.join(spans, "token")


def _star(postings: DataFrame, signatures: DataFrame) -> DataFrame:
    """Each set with the best pivot of its lists that is in another component."""
    pivots = postings.groupBy("token").agg(F.min(F.struct("rep", "root")).alias("pivot"))
    pairs = postings.join(pivots, "token").where("root <> pivot.root").select(F.col("rep").alias("left"), F.col("pivot.rep").alias("right")).distinct()
    best = _compared(pairs, signatures).groupBy("left").agg(F.max(F.struct("matches", "right")).alias("best"))
    return best.select("left", "best.right")


def _block_rows(rows: DataFrame, size: int) -> DataFrame:
    """Lists of ``n`` rows cut into blocks of about ``size``; each row once for each block that its own block meets."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    cut = rows.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return cut.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "n")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two blocks that meet."""
    block = table.column("block").to_numpy()
    return np.flatnonzero(block == table.column("low")[0].as_py()), np.flatnonzero(block == table.column("high")[0].as_py())


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets that retain a pair across components in a list, if the list is the first that the pair shares."""
    for table in grouped(batches, ("token", "low", "high")):
        token, roots, sizes = table.column("token")[0].as_py(), table.column("root").to_numpy(), table.column("n_shingles").to_numpy()
        if roots.min() == roots.max():
            continue
        coordinate = token & 63
        first, second = _sides(table)
        tokens = table.column("tokens").combine_chunks().flatten().to_numpy().reshape(table.num_rows, COORDINATES)
        places = table.column("posted").combine_chunks()
        posted = np.zeros((table.num_rows, COORDINATES), bool)
        posted[np.repeat(np.arange(table.num_rows), places.value_lengths().to_numpy()), places.flatten().to_numpy() & 63] = True
        met, there, early = np.zeros(table.num_rows, bool), tokens[second], posted[second, :coordinate]
        for i in first:
            hit = np.flatnonzero((roots[second] != roots[i]) & (100 * np.minimum(sizes[i], sizes[second]) >= PERCENT * np.maximum(sizes[i], sizes[second])))
            if not len(hit):
                continue
            equal = there[hit] == tokens[i]
            earlier = (equal[:, :coordinate] & early[hit] & posted[i, :coordinate]).any(axis=1)
            hit = hit[(equal.sum(axis=1) >= MATCHES) & ~earlier]
            if len(hit):
                met[i] = met[second[hit]] = True
        reps = table.column("rep").to_numpy()[met]
        yield pa.RecordBatch.from_pydict({"token": np.full(len(reps), token), "rep": reps, "root": roots[met]})


def _overlaps(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Intersection sizes of all sets in ``first`` with all in ``second``, by products of 0/1 matrices over slices of the shingles."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.flatnonzero(count[column] > 1)
    owner, (_, column) = owner[common], np.unique(column[common], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(first), len(second)), np.float32)
    width = 8192
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[low:high], column[low:high] - start] = 1
        total += part[first] @ part[second].T
    return total.astype(np.int64)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the confirmed links between sets of different components in each list."""
    cache = WordHashes()
    for table in grouped(batches, ("token", "low", "high")):
        first, second = _sides(table)
        reps, roots = table.column("rep").to_numpy(), table.column("root").to_numpy()
        sets = [shingle_set(text.as_py(), cache) for text in table.column("text").cast(pa.binary())]
        sizes, both = np.array([len(x) for x in sets]), _overlaps(sets, first, second)
        linked = 100 * both >= PERCENT * (sizes[first][:, None] + sizes[second][None, :] - both)
        linked &= roots[first][:, None] != roots[second][None, :]
        parent = {int(x): int(x) for x in reps}
        links = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            x, y = a, b = int(reps[first[i]]), int(reps[second[j]])
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[x] = y
                links.append((a, b))
        yield pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})


def _by_list(rows: DataFrame) -> DataFrame:
    return rows.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")


def _rest(open_lists: DataFrame, signatures: DataFrame, posted: DataFrame, texts: DataFrame) -> DataFrame:
    """Links for all retained pairs across components, confirmed on the full sets block by block."""
    rows = _block_rows(open_lists, SIGNATURE_BLOCK).join(signatures, "rep").join(posted, "rep")
    met = _by_list(rows).mapInArrow(_meeting, "token long, rep long, root long").distinct()
    met = materialize(met, "met")
    counted = met.join(met.groupBy("token").agg(F.count("*").alias("n")), "token")
    rows = _block_rows(counted, TEXT_BLOCK).join(texts, "rep").select("token", "low", "high", "block", "rep", "root", "text")
    return _by_list(rows).mapInArrow(_linked, "u long, v long")


def _links(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes, and node and root for each class that is linked to another and not a root."""
    classes = _classes(features)
    signatures = among(features.select(F.col("row_id").alias("rep"), "n_shingles", "tokens"), "rep", classes.select("rep"))
    signatures = materialize(signatures, "signatures")
    posted = _posted(signatures)
    # only the texts of posted sets are needed from here on
    texts = materialize(among(features.select(F.col("row_id").alias("rep"), "text"), "rep", posted.select("rep")), "texts", "zstd")
    postings = posted.select("rep", F.explode("posted").alias("token"))
    alone = classes.sparkSession.createDataFrame([], "node long, root long")
    pairs = materialize(_star(_labelled(postings, alone), signatures), "pairs")
    links = materialize(_confirmed(pairs, texts), "links")
    roots = components(links)
    rest = materialize(_rest(materialize(_labelled(postings, roots), "open"), signatures, posted, texts), "links")
    return classes, components(links.unionByName(rest))


def _judged(features: DataFrame, *more: str) -> DataFrame:
    """The columns ``more`` of each row of ``features``, with ``doc_id``, ``n_shingles``, ``component_id``, ``kept`` and ``first``."""
    classes, roots = _links(features)
    labelled = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    firsts = labelled.groupBy("root").agg(F.min("first").alias("first"))
    named = materialize(labelled.drop("first").join(firsts, "root").select("name", "first", "copies"), "named")
    needed = dict.fromkeys([*more, "row_id", "doc_id", "n_shingles", "name"])
    rows = attach(features.select(*needed), named, ["name"], "copies")
    alone = F.col("name").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return rows.withColumn("component_id", component).select(
        *more, "doc_id", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        (alone | (F.col("row_id") == F.col("first.row_id"))).alias("first"),
    )


def near_duplicates(docs: DataFrame, keep_row: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, and ``first`` for one row per component.

    Sets are compared by 64-bit shingle hashes. Null texts and texts without words have an empty set and are linked with nothing.
    Rows without id take part; ``component_id`` is null only where no row of a component has an id. ``first`` marks
    one row of each component, the one with the smallest id, also where ids or whole rows repeat.
    """
    features = _with_features(docs, keep_row)
    if not keep_row:
        return _judged(features)
    judged = _judged(features, "row", "text")
    return judged.select(F.struct(*_whole(docs)).alias("row"), *[c for c in judged.columns if c not in ("row", "text")])


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs``."""
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that have a near duplicate with a smaller id; documents without words stay."""
    features = _with_features(docs, keep_row=True)
    # whole rows are not shuffled: each learns from one bit whether it goes
    gone = _judged(features, "row_id").where("NOT first").select("row_id")
    return among(features.select("row", "text", "row_id"), "row_id", gone, wanted=False).select(*_whole(docs))


__all__ = ["drop_near_duplicates", "near_duplicate_report", "near_duplicates"]
