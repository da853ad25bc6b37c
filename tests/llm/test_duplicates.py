"""Near duplicates, repeated passages, embeddings and components against brute force."""

import hashlib
import random

import numpy as np
import pytest

from leakscan.llm import embedding_dedup, near_dedup, repeats
from leakscan.llm.components import components

SCHEMA = "doc_id long, text string, name string, root long, batch long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "n", 1, 2) for i, t in rows], SCHEMA).repartition(3)


def labels(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    random.seed(2)
    edges = {
        "chain": [(i, i + 1) for i in range(200)], "star": [(500, i) for i in range(300)], "none": [],
        "random": [(random.randrange(400), random.randrange(400)) for _ in range(250)],
    }[shape]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = labels({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if n != r}


def shingles(text):
    data = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    width = min(5, len(data))
    return {tuple(data[i : i + width]) for i in range(len(data) - width + 1)} if data else set()


def family(rng, words, length, members, edits):
    base = [rng.choice(words) for _ in range(length)]
    out = []
    for _ in range(members):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(length)] = rng.choice(words)
        out.append(" ".join(copy))
    return out


def near_corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)] + ["Ünïcode", "UPPER"]
    texts = [None, "", " \n", "one two", "ONE two", "one two three four five", "a b c d"]
    for _ in range(12):
        texts += family(rng, words, rng.randint(20, 300), rng.randint(2, 8), rng.randint(1, 12))
    texts += family(rng, words, 120, 90, 9)  # one large group of near copies around the limit
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [f"{' '.join(rng.choice(words) for _ in range(rng.randint(10, 80)))} {passage}" for _ in range(60)]
    texts += [texts[40]] * 30 + [" ".join(rng.choice(words) for _ in range(50)) for _ in range(60)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("block", [None, 16])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    if block:  # lists and texts in many blocks give the same result
        monkeypatch.setattr(near_dedup, "SIGNATURE_BLOCK", block)
        monkeypatch.setattr(near_dedup, "TEXT_BLOCK", block)
    rows = near_corpus()
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = labels(sets, links)
    got = near_dedup.near_duplicate_report(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_with_missing_and_repeated_ids(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(7, text), (7, text), (None, text), (9, text + " more"), (None, "quite other words stand here now"), (None, None), (3, None), (3, None)]
    source = table(spark, rows)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_duplicate_report(source).collect())
    assert [r[2] for r in got if r[1] > 2] == ["7"] * 4
    stayed = near_dedup.drop_near_duplicates(source)
    assert stayed.columns == source.columns
    assert sorted(str(r.doc_id) for r in stayed.collect()) == ["3", "3", "7", "None", "None"]
    assert near_dedup.near_duplicate_report(source.limit(0)).count() == 0
    assert near_dedup.drop_near_duplicates(source.limit(0)).count() == 0


def removed(rows):
    """Covered bytes by the contract: windows that also start in a row with a smaller id."""
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - 49):
            if i is not None:
                first[data[k : k + 50]] = min(i, first.get(data[k : k + 50], i))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if i is not None and first[data[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        rest = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out.append((str(i), len(data), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def passage_corpus():
    rng = random.Random(8)
    piece = lambda n: "".join(rng.choice("abcdefgh üé漢\n") for _ in range(n))
    shared = [piece(n) for n in (30, 49, 50, 51, 70, 200, 600)]
    texts = [None, "", "a" * 49, "a" * 50, "a" * 400, "ab" * 300, "a" * 51]
    for _ in range(80):
        parts = [rng.choice(shared) if rng.random() < 0.5 else piece(rng.randint(0, 90)) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.3 and parts[0]:
            k = rng.randrange(len(parts[0]))
            parts[0] = parts[0][:k] + "X" + parts[0][k + 1 :]
        texts.append("".join(parts))
    texts += [texts[20]] * 6 + [shared[6] * 3]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("limit", [None, 2])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, limit):
    if limit:  # all anchors with more than two different fragments go window by window
        monkeypatch.setattr(repeats, "INDEX_FRAGMENTS", limit)
        monkeypatch.setattr("leakscan.llm.exchange.BATCH_BYTES", 2000)
    rows = passage_corpus() + [(None, "z" * 300), (None, "z" * 300), (4, "same id " * 30), (4, "same id " * 30), (4, "x" + "same id " * 30), (5000, "same id " * 30)]
    got = repeats.repeat_report(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed(rows)


def test_repeated_passages_of_texts_beyond_a_slice(spark):
    """Copies in long texts that begin at other places, so that slices cut their fragments elsewhere."""
    rng = random.Random(12)
    long = "".join(rng.choice("abcdefgh é\n") for _ in range(300_000))
    assert len(long.encode()) > repeats._SLICE
    rows = [(5, long), (3, "shifted by some bytes " + long[1000:290_000]), (9, long[150_000:150_400]), (8, "zz" + long[240_000:299_000] + "zz"), (7, long[:200] * 3)]
    got = repeats.repeat_report(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed(rows)


def test_spans_and_kept_bytes(spark):
    shared = "0123456789" * 6
    rows = [(1, f"aa{shared}bb"), (2, f"cc{shared[:55]}dd"), (3, "nothing")]
    got = {r.doc_id: r for r in repeats.repeated_spans(table(spark, rows)).collect()}
    assert [(s.start, s.stop) for s in got[2].spans] == [(2, 57)] and bytes(got[2].kept) == b"ccdd"
    assert not got[1].spans and bytes(got[3].kept) == b"nothing"
    assert repeats.repeat_report(table(spark, rows).limit(0)).count() == 0


def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    near = base[:80].repeat(3, axis=0) + rng.normal(scale=0.2, size=(240, 16))
    tight = base[299] + rng.normal(scale=0.1, size=(200, 16))
    rows = [list(map(float, np.float32(v))) for v in np.vstack([base, near, tight, base[5:6].repeat(60, axis=0), 3 * base[6:7]])]
    odd = [None, [], [0.0] * 16, [float("nan"), *[1.0] * 15], [float("inf"), *[1.0] * 15], [None, *[1.0] * 15]]
    return rows + odd


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_against_brute_force(spark, kind):
    rows = vectors()
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in enumerate(rows)], f"vec_id long, embedding array<{kind}>, label int, name string")
    got = {r.vec_id: r for r in embedding_dedup.embedding_duplicates(frame, embedding_dedup.Forest(leaf=32)).collect()}
    good = [i for i, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    points = np.array([rows[i] for i in good])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(points @ points.T >= 0.9, 1))
    true = [(good[x], good[y]) for x, y in zip(a, b, strict=True)]
    links = np.bincount(np.array(true).ravel(), minlength=len(rows))
    assert len(got) == len(rows) and all(got[i].n_links <= links[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.97 * links.sum()
    want = labels(range(len(rows)), true)
    assert sum(got[i].component_id == want[i] for i in got) >= 0.97 * len(rows)
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert all(got[i].n_links == 0 and got[i].kept for i in set(got) - set(good))


def test_embeddings_without_rows_or_ids(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_dedup.embedding_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (None, [2.0, -1.0])], schema)
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dedup.embedding_duplicates(rows).collect())
    assert got == [("4", 2, "4", True), ("4", 2, "4", True), ("None", 0, "None", True), ("None", 2, "4", False)]
