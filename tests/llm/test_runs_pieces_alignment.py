"""Periodic runs, sentence pieces and token alignment against plain Python and the tokenizer libraries."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leakscan.llm import periodic_runs, sentence_pieces, token_alignment
from leakscan.llm.queries import op11_periodic_runs, op12_sentence_pieces, op13_token_alignment

SF = "/root/testdata/sf0.001"
PATH_A = str(public_tokenizers.path("byte_bpe_50k.json"))
PATH_B = str(public_tokenizers.path("piece_bpe_32k.model"))
PARTS = ["'", "s", "ll", " ", "  ", "\n", "\t", "a", "Ab", "hello", "12", "é", "漢", "😀", "!", "<|endoftext|>", "</s>", "<0x0A>", "\x1c", "\x00", "▁", "====", "tion", " "]
TEXTS = [None, "", "  \n ", "a", "x " * 40, "x" * 3000, " " * 500, "a b c d " * 5 + "e", "ab ▁ c", "tail ", " head", "\nline one\n  line two\n", "<|endoftext|> </s>", *["same words here"] * 30]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def edge_docs(spark):
    rows = [(i if i != 3 else None, t, 7, "z") for i, t in enumerate(TEXTS)] + [(0, "again", 8, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int, runs string").repartition(3)


def slow_runs(words):
    """By trying every period: stretches of words equal to those a period on, unless a shorter period explains them."""
    found = set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.add((i, length, q))
            i = max(j, i + 1)
    return sorted(found)


def slow_collapse(words, runs):
    dropped = {k for start, length, q in runs for k in range(start + q, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in dropped)


@settings(max_examples=400, deadline=None)
@given(data=st.data())
def test_runs_equal_trying_every_period(data):
    words = data.draw(st.lists(st.integers(0, 2), max_size=60))
    if words and data.draw(st.booleans()):
        start, period = data.draw(st.integers(0, len(words) - 1)), data.draw(st.integers(1, 12))
        words += [words[start + k % min(period, len(words) - start)] for k in range(50)]
        words += data.draw(st.lists(st.integers(0, 3), max_size=20))
    assert [tuple(r) for r in periodic_runs.find_runs(np.array(words, np.int64)).tolist()] == slow_runs(words)


def test_convolution_is_exact():
    numbers = np.random.default_rng(1)
    codes = numbers.integers(0, 3, 400)
    for block in (1, 2, 8, 32):
        starts = np.arange(0, 400 - 3 * block, block)
        index, shift = periodic_runs.zero_mismatches(codes, starts, block)
        wanted = {(s, d) for s in starts.tolist() for d in range(block, 2 * block) if (codes[s : s + block] == codes[s + d : s + d + block]).all()}
        assert {(int(starts[i]), int(d)) for i, d in zip(index, shift, strict=True)} == wanted
    rows = numbers.integers(0, periodic_runs.PRIME, (3, 64))
    back = periodic_runs.transform(periodic_runs.transform(rows), inverse=True)
    assert (back == rows * 64 % periodic_runs.PRIME).all()


def test_long_runs():
    words = np.tile(np.random.default_rng(2).integers(0, 30_000, 40_000), 6)
    assert periodic_runs.find_runs(words).tolist() == [[0, 240_000, 40_000]]
    assert periodic_runs.find_runs(np.zeros(100_000, np.int64)).tolist() == [[0, 100_000, 1]]


def test_runs_of_odd_rows(spark):
    docs = edge_docs(spark)
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic_runs.periodic_runs(docs).collect())
    wanted = Counter()
    for row in docs.collect():
        words = (row.text or "").encode().split()
        runs = slow_runs(words)
        wanted[row.doc_id, len(words), tuple(runs), slow_collapse([w.decode() for w in words], runs)] += 1
    assert got == wanted
    assert periodic_runs.run_report(periodic_runs.periodic_runs(docs.limit(0))).count() == 0


def test_run_query_equals_plain_python(spark):
    got = {r.doc_id: r for r in op11_periodic_runs(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue  # the slow version; the library's has judged them all
        runs, row = slow_runs(words), got[doc_id]
        assert row.n_runs == len(runs)
        assert row.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert row.collapsed_sha256 == sha(slow_collapse(words, runs))
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        assert (row.start, row.length, row.period) == best
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH_B)


@settings(max_examples=600, deadline=None)
@given(data=st.data())
def test_pieces_equal_the_library(data, library):
    known = test_pieces_equal_the_library.__dict__
    if "both" not in known:
        model = sentence_pieces.PieceModel(PATH_B)
        known["both"] = sentence_pieces.PieceEncoder(model), sentence_pieces.PieceDecoder(model), [p.replace("▁", " ") for p in model.ids]
    encoder, decoder, pieces = known["both"]
    few = data.draw(st.lists(st.integers(0, len(pieces) - 1), max_size=4))
    text = "".join(data.draw(st.lists(st.sampled_from(PARTS), max_size=12))) + "".join(pieces[i] for i in few) + data.draw(st.text(max_size=8))
    ids = np.frombuffer(encoder.ids(text), np.int32).tolist()
    assert ids == library.encode(text)
    assert decoder.text([*ids, 2]) == library.decode([*ids, 2])
    some = data.draw(st.lists(st.integers(0, 300) | st.integers(0, 31_999), max_size=10))
    assert decoder.text(some) == library.decode(some)


def test_each_prefix_ends_in_its_last_token(library):
    encoder = sentence_pieces.PieceEncoder(sentence_pieces.PieceModel(PATH_B))
    text = "▁interchangeable▁rearrangements▁of▁1234"
    last = encoder.last_tokens(text)
    for end in range(2, len(text) + 1):
        assert encoder.tokens[last[end]] == library.encode(text[1:end].replace("▁", " "), out_type=str)[-1]


def test_pieces_of_odd_rows_and_query(spark, library):
    docs = edge_docs(spark).unionByName(spark.createDataFrame([(99, "q" * 40_000 + " a b" * 9000, 1, "")], "doc_id long, text string, ids int, runs string"))
    done = sentence_pieces.decode(sentence_pieces.encode(docs, PATH_B), PATH_B).collect()
    wanted = Counter((r.doc_id, tuple(ids := [*library.encode(r.text or ""), 2]), library.decode(ids)) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in done) == wanted
    assert sentence_pieces.encode(docs.limit(0), PATH_B).count() == 0
    got = {r.doc_id: r for r in op12_sentence_pieces(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = [*library.encode(text or ""), 2]
        assert (got[doc_id].n_tokens, got[doc_id].ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert got[doc_id].decoded_sha256 == sha(library.decode(ids))


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH_B, "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        sentence_pieces.PieceModel(str(tmp_path / "other.model"))


def dense(matrix):
    out = np.zeros((len(matrix.starts) - 1, matrix.width), np.int64)
    for i in range(len(out)):
        for k in range(matrix.starts[i], matrix.starts[i + 1]):
            out[i, matrix.columns[k]] += matrix.values[k]
    return out


def test_row_products_equal_dense_ones(monkeypatch):
    numbers = np.random.default_rng(5)
    for limit in (1, 7, 1 << 20):
        monkeypatch.setattr(token_alignment, "PRODUCT_ENTRIES", limit)
        for _ in range(40):
            rows, middle, width = numbers.integers(1, 9, 3)
            parts = []
            for shape in ((rows, middle), (middle, width)):
                full = numbers.integers(0, 4, shape) * numbers.integers(0, 2, shape)
                at = np.nonzero(full)
                parts.append(token_alignment.Rows(np.concatenate([[0], np.cumsum((full > 0).sum(axis=1))]), at[1], full[at], shape[1]))
            product = token_alignment.row_products(*parts)
            assert (dense(product) == dense(parts[0]) @ dense(parts[1])).all()
            assert (dense(parts[0].transposed()) == dense(parts[0]).T).all()


def slow_alignment(first, second, tokens, text):
    """Tokens, groups and linked id pairs of one text by walking both sequences."""
    a = first.encode(" " + text, add_special_tokens=False).ids if text else []
    b = second.encode(text) if text else []
    raw_a, raw_b = [tokens.bytes_a[i] for i in a], [tokens.bytes_b[i] for i in b]
    if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return [], [], [], []
    groups, links, i, j, end_a, end_b, ours, theirs = [], [], 0, 0, len(raw_a[0]), len(raw_b[0]), [a[0]], [b[0]]
    while True:
        links.append((a[i], b[j]))
        if end_a == end_b:
            groups.append((ours, theirs))
            i, j = i + 1, j + 1
            if i == len(a):
                return a, b, groups, links
            end_a, end_b, ours, theirs = end_a + len(raw_a[i]), end_b + len(raw_b[j]), [a[i]], [b[j]]
        elif end_a < end_b:
            i += 1
            end_a, ours = end_a + len(raw_a[i]), [*ours, a[i]]
        else:
            j += 1
            end_b, theirs = end_b + len(raw_b[j]), [*theirs, b[j]]


def slow_report(rows, library):
    first = Tokenizer.from_file(PATH_A)
    first.encode_special_tokens = True
    tokens = token_alignment.TokenPair(PATH_A, PATH_B)
    found = [(doc_id, *slow_alignment(first, library, tokens, text)) for doc_id, text in rows]
    counts = Counter(link for *_, links in found for link in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    join = lambda ids: ",".join(map(str, ids))
    return Counter(
        (doc_id, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
         sha(";".join(f"{join(x)}|{join(y)}" for x, y in groups)) if a else "", sum(len(x) * len(y) for x, y in groups))
        for doc_id, a, b, groups, links in found
    )


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.sampled_from(PARTS), max_size=12), more=st.text(max_size=8))
def test_alignment_equals_walking(parts, more, library):
    known = test_alignment_equals_walking.__dict__
    if "aligner" not in known:
        known["aligner"], known["first"] = token_alignment.Aligner(token_alignment.TokenPair(PATH_A, PATH_B)), Tokenizer.from_file(PATH_A)
        known["first"].encode_special_tokens = True
    aligner, text = known["aligner"], "".join(parts) + more
    a, b, groups, links = slow_alignment(known["first"], library, aligner.tokens, text)
    found = aligner.of_texts([text])
    assert found.counts.tolist() == [[len(a), len(b), len(groups), len(links), sum(len(x) * len(y) for x, y in groups)]]
    width = len(aligner.tokens.bytes_b)
    assert Counter((int(p) // width, int(p) % width) for p in found.pair) == Counter(links)


def test_shared_group_links():
    found = token_alignment.Alignment.of(np.array([2, 1, 3, 1]), np.array([1, 2, 1, 3]))
    assert found.ends.tolist() == [3, 7]
    assert dense(found.shared_group_links()).tolist() == [[1, 1, 0, 0], [1, 1, 0, 0], [0, 0, 1, 1], [0, 0, 1, 1]]
    assert found.shared_group_sizes().tolist() == [2, 2, 2, 2]
    assert dense(found.links).tolist() == [[1, 1, 0, 0], [0, 1, 0, 0], [0, 0, 1, 2], [0, 0, 0, 1]]


@pytest.mark.parametrize("most", [0, token_alignment.BROADCAST_PAIRS])
def test_alignment_of_odd_rows(spark, library, most):
    docs = edge_docs(spark).unionByName(spark.createDataFrame([(99, "q" * 20_000 + " a b" * 4000, 1, "")], "doc_id long, text string, ids int, runs string"))
    report = token_alignment.alignment_report(token_alignment.align_tokens(docs, PATH_A, PATH_B), most)
    wanted = slow_report([(r.doc_id, r.text) for r in docs.collect()], library)
    assert Counter(map(tuple, report.collect())) == wanted
    empty = token_alignment.alignment_report(token_alignment.align_tokens(docs.limit(0), PATH_A, PATH_B), most)
    assert empty.count() == 0


def test_alignment_query(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, op13_token_alignment(spark, SF).collect())) == slow_report(rows, library)


def test_lists_of_sliced_columns():
    rows = [[1, 2], None, [], [3, None], [4]]
    column = pa.array(rows, pa.list_(pa.int32()))
    assert list(sentence_pieces._lists(column)) == rows
    assert list(sentence_pieces._lists(column.slice(1, 3))) == rows[1:4]
    assert list(sentence_pieces._lists(column.slice(0, 0))) == []
