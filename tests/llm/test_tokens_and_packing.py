"""Prefix counts and packing against the tokenizers library."""

import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from leakscan.llm import packing, token_counts

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
PARTS = ["'", "s", "t", "re", "ll", "ve", "d", "m", " ", "  ", "\n", "\t", "a", "Ab", "hello", "12", "é", "漢", "😀", "!", "<|", "<|endoftext|>", "\x1c", "՘", "#", " "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(PATH)


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.sampled_from(PARTS), max_size=12))
def test_every_prefix_has_its_exact_count(parts, library, counter):
    text = "".join(parts)
    steps = counter.steps(text)
    assert len(steps) == len(text)
    counts = [token_counts.tokens_in_prefix(steps, k) for k in range(len(text) + 1)]
    assert counts == [len(ids(library, text[:k])) for k in range(len(text) + 1)]
    for budget in range(0, counts[-1] + 1):
        assert token_counts.longest_prefix(steps, budget) == max(k for k, n in enumerate(counts) if n <= budget)


@settings(max_examples=200, deadline=None)
@given(parts=st.lists(st.sampled_from(PARTS), max_size=12))
def test_ids_equal_the_library(parts, library):
    text = "".join(parts)
    known = test_ids_equal_the_library.__dict__.setdefault("ids", packing.TokenIds(PATH))
    assert list(struct.unpack(f"<{len(data := known.of(text)) // 4}I", data)) == ids(library, text)


def corpus(spark):
    random.seed(3)
    texts = ["".join(random.choices(PARTS, k=random.randint(0, 2500))) for _ in range(60)] + [None, "", "x" * 30_000, " " * 3000, *["same text"] * 200]
    rows = [(i if i != 5 else None, t, 1, "c") for i, t in enumerate(texts)]
    return texts, spark.createDataFrame(rows, "doc_id long, text string, length int, piece string").repartition(3)


def test_counts_of_whole_texts(spark, library):
    texts, table = corpus(spark)
    got = token_counts.token_count_report(table, PATH).collect()
    by_id = {i if i != 5 else None: t or "" for i, t in enumerate(texts)}
    assert len(got) == len(texts)
    for r in got:
        text = by_id[r.doc_id]
        n = len(ids(library, text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)
        assert n > 512 or r.fit_chars == len(text)
    assert token_counts.prefix_token_counts(table.limit(0), PATH).count() == 0


def test_pieces_fill_sequences_without_gaps(spark, library):
    texts, table = corpus(spark)
    got = packing.pack(table, PATH).collect()
    by_id = {i if i != 5 else None: t or "" for i, t in enumerate(texts)}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    total = 0
    for doc_id, text in by_id.items():
        want, at = [*ids(library, text), 2], 0
        total += len(want)
        for number, r in enumerate(sorted(pieces[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (number, at) and (number == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *want[at : at + r.length]))
            at += r.length
        assert at == len(want) and (len(want) > 1024 or len(pieces[doc_id]) == 1)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-total // 1024) + 1
    assert packing.pack(table.limit(0), PATH).count() == 0


def test_fullest_combination_equals_brute_force():
    random.seed(1)
    for _ in range(200):
        capacity = random.randint(5, 40)
        counts = {random.randint(1, capacity): random.randint(1, 3) for _ in range(random.randint(1, 6))}
        used = packing.fullest(counts, capacity)
        seed = max(counts)
        sums = {seed}
        for n, c in counts.items():
            for _ in range(c - (n == seed)):
                sums |= {x + n for x in sums if x + n <= capacity}
        assert sum(n * k for n, k in used.items()) == max(sums)
        assert all(k <= counts[n] for n, k in used.items()) and used[seed] >= 1
        plan = packing.bin_plan(counts, capacity)
        packed = defaultdict(int)
        for combination, times, _ in plan:
            for n, k in combination.items():
                packed[n] += k * times
        assert dict(packed) == counts
