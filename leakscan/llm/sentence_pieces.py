"""SentencePiece BPE: encoding by a table of last tokens, and decoding.

Each prefix of a text has one last token: the token that ends there and stays apart from the last token of what comes before it. So one
pass over the matches of an automaton of all pieces, with a test whether two tokens stay as they are side by side, fills a
table with the last token of every prefix, and walking it backwards from the end gives the ids.

Two tokens stay apart if merging their joined text, best piece first, never merges across the seam. Up to such a merge each
side merges as it does alone. So the test replays both sides' own merges in order of score and looks each time at the pair along the seam.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leakscan.llm.bpe import UnitCache
from leakscan.llm.common import per_process

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: Bounds of what a worker keeps, in entries of 100 to 150 bytes.
FITS = 400_000
UNITS = 150_000
MOVES = 250_000
#: Rows that are held as ids or texts at a time.
ROWS = 1000
NONE = float("-inf")
WORD = re.compile(r"([A-Za-zÀ-ɏ]+)([\x00-@\[-`{-\x7f]*)\Z")
SEAM = re.compile(r"(?<=[A-Za-zÀ-ɏ])(?=[\x00-@\[-`{-\x7f])|(?<=[\x00-@\[-`{-\x7f])(?=[A-Za-zÀ-ɏ])")

History = list[tuple[float, str]]


class PieceModel:
    """Pieces and scores of a BPE model file with byte fallback, without normalization and with a space put first."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules, trained = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if (
            trained.model_type != BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix or rules.precompiled_charsmap
            or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces or kinds & {USER_DEFINED, UNUSED}
        ):
            raise ValueError("a BPE model with byte fallback, a space put first and no normalization is needed")
        self.pieces = [p.piece for p in model.pieces]
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.unknown_text = trained.unk_surface
        self.control = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        self.end = next((i for i in self.control if self.pieces[i] == trained.eos_piece), None)
        #: Whether a text can be cut before each run of spaces, as no piece goes on with a space after another character.
        self.cuts = not any(SPACE in piece.lstrip(SPACE) for piece in self.scores)
        #: Whether no piece has a Latin letter beside an ASCII character that is none, so that texts can be cut there too.
        self.words = self.cuts and not any(SEAM.search(piece) for piece in self.scores)

    def token_bytes(self) -> list[bytes]:
        """What each id stands for: a piece with spaces, a byte, nothing for control ids."""
        raw = {i: bytes([b]) for b, i in self.byte_ids.items()} | {self.unknown: self.unknown_text.encode()} | dict.fromkeys(self.control, b"")
        return [raw[i] if i in raw else piece.replace(SPACE, " ").encode() for i, piece in enumerate(self.pieces)]


class Matches:
    """An automaton over words: for each place of a text the words that end there, longest first.

    Moves that go back over shorter endings are kept once they were made, up to a number of them.
    """

    def __init__(self, words: list[str]):
        self.moves: list[dict[str, int]] = [{}]
        #: The words that end in a state, as (number, length).
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        for number, word in enumerate(words):
            state = 0
            for letter in word:
                if letter not in self.moves[state]:
                    self.moves[state][letter] = len(self.moves)
                    self.moves.append({})
                    self.ends.append(())
                state = self.moves[state][letter]
            self.ends[state] = ((number, len(word)),)
        self.shorter, self.kept = [0] * len(self.moves), 0
        waiting = deque(self.moves[0].values())
        while waiting:
            state = waiting.popleft()
            for letter, longer in self.moves[state].items():
                back = self.shorter[state]
                while back and letter not in self.moves[back]:
                    back = self.shorter[back]
                self.shorter[longer] = back = self.moves[back].get(letter, 0)
                self.ends[longer] += self.ends[back]
                waiting.append(longer)

    def move(self, state: int, letter: str) -> int:
        back = state
        while back and letter not in self.moves[back]:
            back = self.shorter[back]
        found = self.moves[back].get(letter, 0)
        if self.kept < MOVES:
            self.moves[state][letter], self.kept = found, self.kept + 1
        return found


class PieceEncoder:
    """Ids of texts, as the library gives them without begin and end ids."""

    def __init__(self, model: PieceModel):
        self.model, self.scores = model, model.scores
        #: Tokens: the pieces, and characters that occur in pieces only.
        self.tokens = list(dict.fromkeys([*model.scores, *sorted(set("".join(model.scores)))]))
        self.output = [self._bytes_of(token) for token in self.tokens]
        self.lengths = [len(token) for token in self.tokens]
        self.matches = Matches(self.tokens)
        self.fits: dict[int, bool] = {}
        self.own: dict[int, tuple[History, History] | None] = {}
        self.units = re.compile(f"{SPACE}+[^{SPACE}]*")
        self.by_part = UnitCache(self.unit_ids, UNITS)
        self.by_word = UnitCache(self._joined, UNITS)

    def _bytes_of(self, token: str) -> bytes:
        if token in self.model.ids:
            return array("i", [self.model.ids[token]]).tobytes()
        return array("i", [self.model.byte_ids.get(b, self.model.unknown) for b in token.encode()]).tobytes()

    def _merges(self, number: int) -> tuple[History, History] | None:
        """The merges that make a token, as scores with the last (the first) symbol after each; None if merging doesn't end in it."""
        symbols, right, left = list(self.tokens[number]), [], []
        while len(symbols) > 1:
            best, at = max((self.scores.get(a + b, NONE), -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == NONE:
                return None
            symbols[-at : 2 - at] = [symbols[-at] + symbols[1 - at]]
            right.append((best, symbols[-1]))
            left.append((best, symbols[0]))
        return right, left

    def _history(self, number: int) -> tuple[History, History] | None:
        if number not in self.own:
            self.own[number] = self._merges(number)
        return self.own[number]

    def _apart(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are side by side; ``left`` is -1 at the start."""
        after, before = self._history(left) if left >= 0 else ([], []), self._history(right)
        if after is None or before is None:
            return False
        if left < 0:
            return True
        ours, theirs, scores = after[0], before[1], self.scores
        last, first, i, j = self.tokens[left][-1], self.tokens[right][0], 0, 0
        seam = scores.get(last + first, NONE)
        while True:
            mine = ours[i][0] if i < len(ours) else NONE
            other = theirs[j][0] if j < len(theirs) else NONE
            if seam != NONE and seam > mine and seam >= other:  # of equal scores the leftmost pair goes first
                return False
            if mine == NONE and other == NONE:
                return True
            if mine >= other:
                symbol, i = ours[i][1], i + 1
                if symbol == last:
                    continue
                last = symbol
            else:
                symbol, j = theirs[j][1], j + 1
                if symbol == first:
                    continue
                first = symbol
            seam = scores.get(last + first, NONE)

    def last_tokens(self, text: str) -> list[int]:
        """For the prefix of each length its last token; -1 for the empty one and after a character that is in no piece."""
        fits, many, matches = self.fits, len(self.tokens), self.matches
        moves, ends, last, state = matches.moves, matches.ends, [-1], 0
        if len(fits) > FITS:
            fits.clear()
        for letter in text:
            try:
                state = moves[state][letter]
            except KeyError:
                state = matches.move(state, letter)
            for token, length in ends[state]:
                key = last[-length] * many + token
                try:
                    fit = fits[key]
                except KeyError:
                    fit = fits[key] = self._apart(last[-length], token)
                if fit:
                    last.append(token)
                    break
            else:
                last.append(-1)
        return last

    def unit_ids(self, text: str) -> bytes:
        """Ids of a text in which spaces are written as in pieces, as 32-bit numbers."""
        last, end, found = self.last_tokens(text), len(text), []
        while end:
            token = last[end]
            if token < 0:
                found.append(self._bytes_of(text[end - 1]))
                end -= 1
            else:
                found.append(self.output[token])
                end -= self.lengths[token]
        found.reverse()
        return b"".join(found)

    def _joined(self, word: str) -> bytes:
        """Ids of a space and a word without spaces, from those of its parts."""
        plain = WORD.match(word)
        if plain:
            return self.by_part[SPACE + plain[1]] + self.by_part[plain[2]] if plain[2] else self.by_part[SPACE + word]
        return b"".join(map(self.by_part.__getitem__, SEAM.split(SPACE + word)))

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        text = text.replace(SPACE, " ")
        if self.model.words and "  " not in text and text[0] != " ":
            return b"".join(map(self.by_word.__getitem__, text.split(" ")))
        text = SPACE + text.replace(" ", SPACE)
        return b"".join(map(self.by_part.__getitem__, self.units.findall(text))) if self.model.cuts else self.unit_ids(text)


def _one_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


class PieceDecoder:
    """Text of ids, as the library gives it: without the space put first, with a replacement character for each byte that is no text."""

    def __init__(self, model: PieceModel):
        codecs.register_error("each_byte", _one_byte)
        self.table = model.token_bytes()
        self.pieces, self.control = set(model.ids.values()), model.control

    def text(self, ids: list[int]) -> str:
        joined = b"".join(map(self.table.__getitem__, ids))
        for token in ids:
            if token in self.control:
                continue
            if token in self.pieces and joined.startswith(b" "):
                joined = joined[1:]
            break
        return joined.decode("utf-8", "each_byte")


def _lists(column: pa.ListArray) -> Iterator[list[int] | None]:
    """The rows of a column of lists. A row is converted at once, as one by one is far slower."""
    values, places = column.values, column.offsets.to_pylist()
    for start, stop, known in zip(places, places[1:], column.is_valid().to_pylist(), strict=False):
        if not known:
            yield None
            continue
        row = values.slice(start, stop - start)
        yield row.to_pylist() if row.null_count else row.to_numpy().tolist()


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(start, ROWS) for start in range(0, batch.num_rows, ROWS))


def encode(docs: DataFrame, path: str, end: bool = True) -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and ``ids``, array<int>, with the end id of the model behind them if ``end``.

    A null text counts as empty and has only the end id. Strings of control pieces inside texts are ordinary text. A null id stays
    null, rows that come again are encoded one by one, an empty table gives no rows, other columns are not read.
    """

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process("encoder", path, lambda path: PieceEncoder(PieceModel(path)))
        tail = array("i", [encoder.model.end]).tobytes() if end else b""
        for batch in _small(batches):
            found = [encoder.ids(text.as_py() or "") + tail for text in batch.column("text")]
            offsets = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(found), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(ids_of, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of ``encoded``: ``doc_id``, ``ids`` and ``text``. Null ids give a null text; ids outside the model are an error."""

    def text_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = per_process("decoder", path, lambda path: PieceDecoder(PieceModel(path)))
        for batch in _small(batches):
            texts = [None if ids is None else decoder.text(ids) for ids in _lists(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(text_of, f"doc_id {kind}, ids array<int>, text string")


def round_trip_report(decoded: DataFrame) -> DataFrame:
    """Number and digests of ids and of the decoded text."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )


__all__ = ["PieceDecoder", "PieceEncoder", "PieceModel", "decode", "encode", "round_trip_report"]
