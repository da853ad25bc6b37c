"""Byte-level BPE in units: stretches of text whose tokens don't depend on what stands around them."""

from __future__ import annotations

import json
import re
import unicodedata

import regex

#: A fixed value: how this family of vocabularies cuts text before merging.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A pretoken with all white space before it. Only white space is cut by what follows it, so the tokens of
#: a text are those of its units, and those of a prefix are those of whole units and of one unit's prefix.
UNIT = r"(?:\s*[^\S ])?'(?:s|t|re|ve|m|ll|d)|\s*\p{L}+|\s*\p{N}+|\s*[^\s\p{L}\p{N}]+|\s+"
#: A space beside other white space. A text without it can be cut at its spaces, which is faster.
UNEVEN = re.compile(r" \s|\s ")
CACHE_UNITS = 400_000
CACHE_PIECES = 500_000
CACHE_FITS = 1_000_000
LONG_UNIT = 64
CACHE_STATES = 300_000
SHORT_PREFIX = 10
START = 1 << 19
PRIVATE = 0xE000
_SPACE = r"\p{White_Space}"


def compiled(pattern: str) -> regex.Pattern:
    """Without a case for the separators 0x1C to 0x1F, which are no white space for the tokenizer library."""
    return regex.compile(pattern.replace(r"[^\S ]", rf"(?:(?! ){_SPACE})").replace(r"[^\s", rf"[^{_SPACE}").replace(r"\s", _SPACE).replace(r"\S", r"\P{White_Space}"))


def byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable ones as themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class UnitCache(dict):
    """Unit -> bytes from ``make``; keeps up to ``most`` units of up to LONG_UNIT characters."""

    def __init__(self, make, most: int = CACHE_UNITS):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, unit: str) -> bytes:
        value = self.make(unit)
        if len(unit) <= LONG_UNIT:
            if len(self) >= self.most:
                self.clear()
            self[unit] = value
        return value


class UnitBytes:
    """Joined bytes of the units of ordinary text; ``make`` gives those of one unit."""

    def __init__(self, make):
        self.units = compiled(UNIT)
        self.by_unit = UnitCache(make)
        of_units = lambda text: b"".join(map(self.by_unit.__getitem__, self.split(text)))
        self.of_units = of_units
        self.by_piece = UnitCache(lambda piece: of_units(" " + piece), CACHE_PIECES)

    def split(self, text: str) -> list[str]:
        """The units of a text. Characters without a category yet count as symbols, as in the tokenizer library."""
        odd = () if text.isascii() else {ord(c): PRIVATE for c in set(text) if unicodedata.category(c) == "Cn"}
        if not odd:
            return self.units.findall(text)
        return [text[m.start() : m.end()] for m in self.units.finditer(text.translate(odd))]

    def of(self, text: str) -> bytes:
        if UNEVEN.search(text):
            return self.of_units(text)
        first, *rest = text.split(" ")
        return self.of_units(first) + b"".join(map(self.by_piece.__getitem__, rest))


class Vocabulary:
    """Tokens and merge ranks of a tokenizers file, for counting."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.specials = [t["content"] for t in content["added_tokens"]]
        ids = {token: i for token, i in content["model"]["vocab"].items() if all(c in letters for c in token)}
        self.ids = {raw(token): i for token, i in ids.items()}
        self.bytes = {i: token for token, i in self.ids.items()}
        #: Every string with which a token ends: the token that it is, or -1.
        self.endings = {token[i:]: -1 for token in self.ids for i in range(1, len(token))} | self.ids
        self.merges = {}
        for rank, pair in enumerate(content["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        self.joins = {pair: made for pair, (_, made) in self.merges.items()}
        self.parts = {made: pair for pair, made in self.joins.items()}
        made = list(self.joins.values())
        #: Whether numbers of tokens follow the order of the merges.
        self.ordered = made == sorted(made) and len(set(made)) == len(made) and all(i < made[0] for i in self.bytes if i not in self.parts)
        self.fits: dict[int, bool] = {}
        self.states: dict[bytes, int] = {}
        self.special_ids = {t["content"]: t["id"].to_bytes(4, "little") for t in content["added_tokens"]}
        self.pretokens = compiled(PRETOKEN)
        self.leading = compiled(r"\s*")

    def merge(self, text: bytes) -> list[int]:
        """The tokens of a short byte string, by merging the pair of lowest rank until none is left."""
        parts = [self.ids[text[i : i + 1]] for i in range(len(text))]
        while len(parts) > 1:
            best = min((self.merges.get(pair, (1 << 60, 0)) for pair in zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and self.merges.get((parts[i], parts[i + 1]), (-1, 0))[0] == best[0]:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _check(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are side by side; left is START where there is none."""
        if len(self.fits) > CACHE_FITS:
            self.fits.clear()
        if left == START:
            return self.merge(self.bytes[right]) == [right]
        return self._seam(left, right) if self.ordered else self.merge(self.bytes[left] + self.bytes[right]) == [left, right]

    def _seam(self, left: int, right: int) -> bool:
        """Whether no merge across the seam comes before one that hides it.

        Merges along the seam are undone from the last to the first; a pair that meets on the way and that would have been
        merged before its parts were hidden shows that the tokens don't stay.
        """
        joins, parts, hidden = self.joins, self.parts, 1 << 60
        while True:
            if joins.get((left, right), hidden) < hidden:
                return False
            whole_left, whole_right = left not in parts, right not in parts
            if whole_left and whole_right:
                return True
            if whole_right or (not whole_left and left > right):  # the left token was formed last
                hidden, left = left, parts[left][1]
            else:
                hidden, right = right + 1, parts[right][0]

    def prefix_counts(self, text: bytes) -> list[int]:
        """Token counts of every prefix of one pretoken, 0 to all bytes.

        The last token of a prefix is the one token that ends there and stays as it is after the last token of
        what comes before it, so one pass finds the counts of all prefixes.
        """
        endings, fits, states, counts, last = self.endings, self.fits, self.states, [0], [START]
        for end in range(1, len(text) + 1):
            if end <= SHORT_PREFIX:  # many units begin alike
                state = states.get(text[:end])
                if state is not None:
                    counts.append(state >> 20)
                    last.append(state & 0xFFFFF)
                    continue
            for start in range(end - 1, -1, -1):
                token = endings[text[start:end]]
                if token >= 0:
                    key = last[start] << 20 | token
                    fit = fits.get(key)
                    if fit is None:
                        fit = fits[key] = self._check(last[start], token)
                    if fit:
                        counts.append(counts[start] + 1)
                        last.append(token)
                        break
            if end <= SHORT_PREFIX:
                if len(states) >= CACHE_STATES:
                    states.clear()
                states[text[:end]] = counts[end] << 20 | last[end]
        return counts

    def char_counts(self, text: str) -> list[int]:
        """``prefix_counts`` at the ends of characters."""
        counts, at, out = self.prefix_counts(text.encode()), 0, [0]
        if len(counts) == len(text) + 1:
            return counts
        for c in text:
            at += len(c.encode())
            out.append(counts[at])
        return out

    def unit_counts(self, unit: str) -> list[int]:
        """Token counts of every prefix of a unit, at the ends of its characters."""
        space = self.leading.match(unit).group()
        core = unit[len(space) :]
        if not core or not space or space == " ":
            return self._core_counts(unit)
        before = self.char_counts(space)
        if space[-1] == " ":
            rest, skip = self._core_counts(" " + core), 1
            base = before[len(space) - 1]
        else:
            rest, skip = self._core_counts(core), 0
            base = before[len(space) - 1] + self.char_counts(space[-1])[-1]
        return before + [base + n for n in rest[1 + skip :]]

    def _core_counts(self, text: str) -> list[int]:
        if len(text) == 3 and text in ("'re", "'ve", "'ll"):
            quote = self.char_counts("'")[-1]
            return [0, quote, quote + self.char_counts(text[1])[-1], self.char_counts(text)[-1]]
        return self.char_counts(text)


def cut_specials(text: str, specials: list[str]) -> list[str]:
    """Ordinary text and special strings in turn, ordinary text first and last."""
    if not any(s in text for s in specials):
        return [text]
    return regex.split("(" + "|".join(map(regex.escape, specials)) + ")", text)
