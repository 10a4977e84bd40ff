"""A byte-pair vocabulary read for use by finite-state methods: valid tokens and the pairs of them that may stand side by side.

A text's merges are exact if and only if every token is what its own characters merge to and no merge could have
crossed the border of two neighbours. Whether one could is read off the two tokens' histories: along the border each token
passes through a short chain of pieces (its right or left spine), each alive from the merge that made it to the merge
that used it. A crossing merge needs a piece of either chain, alive at its rank. Merges with equal rank go from left to right,
so the right token's piece may die at the very rank of the crossing merge and the left token's may not.
This holds where every merge ranks behind those that make its parts, which is checked on loading.
"""
from __future__ import annotations

import functools
import json

import numpy as np
import regex
from tokenizers import Regex, normalizers

NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies (printable bytes stand for themselves)."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def marked(letters: str, suffix: str | None) -> str:
    """Letters of a word; where the vocabulary has an end-of-word suffix, the last letter is another symbol."""
    return letters[:-1] + chr(ord(letters[-1]) + 0x2000) if suffix else letters


class Merges:
    """Tokens as strings of symbols; `ids`, and `fits(left id, right id)`."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        model = read["model"]
        self.suffix = model["end_of_word_suffix"] or None
        self.specials = {t["content"]: t["id"] for t in read["added_tokens"]}
        self.shown: list[str] = [""] * (1 + max([*model["vocab"].values(), *self.specials.values()]))
        self.symbols: dict[int, str] = {}
        for token, i in model["vocab"].items():
            self.shown[i] = token
            body = token.removesuffix(self.suffix) if self.suffix else token
            if body:
                self.symbols[i] = marked(body, self.suffix) if self.suffix and token.endswith(self.suffix) else body
        for token, i in self.specials.items():
            self.shown[i] = token
        vocab = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {i: -1 for i, s in self.symbols.items() if len(s) == 1}
        for r, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]):
            a, b, made = vocab[a], vocab[b], vocab[a + b]
            if made in self.born or max(self.born.get(a, NEVER), self.born.get(b, NEVER)) >= r:
                raise ValueError("this vocabulary's merges are not in order; the border test needs them so")
            self.rank[a, b], self.parts[made], self.born[made] = r, (a, b), r
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._fits: dict[int, bool] = {}
        self.ids: dict[str, int] = {}
        sound: set[int] = set()
        for i in sorted(self.born, key=self.born.get):     # parts come before what is made of them
            if i not in self.parts or all(p in sound for p in self.parts[i]) and not self._crossed(*self.parts[i], self.rank[self.parts[i]]):
                sound.add(i)
                self.ids[self.symbols[i]] = i

    def _spine(self, token: int, side: int, known: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """(piece, rank of the merge that uses it) from the token down to its last or first symbol."""
        if token not in known:
            chain, dies = [], NEVER
            t: int | None = token
            while t is not None:
                chain.append((t, dies))
                dies, t = self.born[t], self.parts[t][side] if t in self.parts else None
            known[token] = chain
        return known[token]

    def _crossed(self, a: int, b: int, own: int = NEVER) -> bool:
        """Does a merge ranked before `own` cross the border of a and b?"""
        right = self._spine(b, 0, self._left)
        for piece, dies in self._spine(a, 1, self._right):
            for other, other_dies in right:
                r = self.rank.get((piece, other))
                if r is not None and r < own and r < dies and r <= other_dies:
                    return True
        return False

    def fits(self, a: int, b: int) -> bool:
        pair = a << 20 | b
        found = self._fits.get(pair)
        if found is None:
            if len(self._fits) > 500_000:        # a memory of answers, not a limit
                self._fits.clear()
            found = self._fits[pair] = not self._crossed(a, b)
        return found


@functools.lru_cache(maxsize=None)
def merges(path: str) -> Merges:
    return Merges(path)


@functools.lru_cache(maxsize=None)
def ranges(name: str) -> tuple[tuple[int, int], ...]:
    """Code points of a class such as \\p{L} as the tokenizers library knows it (Unicode versions differ), as ranges."""
    known = np.delete(np.arange(0x110000, dtype="<u4"), np.arange(0xD800, 0xE000))
    rest = normalizers.Replace(Regex(name + "+"), "").normalize_str(known.tobytes().decode("utf-32-le"))
    inside = np.setdiff1d(known, np.frombuffer(rest.encode("utf-32-le"), "<u4"), assume_unique=True)
    new = np.flatnonzero(np.diff(inside, prepend=inside[0]) != 1)
    last = np.append(new[1:] - 1, len(inside) - 1)
    return tuple(zip(inside[new].tolist(), inside[last].tolist()))


def in_brackets(found: tuple[tuple[int, int], ...]) -> str:
    """The ranges as the inside of a bracket expression."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


@functools.lru_cache(maxsize=None)
def special_pattern(specials: tuple[str, ...]):
    """Splits a text at strings of special tokens, longest first, keeping them."""
    return regex.compile("(" + "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None
