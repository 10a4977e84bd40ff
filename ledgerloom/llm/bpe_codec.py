"""BPE encoding and decoding (operator 8).

Encoding: a text is cut at strings of special tokens, normalised and split into words as the tokenizer file says. For
each word an Aho-Corasick automaton lists the tokens that start at each symbol, longest first. A walk takes the
longest one that fits its left neighbour by the pair-compatibility table, and steps back where none does; a position
found hopeless is never tried again, so a word takes linear time. Answers are remembered per word, up to a fixed number of words.

Decoding: an offset table into one run of bytes that holds all tokens; ids become a gather of byte ranges.

NULL and empty texts have no ids and decode to the empty text. A NULL doc_id is kept. Repeated rows give repeated rows.
Very long texts are handled whole; only the list of their ids grows with them.
"""
from __future__ import annotations

import array
import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import normalizers

from .common import columns, slices, text_or_empty
from .merges import byte_letters, in_brackets, marked, merges, ranges, special_pattern

REMEMBERED = 150_000       # words in each of the two generations of answers that a Python worker keeps
#: what the file's split pattern says, with its classes spelled out by `ranges`
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"


class Automaton:
    """Exact merges of one word by longest matches and the pair table."""

    def __init__(self, path: str):
        self.table = merges(path)
        self.find = ahocorasick.Automaton()
        for symbols, i in self.table.ids.items():
            self.find.add_word(symbols, (i, len(symbols)))
        self.find.make_automaton()

    def ids(self, symbols: str) -> list[int]:
        n, fits = len(symbols), self.table.fits
        starting: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, (i, size) in self.find.iter(symbols):
            starting[last - size + 1].append((i, size))        # shorter ones first
        hopeless, out, ends, at, tries = set(), [], [0], 0, list(starting[0])
        waiting = []                   # what is left to try at each position before
        while at < n:
            while tries:
                i, size = tries.pop()
                if at + size not in hopeless and (not out or fits(out[-1], i)):
                    waiting.append(tries)
                    out.append(i)
                    at += size
                    ends.append(at)
                    tries = list(starting[at]) if at < n else []
                    break
            else:
                if not out:
                    raise ValueError("symbols outside the vocabulary")
                # the way to `at` is the only exact one to it, so nothing that passes here can succeed
                hopeless.add(at)
                out.pop()
                ends.pop()
                at, tries = ends[-1], waiting.pop()
        return out


class Words(dict):
    """Ids of words as bytes of 32-bit numbers, found on first sight. A full generation becomes the one before it, whose words are taken
    over when they are met again: frequent words stay, and the memory does not grow with the corpus."""

    def __init__(self, path: str):
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.automaton, letters = Automaton(path), byte_letters()
        self.letters = {b: ord(c) for b, c in enumerate(letters)}
        self.suffix = self.automaton.table.suffix

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.before = self.copy()
            self.clear()
        found = self.before.get(word)
        if found is None:
            symbols = marked(word.encode().decode("latin-1").translate(self.letters), self.suffix)
            found = array.array("i", self.automaton.ids(symbols)).tobytes()
        self[word] = found
        return found


@functools.lru_cache(maxsize=None)
def _words(path: str) -> Words:
    return Words(path)


OLD_LETTERS = re.compile("[^\u0000-˿]")     # beyond: composition and case as the tokenizers library has them
_EXACT = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def normalised(text: str) -> str:
    """NFC and lower case. White space is not touched: the split drops it."""
    if text.isascii():
        return text.lower()
    if OLD_LETTERS.search(text):
        return _EXACT.normalize_str(text)
    return unicodedata.normalize("NFC", text).lower()


def _encoded(path: str, letters: tuple, digits: tuple, blanks: tuple):
    def splitting(limit: int):
        a, b, c = (in_brackets(tuple(x for x in r if x[0] < limit)) for r in (letters, digits, blanks))
        return re.compile(f"{CONTRACTIONS}|[{a}]+|[{b}]|[^{c}{a}{b}]+")

    early, full = splitting(0x300), splitting(0x110000)     # short classes are much faster, and right for early letters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        specials = words.automaton.table.specials
        cut = special_pattern(tuple(specials))
        for batch in batches:
            for part in slices(batch):
                sizes, ids = [0], []
                for text in part.column("text").to_pylist():
                    for piece in (cut.split(text) if "<|" in text else (text,)):
                        if piece in specials:
                            ids.append(np.array([specials[piece]], np.int32))
                        elif piece:
                            found = map(words.__getitem__, (full if OLD_LETTERS.search(piece) else early).findall(normalised(piece)))
                            ids.append(np.frombuffer(b"".join(found), np.int32))
                    sizes.append(len(ids))
                total = np.concatenate([[0], np.cumsum([len(x) for x in ids])]) if ids else np.zeros(1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(total[sizes].astype(np.int32)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))],
                    names=["doc_id", "ids"])
    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every whole text, exactly as the tokenizer file's library gives them without added tokens."""
    found = columns(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return found.mapInArrow(_encoded(path, ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")), "doc_id bigint, ids array<int>")


class Offsets:
    """All tokens in one run of bytes, and where each begins."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.bytes_of_letters = (json.load(f).get("decoder") or {}).get("type") == "ByteLevel"
        shown = merges(path).shown
        back = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        specials = set(merges(path).specials)
        pieces = [b"".join(back.get(c, c.encode()) for c in s) if self.bytes_of_letters and s not in specials
                  else s.encode() + b" " * (not self.bytes_of_letters) for s in shown]
        self.begin = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def text(self, ids: np.ndarray) -> bytes:
        begin, size = self.begin[ids], self.begin[ids + 1] - self.begin[ids]
        done = np.cumsum(size)
        out = self.data[np.repeat(begin - done + size, size) + np.arange(done[-1] if len(done) else 0)].tobytes()
        return out.decode(errors="replace").encode() if self.bytes_of_letters else out[:-1]     # no blank after the last


@functools.lru_cache(maxsize=None)
def _offsets(path: str) -> Offsets:
    return Offsets(path)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = _offsets(path)
        for batch in batches:
            lists = batch.column("ids")
            values, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            begin = 0
            while begin < batch.num_rows:       # about a million ids at once
                end = max(begin + 1, int(np.searchsorted(at, at[begin] + 1_000_000, side="right")) - 1)
                texts = [offsets.text(values[at[i]:at[i + 1]]) for i in range(begin, end)]
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "ids", "text"])
                begin = end
    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the text that the ids stand for, special tokens included. NULL ids are taken as none."""
    found = columns(encoded, "doc_id", "ids")
    return found.mapInArrow(_decoded(path), "doc_id bigint, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): `encode` and `decode` in one pass, so that a task holds one Python worker instead of two."""
    encoded, decoded = _encoded(path, ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")), _decoded(path)
    found = columns(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return found.mapInArrow(lambda batches: decoded(encoded(batches)), "doc_id bigint, ids array<int>, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids as text and of the decoded text."""
    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>"))
    return round_trip(docs, path).select(
        "doc_id", F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
