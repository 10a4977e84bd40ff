"""Token counts by compiled finite-state transducers (operator 6).

Two deterministic transducers stand in a row, both with counts on their transitions.

1. The splitter reads classes of characters with two characters of lookahead and emits the beginning of a word. It has
   eight states. Texts are cut into chunks of equal length, wherever the cuts fall. For every chunk and each possible state
   at its start, one pass gives the state at its end: the chunk's state map. Maps compose, so a parallel prefix scan gives the
   true state at the start of each chunk, and a second pass over all chunks at once marks the words.
2. The counter reads the symbols of a word and emits, on each transition, how many tokens the word gained (or lost) by
   that symbol. Its states are made when first met: a state holds the open positions of the token trie with the token before
   each, and the tokens emitted up to there relative to the current count; a token closes only where the pair table allows
   its left neighbour, so exactly one way stays open to each position. Words seen before are looked up.

NULL and empty texts count 0. Strings of special tokens inside texts are one token each, as the library counts by default.
NULL doc_ids are kept and repeated rows give repeated rows.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import columns, slices, text_or_empty
from .merges import byte_letters, merges, ranges, special_pattern

LETTER, DIGIT, OTHER, BLANK, SPACE, QUOTE, S_T_M_D, R_V, E, L, END = range(11)
CLASSES = 11
ANEW, LETTERS, DIGITS, OTHERS, BLANKS, JOINED, ONE_MORE, TWO_MORE = range(8)
STATES = 8
CHUNK = 256                # characters of a chunk of the scan
REMEMBERED = 600_000       # words whose count a task keeps; it starts over beyond it
COMPILED = 200_000         # states that it keeps, likewise


def character_classes(letters: tuple, digits: tuple, blanks: tuple) -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for found, kind in ((letters, LETTER), (digits, DIGIT), (blanks, BLANK)):
        for a, b in found:
            out[a:b + 1] = kind
    out[ord(" ")], out[ord("'")] = SPACE, QUOTE
    for c in "stmd":
        out[ord(c)] = S_T_M_D
    out[ord("r")] = out[ord("v")] = R_V
    out[ord("e")], out[ord("l")] = E, L
    return out


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and words begun, by state and symbol (class of a character and of the two after it).

    It stands for: contractions 's 't 're 've 'm 'll 'd; else letters, digits or others, each with one space before;
    else white space, which leaves its last character to what follows.
    """
    kind = {LETTER: LETTERS, S_T_M_D: LETTERS, R_V: LETTERS, E: LETTERS, L: LETTERS, DIGIT: DIGITS, OTHER: OTHERS, QUOTE: OTHERS}
    white = (BLANK, SPACE)
    after = np.zeros((STATES, CLASSES ** 3), np.uint8)
    begins = np.zeros((STATES, CLASSES ** 3), np.uint8)

    def begin(a: int, b: int, c: int) -> int:
        if a == QUOTE and b == S_T_M_D:
            return ONE_MORE
        if a == QUOTE and (b, c) in ((R_V, E), (L, L)):
            return TWO_MORE
        if a in kind:
            return kind[a]
        if b in white or b == END:
            return BLANKS
        return JOINED if a == SPACE else ANEW

    for state in range(STATES):
        for symbol in range(CLASSES ** 3):
            a, b, c = symbol // CLASSES ** 2, symbol // CLASSES % CLASSES, symbol % CLASSES
            if a == END:
                result = ANEW, 1
            elif state in (ONE_MORE, TWO_MORE):
                result = (ANEW if state == ONE_MORE else ONE_MORE), 0
            elif state == JOINED and a in kind:
                result = kind[a], 0
            elif state in (LETTERS, DIGITS, OTHERS) and kind.get(a) == state:
                result = state, 0
            elif state == BLANKS and a in white and (b in white or b == END):
                result = BLANKS, 0
            else:
                result = begin(a, b, c), 1
            after[state, symbol], begins[state, symbol] = result
    return after, begins


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (chunks x states), in a logarithmic number of steps."""
    reach = 1
    while reach < len(maps):
        later = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.int64), 1)
        maps = np.concatenate([maps[:reach], later])
        reach *= 2
    return maps


def word_starts(classes: np.ndarray, after: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Positions at which a word begins, or a text ends, in a run of classes in which END follows each text."""
    n = len(classes)
    lanes = -(-n // CHUNK)
    wide = np.full(lanes * CHUNK + 2, END, np.int32)
    wide[:n] = classes
    symbols = np.ascontiguousarray(((wide[:-2] * CLASSES + wide[1:-1]) * CLASSES + wide[2:]).reshape(lanes, CHUNK).T)
    flat, size = after.ravel().astype(np.int32) * CLASSES ** 3, CLASSES ** 3      # states as row offsets
    at = np.repeat((np.arange(STATES, dtype=np.int32) * size)[:, None], lanes, 1)
    for symbol in symbols:
        at = flat[at + symbol]
    maps = scan((at // size).T.astype(np.uint8))
    state = np.concatenate([[ANEW], maps[:-1, ANEW]]).astype(np.int32) * size
    begun, marks = begins.ravel(), np.empty((CHUNK, lanes), np.uint8)
    for k, symbol in enumerate(symbols):
        place = state + symbol
        marks[k] = begun[place]
        state = flat[place]
    return np.flatnonzero(marks.T.ravel()[:n])


class Counter(dict):
    """Tokens of words, by a transducer whose states and transitions are compiled when first met."""

    def __init__(self, path: str):
        super().__init__()
        self.table = merges(path)
        self.fits = self.table.fits
        self.letters = {b: ord(c) for b, c in enumerate(byte_letters())}
        self.children: list[dict[str, int]] = [{}]
        self.token: list[int | None] = [None]
        for symbols, i in self.table.ids.items():
            node = 0
            for c in symbols:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                node = self.children[node][c]
            self.token[node] = i
        self.reset()

    def reset(self) -> None:
        self.open = [(0, -1, 0)]           # per state, in threes: trie node, token before, tokens up to there relative to now
        self.known = {self.open[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """Compile the transition of `state` by `symbol`: the state after it, and the tokens emitted on it."""
        now, closed, children, tokens, each = [], None, self.children, self.token, iter(self.open[state])
        for node, before, count in zip(each, each, each):
            node = children[node].get(symbol)
            if node is not None:
                token = tokens[node]
                if token is not None and (before < 0 or self.fits(before, token)):
                    closed = token, count + 1      # the only one: merges are unique
                if children[node]:
                    now.append((node, before, count))
        if closed is None:
            raise ValueError("symbols outside the vocabulary")
        token, gained = closed
        key = [0, token, 0]
        for node, before, count in now:
            key += (node, before, count - gained)
        key = tuple(key)
        after = self.known.get(key)
        if after is None:
            after = self.known[key] = len(self.open)
            self.open.append(key)
            self.moves.append({})
        found = self.moves[state][symbol] = after, gained
        return found

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        if len(self.open) >= COMPILED:
            self.reset()
        state = count = 0
        moves = self.moves
        for symbol in word.encode().decode("latin-1").translate(self.letters):
            state, gained = moves[state].get(symbol) or self.step(state, symbol)
            count += gained
        self[word] = count
        return count


@functools.lru_cache(maxsize=None)
def _counter(path: str) -> Counter:
    return Counter(path)


def _counted(path: str, letters: tuple, digits: tuple, blanks: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, (after, begins), kind = _counter(path), splitter(), character_classes(letters, digits, blanks)
        specials = counter.table.specials
        cut = special_pattern(tuple(specials))
        for batch in batches:
            for part in slices(batch):
                pieces, owner, counts = [], [], np.zeros(part.num_rows, np.int64)
                for i, text in enumerate(part.column("text").to_pylist()):
                    for piece in (cut.split(text) if "<|" in text else (text,)):
                        if piece in specials:
                            counts[i] += 1
                        elif piece:
                            pieces.append(piece)
                            owner.append(i)
                if pieces:
                    joined = "\n".join(pieces) + "\n"
                    classes = kind[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
                    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
                    classes[ends] = END
                    starts = word_starts(classes, after, begins)
                    at = starts.tolist()
                    words = [joined[a:b] for a, b in zip(at, at[1:])]       # at an end: the line feed put there, or nothing
                    closing = np.searchsorted(starts, ends)
                    for k in closing[:-1].tolist():
                        words[k] = ""
                    tokens = np.fromiter(map(counter.__getitem__, words), np.int64, len(words))
                    total = np.concatenate([[0], np.cumsum(tokens)])
                    upto = total[closing]
                    np.add.at(counts, owner, np.diff(upto, prepend=0))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every whole text."""
    text = text_or_empty()
    found = columns(docs, "doc_id", "text").select("doc_id", text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    return (found.mapInArrow(_counted(path, ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")), "doc_id bigint, n_bytes bigint, n_tokens bigint")
            .withColumn("over_limit", F.col("n_tokens") > limit))
