"""Operators 6 and 8 against the library, on texts with every kind of character."""
import hashlib
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import bpe_codec, token_counts
from ledgerloom.llm.merges import merges

from .helpers import docs, plain

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(4)
    alphabet = "ab'stmdrevl 1 2\n\t  .!é日　İΣς"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0x10000, 0x1FFFF)]))
                      for _ in range(rng.randint(1, 40))) for _ in range(300)]
    return texts + ["a <|endoftext|>b<|startoftext|>", "I'll 'sabc ''s they're", "   x", "x   ", "\n\n\n", "ab" * 3000, "aaaa" * 2000, None, ""]


def test_counts_equal_the_library(spark):
    texts = odd_texts()
    got = {r.doc_id: r for r in token_counts.token_counts(plain(spark, *texts), BYTES).collect()}
    lib = Tokenizer.from_file(BYTES)
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512), t


def test_codec_equals_the_library(spark):
    texts = odd_texts()
    got = {r.doc_id: r for r in bpe_codec.digests(plain(spark, *texts), WORDS).collect()}
    lib, sha = Tokenizer.from_file(WORDS), lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == sha(" ".join(map(str, ids))), t
        assert got[i].decoded_sha256 == sha(lib.decode(ids, skip_special_tokens=False)), t


def test_answers_in_two_generations(spark, monkeypatch):
    """Words remembered do not grow with the corpus, frequent ones are kept, and all answers are those of a fresh start."""
    monkeypatch.setattr(bpe_codec, "REMEMBERED", 40)
    words, rng = bpe_codec.Words(WORDS), random.Random(6)
    seen = []
    for k in range(600):
        for word in ("often", "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))):
            seen.append((word, words[word]))
            assert len(words) + len(getattr(words, "before", {})) <= 80
    fresh = bpe_codec.Words(WORDS)
    assert len({w for w, _ in seen}) > 200 and all(fresh[w] == ids for w, ids in seen)


def test_codec_holds_one_python_worker_a_task(spark):
    plan = bpe_codec.digests(plain(spark, "some text"), WORDS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert bpe_codec.decode(bpe_codec.encode(plain(spark, "Some  text", None), WORDS), WORDS).collect() == bpe_codec.round_trip(plain(spark, "Some  text", None), WORDS).collect()


def test_byte_level_round_trip():
    offsets, automaton = bpe_codec.Offsets(BYTES), bpe_codec.Automaton(BYTES)
    import numpy as np
    for word in ("hello", "Ġthe", "zzzzqqqq"):
        assert offsets.text(np.array(automaton.ids(word))).decode() == word.replace("Ġ", " ")


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pair_table_against_merging(path):
    m = merges(path)
    by_rank = m.rank

    def merged(ids):
        while True:
            found = [(by_rank[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in by_rank]
            if not found:
                return ids
            r, k = min(found)
            made = next(t for t, parts in [(m.ids.get(m.symbols[ids[k]] + m.symbols[ids[k + 1]]), None)])
            ids = ids[:k] + [made] + ids[k + 2:]
    rng, tokens = random.Random(2), list(m.ids.values())
    singles = {s: i for i, s in m.symbols.items() if len(s) == 1}
    for _ in range(400):
        a, b = rng.choice(tokens), rng.choice(tokens)
        symbols = m.symbols[a] + m.symbols[b]
        assert m.fits(a, b) == (merged([singles[c] for c in symbols]) == [a, b])


def test_scan_composes_maps():
    import numpy as np
    maps = np.random.default_rng(1).integers(0, 5, (37, 5)).astype(np.uint8)
    state, want = np.arange(5), []
    for m in maps:
        state = m[state]
        want.append(state)
    assert (token_counts.scan(maps) == np.array(want)).all()


def test_odd_tables(spark):
    d = docs(spark)
    assert token_counts.token_counts(d, BYTES).count() == bpe_codec.digests(d, WORDS).count() == d.count()
    none = d.limit(0)
    assert token_counts.token_counts(none, BYTES).count() == bpe_codec.digests(none, WORDS).count() == 0
    assert bpe_codec.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>"), WORDS).filter("text = ''").count() == 2
