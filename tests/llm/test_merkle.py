"""The tree of midstates against hashlib, node by node."""
import hashlib
import zlib

import numpy as np
import pytest

from ledgerloom.llm import merkle
from ledgerloom.llm.common import save

from .helpers import DOCS, docs, rows

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def brute(data, fanout):
    """One dict per row."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    hashed = lambda r, more=0: H(*map(part, (r[0], r[3], r[2], r[4] if r[4] is None else r[4] + more, r[1])))
    up = lambda level: [H(*level[i:i + fanout]) for i in range(0, len(level), fanout)]
    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append(up(out[-1]))
        return out
    groups = {}
    for r in data:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, hashed(r)))
        trees[g] = tree([hashed(r) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now, seen = hashed(r, int(tampered)), []
            for levels, at in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    start = at // fanout * fanout
                    run = level[start:start + fanout]
                    seen += run[:at - start] + run[at - start + 1:]
                    now = H(*run[:at - start], now, *run[at - start + 1:])
                    at //= fanout
            out.append({"doc_id": r[0], "leaf": hashed(r), "subroot": trees[g][-1][0], "root": top[-1][0], "proof_sha256": H(*seen),
                        "folded_root": now, "verified": now == top[-1][0]})
    return out


def same(df, want):
    got = [r.asDict() for r in df.collect()]
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"], r["proof_sha256"])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_one_level_equals_hashlib():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(7)]
    nodes = merkle.from_bytes(b"".join(digests))
    for fanout in (2, 3, 5, 8):
        above, states = merkle.raised(nodes, fanout)
        assert merkle.to_bytes(above).hex() == "".join(H(*[d.hex() for d in digests[i:i + fanout]]) for i in range(0, 7, fanout))
        # a state resumes: the digests before the slot need not be hashed again
        now = merkle.compress(states[1][:, :1], merkle.hex_block(nodes[:, 1:2]))
        for j in range(2, min(fanout, 7)):
            now = merkle.compress(now, merkle.hex_block(nodes[:, j:j + 1]))
        assert (merkle.finish(now, min(fanout, 7)) == above[:, :1]).all()


@pytest.mark.parametrize("fanout,height", [(2, 12), (2, 3), (3, 2)])
def test_manifest_equals_brute_force(spark, fanout, height):
    data = rows()
    found = merkle.manifest(docs(spark, data), merkle.tampered_sevenths(), fanout, height)
    same(found, brute(data, fanout))
    assert not all(r.verified for r in found.select("verified").collect())


def test_one_row_one_group_and_none(spark):
    one = [(5, "a", "en", None, 1, None, None, None)]
    same(merkle.manifest(docs(spark, one), merkle.tampered_sevenths()), brute(one, 2))
    pair = one + [(6, None, "en", "s", None, None, None, None)]
    same(merkle.manifest(docs(spark, pair), merkle.tampered_sevenths()), brute(pair, 2))
    assert merkle.manifest(spark.createDataFrame([], DOCS), merkle.tampered_sevenths()).count() == 0


def test_null_language_is_not_the_empty_one(spark):
    data = [(i, "t", g, "s", 1, None, None, None) for i, g in enumerate([None, "", "é", "z", "0", "1"])]
    same(merkle.manifest(docs(spark, data), merkle.tampered_sevenths()), brute(data, 2))


def test_stages_keep_nodes_and_states(spark):
    """A saved tree is enough to fold: every stage's rows hold the states before each child slot."""
    nodes = merkle.ranked(merkle.leaves(docs(spark, [(i, str(i), "en", "s", 1, None, None, None) for i in range(21)])), ["doc_id", "leaf"], 2)
    tree = merkle.build(nodes, 2, 2)
    assert len(tree.stages) == 3 and [s.count() for s in tree.stages] == [6, 2, 1]
    for r in tree.stages[0].collect():
        assert [len(x) for x in r.states] == [2 * len(x) for x in r.nodes[1:]]
