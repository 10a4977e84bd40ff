"""The pipeline on the smallest table: each stage against brute force on its own input; odd tables."""
import hashlib

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from ledgerloom.llm.queries import ORACLES, QUERIES

from .helpers import docs
from .test_duplicates import brute_components, brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, the table itself first."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = [(d.columns, [tuple(r) for r in d.collect()])]
    for _, stage in pipeline.STAGES:
        d = pipeline.save(stage(spark, d, SF))
        out.append((d.columns, [tuple(r) for r in d.collect()]))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "encoding"]
    assert all(c == ["doc_id", "text", "lang", "source", "n_chars"] for c, _ in stages[:5])
    assert [len(r) for _, r in stages] == sorted((len(r) for _, r in stages), reverse=True)


def test_quality_stage(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ({r[0] for r in stages[k][1]} for k in (0, 1))
    good = [i for i in before if labels.get(i) == 1]
    assert sum(i in after for i in good) >= 0.95 * len(good)


def test_line_stage(stages):
    before, after = stages[1][1], {r[0]: r[1] for r in stages[2][1]}
    gone = brute_lines(before)
    for r in before:
        lost = set(gone.get((r[0], r[1] or ""), []))
        text = "\n".join(x for i, x in enumerate((r[1] or "").split("\n")) if i not in lost)
        assert after.get(r[0]) == (text if not lost or text.split() else None)


def test_near_duplicate_stage(stages):
    before, after = stages[2][1], {r[0] for r in stages[3][1]}
    assert after == {i for i, (_, c) in brute_components(before, 5, 80).items() if i == c}


def test_decontamination_stage(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = stages[3][1], {r[0] for r in stages[4][1]}
    for r in before:
        if any(x in (r[1] or "") for x in items):
            assert r[0] not in after
    assert len(after) >= 0.9 * len(before)


def test_encoding_stage(stages):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r[0]: r for r in stages[5][1]}
    for r in stages[4][1]:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        assert got[r[0]][1:3] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_stages_on_odd_tables(spark):
    odd = docs(spark).drop("items", "score", "row").withColumnRenamed("source", "source")
    for d in (odd, odd.limit(0)):
        for k, (_, stage) in enumerate(pipeline.STAGES):
            d = pipeline.save(stage(spark, d, SF))
            assert k == 4 or d.columns == odd.columns


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) == {"op2_secrets", "op5_quality_rules", "op11_merkle_manifest", "op12_vector_dedup", "op13_spelling_variants"}
