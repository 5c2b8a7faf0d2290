"""The pipeline's stages against brute force, one after another, and all of them on the smallest tables."""

import corpus_pipeline
from tests.llm import data
from tests.llm.test_operators import FOLD, components


def test_stages_on_awkward_rows(spark, sf):
    from quern.llm.common import materialize

    docs = materialize(data.frame(spark), "docs")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = materialize(stage(spark, docs, sf), name)
        after = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "language_id":
            assert len(after) == sum(any(c.isalpha() for c in t or "") for _, t in before)
        elif name == "exact_dedup":
            assert len(after) == len({(t or "").translate(FOLD) for _, t in before})
        elif name == "near_dedup":
            assert len(after) == len(set(components(before, 80, 100)[0])) and set(after) <= set(before)
        else:
            assert len(after) == len(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in after}


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
