"""Columns whose names an operator might use itself are carried untouched; more languages than a byte tells apart."""

import numpy as np
import pytest

from quern.llm.exact_dedup import drop_exact_copies
from quern.llm.language_id import BUCKETS, SCRIPTS, LanguageModel
from quern.llm.minhash import drop_near_duplicates
from tests.llm import data

ODD = ["_s", "_k", "_i", "_t", "h", "uid2", "near_id", "keep_id", "maybe_copy", "component"]


@pytest.mark.parametrize("drop", [drop_exact_copies, drop_near_duplicates])
def test_clashing_names(spark, drop):
    rows = [(i, data.sentence(__import__("random").Random(i % 4), "en", 30), "en", "s", *range(len(ODD))) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in ODD))
    out = drop(df)
    assert out.columns == df.columns and out.count() == 4
    assert all(tuple(r)[4:] == tuple(range(len(ODD))) for r in out.collect())


def test_viterbi_of_many_languages_by_brute_force():
    """Every path of short texts is tried; there are more languages than a byte has values."""
    import itertools

    rng = np.random.default_rng(2)
    scripts = len(dict.fromkeys(n for n, _, _ in SCRIPTS)) + 1
    for langs, words in ((3, 6), (300, 2)):
        model = LanguageModel([str(i) for i in range(langs)], np.zeros((langs, 1), np.float32), np.ones((langs, scripts), bool), switch=1.0)
        scores = rng.standard_normal((langs, words)).astype(np.float32) * 2
        got = model.viterbi(scores, np.array([words]))
        best = max(itertools.product(range(langs), repeat=words), key=lambda p: sum(scores[s, i] for i, s in enumerate(p)) - sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(got.tolist()) == best
    assert BUCKETS & (BUCKETS - 1) == 0
