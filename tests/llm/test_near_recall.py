"""Near dedup at the limits of op4 and of the pipeline, against brute force."""

import corpus_pipeline
import numpy as np

from curul.llm import near_dedup


def test_bands_and_signatures_follow_the_limit():
    assert near_dedup.banding(85) == (21, 6) and near_dedup.agreement(126, 85) == 91
    assert near_dedup.banding(80) == (25, 5) and near_dedup.agreement(125, 80) == 82


def test_pipeline_stage_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows, kept, near = [], set(), 0
    for i in range(120):
        # Words changed far apart: five of 196 shingles each, so four give a similarity of 0.81 and five 0.78.
        words = [f"w{rng.integers(10**6)}" for _ in range(200)]
        changed = [f"x{i}" if at in range(20, 20 + 40 * (i % 6 - 1) + 1, 40) and i % 6 else w for at, w in enumerate(words)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
        x, y = ({tuple(t[k : k + 5]) for k in range(196)} for t in (words, changed))
        share = len(x & y) / len(x | y)
        near += 0.8 <= share < 0.85
        kept |= {2 * i} if share >= 0.8 else {2 * i, 2 * i + 1}
    assert near == 20 and len(kept) == 140
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()} == kept
