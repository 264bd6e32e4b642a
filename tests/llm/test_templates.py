"""Decontamination of benchmark items that share a long template."""

from __future__ import annotations

import numpy as np
import pytest
from test_pairs import expected_leaks, frame, words

from pagelattice.llm import decontaminate


def test_items_that_share_a_long_template(spark):
    rng = np.random.default_rng(41)
    template = " ".join(words(rng, 300, 10**6))
    own = [" ".join(words(rng, 40, 10**6)) for _ in range(60)]
    items = [(i, f"{template} {x}" if i % 2 else f"{x} {template}") for i, x in enumerate(own)]
    # Each document begins or ends with an item's own question, so the window is cut off.
    docs = [(i, f"{x} {' '.join(words(rng, 30, 10**6))}" if i % 2 else f"{' '.join(words(rng, 30, 10**6))} {x}") for i, x in enumerate(own)]
    want = expected_leaks(items, docs, decontaminate.Settings())
    found = decontaminate.contaminated(frame(spark, docs, False), spark.createDataFrame(items, "item_id long, text string"))
    assert len(want) >= 30
    assert {(r.doc_id, r.item_id): (r.start_word, pytest.approx(r.similarity, abs=2e-9)) for r in found.collect()} == want
