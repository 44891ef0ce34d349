"""The pipeline on the smallest tables, against plain versions of its decisions."""

import re
from pathlib import Path

import numpy as np
import pytest

from test_nearcopies import least_of_groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def holds(text, item, most):
    """Whether ``item`` is in ``text`` with ``most`` edits or fewer: the plain dynamic programme, a row for each of its characters,
    over all places of the text at once."""
    if most == 0:
        return re.search(rf"(?<![^\W_]){re.escape(item)}(?![^\W_])", text) is not None
    t = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, np.int64)
    for ch in item:
        new = np.r_[row[0] + 1, np.minimum(row[:-1] + (t != ord(ch)), row[1:] + 1)]
        row = np.minimum.accumulate(new - at) + at  # characters of the text that the item lacks
        if row.min() > most:
            return False
    return bool(row.min() <= most)


def test_pipeline(spark):
    import sentencepiece

    from corpusloom.llm import decontaminate, pii, quality
    from corpusloom.llm.queries import SURROGATE_KEY, piece_model

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in quality.measure(docs).where("kept").select("doc_id").collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    least = least_of_groups(list(text.items()))  # all pairs compared plainly
    assert set(least.values()) == {1}
    kept = set(least)
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i for i in kept if not any(holds(decontaminate.normal(text[i]), x, len(x) // decontaminate.CHARS_PER_ERROR) for x in items if x)}
    rows = docs.where(docs.doc_id.isin(sorted(kept)))
    private = {r["doc_id"]: r["text"] for r in pii.replace(rows, SURROGATE_KEY).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    got = {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == kept and len(kept) > 50
    assert all(got[i] == (sp.encode(private[i]), sp.decode(sp.encode(private[i]))) for i in kept)
