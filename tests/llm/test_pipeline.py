"""The pipeline against a plain version, stage by stage."""

import math
import os
from collections import Counter

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import words
from test_dedup_ops import brute_classes, brute_removal, key, variants
from test_quality_ops import PlainModel, calibrating

from quarry.llm import queries, suffix
from quarry.llm.common import materialise


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    passage = words(70, 120)
    rows = [(i, words(100 + i, 60), "en") for i in range(30)]
    rows += [(40 + i, t, "en") for i, t in enumerate(variants(9, 4, 80))] + [(50, words(101, 60), "en"), (51, words(101, 60), "en")]
    rows += [(60 + i, words(300 + i, 40) + " " + passage + " " + words(400 + i, 40), "fr" if i else None) for i in range(3)]
    rows += [(70, "#$%&" * 60, "en"), (71, None, "en"), (72, "", None), (None, words(500, 30), "en")]
    out = tmp_path_factory.mktemp("pipeline")
    ids, texts, langs = zip(*rows, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts), "lang": pa.array(langs), "source": ["s"] * len(rows), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}), os.path.join(out, "documents.parquet"))
    pq.write_table(pa.table({"doc_id": pa.array(range(30), pa.int64()), "quality": pa.array([1] * 30, pa.int32()), "toxic": pa.array([0] * 30, pa.int32())}), os.path.join(out, "labels.parquet"))
    return str(out), rows


def test_stages(spark, folder):
    sf, rows = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left_out = calibrating(spark, range(30))
    model = PlainModel([t for i, t, _ in rows if i is not None and i < 30 and i not in left_out], 5)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialise(stage(spark, docs, sf), "stage")
        if number == 4:
            break
        assert out.columns == corpus_pipeline.DOCUMENTS
        now = [(r["doc_id"], r["text"], r["lang"]) for r in out.collect()]
        if number == 0:  # one language has trusted documents, the others take its threshold
            most = (math.floor(max(model.log_ppl(t) for i, t, _ in rows if i in left_out) / 0.002) + 1) * 0.002 + 0.2
            want = Counter((i, t) for i, t, _ in rows if not t or model.log_ppl(t) <= most)
            assert Counter((i, t) for i, t, _ in now) == want and (70, "#$%&" * 60) not in want
        elif number == 1:
            best = {}
            for i, t, _ in rows:
                best[t or ""] = max((i if i is not None else -1), best.get(t or "", -1))
            assert Counter((t or "", -1 if i is None else i) for i, t, _ in now) == Counter(best.items())
        elif number == 2:
            kept = Counter(i for i, name, _ in brute_classes(rows).elements() if i == name)
            assert Counter(i for i, _, _ in now) == kept
        else:
            want = Counter((i, n - gone) for i, n, gone, _, _ in brute_removal(rows, suffix.PASSAGE).elements())
            assert Counter((i, len(t.encode())) for i, t, _ in now) == want and sum(n for _, n in want) < sum(len((t or "").encode()) for _, t, _ in rows)
        docs, rows = out, now
    assert {key(r["doc_id"]) for r in out.collect()} == {i for i, _, _ in rows}


def test_run(spark, folder):
    sf, _ = folder
    got = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.where("doc_id = 70").count() == 0 and got.where("doc_id = 0").count() >= 1


def test_registered():
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{n}" for n in range(1, 14)} and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_one_near_copy_stays(spark):
    """Of near copies with one id or without ids one document stays."""
    texts = [*variants(9, 3, 80), *variants(10, 3, 80)]
    ids = [5, 5, 7, None, None, None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()]
    assert sorted(kept, key=str) == [5, None]
