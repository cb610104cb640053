"""The pipeline's stages on their own inputs."""

from __future__ import annotations

import corpus_pipeline
from rowsieve.llm.common import stored, table

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    names, sizes = [], [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF_DIR))
        names.append(name)
        sizes.append(after.count())
        if name != "packing":
            assert after.columns == docs.columns
        if name == "pii":
            assert after.filter("text rlike '[a-z]@[a-z0-9]+[.]'").count() == 0
        docs = after
    assert names == ["quality rules", "minhash near-dedup", "pii", "mixing", "packing"]
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] < sizes[4]
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0


def test_run_has_the_last_stages_rows(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF_DIR).columns[-2:] == ["sequence_id", "offset"]
