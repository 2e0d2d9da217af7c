"""The pipeline's stages one after the other, on small tables."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from test_linededup import plain as plain_lines
    from test_neardup import plain as plain_groups
    from test_decontaminate import plain as plain_leaks

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"score": F.lit(1), "_lost": F.lit("x"), "_gone": F.lit(2), "label": F.lit(None).cast("int")})
    columns = docs.columns
    seen = [[(r["doc_id"], r["text"]) for r in docs.collect()]]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "encoding":
            assert docs.columns == columns
            seen.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    raw, good, lines, groups, clean = seen
    assert 0 < len(good) < len(raw) and set(good) <= set(raw)
    want = {r[0]: r[2] for r in plain_lines(good)}
    assert {i for i, _ in lines} == {i for i, _ in good}
    before = dict(good)
    assert all(len(before[i].split("\n")) - want[i] == (len(t.split("\n")) if t or len(before[i].split("\n")) > want[i] else 0) for i, t in lines)
    assert {i for i, _ in groups} == {r[0] for r in plain_groups(lines) if r[3]}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {i for i, _ in clean} == {i for i, _ in groups} - {r[0] for r in plain_leaks(groups, items)}
    last = docs.collect()
    assert {r["doc_id"] for r in last} == {i for i, _ in clean} and all(r["round_trip"] for r in last)


def test_registered():
    import __spark_entry__ as entry_module

    names = entry_module.queries()
    assert "pipeline" in names
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")}
