"""Many small files are written by several tasks."""

import glob
import re


def test_documents_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from annomill.plans import tree_queries

    monkeypatch.setattr(tree_queries, "shared_dir", lambda spark, what: str(tmp_path / what))
    spark.range(40).selectExpr("id AS s_suppkey", "concat('n', id) AS s_name").write.parquet(str(tmp_path / "supplier.parquet"))
    assert tree_queries.src_documents(spark, str(tmp_path)).count() == 40
    files = glob.glob(f"{tmp_path}/documents/id=*/part-*")
    assert len(files) == 40 and len({re.search(r"part-(\d+)", f).group(1) for f in files}) > 1
