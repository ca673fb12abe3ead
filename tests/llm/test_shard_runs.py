"""Token shards are written in runs, and their rows are read without writing them again."""

from pathlib import Path

import pytest

pytest.importorskip("debitage.llm")

from debitage.llm import binout  # noqa: E402
from debitage.llm.queries import tokenizer_path  # noqa: E402


def test_each_run_shuffles_its_own_shards_and_rows_are_read_again(spark, tmp_path, monkeypatch):
    runs, write = [], binout.written

    def noted(df, at, mode):
        runs.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, at, mode)

    monkeypatch.setattr(binout, "written", noted)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i))) for i in range(60)], "doc_id long, text string")
    dealt = binout.ordered(docs, tokenizer_path(), str(tmp_path / "run"), window=16, shard=8)
    out = binout.materialised(dealt, str(tmp_path / "shards"))
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "shards").iterdir()}
    assert len(runs) == binout.WAVES > 1
    assert all("pmod" in plan[plan.index("RepartitionByExpression") :] for plan in runs if "RepartitionByExpression" in plan)  # other shards go before the shuffle
    rows = out.collect()
    assert sorted(r["slot"] for r in rows) == list(range(dealt.count())) and {Path(r["path"]) for r in rows} == set(files)
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "shards").iterdir()} == files
