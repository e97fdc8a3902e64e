from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_data import docs  # noqa: F401
from strainwise.llm import reshard as rs


def cheapest(supply, capacity, stay):
    """Fewest moved bytes: all that can stay does."""
    return sum(supply) - sum(min(s, capacity[j]) for s, j in zip(supply, stay) if j is not None)


def test_flow_moves_the_fewest_bytes():
    rng = np.random.default_rng(1)
    for n, m in product((1, 3, 5), (1, 4, 6)):
        supply = rng.integers(0, 100, n).tolist()
        capacity = np.full(m, -(-sum(supply) // m)).tolist()
        stay = [i if i < m else None for i in range(n)]
        flow = rs.min_cost_flow(supply, capacity, stay)
        assert [sum(r) for r in flow] == supply
        assert all(sum(c) <= k for c, k in zip(zip(*flow), capacity))
        moved = sum(b for i, r in enumerate(flow) for j, b in enumerate(r) if stay[i] != j)
        assert moved == cheapest(supply, capacity, stay)


def test_rows_sizes_and_slots(docs):
    pairs = [(i, "é" * (i % 17)) for i in range(400)] + [(1000, None), (1001, ""), (5, "x"), (None, "n")]
    old = F.when(F.coalesce("doc_id", F.lit(0)) % 3 == 0, 0).otherwise(F.coalesce("doc_id", F.lit(0)) % 5)
    out = rs.reshard(docs(pairs), old, 5, [1.0] * 4, block_rows=20).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out) == sorted((i or -1, t or "") for i, t in pairs)
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in out)
    total, longest = sum(r["size"] for r in out), max(r["size"] for r in out)
    for s in range(4):
        own = [r for r in out if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 4) <= 3 * longest


def test_balanced_shards_stay_where_they_are(docs):
    out = rs.reshard(docs([(i, "abcd") for i in range(40)]), F.col("doc_id") % 4, 4, [1.0] * 4)
    assert out.where("shard <> old_shard").count() == 0
    moved = rs.transfers(out).collect()
    assert {(r["old_shard"], r["shard"], r["rows"]) for r in moved} == {(k, k, 10) for k in range(4)}


def test_empty_table(docs):
    assert rs.reshard(docs([]), F.lit(0), 2, [1.0, 1.0]).collect() == []


def test_null_ids_and_long_texts_spread_over_blocks(docs):
    pairs = [(None, f"text {i}") for i in range(200)] + [(1, "é" * 200_000), (1, "é" * 200_000), (2, None), (2, None)]
    out = rs.reshard(docs(pairs), F.lit(0), 1, [1.0] * 3, block_rows=7).collect()
    assert len(out) == len(pairs)
    for s in range(3):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_texts_are_never_shuffled(docs, tmp_path):
    out = rs.reshard(docs([(i, "abcd" * i) for i in range(50)]), F.col("doc_id") % 4, 4, [1.0] * 3, folder=str(tmp_path / "new"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def files_of(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


@pytest.mark.parametrize("n_old,n_new", [(4, 6), (6, 4), (3, 3), (1, 5), (5, 1)])
def test_only_blocks_with_transfers_are_rewritten(spark, docs, tmp_path, n_old, n_new):
    # a hot shard; all rows weigh 8, so cuts fall on rows or half rows
    old = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % n_old)
    table = docs([(i, f"{i:07}") for i in range(960)]).repartition(5)
    kinds = rs.lay_out(table, old, str(tmp_path / "before"), block_rows=16)
    before = files_of(tmp_path / "before")
    supply = [0] * n_old
    for i in range(960):
        supply[0 if i % 3 == 0 else i % n_old] += 8
    out = rs.reshard_files(spark, str(tmp_path / "before"), kinds, n_old, [1.0] * n_new, str(tmp_path / "moved"))
    rows = out.collect()
    assert sorted(r["id"] for r in rows) == list(range(960)) and all(r["text"] == f"{r['id']:07}" for r in rows)
    for s in range(n_new):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    cuts = rs.transfer_cuts(supply, [1.0] * n_new)
    cost = sum(end - start for i, own in enumerate(cuts) for start, (end, j) in zip([0, *[e for e, _ in own]], own) if j != i)
    n_cuts = sum(len(own) for own in cuts)
    moved = sum(r["size"] for r in rows if r["old"] != r["shard"])
    assert abs(moved - cost) <= 8 * n_cuts
    # untouched files stay as they were; what is rewritten is what moved and the rest of the divided blocks
    assert files_of(tmp_path / "before") == before
    rewritten = spark.read.schema(out.schema).parquet(str(tmp_path / "moved"))
    assert moved <= 8 * rewritten.count() <= moved + 16 * 8 * n_cuts


def test_untouched_blocks_are_not_opened(spark, docs, tmp_path):
    table = docs([(i, "abc") for i in range(400)]).repartition(4)
    kinds = rs.lay_out(table, F.when(F.col("doc_id") < 300, 0).otherwise(1), str(tmp_path / "before"), block_rows=10)
    out = rs.reshard_files(spark, str(tmp_path / "before"), kinds, 2, [1.0, 1.0], str(tmp_path / "moved"))
    assert out.where("old = 1 and shard <> 1").count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stay = out.where("slot >= 0")
        stay.collect()
        leaves = stay._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.length()) if leaves.apply(i).metrics().contains("numFiles")]
        opened = {scan.toString(): scan.metrics().get("numFiles").get().value() for scan in scans}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = len(files_of(tmp_path / "before"))
    first = [n for name, n in opened.items() if "file_path" in name]  # the scan of the old folder
    # 100 of 400 rows leave shard 0, and their files with them
    assert len(first) == 1 and 0.6 * files < first[0] < 0.85 * files
