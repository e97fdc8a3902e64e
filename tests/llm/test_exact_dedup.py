import hashlib

from llm_data import docs  # noqa: F401
from strainwise.llm import exact_dedup as ed


def brute(pairs):
    import re

    squeezed = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in pairs]
    return {i: (min(j for (j, _), u in zip(pairs, squeezed) if u == t), squeezed.count(t),
                hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(pairs, squeezed)}


def found(df):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()}


PAIRS = [(1, "a  b"), (2, "a\tb"), (3, " a b"), (4, None), (5, ""), (6, "\n\n"), (7, "a b"), (8, "x" * 300_000),
         (9, "x" * 300_000), (10, "a b "), (11, " \v"), (12, "é b"), (13, "a b")]


def test_equals_brute_force_with_any_window_and_bucket(docs):
    df = docs(PAIRS)
    for settings in ({}, {"window_rows": 2}, {"window_bytes": 5, "bucket_bytes": 3}):
        out = ed.exact_dedup(df, **settings)
        assert found(out) == brute(PAIRS)
        assert {r["doc_id"] for r in out.where("kept").collect()} == {v[0] for v in brute(PAIRS).values()}


def test_repeated_and_null_ids_keep_one_row(docs):
    out = ed.exact_dedup(docs([(1, "t"), (1, "t"), (None, "t"), (None, "u")])).collect()
    assert len(out) == 4
    assert sum(r["kept"] for r in out) == 2
    assert {r["keep_id"] for r in out if r["group_size"] == 3} == {1}


def test_empty_table(docs):
    assert ed.exact_dedup(docs([])).collect() == []


def test_hot_text_is_collapsed_before_the_shuffle(docs):
    pairs = [(i, "hot" if i % 3 else f"t{i}") for i in range(600)]
    assert found(ed.exact_dedup(docs(pairs).repartition(5), window_rows=50)) == brute(pairs)


def test_table_compares_contents_not_only_hashes():
    table = ed.ContentTable()
    assert [table.place(5, c) for c in (b"a", b"b", b"a", b"c", b"b")] == [0, 1, 0, 2, 1]
    assert [table.place(i * 64, str(i).encode()) for i in range(200)] == list(range(3, 203))
    assert table.place(5, b"c") == 2


def test_oversize_buckets_are_split_again(spark):
    rows = spark.createDataFrame([(i, 100) for i in range(400)], "hash long, bytes long")
    out = ed.bucketed(rows, 1000)
    assert max(r["count"] for r in out.groupBy("bucket").count().collect()) <= 40
    same = spark.createDataFrame([(7, 5000)] * 50, "hash long, bytes long")
    assert ed.bucketed(same, 1000).select("bucket").distinct().count() == 1
