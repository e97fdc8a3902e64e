from llm_data import docs  # noqa: F401
import corpus_pipeline as cp
from strainwise.llm.common import stored

import test_ngram_join as tn


def corpus(spark, docs):
    word = [f"w{i}" for i in range(400)]
    text = lambda k, n=60: " ".join(word[(k * 31 + j * 7) % 400] for j in range(n))
    pairs = [(i, text(i)) for i in range(60)]
    pairs += [(100 + i, text(i).replace(" ", "  ")) for i in range(5)]  # exact copies
    pairs += [(200 + i, text(i + 10) + " tail") for i in range(5)]  # near copies
    pairs += [(300 + i, text(i + 20, 40) + f" you idiot {i}") for i in range(40)]
    pairs += [(400, "write to a.b@c.org please " + " ".join(f"q{j}" for j in range(60))), (401, None), (402, ""), (None, " ".join(f"r{j}" for j in range(60))),
              (3, " ".join(f"s{j}" for j in range(60)))]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(300 + i, 1, 1) for i in range(40)],
                                   "doc_id long, quality int, toxic int")
    return docs(pairs), labels


def test_stages_one_by_one(spark, docs, tmp_path):
    df, labels = corpus(spark, docs)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    folder = str(tmp_path)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "pii", "best_fit"]
    now, seen = df, []
    for name, stage in cp.STAGES:
        now = stored(stage(spark, now, folder))
        seen.append(now)
        if name != "best_fit":
            assert now.columns == df.columns
    clean, exact, near, masked, packed = seen
    ids = lambda d: sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in d.select("doc_id").collect())
    assert ids(clean) == sorted([*range(60), *range(100, 105), *range(200, 205), 400, 401, 402, -1, 3])
    # 401 is null and 402 empty: equal; copies go, repeated ids with other texts stay
    assert ids(exact) == sorted([*range(60), *range(200, 205), 400, 401, -1, 3])
    pairs = [(k, r["text"]) for k, r in enumerate(exact.collect())]
    want = tn.brute(pairs)
    assert len(ids(near)) == sum(i == c for i, (_, c) in want.items())
    assert not set(range(200, 205)) & set(ids(near))
    texts = {r["doc_id"]: r for r in masked.collect()}
    assert texts[400]["text"].startswith("write to [EMAIL] please")
    assert texts[400]["n_chars"] == len(texts[400]["text"])
    assert sorted(set(ids(packed))) == sorted(set(ids(masked)))
    assert sum(r["length"] for r in packed.collect()) == sum(len((r["text"] or "").split()) for r in masked.collect())
    whole = cp.run(spark, folder)
    assert sorted(map(tuple, whole.select("doc_id", "length").collect()), key=str) == sorted(
        map(tuple, packed.select("doc_id", "length").collect()), key=str)


def test_empty_tables(spark, docs, tmp_path):
    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []
