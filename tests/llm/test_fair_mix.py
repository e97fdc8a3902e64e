"""The mix against a plain simulation, and its edge cases."""

import hashlib
import random

from pyspark.sql import functions as F

from strainwise.llm import fair_mix as fm


def targets(sizes, share=1.5, repeats=2, weights=(3, 1, 2)):
    """Hand out by weight; whatever is over a source's limit goes round again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, rest = {}, list(order), share * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > repeats * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in free}
        for s in full:
            out[s] = repeats * sizes[s]
            rest -= out[s]
            free.remove(s)
    return out


def simulate(rows, packet=256, repeats=2, share=1.5):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    goal, queue = targets(sizes, share, repeats), []
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    for source in sizes:
        own = sorted((hashlib.md5(":".join(str(x) for x in (i, t) if x is not None).encode()).hexdigest(), k)
                     for k, (i, t, s) in enumerate(rows) if s == source)
        upto = 0
        for _ in range(repeats):
            for _, k in own:
                left = len((rows[k][1] or "").split())
                while left > 0:
                    words = min(packet, left)
                    upto, left = upto + words, left - words
                    queue.append((upto / goal[source], names.index(source), upto, words, k))
    taken, total = [0] * len(rows), 0
    for *_, words, k in sorted(queue):
        total += words
        if total > share * sum(sizes.values()):
            break
        taken[k] += words
    return goal, taken


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2.0, "y") for i, t, s in rows],
                                 "doc_id long, text string, source string, row string, rank int, target double, finish string")


def test_mix_equals_a_simulation(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([1, 5, 40, 700]))), rng.choice("aaaaabcé"))
            for i in range(120)]
    rows += [(200, None, "a"), (201, "", "b"), (202, " \n ", None), (203, "one", None), (None, "two words", "c"),
             (7, "again " * 20, "d"), (7, "again " * 20, "d"), (204, "long " * 9000, "tiny")]
    goal, taken = simulate(rows)
    for part_rows in (10 ** 6, 15):
        mix = fm.fair_mix(rows_of(spark, rows), part_rows=part_rows)
        got = mix.documents.collect()
        key = lambda r: tuple((x is None, x or 0) for x in r)
        want = [(i, len((t or "").split()), round(goal[s], 6), n) for (i, t, s), n in zip(rows, taken)]
        assert sorted(((r["id"], r["size"], round(r["target"], 6), r["taken"]) for r in got), key=key) == sorted(want, key=key)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
        assert mix.queue.agg({"words": "sum"}).first()[0] == sum(taken)


def test_sources_come_near_their_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([10, 300, 3000]), "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(600)]
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    goal = targets(sizes)
    taken = {r["source"]: r["n"] for r in fm.fair_mix(rows_of(spark, rows)).queue.groupBy("source").agg(F.sum("words").alias("n")).collect()}
    # at the cut every source waits inside one packet
    slack = len(goal) * 256 / sum(goal.values())
    assert all(abs(taken[s] - goal[s]) <= 256 + slack * goal[s] for s in goal)


def test_queue_is_in_order(spark):
    rows = [(i, "w " * (i + 1), "ab"[i % 2]) for i in range(40)]
    mix = fm.fair_mix(rows_of(spark, rows), packet=8, part_rows=50)
    ends = [[r["finish"] for r in part] for part in mix.queue.rdd.glom().collect() if part]
    spans = sorted((min(p), max(p)) for p in ends)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))  # range partitions
    assert mix.queue.columns == ["id", "source", "turn", "words", "finish"]


def test_empty_and_blank_tables(spark):
    assert fm.fair_mix(rows_of(spark, [])).documents.count() == 0
    got = fm.fair_mix(rows_of(spark, [(1, None, None), (2, " ", "a")])).documents.collect()
    assert sorted((r["id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    one = fm.fair_mix(rows_of(spark, [(1, "a b c d", "s")])).documents.first()
    assert (one["target"], one["taken"]) == (6.0, 4)


def test_enough_budget_takes_everything(spark):
    rows = [(i, "w " * (i + 1), "abc"[i % 3]) for i in range(9)]
    got = fm.fair_mix(rows_of(spark, rows), share=2.0).documents.collect()
    assert all(r["taken"] == 2 * r["size"] for r in got)
