"""Ranked search against plain scoring, with many small shards and blocks; edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from strainwise.llm import search
from strainwise.llm.common import arrow_limits

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, keep=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, words, df = len(bags), sum(n for *_, n in bags), Counter(w for _, b, _ in bags for w in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag, n in bags:
            m = 50 + (50 * n * n_docs) // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10 ** 9 * bag[w]) // (1000 * bag[w] + 20 * m))
                        for w in set(terms(text)) if w in bag)
            if score > 0:
                scored.append((-score, i is None, i or 0, score))
        out += [(item, k + 1, None if null else i, s) for k, (_, null, i, s) in enumerate(sorted(scored)[:keep])]
    return out


def sort_key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.fixture()
def run(spark):
    arrow_limits(spark)

    def go(docs, items, parts=3, **options):
        d = spark.createDataFrame([(i, t, "a", 1, "b", "c") for i, t in docs],
                                  "doc_id long, text string, terms string, score int, id string, query string").repartition(parts)
        q = spark.createDataFrame([(i, t, "z", 3) for i, t in items], "item_id long, text string, doc_id string, rank int")
        out = search.ranked_search(search.build_index(d), q, **options)
        assert out.columns == ["item_id", "rank", "doc_id", "score"]
        return sorted((tuple(r) for r in out.collect()), key=sort_key)

    return go


def corpus(rng, n):
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "日本", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 10, 40, 300])))) for i in range(n)]


@pytest.mark.parametrize("keep", [1, 5, 50])
def test_equals_scoring_everything(run, monkeypatch, keep):
    monkeypatch.setattr(search, "SHARD_DOCS", 40)
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "FAN_IN", 2)
    rng = random.Random(keep)
    docs = corpus(rng, 300)
    docs += [(1000 + i, docs[7][1]) for i in range(70)]  # more ties than are kept
    docs += [(None, docs[9][1]), (5, docs[9][1]), (5, docs[9][1]), (900, None), (901, ""), (902, "?! ;"), (903, "W3-w3_W3")]
    items = [(i, " ".join(rng.choices([t for _, d in docs[:300] for t in terms(d)] + ["absent"], k=rng.choice([1, 4, 20])))) for i in range(20)]
    items += [(50, docs[7][1]), (51, docs[9][1]), (52, None), (53, "..."), (54, "unseen"), (55, "w3"), (55, "w3")]
    assert run(docs, items, keep=keep) == sorted(brute(docs, items, keep), key=sort_key)


def test_queries_in_several_passes(run):
    rng = random.Random(9)
    docs, items = corpus(rng, 60), [(i, f"w{i} w{i + 1} x1") for i in range(30)]
    assert run(docs, items, pass_terms=10) == sorted(brute(docs, items), key=sort_key)


def test_empty_tables(run):
    assert run([], [(1, "a")]) == [] and run([(1, "a")], []) == [] and run([(1, None)], [(1, "a")]) == []
    # a term that every document holds weighs nothing in a large collection, something in a tiny one
    assert run([(1, "a")], [(1, "A a")]) == brute([(1, "a")], [(1, "A a")])


def test_long_text(run):
    docs = [(1, "needle " + "hay " * 400_000), (2, "needle"), (3, "hay " * 70_000 + "needle " * 300)]
    items = [(1, "needle"), (2, "hay needle")]
    assert run(docs, items) == sorted(brute(docs, items), key=sort_key)


def test_blocks_are_rejected_unopened(monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 8)
    rng = np.random.default_rng(2)
    lengths = rng.integers(20, 60, 4000)
    # term 1 in most documents, term 2 in a few
    hashes = [np.concatenate([rng.integers(100, 10 ** 6, n - 2), [1, 2 if i % 500 == 0 else 1]]).astype(np.uint64) for i, n in enumerate(lengths)]
    arrays = search._build(np.arange(4000), np.zeros(4000, bool), lengths, np.concatenate(hashes))
    row = {name: np.ascontiguousarray(arrays[name], kind).tobytes() for name, kind in search.ARRAYS.items()}
    shard = search._Shard(row, 4000, int(lengths.sum()))
    lists, weights = np.searchsorted(shard.terms, np.array([1, 2], np.uint64)), np.array([20, 5000])
    everything, scores = shard.search(lists, weights, 0)
    floor = int(np.sort(scores)[-5])
    fresh, opened = search._Shard(row, 4000, int(lengths.sum())), []
    some = fresh.some
    fresh.some = lambda i, blocks: opened.append(len(blocks)) or some(i, blocks)
    found, best = fresh.search(lists, weights, floor)
    wanted = scores >= floor
    assert sorted(zip(found.tolist(), best.tolist())) == sorted(zip(everything[wanted].tolist(), scores[wanted].tolist()))
    assert int(lists[0]) not in fresh.open and sum(opened) <= 8 < fresh.blocks[lists[0] + 1] - fresh.blocks[lists[0]]
    none, _ = fresh.search(lists, weights, 10 ** 15)
    assert not len(none)
