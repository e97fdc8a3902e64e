import random

import numpy as np
import pyarrow as pa

from llm_data import docs  # noqa: F401
from strainwise.llm import ngram_join as nj, shingles


def sets(pairs):
    out = {}
    for i, t in pairs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = low.encode().split()
        out[i] = {b" ".join(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({b" ".join(w)} if w else set())
    return out


def brute(pairs):
    s = sets(pairs)
    label = {i: i for i in s}
    changed = True
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b]
             and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(s[i]), label[i]) for i in s}


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 5)))
    passage = [word() for _ in range(40)]
    base = [[word() for _ in range(rng.randrange(1, 120))] for _ in range(12)]
    pairs = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = w[:rng.randrange(20)] + passage + w[:rng.randrange(10)]
        pairs.append((i, rng.choice((" ", "\n", "  ")).join(w).upper() if rng.random() < 0.3 else " ".join(w)))
    return pairs + [(900, None), (901, ""), (902, " \t"), (903, "a b"), (904, "A  b"), (905, "é b c d e f"), (906, "w " * 30_000)]


def test_components_equal_brute_force(docs, monkeypatch):
    monkeypatch.setattr(nj, "WINDOW", 500)
    pairs = corpus(1)
    out = nj.ngram_classes(docs(pairs).repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(pairs)


def test_crowds_cut_into_many_blocks_and_units(docs, monkeypatch):
    monkeypatch.setattr(nj, "CROWD", 3)
    monkeypatch.setattr(nj, "UNIT_ROWS", 20)
    monkeypatch.setattr(nj, "_crowds", lambda docs, runs, groups, vertices, links, known, *a: (links, known))
    pairs = corpus(11, 150)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.ngram_classes(docs(pairs)).collect()}
    assert got == brute(pairs)


def test_met_pairs_miss_none_that_is_similar(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2 ** 63, 60).astype(np.uint64)
    sets_ = []
    for _ in range(120):
        kept = base[rng.random(60) > rng.choice([0.03, 0.1, 0.3])]
        sets_.append(np.unique(np.concatenate([kept, rng.integers(0, 2 ** 63, rng.integers(0, 9)).astype(np.uint64)])))
    rows = [(k, i, len(x), p, i % 50, i % 50, 0, 0, 0, nj._bitmap(x) if i % 7 else None)
            for i, x in enumerate(sets_) for p, k in enumerate(x[:20].astype(np.int64).tolist())]
    names = ["key", "grp", "n", "pos", "lo", "hi", "one", "two", "own", "bits"]
    out = nj._meet(80)(pa.table([list(c) for c in zip(*rows)], names=names)).to_pydict()
    got = {(a, b): c for a, b, c in zip(out["g"], out["h"], out["c"])}
    assert len(got) == len(out["g"]) and all(a < b for a, b in got)
    wanted, possible = 0, 0
    for a in range(120):
        for b in range(a + 1, 120):
            x, y = set(sets_[a].tolist()), set(sets_[b].tolist())
            shared = len(set(sets_[a][:20].tolist()) & set(sets_[b][:20].tolist()))
            if a % 50 == b % 50:
                assert (a, b) not in got
            elif shared:
                possible += 1
                if 100 * len(x & y) >= 80 * len(x | y):
                    wanted += 1
                    assert got[a, b] == shared
    assert wanted > 50 and len(got) < 0.9 * possible  # the bitmaps reject


def test_frequent_shingles_change_the_order_not_the_result(docs, monkeypatch):
    pairs = corpus(3)
    plain = nj.frequent_shingles
    monkeypatch.setattr(nj, "frequent_shingles", lambda rows, bits, words: plain(rows, bits, words, least=3))
    out = nj.ngram_classes(docs(pairs)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(pairs)


def test_repeated_and_null_ids(docs):
    out = nj.ngram_classes(docs([(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (None, "a b c d e f"), (None, "z")]))
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in out.collect())
    assert got == [(0, 1, 0), (0, 2, 1), (1, 2, 1), (1, 2, 1), (1, 2, 1)]


def test_a_near_copy_without_an_id_bridges_two_documents(docs):
    one = [f"w{i}" for i in range(200)]
    mid, two = [*one[:-20], *(f"x{i}" for i in range(20))], [*(f"y{i}" for i in range(20)), *one[20:-20], *(f"x{i}" for i in range(20))]
    assert [len(a & b) / len(a | b) >= 0.8 for a, b in ((sets_of(one), sets_of(mid)), (sets_of(mid), sets_of(two)),
                                                        (sets_of(one), sets_of(two)))] == [True, True, False]
    # an id that is given to two texts must not fetch the other text
    pairs = [(3, " ".join(one)), (None, " ".join(mid)), (7, " ".join(two)), (7, "q r s t u v"), (9, "z")]
    out = nj.ngram_classes(docs(pairs)).collect()
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in out)
    assert got == [(0, 196, 3), (3, 196, 3), (7, 2, 7), (7, 196, 3), (9, 1, 9)]


def sets_of(ws):
    return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)}


def test_empty_table(docs):
    assert nj.ngram_classes(docs([])).collect() == []


def test_vectorised_sets_equal_plain_ones():
    pairs = corpus(5)
    got = shingles.shingle_sets([(t or "").encode() for _, t in pairs])
    plain = sets(pairs)
    assert [len(g) for g in got] == [len(plain[i]) for i, _ in pairs]
    for (i, _), g in zip(pairs, got):
        for (j, _), h in zip(pairs, got):
            if i < j < 60:
                assert len(set(g.tolist()) & set(h.tolist())) == len(plain[i] & plain[j])


def test_prefix_size_cannot_miss_a_partner():
    for n in range(1, 200):
        assert n - nj.prefix_size(n, 80) + 1 == -(-80 * n // 100)
