import random

from llm_data import docs  # noqa: F401
from strainwise.llm import packing


def brute(items, capacity):
    """Best fit by looking at every bin."""
    pieces = []
    for row, length, source, cluster in items:
        start, k = 0, 0
        while length - start > capacity:
            pieces.append((-capacity, row, k, source, cluster))
            start, k = start + capacity, k + 1
        pieces.append((start - length, row, k, source, cluster))
    bins, out = [], {}
    for negative, row, k, source, cluster in sorted(pieces, key=lambda p: p[:3]):
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= max(1, -negative)
                and (source is None or source not in b[1]) and (cluster is None or cluster not in b[2])]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append([capacity, set(), set()])
        bins[i][0] += negative
        bins[i][1].add(source)
        bins[i][2].add(cluster)
        out[row, k] = i
    return out


def test_equals_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        items = [(i, rng.choice((0, 1, 5, 20, 33, 64, 65, 200)), rng.choice((None, "a", "b", "c", "d")),
                  rng.choice((None, 1, 2, 3, 4, 5, 6))) for i in range(rng.randrange(80))]
        got = {(row, piece): bin_ for row, piece, _, _, bin_, _ in packing.pack(items, 64)}
        assert got == brute(items, 64)


def test_bins_hold_no_conflict_and_no_word_is_lost(docs):
    pairs = [(i, " ".join(["w"] * (i * 7 % 90)) + f" t{i % 50}") for i in range(500)] + [(900, None), (901, ""), (3, "w w")]
    df = docs(pairs[:300], "s1").union(docs(pairs[300:], "s2"))
    out = packing.best_fit_pack(packing.items_of(df), capacity=64, group_rows=100).collect()
    words = {}
    for i, t in pairs:
        words[i] = words.get(i, 0) + len((t or "").split())
    got = {}
    bins = {}
    for r in out:
        got[r["id"]] = got.get(r["id"], 0) + r["length"]
        bins.setdefault(r["bin"], []).append(r)
    assert got == words
    for own in bins.values():
        assert sum(r["length"] for r in own) <= 64
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert len({r["source"] for r in own}) == len(own)


def test_empty_table(docs):
    assert packing.best_fit_pack(packing.items_of(docs([]))).collect() == []
