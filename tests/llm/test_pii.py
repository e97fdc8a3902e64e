import hashlib
import re

import numpy as np
import pytest

from llm_data import docs  # noqa: F401
from strainwise.llm import pii


def plain(text):
    """Base spans by the patterns as they are written."""
    out = []
    rules = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, rule in enumerate(rules):
        for m in re.finditer(rule, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if k == 1 and any(len(p.lstrip("0")) > 3 or int(p) > 255 for p in m[0].split(".")):
                continue
            if k == 2 and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if k == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((k, *m.span()))
    return out


CARD = "4111 1111-1111 1111"
TEXTS = ["a@b.co x.y@z-1.org.uk, bad@host @x.y a@@b.c a@b.c@d.e", "1.2.3.4 1.2.3.4.5 999.1.1.1 01.02.03.004 1.2.3 1.2.3.4.5.6.7.8",
         f"card {CARD} and 4111111111111112, 1 2 3 4", "+1 (555) 010-9999 +1 +49.30.1234567 ++44 20 7946 0958 +1234567890123456",
         "", "é@x.y ü+49 30 1234567", "7" * 5000 + ".1.1.1", "a" * 3000 + "@", "+1" + "(" * 3000, "1.1.1.1" + CARD]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text)[0] == plain(text)


def test_base_spans_on_random_texts():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(rng.choice(list("ab1234.@+- ()_9%0"), rng.integers(0, 40)))
        assert pii.base_spans(text)[0] == plain(text), text


def test_gradients_equal_differences():
    tagger = pii.Tagger(3, seed=1)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    ids, tags = np.random.default_rng(0).integers(0, 128, (6, 4)).astype(np.uint8), np.random.default_rng(1).integers(0, 5, (6, 4))
    mask = np.ones((6, 4), bool)
    mask[4:, 1] = False
    loss, grads = tagger.gradients(ids, mask, tags)
    scale = mask.sum() / 4  # gradients are per window, the loss per character
    for name in ("out", "bias", "trans", "rec_f", "in_b"):
        where = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        step = 1e-2
        tagger.p[name][where] += step
        up = tagger.gradients(ids, mask, tags)[0]
        tagger.p[name][where] -= 2 * step
        down = tagger.gradients(ids, mask, tags)[0]
        tagger.p[name][where] += step
        assert (up - down) / (2 * step) * scale == pytest.approx(grads[name][where], rel=0.05, abs=1e-3), name


def test_decoding_equals_full_search():
    from itertools import product

    tagger = pii.Tagger(2, seed=5)
    rng = np.random.default_rng(5)
    for scale in (0.3, 2.0):
        scores = rng.normal(0, scale, (4, 5, 30)).astype(np.float32)
        scores[:, 0] += 1.5
        lengths = rng.integers(1, 5, 30)
        paths = tagger.decode(scores, lengths)
        s, trans = np.round(scores, 3), np.round(tagger.p["trans"], 3)
        value = lambda p, b: sum(s[t, k, b] for t, k in enumerate(p)) + sum(trans[i, j] for i, j in zip(p, p[1:]))
        for b, n in enumerate(lengths):
            best = max(value(p, b) for p in product(range(5), repeat=int(n)))
            assert value(tuple(paths[b]), b) == pytest.approx(best, abs=1e-4)


@pytest.fixture(scope="module")
def trained():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("aeinorst"), rng.integers(2, 9)))
    texts = []
    for i in range(400):
        kind = (f"{word()}.{word()}@{word()}.com", f"{i % 250}.12.{i % 99}.7", CARD, f"+1 (555) {100 + i}-{1000 + i}")[i % 4]
        texts.append(" ".join(word() for _ in range(12)) + f" {kind} " + " ".join(word() for _ in range(12)))
    tagger = pii.Tagger(8)
    losses = tagger.fit(*pii.training_windows(texts), steps=200, batch=64)
    return tagger, losses, texts


def test_training_learns_the_spans(trained):
    tagger, losses, texts = trained
    assert losses[-1] < 0.1 * losses[0]
    tags = pii.tag_texts(tagger, texts)
    right = sum((t[a:b] == k + 1).mean() > 0.8 for text, t in zip(texts, tags) for k, a, b in pii.base_spans(text)[0])
    assert right >= 0.95 * sum(len(pii.base_spans(t)[0]) for t in texts)


def test_found_spans_join_the_base_ones_and_clean_text_has_none(trained):
    tagger = trained[0]
    text = "notes in rain senator.tin (at) stone.com on site and a@b.co"
    base, spans = pii.all_spans(text, pii.tag_texts(tagger, [text])[0])
    assert [text[a:b] for _, a, b in base] == ["a@b.co"] and set(base) <= set(spans)
    clean = "stories in 1999 and 2024 at the inn, 12 rooms, version 2.0.1 " * 40
    assert pii.all_spans(clean, pii.tag_texts(tagger, [clean])[0]) == ([], [])


HELD = {0: ["anna92 (at) mail.com", "tess.44 at inn dot org"],
        1: ["192 dot 168 dot 1 dot 10", "1 . 2 . 3 . 4", "1[.]2[.]3[.]4"],
        2: ["4111.1111.1111.1111", "4111 / 1111 / 1111 / 1111", "4111_1111_1111_1111"], 3: ["tel 555/010/9999", "00555_010_9999"]}


def by_hand(kind, inner, cut=0):
    text = f"rain on {inner} stone"
    tags = np.zeros(len(text), np.int8)
    tags[8 + cut:8 + len(inner) - cut] = kind + 1
    return pii.all_spans(text, tags)[1]


@pytest.mark.parametrize("kind, inner", [(k, x) for k, xs in HELD.items() for x in xs])
def test_a_found_span_stands_beside_shorter_failed_matches(kind, inner):
    assert by_hand(kind, inner) == [(kind, 8, 8 + len(inner))]


def test_a_found_span_that_fails_as_its_kind_is_dropped():
    for kind, inner in ((2, "4111111111111112"), (2, "4111.1111.1111.1112"), (1, "999.1.1.1"), (1, "999 dot 1 dot 1 dot 1"),
                        (1, "1 . 2 . 3"), (3, "tel 555/01"), (3, "555/010/9999/5550/1099"), (2, "1234.5678")):
        assert by_hand(kind, inner) == [], inner
    assert by_hand(2, "4111.1111.1111.1111", cut=1) == [(2, 8, 27)]  # a number is never masked in part
    assert by_hand(3, "4111 1111-1111 1111") == [(2, 8, 27)]  # base spans come first


def test_each_kind_is_added_in_held_out_texts(trained):
    rng = np.random.default_rng(9)
    plain = {0: "torin.sea57@stonert.com", 1: "31.12.45.7", 2: CARD, 3: "+1 (555) 713-4821"}
    for kind, span in plain.items():
        texts = [f"stone in the rain at sea {pii._respell(kind, span, rng)} tins on rent in stores" for _ in range(20)]
        spans = [pii.all_spans(t, g)[1] for t, g in zip(texts, pii.tag_texts(trained[0], texts))]
        assert sum(any(k == kind for k, _, _ in s) for s in spans) >= 10, pii.KINDS[kind]


def test_marks_never_trained_are_found(trained):
    """Numbers apart by signs that no training window holds."""
    signs = ("~", "^", ";")
    assert not any(sign in mark for marks in pii.MARKS.values() for mark in marks for sign in signs)
    plain = {1: "31.12.45.7", 2: "4111.1111.1111.1111", 3: "00555.713.4821"}
    for kind, span in plain.items():
        texts = [f"stone in the rain {w} {span.replace('.', sign)} tins on rent" for sign in signs for w in ("at sea", "nor oats", "one", "so")]
        spans = [pii.all_spans(t, g)[1] for t, g in zip(texts, pii.tag_texts(trained[0], texts))]
        assert sum(any(k == kind for k, _, _ in s) for s in spans) >= 9, pii.KINDS[kind]


def test_skipped_windows_change_nothing(trained, monkeypatch):
    tagger, _, texts = trained
    long = [" ".join(texts[i:i + 9]).replace("@", " (at) ") + " stone" * 200 for i in range(0, 90, 9)]
    quick = [pii.all_spans(t, g) for t, g in zip(long, pii.tag_texts(tagger, long))]
    monkeypatch.setattr(pii, "_promising", lambda t, c, starts, w: [True] * len(starts))
    assert quick == [pii.all_spans(t, g) for t, g in zip(long, pii.tag_texts(tagger, long))]


SMALL = {"steps": 3, "max_docs": 50}


def test_frames(docs):
    pairs = list(enumerate([None, *TEXTS, TEXTS[0]]))
    out = {r["doc_id"]: r for r in pii.find_pii(docs(pairs), **SMALL).collect()}
    for i, text in pairs:
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in plain(text or ""))
        assert out[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert out[i]["n_email"] == sum(k == 0 for k, _, _ in plain(text or ""))
        assert set(told.split(",")) <= set(out[i]["spans"].split(",")) | {""}
    assert pii.find_pii(docs([]), **SMALL).collect() == []


def test_masking_keeps_columns(docs):
    df = docs([(1, "mail a@b.co now"), (2, None), (3, "no data"), (4, "ip 1.2.3.4")])
    out = pii.mask_pii(df, **SMALL)
    assert out.columns == df.columns
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == ["mail [EMAIL] now", None, "no data", "ip [IP]"]
    assert pii.mask_spans("0123456789", [(0, 2, 6), (1, 4, 8), (2, 9, 10)]) == "01[EMAIL]8[CARD]"
