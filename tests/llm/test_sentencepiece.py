import itertools
import os
import random

import pytest

from llm_data import docs  # noqa: F401
from strainwise.llm import sentencepiece_viterbi as sv

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sv.load_pieces(MODEL)


@pytest.fixture(scope="module")
def coder(model):
    return sv.Coder(model)


def best_sum(model, coder, text):
    """Best score by trying every piece at every position, without an automaton."""
    special = set(model["special"])
    score = {p: s for i, (p, s) in enumerate(zip(model["pieces"], model["scores"])) if i not in special}
    best = [0.0] + [float("-inf")] * len(text)
    for end, start in itertools.product(range(1, len(text) + 1), range(len(text))):
        if start < end and text[start:end] in score:
            best[end] = max(best[end], best[start] + score[text[start:end]])
        if start == end - 1 and text[start] not in score:
            best[end] = max(best[end], best[start] + coder.unknown_score)
    return best[-1]


def own_sum(model, coder, ids):
    total, raw = 0.0, 0
    text = b""
    for i in ids:
        if i in coder.byte_ids:
            text += bytes([coder.byte_ids[i]])
        else:
            total += model["scores"][i]
    return total + coder.unknown_score * len(text.decode())


TEXTS = ["the words", "", " ", "  two  spaces ", "a\tb\n\nc", "日本語 の", "🙂🙂 x🙂", "naïve café", "antidisestablishment",
         "x" * 400, "1,234.50 USD", "\u0000\u0001", "ﬁ Ω"]


def test_path_is_optimal(model, coder):
    rng = random.Random(2)
    words = ["".join(rng.choice("thearnisoß é▁9") for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    for text in TEXTS[:9] + words:
        ids = coder.encode(text)
        normal = "▁" + text.replace(" ", "▁") if text else ""
        assert own_sum(model, coder, ids) == best_sum(model, coder, normal), text


def test_words_solved_alone_equal_the_whole(model, coder):
    whole = sv.Coder(model)
    whole.by_word = False
    for text in TEXTS:
        assert whole.encode(text) == coder.encode(text), text


def test_round_trip(coder):
    for text in TEXTS:
        assert coder.decode(coder.encode(text)) == text
    assert coder.decode([1, *coder.encode("ab"), 2]) == "ab"
    with pytest.raises(ValueError):
        coder.decode([10**6])


def test_frames(docs):
    pairs = list(enumerate([None, *TEXTS, "the words"]))
    ids = sv.encode(docs(pairs), MODEL)
    back = {r["doc_id"]: r["text"] for r in sv.decode(ids, MODEL).collect()}
    assert back == {i: t or "" for i, t in pairs}
    told = sv.encode_digest(docs(pairs), MODEL).collect()
    assert all(r["round_trip"] for r in told) and len(told) == len(pairs)
    assert {r["doc_id"]: r["n_pieces"] for r in told} == {r["doc_id"]: len(r["ids"]) for r in ids.collect()}
    assert sv.encode_digest(docs([]), MODEL).collect() == []
