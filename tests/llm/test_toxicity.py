import random
import time

from llm_data import docs  # noqa: F401
from strainwise.llm import toxicity as tx


def test_folding_of_lookalikes_and_digits():
    assert tx.fold("1D10T") == tx.fold("idiot")
    assert tx.fold("mоrоn") == tx.fold("moron")  # Cyrillic o
    assert tx.fold("ｓｃｕｍ") == "scum"
    assert tx.fold("tr​ash") == "trash"


def test_hits_respect_word_starts_stems_and_exceptions():
    lexicon = tx.Lexicon({"trash": 2.0, "vequ*": 3.0}, ("trash can",))
    hits = lambda t: [w for _, _, w in lexicon.hits(tx.fold(t))]
    assert hits("Trash! vequlon, subvequ trashy") == [2.0, 3.0]
    assert hits("a trash can, a trash cans") == [2.0]
    assert hits("tr4sh") == [2.0]
    assert tx.Lexicon({}, ()).hits("x") == []


def test_score_falls_with_length():
    lexicon = tx.Lexicon({"trash": 2.0}, ())
    assert tx.features("trash " + "a " * 10, lexicon)[1] > tx.features("trash " + "a " * 1000, lexicon)[1]


def labelled(spark, docs):
    clean = [(i, f"plain words number {i} on some quiet topic {i % 7}") for i in range(200)]
    toxic = [(1000 + i, f"you {('idiot', 'm0ron')[i % 2]} number {i} on some quiet topic {i % 7}") for i in range(100)]
    other = [(5000, None), (5001, ""), (5002, "what an 1DIOT"), (None, "a quiet topic"), (5002, "again a quiet topic"),
             (5003, "word " * 50_000)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 0, 1) for i, _ in toxic]
                                   + [(5000, 1, None), (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    return docs(clean + toxic + other), labels


def test_held_out_documents_are_told_apart(spark, docs):
    df, labels = labelled(spark, docs)
    out = tx.toxicity(df, labels).collect()
    assert len(out) == df.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 5000]
    assert len(held) > 20
    assert all(r["predicted"] == int(r["doc_id"] >= 1000) for r in held)
    by = {r["doc_id"]: r["predicted"] for r in out}
    assert by[5000] == by[5001] == by[5003] == 0
    assert sorted(r["predicted"] for r in out if r["doc_id"] == 5002) == [0, 1]


def test_rejecting_keeps_columns_and_clean_rows(spark, docs):
    df, labels = labelled(spark, docs)
    out = tx.reject_toxic(df, labels)
    assert out.columns == df.columns and out.schema == df.schema
    assert sorted(r["doc_id"] for r in out.where("doc_id < 5000").collect()) == list(range(200))


def test_no_labels_and_no_rows(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in tx.toxicity(docs([(1, "idiot")]), labels).collect()] == [0]
    assert tx.toxicity(docs([]), labels).collect() == []


def plain_hits(weights, exceptions, text):
    """Every listed pattern tried at every word start; every phrase tried at every place."""
    def starts(i):
        return not (i and text[i - 1].isalpha())

    def ends(i):
        return i == len(text) or not text[i].isalpha()

    spared = [(i, i + len(p)) for p in map(tx.fold, exceptions) for i in range(len(text))
              if text.startswith(p, i) and starts(i) and ends(i + len(p))]
    out = []
    for i in range(len(text)):
        best = None
        for pattern, weight in weights.items():
            key = pattern.rstrip("*")
            if text.startswith(key, i) and starts(i) and (pattern.endswith("*") or ends(i + len(key))):
                if best is None or (-weight, len(key)) < best:
                    best = (-weight, len(key))
        if best and not any(a <= i and i + best[1] <= b for a, b in spared):
            out.append((i, i + best[1], -best[0]))
    return out


def test_hits_equal_trying_everything_on_random_texts():
    rng = random.Random(5)
    look = {v: [k for k, x in (tx.HOMOGLYPHS | tx.DIGITS).items() if x == v] for v in set(tx.HOMOGLYPHS.values())}
    words = ["scum", "trash", "trashy", "tra", "can", "bin", "moron", "clown", "fish", "idiot", "proof", "a"]
    for _ in range(300):
        weights = {tx.fold(w): round(rng.uniform(0.5, 3), 3) for w in rng.sample(words, 4)} | {
            tx.fold(rng.choice(words)) + "*": round(rng.uniform(0.5, 3), 3) for _ in range(3)}
        exceptions = [" ".join(rng.sample(words, 2)) for _ in range(4)] + list(tx.EXCEPTIONS)
        said = []
        for _ in range(rng.randint(0, 40)):
            word = "".join(rng.choice(look.get(c) or [c]) if rng.random() < 0.2 else c.upper() if rng.random() < 0.1 else c
                           for c in rng.choice(words))
            said.append(word + rng.choice([" ", " ", " ", ", ", "", ". ", "​ "]))
        text = tx.fold("".join(said))
        assert tx.Lexicon(weights, exceptions).hits(text) == plain_hits(weights, exceptions, text)


def test_many_exceptions_in_one_text_stay_linear():
    lexicon = tx.Lexicon({"trash": 2.0}, ("trash can",))
    text = tx.fold("a trash can, " * 100_000 + "trash")
    start = time.process_time()
    assert len(lexicon.hits(text)) == 1
    assert time.process_time() - start < 20  # the square of the phrases would take hours
