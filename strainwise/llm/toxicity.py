"""Toxicity score: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length."""

import re
from collections import Counter, defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import only, records, stored

# Look-alike letters and the Latin letter each one stands for.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x",
    "у": "y", "ё": "e", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ı": "i", "ɑ": "a", "ɡ": "g", "ſ": "s",
}
# Digits used for letters. One and l both become i, so that either reading matches.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
# Phrases in which a listed word is harmless.
EXCEPTIONS = ("clown fish", "idiot proof", "pathetic fallacy", "sore loser", "trash bin", "trash can")
INVISIBLE = "­​‌‍⁠﻿"

_FOLD = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()} | {ord("l"): "i", ord("ӏ"): "i"}
_FOLD |= {0xFF41 + i: "i" if chr(97 + i) == "l" else chr(97 + i) for i in range(26)}  # full-width letters
_FOLD |= {ord(c): None for c in INVISIBLE}
WORD = re.compile(r"[^\W\d_]+")
STEMS = range(4, 9)


def fold(text: str) -> str:
    """Lower case, look-alikes and digit substitutions folded, invisible characters dropped."""
    return text.lower().translate(_FOLD)


def patterns(word: str) -> list[str]:
    """The word itself, and its beginnings of 4 to 8 letters marked by a star."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


class Lexicon:
    """Weighted words and stems, and exception phrases, in one automaton over folded text."""

    def __init__(self, weights: dict[str, float], exceptions):
        self.machine = ahocorasick.Automaton()
        entries = defaultdict(list)
        for pattern, weight in weights.items():
            entries[pattern.rstrip("*")].append((pattern.endswith("*"), weight))
        for phrase in exceptions:
            entries[fold(phrase)].append((False, None))
        for key, values in entries.items():
            self.machine.add_word(key, (len(key), values))
        self.empty = not entries
        if not self.empty:
            self.machine.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of each listed word outside exception phrases, heaviest entry per word."""
        if self.empty:
            return []
        found, spared = {}, []
        for last, (length, values) in self.machine.iter(folded):
            start, end = last - length + 1, last + 1
            if start and folded[start - 1].isalpha():
                continue
            closed = end == len(folded) or not folded[end].isalpha()
            for stem, weight in values:
                if weight is None:
                    if closed:
                        spared.append((start, end))
                elif (closed or stem) and weight > found.get(start, (0, 0.0))[1]:
                    found[start] = (end, weight)
        # one sweep: a hit is spared if a phrase that began no later ends no earlier
        spared.sort()
        out, next_, reach = [], 0, -1
        for start, (end, weight) in sorted(found.items()):
            while next_ < len(spared) and spared[next_][0] <= start:
                reach = max(reach, spared[next_][1])
                next_ += 1
            if end > reach:
                out.append((start, end, weight))
        return out


def _counts(label: int, wanted: frozenset | None):
    """Documents with a label that hold each pattern, summed per task."""

    def run(batches):
        total = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                if toxic == label:
                    words = set(WORD.findall(fold(text.as_py() or "")))
                    found = {p for w in words for p in patterns(w)}
                    total.update(found if wanted is None else found & wanted)
        rows = list(total.items())
        for i in range(0, len(rows), 50_000):
            yield records(rows[i:i + 50_000], pa.schema([("pattern", pa.string()), ("n", pa.int64())]))

    return run


def _contexts(wanted: frozenset):
    """Where toxic documents hold each pattern: (document, pattern, words around)."""

    def run(batches):
        for number, batch in enumerate(batches):
            rows = set()
            for i, (text, toxic) in enumerate(zip(batch.column(0), batch.column(1).to_pylist())):
                if toxic == 1:
                    words = WORD.findall(fold(text.as_py() or ""))
                    for k, word in enumerate(words):
                        around = " ".join([*words[max(0, k - 3):k], "-", *words[k + 1:k + 4]])
                        rows.update((f"{number}.{i}", p, around) for p in patterns(word) if p in wanted)
            yield records(sorted(rows), pa.schema([("doc", pa.string()), ("pattern", pa.string()), ("around", pa.string())]))

    return run


def _cover(found, weights: dict[str, float], least: int, most: int, depth: int = 8) -> dict[str, float]:
    """Choose patterns greedily by the toxic documents that speak for them.

    A document counts while it has fewer than ``depth`` chosen patterns, and for a pattern
    only if it shows it in a context that no other document has shown: copies count once.
    Ties go to the higher weight, then to the longer and smaller pattern; a pattern
    beginning with a chosen stem is not needed.
    """
    places = defaultdict(lambda: defaultdict(set))
    for doc, pattern, around in found:
        places[pattern][doc].add(around)
    speak = {}
    for pattern, docs in places.items():
        seen, own = set(), []
        for doc in sorted(docs):
            if docs[doc] - seen:
                own.append(doc)
                seen |= docs[doc]
        speak[pattern] = own
    covered, chosen = Counter(), {}
    while len(chosen) < most and speak:
        gain, weight, _, best = max((sum(covered[d] < depth for d in own), weights[p], len(p), p)
                                    for p, own in speak.items())
        if gain < least:
            break
        chosen[best] = weight
        covered.update(places[best].keys())
        stem = best.rstrip("*")
        speak = {p: own for p, own in speak.items()
                 if p != best and not (best.endswith("*") and p.startswith(stem))}
    return chosen


def _phrases(lexicon: Lexicon):
    """Two-word phrases around hits, with the label of their document, summed per task."""

    def run(batches):
        total = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                folded = fold(text.as_py() or "")
                for start, end, _ in lexicon.hits(folded):
                    word = WORD.match(folded, start)
                    before, after = WORD.findall(folded[max(0, start - 40):start]), WORD.match(folded, word.end() + 1)
                    if before and folded[start - 1] == " ":
                        total[f"{before[-1]} {word[0]}", toxic] += 1
                    if after and folded[word.end()] == " ":
                        total[f"{word[0]} {after[0]}", toxic] += 1
        yield records([(p, t, n) for (p, t), n in total.items()],
                      pa.schema([("phrase", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())]))

    return run


def features(folded: str, lexicon: Lexicon) -> tuple[float, float]:
    """Hit weight as a whole, and per thousand characters."""
    weight = sum(w for _, _, w in lexicon.hits(folded))
    return float(np.log1p(weight)), float(np.log1p(1000.0 * weight / (len(folded) + 100)))


def _features(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            rows = [(*features(fold(text.as_py() or ""), lexicon), toxic)
                    for text, toxic in zip(batch.column(0), batch.column(1).to_pylist())]
            yield records(rows, pa.schema([("x1", pa.float64()), ("x2", pa.float64()), ("y", pa.int32())]))

    return run


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton steps for a logistic fit with intercept and a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(b))
        b = b + np.linalg.solve(h, x.T @ (y - p) - penalty * b)
    return b


def learn(labelled: DataFrame, max_rows: int = 20_000, max_entries: int = 300, min_weight: float = 4.0) -> dict:
    """Lexicon, exceptions and score coefficients from rows ``id, text, toxic`` (0/1).

    At most about ``max_rows`` labelled rows (chosen by hash of the id) are used, so
    everything fetched here is bounded by that sample. Patterns need a log-odds of
    ``min_weight`` (less for few toxic rows) and three contexts in toxic documents.
    Without any toxic row the lexicon is empty and every score is low.
    """
    n = labelled.count()
    share = min(1.0, max_rows / max(n, 1))
    sample = stored(labelled.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select(
        "text", F.col("toxic").cast("int")))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1:
        return {"weights": {}, "exceptions": EXCEPTIONS, "beta": [-5.0, 0.0, 0.0]}
    toxic = (sample.mapInArrow(_counts(1, None), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= max(3, n1 // 200)).collect())
    count = {r["pattern"]: r["n"] for r in toxic}
    clean = {r["pattern"]: r["n"] for r in sample.mapInArrow(_counts(0, frozenset(count)), "pattern string, n long")
             .groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    weights = {}
    for p, a in count.items():
        b = clean.get(p, 0)
        odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
        if odds >= min_weight and b <= 0.02 * a:
            weights[p] = float(odds)
    found = [tuple(r) for r in sample.mapInArrow(_contexts(frozenset(weights)), "doc string, pattern string, around string")
             .withColumn("doc", F.concat_ws("/", F.spark_partition_id(), "doc")).collect()]
    chosen = _cover(found, weights, max(3, n1 // 200), max_entries)
    phrases = sample.mapInArrow(_phrases(Lexicon(chosen, EXCEPTIONS)), "phrase string, toxic int, n long").groupBy(
        "phrase").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n"))).alias("clean"),
                      F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("toxic"))
    learned = [r["phrase"] for r in phrases.where("clean >= 2 and toxic is null").orderBy(F.desc("clean"), "phrase")
               .limit(max_entries).collect()]
    exceptions = (*EXCEPTIONS, *learned)
    table = np.array(sample.mapInArrow(_features(Lexicon(chosen, exceptions)), "x1 double, x2 double, y int").collect(), float)
    return {"weights": chosen, "exceptions": exceptions, "beta": _logistic(table[:, :2], table[:, 2]).tolist()}


def _score(model: dict):
    def run(batches):
        lexicon, beta = Lexicon(model["weights"], model["exceptions"]), model["beta"]
        for batch in batches:
            out = []
            for text in batch.column("_text"):
                x1, x2 = features(fold(text.as_py() or ""), lexicon)
                out.append(1 / (1 + float(np.exp(-np.clip(beta[0] + beta[1] * x1 + beta[2] * x2, -30, 30)))))
            rest = [batch.column(c) for c in batch.schema.names if c != "_text"]
            yield pa.record_batch([*rest, pa.array(out, pa.float64())],
                                  names=[*(c for c in batch.schema.names if c != "_text"), "score"])

    return run


def held_out(id_col: str) -> Column:
    """Rows that learning never sees: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", max_rows: int = 20_000) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5).

    Learns from labelled rows that are not held out; a document with several labels takes
    the highest, null labels are left out. Null and empty texts have no hits and score
    low. Whole texts are read; other columns are ignored; an empty table gives no rows.
    """
    model = learn_from(docs, labels, id_col, text_col, label_col, max_rows)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["id"]
    scored = rows.mapInArrow(_score(model), f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def learn_from(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic",
               max_rows: int = 20_000) -> dict:
    """Model from ``docs`` and ``labels``; the labels are sampled before they meet the texts."""
    known = only(labels, id=id_col, toxic=label_col).where(F.col("toxic").isNotNull()).withColumn(
        "held", held_out("id")).where("not held").groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = min(1.0, max_rows / max(n, 1))
    # at most about max_rows narrow rows: safe to send everywhere
    few = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return learn(only(docs, id=id_col, text=text_col).join(F.broadcast(few), "id"), max_rows=2 * max_rows)


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", max_rows: int = 20_000) -> DataFrame:
    """The documents with a score below 0.5, all columns as they are, in one narrow pass."""
    model = learn_from(docs, labels, id_col, text_col, label_col, max_rows)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("_text", F.col(names[docs.columns.index(text_col)]))
    scored = rows.mapInArrow(_score(model), ", ".join(f"{c} {t}" for c, t in rows.drop("_text").dtypes) + ", score double")
    return scored.where("score < 0.5").drop("score").toDF(*docs.columns)
