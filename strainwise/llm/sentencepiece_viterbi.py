"""SentencePiece encoding by an Aho-Corasick automaton and a single-pass Viterbi, and decoding."""

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, records

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
LOWEST = float("-inf")


def load_pieces(model_file: str) -> dict:
    """Pieces, scores and special ids of a SentencePiece model file, as plain values."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    if model.normalize(" a  b\tﬁ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b\tﬁ":
        raise ValueError("only models that keep the text and put a space before it are supported")
    n = len(model)
    return {
        "pieces": [model.id_to_piece(i) for i in range(n)],
        "scores": [model.get_score(i) for i in range(n)],
        "bytes": {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)},
        "unknown": model.unk_id(),
        "special": [i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)],
    }


class Coder:
    """Encodes and decodes with the pieces of ``load_pieces``; built once per task.

    The best segmentation maximises the sum of piece scores; of equal sums the one whose
    last piece is longest wins, position by position. A character that is no piece costs
    the lowest score less 10 and is written as its UTF-8 bytes.
    """

    def __init__(self, model: dict, memo_words: int = 250_000):
        self.pieces, self.bytes, self.unknown = model["pieces"], model["bytes"], model["unknown"]
        self.machine = ahocorasick.Automaton()
        special = set(model["special"])
        usable = [i for i in range(len(self.pieces)) if i not in special and self.pieces[i]]
        for i in usable:
            self.machine.add_word(self.pieces[i], (i, len(self.pieces[i]), float(model["scores"][i])))
        self.machine.make_automaton()
        self.singles = frozenset(self.pieces[i] for i in usable if len(self.pieces[i]) == 1)
        self.unknown_score = min(model["scores"][i] for i in usable) - UNKNOWN_PENALTY
        # no piece reaches over "x▁": then each word can be solved on its own and remembered
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in (self.pieces[i] for i in usable))
        self.memo, self.memo_words = {}, memo_words
        self.byte_ids = {i: b for b, i in self.bytes.items()}
        self.byte_range = (min(self.byte_ids), max(self.byte_ids)) if self.byte_ids else (1, 0)
        self.plain = [p if i not in special else "" for i, p in enumerate(self.pieces)]

    def best_path(self, text: str) -> tuple[int, ...]:
        """Ids of one stretch of normalised text.

        The automaton reports, at each position, every piece that ends there (the longest
        first, then along its output links); each relaxes the best score of that position.
        """
        n = len(text)
        best, back, size = [0.0] + [LOWEST] * n, [-1] * (n + 1), [1] * (n + 1)
        if self.singles.issuperset(text):
            for last, (piece, length, score) in self.machine.iter(text):
                total = best[last + 1 - length] + score
                if total > best[last + 1]:
                    best[last + 1], back[last + 1], size[last + 1] = total, piece, length
        else:
            matches, pending = self.machine.iter(text), None
            for end in range(1, n + 1):
                # all pieces that end here; the start positions are final already
                while (pending := pending or next(matches, None)) and pending[0] == end - 1:
                    piece, length, score = pending[1]
                    total = best[end - length] + score
                    if total > best[end]:
                        best[end], back[end], size[end] = total, piece, length
                    pending = None
                if text[end - 1] not in self.singles and best[end - 1] + self.unknown_score > best[end]:
                    best[end], back[end], size[end] = best[end - 1] + self.unknown_score, -1, 1
        ids, at = [], n
        while at:
            if back[at] >= 0:
                ids.append(back[at])
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(self.unknown)
            at -= size[at]
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        normal = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            return list(self.best_path(normal))
        # words are remembered without their space mark; runs of spaces need the general cut
        single = SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " "
        words = text.split(" ") if single else _words(normal)
        mark = SPACE if single else ""
        out, memo = [], self.memo if single else {}
        for word in words:
            ids = memo.get(word)
            if ids is None:
                ids = self.best_path(mark + word)
                if len(word) <= 64:
                    if len(memo) >= self.memo_words:
                        memo.clear()
                    memo[word] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        """Text of the ids; bytes are joined and read as UTF-8, control ids give nothing."""
        numbers = np.asarray(ids, np.int64)
        if len(numbers) and not 0 <= numbers.min() <= numbers.max() < len(self.pieces):
            raise ValueError("an id is outside the vocabulary")
        low, high = self.byte_range
        texts = [self.plain[i] for i in numbers.tolist()]
        at = np.flatnonzero((numbers >= low) & (numbers <= high))
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
            raw = bytes(self.byte_ids[i] for i in numbers[run].tolist())
            texts[run[0]] = raw.decode("utf-8", "replace")
        joined = "".join(texts)
        text = joined.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _words(normal: str):
    """Cut before each run of spaces that follows another character."""
    first, *rest = normal.split(SPACE)
    if first:
        yield first
    run = ""
    for part in rest:
        run += SPACE
        if part:
            yield run + part
            run = ""
    if run:
        yield run


def _encode(model, digest: bool):
    def run(batches):
        coder = Coder(model.value)
        for batch in batches:
            rows = []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids = coder.encode(text)
                if digest:
                    raw = np.array(ids, "<i4").tobytes()
                    rows.append((id_, len(ids), hashlib.sha256(raw).hexdigest(), coder.decode(np.frombuffer(raw, "<i4")) == text.replace(SPACE, " ")))
                else:
                    rows.append((id_, ids))
            kind = batch.schema.field(0)
            rest = [("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_())] if digest else [
                ("ids", pa.list_(pa.int32()))]
            yield records(rows, pa.schema([kind, *rest]))

    return run


def _decode(model):
    def run(batches):
        coder = Coder(model.value)
        for batch in batches:
            rows = [(id_, None if ids is None else coder.decode(ids))
                    for id_, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield records(rows, pa.schema([batch.schema.field(0), ("text", pa.string())]))

    return run


def _shipped(df: DataFrame, model_file: str):
    """The vocabulary is read once and sent out: executors need no model file (a few MB)."""
    return df.sparkSession.sparkContext.broadcast(load_pieces(model_file))


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids``: piece ids of each whole text. Null and empty texts give no ids.

    Every row gives a row; other columns are ignored; an empty table gives no rows.
    """
    rows = only(docs, id=id_col, text=text_col)
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_encode(_shipped(docs, model_file), False), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def encode_digest(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_pieces, ids_sha256`` (ids as little-endian 32-bit numbers) and ``round_trip``.

    ``round_trip`` says that decoding gives the text back; a text that holds the space
    mark itself comes back with spaces in its place and counts as the same.
    """
    rows = only(docs, id=id_col, text=text_col)
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_encode(_shipped(docs, model_file), True), (
        f"id {kind}, n_pieces long, ids_sha256 string, round_trip boolean")).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, text`` of rows with piece ids; null ids give a null text, no ids an empty one."""
    rows = only(encoded, id=id_col, ids=ids_col)
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_decode(_shipped(encoded, model_file)), f"id {kind}, text string").withColumnRenamed("id", id_col)
