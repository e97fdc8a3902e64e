"""Personal data: base patterns, and a character-level BiLSTM with a CRF for other spellings."""

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SLICE_BYTES, only, records, slices

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# whole digit runs only, so that a long run is not tried from each of its digits
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(numbers: list[str]) -> bool:
    return all(len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or 0) <= 255 for n in numbers)


def base_spans(text: str) -> tuple[list, list]:
    """Spans ``(kind, start, end)`` by kind, then start; and the matches that failed their check."""
    spans, failed, last, at = [], [], 0, text.find("@")
    while at >= 0:
        # a match is the run of name characters before the sign, and a domain behind it
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            spans.append((0, start, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        for m in pattern.finditer(text):
            if kind == 1:
                good = _octets(m[0].split("."))
            elif kind == 2:
                digits = _digits(m[0])
                good = 16 <= len(digits) <= 19 and luhn(digits)
            else:
                good = 8 <= len(_digits(m[0])) <= 15
            (spans if good else failed).append((kind, *m.span()))
    return spans, failed


# ------------------------------------------------------------------------- network
ALPHABET = 130  # ASCII codes, 128 for all other characters, 129 for padding
PAD = 129


def symbols(text: str) -> np.ndarray:
    out = np.empty(len(text), np.uint8)
    for i in range(0, len(text), 1 << 16):  # four bytes a character only for a piece at a time
        codes = np.frombuffer(text[i:i + (1 << 16)].encode("utf-32-le", "surrogatepass"), np.uint32)
        out[i:i + len(codes)] = np.minimum(codes, 128)
    return out


class Tagger:
    """BiLSTM over characters and a CRF over tags (none, and one per kind); numpy only.

    Arrays are (units, batch) per step, so that all gate arithmetic is contiguous. The
    four gates share one tanh: sigmoid(x) = (1 + tanh(x / 2)) / 2.
    """

    def __init__(self, hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden, tags = hidden, len(KINDS) + 1
        scale = lambda *s: rng.normal(0, 0.25, s).astype(np.float32)
        self.p = {"out": scale(tags, 2 * hidden), "bias": np.zeros((tags, 1), np.float32),
                  "trans": scale(tags, tags)}
        for side in "fb":
            self.p[f"in_{side}"] = scale(4 * hidden, ALPHABET)
            self.p[f"in_{side}"][hidden:2 * hidden] += 0.5  # remember by default
            self.p[f"rec_{side}"] = scale(4 * hidden, hidden)

    def _steps(self, side, length):
        return range(length) if side == "f" else range(length - 1, -1, -1)

    def forward(self, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Scores (time, tags, batch) of ids (time, batch); with ``keep``, also what learning needs."""
        H, (length, batch) = self.hidden, ids.shape
        states = np.zeros((length, 2 * H, batch), np.float32)
        kept = {}
        whole = mask.all(axis=1)
        half = np.full((4 * H, 1), 0.5, np.float32)
        half[3 * H:] = 1.0
        for n, side in enumerate("fb"):
            table, rec = np.ascontiguousarray((self.p[f"in_{side}"] * half).T), self.p[f"rec_{side}"] * half
            h, c = np.zeros((H, batch), np.float32), np.zeros((H, batch), np.float32)
            for t in self._steps(side, length):
                z = rec @ h
                z += np.take(table, ids[t], axis=0).T
                np.tanh(z, out=z)
                gates = z[:3 * H]
                gates += 1.0
                gates *= 0.5
                before, c = c, z[H:2 * H] * c + z[:H] * z[3 * H:]
                if not whole[t]:
                    c *= mask[t]
                tc = np.tanh(c)
                if keep:
                    kept[side, t] = (h, before, z, c, tc)
                h = z[2 * H:3 * H] * tc
                if not whole[t]:
                    h *= mask[t]
                states[t, n * H:(n + 1) * H] = h
        scores = np.einsum("kh,thb->tkb", self.p["out"], states, optimize=True) + self.p["bias"]
        return (scores, states, kept) if keep else scores

    def gradients(self, ids, mask, tags):
        """Loss and gradients of the CRF log-likelihood, averaged over windows."""
        H, (length, batch) = self.hidden, ids.shape
        scores, states, kept = self.forward(ids, mask, keep=True)
        trans, K = self.p["trans"].astype(np.float64), len(KINDS) + 1
        s = scores.astype(np.float64)
        alpha, beta = np.zeros((length, K, batch)), np.zeros((length, K, batch))
        alpha[0] = s[0]
        lse = lambda x, axis: (m := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis=axis))
        for t in range(1, length):
            step = lse(alpha[t - 1][:, None] + trans[:, :, None], 0) + s[t]
            alpha[t] = np.where(mask[t], step, alpha[t - 1])
        for t in range(length - 2, -1, -1):
            step = lse(trans[:, :, None] + (s[t + 1] + beta[t + 1])[None], 1)
            beta[t] = np.where(mask[t + 1], step, beta[t + 1])
        z = lse(alpha[-1], 0)
        gold = (np.arange(K)[None, :, None] == tags[:, None]) & mask[:, None]
        d = np.exp(alpha + beta - z) * mask[:, None] - gold
        pairs = np.zeros((K, K))
        for t in range(1, length):
            both = np.exp(alpha[t - 1][:, None] + trans[:, :, None] + (s[t] + beta[t])[None] - z) * mask[t]
            both -= gold[t - 1][:, None] & gold[t][None]
            pairs += both.sum(axis=2)
        loss = (z - (s * gold).sum(axis=(0, 1)) - (
            trans[tags[:-1], tags[1:]] * mask[1:]).sum(axis=0)).sum() / mask.sum()
        d = d.astype(np.float32)
        grads = {"out": np.einsum("tkb,thb->kh", d, states, optimize=True), "bias": d.sum(axis=(0, 2))[:, None],
                 "trans": pairs.astype(np.float32)}
        back = np.einsum("kh,tkb->thb", self.p["out"], d, optimize=True)
        for n, side in enumerate("fb"):
            rec, g_rec = self.p[f"rec_{side}"], np.zeros_like(self.p[f"rec_{side}"])
            g_in = np.zeros((ALPHABET, 4 * H), np.float32)
            dh, dc = np.zeros((H, batch), np.float32), np.zeros((H, batch), np.float32)
            for t in reversed(list(self._steps(side, length))):
                h, before, z, c, tc = kept[side, t]
                i, f, o, g = z[:H], z[H:2 * H], z[2 * H:3 * H], z[3 * H:]
                dh = (dh + back[t, n * H:(n + 1) * H]) * mask[t]
                dc = (dc + dh * o * (1 - tc * tc)) * mask[t]
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o),
                                     dc * i * (1 - g * g)])
                g_rec += dz @ h.T
                np.add.at(g_in, ids[t], dz.T)
                dc = dc * f
                dh = rec.T @ dz
            grads[f"rec_{side}"], grads[f"in_{side}"] = g_rec, g_in.T
        return loss, {k: v / batch for k, v in grads.items()}

    def fit(self, ids, mask, tags, steps: int, batch: int, rate: float = 0.02, seed: int = 7) -> list[float]:
        """Adam over random batches of windows (time, number); returns the losses.

        Characters that no window holds are read as "all other characters" from then on.
        """
        rng, losses = np.random.default_rng(seed), []
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, ids.shape[1], batch)
            loss, grads = self.gradients(ids[:, pick], mask[:, pick], tags[:, pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9 ** step))
                             / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
            losses.append(float(loss))
        seen = np.isin(np.arange(PAD), ids[mask])
        if seen[128]:
            for side in "fb":
                self.p[f"in_{side}"][:, :PAD][:, ~seen] = self.p[f"in_{side}"][:, [128]]
        return losses

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Best tag paths of scores (time, tags, batch).

        A run of other tags gains at most the sum of its best differences to "none" plus
        what entering and leaving cost. Windows whose best such sum is not positive need no
        search: their best path is "none" throughout.
        """
        trans = np.round(self.p["trans"], 3)
        s = np.round(scores, 3)
        stay = trans[0, 0]
        inside = float(trans[1:, 1:].max() - stay)
        # entering replaces one "none" step; at the window's edges it costs nothing
        edges = max(0.0, float((trans[0, 1:] - stay).max()) - inside) + max(0.0, float((trans[1:, 0] - stay).max()))
        cost = float((trans[0, 1:] - stay).max()) + float((trans[1:, 0] - stay).max()) - inside
        gain = s[:, 1:].max(axis=1) - s[:, 0] + inside
        for b, n in enumerate(lengths):
            gain[n:, b] = -1e3
        sums = np.concatenate([np.zeros((1, gain.shape[1]), gain.dtype), np.cumsum(gain, axis=0)])
        low = np.minimum.accumulate(sums, axis=0)
        # a run inside the window pays both edges, one at the border may not
        best_run = (sums[1:] - low[:-1]).max(axis=0)
        border = np.maximum(sums[1:].max(axis=0), sums[lengths, np.arange(len(lengths))] - low.min(axis=0))
        live = (best_run + min(cost, edges) > 0) | (border + edges > 0)
        paths = [np.zeros(n, np.int8) for n in lengths]
        which = np.flatnonzero(live)
        if not len(which):
            return paths
        s, n, every = s[:, :, which], lengths[which], np.arange(len(which))
        best, back = s[0], np.zeros(s.shape, np.int8)
        for t in range(1, len(s)):
            step = best[:, None] + trans[:, :, None]
            back[t] = step.argmax(axis=0)
            best = np.where(t < n, step.max(axis=0) + s[t], best)
        tag, path = best.argmax(axis=0).astype(np.int8), np.zeros((len(s), len(which)), np.int8)
        for t in range(len(s) - 1, -1, -1):
            path[t] = tag
            tag = np.where(t < n, back[t, tag, every], tag)
        for k, b in enumerate(which):
            paths[b] = path[:n[k], k].copy()
        return paths


# ------------------------------------------------------------------------ training
# What stands between the numbers of respelled spans, by kind, and before a phone number.
MARKS = {
    1: (" . ", "[.]", "(.)", " dot ", "[dot]", "(dot)", "-", " - ", "/", " / ", "_", "|", ":", "*", "\\", " * ", "--", "=", "<.>",
        "·", " · ", "«dot»", "«.»"),
    2: (".", " . ", "/", " / ", "_", " _ ", "|", "--", "*", " * ", "=", "\\", "·", " · "),
    3: ("/", " / ", "_", " _ ", ".", " . ", "-", "|", "--", "*", " * ", "=", "\\", "·", " · "),
}
CUES = ("00", "00", "tel ", "tel: ", "call ", "phone ", "ph. ")


def _respell(kind: int, text: str, rng) -> str:
    """Another spelling of a base span, as people write it to get past patterns."""
    if kind == 0:
        name, _, host = text.partition("@")
        at, dot = ((" at ", " dot "), (" (at) ", "."), ("[at]", "[dot]"), (" @ ", "."), (" (at) ", " (dot) "))[rng.integers(5)]
        return name + at + host.replace(".", dot)
    marks = MARKS[kind]
    mark = marks[rng.integers(len(marks))]
    if kind == 1:
        return text.replace(".", mark)
    digits = _digits(text)
    size = 4 if kind == 2 else int(rng.integers(2, 5))
    body = mark.join(digits[i:i + size] for i in range(0, len(digits), size))
    return body if kind == 2 else CUES[rng.integers(len(CUES))] + body


def training_windows(texts, width: int = 96, spelt: int = 3, seed: int = 7):
    """Windows (ids, mask, tags) around the base spans of ``texts``, as they are and ``spelt`` times respelled.

    As many windows without any span are added; failed matches in them teach "none".
    """
    rng, windows = np.random.default_rng(seed), []
    for text in texts:
        spans, failed = base_spans(text)
        taken = np.zeros(len(text), np.int8)
        for kind, a, b in spans:
            taken[a:b] = kind + 1
        for kind, a, b, other in [(*s, False) for s in spans] + [(*s, True) for s in spans for _ in range(spelt)]:
            left = max(0, a - int(rng.integers(5, width // 2)))
            inside = _respell(kind, text[a:b], rng) if other else text[a:b]
            tags = np.concatenate([taken[left:a], np.full(len(inside), kind + 1, np.int8), taken[b:b + width]])
            windows.append((text[left:a] + inside + text[b:b + width], tags))
        for a in [x[1] for x in failed] + list(rng.integers(0, max(1, len(text)), 1 + len(spans))):
            left = max(0, int(a) - int(rng.integers(5, width // 2)))
            windows.append((text[left:left + width], taken[left:left + width]))
    windows = [(t[:width], g[:width]) for t, g in windows if t]
    ids = np.full((width, len(windows)), PAD, np.uint8)
    tags, mask = np.zeros((width, len(windows)), np.int8), np.zeros((width, len(windows)), bool)
    for k, (text, own) in enumerate(windows):
        ids[:len(text), k], tags[:len(own), k], mask[:len(text), k] = symbols(text), own, True
    return ids, mask, tags


def train(docs: DataFrame, max_docs: int = 1500, max_chars: int = 4_000_000, hidden: int = 8, steps: int = 300,
          batch: int = 96) -> Tagger:
    """Tagger trained on at most about ``max_docs`` documents (by text hash) that hold digits or signs.

    The sample is bounded by ``max_docs`` rows and ``max_chars`` characters in all, longest left
    out; training runs on the driver from this sample only.
    """
    texts = docs.where(F.col("text").rlike("[0-9@]"))
    n = texts.count()
    share = min(1.0, max_docs / max(n, 1))
    few = texts.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000)).where(
        F.length("text") <= max_chars // max_docs * 4).select("text")
    rows = sorted({r["text"] for r in few.limit(2 * max_docs).collect()})
    tagger = Tagger(hidden)
    ids, mask, tags = training_windows(rows)
    if ids.shape[1]:
        tagger.fit(ids, mask, tags, steps, batch)
    return tagger


# ------------------------------------------------------------------------ inference
BRACKET_AT = r"[(\[{]\s?at\s?[)\]}]"
EVIDENCE = re.compile(rf"@|\bdot\b|{BRACKET_AT}")
LEAST_DIGITS = (0, 4, 15, 8)
NUMBERS = re.compile(r"[0-9]+")


def _plausible(kind: int, text: str) -> bool:
    """A found span must hold what its kind cannot do without, and pass the check that its base pattern has to pass."""
    if kind == 0:
        return len(text) >= 8 and ("@" in text or re.search(BRACKET_AT, text) is not None or (
            re.search(r"\bat\b", text) is not None and re.search(r"\bdot\b", text) is not None))
    if kind == 1:
        # four numbers, whatever stands for the dots
        numbers = NUMBERS.findall(text)
        marks = NUMBERS.split(text)[1:-1]
        return len(numbers) == 4 and _octets(numbers) and all(len(mark) <= 8 for mark in marks)
    digits = _digits(text)
    if not (LEAST_DIGITS[kind] <= len(digits) <= (19 if kind == 2 else 15) and len(digits) * 3 >= len(text)):
        return False
    return kind != 2 or luhn(digits)


def _whole(text: str, kind: int, a: int, b: int) -> tuple[int, int]:
    """The span without blanks at its ends, and with the rest of a number that it cuts."""
    inner = text[a:b]
    a, b = a + len(inner) - len(inner.lstrip()), b - len(inner) + len(inner.rstrip())
    if kind and a < b:
        while a > 0 and "0" <= text[a] <= "9" and "0" <= text[a - 1] <= "9":
            a -= 1
        while b < len(text) and "0" <= text[b - 1] <= "9" and "0" <= text[b] <= "9":
            b += 1
    return a, b


def _promising(text: str, codes: np.ndarray, starts: list[int], width: int) -> list[bool]:
    """Windows to decode: those holding any sign that a plausible span must hold, and their neighbours.

    Exact: a span found elsewhere would have no such sign and would be dropped.
    """
    digits = np.append(np.int32(0), np.cumsum((codes >= 48) & (codes <= 57), dtype=np.int32))
    signs = np.array([m.start() for m in EVIDENCE.finditer(text)], np.int64)
    ends = np.minimum(np.array(starts) + width, len(codes))
    near = (digits[ends] - digits[starts] >= 1) | (np.searchsorted(signs, ends) > np.searchsorted(signs, starts))
    if digits[-1] < min(LEAST_DIGITS[1:]):
        near = np.searchsorted(signs, ends) > np.searchsorted(signs, starts)
    wide = near.copy()
    wide[1:] |= near[:-1]
    wide[:-1] |= near[1:]
    return wide.tolist()


def tag_texts(tagger: Tagger, texts: list[str], width: int = 512, overlap: int = 64, batch: int = 512) -> list[np.ndarray]:
    """Tags of each text: overlapping windows are decoded, and each character takes the tag
    of the window in which it lies farther from an edge. All windows of a text are looked
    at; those where no span could be reported (see ``_promising``) keep "none"."""
    codes = [symbols(t) for t in texts]
    windows = []  # (length, text, start)
    for k, c in enumerate(codes):
        starts = [0]
        while starts[-1] + width < len(c):
            starts.append(starts[-1] + width - overlap)
        if len(c):
            windows += [(min(width, len(c) - a), k, a) for a, on in zip(starts, _promising(texts[k], c, starts, width)) if on]
    windows.sort()
    tags = [np.zeros(len(c), np.int8) for c in codes]
    for i in range(0, len(windows), batch):
        part = windows[i:i + batch]
        longest = part[-1][0]
        ids = np.full((longest, len(part)), PAD, np.uint8)
        for b, (n, k, start) in enumerate(part):
            ids[:n, b] = codes[k][start:start + n]
        mask = ids != PAD
        paths = tagger.decode(tagger.forward(ids, mask), np.array([n for n, _, _ in part]))
        for path, (n, k, start) in zip(paths, part):
            if path.any():
                lo = overlap // 2 if start else 0
                hi = n if start + n == len(codes[k]) else n - overlap // 2
                tags[k][start + lo:start + hi] = path[lo:hi]
    return tags


def _ruled_out(a: int, b: int, failed: list) -> bool:
    """Whether one of the failed matches (in order, apart) covers about the same characters as the span."""
    at = bisect_right(failed, a, key=lambda m: m[1])
    while at < len(failed) and failed[at][0] < b:
        x, y = failed[at]
        if 4 * (min(b, y) - max(a, x)) >= 3 * max(b - a, y - x):
            return True
        at += 1
    return False


def all_spans(text: str, tags: np.ndarray) -> tuple[list, list]:
    """Base spans, and all spans: found ones join unless they touch a base span or failed as one of their kind."""
    base, failed = base_spans(text)
    if not tags.any():
        return base, base
    taken = np.zeros(len(text), bool)
    for _, a, b in base:
        taken[a:b] = True
    wrong = [[(a, b) for k, a, b in failed if k == kind] for kind in range(len(KINDS))]
    edges = np.flatnonzero(np.diff(tags, prepend=0, append=0))
    found = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if tags[a]:
            kind = int(tags[a]) - 1
            a, b = _whole(text, kind, a, b)
            if a < b and not taken[a:b].any() and _plausible(kind, text[a:b]) and not _ruled_out(a, b, wrong[kind]):
                taken[a:b] = True
                found.append((kind, a, b))
    return base, sorted(base + found)


def _told(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _slices(batch: pa.RecordBatch):
    for part in slices(batch, "text", SLICE_BYTES):
        yield part, [t or "" for t in part.column("text").to_pylist()]


def _find(tagger: Tagger):
    schema = pa.schema([*((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        for batch in batches:
            for part, texts in _slices(batch):
                rows = []
                for text, tags in zip(texts, tag_texts(tagger, texts)):
                    base, spans = all_spans(text, tags)
                    counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                    rows.append((*counts, hashlib.sha256(_told(base).encode()).hexdigest(), _told(spans)))
                out = records(rows, schema)
                yield pa.record_batch([part.column("id"), *out.columns], names=["id", *schema.names])

    return run


def mask_spans(text: str, spans) -> str:
    """Replace spans by their kind in brackets; where spans overlap, the earliest and longest is used."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{KINDS[kind].upper()}]"]
            last = b
        elif b > last:
            last = b  # covered by the mask before it
    return "".join([*out, text[last:]])


def _mask(tagger: Tagger):
    def run(batches):
        for batch in batches:
            for part, _ in _slices(batch):
                given = part.column("text").to_pylist()
                tags = tag_texts(tagger, [t or "" for t in given])
                masked = [t and mask_spans(t, all_spans(t, g)[1]) for t, g in zip(given, tags)]
                yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(masked, pa.string()))

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per document: id, base counts per kind, ``base_sha256`` and ``spans``.

    ``spans`` lists base spans and those the tagger adds, as kind:start:end in code
    points. Null counts as empty; other columns are ignored; an empty table gives no rows
    (the tagger is then untrained and unused). Repeated rows give repeated results.
    """
    rows = only(docs, id=id_col, text=text_col)
    kind = dict(rows.dtypes)["id"]
    found = rows.mapInArrow(_find(train(rows, **settings)), (
        f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"))
    return found.withColumnRenamed("id", id_col)


def mask_pii(docs: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The documents with every span replaced by its kind; all columns and null texts are kept."""
    names = docs.columns
    place = [i for i, n in enumerate(names) if n == text_col][0]
    rows = docs.toDF(*["text" if i == place else f"c{i}" for i in range(len(names))])
    masked = rows.mapInArrow(_mask(train(rows.select("text"), **settings)), rows.schema)
    return masked.toDF(*names)
