"""Personal data: exact patterns, and a linear-chain CRF for what they miss.

The patterns find e-mail addresses, IP addresses, card and phone numbers. The CRF labels the
tokens around anything that has a digit or an at sign (or a spelt-out one) from word shapes; it is
trained by likelihood on a small table of labelled sentences and decoded by Viterbi over padded numpy
batches. Its spans are added where no pattern's span lies; the patterns' spans stay. Card numbers that it
adds pass Luhn, and other digits must be as many as their kind has.
Tokens further than REACH from any such token can only be plain text, so neighbourhoods are decoded,
with the features that their tokens have in the whole text; tests hold this against decoding whole texts.

Defined results: null counts as empty and has no spans; repeated rows repeat; an empty table gives
an empty result; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm import words
from helixspark.llm.text import named
from helixspark.session import ship, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)
REACH = 3
Span = tuple[int, int, str]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried once, from its start: from later on it can't match where the whole run doesn't.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign the name goes left as far as it can, so long texts take linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The patterns' spans: start, end (code points, exclusive), kind; by start, then kind."""
    found = [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# ---- the CRF

_TOKEN = re.compile(r"\S+")
_SIGNAL = re.compile(r"[0-9@]|[\[(]at[\])]|[\[(]dot[\])]", re.IGNORECASE)
_RUNS = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|[^\x00-\x7F]+|.", re.DOTALL)
_AGAIN = re.compile(r"(.{1,4})\1+", re.DOTALL)
# Words beside personal data.
CUES = frozenset("at dot email e-mail mail contact write tel tel. phone call mobile fax number card visa mastercard credit account ip host server address from login order invoice page version date total price item".split())


def shape(token: str) -> tuple[str, str]:
    """Word shape of the whole token with the lengths of digit runs, and without any. Repeated parts of long shapes stand once."""
    fine, coarse = [], []
    for run in _RUNS.findall(token):
        c = run[0]
        kind = "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "9" if "0" <= c <= "9" else "u" if c > "\x7f" else c
        fine.append(f"9{min(len(run), 20)}" if kind == "9" else kind)
        coarse.append(kind)
    a, b = "".join(fine), "".join(coarse)
    return (a, b) if len(coarse) <= 40 else (_AGAIN.sub(r"\1", a), _AGAIN.sub(r"\1", b))


def _card_like(token: str) -> str:
    """Whether a token of as many digits as a card has passes Luhn."""
    digits = "".join(_DIGIT.findall(token))
    return str(luhn(digits)) if 14 <= len(digits) <= 19 else ""


def token_features(tokens: Sequence[str]) -> list[list[str]]:
    """Names of each token's features: its shapes, those beside it, and words beside personal data."""
    shapes = [shape(t) for t in tokens]
    cues = [c if (c := t.strip(".,:;()[]").lower()) in CUES else "" for t in tokens]
    out = []
    for i, t in enumerate(tokens):
        f = ["s:" + shapes[i][0], "c:" + shapes[i][1], "d:" + str(min(sum(c.isdigit() for c in t), 20)), "@" if "@" in t else "-@", "k:" + cues[i], "v:" + _card_like(t)]
        for k, name in ((-1, "l"), (1, "r"), (-2, "ll"), (2, "rr")):
            j = i + k
            inside = 0 <= j < len(tokens)
            f.append(f"{name}c:{shapes[j][1]}" if inside else f"{name}edge")
            if inside and cues[j]:
                f.append(f"{name}k:{cues[j]}")
        out.append(f)
    return out


def labelled_table(n: int = 480, seed: int = 7) -> list[list[tuple[str, str]]]:
    """The small training table: sentences of (token, kind), made from templates."""
    r = np.random.default_rng(seed)
    syllables = ("an", "ter", "lo", "mi", "sche", "ou", "que", "tion", "ra", "del", "en", "ver")
    word = lambda: "".join(r.choice(syllables, r.integers(1, 4)))
    digits = lambda k: "".join(map(str, r.integers(0, 10, k)))
    host = lambda: f"{word()}{r.integers(0, 10)}.{r.choice(['com', 'org', 'net', 'example.com'])}"

    hexed = lambda k: "".join(r.choice(list("0123456789abcdef"), k))

    def email() -> str:
        a, b = f"{word()}.{digits(2)}", host()
        name, dot = b.rsplit(".", 1)
        return str(r.choice([f"{a}@{b}", f"{a} @ {b}", f"{a} [at] {b}", f"{a} (at) {name} (dot) {dot}", f"{a}[at]{b}", f"{a} [at] {name} [dot] {dot}"]))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return str(r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"00{digits(2)} {a} {b}{c}"]))

    def card() -> str:
        number = digits(15)
        number += next(c for c in "0123456789" if luhn(number + c))
        p = [number[i : i + 4] for i in range(0, 16, 4)]
        return str(r.choice([" ".join(p), "-".join(p), "".join(p), ".".join(p)]))

    def not_a_card() -> str:
        while luhn(number := digits(16)):
            pass
        return str(r.choice([number, "-".join(number[i : i + 4] for i in range(0, 16, 4))]))

    def ip() -> str:
        p = [str(x) for x in r.integers(1, 255, 4)]
        return str(r.choice([".".join(p), f"{'.'.join(p)}:{digits(4)}", "[.]".join(p)]))

    def plain() -> str:
        return str(r.choice([digits(r.integers(1, 6)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"${digits(2)}.{digits(2)}", f"{word()}{digits(2)}", f'token = "{hexed(40)}"', f"password={hexed(18)}", f"key-{hexed(24)}", f"{digits(2)}:{digits(2)}", f"/{word()}/{digits(5)}", f"{digits(3)},{digits(3)}", f"#{digits(6)}", f"{digits(12)}", f"@{word()}", not_a_card(), not_a_card()]))

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    cues = {"email": ("mail", "contact", "write"), "ip": ("ip", "from", "host"), "card": ("card", "visa", "account"), "phone": ("call", "phone", "tel")}
    rows = []
    for i in range(n):
        sentence = [(word(), "") for _ in range(r.integers(1, 5))]
        for _ in range(r.integers(1, 3)):
            kind = LABELS[(i + len(sentence)) % 5] if r.random() < 0.8 else ""
            if kind and r.random() < 0.3:
                sentence.append((str(r.choice(cues[kind])), ""))
            text = makers[kind]() if kind else plain()
            sentence += [(t, kind) for t in text.split()]
            if r.random() < 0.2:
                sentence[-1] = (sentence[-1][0] + str(r.choice([".", ","])), kind)
            sentence += [(word(), "") for _ in range(r.integers(1, 5))]
        rows.append(sentence)
    return rows


@dataclass
class Crf:
    names: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def scores(self, features: Sequence[list[str]]) -> np.ndarray:
        get = self.names.get
        return np.array([self.emit[[k for f in x if (k := get(f)) is not None]].sum(0) for x in features], np.float64).reshape(-1, len(LABELS))

    def decode(self, rows: Sequence[Sequence[list[str]]]) -> list[np.ndarray]:
        """Labels of sequences of tokens' features, Viterbi over batches of like length."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        for a in range(0, len(order), 512):
            part = [i for i in order[a : a + 512] if rows[i]]
            if not part:
                continue
            size = np.array([len(rows[i]) for i in part])
            e = np.zeros((len(part), size.max(), len(LABELS)))
            for k, i in enumerate(part):
                e[k, : size[k]] = self.scores(rows[i])
            best, back = e[:, 0], np.zeros(e.shape, np.int8)
            for t in range(1, e.shape[1]):
                way = best[:, :, None] + self.move
                back[:, t] = way.argmax(1)
                best = np.where((t < size)[:, None], way.max(1) + e[:, t], best)
            at = best.argmax(1)
            path = np.zeros(e.shape[:2], int)
            for t in range(e.shape[1] - 1, -1, -1):
                path[:, t] = at
                at = np.where((t < size) & (t > 0), back[np.arange(len(part)), t, at], at)
            for k, i in enumerate(part):
                out[i] = path[k, : size[k]]
        return out


def train(rows: list[list[tuple[str, str]]], steps: int = 120, penalty: float = 0.3) -> Crf:
    """Gradient ascent (Adam) on the conditional log-likelihood, by forward-backward over one padded batch."""
    n, labels = len(rows), len(LABELS)
    names: dict[str, int] = {}
    where, what, longest = [], [], max(map(len, rows))
    gold, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, row in enumerate(rows):
        mask[i, : len(row)] = True
        gold[i, : len(row)] = [LABELS.index(k) for _, k in row]
        for t, own in enumerate(token_features([x for x, _ in row])):
            where += [i * longest + t] * len(own)
            what += [names.setdefault(f, len(names)) for f in own]
    where, what = np.array(where), np.array(what)
    emit, move = np.zeros((len(names), labels)), np.zeros((labels, labels))
    want_emit, want_move = np.zeros_like(emit), np.zeros_like(move)
    np.add.at(want_emit, (what, gold.ravel()[where]), 1)
    both = mask[:, 1:]
    np.add.at(want_move, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    state = [np.zeros_like(x) for x in (emit, move, emit, move)]
    order = np.argsort(where, kind="stable")
    starts = np.flatnonzero(np.diff(where[order], prepend=-1))
    cells = where[order][starts]

    def logsum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        e = np.zeros((n * longest, labels))
        e[cells] = np.add.reduceat(emit[what[order]], starts)
        e = e.reshape(n, longest, labels)
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0]
        for t in range(1, longest):
            f[:, t] = np.where(mask[:, t, None], logsum(f[:, t - 1, :, None] + move, 1) + e[:, t], f[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(mask[:, t + 1, None], logsum(move + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        z = logsum(f[:, -1], 1)
        p = np.exp(f + b - z[:, None, None]) * mask[:, :, None]
        pairs = np.exp(f[:, :-1, :, None] + move + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        got_emit = np.zeros_like(emit)
        np.add.at(got_emit, what, p.reshape(-1, labels)[where])
        slopes = (want_emit - got_emit - penalty * emit, want_move - pairs.sum((0, 1)) - penalty * move)
        for k, (x, slope) in enumerate(zip((emit, move), slopes, strict=True)):
            state[k] += 0.1 * (slope - state[k])
            state[k + 2] += 0.01 * (slope**2 - state[k + 2])
            x += 0.15 * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 2] / (1 - 0.99**step)) + 1e-8)
    return Crf(names, emit, move)


# Digits that a span of a kind may have.
_DIGITS = {"ip": (4, 17), "card": (14, 19), "phone": (9, 15)}

_LETTER = re.compile(r"[^\W\d_]")


def _plausible(kind: str, text: str) -> bool:
    if kind == "email":
        return "@" in text or bool(_SIGNAL.search(text)) and "at" in text.lower()
    digits = "".join(_DIGIT.findall(text))
    if kind == "card" and not luhn(digits):
        return False
    return _DIGITS[kind][0] <= len(digits) <= _DIGITS[kind][1] and not _LETTER.search(text)


def neighbourhoods(text: str, reach: int | None = REACH) -> list[tuple[list[tuple[int, int]], list[list[str]]]]:
    """Places and features of the tokens within ``reach`` of a signal, in runs; with None, of all tokens in one."""
    if not _SIGNAL.search(text):
        return []
    places = [m.span() for m in _TOKEN.finditer(text)]
    if reach is None:
        return [(places, token_features([text[a:b] for a, b in places]))]
    starts = np.array([a for a, _ in places])
    near = np.zeros(len(places) + 1, int)
    for m in _SIGNAL.finditer(text):
        k = int(np.searchsorted(starts, m.start(), "right")) - 1
        near[max(0, k - reach)] += 1
        near[min(len(places), k + reach + 1)] -= 1
    inside, out = np.flatnonzero(np.cumsum(near)[:-1] > 0), []
    for run in np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1):
        if len(run):
            low, high = max(0, run[0] - 2), min(len(places), run[-1] + 3)  # features look two tokens aside
            found = token_features([text[a:b] for a, b in places[low:high]])
            out.append((places[run[0] : run[-1] + 1], found[run[0] - low : run[-1] + 1 - low]))
    return out


def added_spans(texts: Sequence[str], base: Sequence[list[Span]], crf: Crf, reach: int | None = REACH) -> list[list[Span]]:
    """For each text the CRF's spans that lie beside all of the patterns'."""
    runs = [(i, *run) for i, t in enumerate(texts) for run in neighbourhoods(t, reach)]
    found: list[list[Span]] = [[] for _ in texts]
    for (i, run, _), labels in zip(runs, crf.decode([features for _, _, features in runs]), strict=True):
        k = 0
        while k < len(run):
            j = k
            while j + 1 < len(run) and labels[j + 1] == labels[k]:
                j += 1
            if labels[k]:
                raw = texts[i][run[k][0] : run[j][1]]
                start = run[k][0] + len(raw) - len(raw.lstrip("\"'<[{,;:"))
                end = run[j][1] - (len(raw) - len(raw.rstrip("\"'>]}.,;:!?")))
                kind = LABELS[labels[k]]
                if start < end and _plausible(kind, texts[i][start:end]) and all(end <= a or b <= start for a, b, _ in base[i]):
                    found[i].append((start, end, kind))
            k = j + 1
    return found


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (start, end, kind, added) of every document, patterns' and CRF's."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled_table()))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("added", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = words.buffers(batch.column(1))
            for i, j in words.slices(offsets):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, shared.value)
                rows = [sorted([(*s, False) for s in a] + [(*s, True) for s in b], key=lambda s: (s[0], KINDS.index(s[2]), s[1])) for a, b in zip(base, more, strict=True)]
                out = pa.array([[dict(zip(("start", "end", "kind", "added"), s, strict=True)) for s in r] for r in rows], pa.list_(span))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), out], ["doc_id", "spans"])

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<start: long, end: long, kind: string, added: boolean>>")


def mask(text: str, spans: Sequence[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans go together."""
    out, done = [], 0
    for a, b, k in sorted(spans):
        if a >= done:
            out += [text[done:a], f"<{k}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base_sha256, spans, n_added from find_spans."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda kind: lambda s: s["kind"] == kind
    base = F.filter("spans", lambda s: ~s["added"])
    counts = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"), F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added"),
    )


def op3_pii(spark, sf_dir: str) -> DataFrame:
    return digests(find_spans(table(spark, sf_dir, "documents")))
