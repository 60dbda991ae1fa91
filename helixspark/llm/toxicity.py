"""Toxicity scoring after noisy-channel deobfuscation.

A token that may hide a word (letters mixed with digits or symbols, letters one by one, a letter
three times in a row) becomes a character lattice: every sign stands for itself, for the letters it
resembles, or for nothing; repeats and separators may be dropped. Viterbi search under a character
trigram model of the whole corpus picks the word. Letters that the model doesn't know stand for
themselves. A classifier on words and word beginnings, fitted to a bounded sample of labelled
documents, then scores the restored text. Features are found and counted on the executors; the driver gets
counts of the chosen ones and one row of their numbers for each document of the sample.

Defined results: null counts as empty and gets the score of a text without any marked word;
repeated rows score alike, and to learn from count once for each id; an id with labels of both kinds is
toxic; without labelled documents of both kinds every score is that of the kind there is, 0 without any;
an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.llm.text import named
from helixspark.session import cut, ship, table

#: Labelled documents of each kind from which the classifier learns, at most: those with the least hash of the id.
SAMPLE = 3000
#: Labels are broadcast up to so many rows to find their documents, joined by a shuffle of ids beyond.
MAX_BROADCAST = 1_000_000
#: Features that the classifier keeps, at most, and the chi-square they need.
FEATURES, LEAST_CHI2, LEAST_DOCS = 400, 20.0, 4
THRESHOLD = 0.7
PREFIXES = (3, 4, 5, 6)
# Signs and the letters they resemble.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ"
SIZE = len(LETTERS) + 1
#: Costs in nats: a resembling sign, one dropped or taken for a border, a dropped separator, a dropped repeat (of a run of two; of more).
RESEMBLES, SIGN, BORDER, SEPARATOR, REPEAT, LONG_REPEAT = 0.5, 8.0, 4.0, 1.0, 5.0, 0.5
EDGE = ".,;:!?\"'()[]{}<>«»…|#*%&-_=/\\~`^"
_INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
_CODES = np.zeros(0x250, np.int64)
for _c, _i in _INDEX.items():
    _CODES[ord(_c)] = _i
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?:(?<=\s)|^)\S(?:[ \t]\S){2,}(?=\s|$)")
_WORDS = re.compile(r"[^\W\d_]+")


def trigram_counts(texts: Iterable[str], joined: int = 1 << 19) -> np.ndarray:
    """How often each trigram of letters and word borders occurs. Short texts are counted together."""
    total, waiting, size = np.zeros(SIZE**3, np.int64), [], 0
    for text in chain(texts, [None]):
        if text is not None:
            waiting.append(text)
            size += len(text)
            if size < joined:
                continue
        codes = np.frombuffer(f" {'  '.join(waiting).lower()} ".encode("utf-32-le"), np.uint32)
        waiting, size = [], 0
        codes = np.concatenate([[0], np.where(codes < 0x250, _CODES[np.minimum(codes, 0x24F)], 0)])
        total += np.bincount((codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:], minlength=SIZE**3)
    return total


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a sign after two others: trigrams backed by bigrams, backed by single signs."""
    c3 = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + SIZE)
    p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
    return np.log((c3 + 5 * p2) / (c3.sum(2, keepdims=True) + 5))


def lattice(token: str) -> list[list[tuple[int, str, float]]]:
    """For each sign of a lower-cased token what it can stand for: its number in the model (-1 for nothing, 0 for a border), what is written, and the cost."""
    out, run = [], 0
    for i, c in enumerate(token):
        run = run + 1 if i and token[i - 1] == c else 1
        if c in _INDEX:
            arcs = [(_INDEX[c], c, 0.0)]
        elif c.isalpha():
            arcs = [(0, c, 0.0)]
        else:
            signs = LEET.get(c, "")
            arcs = [(0, " ", BORDER if signs else 0.0), (-1, "", SIGN if signs else SEPARATOR), *((_INDEX[x], x, RESEMBLES) for x in signs)]
        if run > 1 and c in _INDEX:
            long = run > 2 or token[i + 1 : i + 2] == c
            arcs.append((-1, "", LONG_REPEAT if long else REPEAT))
        out.append(arcs)
    return out


def restore(token: str, lm: list[list[list[float]]]) -> str:
    """The most probable plain text of an obfuscated token: words and spaces."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for arcs in lattice(token):
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in best.items():
            row = lm[a][b]
            for sign, written, cost in arcs:
                if sign < 0:
                    state, value, way = (a, b), score - cost, path
                else:
                    state, value, way = (b, sign), score - cost + row[sign], (written, path)
                if state not in step or value > step[state][0]:
                    step[state] = (value, way)
        best = step
    _, path = max(((score + lm[a][b][0], path) for (a, b), (score, path) in best.items()), key=lambda x: x[0])
    signs = []
    while path:
        signs.append(path[0])
        path = path[1]
    return "".join(reversed(signs))


@dataclass
class Restorer:
    """Plain words of texts, or what ``of`` makes of a token's words; met tokens are remembered, up to a bound."""

    lm: list
    of: Callable[[Iterable[str]], tuple[str, ...]] = tuple
    remember: int = 100_000
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def _token(self, token: str) -> tuple[str, ...]:
        core = token.rstrip(EDGE).lstrip(EDGE)
        if core[:1] == "$" and core[1:2] == "$" or core[-2:] == "$$":
            core = core.strip("$")
        if core.isalpha():
            return tuple(restore(core, self.lm).split()) if _TRIPLE.search(core) else (core,)
        parts = _WORDS.findall(core)
        if not parts:
            return ()
        hidden = any(c in LEET for c in core) or len(parts) > 2 and max(map(len, parts)) <= 2 or _TRIPLE.search(core)
        return tuple(restore(core, self.lm).split()) if hidden else tuple(parts)

    def words(self, text: str) -> tuple[set[str], int]:
        """The distinct restored words, or the features of them that ``of`` keeps, and the number of distinct tokens."""
        text = text.lower()
        tokens = set(text.split())
        if len(self.known) > self.remember:
            self.known.clear()
        found: set[str] = set()
        known = self.known
        for token in tokens:
            own = known.get(token)
            if own is None:
                own = known[token] = self.of(self._token(token))
            if own:
                found.update(own)
        for m in _SPACED.finditer(text):
            found.update(self.of(restore(m[0], self.lm).split()))
        return found, len(tokens)


def features(words: Iterable[str]) -> Iterator[str]:
    """Distinct words, and beginnings of longer ones with a hyphen, which may repeat."""
    for w in words:
        yield w
        for k in PREFIXES:
            if len(w) > k:
                yield w[:k] + "-"


@dataclass
class Classifier:
    weights: dict[str, float]
    bias: float
    length: float = 0.0

    def hits(self, words: Iterable[str]) -> tuple[str, ...]:
        """The features of a few words that have a weight."""
        w = self.weights
        return tuple(f for f in features(words) if f in w) if w else ()

    def score(self, hits: set[str], size: int) -> float:
        z = self.bias + self.length * _long(size) + sum(self.weights[f] for f in sorted(hits))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _long(size: int) -> float:
    """Long texts hold more chance hits."""
    return math.log(size + 1) - 5


def fit(x: np.ndarray, labels: np.ndarray, steps: int = 25, penalty: float = 0.05) -> np.ndarray:
    """Weights of the columns of ``x``, the last for a constant, by Newton steps of logistic regression.

    Both kinds of rows weigh the same, however many of each there are.
    """
    toxic = int(labels.sum())
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    weight = np.where(labels == 1, len(x) / (2 * toxic), len(x) / (2 * (len(x) - toxic)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        v = (weight * np.maximum(p * (1 - p), 1e-4)).astype(np.float32)
        step = np.linalg.solve((x * v[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (labels - p)).astype(np.float32) - ridge * w)
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-3:
            break
    return w


def corpus_model(docs: DataFrame, text_col: str = "text") -> list:
    """The character model of all texts. SIZE**3 counts at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            total += trigram_counts(t.as_py() or "" for t in batch.column(0))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "n"])

    parts = docs.select(named(text_col).alias("text")).mapInArrow(run, "code long, n long")
    found = parts.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIZE**3, np.int64)
    counts[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return language_model(counts).tolist()


def sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """id, toxic, text of the rows of at most ``sample`` documents of each kind that have a label (doc_id, toxic)."""
    marks = labels.select(named(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    marks = cut(marks.groupBy("id").agg(F.max("toxic").alias("toxic")))
    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    there = cut(rows.select("id").join(F.broadcast(marks) if marks.count() <= MAX_BROADCAST else marks, "id").distinct())
    pick = lambda kind: there.where(F.col("toxic") == kind).orderBy(F.xxhash64("id"), "id").limit(sample)
    return rows.join(F.broadcast(cut(pick(0).unionByName(pick(1)))), "id")


def learn(docs: DataFrame, labels: DataFrame, lm: list, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Classifier:
    """The classifier from at most ``sample`` documents of each kind of ``labels`` (doc_id, toxic)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.array(lm, np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = None
        for batch in batches:
            restorer = restorer or Restorer(shared.value.tolist(), remember=50_000)
            for id_, toxic, text in zip(*batch.columns, strict=True):
                own, size = restorer.words(text.as_py() or "")
                yield pa.RecordBatch.from_arrays([pa.array([id_.as_py()]), pa.array([toxic.as_py()], pa.int32()), pa.array([size]), pa.array([sorted(set(features(own)))], pa.list_(pa.string()))], ["id", "toxic", "size", "features"])

    found = sampled(docs, labels, id_col, text_col, sample).select("id", "toxic", "text").mapInArrow(run, "id long, toxic int, size long, features array<string>")
    found = cut(found.groupBy("id", "toxic").agg(F.min(F.struct("size", "features")).alias("own")).select("toxic", "own.*"))
    toxic, rows = found.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    if not 0 < toxic < rows:
        return Classifier({}, 30.0 * (1 if toxic else -1))
    names = chosen_features(found, toxic, rows)
    numbers = found.select("toxic", "size", F.array_intersect("features", F.lit(names) if names else F.array().cast("array<string>")).alias("own")).toArrow()
    labels_ = numbers.column("toxic").to_numpy().astype(np.int64)
    x, column = np.zeros((rows, len(names) + 2), np.float32), {f: i for i, f in enumerate(names)}
    x[:, -1] = 1
    x[:, -2] = [_long(size) for size in numbers.column("size").to_pylist()]
    for i, own in enumerate(numbers.column("own").to_pylist()):
        x[i, [column[f] for f in own]] = 1
    w = fit(x, labels_)
    return Classifier({f: float(v) for f, v in zip(names, w, strict=False)}, float(w[-1]), float(w[-2]))


def chosen_features(found: DataFrame, toxic: int, rows: int) -> list[str]:
    """The features (of toxic and features) that are most unevenly spread over the two kinds of rows, by chi-square."""
    counts = found.select(F.col("toxic").cast("long").alias("toxic"), F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b, clean = F.col("a").cast("double"), F.col("b").cast("double"), rows - toxic
    chi2 = rows * F.pow(a * (clean - b) - b * (toxic - a), F.lit(2)) / F.greatest(float(toxic) * clean * (a + b) * (rows - a - b), F.lit(1.0))
    uneven = counts.where((a >= LEAST_DOCS) & (a * clean > b * toxic)).select("f", chi2.alias("chi2")).where(F.col("chi2") >= LEAST_CHI2)
    return [r.f for r in uneven.orderBy(F.desc("chi2"), "f").limit(FEATURES).collect()]


def score_documents(docs: DataFrame, classifier: Classifier, lm: list, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score. The model goes to the workers as a broadcast variable of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast((classifier, np.array(lm, np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table_ = shared.value
        restorer = Restorer(table_.tolist(), own.hits)
        for batch in batches:
            scores = [own.score(*restorer.words(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def training_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels that may be learnt from; the others are held out."""
    return labels.where(~held_out(id_col))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(named(id_col).cast("string")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    ship(docs.sparkSession)
    lm = corpus_model(docs, text_col)
    scores = score_documents(docs, learn(docs, training_rows(labels), lm, id_col, text_col), lm, id_col, text_col)
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, whole, without those whose score reaches the threshold. Rows stay where they are."""
    ship(docs.sparkSession)
    lm = corpus_model(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((learn(docs, training_rows(labels), lm, id_col, text_col), np.array(lm, np.float32)))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table_ = shared.value
        restorer = Restorer(table_.tolist(), own.hits)
        for batch in batches:
            yield batch.filter(pa.array([own.score(*restorer.words(t.as_py() or "")) < threshold for t in batch.column(place)], pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # mapInArrow doesn't take names with dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
