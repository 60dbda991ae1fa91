"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of n-grams of ORDER code points over whatever alphabet the texts have; only ASCII white
space is one sign, which also stands before a text. Counts, continuation counts and back-off weights
are tables sharded by n-gram, which grow with the trusted text. Documents are packed into blocks; a
block asks once for each of its distinct n-grams, so what moves is pre-aggregated and no n-gram
is a hot key. The joins with the tables give every wanted n-gram its probability, from single
signs upwards; each block meets its answers and scores its documents.

One trusted document in HELD_OUT isn't trained on. A document is kept if its perplexity is within a
quantile of these documents of its language.

Defined results: null or empty text has a null perplexity and isn't kept; a null language counts as
the empty one; a language without held-out trusted documents takes the quantile of all; without trusted
rows all documents are trusted; where either part of them is empty both are the whole; without
any text to take a quantile of, all documents with text are kept; repeated rows are judged alike;
an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.session import cut, discard, release, scratch, ship, stored, table

ORDER = 4
#: Of the trusted documents one in so many sets thresholds instead of counts.
HELD_OUT = 5
#: A document is kept up to MARGIN times this quantile of the held-out trusted documents' perplexity.
QUANTILE, MARGIN = 0.99, 1.05
#: Ids of trusted rows are broadcast up to so many (16 MB), joined by a shuffle beyond.
MAX_BROADCAST = 1_000_000
MAX_LANGS = 10_000
#: Code points in a block (or one longer document), and those that are looked at together.
BLOCK, SLICE = 1 << 25, 1 << 20
_PAD = " " * (ORDER - 1)
BLOCKS = "block long, doc_ids array<long>, langs array<string>, sizes array<long>, texts binary"


def signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ORDER - 1 borders, and the number of the text at each place; -1 at borders."""
    found = np.frombuffer((_PAD + _PAD.join(texts)).encode("utf-32-le"), np.uint32) if texts else np.zeros(0, np.uint32)
    found = np.where((found >= 9) & (found <= 13), np.uint32(32), found)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.full((len(texts), 2), -1)
    owner[:, 1] = np.arange(len(texts))
    return found, np.repeat(owner.ravel(), np.stack([np.full(len(texts), ORDER - 1), sizes], 1).ravel())


def slices(found: np.ndarray, owner: np.ndarray, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For stretches of places: the number of the n-gram that ends at each (borders left out), the texts there, and the alphabet.

    Numbers are exact, to the base of the size of the stretch's alphabet; stretches with too many letters for that are halved.
    """
    for a in range(0, len(found), size):
        inside = owner[a : a + size]
        if (inside < 0).all():
            continue
        part = found[max(0, a - ORDER + 1) : a + size]
        met = np.zeros(0x110000, bool)
        met[part] = True
        alphabet = np.flatnonzero(met)
        if len(alphabet) ** ORDER >= 1 << 63:
            b = max(0, a - ORDER + 1)
            inner = owner[b : a + size].copy()
            inner[: a - b] = -1
            yield from slices(found[b : a + size], inner, size // 2)
            continue
        place = np.zeros(0x110000, np.int64)
        place[alphabet] = np.arange(len(alphabet))
        dense = place[part]
        own = np.flatnonzero(inside >= 0) + (len(part) - len(inside))
        numbers = dense[: len(dense) - ORDER + 1]
        for k in range(ORDER - 2, -1, -1):
            numbers = numbers * len(alphabet) + dense[ORDER - 1 - k : len(dense) - k]
        numbers = numbers[own - ORDER + 1]

        yield numbers, inside[inside >= 0], alphabet


def spell(numbers: np.ndarray, alphabet: np.ndarray) -> list[str]:
    letters = np.empty((len(numbers), ORDER), np.uint32)
    for k in range(ORDER - 1, -1, -1):
        numbers, last = numbers // len(alphabet), numbers
        letters[:, k] = alphabet[last - numbers * len(alphabet)]
    text = letters.tobytes().decode("utf-32-le")
    return [text[i : i + ORDER] for i in range(0, len(text), ORDER)]


def distinct(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers and how often each occurs, by sorting, which is the faster way here."""
    numbers = np.sort(numbers)
    at = np.flatnonzero(np.diff(numbers, prepend=numbers[:1] - 1))
    return numbers[at], np.diff(at, append=len(numbers))


def _joined(texts: Iterator[str], limit: int) -> Iterator[list[str]]:
    """Texts in lists of ``limit`` code points or one longer text."""
    waiting, size = [], 0
    for t in texts:
        if waiting and size + len(t) > limit:
            yield waiting
            waiting, size = [], 0
        waiting.append(t)
        size += len(t)
    if waiting:
        yield waiting


def _count_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts in _joined((t.as_py() or "" for b in batches for t in b.column(0)), SLICE):
        for numbers, _, alphabet in slices(*signs(texts)):
            some, n = distinct(numbers)
            yield pa.RecordBatch.from_arrays([pa.array(spell(some, alphabet), pa.string()), pa.array(n, pa.int64())], ["gram", "n"])


# ---- the model


def levels(trusted: DataFrame) -> list[DataFrame]:
    """gram, n for n-grams of 1 to ORDER signs: occurrences at the top, below how many signs come before."""
    parts = trusted.select("text").mapInArrow(_count_parts, "gram string, n long")
    found = [cut(parts.groupBy("gram").agg(F.sum("n").alias("n")))]
    for k in range(ORDER - 1, 0, -1):
        found.insert(0, cut(found[0].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))))
    return found


def discounts(own: DataFrame) -> list[float]:
    """What is taken from counts of 1, 2 and more of one level."""
    n = [max(1, x) for x in own.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]


def _discount(d: list[float]) -> Column:
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def probabilities(wanted: DataFrame, own: list[DataFrame]) -> DataFrame:
    """gram, p for the distinct n-grams ``wanted`` (column gram, ORDER signs), from ``levels``.

    Each level adds what its counts leave to the n-gram to its context's weight times the level below.
    """
    asked = [wanted]
    for k in range(ORDER - 1, 0, -1):
        asked.insert(0, asked[0].select(F.substring("gram", 2, k).alias("gram")).distinct())
    p = None
    for k, (counts, here) in enumerate(zip(own, asked, strict=True), 1):
        less = _discount(discounts(counts))
        if p is None:
            total, spare, signs_ = counts.agg(F.sum("n"), F.sum(less), F.count(F.lit(1))).first()
            rest = (spare / total if total else 1.0) / (signs_ + 1)  # one more sign stands for all unknown ones
            seen = counts.select("gram", ((F.col("n") - less) / F.lit(float(total or 1))).alias("share"))
            p = cut(here.join(seen, "gram", "left").select("gram", (F.coalesce("share", F.lit(0.0)) + F.lit(rest)).alias("p")))
            continue
        context = F.substring("gram", 1, k - 1).alias("context")
        sums = cut(counts.groupBy(context).agg(F.sum("n").alias("total"), (F.sum(less) / F.sum("n")).alias("weight")))
        seen = counts.select("gram", context, (F.col("n") - less).alias("own")).join(sums, "context").select("gram", (F.col("own") / F.col("total")).alias("share"))
        found = here.select("gram", context, F.substring("gram", 2, k - 1).alias("low")).join(seen, "gram", "left").join(sums.select("context", "weight"), "context", "left")
        value = F.coalesce("share", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("p")
        p = cut(found.join(p.withColumnRenamed("gram", "low"), "low").select("gram", value.alias("p")))
    return p


# ---- scoring


def _pack(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    task, codec, number = TaskContext.get().partitionId(), pa.Codec("zstd", 9), 0
    ids: list = []
    langs: list = []
    texts: list[str] = []
    size = 0

    def block() -> pa.RecordBatch:
        raw = [t.encode() for t in texts]
        blob = codec.compress(b"".join(raw), asbytes=True)
        row = [(task << 32) + number], [ids], [langs], [[len(x) for x in raw]], [blob]
        types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], ["block", "doc_ids", "langs", "sizes", "texts"])

    for b in batches:
        for doc_id, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            text = text.as_py() or ""
            if texts and size + len(text) > limit:
                yield block()
                ids, langs, texts, size, number = [], [], [], 0, number + 1
            ids.append(doc_id)
            langs.append(lang)
            texts.append(text)
            size += len(text)
    if texts:
        yield block()


def _unpack(sizes: list[int], texts: bytes) -> list[str]:
    raw = pa.decompress(texts, sum(sizes), "zstd", asbytes=True) if sum(sizes) else b""
    ends = np.cumsum(sizes).tolist()
    return [raw[e - n : e].decode() for e, n in zip(ends, sizes, strict=True)]


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, gram: the distinct n-grams of each block."""
    for b in batches:
        for block, sizes, texts in zip(*(b.column(c).to_pylist() for c in ("block", "sizes", "texts")), strict=True):
            met: set[str] = set()
            for part in _joined(iter(_unpack(sizes, texts)), SLICE):
                for numbers, _, alphabet in slices(*signs(part)):
                    new = [g for g in spell(distinct(numbers)[0], alphabet) if g not in met]
                    met.update(new)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), block)), pa.array(new, pa.string())], ["block", "gram"])


def perplexities(texts: list[str], grams: np.ndarray, logs: np.ndarray) -> Iterator[float | None]:
    """Of each text, by the logarithms of its n-grams' probabilities; ``grams``: a row of code points for each, in order."""
    for part in _joined(iter(texts), SLICE):
        total = np.zeros(len(part))
        for numbers, at, alphabet in slices(*signs(part)):
            place = np.full(0x110000, -1)
            place[alphabet] = np.arange(len(alphabet))
            spelt = place[grams]
            here = np.flatnonzero((spelt >= 0).all(1))
            own = spelt[here] @ (len(alphabet) ** np.arange(ORDER - 1, -1, -1, dtype=np.int64))  # in order, as letters are
            some, back = np.unique(numbers, return_inverse=True)
            total += np.bincount(at, logs[here[np.searchsorted(own, some)]][back], len(part))
        yield from (float(np.exp(-x / len(t))) if t else None for x, t in zip(total, part, strict=True))


def _scored(block: pa.Table, answers: pa.Table) -> pa.Table:
    answers = answers.sort_by("gram")
    grams = np.frombuffer("".join(answers.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
    row = {c: block.column(c)[0].as_py() for c in ("doc_ids", "langs", "sizes", "texts")}
    texts = _unpack(row["sizes"], row["texts"])
    found = list(perplexities(texts, grams, answers.column("log_p").to_numpy().astype(np.float64)))
    out = pa.array(row["doc_ids"], pa.int64()), pa.array(row["langs"], pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(found, pa.float64())
    return pa.table(dict(zip(("doc_id", "lang", "n_chars", "perplexity"), out, strict=True)))


def score(docs: DataFrame, own: list[DataFrame], block: int = BLOCK) -> DataFrame:
    """doc_id, lang, n_chars, perplexity of every document (doc_id, lang, text) under the model of ``levels``."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    blocks = cut(rows.mapInArrow(lambda batches: _pack(batches, block), BLOCKS))
    release(docs.sparkSession)
    path = scratch(docs.sparkSession, "wanted")
    wanted = stored(blocks.mapInArrow(_wanted, "block long, gram string"), path)
    p = probabilities(cut(wanted.select("gram").distinct()), own)
    release(docs.sparkSession)
    answers = wanted.join(p, "gram").select("block", "gram", F.log("p").cast("float").alias("log_p"))
    found = cut(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: _scored(a, b), "doc_id long, lang string, n_chars long, perplexity double"))
    discard(docs.sparkSession, path)
    return found


def _held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % HELD_OUT == 0, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, lang, n_chars, perplexity, threshold, kept."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    good = labels.where("quality = 1").select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    good = cut(good.withColumn("held", _held_out(F.col("doc_id"))))
    sums = F.count(F.lit(1)), F.count_if(F.col("held"))
    n, n_held = good.agg(*sums).first()
    labelled = n > 0
    if not labelled:
        n, n_held = docs.select(_held_out(F.col("doc_id")).alias("held")).agg(*sums).first()

    def trusted(rows: DataFrame, held: bool) -> DataFrame:
        """The rows to train on, or those held out."""
        both = not 0 < n_held < n
        if not labelled:
            return rows if both else rows.where(_held_out(F.col("doc_id")) == F.lit(held))
        side = (good if both else good.where(F.col("held") == F.lit(held))).select("doc_id")
        return rows.join(F.broadcast(side) if n <= MAX_BROADCAST else side, "doc_id", "left_semi")

    scored = score(docs, levels(trusted(docs, False)), block)
    at = F.percentile_approx("perplexity", quantile, 10_000) * MARGIN
    own = trusted(scored, True).where("perplexity is not null")
    by_lang = cut(own.groupBy("lang").agg(at.alias("own")))
    overall = own.agg(at.alias("x")).first()["x"]
    found = scored.join(F.broadcast(by_lang) if by_lang.count() <= MAX_LANGS else by_lang, "lang", "left")
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    within = F.coalesce(F.col("perplexity") <= threshold, F.col("perplexity").isNotNull())
    return found.select("doc_id", "lang", "n_chars", "perplexity", threshold.alias("threshold"), within.alias("kept"))


def op9_quality_lm(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
