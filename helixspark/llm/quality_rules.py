"""Quality rules: per-document counts, then verdicts on hosts.

Rule failures are added up by host. A host's failure rate is shrunk towards all hosts by a beta
prior fitted to their rates by moments, without what sampling adds to their spread, so that small
hosts aren't condemned on few documents. A host whose own and shrunk rates exceed a threshold loses
all its documents; the base rules drop single ones.

Defined results: null text counts as empty and fails; a null host counts as the empty one;
repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm import words
from helixspark.llm.skew import join_hot
from helixspark.llm.text import named
from helixspark.session import cut, ship, table

WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
#: A document fails the further rules beyond this share of symbols in its word characters, or of repeated lines in its lines.
MAX_SYMBOLS, MAX_DUP_LINES = 0.1, 0.3
#: A host is dropped when its failure rate exceeds this, both its own and the shrunk one.
HOST_RATE = 0.5
#: The documents that the prior weighs: so many at least, lest a few documents condemn a host, and at most.
LEAST_STRENGTH, MOST_STRENGTH = 10.0, 1000.0
#: The table of dropped hosts is broadcast up to so many rows, joined by a shuffle without hot keys beyond.
MAX_BROADCAST = 200_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER = np.ones(256, bool)
_LETTER[[9, 10, 11, 12, 13, 32, *range(0x80, 0xC0)]] = False
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def repeated_words(h: np.ndarray, at: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """For each document the words in windows of ``size`` words that it holds twice or more."""
    runs = words.windows(h, size)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = doc[: len(runs)] == doc[size - 1 : size - 1 + len(runs)]
    first = np.flatnonzero(whole)
    key = words.mix(runs[first] ^ words.mix(doc[first].astype(np.uint64) + np.uint64(1)))
    _, inv, n = np.unique(key, return_inverse=True, return_counts=True)
    twice = first[n[inv] > 1]
    change = np.zeros(len(h) + size + 1, np.int64)
    change[twice] += 1
    change[twice + size] -= 1
    return _sums(np.cumsum(change)[: len(h)] > 0, at)


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of the documents between ``offsets``."""
    base, raw = int(offsets[0]), data[offsets[0] : offsets[-1]]
    h, at = words.hashes(data, offsets, False)
    lines = [[x for x in raw[a:b].tobytes().split(b"\n") if x.strip()] for a, b in zip(offsets[:-1] - base, offsets[1:] - base, strict=True)]
    return {
        "n_words": np.diff(at),
        "word_chars": _sums(_LETTER[raw], offsets - base),
        "n_symbols": _sums(_SYMBOL[raw], offsets - base),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_lines": np.array([len(x) for x in lines], np.int64),
        "n_repeat_words": repeated_words(h, at),
    }


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = words.buffers(batch.column(2))
        for i, j in words.slices(offsets):
            found = counts(data, offsets[i : j + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *(pa.array(found[c]) for c in COUNTS)], ["doc_id", "host", *COUNTS])


def host_rates(judged: DataFrame) -> DataFrame:
    """host, n, failures, rate (shrunk by the beta prior) from rows with host and failed."""
    hosts = cut(judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failures")))
    n, k, squares, groups = hosts.agg(F.sum("n"), F.sum("failures"), F.sum(F.col("n").cast("double") * F.col("n")), F.count(F.lit(1))).first()
    m = min(max((k or 0) / (n or 1), 1e-3), 1 - 1e-3)
    spread = hosts.agg(F.sum(F.col("n") * F.pow(F.col("failures") / F.col("n") - m, F.lit(2)))).first()[0]
    strength = prior_strength(m, n or 0, squares or 0, groups, spread or 0)
    return hosts.withColumn("rate", (F.col("failures") + m * strength) / (F.col("n") + strength))


def prior_strength(m: float, n: int, squares: float, groups: int, spread: float) -> float:
    """How many documents the prior weighs, by moments of the beta-binomial distribution.

    ``spread`` is the sum of n (rate - m)^2 over hosts. What sampling alone would give, (groups - 1) m (1 - m),
    is taken out; only what is left tells how much hosts differ.
    """
    sampling = m * (1 - m) * (groups - 1)
    room = m * (1 - m) * (n - squares / n - (groups - 1)) if n else 0.0
    alike = (spread - sampling) / room if room > 1e-9 else 0.0
    return min(max(1 / alike - 1, LEAST_STRENGTH), MOST_STRENGTH) if alike > 0 else MOST_STRENGTH


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, rules_failed, host_rate_failed, kept."""
    ship(docs.sparkSession)
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(host_col).cast("string"), F.lit("")).alias("host"), named(text_col).alias("text"))
    rows = rows.mapInArrow(_counted, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    more = base | (F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars")) | (F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"))
    judged = cut(rows.withColumn("base_failed", base).withColumn("failed", more))
    over = (F.col("rate") > host_rate) & (F.col("failures") > host_rate * F.col("n"))
    bad = cut(host_rates(judged).where(over).select("host", F.lit(True).alias("bad")))
    found = judged.join(F.broadcast(bad), "host", "left") if bad.count() <= MAX_BROADCAST else join_hot(judged, bad, ["host"], "left")
    bad_host = F.coalesce("bad", F.lit(False))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed").alias("rules_failed"), bad_host.alias("host_failed"), (~F.col("base_failed") & ~bad_host).alias("kept"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
with t as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents),
d as (select doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
win as (select doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) as h from d, unnest(range(1, len(w) - {WINDOW - 2})) as x(i)),
twice as (select doc_id, i from win qualify count(*) over (partition by doc_id, h) > 1),
rep as (select doc_id, count(distinct i + j) as n from twice, unnest(range(0, {WINDOW})) as y(j) group by doc_id),
c as (select doc_id, host, len(w) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
             len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines, coalesce(rep.n, 0) as n_repeat_words from d left join rep using (doc_id)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words as base_failed from c),
f as (select *, base_failed or n_symbols > {MAX_SYMBOLS}::double * word_chars or n_dup_lines > {MAX_DUP_LINES}::double * n_lines as rules_failed from b),
h as (select host, count(*) as n, sum(rules_failed::int) as k from f group by host),
t0 as (select least(greatest(sum(k) / sum(n), 1e-3), 1 - 1e-3) as m, sum(n) as total, sum(n::double * n) as squares, count(*) as hosts from h),
t1 as (select m, sum(n * pow(k / n - m, 2)) - m * (1 - m) * (any_value(hosts) - 1) as above, m * (1 - m) * (any_value(total) - any_value(squares) / any_value(total) - (any_value(hosts) - 1)) as room from h, t0 group by m),
s as (select m, case when room > 1e-9 and above > 0 then least(greatest(room / above - 1, {LEAST_STRENGTH}), {MOST_STRENGTH}) else {MOST_STRENGTH} end as strength from t1),
bad as (select host from h, s where (k + m * strength) / (n + strength) > {HOST_RATE} and k > {HOST_RATE} * n)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed, rules_failed,
       host in (select host from bad) as host_failed, not base_failed and host not in (select host from bad) as kept from f
"""
