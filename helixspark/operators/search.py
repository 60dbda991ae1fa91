"""Counting and locating batches of exact patterns.

A few patterns are counted in one pass over the sequences, overlaps included. Larger
batches are joined with the text's windows on their first letters (the seed) and compared in full where
the seeds meet: a batch of bounded size is broadcast, so that neither windows nor places are shuffled, and
a larger one meets them in a shuffle. Places are listed by pattern, packed before they move, and each list
is made once for all queries of its pattern. Patterns without the ambiguity letter can't span two sequences and skip all
windows with it, which are the most frequent ones; patterns with it run over the text of all
sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.functions.alphabet import Alphabet, fold
from helixspark.operators.sequences import continued, windows
from helixspark.session import cut, ship

#: Letters of the seed; shorter patterns are their own seed.
SEED = 12
#: Up to so many distinct patterns, and letters of them, are counted by one pass without windows.
FEW, FEW_LETTERS = 64, 10_000
#: Patterns are broadcast up to so many, of so many letters together, and their queries' numbers up to so many (16 MB); beyond, they are shuffled.
MAX_PATTERNS, MAX_LETTERS, MAX_QUERIES = 200_000, 10_000_000, 2_000_000
#: Places that a task packs at once, and at most in one row.
PACKED, PACK = 2_000_000, 1024


def checked(queries: DataFrame, alphabet: Alphabet, max_query_len: int | None = None) -> DataFrame:
    """query_id, pattern folded. An empty, null or too long pattern and one with $ or # is an error."""
    bad = F.coalesce(F.col("pattern") == "", F.lit(True)) | F.col("pattern").rlike("[$#]")
    if max_query_len:
        bad = bad | (F.length("pattern") > max_query_len)
    pattern = F.when(bad, F.raise_error(F.concat(F.lit("invalid pattern: "), F.coalesce("pattern", F.lit("null"))))).otherwise(fold(F.col("pattern"), alphabet))
    return queries.select(F.col("query_id").cast("long").alias("query_id"), pattern.alias("pattern"))


def occurrences(sequences: DataFrame, patterns: DataFrame, alphabet: Alphabet, seed: int = SEED) -> DataFrame:
    """pattern, sequence_idx, local_position of every occurrence of the distinct folded ``patterns``.

    ``sequences``: folded, with seq_idx and seq. Overlapping occurrences count; a match that begins at
    the delimiter behind a sequence has the sequence's length as its position.
    """
    return _met(sequences, cut(patterns.select("pattern").distinct()), alphabet, "pattern", seed)


def _met(sequences: DataFrame, patterns: DataFrame, alphabet: Alphabet, column: str, seed: int = SEED) -> DataFrame:
    """``column`` of the distinct ``patterns``, which are cut, with sequence_idx and local_position of every occurrence."""
    patterns = patterns.withColumn("size", F.length("pattern")).withColumn("wide", F.contains("pattern", F.lit(alphabet.ambiguity)))
    kinds = patterns.groupBy("wide", F.least("size", F.lit(seed)).alias("seed")).agg(F.max("size").alias("longest"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("letters")).collect()
    few = sum(k["n"] for k in kinds) <= MAX_PATTERNS and sum(k["letters"] for k in kinds) <= MAX_LETTERS
    found = []
    for kind in kinds:  # at most twice as many as a seed has letters
        k = kind["seed"]
        text = continued(sequences, kind["longest"], alphabet) if kind["wide"] else sequences
        starts = windows(text, k, kind["longest"])
        if not kind["wide"]:
            starts = starts.where(~F.contains("kmer", F.lit(alphabet.ambiguity)))
        own = patterns.where((F.col("wide") == kind["wide"]) & (F.least("size", F.lit(seed)) == k)).select("pattern", F.substring("pattern", 1, k).alias("kmer"), F.col(column).alias("_own"))
        hits = starts.join(F.broadcast(own) if few else own, "kmer")
        hits = hits.where(F.startswith("rest", "pattern")) if kind["longest"] > k else hits
        found.append(hits.select(F.col("_own").alias(column), F.col("seq_idx").alias("sequence_idx"), F.col("pos").alias("local_position")))
    if not found:
        return patterns.select(column, F.lit(0).cast("long").alias("sequence_idx"), F.lit(0).cast("long").alias("local_position")).limit(0)
    return reduce(DataFrame.unionByName, found)


def locate(sequences: DataFrame, queries: DataFrame, alphabet: Alphabet, max_query_len: int | None = None) -> DataFrame:
    """query_id, sequence_idx, local_position; queries without a match have no row, repeated queries each their own."""
    asked = cut(checked(queries, alphabet, max_query_len))
    if asked.count() > MAX_QUERIES:
        return asked.join(occurrences(sequences, asked, alphabet), "pattern").select("query_id", "sequence_idx", "local_position")
    nulls = F.count_if(F.col("query_id").isNull()).cast("int")
    ids = F.concat(F.collect_list("query_id"), F.array_repeat(F.lit(None).cast("long"), nulls))
    found = _met(sequences, cut(asked.groupBy("pattern").agg(ids.alias("ids"))), alphabet, "ids")
    return found.select(F.explode("ids").alias("query_id"), "sequence_idx", "local_position")


def _few(patterns: DataFrame) -> list[str] | None:
    """The distinct patterns, if they are few and short."""
    n, letters = patterns.agg(F.count(F.lit(1)), F.sum(F.length("pattern"))).first()
    return [r.pattern for r in patterns.collect()] if n <= FEW and (letters or 0) <= FEW_LETTERS else None


def hits(text: Column, pattern: str) -> Column:
    """How often a folded pattern begins in a folded text, overlaps included: by how many letters the text loses.

    A pattern of one repeated letter takes the surplus of each run; one that can't overlap itself is taken
    out whole, without a regular expression; of any other the first letter goes.
    """
    size, first = len(pattern), pattern[0]
    if pattern == first * size:
        left, each = F.regexp_replace(text, f"{first}{{{size},}}", first * (size - 1)), 1
    elif not any(pattern.startswith(pattern[k:]) for k in range(1, size)):
        left, each = F.replace(text, F.lit(pattern), F.lit("")), size
    else:
        left, each = F.regexp_replace(text, f"{first}(?={pattern[1:]})", ""), 1
    return ((F.octet_length(text) - F.octet_length(left)) / each).cast("long")


def count_few(sequences: DataFrame, patterns: list[str], alphabet: Alphabet) -> DataFrame:
    """pattern, k: the occurrences of each. One pass counts within sequences and keeps their ends for patterns that may span some."""
    sums = lambda counted: [F.sum(c).alias(f"p{i}") for i, c in enumerate(counted)]
    wide = [p for p in patterns if alphabet.ambiguity in p]
    inside = [hits(F.col("seq"), p) for p in patterns]
    if not wide:
        found = dict(zip(patterns, sequences.agg(*sums(inside)).first(), strict=True)) if patterns else {}
    else:  # a match that isn't inside a sequence begins in its last letters or at the delimiter behind it
        longest = max(map(len, wide))
        ends = F.expr(f"left(seq, {longest})").alias("seq"), F.expr(f"right(seq, {longest - 1})").alias("end")
        rows = cut(sequences.select("seq_idx", *ends, *[c.alias(f"p{i}") for i, c in enumerate(inside)]))
        found = dict(zip(patterns, rows.agg(*[F.sum(f"p{i}") for i in range(len(patterns))]).first(), strict=True))
        spans = continued(rows.select("seq_idx", "seq", "end"), longest, alphabet)
        over = spans.agg(*sums(hits(F.concat(F.expr(f"right(end, {len(p) - 1})"), F.expr(f"left(tail, {len(p)})")), p) for p in wide)).first()
        found |= {p: (found[p] or 0) + (n or 0) for p, n in zip(wide, over, strict=True)}
    return sequences.sparkSession.createDataFrame([(p, k or 0) for p, k in found.items()], "pattern string, k long")


def count(sequences: DataFrame, queries: DataFrame, alphabet: Alphabet, max_query_len: int | None = None) -> DataFrame:
    """query_id, n for every query, 0 included. Occurrences are summed up by pattern before they meet the queries."""
    asked = cut(checked(queries, alphabet, max_query_len))
    few = _few(asked.select("pattern").distinct())
    sums = occurrences(sequences, asked, alphabet).groupBy("pattern").agg(F.count(F.lit(1)).alias("k")) if few is None else F.broadcast(count_few(sequences, few, alphabet))
    return asked.join(sums, "pattern", "left").select("query_id", F.coalesce("k", F.lit(0).cast("long")).alias("n"))


def locate_lists(sequences: DataFrame, queries: DataFrame, alphabet: Alphabet, max_query_len: int | None = None) -> DataFrame:
    """query_id, locations (sorted structs) for every query; an empty list where there are none."""
    found = lists_by_pattern(sequences, queries, alphabet, max_query_len)
    return found.select(F.explode("ids").alias("query_id"), "locations")


def lists_by_pattern(sequences: DataFrame, queries: DataFrame, alphabet: Alphabet, max_query_len: int | None = None) -> DataFrame:
    """ids (of all queries of a pattern), locations (sorted structs, none if it has no match) for every distinct pattern."""
    ship(queries.sparkSession)
    asked = cut(checked(queries, alphabet, max_query_len))
    patterns = cut(asked.select("pattern").distinct().withColumn("code", F.monotonically_increasing_id()))
    places = _met(sequences, patterns, alphabet, "code").mapInArrow(_pack, PACKED_ROWS)
    many = patterns.count() > MAX_PATTERNS
    asks = asked.join(patterns if many else F.broadcast(patterns), "pattern")
    asks = asks.select("code", "query_id", F.lit(0).cast("long").alias("first"), F.lit(None).cast("binary").alias("pack"))
    rows = places.unionByName(asks).repartition("code").sortWithinPartitions("code")
    return rows.mapInArrow(_listed, "ids array<long>, locations array<struct<sequence_idx: bigint, local_position: bigint>>")


PACKED_ROWS = "code long, query_id long, first long, pack binary"


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number below 2 ** 63 in bytes of seven bits, low ones first, all but its last with the high bit; and where each begins."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= 1 << 7 * k
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(size.max(initial=0)):
        some = np.flatnonzero(size > k)
        out[ends[some] - size[some] + k] = (values[some] >> 7 * k) & 127 | np.where(k + 1 < size[some], 128, 0)
    return out, ends - size


def from_varints(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    out = (data[starts] & 127).astype(np.int64)
    for k in range(1, int((ends - starts).max(initial=0)) + 1):
        some = np.flatnonzero(ends - starts >= k)
        out[some] |= (data[starts[some] + k] & 127).astype(np.int64) << 7 * k
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places as rows of one pattern each: the first sequence, then for each place how far the sequence is on, and the position."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        code, seq, pos = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
        order = np.lexsort((seq, code))
        code, seq, pos = code[order], seq[order], pos[order]
        at = np.arange(len(code))
        new = np.concatenate([[True], code[1:] != code[:-1]])
        new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % PACK == 0
        step = np.where(new, 0, np.diff(seq, prepend=0))
        data, starts = varints(np.stack([step, pos], 1).ravel())
        edges = np.append(starts[::2][new], len(data)).astype(np.int32)
        packs = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pa.array(code[new]), pa.nulls(len(packs), pa.int64()), pa.array(seq[new]), packs], ["code", "query_id", "first", "pack"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= PACKED:
            yield packed(held)
            held, n = [], 0
    if n:
        yield packed(held)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ids, locations of each code, from rows in the order of their codes."""

    def listed(rows: pa.Table) -> pa.RecordBatch:
        code, packs = rows.column("code").to_numpy(), rows.column("pack").combine_chunks()
        asks = packs.is_null().to_numpy(zero_copy_only=False)
        codes, group = np.unique(code, return_inverse=True)
        ids = rows.column("query_id").combine_chunks().filter(pa.array(asks))
        edges = np.searchsorted(group[asks], np.arange(len(codes) + 1)).astype(np.int32)
        group, first, packs = group[~asks], rows.column("first").to_numpy()[~asks], packs.filter(pa.array(~asks))
        size = pc.binary_length(packs).to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(packs.to_pylist()), np.uint8)
        step, pos = from_varints(data).reshape(-1, 2).T
        # how many numbers end before each row's bytes begin
        done = np.concatenate([[0], np.cumsum(data < 128)])[np.cumsum(size) - size] // 2
        n = np.diff(np.append(done, len(step)))
        far = np.cumsum(step)
        seq = far + np.repeat(first - (far[done] if len(done) else far[:0]), n)
        group = np.repeat(group, n)
        order = np.lexsort((pos, seq, group))
        places = pa.StructArray.from_arrays([pa.array(seq[order]), pa.array(pos[order])], ["sequence_idx", "local_position"])
        ends = np.searchsorted(group, np.arange(len(codes) + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(edges), ids), pa.ListArray.from_arrays(pa.array(ends), places)], ["ids", "locations"])

    held: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        t, last = pa.Table.from_batches([batch]), batch.column(0)[len(batch) - 1].as_py()
        k = int(np.searchsorted(batch.column(0).to_numpy(), last))
        if k or held and held[0].column("code")[0].as_py() != last:
            yield listed(pa.concat_tables([*held, t.slice(0, k)]))
            held = []
        held.append(t.slice(k))
    if held:
        yield listed(pa.concat_tables(held))
