"""Suffix array, Burrows-Wheeler transform and rank tables as DataFrames.

All tables are distributed: suffixes are ranked by prefix doubling over range-partitioned sorts, and
ranks are read off milestones at the starts of blocks plus a count inside one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.functions.alphabet import SENTINEL, Alphabet, index_of
from helixspark.operators import bounded
from helixspark.operators.ordered import global_rank
from helixspark.operators.sequences import continued, last_sequence, sequence_index, windows
from helixspark.session import cut, release, scratch, stored

#: Letters that the first ranking compares, and rows between milestones.
FIRST, BLOCK = 16, 256
#: Bounded suffixes of so many letters at most are sorted by all of them at once.
SHORT = 64


def suffix_array(sequences: DataFrame, alphabet: Alphabet, max_query_len: int | None = None) -> DataFrame:
    """row, pos: all positions of the text, the sentinel's included, in the order of their suffixes.

    With ``max_query_len`` only so many letters are compared, and ties go by position; up to SHORT letters
    are compared in one sort, or as far as they fit in 96 bits without a shuffle of positions.
    """
    if max_query_len and bounded.fits(alphabet, max_query_len):
        found = bounded.by_first_letters(sequences, alphabet, max_query_len)
        if found is not None:
            return found
    if max_query_len and max_query_len <= SHORT:
        return _by_first_letters(sequences, alphabet, max_query_len)
    first = min(FIRST, max_query_len or FIRST)
    ranked = _starts(sequences, alphabet, first)
    ranked, h = cut(global_rank(ranked, ["key"], "rank").select("pos", "rank")), first
    n = ranked.count()
    while (not max_query_len or h < max_query_len) and ranked.select("rank").distinct().count() < n:
        after = ranked.select((F.col("pos") - h).alias("pos"), F.col("rank").alias("next"))
        pairs = ranked.join(after, "pos", "left").select("pos", "rank", F.coalesce("next", F.lit(-1).cast("long")).alias("next"))
        ranked, h = cut(global_rank(pairs, ["rank", "next"], "r").select("pos", F.col("r").alias("rank"))), 2 * h
    if max_query_len:
        ranked = global_rank(ranked, ["rank", "pos"], "r").select("pos", F.col("r").alias("rank"))
    return ranked.select(F.col("rank").alias("row"), "pos")


def _starts(sequences: DataFrame, alphabet: Alphabet, letters: int) -> DataFrame:
    """pos, key of all positions: up to so many letters from there. Texts get their starts before they are taken apart."""
    index = sequence_index(sequences.withColumn("header", F.lit("")))
    last = last_sequence(sequences)
    ended = sequences.select("seq_idx", F.when(F.col("seq_idx") == last, F.concat("seq", F.lit(SENTINEL))).otherwise(F.col("seq")).alias("seq"))
    text = continued(ended, letters, alphabet).join(index.select("seq_idx", "start_position"), "seq_idx")
    starts = windows(text.select(F.col("start_position").alias("seq_idx"), "seq", "tail"), 1, letters)
    return starts.select((F.col("seq_idx") + F.col("pos")).alias("pos"), F.col("rest").alias("key"))


def _by_first_letters(sequences: DataFrame, alphabet: Alphabet, letters: int) -> DataFrame:
    """row, pos by so many letters, then by position: one sort, of which only the positions are stored, in order."""
    spark = sequences.sparkSession
    rows = _starts(sequences, alphabet, letters)
    if alphabet.cardinality < 15:  # two letters a byte; what ends early is smaller than all that goes on
        digits = F.translate("key", alphabet.letters, "123456789abcdef"[: alphabet.cardinality])
        rows = rows.select("pos", F.unhex(F.rpad(digits, letters + letters % 2, "0")).alias("key"))
    placed = rows.repartitionByRange("key", "pos").sortWithinPartitions("key", "pos").select("pos", F.monotonically_increasing_id().alias("at"))
    placed = stored(placed, scratch(spark, "suffixes"))
    release(spark)
    part = F.shiftright("at", 33)  # the number of a partition is above the 33 bits of a row's number in it
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    rows = placed.select("pos", part.alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("own"))
    return rows.join(F.broadcast(before), "part").select((F.col("before") + F.col("own")).cast("long").alias("row"), "pos")


def bwt(array: DataFrame, letters: DataFrame) -> DataFrame:
    """row, pos, bwt: the letter before each suffix, the sentinel before the first."""
    before = letters.where(F.col("symbol") != SENTINEL).select((F.col("pos") + 1).alias("pos"), F.col("symbol").alias("bwt"))
    return array.join(before, "pos", "left").select("row", "pos", F.coalesce("bwt", F.lit(SENTINEL)).alias("bwt"))


def symbol_counts(table: DataFrame) -> DataFrame:
    return table.groupBy(F.col("bwt").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


def prefix_sums(table: DataFrame, alphabet: Alphabet) -> DataFrame:
    """idx, c: how many letters are smaller; one more row holds the length. Absent symbols have a row."""
    spark = table.sparkSession
    every = spark.createDataFrame([(i, c) for i, c in enumerate(alphabet.letters)] + [(alphabet.cardinality, "")], "idx long, symbol string")
    n = F.coalesce("n", F.lit(0).cast("long"))
    sums = F.sum(n).over(W.orderBy("idx")) - n
    return every.join(F.broadcast(symbol_counts(table)), "symbol", "left").select("idx", sums.cast("long").alias("c"))


def with_c(table: DataFrame, sums: DataFrame, alphabet: Alphabet, symbol: str) -> DataFrame:
    """``table`` with c of its symbol; the sums have one row for each symbol of the alphabet."""
    return table.withColumn("_idx", index_of(F.col(symbol), alphabet)).join(F.broadcast(sums.withColumnRenamed("idx", "_idx")), "_idx").drop("_idx")


def milestones(table: DataFrame, alphabet: Alphabet, block: int = BLOCK) -> DataFrame:
    """block, symbol, cnt: how often each symbol stands before the block's first row.

    Sums run over groups of blocks, whose totals are accumulated apart.
    """
    own = table.groupBy(F.floor(F.col("row") / block).cast("long").alias("block"), F.col("bwt").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    blocks = own.select("block").distinct().select("block", F.explode(F.array(*[F.lit(c) for c in alphabet.letters])).alias("symbol"))
    own = blocks.join(own, ["block", "symbol"], "left").na.fill(0, ["n"]).withColumn("_far", F.shiftright("block", 12))
    totals = own.groupBy("_far", "symbol").agg(F.sum("n").alias("_n"))
    before = totals.select("_far", "symbol", (F.sum("_n").over(W.partitionBy("symbol").orderBy("_far")) - F.col("_n")).alias("_before"))
    near = F.sum("n").over(W.partitionBy("_far", "symbol").orderBy("block")) - F.col("n")
    return own.withColumn("_near", near).join(before, ["_far", "symbol"]).select("block", "symbol", (F.col("_near") + F.col("_before")).cast("long").alias("cnt"))


def rank_occurrence(points: DataFrame, table: DataFrame, marks: DataFrame, block: int = BLOCK) -> DataFrame:
    """``points`` (p, symbol and others) with occ: how often the symbol stands in rows 0 to p. Rows before 0 give 0."""
    asked = points.withColumn("_block", F.floor(F.col("p") / block).cast("long"))
    keys = asked.select("p", "symbol", "_block").distinct().where("p >= 0")
    inside = keys.join(table.select(F.floor(F.col("row") / block).cast("long").alias("_block"), "row", F.col("bwt").alias("symbol")), ["_block", "symbol"]).where("row <= p")
    inside = inside.groupBy("p", "symbol").agg(F.count(F.lit(1)).alias("_in"))
    known = keys.join(marks.withColumnRenamed("block", "_block"), ["_block", "symbol"]).join(inside, ["p", "symbol"], "left")
    known = known.select("p", "symbol", (F.col("cnt") + F.coalesce("_in", F.lit(0))).cast("long").alias("occ"))
    return asked.join(known, ["p", "symbol"], "left").withColumn("occ", F.coalesce("occ", F.lit(0).cast("long"))).drop("_block")


def lf_mapping(table: DataFrame, sums: DataFrame, marks: DataFrame, alphabet: Alphabet, block: int = BLOCK) -> DataFrame:
    """row, pos, lf: the row of the suffix that begins one letter earlier; 0 from the sentinel."""
    rows = table.withColumn("block", F.floor(F.col("row") / block).cast("long")).withColumnRenamed("bwt", "symbol")
    inside = F.row_number().over(W.partitionBy("block", "symbol").orderBy("row")) - 1
    rows = with_c(rows.withColumn("_in", inside).join(marks, ["block", "symbol"]), sums, alphabet, "symbol")
    lf = F.when(F.col("symbol") == SENTINEL, F.lit(0).cast("long")).otherwise((F.col("c") + F.col("cnt") + F.col("_in")).cast("long"))
    return rows.select("row", "pos", lf.alias("lf"))


def sampled(array: DataFrame, ratio: int) -> DataFrame:
    """The rows of the suffix array whose number is a multiple of ``ratio``."""
    return array.where(F.col("row") % ratio == 0)


def reconstruct(lf: DataFrame, kept: DataFrame, length: int) -> DataFrame:
    """row, pos of all rows from the kept ones: walks along lf to a kept row, and adds the steps.

    Every round joins each walk with the walk that begins where it ends, so its length doubles.
    """
    walks = lf.select("row", F.col("lf").alias("to")).join(kept.select("row", F.col("pos").alias("known")), "row", "left")
    walks = cut(walks.select("row", F.when(F.col("known").isNotNull(), F.col("row")).otherwise(F.col("to")).alias("to"), F.when(F.col("known").isNotNull(), 0).otherwise(1).cast("long").alias("steps"), "known"))
    for _ in range(length.bit_length() + 1):
        if walks.where("known is null").isEmpty():
            break
        ahead = walks.select(F.col("row").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"), F.col("known").alias("there"))
        walks = cut(walks.join(ahead, "to").select("row", F.when(F.col("known").isNotNull(), F.col("to")).otherwise(F.col("far")).alias("to"), F.when(F.col("known").isNotNull(), F.col("steps")).otherwise(F.col("steps") + F.col("more")).alias("steps"), F.coalesce("known", "there").alias("known")))
    return walks.select("row", ((F.col("known") + F.col("steps")) % length).alias("pos"))


def initial_ranges(sums: DataFrame, alphabet: Alphabet) -> DataFrame:
    """symbol, start_ptr, end_ptr: the rows whose suffixes begin with each symbol."""
    ends = F.lead("c").over(W.orderBy("idx")) - 1
    symbol = F.substring(F.lit(alphabet.letters), F.col("idx").cast("int") + 1, F.lit(1))
    found = sums.select("idx", symbol.alias("symbol"), F.col("c").alias("start_ptr"), ends.alias("end_ptr")).where("end_ptr is not null")
    return found.select("symbol", *_canonical(F.col("start_ptr"), F.col("end_ptr")))


def _canonical(start: Column, end: Column) -> list[Column]:
    """Every empty range is (1, 0)."""
    none = start > end
    return [F.when(none, 1).otherwise(start).cast("long").alias("start_ptr"), F.when(none, 0).otherwise(end).cast("long").alias("end_ptr")]


def extend_ranges(ranges: DataFrame, table: DataFrame, marks: DataFrame, sums: DataFrame, alphabet: Alphabet) -> DataFrame:
    """``ranges`` (range_id, start_ptr, end_ptr, symbol) extended by a letter on the left: one backward search step."""
    both = ranges.select("range_id", "symbol", F.posexplode(F.array(F.col("start_ptr") - 1, F.col("end_ptr"))).alias("side", "p"))
    occ = rank_occurrence(both, table, marks).groupBy("range_id", "symbol").agg(F.max(F.when(F.col("side") == 0, F.col("occ"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("occ"))).alias("high"))
    return with_c(occ, sums, alphabet, "symbol").select("range_id", "symbol", *_canonical(F.col("c") + F.col("low"), F.col("c") + F.col("high") - 1))


def kmer_ranges(sequences: DataFrame, array: DataFrame, k: int, alphabet: Alphabet) -> DataFrame:
    """kmer, start_ptr, end_ptr of every k-mer of plain letters that occurs."""
    if k < 1:
        raise ValueError("k must be at least 1")
    starts = windows(sequences, k).where(~F.contains("kmer", F.lit(alphabet.ambiguity)))
    return pattern_rows(starts.select(F.col("seq_idx").alias("sequence_idx"), F.col("pos").alias("local_position"), F.col("kmer")), sequences, array, ["kmer"])


def pattern_rows(hits: DataFrame, sequences: DataFrame, array: DataFrame, by: list[str]) -> DataFrame:
    """The range of suffix rows of the occurrences of each key."""
    index = sequence_index(sequences.withColumn("header", F.lit(""))).select(F.col("seq_idx").alias("sequence_idx"), "start_position")
    at = hits.join(index, "sequence_idx").select(*by, (F.col("start_position") + F.col("local_position")).alias("pos"))
    return at.join(array, "pos").groupBy(*by).agg(F.min("row").alias("start_ptr"), F.max("row").alias("end_ptr"))
