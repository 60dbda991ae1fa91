"""The sequence collection: folding, start positions, letters by position, and windows of letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.functions.alphabet import SENTINEL, Alphabet, fold
from helixspark.operators.ordered import as_of, running_sum
from helixspark.session import cut

#: Letters in a piece of a sequence whose windows are taken apart together. ``substring`` counts
#: characters from the start, so windows of whole sequences would take quadratic time, and so would
#: pieces that are cut out one by one.
CHUNK = 256


def folded(sequences: DataFrame, alphabet: Alphabet) -> DataFrame:
    """seq_idx, header, seq with canonical letters; null counts as empty."""
    return sequences.select("seq_idx", "header", fold(F.coalesce("seq", F.lit("")), alphabet).alias("seq"))


def sequence_index(sequences: DataFrame) -> DataFrame:
    """seq_idx, header, start_position, length: where each sequence starts in the text of all, with a delimiter between two."""
    rows = sequences.select("seq_idx", "header", F.length("seq").cast("long").alias("length"))
    return running_sum(rows, "seq_idx", F.col("length") + 1, "start_position").select("seq_idx", "header", "start_position", "length")


def last_sequence(sequences: DataFrame) -> int:
    """The greatest number; -1 if there are no sequences."""
    found = sequences.agg(F.max("seq_idx")).first()[0]
    return -1 if found is None else found


def continued(sequences: DataFrame, letters: int, alphabet: Alphabet) -> DataFrame:
    """``sequences`` with tail: what follows each sequence in the text of all, ``letters`` letters at most.

    Numbers may have gaps: sequences are counted in their order first. Each round doubles how many
    sequences a tail reaches over, by an equi-join on the place in that order.
    """
    last = last_sequence(sequences)
    heads = sequences.select("seq_idx", F.expr(f"left(concat(seq, if(seq_idx = {last}L, '', '{alphabet.ambiguity}')), {letters})").alias("head"))
    heads, step = cut(running_sum(heads, "seq_idx", F.lit(1), "place")), 1
    n = heads.count()
    while step < n and step < letters:
        after = heads.select((F.col("place") - step).alias("place"), F.col("head").alias("more"))
        short = heads.where(F.length("head") < letters)
        if short.where(F.col("place") + step < n).isEmpty():
            break
        heads = cut(heads.join(after, "place", "left").select("seq_idx", "place", F.expr(f"left(concat(head, coalesce(more, '')), {letters})").alias("head")))
        step *= 2
    after = heads.select((F.col("place") - 1).alias("place"), F.col("head").alias("more"))
    tail = F.expr(f"if(seq_idx = {last}L, '', left(concat('{alphabet.ambiguity}', coalesce(more, '')), {letters}))")
    tails = heads.select("seq_idx", "place").join(after, "place", "left").select("seq_idx", tail.alias("tail"))
    return sequences.join(tails, "seq_idx")


def windows(sequences: DataFrame, size: int, longest: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """seq_idx, pos, kmer (``size`` letters from there), rest (up to ``longest`` letters from there) for every start.

    ``sequences``: seq_idx, seq, and where windows may run on beyond the end, tail. Starts lie in the
    sequence or on the delimiter behind it; windows that end early are left out.
    """
    longest = max(size, longest or size)
    tail = F.col("tail") if "tail" in sequences.columns else F.lit("")
    text = sequences.select("seq_idx", F.concat("seq", tail).alias("text"), F.length(F.concat("seq", F.substring(tail, 1, 1))).alias("own"))
    text = text.withColumn("n", F.least(F.col("own"), F.length("text") - size + 1)).where("n > 0")
    # one pass cuts the text into chunks; each then gets the letters that its last windows need from the next
    chunk = max(chunk, longest)
    text = text.select("seq_idx", "n", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("chunks"))
    joined = F.transform("chunks", lambda c, i: F.concat(c, F.coalesce(F.substring(F.get("chunks", i + 1), 1, longest - 1), F.lit(""))))
    pieces = text.select("seq_idx", "n", F.posexplode(joined).alias("piece", "part")).where(F.col("piece") * chunk < F.col("n"))
    pieces = pieces.select("seq_idx", (F.col("piece") * chunk).alias("at"), F.least(F.lit(chunk), F.col("n") - F.col("piece") * chunk).alias("n"), "part")
    starts = pieces.select("seq_idx", "at", "part", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i"))
    return starts.select("seq_idx", (F.col("at") + F.col("i")).cast("long").alias("pos"), F.substring("part", F.col("i") + 1, F.lit(size)).alias("kmer"), F.substring("part", F.col("i") + 1, F.lit(longest)).alias("rest"))


def letters(sequences: DataFrame, alphabet: Alphabet) -> DataFrame:
    """pos, symbol of the text of all sequences: delimiters between them and the sentinel at the end."""
    index = sequence_index(sequences.withColumn("header", F.lit("")))
    last = last_sequence(sequences)
    end = F.when(F.col("seq_idx") == F.lit(last), SENTINEL).otherwise(alphabet.ambiguity)
    ended = sequences.select("seq_idx", F.concat("seq", end).alias("seq"))
    return windows(ended, 1).join(index.select("seq_idx", "start_position"), "seq_idx").select((F.col("start_position") + F.col("pos")).alias("pos"), F.col("kmer").alias("symbol"))


def localize(positions: DataFrame, index: DataFrame, position: str = "pos") -> DataFrame:
    """``positions`` with sequence_idx and local_position: by the greatest start at or before each."""
    found = as_of(positions, position, index.select(F.col("seq_idx").alias("sequence_idx"), "start_position"), "start_position")
    return found.withColumn("local_position", F.col(position) - F.col("start_position")).drop("start_position")
