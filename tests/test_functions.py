import pytest
from pyspark.sql import functions as F

from helixspark.functions import alphabet as ab
from helixspark.functions import ranges
from helixspark.functions.alphabet import Alphabet, Symbol
from helixspark.functions.ranges import SearchRange


@pytest.mark.parametrize("alphabet", list(Alphabet))
def test_symbols_round_trip(alphabet):
    for c in alphabet.letters + alphabet.letters.lower():
        s = Symbol.new_ascii(alphabet, c)
        assert s.letter == c.upper() and Symbol.new_index(alphabet, s.index) == s == Symbol.new_bit_vector(alphabet, s.bit_vector)
    assert len({Symbol.new_ascii(alphabet, c).bit_vector for c in alphabet.letters}) == alphabet.cardinality == alphabet.num_encoding_symbols + 2
    assert Symbol.new_ascii(alphabet, "#").is_sentinel and str(Symbol.new_ascii(alphabet, "a")) == f"{alphabet} code A"
    assert Alphabet.from_id(alphabet.id) is alphabet
    with pytest.raises(ValueError):
        Symbol.new_index(alphabet, alphabet.cardinality)
    with pytest.raises(ValueError):
        Alphabet.from_id(2)


def test_folding(spark):
    texts = ["acguN$#-ßx", "ACDEFGHIKLMNPQRSTVWYbzX*", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for alphabet, want in ((Alphabet.NUCLEOTIDE, ["ACGTNNNNNN", "ACNNNGNNNNNNNNNNTNNNNNNN", "", None]), (Alphabet.AMINO, ["ACGXNXXXXX", "ACDEFGHIKLMNPQRSTVWYXXXX", "", None])):
        assert [r[0] for r in df.select(ab.fold(F.col("t"), alphabet)).collect()] == want
        assert [ab.fold_text(t, alphabet) for t in texts if t is not None] == want[:3]
    row = df.select(ab.symbol_of_char(F.lit("#"), Alphabet.AMINO), ab.is_sentinel(F.lit("$")), ab.described(F.lit("A"), Alphabet.AMINO)).first()
    assert list(row) == ["$", True, "amino code A"]


def test_ranges(spark):
    assert SearchRange.zero().is_empty() and len(SearchRange(999, 0)) == 0 and len(SearchRange(500, 499)) == 0
    assert list(SearchRange(3, 5)) == [3, 4, 5] and len(SearchRange(3, 5)) == 3
    df = spark.createDataFrame([(1, 0), (3, 5)], "a long, b long")
    got = df.select(ranges.range_length(F.col("a"), F.col("b")), ranges.range_rows(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0, []), (3, [3, 4, 5])]


def test_popcount(spark):
    word = 0b1011 | -(1 << 63)
    df = spark.range(64).select("id", ranges.masked_popcount(F.lit(word), F.col("id")).alias("n"), ranges.bit_of(F.array(F.lit(word)), F.col("id")).alias("bit"))
    bits = [(word >> i) & 1 for i in range(64)]
    assert [(r.n, r.bit) for r in df.orderBy("id").collect()] == [(sum(bits[: i + 1]), bits[i]) for i in range(64)]
