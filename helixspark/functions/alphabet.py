"""The nucleotide and amino alphabets, symbols, and their column functions."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SENTINEL = "$"
# Letters in index order, and their bit codes.
_LETTERS = {"nucleotide": "$ACGNT", "amino": "$ACDEFGHIKLMNPQRSTVWXY"}
_CODES = {
    "nucleotide": {"$": 0b100, "A": 0b110, "C": 0b101, "G": 0b011, "N": 0b010, "T": 0b001},
    "amino": {
        "$": 0b00000, "A": 0b01100, "C": 0b10111, "D": 0b00011, "E": 0b00110, "F": 0b11110, "G": 0b11010, "H": 0b11011, "I": 0b11001, "K": 0b10101, "L": 0b11100,
        "M": 0b11101, "N": 0b01000, "P": 0b01001, "Q": 0b00100, "R": 0b10011, "S": 0b01010, "T": 0b00101, "V": 0b10110, "W": 0b00001, "X": 0b11111, "Y": 0b00010,
    },
}


class Alphabet(Enum):
    """Closed set of alphabets; ids 0 and 1."""

    NUCLEOTIDE = "nucleotide"
    AMINO = "amino"

    def __str__(self) -> str:
        return self.value

    @property
    def id(self) -> int:
        return list(Alphabet).index(self)

    @classmethod
    def from_id(cls, n: int) -> Alphabet:
        if n not in (0, 1):
            raise ValueError(f"no alphabet has the id {n}")
        return list(cls)[n]

    @property
    def letters(self) -> str:
        """Canonical letters in index order, which is also ASCII order."""
        return _LETTERS[self.value]

    @property
    def cardinality(self) -> int:
        return len(self.letters)

    @property
    def num_encoding_symbols(self) -> int:
        """Without the sentinel and the ambiguity letter."""
        return self.cardinality - 2

    @property
    def ambiguity(self) -> str:
        """What unknown letters fold to; also stands between sequences."""
        return "N" if self is Alphabet.NUCLEOTIDE else "X"

    @property
    def plain(self) -> str:
        """The letters that are neither sentinel nor ambiguity."""
        return self.letters.replace(SENTINEL, "").replace(self.ambiguity, "")

    @property
    def default_kmer(self) -> int:
        return 10 if self is Alphabet.NUCLEOTIDE else 4


def fold(text: Column, alphabet: Alphabet) -> Column:
    """Canonical letters, one for each character: ASCII case folded, U as T, anything unknown (also $ and #) ambiguous.

    All of ASCII goes by one translation; only texts with other characters have matches for the pattern.
    """
    ascii_ = "".join(map(chr, range(128)))
    return F.regexp_replace(F.translate(text, ascii_, fold_text(ascii_, alphabet)), "[^\\x00-\\x7F]", alphabet.ambiguity)


def fold_text(text: str, alphabet: Alphabet) -> str:
    """``fold`` for one string in Python."""
    upper = text.translate(str.maketrans(_LOWER, _UPPER))
    upper = upper.replace("U", "T") if alphabet is Alphabet.NUCLEOTIDE else upper
    return "".join(c if c in alphabet.plain else alphabet.ambiguity for c in upper)


def symbol_of_char(c: Column, alphabet: Alphabet) -> Column:
    """One canonical letter for one character; $ and # are the sentinel."""
    return F.when(c.isin("$", "#"), SENTINEL).otherwise(fold(c, alphabet))


def index_of(symbol: Column, alphabet: Alphabet) -> Column:
    return (F.instr(F.lit(alphabet.letters), symbol) - 1).cast("long")


def symbol_at(index: Column, alphabet: Alphabet) -> Column:
    return F.substring(F.lit(alphabet.letters), index.cast("int") + 1, F.lit(1))


def bitcode_of(symbol: Column, alphabet: Alphabet) -> Column:
    codes = _CODES[alphabet.value]
    return F.element_at(F.array(*[F.lit(codes[c]).cast("long") for c in alphabet.letters]), (index_of(symbol, alphabet) + 1).cast("int"))


def symbol_of_bitcode(code: Column, alphabet: Alphabet) -> Column:
    codes = _CODES[alphabet.value]
    return F.element_at(F.create_map(*[x for c in alphabet.letters for x in (F.lit(codes[c]).cast("long"), F.lit(c))]), code.cast("long"))


def is_sentinel(symbol: Column) -> Column:
    return symbol == SENTINEL


def described(symbol: Column, alphabet: Alphabet) -> Column:
    return F.concat_ws(" ", F.lit(str(alphabet)), F.lit("code"), symbol)


@dataclass(frozen=True)
class Symbol:
    """One letter of an alphabet. The codings of a symbol all lead to the same value."""

    alphabet: Alphabet
    letter: str

    @classmethod
    def new_ascii(cls, alphabet: Alphabet, c: str) -> Symbol:
        return cls(alphabet, SENTINEL if c in "$#" else fold_text(c, alphabet))

    @classmethod
    def new_index(cls, alphabet: Alphabet, index: int) -> Symbol:
        if not 0 <= index < alphabet.cardinality:
            raise ValueError(f"index {index} is outside the {alphabet} alphabet")
        return cls(alphabet, alphabet.letters[index])

    @classmethod
    def new_bit_vector(cls, alphabet: Alphabet, code: int) -> Symbol:
        found = [c for c, x in _CODES[alphabet.value].items() if x == code]
        if not found:
            raise ValueError(f"no {alphabet} symbol has the code {code:b}")
        return cls(alphabet, found[0])

    @property
    def ascii(self) -> str:
        return self.letter

    @property
    def index(self) -> int:
        return self.alphabet.letters.index(self.letter)

    @property
    def bit_vector(self) -> int:
        return _CODES[self.alphabet.value][self.letter]

    @property
    def is_sentinel(self) -> bool:
        return self.letter == SENTINEL

    def __str__(self) -> str:
        return f"{self.alphabet} code {self.letter}"
