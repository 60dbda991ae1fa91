"""The index: built from sequences, asked for counts and places, saved and loaded as Parquet tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.functions.alphabet import Alphabet, Symbol
from helixspark.functions.ranges import LocalizedPosition, SearchRange
from helixspark.operators import fm, search
from helixspark.operators import sequences as seqs
from helixspark.session import cut
from helixspark.sources.fastx import read_sequences

VERSION = 1
TABLES = ("sequences", "suffix_array", "bwt", "prefix_sums", "milestones", "sampled", "kmer_ranges")


@dataclass(frozen=True)
class BuildOptions:
    """How to build. ``remove_intermediate`` is accepted for likeness: no intermediate file is left."""

    alphabet: Alphabet = Alphabet.NUCLEOTIDE
    suffix_array_compression_ratio: int = 8
    lookup_table_kmer_len: int | None = None
    max_query_len: int | None = None
    remove_intermediate: bool = True

    def __post_init__(self) -> None:
        if self.suffix_array_compression_ratio < 1:
            raise ValueError("the suffix array compression ratio must be at least 1")
        if self.kmer < 1:
            raise ValueError("the k-mer length must be at least 1")
        if self.max_query_len is not None and self.max_query_len < 1:
            raise ValueError("the longest query must have at least 1 letter")

    @property
    def kmer(self) -> int:
        return self.alphabet.default_kmer if self.lookup_table_kmer_len is None else self.lookup_table_kmer_len


@dataclass
class Index:
    """Tables are built when first asked for; counting and locating need the sequences only."""

    spark: SparkSession
    options: BuildOptions
    sequences: DataFrame
    stored: dict[str, DataFrame] = field(default_factory=dict)

    def _table(self, name: str, make) -> DataFrame:
        if name not in self.stored:
            self.stored[name] = cut(make())
        return self.stored[name]

    # ---- tables

    @cached_property
    def sequence_index(self) -> DataFrame:
        return cut(seqs.sequence_index(self.sequences))

    @cached_property
    def letters(self) -> DataFrame:
        return cut(seqs.letters(self.sequences, self.alphabet))

    @property
    def suffix_array(self) -> DataFrame:
        return self._table("suffix_array", lambda: fm.suffix_array(self.sequences, self.alphabet, self.options.max_query_len))

    @property
    def bwt(self) -> DataFrame:
        return self._table("bwt", lambda: fm.bwt(self.suffix_array, self.letters))

    @property
    def prefix_sums(self) -> DataFrame:
        return self._table("prefix_sums", lambda: fm.prefix_sums(self.bwt, self.alphabet))

    @property
    def milestones(self) -> DataFrame:
        return self._table("milestones", lambda: fm.milestones(self.bwt, self.alphabet))

    @property
    def sampled_suffix_array(self) -> DataFrame:
        return self._table("sampled", lambda: fm.sampled(self.suffix_array, self.options.suffix_array_compression_ratio))

    @property
    def kmer_ranges(self) -> DataFrame:
        return self._table("kmer_ranges", lambda: fm.kmer_ranges(self.sequences, self.suffix_array, self.options.kmer, self.alphabet))

    @cached_property
    def lf(self) -> DataFrame:
        return cut(fm.lf_mapping(self.bwt, self.prefix_sums, self.milestones, self.alphabet))

    # ---- metadata

    @property
    def alphabet(self) -> Alphabet:
        return self.options.alphabet

    @property
    def suffix_array_compression_ratio(self) -> int:
        return self.options.suffix_array_compression_ratio

    @property
    def version_number(self) -> int:
        return VERSION

    @cached_property
    def bwt_len(self) -> int:
        """Letters of all sequences, a delimiter between two, and the sentinel; 1 for no sequences."""
        n, k = self.sequences.agg(F.sum(F.length("seq")), F.count(F.lit(1))).first()
        return (n or 0) + max(k - 1, 0) + 1

    def metadata(self) -> DataFrame:
        """One row: version, alphabet, ratio, k, longest query, length."""
        o = self.options
        row = (VERSION, str(o.alphabet), o.suffix_array_compression_ratio, o.kmer, o.max_query_len, self.bwt_len)
        return self.spark.createDataFrame([row], "version_number long, alphabet string, suffix_array_compression_ratio long, kmer_len long, max_query_len long, bwt_len long")

    def table_sizes(self) -> DataFrame:
        """table_name, n: rows of each table, built where it isn't yet."""
        every = [("sequences", self.sequences), ("suffix_array", self.suffix_array), ("bwt", self.bwt), ("prefix_sums", self.prefix_sums), ("milestones", self.milestones), ("sampled", self.sampled_suffix_array), ("kmer_ranges", self.kmer_ranges)]
        found = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in every]
        return reduce(DataFrame.unionByName, found)

    # ---- queries

    def parallel_count(self, queries: DataFrame) -> DataFrame:
        """query_id, n for a batch (query_id, pattern)."""
        return search.count(self.sequences, queries, self.alphabet, self.options.max_query_len)

    def parallel_locate(self, queries: DataFrame) -> DataFrame:
        """query_id, sequence_idx, local_position: one row for each occurrence."""
        return search.locate(self.sequences, queries, self.alphabet, self.options.max_query_len)

    def parallel_locate_lists(self, queries: DataFrame) -> DataFrame:
        return search.locate_lists(self.sequences, queries, self.alphabet, self.options.max_query_len)

    def _asked(self, patterns: Iterable[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(patterns)), "query_id long, pattern string")

    def count_string(self, pattern: str) -> int:
        return self.parallel_count(self._asked([pattern])).first()["n"]

    def locate_string(self, pattern: str, limit: int | None = None) -> list[LocalizedPosition]:
        """Sorted places of one pattern, with ``limit`` the first so many; a result for one user, so it is collected. Frequent patterns: parallel_locate."""
        found = self.parallel_locate(self._asked([pattern]))
        found = found.orderBy("sequence_idx", "local_position").limit(limit) if limit is not None else found
        return sorted(LocalizedPosition(r.sequence_idx, r.local_position) for r in found.toLocalIterator())

    def search_ranges(self, queries: DataFrame) -> DataFrame:
        """query_id, start_ptr, end_ptr of the suffix rows of each pattern; (1, 0) where there are none."""
        asked = cut(search.checked(queries, self.alphabet, self.options.max_query_len))
        hits = search.occurrences(self.sequences, asked, self.alphabet)
        found = fm.pattern_rows(hits, self.sequences, self.suffix_array, ["pattern"])
        return asked.join(found, "pattern", "left").select("query_id", F.coalesce("start_ptr", F.lit(1).cast("long")).alias("start_ptr"), F.coalesce("end_ptr", F.lit(0).cast("long")).alias("end_ptr"))

    def kmer_lookup(self, queries: DataFrame) -> DataFrame:
        """As search_ranges, for patterns of the table's length without the ambiguity letter, from the table. Others are an error."""
        asked = search.checked(queries, self.alphabet)
        other = (F.length("pattern") != self.options.kmer) | F.contains("pattern", F.lit(self.alphabet.ambiguity))
        asked = asked.withColumn("pattern", F.when(other, F.raise_error(F.concat(F.lit(f"not a pattern of {self.options.kmer} plain letters: "), "pattern"))).otherwise(F.col("pattern")))
        found = asked.join(self.kmer_ranges, asked["pattern"] == F.col("kmer"), "left")
        return found.select("query_id", F.coalesce("start_ptr", F.lit(1).cast("long")).alias("start_ptr"), F.coalesce("end_ptr", F.lit(0).cast("long")).alias("end_ptr"))

    def initial_search_range(self, symbol: Symbol) -> SearchRange:
        row = fm.initial_ranges(self.prefix_sums, self.alphabet).where(F.col("symbol") == symbol.letter).first()
        return SearchRange(row.start_ptr, row.end_ptr)

    def update_range_with_symbol(self, found: SearchRange, symbol: Symbol) -> SearchRange:
        """One step of backward search. The sentinel never extends a range."""
        if symbol.is_sentinel:
            raise ValueError("a range can't be extended by the sentinel")
        ranges = self.spark.createDataFrame([(0, found.start_ptr, found.end_ptr, symbol.letter)], "range_id long, start_ptr long, end_ptr long, symbol string")
        row = fm.extend_ranges(ranges, self.bwt, self.milestones, self.prefix_sums, self.alphabet).first()
        return SearchRange(row.start_ptr, row.end_ptr)

    def backstep(self, row: int) -> int:
        return self.lf.where(F.col("row") == row).first()["lf"]

    # ---- files

    def save(self, path: str) -> None:
        """Writes all tables and the metadata under ``path``, over what is there."""
        made = {"sequences": self.sequences, "suffix_array": self.suffix_array, "bwt": self.bwt, "prefix_sums": self.prefix_sums, "milestones": self.milestones, "sampled": self.sampled_suffix_array, "kmer_ranges": self.kmer_ranges}
        for name in TABLES:
            made[name].write.mode("overwrite").parquet(f"{path}/{name}")
        self.metadata().write.mode("overwrite").parquet(f"{path}/metadata")


def saved_bytes(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of each table of a saved index."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    places = {name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in TABLES}
    return {name: place.getFileSystem(hadoop).getContentSummary(place).getLength() for name, place in places.items()}


def build(spark: SparkSession, source: DataFrame | str, options: BuildOptions | None = None) -> Index:
    """An index of a FASTA or FASTQ path, or of a table with seq_idx, header and seq."""
    options = options or BuildOptions()
    rows = read_sequences(spark, source) if isinstance(source, str) else source
    return Index(spark, options, cut(seqs.folded(rows, options.alphabet)))


def load(spark: SparkSession, path: str) -> Index:
    """A saved index. Unknown versions are refused."""
    row = spark.read.parquet(f"{path}/metadata").first()
    if row.version_number != VERSION:
        raise ValueError(f"version {row.version_number} of the index at {path} can't be read")
    options = BuildOptions(Alphabet(row.alphabet), row.suffix_array_compression_ratio, row.kmer_len, row.max_query_len)
    stored = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    return Index(spark, options, stored.pop("sequences"), stored)
