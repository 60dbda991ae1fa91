"""Registered queries of the sequence engine and their DuckDB SQL.

Corpora, each a whole table: ``reads`` has a 32-letter read for every order (the MD5 of its key,
spelt in nucleotides), ``parts`` a pattern for every part, ``documents`` the folded texts. The index
tables are of a read for every supplier, and for amino acids of the names of all nations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.functions import alphabet as ab
from helixspark.functions import ranges
from helixspark.functions.alphabet import Alphabet
from helixspark.operators import fm, search
from helixspark.operators import sequences as seqs
from helixspark.plans.index import BuildOptions, Index, build, load
from helixspark.session import scratch, table
from helixspark.sources.fastx import read_fasta, read_fastq, write_fasta, write_fastq

NUC, AMINO = Alphabet.NUCLEOTIDE, Alphabet.AMINO


def _dna(key: str) -> Column:
    return F.translate(F.md5(F.col(key).cast("string")), "0123456789abcdef", "ACGT" * 4)


def reads(spark, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seq_idx"), F.concat(F.lit("read_"), F.col("o_orderkey").cast("string")).alias("header"), _dna("o_orderkey").alias("seq"))


def patterns(spark, d: str, size: int = 7) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.substring(_dna("p_partkey"), 1, size).alias("pattern"))


def texts(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_idx"), F.lit("").alias("header"), F.col("text").alias("seq"))


def suppliers(spark, d: str) -> DataFrame:
    return table(spark, d, "supplier").select((F.col("s_suppkey") - F.lit(_least(table(spark, d, "supplier"), "s_suppkey"))).alias("seq_idx"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("header"), _dna("s_suppkey").alias("seq"))


def _least(df: DataFrame, key: str) -> int:
    return df.agg(F.min(key)).first()[0] or 0


def nations(spark, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("seq_idx"), F.col("n_name").alias("header"), F.col("n_name").alias("seq"))


_indexes: dict[tuple, Index] = {}


def forget_indexes() -> None:
    """The next query of an index builds it anew."""
    _indexes.clear()


def index(spark, d: str, alphabet: Alphabet = NUC) -> Index:
    """The index of the suppliers' reads (or nations' names), built once for each session and folder."""
    key = (spark.sparkContext.applicationId, d, alphabet)
    if key not in _indexes:
        rows = suppliers(spark, d) if alphabet is NUC else nations(spark, d)
        _indexes[key] = build(spark, rows, BuildOptions(alphabet, lookup_table_kmer_len=5 if alphabet is NUC else 2))
    return _indexes[key]


def _folds(alphabet: Alphabet):
    return lambda spark, d: table(spark, d, "documents").select("doc_id", ab.fold(F.col("text"), alphabet).alias("folded"))


def _symbols(spark, d: str) -> DataFrame:
    """symbol, n of the letters of all documents as folded, and of the sentinel 0."""
    return seqs.windows(seqs.folded(texts(spark, d), NUC), 1).groupBy(F.col("kmer").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


def scan_sequences(spark, d: str) -> DataFrame:
    """All reads written as FASTA and as FASTQ, and read again."""
    rows, a, b = reads(spark, d), scratch(spark, "fasta"), scratch(spark, "fastq")
    write_fasta(rows, a, width=20)
    write_fastq(rows, b)
    return read_fasta(spark, a).withColumn("format", F.lit("fasta")).unionByName(read_fastq(spark, b).withColumn("format", F.lit("fastq")))


def extend_range(spark, d: str) -> DataFrame:
    """The range of every letter extended by every plain letter."""
    x = index(spark, d)
    first = fm.initial_ranges(x.prefix_sums, NUC).where("symbol <> '$'").select(F.col("symbol").alias("range_symbol"), "start_ptr", "end_ptr")
    ranges = first.select("range_symbol", "start_ptr", "end_ptr", F.explode(F.split(F.lit("A,C,G,N,T"), ",")).alias("symbol"))
    ranges = ranges.withColumn("range_id", ab.index_of(F.col("range_symbol"), NUC))
    found = fm.extend_ranges(ranges, x.bwt, x.milestones, x.prefix_sums, NUC)
    return found.select(ab.symbol_at(F.col("range_id"), NUC).alias("range_symbol"), "symbol", "start_ptr", "end_ptr")


def rank_occurrence(spark, d: str) -> DataFrame:
    """How often each row's letter stands up to that row."""
    x = index(spark, d)
    points = x.bwt.select(F.col("row").alias("p"), F.col("bwt").alias("symbol"))
    return fm.rank_occurrence(points, x.bwt, x.milestones).select("p", "symbol", "occ")


def localize_positions(spark, d: str) -> DataFrame:
    """Every position of the reads' text, as sequence and place in it."""
    index_ = seqs.sequence_index(reads(spark, d))
    ends = index_.select(F.explode(F.array(F.col("start_position"), F.col("start_position") + F.lit(17), F.col("start_position") + F.col("length"))).alias("pos"))
    return seqs.localize(ends, index_).select("pos", "sequence_idx", "local_position")


def _prefixes(spark, d: str, size: int) -> DataFrame:
    """The first letters of every supplier's read, as patterns."""
    return suppliers(spark, d).select(F.col("seq_idx").alias("query_id"), F.substring("seq", 1, size).alias("pattern"))


def index_roundtrip(spark, d: str) -> DataFrame:
    """Counts from an index that was saved and loaded."""
    path = scratch(spark, "index")
    index(spark, d).save(path)
    found = load(spark, path)
    return found.parallel_count(patterns(spark, d, 4)).join(found.metadata().select("bwt_len", "version_number"), F.lit(True))


def count_pattern(spark, d: str) -> DataFrame:
    """A few patterns in all documents, within and across them, overlaps included."""
    asked = spark.createDataFrame([(0, "gat"), (1, "NACG"), (2, "cau"), (3, "GATTACAGATTACA"), (4, "AA"), (5, "NN"), (6, "NNTN")], "query_id long, pattern string")
    return search.count(seqs.folded(texts(spark, d), NUC), asked, NUC)


def _located(spark, d: str, asked: DataFrame) -> DataFrame:
    return search.locate(seqs.folded(reads(spark, d), NUC), asked, NUC)


def locate_lists(spark, d: str) -> DataFrame:
    """The places of each pattern in one row, in order."""
    found = search.lists_by_pattern(seqs.folded(reads(spark, d), NUC), patterns(spark, d), NUC)
    shown = F.transform("locations", lambda x: F.concat_ws(":", x["sequence_idx"].cast("string"), x["local_position"].cast("string")))
    found = found.select("ids", F.size("locations").cast("long").alias("n"), F.array_join(shown, ",").alias("places"))
    return found.select(F.explode("ids").alias("query_id"), "n", "places")


def suffix_array_bounded(spark, d: str) -> DataFrame:
    """All positions of the folded documents by the next 32 letters, then by position."""
    return fm.suffix_array(seqs.folded(texts(spark, d), NUC), NUC, 32).select("row", "pos")


def symbol_bits(spark, d: str) -> DataFrame:
    """For every nation a vector of 128 bits with one set, and how many are set up to places in it."""
    at = (F.col("n_nationkey") * 5).cast("long")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), at.alias("at"), ranges.with_bit(ranges.empty_bits(F.lit(128)), at).alias("bits"))
    bit = ranges.bit_of(F.col("bits"), F.col("at")).cast("long")
    low = [ranges.masked_popcount(F.element_at("bits", i + 1), F.lit(50)).cast("long").alias(f"low{i}") for i in (0, 1)]
    return rows.select("key", bit.alias("bit"), *low)


QUERIES = {
    "fold_nucleotide": _folds(NUC),
    "fold_amino": _folds(AMINO),
    "symbol_index": lambda s, d: _symbols(s, d).select("symbol", ab.index_of(F.col("symbol"), NUC).alias("idx"), "n"),
    "symbol_bitcode": lambda s, d: _symbols(s, d).select("symbol", ab.bitcode_of(F.col("symbol"), NUC).alias("code"), ab.symbol_of_bitcode(ab.bitcode_of(F.col("symbol"), NUC), NUC).alias("back"), "n"),
    "symbol_ascii": lambda s, d: _symbols(s, d).select(ab.symbol_at(ab.index_of(F.col("symbol"), NUC), NUC).alias("symbol"), ab.described(F.col("symbol"), NUC).alias("shown"), "n"),
    "scan_sequences": scan_sequences,
    "sequence_index": lambda s, d: seqs.sequence_index(reads(s, d)),
    "localize_positions": localize_positions,
    "batch_count": lambda s, d: search.count(seqs.folded(reads(s, d), NUC), patterns(s, d), NUC),
    "batch_locate": lambda s, d: _located(s, d, patterns(s, d)),
    "count_pattern": count_pattern,
    "locate_lists": locate_lists,
    "suffix_array_bounded": suffix_array_bounded,
    "symbol_bits": symbol_bits,
    "locate_pattern": lambda s, d: _located(s, d, s.createDataFrame([(0, "gattaca")], "query_id long, pattern string")),
    "suffix_array": lambda s, d: index(s, d).suffix_array.select("row", "pos"),
    "suffix_array_amino": lambda s, d: index(s, d, AMINO).suffix_array.select("row", "pos"),
    "bwt": lambda s, d: index(s, d).bwt.select("row", "pos", "bwt"),
    "bwt_amino": lambda s, d: index(s, d, AMINO).bwt.select("row", "pos", "bwt"),
    "symbol_counts": lambda s, d: fm.symbol_counts(index(s, d).bwt),
    "prefix_sums": lambda s, d: index(s, d).prefix_sums.select("idx", "c"),
    "occ_milestones": lambda s, d: index(s, d).milestones.select("block", "symbol", "cnt"),
    "sampled_suffix_array": lambda s, d: index(s, d).sampled_suffix_array.select("row", "pos"),
    "kmer_ranges": lambda s, d: index(s, d).kmer_ranges.select("kmer", "start_ptr", "end_ptr"),
    "rank_occurrence": rank_occurrence,
    "lf_mapping": lambda s, d: index(s, d).lf.select("row", "pos", "lf"),
    "sa_reconstruct": lambda s, d: fm.reconstruct(index(s, d).lf, index(s, d).sampled_suffix_array, index(s, d).bwt_len),
    "initial_search_range": lambda s, d: fm.initial_ranges(index(s, d).prefix_sums, NUC),
    "search_range": lambda s, d: index(s, d).search_ranges(_prefixes(s, d, 6)),
    "extend_range": extend_range,
    "kmer_lookup": lambda s, d: index(s, d).kmer_lookup(_prefixes(s, d, 5)),
    "index_sizes": lambda s, d: index(s, d).table_sizes(),
    "index_metadata": lambda s, d: index(s, d).metadata().drop("max_query_len"),
    "index_roundtrip": index_roundtrip,
}

_FOLD = "regexp_replace(translate({0}, 'abcdefghijklmnopqrstuvwxyzU', 'ABCDEFGHIJKLMNOPQRSTTVWXYZT'), '[^ACGT]', 'N', 'g')"
_FOLD_AMINO = "regexp_replace(translate({0}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACDEFGHIKLMNPQRSTVWY]', 'X', 'g')"
_READ = "translate(md5(cast({0} as varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_SYMBOLS = f"f as (select {_FOLD.format('text')} as s from documents), c as (select unnest(string_split(s, '')) as symbol from f where s <> ''), n as (select symbol, count(*) as n from c group by symbol)"
_READS = f"r as (select o_orderkey as seq_idx, {_READ.format('o_orderkey')} as s from orders)"
_STARTS = "st as (select o_orderkey as seq_idx, 'read_' || o_orderkey as header, cast(sum(33) over (order by o_orderkey) - 33 as bigint) as start_position, cast(32 as bigint) as length from orders)"
_FM = f"""d as (select s_suppkey - (select min(s_suppkey) from supplier) as i, {_READ.format('s_suppkey')} as s from supplier),
t as (select string_agg(s, 'N' order by i) || '$' as t from d),
fm as (select cast(row_number() over (order by substr(t, p + 1)) - 1 as bigint) as row, cast(p as bigint) as pos, case when p = 0 then '$' else substr(t, p, 1) end as bwt, t from t, unnest(range(0, length(t))) as x(p)),
a as (select cast(i - 1 as bigint) as idx, substr('$ACGNT', i, 1) as symbol from range(1, 7) as x(i)),
n as (select symbol, count(fm.bwt) as n from a left join fm on bwt = symbol group by symbol),
c as (select idx, symbol, n, cast(sum(n) over (order by idx) - n as bigint) as c from a join n using (symbol))"""
_FM_AMINO = _FM.split("a as (")[0].rstrip().rstrip(",").replace("s_suppkey - (select min(s_suppkey) from supplier)", "n_nationkey").replace(_READ.format("s_suppkey"), _FOLD_AMINO.format("n_name")).replace("from supplier", "from nation").replace("'N'", "'X'")
_HITS = "w as (select seq_idx, i - 1 as pos, substr(s, cast(i as int), 7) as kmer from r, unnest(range(1, length(s) - 5)) as x(i))"
_PARTS = f"q as (select p_partkey as query_id, substr({_READ.format('p_partkey')}, 1, {{0}}) as pattern from part)"
#: Every position of the folded documents with the next 32 letters, by chunks of 256.
_PIECES = (
    f"x as (select regexp_extract_all(string_agg({_FOLD.format('text')}, 'N' order by doc_id){{0}}, '.{{{{1,256}}}}') as c from documents), "
    "y as (select i, c[i] as own, c[i] || coalesce(substr(c[i + 1], 1, 31), '') as part from x, unnest(range(1, len(c) + 1)) as u(i)), "
    "w as (select (i - 1) * 256 + j as pos, substr(part, cast(j + 1 as int), 32) as w from y, unnest(range(0, length(own))) as v(j))"
)
_CODES = "case symbol when '$' then 4 when 'A' then 6 when 'C' then 5 when 'G' then 3 when 'N' then 2 else 1 end"


def _range(pattern: str) -> str:
    return f"select query_id, coalesce(min(row), 1) as start_ptr, coalesce(max(row), 0) as end_ptr from {pattern} left join fm on prefix(substr(t, pos + 1), pattern) group by query_id"


_SUPPLIER_PREFIX = "q as (select i as query_id, substr(s, 1, {0}) as pattern from d)"

ORACLE_SQL = {
    "fold_nucleotide": f"select doc_id, {_FOLD.format('text')} as folded from documents",
    "fold_amino": f"select doc_id, {_FOLD_AMINO.format('text')} as folded from documents",
    "symbol_index": f"with {_SYMBOLS} select symbol, cast(instr('$ACGNT', symbol) - 1 as bigint) as idx, n from n",
    "symbol_bitcode": f"with {_SYMBOLS} select symbol, cast({_CODES} as bigint) as code, symbol as back, n from n",
    "symbol_ascii": f"with {_SYMBOLS} select symbol, 'nucleotide code ' || symbol as shown, n from n",
    "scan_sequences": f"with {_READS} select cast(row_number() over (order by seq_idx) - 1 as bigint) as seq_idx, 'read_' || seq_idx as header, s as seq, format from r cross join (values ('fasta'), ('fastq')) as f(format)".replace("row_number() over (order by seq_idx)", "row_number() over (partition by format order by r.seq_idx)").replace("'read_' || seq_idx", "'read_' || r.seq_idx"),
    "sequence_index": f"with {_STARTS} select seq_idx, header, start_position, length from st",
    "localize_positions": f"with {_STARTS} select cast(start_position + x as bigint) as pos, seq_idx as sequence_idx, cast(x as bigint) as local_position from st cross join (values (0), (17), (32)) as v(x)",
    "batch_count": f"with {_READS}, {_HITS}, {_PARTS.format(7)} select query_id, count(w.seq_idx) as n from q left join w on pattern = kmer group by query_id",
    "batch_locate": f"with {_READS}, {_HITS}, {_PARTS.format(7)} select query_id, seq_idx as sequence_idx, cast(pos as bigint) as local_position from q join w on pattern = kmer",
    "count_pattern": f"with {_PIECES.format('')}, q(query_id, p) as (values (0, 'GAT'), (1, 'NACG'), (2, 'CAT'), (3, 'GATTACAGATTACA'), (4, 'AA'), (5, 'NN'), (6, 'NNTN')) "
    "select cast(query_id as bigint) as query_id, cast(sum((prefix(w, p) and length(w) >= length(p))::int) as bigint) as n from w cross join q group by query_id",
    "locate_lists": f"with {_READS}, {_HITS}, {_PARTS.format(7)} select query_id, count(w.seq_idx) as n, coalesce(string_agg(seq_idx || ':' || pos, ',' order by seq_idx, pos), '') as places from q left join w on pattern = kmer group by query_id",
    "suffix_array_bounded": f"with {_PIECES.format(" || '$'")} select cast(row_number() over (order by w, pos) - 1 as bigint) as row, cast(pos as bigint) as pos from w",
    "symbol_bits": "select n_nationkey as key, cast(1 as bigint) as bit, cast((n_nationkey * 5 <= 50)::int as bigint) as low0, cast((n_nationkey * 5 between 64 and 114)::int as bigint) as low1 from nation",
    "locate_pattern": f"with {_READS}, {_HITS} select cast(0 as bigint) as query_id, seq_idx as sequence_idx, cast(pos as bigint) as local_position from w where kmer = 'GATTACA'",
    "suffix_array": f"with {_FM} select row, pos from fm",
    "suffix_array_amino": f"with {_FM_AMINO} select row, pos from fm",
    "bwt": f"with {_FM} select row, pos, bwt from fm",
    "bwt_amino": f"with {_FM_AMINO} select row, pos, bwt from fm",
    "symbol_counts": f"with {_FM} select bwt as symbol, count(*) as n from fm group by bwt",
    "prefix_sums": f"with {_FM} select idx, c from c union all select 6, count(*) from fm",
    "occ_milestones": f"with {_FM}, b as (select distinct row // 256 as block from fm) select cast(block as bigint) as block, symbol, (select count(*) from fm where row < block * 256 and fm.bwt = a.symbol) as cnt from b cross join a",
    "sampled_suffix_array": f"with {_FM} select row, pos from fm where row % 8 = 0",
    "kmer_ranges": f"with {_FM} select substr(t, pos + 1, 5) as kmer, min(row) as start_ptr, max(row) as end_ptr from fm where regexp_full_match(substr(t, pos + 1, 5), '[ACGT]{{5}}') group by 1",
    "rank_occurrence": f"with {_FM} select row as p, bwt as symbol, count(*) over (partition by bwt order by row) as occ from fm",
    "lf_mapping": f"with {_FM} select row, pos, case when bwt = '$' then 0 else cast(c + count(*) over (partition by bwt order by row) - 1 as bigint) end as lf from fm join c on bwt = symbol",
    "sa_reconstruct": f"with {_FM} select row, pos from fm",
    "initial_search_range": f"with {_FM} select symbol, case when n = 0 then 1 else c end as start_ptr, case when n = 0 then 0 else c + n - 1 end as end_ptr from c",
    "search_range": f"with {_FM}, {_SUPPLIER_PREFIX.format(6)} {_range('q')}",
    "extend_range": f"with {_FM}, e as (select x.symbol as range_symbol, y.symbol as symbol from a x cross join a y where x.symbol <> '$' and y.symbol <> '$') select range_symbol, e.symbol, coalesce(min(row), 1) as start_ptr, coalesce(max(row), 0) as end_ptr from e left join fm on substr(t, pos + 1, 2) = e.symbol || range_symbol group by range_symbol, e.symbol",
    "kmer_lookup": f"with {_FM}, {_SUPPLIER_PREFIX.format(5)} {_range('q')}",
    "index_sizes": f"with {_FM} select 'sequences' as table_name, count(*) as n from d union all select 'suffix_array', count(*) from fm union all select 'bwt', count(*) from fm union all select 'prefix_sums', 7 union all "
    "select 'milestones', 6 * count(distinct row // 256) from fm union all select 'sampled', count(*) from fm where row % 8 = 0 union all select 'kmer_ranges', count(distinct substr(t, pos + 1, 5)) from fm where regexp_full_match(substr(t, pos + 1, 5), '[ACGT]{5}')",
    "index_metadata": f"with {_FM} select cast(1 as bigint) as version_number, 'nucleotide' as alphabet, cast(8 as bigint) as suffix_array_compression_ratio, cast(5 as bigint) as kmer_len, cast(length(t) as bigint) as bwt_len from t",
    "index_roundtrip": f"with {_FM}, {_PARTS.format(4)} select query_id, count(fm.row) as n, cast((select length(t) from t) as bigint) as bwt_len, cast(1 as bigint) as version_number from q left join fm on pattern = substr(fm.t, pos + 1, 4) group by query_id",
}
