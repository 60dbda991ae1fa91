import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helixspark.functions.alphabet import Alphabet, Symbol, fold, fold_text
from helixspark.functions.ranges import SearchRange
from helixspark.operators import fm, search
from helixspark.operators.ordered import as_of, global_rank, running_sum
from helixspark.plans.index import BuildOptions, build, load, saved_bytes
from helixspark.sources.fastx import read_fasta, read_fastq, read_sequences, write_fasta
from helixspark.streaming.patterns import count_stream, locate_stream

NUC, AMINO = Alphabet.NUCLEOTIDE, Alphabet.AMINO


def collection(spark, seqs):
    return spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(seqs)], "seq_idx long, header string, seq string")


def queries(spark, patterns):
    return spark.createDataFrame(list(enumerate(patterns)), "query_id long, pattern string")


def brute(seqs, pattern, alphabet):
    """All overlapping matches in the folded text of all sequences."""
    folded = [fold_text(s, alphabet) for s in seqs]
    text, p, out, starts, at = alphabet.ambiguity.join(folded), fold_text(pattern, alphabet), [], [], 0
    for s in folded:
        starts.append(at)
        at += len(s) + 1
    i = text.find(p)
    while i >= 0:
        k = max(k for k, a in enumerate(starts) if a <= i)
        out.append((k, i - starts[k]))
        i = text.find(p, i + 1)
    return out


CASES = [
    (["AAAAA"], {"AA": 4}),
    (["ACGT", "TTAC", "ACGT"], {"ACGT": 2, "AC": 3, "N": 2, "TNT": 1, "CNA": 1, "TTT": 0, "acgu": 2}),
    (["ACRYGU"], {"NN": 1}),
    (["AC$GT"], {"CNG": 1}),
    (["A", "", "C", "G"], {"ANNCNG": 1, "NNC": 1, "N": 3}),
]


@pytest.mark.parametrize(("seqs", "want"), CASES)
def test_written_cases(spark, seqs, want):
    index = build(spark, collection(spark, seqs))
    asked = queries(spark, [*want, *want])
    assert [r.n for r in index.parallel_count(asked).orderBy("query_id").collect()] == list(want.values()) * 2
    places = {r.query_id: [tuple(x) for x in r.locations] for r in index.parallel_locate_lists(asked).collect()}
    assert [places[i] for i in range(2 * len(want))] == [brute(seqs, p, NUC) for p in want] * 2


@pytest.mark.parametrize(("alphabet", "letters"), [(NUC, "ACGTacgtuN-"), (AMINO, "ACDEFGHIKLMNPQRSTVWYbx")])
def test_random_collections(spark, alphabet, letters):
    r = random.Random(alphabet.id)
    seqs = ["".join(r.choices(letters, k=r.randrange(0, 700 if i == 3 else 40))) for i in range(12)]
    patterns = [s[a : a + n] for s in seqs if len(s) > 4 for a in [r.randrange(len(s) - 3)] for n in (1, 3, 9, 20) if s[a : a + n]]
    index = build(spark, collection(spark, seqs), BuildOptions(alphabet))
    got = {q: [] for q in range(len(patterns))}
    for row in index.parallel_locate(queries(spark, patterns)).collect():
        got[row.query_id].append((row.sequence_idx, row.local_position))
    assert [sorted(got[q]) for q in got] == [brute(seqs, p, alphabet) for p in patterns]


@pytest.mark.parametrize("numbers", [(0, 5, 9, 10, 70_000), (3, 2**33, 2**33 + 1, 2**40, 2**40 + 7)])
def test_gaps_between_numbers(spark, numbers):
    """Numbers of a filtered collection: what follows a sequence is the next one there is."""
    seqs = ["ACGT", "TTAC", "", "ACGT", "A"]
    rows = spark.createDataFrame([(n, "h", s) for n, s in zip(numbers, seqs, strict=True)], "seq_idx long, header string, seq string")
    index = build(spark, rows)
    asked = ["TNT", "CNA", "CNNA", "TNA", "N", "NN", "ACGT", "CNNACGTNA"]
    want = [brute(seqs, p, NUC) for p in asked]
    assert [r.n for r in index.parallel_count(queries(spark, asked)).orderBy("query_id").collect()] == list(map(len, want))
    places = {r.query_id: [(numbers.index(x.sequence_idx), x.local_position) for x in r.locations] for r in index.parallel_locate_lists(queries(spark, asked)).collect()}
    assert [places[i] for i in range(len(asked))] == want
    text = "N".join(seqs) + "$"
    assert [x.pos for x in index.suffix_array.orderBy("row").collect()] == sorted(range(len(text)), key=lambda i: text[i:])


def test_kmer_lookup_takes_its_own_length_only(spark):
    index = build(spark, collection(spark, ["ACGTACG"]), BuildOptions(lookup_table_kmer_len=3))
    assert [tuple(r) for r in index.kmer_lookup(queries(spark, ["acg", "TTT"])).orderBy("query_id").collect()] == [(0, 1, 2), (1, 1, 0)]
    for bad in ("ACGT", "AC", "TNA"):
        with pytest.raises(PySparkException):
            index.kmer_lookup(queries(spark, [bad])).collect()


def test_few_patterns_as_many(spark, monkeypatch):
    """The pass for few patterns counts as the join of windows does."""
    r = random.Random(6)
    index = build(spark, collection(spark, ["".join(r.choices("ACGTN", k=r.randrange(0, 60))) for _ in range(30)]))
    asked = queries(spark, ["A", "AA", "NN", "NAN", "ACG", "TNNT", "N", "GNG", "AANAA", "CCCCCCCCCCCCCCCC"])
    few = sorted(map(tuple, index.parallel_count(asked).collect()))
    monkeypatch.setattr(search, "FEW", 0)
    assert few == sorted(map(tuple, index.parallel_count(asked).collect())) and sum(n for _, n in few) > 100


def test_hits_count_overlaps(spark):
    r = random.Random(8)
    texts = ["", "A", "NN"] + ["".join(r.choices("ACN", k=r.randrange(40))) for _ in range(30)]
    asked = ["A", "N", "AA", "AC", "NNN", "ANA", "NAN", "AACA", "NANAN", "CCNN", "ACACA", "ACGTACGTA"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[search.hits(F.col("t"), p).alias(p) for p in asked]).collect()
    assert all(row[p] == sum(row.t.startswith(p, i) for i in range(len(row.t))) for row in rows for p in asked)


def _exchanges(df, rows):
    """Whether rows as wide as ``rows`` are shuffled anywhere in the plan."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x and rows in x]


def test_places_of_a_bounded_batch_are_not_shuffled(spark):
    """Neither windows nor places move for a batch that can be broadcast; lists move packed, once for each distinct pattern."""
    rows, asked = collection(spark, ["ACGTACGT", "TTACG"]), queries(spark, ["ACG", "TTT", "ACG"])
    assert not _exchanges(search.locate(rows, asked, NUC), "kmer") and not _exchanges(search.locate(rows, asked, NUC), "pattern")
    assert not _exchanges(search.locate_lists(rows, asked, NUC), "kmer") and not _exchanges(search.locate_lists(rows, asked, NUC), "local_position")
    assert len(search.lists_by_pattern(rows, asked, NUC).collect()) == 2


def test_large_batches_and_small_packs(spark, monkeypatch):
    """Batches beyond the bounds of a broadcast, packs of a few places and null or repeated query numbers give the same places."""
    r = random.Random(7)
    seqs = ["".join(r.choices("ACGTN", k=r.randrange(60))) for _ in range(40)]
    patterns = [(q, p) for q, p in enumerate(["A", "AC", "NN", "TTTTTTTTTTTTTT", "CN", "GT"])] + [(1, "AC"), (None, "GT"), (None, "GT")]
    asked = spark.createDataFrame(patterns, "query_id long, pattern string")
    rows = spark.createDataFrame([(i * 2**34 - 5, "h", s) for i, s in enumerate(seqs)], "seq_idx long, header string, seq string")
    want = [(q, [(i * 2**34 - 5, k) for i, k in brute(seqs, p, NUC)]) for q, p in patterns]
    order = lambda x: (x[0] is None, x)

    def check():
        places = sorted((tuple(x) for x in search.locate(rows, asked, NUC).collect()), key=order)
        assert places == sorted(((q, *x) for q, found in want for x in found), key=order)
        lists = [(x.query_id, [tuple(y) for y in x.locations]) for x in search.locate_lists(rows, asked, NUC).collect()]
        assert sorted(lists, key=order) == sorted(want, key=order)

    check()
    for name, value in (("PACKED", 3), ("PACK", 2), ("MAX_PATTERNS", 0), ("MAX_QUERIES", 0)):
        monkeypatch.setattr(search, name, value)
    check()


def test_varints():
    r = random.Random(3)
    values = np.array([0, 1, 127, 128, 2**63 - 1, *(r.randrange(2 ** r.randrange(1, 64) - 1 or 1) for _ in range(500))], np.int64)
    data, starts = search.varints(values)
    assert (search.from_varints(data) == values).all() and len(search.from_varints(data[:0])) == 0
    assert [len(data[a:b]) for a, b in zip(starts, [*starts[1:], len(data)], strict=True)] == [max(1, -(-int(v).bit_length() // 7)) for v in values]


def test_fold_of_all_ascii_and_beyond(spark):
    texts = ["".join(map(chr, range(128))), "na\u00efve \u0130\u0131\u017f\u212a \U0001f600x\nacgtu$#", ""]
    for alphabet in Alphabet:
        found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fold(F.col("t"), alphabet).alias("f")).collect()
        assert [x.f for x in found] == [fold_text(t, alphabet) for t in texts]


def test_index_tables(spark):
    r = random.Random(5)
    seqs = ["".join(r.choices("ACGT", k=k)) for k in (400, 60, 0, 33)] + ["ACGT" * 40]
    index = build(spark, collection(spark, seqs), BuildOptions(NUC, 3, 4))
    text = "N".join(seqs) + "$"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    assert [x.pos for x in index.suffix_array.orderBy("row").collect()] == order  # the repeat takes several doublings
    bwt = [text[i - 1] if i else "$" for i in order]
    assert [x.bwt for x in index.bwt.orderBy("row").collect()] == bwt
    place = {p: i for i, p in enumerate(order)}
    lf = [x.lf for x in index.lf.orderBy("row").collect()]
    assert lf == [place[p - 1] if p else 0 for p in order]
    assert [x.pos for x in fm.reconstruct(index.lf, index.sampled_suffix_array, index.bwt_len).orderBy("row").collect()] == order
    assert index.bwt_len == len(text) and index.version_number == 1 and index.suffix_array_compression_ratio == 3
    assert index.backstep(5) == lf[5]
    found = index.initial_search_range(Symbol.new_ascii(NUC, "t"))
    for c in "CA":
        found = index.update_range_with_symbol(found, Symbol.new_ascii(NUC, c))
    rows = [i for i, p in enumerate(order) if text[p : p + 3] == "ACT"]
    assert found == (SearchRange(rows[0], rows[-1]) if rows else SearchRange.zero())
    got = index.search_ranges(queries(spark, ["ACT", "AAAAAAAAAAAA"])).orderBy("query_id").collect()
    assert [(x.start_ptr, x.end_ptr) for x in got] == [(rows[0], rows[-1]), (1, 0)]
    assert index.count_string("act") == len(rows) and [(p.sequence_idx, p.local_position) for p in index.locate_string("ACT")] == brute(seqs, "ACT", NUC)
    with pytest.raises(ValueError):
        index.update_range_with_symbol(found, Symbol.new_ascii(NUC, "$"))


def test_bounded_suffixes(spark):
    index = build(spark, collection(spark, ["ACACACAC"]), BuildOptions(max_query_len=3))
    text = "ACACACAC$"
    assert [x.pos for x in index.suffix_array.orderBy("row").collect()] == sorted(range(9), key=lambda i: (text[i : i + 3], i))
    with pytest.raises(PySparkException):
        index.parallel_count(queries(spark, ["ACAC"])).collect()


@pytest.mark.parametrize(("alphabet", "letters"), [(NUC, 5), (NUC, 8), (AMINO, 3)])
def test_bounded_suffixes_take_one_sort(spark, monkeypatch, alphabet, letters):
    """No ranking by doubling, which would store and shuffle every position several times; ends, gaps and repeats in order."""
    r = random.Random(letters)
    seqs = ["".join(r.choices(alphabet.plain[:3] + alphabet.ambiguity, k=r.choice([0, 1, 2, 30, 300]))) for _ in range(20)] + ["", "A"]
    rows = spark.createDataFrame([(3 * i + 5, "h", s) for i, s in enumerate(seqs)], "seq_idx long, header string, seq string")
    text = alphabet.ambiguity.join(seqs) + "$"
    monkeypatch.setattr(fm, "global_rank", None)
    got = [x.pos for x in fm.suffix_array(rows, alphabet, letters).orderBy("row").collect()]
    assert got == sorted(range(len(text)), key=lambda i: (text[i : i + letters], i))


@pytest.mark.parametrize(("alphabet", "letters", "size"), [(NUC, 32, 40), (NUC, 1, 60), (AMINO, 19, 50), (NUC, 21, 10**6)])
def test_bounded_suffixes_are_sorted_in_buckets(spark, monkeypatch, alphabet, letters, size):
    """Positions aren't shuffled; buckets end within runs of equal letters, rows within sequences, and longer texts give the same."""
    r = random.Random(letters)
    a = alphabet.ambiguity
    seqs = [a * 90, "", a, "".join(r.choices(alphabet.plain + a, k=400)), "".join(r.choices(alphabet.plain[:2], k=200)), a * 90, ""]
    seqs += [seqs[3][:50], seqs[3], alphabet.plain[0] * 40]
    rows = spark.createDataFrame([(3 * i + 5, "h", s) for i, s in enumerate(seqs)], "seq_idx long, header string, seq string").repartition(3)
    text = a.join(seqs) + "$"
    want = sorted(range(len(text)), key=lambda i: (text[i : i + letters], i))
    monkeypatch.setattr(fm.bounded, "BUCKET", size * 5)
    monkeypatch.setattr(fm.bounded, "CHUNK", size)
    found = fm.suffix_array(rows, alphabet, letters)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [x.pos for x in found.orderBy("row").collect()] == want
    monkeypatch.setattr(fm.bounded, "MOST", 10)
    assert [x.pos for x in fm.suffix_array(rows, alphabet, letters).orderBy("row").collect()] == want


def test_steps_of_positions():
    at = np.array([0, 1, 255, 510, 1529, 3, 258, 70000])
    data, ends = fm.bounded.gaps(at, np.array([0, 5]))
    assert fm.bounded.from_gaps(data[: ends[4]]).tolist() == at[:5].tolist() and fm.bounded.from_gaps(data[ends[4] :]).tolist() == at[5:].tolist()


@pytest.mark.parametrize("bad", ["", "A$C", "#"])
def test_invalid_patterns(spark, bad):
    with pytest.raises(PySparkException):
        build(spark, collection(spark, ["ACGT"])).parallel_count(queries(spark, [bad])).collect()


@pytest.mark.parametrize("options", [{"suffix_array_compression_ratio": 0}, {"lookup_table_kmer_len": 0}, {"max_query_len": 0}])
def test_invalid_options(options):
    with pytest.raises(ValueError):
        BuildOptions(**options)


def test_no_sequences(spark):
    index = build(spark, spark.createDataFrame([], "seq_idx long, header string, seq string"))
    assert [r.n for r in index.parallel_count(queries(spark, ["A", "N"])).collect()] == [0, 0]


def test_save_and_load(spark, tmp_path):
    index = build(spark, collection(spark, ["ACGTT", "GATTACA"]), BuildOptions(NUC, 2, 3))
    index.save(str(tmp_path / "x"))
    again = load(spark, str(tmp_path / "x"))
    assert again.options == index.options and again.count_string("TT") == 2
    assert again.locate_string("T", limit=2) == again.locate_string("T")[:2] and min(saved_bytes(spark, str(tmp_path / "x")).values()) > 0
    for name in ("sequences", "suffix_array", "bwt", "prefix_sums", "milestones", "sampled_suffix_array", "kmer_ranges"):
        a, b = getattr(index, name), getattr(again, name)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
    again.metadata().withColumn("version_number", F.lit(9)).write.mode("overwrite").parquet(str(tmp_path / "x2/metadata"))
    with pytest.raises(ValueError):
        load(spark, str(tmp_path / "x2"))


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\r\nACGT\r\nAC\r\n>two\n\n>three >x\nGG\nTT\n")
    (tmp_path / "b.fa").write_text("; comment\n>four\nA")
    rows = [tuple(r) for r in read_fasta(spark, str(tmp_path / "*.fa")).orderBy("seq_idx").collect()]
    assert rows == [(0, "one first", "ACGTAC"), (1, "two", ""), (2, "three >x", "GGTT"), (3, "four", "A")]
    long = collection(spark, ["ACGTT" * 50, "", "G"])
    write_fasta(long, str(tmp_path / "out"))
    assert max(map(len, "".join(p.read_text() for p in (tmp_path / "out").glob("part*")).split("\n"))) == 80
    assert [tuple(r) for r in read_fasta(spark, str(tmp_path / "out")).orderBy("seq_idx").collect()] == [tuple(r) for r in long.collect()]


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r0\nACG\n+\n@@@\n@r1 x\nTT\n+r1\n+>\n@r2\nG\n+\n>\n")
    rows = [tuple(r) for r in read_sequences(spark, str(tmp_path / "a.fastq")).orderBy("seq_idx").collect()]
    assert rows == [(0, "r0", "ACG"), (1, "r1 x", "TT"), (2, "r2", "G")]
    assert [tuple(r) for r in read_fastq(spark.newSession(), str(tmp_path / "a.fastq")).orderBy("seq_idx").collect()] == rows


def test_split_files(spark, tmp_path):
    """Records that lie across the splits of a file keep their order."""
    (tmp_path / "a.fa").write_text("".join(f">h{i}\n{'ACGT' * (i % 7)}\n" for i in range(400)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = [tuple(r) for r in read_fasta(spark, str(tmp_path / "a.fa")).orderBy("seq_idx").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == [(i, f"h{i}", "ACGT" * (i % 7)) for i in range(400)]


def test_ordered(spark):
    r = random.Random(2)
    values = [r.randrange(9) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long")
    sums = {x.i: x.s for x in running_sum(df, "i", F.col("v"), "s", bits=4).collect()}
    assert sums == {i: sum(values[:i]) for i in range(300)}
    ranks = {x.i: x.k for x in global_rank(df, ["v"], "k").collect()}
    assert ranks == {i: sum(w < v for w in values) for i, v in enumerate(values)}
    marks = spark.createDataFrame([(a, f"m{a}") for a in (3, 4, 100, 250)], "at long, name string")
    found = {x.i: x.name for x in as_of(df, "i", marks, "at", bits=4).collect()}
    assert found == {i: next((f"m{a}" for a in (250, 100, 4, 3) if a <= i), None) for i in range(300)}


def test_streams(spark, tmp_path):
    index = build(spark, collection(spark, ["ACGTACGT", "TTACG"]))
    queries(spark, ["ACG", "TTT"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, pattern string").parquet(str(tmp_path / "in"))
    got = []
    q = count_stream(stream, index, lambda df, n: got.extend(map(tuple, df.collect())), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == [(0, 3), (1, 0)]
    q = locate_stream(stream, index, 3).writeStream.format("memory").queryName("places").option("checkpointLocation", str(tmp_path / "state2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from places").collect())) == [(0, 0, 0), (0, 0, 4), (0, 1, 2)]
