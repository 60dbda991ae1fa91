"""Each operator against DuckDB, a brute-force version, an exact round trip or held-out rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixspark.llm import bpe, components, mixing, near_dedup, pii, quality_lm, quality_rules, queries, skew, toxicity, url_filter, warc, words
from helixspark.session import scratch, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(texts, k):
    """Smallest id reachable, by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.fixture(scope="module")
def documents(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, same_rows, name):
    same_rows(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name])


# ---- URL filter


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("key like 'k1%'").unionByName(spark.createDataFrame([("elsewhere",)], "key string"))
    found = url_filter.cascade(listed, universe, first_wrong=0.2, next_wrong=0.3)
    assert len(found.levels) > 2
    got = {r.key: r.hit for r in universe.select("key", found.contains(F.col("key")).alias("hit")).collect()}
    assert all(hit == k.startswith("k1") for k, hit in got.items())


def test_long_lists_are_dealt_out(spark, monkeypatch):
    """Lists beyond the bound of one filter go to several cascades, which are exact too."""
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("key like 'k1%'").unionByName(spark.createDataFrame([("elsewhere",)], "key string"))
    monkeypatch.setattr(url_filter, "MAX_BITS", 4096)
    found = url_filter.cascade(listed, universe)
    assert len(found.parts) > 2
    got = {r.key: r.hit for r in universe.select("key", found.contains(F.col("key")).alias("hit")).collect()}
    assert all(hit == k.startswith("k1") for k, hit in got.items())


# ---- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "phone" and not 10 <= len(digits) <= 15 or kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans(texts):
    r = random.Random(3)
    hard = ["".join(r.choices("ab@.-+1 2%()4", k=40)) for _ in range(3000)] + ["a@b.c@d.e a@b.c%x@d.e @@x@y.z", "1.2.3.4.5.6.7.8 256.1.1.1", "4111 1111-1111 1111 4111111111111112", "+1 (569) 555-8554+44 123456789"]
    for t in [*texts.values(), *hard]:
        assert pii.base_spans(t) == brute_spans(t)


def test_crf_adds_what_patterns_miss(spark):
    crf = pii.train(pii.labelled_table())
    held_out = pii.labelled_table(200, seed=99)
    found = crf.decode([pii.token_features([t for t, _ in row]) for row in held_out])
    right = sum(pii.LABELS[x] == k for row, path in zip(held_out, found, strict=True) for (_, k), x in zip(row, path, strict=True))
    assert right > 0.97 * sum(map(len, held_out))
    pairs = [(k, pii.LABELS[x]) for row, path in zip(held_out, found, strict=True) for (_, k), x in zip(row, path, strict=True)]
    for kind in pii.KINDS:  # of each kind
        both, said, true = (sum(f(p) for p in pairs) for f in (lambda p, k=kind: p == (k, k), lambda p, k=kind: p[1] == k, lambda p, k=kind: p[0] == k))
        assert both > 0.9 * said and both > 0.9 * true, (kind, both, said, true)
    text = "write to nase.77 [at] mail6.example (dot) com or call (608) 555-0659 by 2020-01-02, page 12345; a@b.org"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = [(s.kind, text[s.start : s.end], s.added) for s in pii.find_spans(df).first().spans]
    assert spans == [("email", "nase.77 [at] mail6.example (dot) com", True), ("phone", "(608) 555-0659", True), ("email", "a@b.org", False)]
    assert pii.mask("x a@b.org y", [(2, 9, "email")]) == "x <email> y"


def test_added_spans_of_neighbourhoods():
    """They are those of whole texts, no card among them fails Luhn, and long tokens have a shape of all their signs."""
    pd = pytest.importorskip("pandas")
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet", columns=["text"]).text.fillna("").tolist()
    docs += ["x" * 80 + " 4111.1111.1111.1111 and 4111.1111.1111.1112", "call (608) 555-0659 or 1234567812345678", "nase.77 [at] mail6.example (dot) com"]
    crf = pii.train(pii.labelled_table())
    base = [pii.base_spans(t) for t in docs]
    near, full = pii.added_spans(docs, base, crf), pii.added_spans(docs, base, crf, None)
    assert near == full
    added = [(k, t[a:b]) for t, spans in zip(docs, near, strict=True) for a, b, k in spans]
    assert all(pii.luhn("".join(re.findall("[0-9]", x))) for k, x in added if k == "card")
    assert ("card", "4111.1111.1111.1111") in added and ("phone", "(608) 555-0659") in added
    assert pii.shape("ab1" * 60 + "@x9") != pii.shape("ab1" * 60) and len(pii.shape("a1" * 5000)[0]) < 40
    assert len(added) < 0.05 * sum(map(len, base)) + 10  # few, as the patterns catch nearly all


def test_viterbi_is_exact():
    r = np.random.default_rng(0)
    crf = pii.Crf({}, np.zeros((1, 5)), r.normal(size=(5, 5)))
    scores = [r.normal(size=(n, 5)) for n in (1, 3, 4)]
    crf.scores = lambda features: scores[len(features[0])]
    paths = crf.decode([[["x"] * i] + [[]] * (len(s) - 1) for i, s in enumerate(scores)])
    for s, path in zip(scores, paths, strict=True):
        total = lambda p, s=s: sum(s[i, x] for i, x in enumerate(p)) + sum(crf.move[a, b] for a, b in itertools.pairwise(p))
        assert tuple(path) == max(itertools.product(range(5), repeat=len(s)), key=total)


def test_pii_query(spark, sf, texts):
    for r in queries.QUERIES["op3_pii"](spark, sf).collect():
        base = brute_spans(texts[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, _, k in base) for x in pii.KINDS]
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))


# ---- tokens


def test_bpe_equals_tiktoken(spark, sf, texts):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    own = bpe.codec()
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for r in queries.QUERIES["op4_bpe"](spark, sf).collect():
        ids = other.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    g = random.Random(1)
    hard = ["", "a" * 3000, "it's 'S we'll", " " * 300 + "x", "\x1c\x1d a\x85b", "日本語🙂"] + ["".join(g.choices("abcdeioustrn ", k=g.randrange(1, 400))) for _ in range(150)] + ["".join(g.choices("abcdeioustrn", k=g.randrange(100, 900))) for _ in range(30)]
    for t, (ids, _) in zip(hard, own.encode(hard), strict=True):
        assert ids.tolist() == other.encode_ordinary(t) and own.decode(ids) == t.encode()
    longest = ["".join(g.choices(letters, k=n)) for letters in ("x", "ab", "abcdefghijklmnopqrstuvwxyz", "etaoinshrdlu", "éàüñ") for n in (127, 129, 1000, 9000)]
    assert all(own._long(t.encode()).tolist() == other.encode_ordinary(t) for t in longest)  # rows of their own length
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    assert {r.doc_id: bytes(r.raw) for r in bpe.decode_documents(bpe.encode_documents(df)).collect()} == {i: t.encode() for i, t in enumerate(hard)}


# ---- WARC


def test_warc_query_equals_sql_on_repeated_rows(spark, tmp_path):
    """Repeated rows, null ids and payloads, and one payload that many pages share."""
    rows = [(1, "a://b/", "x"), (1, "a://b/", "x"), (2, "a://c/", "x"), (2, "a://d/", "x"), (2, "a://d/", "x"), (None, "a://e/", "x"), (None, "a://f/", "y"), (None, "a://f/", "y"), (4, None, None), (5, "u", "")] + [(100 + i, "a://g/", "z") for i in range(300)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES["op5_warc"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(warc.OP5_SQL)
    assert Counter(map(tuple, got.select(want.columns).collect())) == Counter(want.fetchall())
    assert len(rows) == sum(Counter(want.fetchall()).values())


def test_archives(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://h.org/a?q", "<p>\r\n\r\nx</p>"), (2, "http://h.org/", "<p>\r\n\r\nx</p>"), (3, None, "y")], "page_id long, url string, html string")
    path = scratch(spark, "w")
    warc.write_archives(pages, path)
    captures = {r.page_id: r for r in warc.assemble(warc.read_archives(spark, path)).collect()}
    assert bytes(captures[2].response.payload) == b"<p>\r\n\r\nx</p>" and captures[1].response.kind == "revisit" and captures[1].refers_to == 2
    assert captures[1].request.target_uri == "http://h.org/a?q" and captures[3].response.target_uri is None
    monkeypatch.setattr(warc, "MAX_BROADCAST", 0)  # the same where winners are joined by a shuffle
    warc.write_archives(pages, path + "3")
    again = {r.page_id: r for r in warc.assemble(warc.read_archives(spark, path + "3")).collect()}
    assert {i: (r.response.kind, r.refers_to) for i, r in again.items()} == {i: (r.response.kind, r.refers_to) for i, r in captures.items()}
    assert captures[1].response.refers_to == captures[2].record_id
    warc.write_archives(pages, path + "2", least=100)
    assert {r.response.kind for r in warc.assemble(warc.read_archives(spark, path + "2")).collect()} == {"response"}


# ---- toxicity


def test_restoring(texts):
    lm = toxicity.language_model(toxicity.trigram_counts([*texts.values(), "idiot stupid moron pathetic loser worthless clown " * 50])).tolist()
    r = toxicity.Restorer(lm)
    for token, want in {"1d10t": "idiot", "stuuupid": "stupid", "$tupid!": "stupid", "m0r0n,": "moron", "p@thetic": "pathetic", "i.d.i.o.t": "idiot", "plain": "plain"}.items():
        assert r.words(token)[0] == {want}, token
    assert "idiot" in r.words("you i d i o t you")[0]
    assert r.words("x" * 5000 + "1" * 5000)[1] == 1


def test_restoring_is_exact():
    """The best of all ways through the lattice, by trying each; letters beyond the model stay."""
    r = np.random.default_rng(4)
    lm = r.normal(size=(toxicity.SIZE,) * 3).tolist()
    for token in ("1a0", "aab!", "a.b3", "$$a1", "жa1", "aaa7"):
        ways = []
        for way in itertools.product(*toxicity.lattice(token)):
            a = b = 0
            total = 0.0
            for sign, _, cost in way:
                total -= cost
                if sign >= 0:
                    total += lm[a][b][sign]
                    a, b = b, sign
            ways.append((total + lm[a][b][0], "".join(x[1] for x in way)))
        assert toxicity.restore(token, lm) == max(ways)[1], token
    assert toxicity.restore("слово1", lm).startswith("слово")


def test_toxicity_query_equals_brute_force(spark):
    """op6's rows by the definition: sample, features, chi-square, weights and scores, with repeated rows and clashing names."""
    r = random.Random(9)
    words_ = ["table", "green", "river", "walks", "under", "stone"]
    rows = [(i, " ".join(r.choices(words_, k=12) + (["idiot", "m0ron"] if i % 3 == 0 else [])), 1, i % 3 == 0) for i in range(300)]
    docs = [(i, t, 5, "x") for i, t, _, _ in rows] + [(0, rows[0][1], 5, "x")] * 40 + [(None, None, 5, "x")]
    labels = spark.createDataFrame([(i, int(bad)) for i, _, _, bad in rows] + [(0, 0), (10**9, 1), (None, 1)], "doc_id long, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int, `meta.url` string")
    got = toxicity.toxicity(df, labels).collect()
    assert len(got) == len(docs)
    lm = toxicity.language_model(toxicity.trigram_counts(t or "" for _, t, _, _ in docs)).astype(np.float32).tolist()
    restorer = toxicity.Restorer(lm)
    train = [(set(toxicity.features(own)), size, int(bad)) for i, t, _, bad in rows if zlib.crc32(str(i).encode()) % 3 != 1 for own, size in [restorer.words(t)]]
    n, toxic = len(train), sum(y for _, _, y in train)
    seen, ranked = Counter(f for x, _, y in train if y for f in x), []
    other = Counter(f for x, _, y in train if not y for f in x)
    for f, a in seen.items():
        b = other[f]
        chi2 = n * (a * (n - toxic - b) - b * (toxic - a)) ** 2 / max(1, toxic * (n - toxic) * (a + b) * (n - a - b))
        if a >= toxicity.LEAST_DOCS and a * (n - toxic) > b * toxic and chi2 >= toxicity.LEAST_CHI2:
            ranked.append((-chi2, f))
    names = [f for _, f in sorted(ranked)[: toxicity.FEATURES]]
    assert {"idiot", "moron"} <= set(names)
    x = np.array([[f in own for f in names] + [math.log(size + 1) - 5, 1] for own, size, _ in train], np.float32)
    w = toxicity.fit(x, np.array([y for _, _, y in train]))
    for row in got:
        own, size = restorer.words(dict((i, t) for i, t, _, _ in docs)[row.doc_id] or "")
        z = sum(v for f, v in zip(names, w, strict=False) if f in set(toxicity.features(own))) + w[-2] * (math.log(size + 1) - 5) + w[-1]
        assert math.isclose(row.score, 1 / (1 + math.exp(-z)), abs_tol=2e-3)
        assert row.predicted == (row.score >= 0.7) and row.held_out == (row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 3 == 1)


def test_trigram_counts():
    ts = ["Ab", "", "b a"]
    got, n = toxicity.trigram_counts(ts, joined=1), toxicity.SIZE
    assert (got == toxicity.trigram_counts(ts)).sum() > 0
    assert got[(0 * n + 1) * n + 2] == 1 and np.exp(toxicity.language_model(got)).sum(2).round(6).min() == 1


def test_held_out_rows(spark):
    pd = pytest.importorskip("pandas")
    rows = pd.read_parquet("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    df, labels = spark.createDataFrame(rows[["doc_id", "text"]]), spark.createDataFrame(rows[["doc_id", "toxic"]])
    found = toxicity.toxicity(df, labels).toPandas().merge(rows, on="doc_id")
    assert [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id] == found.held_out.tolist()
    out = found[found.held_out]
    assert out[out.predicted == 1].toxic.mean() > 0.95 and out[out.toxic == 1].predicted.mean() > 0.9
    pairs = [(a > b) + (a == b) / 2 for a in out[out.toxic == 1].score for b in out[out.toxic == 0].score.sample(200, random_state=1)]
    assert sum(pairs) / len(pairs) > 0.99


# ---- near copies


@pytest.mark.parametrize("limit", [512, 2])
def test_near_groups(spark, texts, monkeypatch, limit):
    """Also with clusters of more than two members split into blocks."""
    monkeypatch.setattr(near_dedup, "MAX_MEMBERS", limit)
    r, more = random.Random(4), dict(texts)
    vocabulary = [f"w{i}" for i in range(500)]
    for group in range(6):
        base = r.choices(vocabulary, k=r.choice([3, 8, 60, 300]))
        for _ in range(9):
            copy = [w if r.random() > 0.07 else r.choice(vocabulary) for w in base]
            more[len(more) + 1000] = " ".join(copy)
            more[len(more) + 1000] = " ".join(copy).upper() + "\n"
    df = spark.createDataFrame(list(more.items()), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_groups(df, size=2).collect()}
    want = brute_components(more, 2)
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert [i for i in got if got[i] != want[i]] == []


def sketch(text):
    data, offsets = words.buffers(pa.array([text]))
    (s,) = words.shingle_sets(data, offsets, 2)
    regs = near_dedup.registers([s])
    return len(s), regs[0], near_dedup.band_keys(regs)[0]


@pytest.mark.parametrize("members", [1024, 2])
def test_near_groups_of_shared_passages(spark, monkeypatch, members):
    """Linked texts, each of whose common bands has a smaller id, of a text that shares passages only."""
    monkeypatch.setattr(near_dedup, "BAND_MEMBERS", members, raising=False)
    r = random.Random(5)
    base = [f"w{r.randrange(10**9)}" for _ in range(480)]
    pair = {5000: " ".join(base), 6000: " ".join([*base, *(f"e{i}" for i in range(100))])}
    both = [sketch(t) for t in pair.values()]
    bands, texts = set(both[0][2].tolist()) & set(both[1][2].tolist()), {}
    while bands:
        at, chosen = r.randrange(60), sorted(r.sample(range(8), 4))
        text = " ".join([*(w for i in chosen for w in base[at + 60 * i : at + 60 * i + 60]), *(f"o{r.randrange(10**9)}" for _ in range(30))])
        n, regs, keys = sketch(text)
        far = all(near_dedup.corrected((regs == x).sum(), n, m) < near_dedup.ESTIMATE for m, x, _ in both)
        if far and bands & set(keys.tolist()):
            bands -= set(keys.tolist())
            texts[len(texts)] = text
    texts |= pair
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_groups(df, size=2).collect()}
    want = brute_components(texts, 2)
    assert want[6000][1] == want[5000][1] == got[6000][1]
    assert got == want


def test_near_groups_of_stock_lines(spark):
    """6,000 pages that are random halves of 80 stock lines, and near copies of some at 0.8 to 0.95: no link is lost."""
    r = random.Random(11)
    lines = [" ".join(f"w{r.randrange(3000)}" for _ in range(9)) for _ in range(80)]
    pages = [sorted(r.sample(range(80), 40)) for _ in range(6000)]
    for i in range(60):  # a line or two of forty are dropped or swapped
        copy = list(pages[i * 90])
        for _ in range(1 + i % 3):
            copy.remove(r.choice(copy))
        pages.append(copy)
    texts = ["\n".join(lines[k] for k in p) for p in pages]
    sets = [shingles(t, 2) for t in texts]
    column = {s: i for i, s in enumerate(set().union(*sets))}
    has = np.zeros((len(sets), len(column)), np.float32)
    for i, s in enumerate(sets):
        has[i, [column[x] for x in s]] = 1
    both, n = has @ has.T, has.sum(1)
    a, b = np.nonzero(np.triu(100 * both >= 80 * (n[:, None] + n[None, :] - both), 1))
    got = {x.doc_id: x.component_id for x in near_dedup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=2).collect()}
    assert len(a) >= 50 and [(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if got[i] != got[j]] == []
    linked = set(a.tolist()) | set(b.tolist())
    assert [i for i, c in got.items() if i not in linked and c != i] == []


def test_near_labels():
    r = np.random.default_rng(2)
    regs = r.integers(0, 2, (60, near_dedup.REGISTERS)).astype(np.uint16) * r.integers(1, 4, (60, 1)).astype(np.uint16)
    n, side = r.integers(50, 80, 60), r.integers(0, 2, 60)
    for sides in (None, side):
        parent = list(range(60))
        for _ in range(60):
            for i, j in itertools.combinations(range(60), 2):
                est = near_dedup.corrected((regs[i] == regs[j]).sum(), n[i], n[j])
                if est >= near_dedup.ESTIMATE and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j]) and (sides is None or sides[i] != sides[j]):
                    parent[i] = parent[j] = min(parent[i], parent[j])
        got = near_dedup.near_labels(regs, n, 80, sides)
        assert len(set(parent)) > 1
        assert {(i, j) for i, j in itertools.product(range(60), repeat=2) if parent[i] == parent[j]} == {(i, j) for i, j in itertools.product(range(60), repeat=2) if got[i] == got[j]}


def test_near_query(spark, sf, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op7_minhash"](spark, sf).collect()}
    assert got == brute_components(texts, 2)


def test_estimates():
    r, errors = np.random.default_rng(0), []
    for n in r.integers(20, 3000, 200):
        s = np.unique(words.mix(r.integers(0, 2**63, n).astype(np.uint64)))
        part = np.sort(r.permutation(s)[: int(len(s) * 0.8)])
        a, b = near_dedup.registers([s, part])
        errors.append(near_dedup.corrected((a == b).sum(), np.array(len(s)), np.array(len(part))) - len(part) / len(s))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_hot_keys_join_alike(spark):
    rows = spark.createDataFrame([(i if i % 3 else 7, "b", i) for i in range(1500)] + [(-1, "c", i) for i in range(500)], "a long, b string, x long")
    other = spark.createDataFrame([(7, "b", "seven"), (8, "b", "eight"), (10, "z", "none")], "a long, b string, y string")
    assert skew.hot_keys(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")), ["a", "b"]).count() == 2
    for how in ("inner", "left"):
        got, want = skew.join_hot(rows, other, ["a", "b"], how), rows.join(other, ["a", "b"], how)
        assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(300, x) for x in range(301, 900)] + [(2000, x) for x in range(950, 1400)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {x.id: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: p for x, p in parent.items() if x in got} and {x for e in edges if e[0] != e[1] for x in e} == set(got)


# ---- mixing


def test_components_of_bounded_tables_take_one_task(spark, monkeypatch):
    """A bounded edge table takes a few jobs, not rounds of them, and gives what the rounds give: chains, hubs, repeats, loops, negative ids."""
    r = random.Random(12)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000 - i, 5001 - i) for i in range(80)]
    edges += [(r.randrange(6000, 6400), r.randrange(6000, 6400)) for _ in range(250)] + [(7, 7), (9000, 9000), (-3, 5), (2**62, -(2**62))]
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    spark.sparkContext.setJobGroup("few", "")
    got = sorted(map(tuple, components.connected_components(df).collect()))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("more", "")
    monkeypatch.setattr(components, "ONE_TASK", -1)
    assert got == sorted(map(tuple, components.connected_components(df).collect())) and len({i for i, _ in got}) == len(got)
    assert jobs <= 8 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("more"))
    assert components.connected_components(df.limit(0)).isEmpty()


def test_raking_meets_targets(spark):
    r = random.Random(2)
    cells = [(s, la, t, r.randrange(1, 1000)) for s in "abcd" for la in "xy" for t in "pq"]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    w = {(x.source, x.lang, x.topic): x.weight for x in mixing.rake(df).collect()}
    apart = {(x.source, x.lang, x.topic): x.weight for x in mixing.rake(df, sweeps=3, few=False).collect()}
    assert all(math.isclose(apart[c], w[c], rel_tol=1e-6) for c in w)
    total = sum(c[3] for c in cells)
    for d in range(3):
        own, got = Counter(), Counter()
        for c in cells:
            own[c[d]] += c[3]
            got[c[d]] += c[3] * w[c[:3]]
        scale = sum(v**mixing.ALPHA for v in own.values())
        for v in own:
            assert math.isclose(got[v], own[v] ** mixing.ALPHA / scale * total, rel_tol=1e-6)


def test_given_targets_and_yield(spark):
    """Drawn shares are the given ones; with a yield, small cells are kept whole and the rest stay in proportion."""
    r = random.Random(3)
    docs = spark.createDataFrame([(i, "a b c d", "big" if i % 10 else "small", "en" if r.random() < 0.7 else "de") for i in range(6000)], "doc_id long, text string, source string, lang string")
    shares = [("source", "big", 0.6), ("source", "small", 0.4), ("lang", "en", 0.5), ("lang", "de", 0.5), ("topic", "prose", 1.0), ("topic", "none", 3.0)]
    targets = spark.createDataFrame(shares, "dimension string, value string, share double")
    drawn = [x for x in mixing.mix(docs, targets=targets, least=0.0).collect() if x.kept]
    for d, v, share in shares[:4]:
        assert abs(sum(x[d] == v for x in drawn) / len(drawn) - share) < 0.05
    every = mixing.mix(docs, targets=targets, least=0.9).collect()
    assert sum(x.kept for x in every) > 0.88 * len(every) and {x.prob for x in every if x.source == "small"} == {1.0}
    only = mixing.mix(docs, targets=targets.where("value <> 'small'")).collect()
    assert {x.source for x in only if x.kept} == {"big"}


def test_many_cells_join_by_shuffle(documents, monkeypatch):
    documents = documents.where("source in ('src0', 'src1')")
    want = sorted(map(tuple, mixing.mix(documents).collect()))
    monkeypatch.setattr(mixing, "MAX_CELLS", 0)
    got = sorted(map(tuple, mixing.mix(documents).collect()))
    assert [r[0] for r in got] == [r[0] for r in want] and all(abs(a[6] - b[6]) < 1e-5 for a, b in zip(got, want, strict=True))


# ---- quality


def brute_kneser_ney(counts, size):
    """Interpolated modified Kneser-Ney of the order of ``counts`` (by n-gram), straight from the definition."""
    grams = [counts]
    while len(next(iter(grams[0]))) > 1:
        lower = Counter()
        for g in grams[0]:
            lower[g[1:]] += 1
        grams.insert(0, lower)
    cuts, by_context = [], []
    for c in grams:
        n = [max(1, sum(v == k for v in c.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        cuts.append([0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))])
        by_context.append({})
        for x, v in c.items():
            by_context[-1].setdefault(x[:-1], []).append(v)

    def p(g):
        if not g:
            return 1 / size
        d, rest, lower = cuts[len(g) - 1], by_context[len(g) - 1].get(g[:-1]), p(g[1:])
        if not rest:
            return lower
        v = grams[len(g) - 1].get(g, 0)
        return (v - d[min(v, 3)]) / sum(rest) + sum(d[min(x, 3)] for x in rest) / sum(rest) * lower

    return p


def spelt(text):
    """Every n-gram that ends at a sign of the text."""
    k = quality_lm.ORDER
    text = " " * (k - 1) + re.sub("[\t\n\x0b\x0c\r]", " ", text)
    return [text[i : i + k] for i in range(len(text) - k + 1)]


def test_ngrams_of_slices():
    """Stretches of any size give the same n-grams, also where an alphabet is too large for a long one."""
    texts = ["a\tb c", "", "é語" * 9, "x" * 40, "".join(chr(c) for c in range(0x4E00, 0x4E00 + 60000) if not 0xD800 <= c < 0xE000), "end"]
    want = Counter((i, g) for i, t in enumerate(texts) for g in spelt(t))
    for size in (3, 64, 1 << 20):
        got = Counter()
        for numbers, at, alphabet in quality_lm.slices(*quality_lm.signs(texts), size):
            got.update(zip(at.tolist(), quality_lm.spell(numbers, alphabet), strict=True))
        assert got == want


@pytest.mark.parametrize("block", [1 << 25, 200])
def test_quality_query_equals_brute_force(spark, block):
    """Perplexities, thresholds and verdicts, over two scripts, in one block or many."""
    r = random.Random(7)
    docs = {i: " ".join("".join(r.choices("abcdé" if i % 2 else "абвг語", k=r.randrange(1, 5))) + r.choice(["", "", "\n"]) for _ in range(r.randrange(1, 30))) for i in range(60)} | {70: "", 71: "zz" * 200, 72: None, 73: "".join(map(chr, range(0x4E00, 0x5200)))}
    good = [i for i in docs if i < 40]
    rows = [(i, t, None if i == 5 else "xy"[i % 2]) for i, t in docs.items()]
    found = quality_lm.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1) for i in good] + [(50, 0), (None, 1)], "doc_id long, quality int"), block=block).collect()
    held = [i for i in good if zlib.crc32(str(i).encode()) % quality_lm.HELD_OUT == 0]
    counts = Counter(g for i in good if i not in held for g in spelt(docs[i]))
    p = brute_kneser_ney(counts, len({g[-1] for g in counts}) + 1)
    want = {i: math.exp(-sum(math.log(p(g)) for g in spelt(t)) / len(t)) if t else None for i, t in docs.items()}
    assert sorted(x.doc_id for x in found) == sorted(docs)
    for x in found:
        assert x.n_chars == len(docs[x.doc_id] or "") and (x.perplexity is None) == (want[x.doc_id] is None)
        if x.perplexity:
            assert math.isclose(x.perplexity, want[x.doc_id], rel_tol=1e-4)
            own = sorted(want[i] for i in held if "xy"[i % 2] == x.lang) or sorted(want[i] for i in held)
            limit = own[math.ceil(quality_lm.QUANTILE * len(own)) - 1] * quality_lm.MARGIN
            assert math.isclose(x.threshold, limit, rel_tol=1e-4)
        assert x.kept == (x.perplexity is not None and x.perplexity <= x.threshold)


def test_model_grows(spark):
    """No count is capped, and unknown scripts have n-grams of their own."""
    one = spark.createDataFrame([("абв " * 50,), ("語文 " * 50,)], "text string")
    top = {r.gram: r.n for r in quality_lm.levels(one)[-1].collect()}
    assert top == Counter(g for t in ("абв " * 50, "語文 " * 50) for g in spelt(t))
    many = quality_lm.levels(one)[:-1] + [spark.createDataFrame([("aaaa", 2**40), ("aaab", 2**40)], "gram string, n long")]
    p = {r.gram: r.p for r in quality_lm.probabilities(spark.createDataFrame([("aaaa",), ("aaac",)], "gram string"), many).collect()}
    assert abs(p["aaaa"] - 0.5) < 1e-6


def test_perplexity_tells_junk(spark):
    d = "/root/testdata/sf0.01"
    rows = [r for r in queries.QUERIES["op9_quality_lm"](spark, d).join(table(spark, d, "labels"), "doc_id").collect()]
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) > 0.97 * len(good) and sum(not r.kept for r in bad) > 0.5 * len(bad)


def brute_rules(t):
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = Counter(x for x in t.split("\n") if WORD.search(x))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(lines.values()) - len(lines), len(covered)


def test_rules_query(spark, sf, texts):
    for r in queries.QUERIES["op10_quality_rules"](spark, sf).collect():
        want = brute_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed and not r.host_failed)


def test_host_rates(spark):
    rows = [("bad", True)] * 90 + [("bad", False)] * 10 + [("good", False)] * 95 + [("good", True)] * 5 + [("new", True)]
    rates = {r.host: r.rate for r in quality_rules.host_rates(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert rates["good"] < rates["new"] < rates["bad"] and rates["bad"] > quality_rules.HOST_RATE
    alone = spark.range(900).select(F.concat(F.lit("h"), "id").alias("host"), (F.col("id") % 3 == 0).alias("failed"))
    assert quality_rules.host_rates(alone).where(F.col("rate") > quality_rules.HOST_RATE).count() == 0  # one document tells nothing of a host
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    docs = [(i, "junk", "bad") for i in range(200)] + [(500, text, "bad"), (501, text, "ok")] + [(600 + i, text + f" {i}", "ok") for i in range(200)]
    kept = {r.doc_id for r in quality_rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect() if r.kept}
    assert 500 not in kept and 501 in kept and len(kept) == 201


def test_rules_query_equals_sql_with_failing_hosts(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randrange(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs = []
    for host, n, share in (("bad", 60, 0.9), ("poor", 40, 0.6), ("mixed", 50, 0.4), ("good", 400, 0.05), ("tiny", 2, 1.0), (None, 30, 0.95)):
        docs += [(len(docs) + i, r.choice([text(5), "ab " * 60, text(30) + " #" * 90, None, "\n".join(["a line"] * 30)]) if r.random() < share else text(40), host) for i in range(n)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op10_quality_rules"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(quality_rules.OP10_SQL)
    rows = sorted(map(tuple, got.select(want.columns).collect()))
    assert rows == sorted(want.fetchall())
    hosts = {d[2] for d, x in zip(sorted(docs, key=lambda d: d[0]), rows, strict=True) if x[want.columns.index("host_failed")]}
    assert {"bad", None} <= hosts and not hosts & {"good", "tiny", "mixed"}


# ---- words


def test_words_across_slices(monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choices("aB \n\té", k=r.randrange(0, 200))) for _ in range(100)] + [None, "x" * 5000 + " y"]
    data, offsets = words.buffers(pa.array(texts))
    whole = [words.hashes(data, offsets[i : i + 2], True)[0].tolist() for i in range(len(texts))]
    monkeypatch.setattr(words, "SLICE", 16)
    cut = [words.hashes(data, offsets[i : i + 2], True)[0].tolist() for i in range(len(texts))]
    assert whole == cut and [len(x) for x in whole] == [len(WORD.findall(t or "")) for t in texts]
    flat = dict(zip([w.translate(LOWER) for t in texts for w in WORD.findall(t or "")], [h for x in whole for h in x], strict=True))
    assert len(set(flat.values())) == len(flat)
