"""Near-duplicate detection by HyperMinHash, then verification on full shingle sets.

1. Each document becomes 128 registers of 16 bits: of the least shingle hash in each bucket the
   count of leading zeros (6 bits) and the bits after the first one (10 bits). Empty buckets
   borrow from others in an order of their own, so any register agrees with the probability
   of the Jaccard similarity.
2. Documents with equal sets collapse into one class.
3. 32 bands of 4 registers; classes that share a band are compared by registers with the band's
   smallest member, and stay together at an estimate, corrected for chance collisions, of 0.5
   (two copies of one original, each at 0.8 to it, are still at 0.6 to one another). Where some
   aren't near that member, all others of the band are compared with each other, large bands in
   blocks; only pairs whose sizes rule the similarity out are skipped, and such as are together.
4. In each cluster so formed all pairs are decided on full sets. Pairs already connected are
   skipped, and the text that shares most comes first, so a cluster takes few passes over its sets.
   Clusters too large for a task are split into blocks, all compared with the best connected
   members; what is still apart then meets every other block of its cluster.

Defined results: null or blank text has an empty set and links with nothing; a null id links with
nothing and is kept, with a null component; rows with one id are one node, kept or dropped
together; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.llm import words
from helixspark.llm.components import connected_components
from helixspark.llm.text import named, whole
from helixspark.session import cut, release, ship, table

BUCKET_BITS, MANTISSA = 7, 10
REGISTERS = 1 << BUCKET_BITS
BANDS, ROWS = 32, 4
#: The least corrected estimate at which two classes stay in one cluster.
ESTIMATE = 0.6
#: A cluster is decided in one task up to so many members and shingles.
MAX_MEMBERS, MAX_SHINGLES = 512, 1_000_000
PIVOTS = 8
#: Members of a band are compared with each other in blocks of about so many, each pair of blocks in one task.
BAND_MEMBERS = 1024
#: Ids (of clustered documents, or of those to drop) are broadcast up to so many (16 MB), joined by a shuffle of the texts beyond.
MAX_BROADCAST = 1_000_000
_U = np.uint64
_ORDER = np.stack([np.random.default_rng(j).permutation(REGISTERS) for j in range(REGISTERS)])
_BAND_SALT = words.mix(np.arange(1, BANDS + 1).astype(np.uint64))
SKETCH = "doc_id long, n long, set_a long, set_b long, registers binary, bands array<long>"


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each non-empty sorted set of hashes."""
    rest, full = np.zeros((len(sets), REGISTERS), np.uint64), np.zeros((len(sets), REGISTERS), bool)
    edges = np.arange(REGISTERS).astype(np.uint64) << _U(64 - BUCKET_BITS)
    for k, u in enumerate(sets):
        at = np.searchsorted(u, edges)
        least = u[np.minimum(at, len(u) - 1)]
        full[k] = (at < len(u)) & (least >> _U(64 - BUCKET_BITS) == edges >> _U(64 - BUCKET_BITS))
        rest[k] = least << _U(BUCKET_BITS)
    bits = 64 - BUCKET_BITS
    zeros = np.minimum(64 - np.frexp(rest.astype(np.float64))[1], bits)
    zeros[rest == 0] = bits
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> _U(64 - MANTISSA)
    found = (zeros.astype(np.uint64) << _U(MANTISSA) | mantissa).astype(np.uint16)
    own, filled = found.copy(), full.copy()
    for t in range(REGISTERS):
        row, bucket = np.nonzero(~filled)
        if not len(row):
            break
        donor = _ORDER[bucket, t]
        has = full[row, donor]
        row, bucket, donor = row[has], bucket[has], donor[has]
        found[row, bucket] = own[row, donor]
        filled[row, bucket] = True
    return found


def band_keys(regs: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(_BAND_SALT, (len(regs), BANDS)).copy()
    for i in range(ROWS):
        keys = words.mix(keys ^ regs[:, i : BANDS * ROWS : ROWS].astype(np.uint64))
    return keys


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.buffers(batch.column(1))
            for i, j in words.slices(offsets):
                sets = list(words.shingle_sets(data, offsets[i : j + 1], size))
                n = np.array([len(s) for s in sets])
                regs = registers([s if len(s) else np.zeros(1, np.uint64) for s in sets])
                keys = band_keys(regs).astype(np.int64)
                some = n > 0
                a = np.array([np.bitwise_xor.reduce(words.mix(s + _U(1))) if len(s) else 0 for s in sets], np.uint64).astype(np.int64)
                b = np.array([np.add.reduce(words.mix(s ^ _U(0xA5A5A5A5A5A5A5A5))) if len(s) else 0 for s in sets], np.uint64).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]), pa.int32()), pa.array(keys[some].ravel()))
                raw = pa.array([r.tobytes() if k else b"" for r, k in zip(regs, some, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(a), pa.array(b), raw, lists], ["doc_id", "n", "set_a", "set_b", "registers", "bands"])

    return run


def corrected(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate from agreeing registers, less the collisions to expect of different values."""
    ratio = np.minimum(n, m) / np.maximum(n, m)
    chance = 0.169919487159739 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    share = agree / REGISTERS
    return np.clip((share - chance) / (1 - chance), 0, 1)


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.Table.from_batches([batch])
        a, b = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
        est = corrected((a == b).sum(1), t.column("n_a").to_numpy(), t.column("n_b").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(est)], ["a", "b", "estimate"])


def near_labels(regs: np.ndarray, n: np.ndarray, percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """A label for each row of registers: equal for all that a chain of estimates of ESTIMATE connects.

    Pairs whose sizes ``n`` rule out the similarity, and with ``side`` those of one side, aren't compared.
    """
    order = np.argsort(n, kind="stable")
    regs, n, labels = regs[order], n[order], np.arange(len(n))
    side = None if side is None else side[order]
    ends = np.searchsorted(n, 100 * n // percent, "right")
    for p in range(len(n)):
        others = labels[p + 1 : ends[p]] != labels[p]
        if side is not None:
            others &= side[p + 1 : ends[p]] != side[p]
        others = np.flatnonzero(others) + p + 1
        if not len(others):
            continue
        est = corrected((regs[others] == regs[p]).sum(1), n[others], n[p])
        found = np.unique(labels[others[est >= ESTIMATE]])
        if len(found):
            labels[np.isin(labels, found)] = labels[p]
    back = np.empty_like(labels)
    back[order] = labels
    return back


def _within_band(percent: int):
    def run(group: pa.Table) -> pa.Table:
        ids, block = group.column("b").to_numpy(), group.column("block").to_numpy()
        regs = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        one = group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
        labels = near_labels(regs, group.column("n").to_numpy(), percent, None if one else block)
        first = np.unique(labels, return_index=True, return_inverse=True)
        return pa.table({"a": ids[first[1]][first[2]], "b": ids})

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.buffers(batch.column(1))
            for i, j in words.slices(offsets):
                sets = list(words.shingle_sets(data, offsets[i : j + 1], size))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "shingles"])

    return run


def linked_labels(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, percent: int) -> np.ndarray:
    """Labels after joining all items whose sets, laid end to end in ``flat``, have the similarity.

    Items with equal labels are connected already. Every pair of different labels is decided.
    """
    labels, at = labels.copy(), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    if len(sizes) == 2:
        both = len(np.intersect1d(flat[: sizes[0]], flat[sizes[0] :], assume_unique=True))
        if 100 * both >= percent * (sizes.sum() - both):
            labels[:] = labels.min()
        return labels
    inv = np.unique(flat, return_inverse=True)[1]
    shared = np.add.reduceat(np.bincount(inv)[inv], at) / sizes
    mark = np.zeros(inv.max() + 1, bool)
    for p in np.argsort(-shared, kind="stable"):
        if not ((labels != labels[p]) & (100 * np.minimum(sizes, sizes[p]) >= percent * np.maximum(sizes, sizes[p]))).any():
            continue
        own = inv[at[p] : at[p] + sizes[p]]
        mark[own] = True
        both = np.add.reduceat(mark[inv], at, dtype=np.int64)
        mark[own] = False
        found = np.unique(labels[100 * both >= percent * (sizes + sizes[p] - both)])
        labels[np.isin(labels, found)] = found.min()
        if (labels == labels[0]).all():
            break
    return labels


def _every_block():
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block")


def _decide(percent: int):
    def run(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").to_numpy()
        shingles = group.column("shingles").combine_chunks()
        found = linked_labels(shingles.flatten().to_numpy(), shingles.value_lengths().to_numpy().astype(np.int64), group.column("label").to_numpy(), percent)
        return pa.table({"a": ids, "b": found})

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. ``size``: words in a shingle."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    sketches = cut(rows.mapInArrow(_sketches(size), SKETCH))
    key = ["n", "set_a", "set_b"]
    texts = sketches.where("n > 0 and doc_id is not null")
    classes = cut(texts.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("registers").alias("registers"), F.first("bands").alias("bands")))
    # rows with one id are one node: the smallest id stands for a class, so such ids link their classes
    twice = cut(texts.groupBy("doc_id").agg(F.min("set_a").alias("x"), F.max("set_a").alias("y")).where("x <> y").select("doc_id"))
    same = texts.join(twice, "doc_id").join(classes.select(*key, "rep"), key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    release(spark)

    banded = classes.select("rep", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.min("rep").alias("a")).where("k > 1")
    shared = cut(banded.join(buckets, "band").select("band", "a", F.col("rep").alias("b"), "k"))
    pairs = cut(shared.groupBy("a", "b").agg(F.sum("k").alias("k")))
    release(spark)
    degree = pairs.groupBy(F.col("b").alias("doc_id")).agg(F.sum("k").alias("degree"))
    own = classes.select("rep", F.col("n").alias("n"), "registers")
    compared = pairs.where("a <> b").select("a", "b").join(own.toDF("a", "n_a", "regs_a"), "a").join(own.toDF("b", "n_b", "regs_b"), "b")
    star = cut(compared.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(_estimates, "a long, b long, estimate double"))
    release(spark)
    near = star.where(F.col("estimate") >= ESTIMATE).select("a", "b")
    # members that aren't near their band's smallest may be near any other of the band
    far = star.where(F.col("estimate") < ESTIMATE).select("a", "b")
    within = _near_within_bands(shared, far, own, percent)
    clusters = connected_components(near if within is None else near.unionByName(within)).toDF("doc_id", "cluster")
    release(spark)

    links = _verified(rows, clusters, classes, degree, size, percent)
    if not twice.isEmpty():
        links = links.unionByName(same)
    components = connected_components(links).toDF("rep", "component")
    node = classes.select(*key, "rep").join(components, "rep", "left").select(*key, F.coalesce("component", "rep").alias("component"))
    found = sketches.join(cut(node), key, "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _near_within_bands(shared: DataFrame, far: DataFrame, own: DataFrame, percent: int) -> DataFrame | None:
    """Edges a, b between near members of the bands in which some member is far from the smallest."""
    undecided = shared.where("k > 2")
    open_bands = undecided.join(far, ["a", "b"], "left_semi").select("band").distinct()
    members = cut(undecided.where("a <> b").join(open_bands, "band", "left_semi"))
    if members.isEmpty():
        return None
    members = members.withColumn("blocks", F.ceil(F.col("k") / F.lit(BAND_MEMBERS)).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("b"), "blocks")).select("band", "b", "block", "blocks")
    asked = members.join(own.toDF("b", "n", "registers"), "b").select("band", "b", "n", "registers", F.col("block").alias("own"), "blocks", _every_block())
    pairs = asked.select("band", F.least("own", "block").alias("lo"), F.greatest("own", "block").alias("hi"), "b", "n", "registers", F.col("own").alias("block"))
    decide = _within_band(percent)
    return pairs.groupBy("band", "lo", "hi").applyInArrow(lambda t: decide(t), "a long, b long").where("a <> b").distinct()


def _verified(rows: DataFrame, clusters: DataFrame, classes: DataFrame, degree: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges a, b that connect what is linked within each cluster."""
    members = cut(clusters.join(classes.select(F.col("rep").alias("doc_id"), "n"), "doc_id"))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("k") / F.lit(MAX_MEMBERS), F.col("shingles") / F.lit(MAX_SHINGLES))).cast("int")
    members = members.join(cut(sizes.select("cluster", blocks.alias("blocks"))), "cluster")
    wanted = members.select("doc_id")
    wanted = F.broadcast(wanted) if members.count() <= MAX_BROADCAST else wanted
    sets = rows.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(size), "doc_id long, shingles array<long>")
    sets = cut(sets.where(F.size("shingles") > 0))
    release(rows.sparkSession)
    placed = members.join(sets, "doc_id").withColumn("label", F.col("doc_id"))
    decide, edges = _decide(percent), "a long, b long"
    columns = ["doc_id", "shingles", "label"]
    small = placed.where("blocks = 1").select("cluster", *columns).groupBy("cluster").applyInArrow(lambda t: decide(t), edges).where("a <> b")

    large = cut(placed.where("blocks > 1").select("cluster", "blocks", F.pmod(F.xxhash64("doc_id"), "blocks").alias("block"), *columns))
    if large.isEmpty():
        return small
    best = F.row_number().over(W.partitionBy("cluster").orderBy(F.col("degree").desc(), "doc_id"))
    pivots = large.select("cluster", "blocks", "doc_id").join(degree, "doc_id").withColumn("best", best).where(F.col("best") <= PIVOTS)
    pivots = pivots.select("doc_id").join(large, "doc_id")
    everywhere = pivots.select("cluster", _every_block(), *columns, "blocks", F.col("block").alias("home")).where("block <> home")
    first = large.select("cluster", "block", *columns).unionByName(everywhere.select("cluster", "block", *columns))
    met = cut(first.groupBy("cluster", "block").applyInArrow(lambda t: decide(t), edges).where("a <> b"))
    labels = cut(connected_components(met).toDF("doc_id", "found"))
    large = cut(large.join(labels, "doc_id", "left").withColumn("label", F.coalesce("found", "doc_id")).drop("found"))
    # what isn't in the largest part of its cluster meets every block
    parts = large.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k"))
    main = parts.groupBy("cluster").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    apart = large.join(cut(main), "cluster").where("label <> main").drop("main")
    homes = cut(apart.select("cluster", F.col("block").alias("from")).distinct())
    homes = F.broadcast(homes) if homes.count() <= MAX_BROADCAST else homes
    asked = apart.select("cluster", F.col("block").alias("from"), _every_block(), *columns)
    there = large.join(homes, "cluster").select("cluster", "from", "block", *columns)
    own = asked.where("`from` <> block").unionByName(there)
    rest = own.groupBy("cluster", "from", "block").applyInArrow(lambda t: decide(t), edges).where("a <> b")
    return small.unionByName(met).unionByName(rest)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, whole, one of each group of near copies: that with the smallest id."""
    dropped = cut(near_groups(docs, id_col, text_col, size, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct())
    dropped = F.broadcast(dropped) if dropped.count() <= MAX_BROADCAST else dropped
    rows = docs.select(whole(docs).alias("doc"), named(id_col).cast("long").alias("id"))
    return rows.join(dropped, rows["id"] == dropped["gone"], "left_anti").select("doc.*")


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), size=2)
