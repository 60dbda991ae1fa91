"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked until their sums meet the target shares
of every source, language and topic: given ones, or the token shares to a power, by which large
values give way to small ones. A cell's weight over its tokens, to a scale and 1 at most, is the
probability with which each of its documents is drawn. The scale is the largest cell's weight, so that what is
drawn has the target shares in expectation, or smaller where that would draw less than a given share
of all tokens; then cells that are too small for their target are kept whole. Drawing goes by a
hash of the id, so it repeats exactly.

Defined results: a null source or language counts as empty; a null text has the topic prose and
one token, as an empty one; repeated rows are drawn together; values without a given target have none
of the mix, targets of values that don't occur are left out; an empty table gives an empty result;
other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.llm.skew import join_hot
from helixspark.llm.text import WORD, named, utf8, whole
from helixspark.session import cut, table

#: Up to so many cells are raked in one task and broadcast; beyond, every step is an aggregation and a join.
MAX_CELLS = 100_000
#: Target shares go as token shares to this power, where none are given.
ALPHA = 0.7
#: Sweeps between tests of convergence, and the largest share by which a value may miss its target then; at most ROUNDS tests.
SWEEPS, TOLERANCE, ROUNDS = 10, 1e-9, 10
#: The share of all tokens that is drawn at least, and the scales that are tried: powers of 2 ** (1 / 8).
YIELD, SCALES = 0.5, 128
DIMS = ("source", "lang", "topic")


def topic(text: Column) -> Column:
    """A coarse topic by marks in the text: the first that applies."""
    return (
        F.when(F.contains(text, F.lit("icense")) | F.contains(text, F.lit("opyright")), "legal")
        .when(F.contains(text, F.lit(" | ")), "tabular")
        .when(F.contains(text, F.lit("@")), "contact")
        .otherwise("prose")
    )


def _described(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = utf8(named(text_col))
    seed = F.coalesce(named(id_col).cast("string"), text)
    return [
        named(id_col).alias("doc_id"), utf8(F.col("source")).alias("source"), utf8(F.col("lang")).alias("lang"), topic(text).alias("topic"),
        F.greatest(F.regexp_count(text, F.lit(WORD)), F.lit(1)).cast("long").alias("n_tokens"),
        (F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)).alias("draw"),
    ]


def _aimed(cells: DataFrame, alpha: float, targets: DataFrame | None) -> DataFrame:
    """``cells`` with x, their tokens, and for each dimension the tokens that their value is to have."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    for d in DIMS:
        own = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("sum"))
        if targets is None:
            own = own.withColumn("share", F.pow("sum", F.lit(alpha)))
        else:
            given = targets.where(F.col("dimension") == d).groupBy(F.col("value").alias(d)).agg(F.sum("share").cast("double").alias("share"))
            own = own.join(given, d, "left").na.fill(0.0, ["share"])
        own = cut(own)
        shares = own.agg(F.sum("share")).first()[0] or 1.0
        cells = cells.join(own.select(d, (F.col("share") / shares * total).alias(f"target_{d}")), d)
    return cut(cells.withColumn("x", F.col("tokens").cast("double")))


def _fitted(d: str, sums: Column) -> Column:
    """x so that the sums of this dimension are its targets."""
    return F.when(sums > 0, F.col("x") * F.col(f"target_{d}") / sums).otherwise(0.0)


def _miss(cells: DataFrame) -> float:
    """The largest distance of a value's share from its target."""
    total = cells.agg(F.sum("x")).first()[0] or 1.0
    return max(cells.groupBy(d).agg(F.abs(F.sum("x") - F.first(f"target_{d}")).alias("off")).agg(F.max("off")).first()[0] or 0.0 for d in DIMS) / total


def rake(cells: DataFrame, alpha: float = ALPHA, targets: DataFrame | None = None, sweeps: int = SWEEPS, few: bool = True) -> DataFrame:
    """source, lang, topic, tokens, weight: the factor of each cell's tokens after raking.

    ``cells`` has source, lang, topic and tokens (over 0). ``targets``: dimension, value, share.
    ``few``: all in one task, by windows that don't shuffle.
    """
    cells = _aimed(cells, alpha, targets)
    cells = cells.coalesce(1) if few else cells
    for _ in range(ROUNDS):
        for _ in range(sweeps):
            for d in DIMS:
                if few:
                    cells = cells.withColumn("x", _fitted(d, F.sum("x").over(W.partitionBy(d))))
                else:
                    sums = cells.groupBy(d).agg(F.sum("x").alias("sum"))
                    cells = cut(cells.join(sums, d).withColumn("x", _fitted(d, F.col("sum"))).drop("sum"))
        cells = cut(cells)
        if _miss(cells) <= TOLERANCE:
            break
        cells = cells.coalesce(1) if few else cells
    return cells.select(*DIMS, "tokens", (F.col("x") / F.col("tokens")).alias("weight"))


def _scale(raked: DataFrame, least: float) -> float:
    """The largest weight, or the first of smaller scales that draws ``least`` of all tokens."""
    top = raked.agg(F.max("weight")).first()[0] or 1.0
    tried = raked.select("tokens", "weight", F.explode(F.sequence(F.lit(0), F.lit(SCALES))).alias("j"))
    drawn = tried.groupBy("j").agg((F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") / (F.lit(top) * F.pow(F.lit(2.0), -F.col("j") / F.lit(8.0))))) / F.sum("tokens")).alias("drawn"))
    j = drawn.where(F.col("drawn") >= least).agg(F.min("j")).first()[0]
    return top * 2.0 ** (-(SCALES if j is None else j) / 8.0)


def _weights(rows: DataFrame, alpha: float, targets: DataFrame | None, least: float) -> tuple[DataFrame, bool]:
    """weight and prob of each cell, and whether the cells are few."""
    cells = cut(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))
    few = cells.count() <= MAX_CELLS
    raked = rake(cells, alpha, targets, few=few)
    return raked.select(*DIMS, "weight", F.least(F.lit(1.0), F.col("weight") / F.lit(_scale(raked, least))).alias("prob")), few


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, targets: DataFrame | None = None, least: float = YIELD) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, weight, prob, kept. No document moves."""
    rows = cut(docs.select(*_described(docs, id_col, text_col)))
    weights, few = _weights(rows, alpha, targets, least)
    found = rows.join(F.broadcast(weights), list(DIMS)) if few else join_hot(rows, weights, DIMS)
    return found.select("doc_id", *DIMS, "n_tokens", F.round("weight", 6).alias("weight"), F.round("prob", 6).alias("prob"), (F.col("draw") < F.col("prob")).alias("kept"))


def draw_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, targets: DataFrame | None = None, least: float = YIELD) -> DataFrame:
    """The drawn documents, whole."""
    described = _described(docs, id_col, text_col)
    weights, few = _weights(docs.select(*described), alpha, targets, least)
    rows = docs.select(whole(docs).alias("doc"), *described)
    found = rows.join(F.broadcast(weights), list(DIMS)) if few else join_hot(rows, weights, DIMS)
    return found.where("draw < prob").select("doc.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _sql() -> str:
    steps = [r"""
d0 as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, coalesce(text, '') as text, coalesce(cast(doc_id as varchar), text, '') as seed from documents),
d as (select doc_id, source, lang, case when contains(text, 'icense') or contains(text, 'opyright') then 'legal' when contains(text, ' | ') then 'tabular' when contains(text, '@') then 'contact' else 'prose' end as topic,
             greatest(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 1) as n_tokens, cast(('0x' || substr(md5(seed), 1, 8)) as bigint) / 4294967296.0 as draw from d0),
c0 as (select source, lang, topic, cast(sum(n_tokens) as double) as tokens from d group by all),
c1 as (select *, sum(tokens) over (partition by source) as sum_source, sum(tokens) over (partition by lang) as sum_lang, sum(tokens) over (partition by topic) as sum_topic from c0)""",
    "x0 as (select *, tokens as x, " + ", ".join(f"pow(sum_{d}, {ALPHA}) / sum(pow(sum_{d}, {ALPHA}) * tokens / sum_{d}) over () * sum(tokens) over () as target_{d}" for d in DIMS) + " from c1)"]
    sweeps = 3 * SWEEPS  # the driver's tables have converged by then
    for i in range(3 * sweeps):
        d = DIMS[i % 3]
        steps.append(f"x{i + 1} as (select * replace (x * target_{d} / sum(x) over (partition by {d}) as x) from x{i})")
    steps.append(f"w0 as (select source, lang, topic, tokens, x / tokens as weight, max(x / tokens) over () as top from x{3 * sweeps})")
    steps.append(f"y as (select j, sum(tokens * least(1.0, weight / (top * pow(2.0, -j / 8.0)))) / sum(tokens) as drawn from w0 cross join generate_series(0, {SCALES}) as s(j) group by j)")
    steps.append(f"z as (select pow(2.0, -coalesce(min(j) filter (drawn >= {YIELD}), {SCALES}) / 8.0) as factor from y)")
    steps.append("w as (select source, lang, topic, weight, least(1.0, weight / (top * factor)) as prob from w0 cross join z)")
    return f"with {', '.join(steps)} select doc_id, source, lang, topic, cast(n_tokens as bigint) as n_tokens, round(weight, 6) as weight, round(prob, 6) as prob, draw < prob as kept from d join w using (source, lang, topic)"


OP8_SQL = _sql()
