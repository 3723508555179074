"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Each source gets a mean repetition rate = target share x corpus size / source size. A document's count is the inverse
of the Poisson distribution function at a uniform number hashed from its id, so any task computes the same count again.
Copies are exploded and then dealt over the cluster by a hash of (id, copy).

Skew: sizes are pre-aggregated per source on the map side; the rate table is broadcast only if it has at most
`broadcast_sources` rows, else Spark joins it by shuffle (AQE splits hot sources); the final shuffle key is unique per copy.

Defined results: null texts have size 0; null sources form one source; a source of total size 0 keeps rate 1; a source
missing from given weights gets weight 0; rows with a null id hash as 'null'; repeated rows get equal counts; an empty
table gives an empty result; columns of the input pass through, except that columns named like an output column are
replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = "mix-1"
#: A rate above this is drawn as a sum of several Poisson numbers, since exp(-rate) would underflow.
MAX_RATE = 500.0


def _unit(*parts) -> F.Column:
    """52 bits of md5 as a number from 0 to below 1, exact in double precision."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def _id_text(doc_id: str) -> F.Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, budget: float = 1.0, source: str = "source", text: str = "text") -> tuple[DataFrame, int]:
    """One row per source: __ll_source, size, rate, draws, cdf; and the number of sources.

    Target shares are `weights`, or size ** temperature where none are given; `budget` is the wanted size of the mix as
    a multiple of the corpus.
    """
    sizes = docs.groupBy(F.col(source).alias("__ll_source")).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("bigint").alias("size"))
    if weights is None:
        sizes = sizes.withColumn("__ll_w", F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(temperature))).otherwise(F.lit(0.0)))
    else:
        chosen = F.lit(0.0)
        for name, w in weights.items():
            chosen = F.when(F.col("__ll_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(chosen)
        sizes = sizes.withColumn("__ll_w", F.when(F.col("size") > 0, chosen).otherwise(F.lit(0.0)))
    total = sizes.agg(F.sum("size").alias("n"), F.sum("__ll_w").alias("w"), F.count(F.lit(1)).alias("k")).collect()[0]
    scale = budget * float(total["n"] or 0) / (total["w"] or 1.0)
    rated = sizes.select("__ll_source", "size", F.when(F.col("size") > 0, F.lit(scale) * F.col("__ll_w") / F.col("size")).otherwise(F.lit(1.0)).alias("rate"))
    rated = rated.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE)).cast("int"))
    rated = rated.withColumn("__ll_r", F.col("rate") / F.col("draws"))
    # P(0), P(<=1), ... far enough that the rest is below the 2**-52 steps of the uniform number.
    steps = F.sequence(F.lit(1), F.ceil(F.col("__ll_r") + 12 * F.sqrt("__ll_r") + 30).cast("int"))
    first = F.exp(-F.col("__ll_r"))
    cdf = F.aggregate(
        steps,
        F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda acc, k: F.struct((acc["p"] * F.col("__ll_r") / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * F.col("__ll_r") / k)).alias("c")),
        lambda acc: acc["c"],
    )
    return rated.select("__ll_source", "size", "rate", "draws", cdf.alias("cdf")), int(total["k"])


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, budget: float = 1.0, seed: str = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text", broadcast_sources: int = 10_000, names: tuple[str, str, str] = ("n_copies", "copy", "shuffle_key")) -> DataFrame:
    """docs' columns plus, under the given names, n_copies (int), copy (int, from 0) and shuffle_key (long), in globally shuffled order."""
    n_copies, copy, shuffle_key = names
    rates, n_sources = source_rates(docs, weights, temperature, budget, source, text)
    rates = rates.select("__ll_source", F.col("draws").alias("__ll_draws"), F.col("cdf").alias("__ll_cdf"))
    if n_sources <= broadcast_sources:
        rates = F.broadcast(rates)
    kept = docs.drop(*names)
    joined = kept.join(rates, kept[source].eqNullSafe(F.col("__ll_source")))
    one_draw = lambda j: F.size(F.filter("__ll_cdf", lambda c: c <= _unit(F.lit(seed), _id_text(doc_id), j.cast("string"))))
    several = F.aggregate(F.sequence(F.lit(1), F.col("__ll_draws")), F.lit(0), lambda acc, j: acc + one_draw(j))
    # Almost every source needs one draw; its uniform number is then computed once per row.
    once = F.size(F.filter("__ll_cdf", lambda c: c <= F.col("__ll_u")))
    counted = joined.withColumn("__ll_u", _unit(F.lit(seed), _id_text(doc_id), F.lit("1"))).withColumn(n_copies, F.when(F.col("__ll_draws") == 1, once).otherwise(several))
    copies = counted.where(F.col(n_copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(n_copies) - 1)))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), _id_text(doc_id), F.col(copy).cast("string"))), 1, 15), 16, 10).cast("bigint")
    return copies.drop("__ll_source", "__ll_draws", "__ll_cdf", "__ll_u").withColumn(shuffle_key, key).repartition(shuffle_key).sortWithinPartitions(shuffle_key)


ORACLE_SQL = f"""
WITH sizes AS (
  SELECT source, coalesce(sum(length(text)), 0)::BIGINT AS size FROM documents GROUP BY source
), weighted AS (
  SELECT source, size, CASE WHEN size > 0 THEN pow(size::DOUBLE, 0.5::DOUBLE) ELSE 0e0 END AS w FROM sizes
), rated AS (
  SELECT source, CASE WHEN size > 0 THEN (SELECT sum(size)::DOUBLE / sum(w) FROM weighted) * w / size ELSE 1e0 END AS rate FROM weighted
), steps AS (
  SELECT source, rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate) + 30) + 1)::BIGINT)) AS k FROM rated
), cdf AS (
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM steps
), drawn AS (
  SELECT doc_id, source, ('0x' || substr(md5('{SEED}|' || doc_id::VARCHAR || '|1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496e0 AS u FROM documents
), counted AS (
  SELECT d.doc_id, count(c.k)::INT AS n_copies FROM drawn d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u GROUP BY d.doc_id
), copies AS (
  SELECT doc_id, n_copies, unnest(range(0, n_copies))::INT AS copy FROM counted
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.n_copies, c.copy,
       ('0x' || substr(md5('{SEED}|order|' || d.doc_id::VARCHAR || '|' || c.copy::VARCHAR), 1, 15))::BIGINT AS shuffle_key
FROM copies c JOIN documents d USING (doc_id)
"""
