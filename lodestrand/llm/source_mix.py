"""Mixing sources to target weights: temperature, budget and block permutations.

Source i with token share p_i gets the weight p_i**a / sum(p_j**a). The
exponent a is bisected: the largest a whose weights reach a target entropy,
but never so small that a source would be repeated beyond a limit. A token
budget then gives each source a quota, which is filled by whole passes
(epochs) over its documents: in each pass the source's blocks are permuted,
and the documents inside each block. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, join_counted, long_hash, staged, whole_text

STEPS = 50
SEED = 17


def n_words(name: str = "text") -> Column:
    """Words of the text, as its measure of tokens; null has none."""
    return F.regexp_count(whole_text(name), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _bisect(ok, rising: bool) -> Column:
    """Bisects [0, 1] for the edge of a monotone condition and returns the side where it holds."""
    def step(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        good = ok(mid)
        return F.struct(F.when(good == F.lit(rising), s["lo"]).otherwise(mid).alias("lo"), F.when(good == F.lit(rising), mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step, lambda s: s["hi"] if rising else s["lo"])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def source_weights(totals: DataFrame, entropy_share: float | None = 0.97, max_repeat: float = 4.0, budget_share: float | None = 1.0) -> DataFrame:
    """One row per source: src, tokens, exponent, weight, quota, epochs.

    totals: (src, tokens), tokens > 0. entropy_share: target entropy as a share
    of that of equal weights (None: only the limit counts). budget_share:
    budget in units of all tokens; None takes the least budget with which every
    source is read at least once. max_repeat: no source is read more often,
    unless even natural weights (exponent 1) do so. Sources are grouped into
    one row, so they are assumed to be few, unlike documents.
    """
    one = totals.agg(F.array_sort(F.collect_list(F.struct("src", "tokens"))).alias("s"))
    share = F.transform("s", lambda x: x["tokens"].cast("double") / _sum(F.transform("s", lambda y: y["tokens"].cast("double"))))
    one = one.withColumn("p", share)
    powered = lambda a: F.transform("p", lambda p: F.pow(p, a))
    # entropy of w = q / Q: ln Q - sum(q ln q) / Q
    entropy = lambda a: F.log(_sum(powered(a))) - _sum(F.transform(powered(a), lambda q: q * F.log(q))) / _sum(powered(a))
    ratio = lambda a: F.transform("p", lambda p: F.pow(p, a - 1))
    if budget_share is None:
        repeat = lambda a: F.array_max(ratio(a)) / F.array_min(ratio(a))
    else:
        repeat = lambda a: F.lit(float(budget_share)) * F.array_max(ratio(a)) / _sum(powered(a))
    floor_a = _bisect(lambda a: repeat(a) <= F.lit(float(max_repeat)), rising=True)
    wanted = floor_a if entropy_share is None else F.greatest(floor_a, _bisect(lambda a: entropy(a) >= F.lit(float(entropy_share)) * F.log(F.size("s").cast("double")), rising=False))
    one = one.withColumn("exponent", F.round(wanted, 9))
    one = one.withColumn("w", F.transform(powered(F.col("exponent")), lambda q: F.round(q / _sum(powered(F.col("exponent"))), 12)))
    whole = _sum(F.transform("s", lambda x: x["tokens"].cast("double")))
    reach = F.array_max(F.zip_with("p", "w", lambda p, w: p / w)) if budget_share is None else F.lit(float(budget_share))
    one = one.withColumn("budget", F.floor(F.round(whole * reach, 3)))
    rows = one.select("exponent", "budget", F.explode(F.arrays_zip("s", "w")).alias("x"))
    # under the least budget every source is read in full at least
    quota = F.floor(F.round(F.col("x.w") * F.col("budget"), 3))
    quota = F.greatest(quota, F.col("x.s.tokens")) if budget_share is None else quota
    return rows.select(F.col("x.s.src").alias("src"), F.col("x.s.tokens").alias("tokens"), "exponent", F.col("x.w").alias("weight"), quota.alias("quota")).withColumn(
        "epochs", F.greatest(F.lit(1), F.ceil(F.col("quota") / F.col("tokens"))).cast("int")
    )


def mixed(docs: DataFrame, entropy_share: float | None = 0.97, max_repeat: float = 4.0, budget_share: float | None = 1.0, block_rows: int = 4096, mix_tokens: int = 1_000_000, seed: int = SEED) -> DataFrame:
    """One row per drawn copy: row_key, src, epoch, n_tokens, start_token, mix_block.

    docs: (row_key, source, n_tokens). A null source is the source ''. A copy
    is drawn if it starts below its source's quota, counted over all epochs;
    documents without tokens follow the same rule, and so does a source without
    any token (read once). Under the least budget (budget_share=None) the first
    pass draws every document, also those without tokens at its end. No window holds more than one block of documents,
    about block_rows of them, or the list of a source's blocks. mix_block
    deals each source evenly over blocks of about mix_tokens, so that every
    block has the target weights. Copies of one row_key share their places.
    """
    rows = staged(docs.select("row_key", F.coalesce("source", F.lit("")).alias("src"), "n_tokens"), "sizes")
    sums = staged(rows.groupBy("src").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("_rows")), "sources")
    plan = source_weights(sums.where("tokens > 0").select("src", "tokens"), entropy_share, max_repeat, budget_share)
    plan = sums.select("src", "_rows", F.ceil(F.col("_rows") / block_rows).alias("_blocks")).join(plan, "src", "left").na.fill({"quota": 1, "epochs": 1, "tokens": 0})
    # one row per source; large sources are broadcast, of which there are few, the others meet by key
    rows = join_counted(rows, sums.select("src", "_rows", F.ceil(F.col("_rows") / block_rows).alias("_blocks")), ["src"], "_rows").drop("_rows").withColumn("_block", F.pmod(long_hash(F.lit(str(seed)), F.lit("block"), F.col("row_key")), F.col("_blocks")))
    blocks = rows.groupBy("src", "_block").agg(F.sum("n_tokens").alias("_size"))
    passes = blocks.join(plan, "src").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    drawn = "{} < quota or epoch = 0 and quota >= tokens" if budget_share is None else "{} < quota"
    in_pass = Window.partitionBy("src", "epoch").orderBy(long_hash(F.lit(str(seed)), F.col("epoch"), F.col("src"), F.lit("block"), F.col("_block")), "_block").rowsBetween(Window.unboundedPreceding, -1)
    passes = passes.withColumn("_offset", F.col("epoch") * F.col("tokens") + F.coalesce(F.sum("_size").over(in_pass), F.lit(0))).where(drawn.format("_offset"))
    copies = rows.select("row_key", "src", "n_tokens", "_block").join(passes.select("src", "_block", "epoch", "_offset", "quota", "tokens"), ["src", "_block"])
    in_block = Window.partitionBy("src", "_block", "epoch").orderBy(long_hash(F.lit(str(seed)), F.col("epoch"), F.col("row_key")), "row_key").rowsBetween(Window.unboundedPreceding, -1)
    copies = copies.withColumn("start_token", F.col("_offset") + F.coalesce(F.sum("n_tokens").over(in_block), F.lit(0))).where(drawn.format("start_token"))
    total = plan.agg(F.greatest(F.lit(1), F.ceil(F.sum("quota") / mix_tokens)).alias("_mix_blocks"))
    return copies.join(F.broadcast(total)).select(  # total is one row
        "row_key", "src", "epoch", "n_tokens", "start_token", F.least(F.floor(F.col("start_token").cast("double") / F.col("quota") * F.col("_mix_blocks")), F.col("_mix_blocks") - 1).cast("long").alias("mix_block")
    )


def mix_rows(docs: DataFrame, max_repeat: float = 2.0, **options) -> DataFrame:
    """docs with every row as often as the mix draws it, same columns; by default each row once at least.

    Rows are told apart by source, doc_id and text; rows that are equal in all
    three are drawn together. A null source is the source '', null and empty
    texts have no words; an empty table gives an empty result.
    """
    options = {"entropy_share": None, "budget_share": None} | options
    key = F.sha2(F.concat_ws(":", F.coalesce("source", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), whole_text()), 256)
    name, times = free_name(docs, "row_key"), free_name(docs, "times")
    sizes = docs.select(key.alias("row_key"), "source", n_words().alias("n_tokens")).groupBy("row_key", "source").agg(F.sum("n_tokens").alias("n_tokens"))
    drawn = mixed(sizes, max_repeat=max_repeat, **options).groupBy(F.col("row_key").alias(name)).agg(F.count(F.lit(1)).cast("int").alias(times))
    return docs.withColumn(name, key).join(drawn, name).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mixed() of all documents, with words as tokens, at 0.97 of the entropy of equal weights and a budget of all words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs.select(F.col("doc_id").alias("row_key"), "source", n_words().alias("n_tokens"))).select(F.col("row_key").alias("doc_id"), F.col("src").alias("source"), "epoch", "n_tokens", "start_token", "mix_block")


_H = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"

OP10_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), t AS (SELECT src, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS n FROM d GROUP BY src),
p AS (SELECT src, tokens, CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM t) AS p FROM t WHERE tokens > 0),
limits(k, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT k, lo, hi, (lo + hi) / 2 AS mid, (SELECT max(p ** ((lo + hi) / 2 - 1)) / sum(p ** ((lo + hi) / 2)) <= 4 FROM p) AS ok FROM limits WHERE k < {STEPS})
), spread(k, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT k, lo, hi, (lo + hi) / 2 AS mid,
           (SELECT ln(sum(q)) - sum(q * ln(q)) / sum(q) >= 0.97 * ln(count(*)) FROM (SELECT p ** ((lo + hi) / 2) AS q FROM p)) AS ok FROM spread WHERE k < {STEPS})
), a AS (SELECT round(greatest((SELECT hi FROM limits WHERE k = {STEPS}), (SELECT lo FROM spread WHERE k = {STEPS})), 9) AS a),
w AS (SELECT src, tokens, CAST(floor(round(round(p ** a / (SELECT sum(p ** a) FROM p, a), 12) * (SELECT sum(tokens) FROM t), 3)) AS BIGINT) AS quota FROM p, a),
plan AS (SELECT t.src, t.tokens, CAST(ceil(n / 4096.0) AS BIGINT) AS blocks, coalesce(quota, 1) AS quota, greatest(1, coalesce(CAST(ceil(quota / t.tokens) AS BIGINT), 1)) AS epochs FROM t LEFT JOIN w USING (src)),
r AS (SELECT doc_id, d.src, n_tokens, {_H.format(f"'{SEED}:block:' || doc_id")} % blocks AS block, tokens, quota, epochs FROM d JOIN plan USING (src)),
b AS (SELECT src, block, sum(n_tokens) AS size, any_value(tokens) AS tokens, any_value(quota) AS quota, unnest(range(any_value(epochs))) AS epoch FROM r GROUP BY src, block),
o AS (SELECT src, block, epoch, quota, epoch * tokens + coalesce(sum(size) OVER (PARTITION BY src, epoch ORDER BY {_H.format(f"'{SEED}:' || epoch || ':' || src || ':block:' || block")}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM b),
c AS (SELECT doc_id, src, epoch, n_tokens, o.quota, off + coalesce(sum(n_tokens) OVER (PARTITION BY src, block, epoch ORDER BY {_H.format(f"'{SEED}:' || epoch || ':' || doc_id")}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_token
      FROM r JOIN o USING (src, block)),
m AS (SELECT greatest(1, ceil(sum(quota) / 1000000.0)) AS n FROM plan)
SELECT doc_id, src AS source, CAST(epoch AS INT) AS epoch, n_tokens, CAST(start_token AS BIGINT) AS start_token,
       CAST(least(floor(CAST(start_token AS DOUBLE) / quota * n), n - 1) AS BIGINT) AS mix_block
FROM c, m WHERE start_token < quota
"""
