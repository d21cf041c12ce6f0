"""Mixing sources to target weights by a Pfair schedule.

Each source's rows are shuffled by a hash and cut into blocks. With integer weights W of total D,
block i of a source is released at slot floor(i * D / W) and due by slot ceil((i + 1) * D / W);
earliest deadline first among the released blocks gives each slot one block. Total load is one,
so each source stays less than one block from its exact share, and at every multiple of D all
shares are exact: the schedule repeats. It is therefore computed once, for D slots, and joined to
the blocks, which makes the whole operator joins and aggregates of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import table, without

BLOCK_ROWS = 8
RESOLUTION = 1000
#: Hash prefix by which a source's rows are split for ranking: 16 ** 3 parts, so that a source
#: with a third of all rows is no single task's work.
PREFIX = 3
#: A period of more slots, or one of more slots times sources, is refused: it is computed in one task and broadcast.
MOST_SLOTS, MOST_STEPS = 100_000, 200_000_000
OUT = ["mix_weight", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_row"]


def _known(source: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def tempered_weights(df: DataFrame, source: str = "source", resolution: int = RESOLUTION) -> DataFrame:
    """Integer target weights (source, weight) in proportion to the square root of a source's rows.

    Integers throughout, so that no order of additions matters. Each source gets 1 at least. There
    is one row per source; null is a source like others.
    """
    sizes = df.groupBy(F.col(source).alias("source")).agg(F.floor(F.sqrt(F.count("*").cast("double")) * 1000).cast("bigint").alias("root"))
    total = sizes.agg(F.sum("root").alias("total"))
    return sizes.crossJoin(F.broadcast(total)).select("source", F.greatest(F.lit(1), F.expr(f"(2 * root * {resolution} + total) div (2 * total)")).cast("bigint").alias("weight"))


def period(weights: DataFrame) -> DataFrame:
    """One hyperperiod of the schedule: (key, total, weight, nth, slot), D rows.

    Weights are configuration, of a checked size: D, their sum, is at most MOST_SLOTS, and D times the number of
    sources at most MOST_STEPS; beyond that this fails. Sources without a positive weight have no slots.
    """
    listed = weights.where("weight > 0").select(_known(F.col("source")).alias("key"), F.col("weight").cast("bigint").alias("weight")).groupBy("key").agg(F.sum("weight").alias("weight"))
    gathered = listed.agg(F.sort_array(F.collect_list(F.struct("key", "weight"))).alias("s"), F.sum("weight").alias("d")).where("d > 0")
    size = listed.agg(F.count("*").alias("n"), F.sum("weight").alias("d")).first()
    if size.n and (size.d > MOST_SLOTS or size.d * size.n > MOST_STEPS):
        raise ValueError(f"{size.n} sources with weights of sum {size.d}: group sources, or take smaller weights")
    # the state holds how many blocks each source has had, and who got each slot
    due = "struct(((c + 1) * d + s[j].weight - 1) div s[j].weight as due, j as j)"
    free = f"filter(transform(st.had, (c, j) -> if((c * d) div s[j].weight <= t, {due}, null)), x -> x is not null)"
    step = f"transform(array(array_min({free})), p -> struct(transform(st.had, (c, j) -> if(j = p.j, c + 1, c)) as had, concat(st.got, array(p.j)) as got))[0]"
    plan = gathered.withColumn("plan", F.expr(f"aggregate(sequence(0L, d - 1), struct(array_repeat(0L, size(s)) as had, cast(array() as array<int>) as got), (st, t) -> {step}, st -> st.got)"))
    slots = plan.select("s", "d", F.posexplode("plan").alias("slot", "j"))
    return slots.select(
        F.expr("s[j].key").alias("key"),
        F.col("d").alias("total"),
        F.expr("s[j].weight").alias("weight"),
        (F.row_number().over(Window.partitionBy("j").orderBy("slot")) - 1).cast("bigint").alias("nth"),
        F.col("slot").cast("bigint").alias("slot"),
    )


def mix_sources(df: DataFrame, weights: DataFrame, source: str = "source", key: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every row of df with its place in the mixture: order by mix_slot, mix_row.

    mix_weight: the source's weight; mix_block: its block number; mix_release, mix_deadline: slots
    between which the block is due; mix_slot: its slot; mix_row: the place within the block.

    Once a source runs out its slots stay empty and the others keep theirs, so no row is dropped;
    shares hold up to the first empty slot. Within a source rows are ordered by the MD5 of `key`, then
    by `key`, those without a key by a hash of their columns; rows that tie in both are interchangeable. A null
    source is a source of its own. A source without a positive weight keeps its rows, with a null slot.
    Columns of df that bear the name of a new one are replaced. An empty df gives an empty result.
    """
    b, r, h, n = "__mix_part", "__mix_key", "__mix_hash", "__mix_rank"
    rows = without(df, OUT)
    # rows without a key are spread by their other columns, so that they aren't one task's work
    plain = [F.col(f"`{c}`") for c, t in rows.dtypes if t.split("<")[0] not in ("map", "array", "struct", "variant")]
    spread = F.when(F.col(key).isNull(), F.hex(F.xxhash64(*plain))).otherwise(F.col(key).cast("string"))
    rows = rows.withColumn(r, _known(F.col(source))).withColumn(h, F.md5(spread))
    rows = rows.withColumn(b, F.substring(h, 1, PREFIX))
    sizes = rows.groupBy(r, b).agg(F.count("*").alias("n"))
    before = sizes.select(F.col(r).alias("k"), F.col(b).alias("p"), (F.sum("n").over(Window.partitionBy(r).orderBy(b)) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy(r, b).orderBy(h, F.col(key))) - 1
    ranked = rows.withColumn(n, within).join(before, (F.col(r) == F.col("k")) & (F.col(b) == F.col("p"))).withColumn(n, (F.col(n) + F.col("before")).cast("bigint"))
    plan = F.broadcast(period(weights).select(F.col("key").alias("pk"), "total", "weight", "nth", "slot"))  # MOST_SLOTS rows at most, checked
    block = F.expr(f"{n} div {block_rows}")
    sized = F.broadcast(weights.where("weight > 0").groupBy(_known(F.col("source")).alias("wk")).agg(F.sum("weight").alias("w")))  # no more rows than the plan
    placed = ranked.withColumn("__mix_block", block).join(sized, F.col(r) == F.col("wk"), "left")
    placed = placed.withColumn("__mix_nth", F.expr("__mix_block % w"))
    placed = placed.join(plan, (F.col(r) == F.col("pk")) & (F.col("__mix_nth") == F.col("nth")), "left")
    done = placed.select(
        *[F.col(f"`{c}`") for c in rows.columns if c not in (b, r, h)],
        F.coalesce("w", F.lit(0)).cast("bigint").alias("mix_weight"),
        F.col("__mix_block").alias("mix_block"),
        F.expr("(__mix_block * total) div weight").alias("mix_release"),
        F.expr("((__mix_block + 1) * total + weight - 1) div weight").alias("mix_deadline"),
        F.expr("(__mix_block div weight) * total + slot").alias("mix_slot"),
        F.expr(f"{n} % {block_rows}").alias("mix_row"),
    )
    return done


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs, tempered_weights(docs)).select("doc_id", "source", *OUT)


SQL = f"""
WITH RECURSIVE roots AS (
  SELECT source, CAST(floor(sqrt(CAST(count(*) AS DOUBLE)) * 1000) AS BIGINT) AS root FROM documents GROUP BY source),
weighed AS (
  SELECT source, coalesce('=' || source, 'null') AS k,
         greatest(1, (2 * root * {RESOLUTION} + (SELECT CAST(sum(root) AS BIGINT) FROM roots)) // (2 * (SELECT CAST(sum(root) AS BIGINT) FROM roots))) AS w
  FROM roots),
listed AS (SELECT list(w ORDER BY k) AS ws, list(k ORDER BY k) AS ks, CAST(sum(w) AS BIGINT) AS d FROM weighed),
run(t, had, j) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(ws, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM listed
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(ws) + 1), lambda i: had[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick FROM (
    SELECT t, had, ws, d, list_min(list_transform(list_filter(range(1, len(ws) + 1), lambda i: (had[i] * d) // ws[i] <= t + 1),
           lambda i: (((had[i] + 1) * d + ws[i] - 1) // ws[i]) * 1000000 + i)) % 1000000 AS pick
    FROM run, listed WHERE t + 1 < d)),
slots AS (SELECT ks[j] AS k, t AS slot, row_number() OVER (PARTITION BY j ORDER BY t) - 1 AS nth FROM run, listed WHERE t >= 0),
ranked AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS k,
         row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS n FROM documents),
blocks AS (SELECT *, n // {BLOCK_ROWS} AS b FROM ranked)
SELECT doc_id, b.source, w AS mix_weight, b AS mix_block, (b * d) // w AS mix_release, ((b + 1) * d + w - 1) // w AS mix_deadline,
       (b // w) * d + slot AS mix_slot, n % {BLOCK_ROWS} AS mix_row
FROM blocks b JOIN weighed USING (k) CROSS JOIN listed JOIN slots s ON s.k = b.k AND s.nth = b.b % w
"""
