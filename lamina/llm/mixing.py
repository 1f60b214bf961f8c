"""Mixing sources to target weights by Pareto order sampling, on DataFrame operations only.

A source's target is its share, by weight, of `total` times all words, capped
at `most` times its own words; what a cap frees is shared again by weight.
With target / words = whole + part, every document gets `whole` certain
copies, and the rest of the target is drawn: a document's inclusion
probability p is the rest's share times a length weight, its rank is
U / (1 - U) divided by p / (1 - p) with U a hash of the document, and
documents are taken by rising rank until the words come nearest to the rest
(the fixed size).  One last exchange takes or drops the single document that
brings the source nearest to its target.

No source is ever brought into one task: words are summed per source and rank
bucket, a window over at most BUCKETS sums finds the bucket that the cut falls
into, the same is done once more inside this bucket, and only the rows of the
part that the cut falls into, one of BUCKETS^2, are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.common import fresh, materialize, small_side

#: A word; the weights of the sources in code point order, repeating.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUCKETS = 4096
#: Words at which a document's length weight reaches half of its limit.
HALF = 50
SEED = "mix-1"


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def units(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, rows: documents that agree in all three are drawn together."""
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("rows"))
        .withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        .withColumn("liking", 1 + F.expr(f"(100 * size) div (size + {HALF})"))
    )


def targets(drawn: DataFrame, total: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """key, source, source_size, liked, target: the water level over all sources, saturated ones first.

    One row per source; the two windows over all sources see sums only.
    """
    sums = drawn.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum(F.col("size") * F.col("rows") * F.col("liking")).alias("liked"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy()
    by_cap = Window.orderBy((F.col("cap").cast("double") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(total) - F.coalesce(F.sum("cap").over(by_cap), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0))
    )
    leveled = ranked.withColumn("level", level)
    # with sources saturated in order of cap / weight, the level rises up to the true one and falls after it
    return leveled.select("key", "source", "source_size", "liked", F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(everything)).alias("target"))


def uniform() -> Column:
    """U in [0, 1): 52 bits of a digest of the document's id, size and the seed."""
    text = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.lit(SEED))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def _cut(sums: DataFrame, place: str, name: str) -> DataFrame:
    """key, `name`, below: where each source's running words first reach its rest, and the words before; `sums` has key, rest, below, place, in_bucket."""
    before = Window.partitionBy("key").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    running = sums.withColumn("below", F.col("below") + F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).where("below < rest")
    return running.groupBy("key").agg(F.max(place).alias(name), F.max("below").alias("below"))


def decide(drawn: DataFrame) -> DataFrame:
    """The units with source_size, target and copies (0, 1, ...) of each of their rows."""
    goal = targets(drawn).drop("source")
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    goal = materialize(goal, "mix-goal")
    likely = F.least(F.lit(1.0), F.col("rest") * F.col("liking") / F.col("liked"))
    draws = (F.col("rest") > 0) & (F.col("size") > 0)
    odds = F.col("u") * (1 - F.col("p")) / ((1 - F.col("u")) * F.col("p"))
    ranked = (
        drawn.join(small_side(goal), "key")
        .withColumn("u", uniform())
        .withColumn("p", F.when(draws, likely))
        .withColumn("q", F.when(draws, odds))
        .withColumn("x", F.col("q") / (1 + F.col("q")))
        .withColumn("bucket", F.least(F.floor(F.col("x") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
        .withColumn("words", F.col("size") * F.col("rows"))
    )
    sums = ranked.where("x is not null").groupBy("key", "rest", "bucket").agg(F.sum("words").alias("in_bucket"))
    cut = materialize(_cut(sums.withColumn("below", F.lit(0).cast("long")), "bucket", "cut"), "mix-cut")
    placed = ranked.join(small_side(cut), "key", "left").withColumn("part", F.when(F.col("bucket") == F.col("cut"), F.least(F.floor((F.col("x") * BUCKETS - F.col("bucket")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")))
    parts = placed.where("part is not null").groupBy("key", "rest", "below", "part").agg(F.sum("words").alias("in_bucket"))
    fine = materialize(_cut(parts, "part", "part_cut"), "mix-part")
    placed = placed.drop("below").join(small_side(fine), "key", "left")
    at_cut = Window.partitionBy("key", "bucket", "part").orderBy("x", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        placed.where("part = part_cut")
        .withColumn("reach", F.col("below") + F.sum("words").over(at_cut))
        .withColumn("picked", (F.col("reach") <= F.col("rest")) | ((F.col("reach") - F.col("words") < F.col("rest")) & (F.col("reach") - F.col("rest") < F.col("rest") - (F.col("reach") - F.col("words")))))
        .drop("reach")
    )
    others = placed.where("not coalesce(part = part_cut, false)").withColumn("picked", F.coalesce((F.col("bucket") < F.col("cut")) | (F.col("part") < F.col("part_cut")), F.lit(False)))
    chosen = materialize(others.unionByName(edge).select("key", "doc_id", "source", "size", "rows", "words", "x", "source_size", "target", "whole", "rest", "picked"), "mix-draw")
    off = chosen.groupBy("key", "rest").agg(F.sum(F.when(F.col("picked"), F.col("words")).otherwise(0)).alias("got")).select("key", (F.col("rest") - F.col("got")).alias("off"))
    change = F.when(F.col("picked"), -F.col("words")).otherwise(F.col("words"))
    moves = (
        chosen.where("x is not null")
        .join(small_side(off), "key")
        .groupBy("key", "off")
        .agg(F.min(F.struct(F.abs(F.col("off") - change).alias("left"), "x", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "size")).alias("move"))
        .where("move.left < abs(off)")
        .select("key", F.col("move.id").alias("move_id"), F.col("move.no_id").alias("move_no_id"), F.col("move.size").alias("move_size"))
    )
    moved = (F.coalesce("doc_id", F.lit(0)) == F.col("move_id")) & (F.col("doc_id").isNull() == F.col("move_no_id")) & (F.col("size") == F.col("move_size"))
    swap = F.coalesce(moved & F.col("x").isNotNull(), F.lit(False))
    return chosen.join(small_side(moves), "key", "left").select(
        "doc_id", "source", "size", "rows", "source_size", "target", (F.col("whole") + (F.col("picked") != swap).cast("long")).alias("copies")
    )


def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, source: one row per document, taken in words with repeats.

    `docs` has doc_id, text and source.  Null texts and texts without words have size 0 and take 0; a null
    source is a source of its own, last in order; documents that agree in id, source and size (repeated
    rows, null ids) are drawn together; an empty table gives no rows.  Other columns are ignored.
    """
    decided = decide(materialize(units(docs), "mix-units"))
    return decided.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source"
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with the columns of `docs`.

    Null and empty texts and texts without words are never drawn; they stay as often as their source is taken
    whole.  A null source is a source of its own; rows that agree in id, source and size (repeated rows, null
    ids) are taken together; an empty table gives no rows.
    """
    own_id, own_source, own_size, own_copies, own_copy = (fresh(docs, f"mix_{stem}") for stem in ("id", "source", "size", "copies", "copy"))
    decided = decide(materialize(units(docs), "mix-units")).where("copies > 0").select(
        F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("size").alias(own_size), F.col("copies").alias(own_copies)
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & F.col("source").cast("string").eqNullSafe(F.col(own_source)) & (words(F.col("text")) == F.col(own_size))
    return docs.join(decided, same).withColumn(own_copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(own_copies)))).select(*(F.col(f"`{c}`") for c in docs.columns))


#: The same rows by one window per source, for DuckDB.
ORACLE = rf"""
with d as (
  select cast(doc_id as bigint) as doc_id, source, cast(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as bigint) as size from documents),
u as (select doc_id, source, size, count(*) as n, 1 + (100 * size) // (size + {HALF}) as liking from d group by all),
s as (select source, sum(size * n)::bigint as source_size, sum(size * n * liking)::bigint as liked from u group by source),
w as (select *, [3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight from s),
c as (select *, (sum(source_size) over ())::bigint as everything, (sum(weight) over ())::bigint as weights,
  coalesce(sum(2 * source_size) over (order by (2 * source_size)::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as capped,
  coalesce(sum(weight) over (order by (2 * source_size)::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as used from w),
l as (select *, (everything * 1.5::double - capped) / (weights - used)::double as level from c),
t as (select source, source_size, liked, least((2 * source_size)::double, weight * (max(level) over ())) as target from l),
g as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from t),
r as (select u.*, u.size * u.n as words, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size as rest, g.liked,
  cast('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || size || '|{SEED}'), 1, 13) as bigint)::double / {float(1 << 52)}::double as v
  from u join g on u.source is not distinct from g.source),
p as (select *, case when rest > 0 and size > 0 then least(1.0::double, rest * liking / liked) end as p from r),
q as (select *, v * (1 - p) / ((1 - v) * p) as q from p),
x as (select *, q / (1 + q) as x from q),
o as (select *, case when x is not null then sum(words) over (partition by source, x is null order by x, doc_id nulls first, size rows unbounded preceding) end as reach from x),
k as (select *, coalesce(reach <= rest or (reach - words < rest and reach - rest < rest - (reach - words)), false) as picked from o),
f as (select source, rest - sum(case when picked then words else 0 end) as off from k group by source, rest),
m as (select k.source, f.off, min(row(abs(f.off - case when picked then -words else words end), x, coalesce(doc_id, 0), doc_id is null, size)) as move
  from k join f on k.source is not distinct from f.source where x is not null group by all),
e as (select k.*, coalesce(m.move[1] < abs(m.off) and m.move[3] = coalesce(doc_id, 0) and m.move[4] = (doc_id is null) and m.move[5] = size and x is not null, false) as swap
  from k left join m on k.source is not distinct from m.source)
select doc_id, size, source_size, target, ((whole + (picked <> swap)::bigint) * size)::bigint as taken, source from e, range(e.n) as copies(i)
"""
