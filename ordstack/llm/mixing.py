"""Mixing sources to target weights along a time-varying curriculum.

Every source has a schedule of weights over training progress 0 to 1. Its integral, scaled to the
source's target, is the source's cumulative demand for words; the inverse of that demand says at
which progress a document's words are due. Documents are range-sorted by that position.

Prefix sums over a source are taken in two levels (bins of the source's order, then rows of a bin), so
a source with most of the rows is spread like any other. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordstack.llm.corpus import columns, n_words, read
from ordstack.session import store

Schedule = tuple[tuple[float, float], ...]

#: Weights of sources by rank, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix as a share of all words, and the most often a source may be repeated.
SHARE = 1.5
MOST = 2.0
#: Weight over progress, by rank, repeating: knots (progress, factor), linear in between. The factors
#: average to one, so they say when a source is due, not how much of it.
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)),
)
ROWS_PER_BIN = 20_000


def cumulative(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """Per segment (progress, demand so far, density, slope), demand scaled to 1 at the end."""
    if len(schedule) < 2 or schedule[0][0] != 0 or schedule[-1][0] != 1:
        raise ValueError("a schedule has knots from progress 0 to 1")
    out, total = [], 0.0
    for (u0, w0), (u1, w1) in zip(schedule, schedule[1:]):
        if u1 <= u0 or min(w0, w1) < 0:
            raise ValueError("knots must rise and weights must not be negative")
        out.append((u0, total, w0, (w1 - w0) / (u1 - u0)))
        total += (w0 + w1) / 2 * (u1 - u0)
    if total <= 0:
        raise ValueError("a schedule needs some weight")
    return [(u, d / total, w / total, k / total) for u, d, w, k in out]


def position(demand: Column, rank: Column, schedules: tuple[Schedule, ...] = SCHEDULES) -> Column:
    """Progress at which a source's cumulative demand reaches ``demand`` (0 to 1)."""
    by_rank = F.lit(None).cast("double")
    for i, schedule in enumerate(schedules):
        at = F.lit(None).cast("double")
        for u, d, w, k in cumulative(schedule):
            left = F.greatest(demand - d, F.lit(0.0))
            # the root of w x + k x^2 / 2 = left that stays finite for k = 0
            root = F.sqrt(F.greatest(F.lit(w * w) + 2 * k * left, F.lit(0.0)))
            step = F.when(left <= 0, 0.0).otherwise(2 * left / (w + root))
            at = F.when(demand >= d, u + step).otherwise(at)
        by_rank = F.when((rank - 1) % len(schedules) == i, at).otherwise(by_rank)
    return F.least(F.greatest(by_rank, F.lit(0.0)), F.lit(1.0))


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, rank, source_size, target)`` of every source of ``sizes`` (``source``, ``size``).

    Sources are ranked by code point, null last. The targets share ``share`` times all words by
    weight; what a source may not take (more than ``most`` times its size) goes to the others by
    weight. All sources at their bound stand before all others in the order of bound by weight, so the
    last level shared by the rest follows from running sums. One row per source is handled here.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = by_source.withColumn("rank", rank).withColumn(
        "weight", F.get(weights, (F.col("rank") - 1) % len(WEIGHTS))
    )
    bound = ranked.withColumn("bound", F.col("source_size") * most)
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("rank")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (
        share * F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(order), F.lit(0.0))
    ) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    levelled = bound.withColumn("level", level)
    first = F.min(
        F.when(
            F.col("level") * F.col("weight") <= F.col("bound"),
            F.struct((F.col("bound") / F.col("weight")).alias("at"), "rank", "level"),
        )
    ).over(whole)
    return levelled.withColumn("free", first["level"]).select(
        "source", "rank", "source_size",
        F.when(F.col("free").isNull(), F.col("bound"))
        .otherwise(F.least("bound", F.col("free") * F.col("weight"))).alias("target"),
    )


#: Columns the mix reads, and those it adds.
READ = ("doc_id", "source", "text")
ADDED = ("size", "source_size", "target", "copies", "taken", "progress")


def mix(df: DataFrame, seed: int = 0, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target``, ``copies``, ``taken`` and ``progress``.

    A source's documents queue in the order of a seeded hash of ``doc_id`` and are taken over
    and over in whole until the source's target is met as nearly as whole documents can: a copy is
    taken when its middle word lies before the target. ``progress`` holds the positions of the copies.
    Null and empty texts have size 0, ask for nothing and are taken once at their place. Repeated rows
    queue one after another. A null id is an id like any other. Very long texts count whole. An empty table
    gives no rows. Added columns replace equal names; other columns pass through, whatever their names.
    """
    names = [c for c in df.columns if c not in ADDED]
    others = [F.col(f"`{c}`") for c in names if c not in READ]
    rest = F.struct(*others) if others else F.lit(None)
    narrow_names = df.select(*READ, rest.alias("others"))  # nothing of the input can clash with what is added
    sized = narrow_names.withColumn("size", n_words(F.col("text")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 15), 16, 10).cast("long")
    n_bins = max(1, -(-df.select("source").count() // ROWS_PER_BIN))
    queued = sized.withColumn("_at", hashed).withColumn(
        "_bin", F.floor(F.col("_at") / float(1 << 60) * n_bins)  # bins follow the order
    )
    narrow = store(
        queued.groupBy("source", "_bin").agg(F.sum("size").alias("size")), "mix-bins"
    )  # one row per source and bin
    goals = targets(narrow)
    before = F.sum("size").over(Window.partitionBy("source").orderBy("_bin")) - F.col("size")
    bins = narrow.select(F.col("source").alias("_source"), F.col("_bin").alias("_in"), before.alias("_before"))
    bins = bins.join(goals, bins["_source"].eqNullSafe(goals["source"])).drop("source")
    placed = queued.join(
        F.broadcast(bins) if n_bins <= 64 and goals.count() <= 1024 else bins,
        queued["source"].eqNullSafe(bins["_source"]) & (queued["_bin"] == bins["_in"]),
    )
    within = Window.partitionBy("source", "_bin").orderBy("_at", "doc_id", "size")
    middle = (
        F.col("_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    )
    cycle = F.col("source_size")
    # copies: how many of middle, middle + cycle, middle + 2 cycle, ... lie before the target
    fits = F.when(F.col("size") == 0, 1).otherwise(
        F.greatest(F.ceil((F.col("target") - F.col("_middle")) / cycle), F.lit(0))
    )
    copies = F.least(fits, F.lit(int(most))).cast("int")
    share_of = lambda c: F.when(F.col("target") > 0, (F.col("_middle") + (c - 1) * cycle) / F.col("target")).otherwise(0.0)
    return (
        placed.withColumn("_middle", middle.cast("double"))
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .withColumn(
            "progress",
            F.when(F.col("copies") > 0, F.transform(
                F.sequence(F.lit(1), F.greatest("copies", F.lit(1))),
                lambda c: position(share_of(c), F.col("rank")),
            )).otherwise(F.array().cast("array<double>")),
        )
        .select(*[F.col(c) if c in READ else F.col("others").getField(c).alias(c) for c in names], *ADDED)
    )


def in_training_order(df: DataFrame, seed: int = 0) -> DataFrame:
    """The copies the mix takes, one row each with the columns of ``df``, range-sorted by position."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in READ]
    packed = df.select(*READ, (F.struct(*others) if others else F.lit(None)).alias("others"))
    copies = mix(packed, seed).withColumn("due", F.explode("progress"))
    names = [F.col(c) if c in READ else F.col("others").getField(c).alias(c) for c in df.columns]
    return (
        copies.repartitionByRange("due", F.xxhash64("doc_id"))
        .sortWithinPartitions("due", F.xxhash64("doc_id"))
        .select(*names)
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a mix of all sources takes, and where in training each of its copies
    falls, range-sorted by the first position; documents that are not taken come first. See ``mix``."""
    docs = columns(read(spark, sf_dir), "doc_id", "source", "text")
    placed = mix(docs).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "source",
        *[F.round(F.get("progress", F.lit(i)), 9).alias(f"{n}_position") for i, n in enumerate(("first", "second"))],
    )
    order = ["first_position", F.xxhash64("doc_id")]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order)


_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"


def _position(x: str) -> str:
    """Progress by rank: the inverse demand of each default schedule, in its closed form."""
    return f"""CASE (rank - 1) % 3
    WHEN 0 THEN 2 * {x} / (1.5 + sqrt(greatest(2.25 - 2 * {x}, 0)))
    WHEN 1 THEN 2 * {x} / (0.5 + sqrt(greatest(0.25 + 2 * {x}, 0)))
    ELSE CASE WHEN {x} >= 0.5 THEN 0.5 + 2 * ({x} - 0.5) / (1.5 + sqrt(greatest(2.25 - 4 * ({x} - 0.5), 0)))
         ELSE 2 * {x} / (0.5 + sqrt(greatest(0.25 + 4 * {x}, 0))) END END"""


OP2_SQL = f"""WITH d AS (SELECT doc_id, source, {_WORDS} AS size,
    ('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
    FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][CAST((rank - 1) % 3 AS INT) + 1] AS DOUBLE) AS weight,
    CAST(2 * source_size AS DOUBLE) AS bound FROM s),
v AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(bound) OVER o, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM w
    WINDOW o AS (ORDER BY bound / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(bound, weight * (SELECT level FROM v WHERE level * weight <= bound ORDER BY bound / weight, rank LIMIT 1)) AS target FROM v),
m AS (SELECT d.doc_id, d.source, d.size, source_size, target, rank,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)
      - CAST(d.size AS DOUBLE) / 2 AS middle
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN size = 0 THEN 1
    ELSE CAST(least(greatest(ceil((target - middle) / source_size), 0), 2) AS BIGINT) END AS copies,
    CASE WHEN target > 0 THEN middle / target ELSE 0 END AS x,
    CASE WHEN target > 0 THEN (middle + source_size) / target ELSE 0 END AS y FROM m)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target, CAST(copies * size AS BIGINT) AS taken,
    source, CASE WHEN copies > 0 THEN round({_position('x')}, 9) END AS first_position,
    CASE WHEN copies > 1 THEN round({_position('y')}, 9) END AS second_position FROM c"""
