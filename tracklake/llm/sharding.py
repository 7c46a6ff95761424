"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard draws a score from the key and its own number; the record goes to the shard
of the highest score.  One more shard takes records only into itself, and a shard of
twice the weight takes twice the records.  Only built-in functions are used.

Null keys go to one shard as if the key were the empty string.  Repeated rows go to the
same shard and get slots of their own.  A null text has size 1; texts of any length count
whole.  An empty table gives an empty one.  Extra columns are passed on; those of the names
of the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.components import unused

#: Blocks in which the slots of one shard are counted; a block's rows are numbered in one task.
BLOCKS = 1024
#: Hexadecimal digits of a draw: 48 bits, exact in a double.
DRAW_DIGITS = 12


def _draw(digits: int, *parts: Column) -> Column:
    """The first digits of the md5 of the parts, as a number; any other engine draws the same."""
    return F.conv(F.left(F.md5(F.concat_ws("|", *parts)), F.lit(digits)), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard, from 0, of the highest score -weight / ln(u); ties go to the higher number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))
    scores = []
    for i, w in enumerate(weights):
        u = (_draw(DRAW_DIGITS, F.lit(str(seed)), F.lit(str(i)), text) + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))
        scores.append(F.struct((F.lit(-float(w)) / F.log(u)).alias("score"), F.lit(i).alias("shard")))
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def assign_shards(df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 8, seed: int = 0, to: str = "shard") -> DataFrame:
    """Adds the shard of each row: a projection, without a shuffle."""
    return df.withColumn(to, rendezvous(F.col(key), weights, seed))


def number_slots(df: DataFrame, shard: str, order: Sequence[str], blocks: int = BLOCKS, to: str = "slot") -> DataFrame:
    """Adds a gapless number from 0 within each shard, in blocks, so that no shard is numbered in one task.

    The rows of a shard are dealt into ``blocks`` blocks by a hash of ``order``; only the
    counts of the blocks (shards x blocks rows) are summed in one place.  Rows that are equal
    in ``order`` share a block; copies of one row are numbered in one task.
    """
    block, count, of, its, start = (unused(df, c) for c in ("block", "n", "s", "b", "start"))
    dealt = df.withColumn(block, (_draw(8, *[F.col(c).cast("string") for c in order]) % blocks).cast("int"))
    counts = dealt.groupBy(shard, block).agg(F.count(F.lit(1)).alias(count))
    before = F.sum(count).over(Window.partitionBy(shard).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(shard).alias(of), F.col(block).alias(its), F.coalesce(before, F.lit(0)).alias(start))
    own = F.row_number().over(Window.partitionBy(shard, block).orderBy(*order)) - 1
    # shards x blocks rows at most, whatever the input.
    joined = dealt.join(F.broadcast(starts), (F.col(shard) == F.col(of)) & (F.col(block) == F.col(its)))
    return joined.withColumn(to, (F.col(start) + own).cast("long")).drop(block, of, its, start)
