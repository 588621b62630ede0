"""Sharding by jump consistent hashing, with DataFrame functions only.

A key's 64 bits seed a sequence of pseudo-random jumps 0 = j1 < j2 < ...; with n shards the key lies in the last jump
below n. No ring or table of shards is stored, and since a jump never depends on n, an appended shard only takes the
keys whose next jump hits it: about 1 in n + 1, all into the new shard. A key jumps some ln(n) times, so the loop has
few steps; the rare key that needs more goes on in a second loop of up to n steps, which no other key runs.

Keys are the first 64 bits of the MD5 digest of an id as text, so they are the same in every session and language.

Rows of a shard are numbered without collecting it: all rows are sorted by ranges of (shard, id, checksum, size, place),
counted per written partition, and a shard's slots start at the number of rows before it. Neither a large shard nor a
repeated id makes a large task, because the place of a row tells equal ones apart.

Defined cases: a null text has no bytes, like an empty one (size 8, checksum 0); rows with equal ids share a shard and
have slots of their own, in the order of checksum, size, then place; a null id counts as the empty text for the hash and
is numbered last; a very long text is one row of its size; an empty table gives an empty one. Columns of the input
other than the id and the text are not read, so their names cannot clash; ``write_shards`` and ``moved_rows`` replace a
column named shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ids import nulls_last, number_sorted
from ..workspace import materialise

#: Fixed values of the published generator: multiplier of the 64-bit step, and its modulus.
STEP, MODULUS = 2862933555777941757, 1 << 64
#: Steps of the first loop. A key needs more with a probability below 10^-12 even for a million shards.
FEW_JUMPS = 64
#: Bytes counted for a row beside its text.
ROW_BYTES = 8


def stable_key(id_col: Column) -> Column:
    """Unsigned 64 bits of an id, as a decimal."""
    digest = F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def _jump(state: Column, shards: int) -> Column:
    """One jump of a state (key, shard, next), or the state itself once the next jump leaves the shards."""
    seed = ((state["key"] * F.lit(STEP).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)"))
            % F.lit(str(MODULUS)).cast("decimal(20,0)")).cast("decimal(20,0)")
    high = F.floor(seed / F.lit(1 << 33).cast("decimal(10,0)")).cast("double")
    further = F.floor((state["next"] + 1) * (F.lit(float(1 << 31)) / (high + 1))).cast("bigint")
    jumped = F.struct(seed.alias("key"), state["next"].alias("shard"), further.alias("next"))
    return F.when(state["next"] < shards, jumped).otherwise(state)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards`` - 1 of a 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard")
    zero = F.lit(0).cast("bigint")
    start = F.struct(key.alias("key"), zero.alias("shard"), zero.alias("next"))

    def jumps(state, most):
        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, lambda s, _: _jump(s, shards))

    few = jumps(start, min(shards, FEW_JUMPS))
    if shards <= FEW_JUMPS:
        return few["shard"].cast("int")
    return F.when(few["next"] >= shards, few["shard"]).otherwise(jumps(start, shards)["shard"]).cast("int")


def shard_rows(
    df: DataFrame, shards: int, grown: int | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard) of every row; ``grown`` is a larger number of shards to compare."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        stable_key(F.col(id_col)).alias("key"),
        F.monotonically_increasing_id().alias("place"),
    )
    jumped = materialise(placed.select(
        "id", "size", "text_crc32", "place", jump_shard(F.col("key"), shards).alias("shard"),
        (jump_shard(F.col("key"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    ), "sharded")
    numbered = number_sorted(jumped, "number", ["shard", "id", "text_crc32", "size", "place"])
    counts = jumped.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    # One row a shard: the rows of all shards before it.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return numbered.join(materialise(starts, "shard-starts"), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard",
        (F.col("number") - F.col("start") - 1).alias("slot"), "grown_shard",
    )


def write_shards(df: DataFrame, path: str, shards: int, id_col: str = "doc_id") -> None:
    """``df`` as Parquet with a folder for each shard; a large shard gets several files, each sorted by id."""
    placed = df.withColumn("shard", jump_shard(stable_key(F.col(id_col)), shards))
    dealt = placed.hint("rebalance", "shard").sortWithinPartitions("shard", *nulls_last([id_col]))
    dealt.write.partitionBy("shard").parquet(path)


def moved_rows(df: DataFrame, shards: int, grown: int, id_col: str = "doc_id") -> DataFrame:
    """The rows that leave their shard when there are ``grown`` shards, with the column ``shard`` they go to."""
    key = stable_key(F.col(id_col))
    placed = df.withColumn("shard", jump_shard(key, grown))
    return placed.where(F.col("shard") >= shards) if grown >= shards else placed.where(jump_shard(key, shards) >= grown)
