"""Training frames and splits."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clean import hour_bucket
from ..schema import AIRLINE, DATE, DEST, HOUR, ORIGIN, ROW_SEQ, key_of
from ..sources.datamart import Star

# --- fixed values: model inputs ---
CATEGORICAL = ("Airline", "Origin", "Dest", "DepTimeBlk", "ArrTimeBlk")
NUMERIC = ("Distance", "DayOfWeek", "Month", "DepHour", "ArrHour")
LABEL = "label"
SEED = 42
# Rows of the seeded sample (``ml_sample``); models are fitted with all rows.
MOST_TRAINING_ROWS = 1_000_000
TEST_SHARE = 0.2

# Rows are counted by this many more bits of their hash at a time, until at
# most this many rows of a class share all bits with the one that fills a quota.
SLICE_BITS, FEW_ROWS = 16, 10_000


def star_join_inner(star: Star) -> DataFrame:
    """Fact with the model's dimension columns; rows that miss one of six dimensions vanish."""
    fact = star.fact
    dims = [
        (HOUR, "dim_hora_id", {"hhmm": "CRSDepTime"}),
        (HOUR, "dim_hora_arr_id", {"hhmm": "CRSArrTime"}),
        (DATE, "dim_fecha_id", {"DayOfWeek": "DayOfWeek", "Month": "Month", "Year": "Year"}),
        (AIRLINE, "dim_aerolinea_id", {"Airline": "Airline"}),
        (ORIGIN, "dim_origen_id", {"Origin": "Origin"}),
        (DEST, "dim_destino_id", {"Dest": "Dest"}),
    ]
    for dim, foreign_key, columns in dims:
        # Year and Month of a fact written here are partition columns: a year
        # filter on them prunes folders, one on the dimension would not.
        missing = {c: name for c, name in columns.items() if name not in fact.columns}
        narrow = star.dims[dim].select(
            F.col(key_of(dim)).alias(foreign_key), *[F.col(c).alias(name) for c, name in missing.items()]
        )
        fact = fact.join(narrow, foreign_key, "inner")
    return fact.select(
        "CRSDepTime", "CRSArrTime", "Distance", "DayOfWeek", "Month", "Year",
        "Airline", "Origin", "Dest", "DepTimeBlk", "ArrTimeBlk", "DepDel15",
    )


# --- fixed values: types of the model's inputs in the star ---
WHOLE_INPUTS = ("CRSDepTime", "CRSArrTime", "DayOfWeek", "Month", "Year")


def ml_frame(star: Star) -> DataFrame:
    """Model rows of the star: typed inputs, hours of day and label; a row with an unusable number is left out."""
    joined = star_join_inner(star)
    given = {
        **{c: F.col(c).try_cast("int") for c in WHOLE_INPUTS},
        "Distance": F.col("Distance").try_cast("double"), LABEL: F.col("DepDel15").try_cast("double"),
    }
    derived = {"DepHour": hour_bucket(given["CRSDepTime"]), "ArrHour": hour_bucket(given["CRSArrTime"])}
    return joined.withColumns({**given, **derived}).dropna(subset=[*WHOLE_INPUTS, "Distance", LABEL])


def curated_frame(curated: DataFrame) -> DataFrame:
    """Model rows straight from the curated table; categories may be null."""
    needed = ["CRSDepTime", "CRSArrTime", "Distance", "DayOfWeek", "Month"]
    return (
        curated.dropna(subset=["DepDel15", *needed])
        .select(
            ROW_SEQ, *needed, *CATEGORICAL,
            F.floor(F.col("CRSDepTime") / 100).cast("int").alias("DepHour"),
            F.floor(F.col("CRSArrTime") / 100).cast("int").alias("ArrHour"),
            F.col("DepDel15").cast("double").alias(LABEL),
        )
    )


def latest_year(frame: DataFrame) -> int:
    """The year validation is done on: one number."""
    return frame.agg(F.max("Year")).first()[0]


def temporal_split(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Earlier years to train on, the latest year to validate on."""
    latest = latest_year(frame)
    return frame.where(F.col("Year") < latest), frame.where(F.col("Year") == latest)


def class_distribution(frame: DataFrame) -> DataFrame:
    """(label, count, share) of the classes."""
    counts = frame.groupBy(LABEL).agg(F.count(F.lit(1)).alias("count"))
    classes = Window.partitionBy()  # one row per class
    return counts.withColumn("share", F.col("count") / F.sum("count").over(classes)).orderBy(LABEL)


def _narrowed(hashed: DataFrame, cuts: dict, bits: int) -> dict:
    """Group -> (leading bits of the hash that fills the quota, rows still to take among them, rows that have them)."""
    prefix = F.shiftright(F.col("hash"), 64 - bits + SLICE_BITS)
    inside = F.lit(False)
    for group, (lead, _, _) in cuts.items():
        here = F.col("group").eqNullSafe(F.lit(group))
        inside = inside | (here if bits == SLICE_BITS else here & (prefix == lead))
    counts = hashed.where(inside).groupBy("group", F.shiftright(F.col("hash"), 64 - bits).alias("slice")).agg(
        F.count(F.lit(1)).alias("n"))
    need = F.lit(None).cast("bigint")
    for group, (_, take, _) in cuts.items():
        need = F.when(F.col("group").eqNullSafe(F.lit(group)), take).otherwise(need)
    up_to = Window.partitionBy("group").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        counts.select("group", "slice", "n", F.sum("n").over(up_to).alias("up_to"), need.alias("need"))
        .where("up_to >= need and up_to - n < need").collect()  # one row per group
    )
    return {r["group"]: (r["slice"], r["need"] - (r["up_to"] - r["n"]), r["n"]) for r in rows}


def quota_condition(df: DataFrame, by: Column, share: float | None = None, rows: int | None = None,
                    key: str = ROW_SEQ, seed: int = SEED, few: int = FEW_ROWS) -> Column:
    """Condition that holds for exactly a share (rounded) or a number of rows of each group of ``by``.

    Rows are taken in the order of (seeded hash of their key, key), so the
    choice does not depend on partitioning, and it ends up as a comparison with
    one such pair per group. The pair is found without sorting a group: rows of
    all groups are counted by the leading bits of the hash, then, where a quota
    falls, by more of them, until at most ``few`` rows are left to rank.
    ``by`` must have few values, such as the classes of a label, and ``key``
    must be unique: rows that share it are taken together.
    """
    hashed = df.select(by.alias("group"), F.col(key).alias("key"), F.xxhash64(F.col(key), F.lit(seed)).alias("hash"))
    cuts = {}
    for r in hashed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per group
        take = int(Decimal(r["n"] * share).quantize(Decimal(1), ROUND_HALF_UP)) if rows is None else min(r["n"], rows)
        if take:
            cuts[r["group"]] = (0, take, r["n"])
    bits = 0
    while cuts and bits < 64 and max(n for _, _, n in cuts.values()) > few:
        bits += SLICE_BITS
        cuts = _narrowed(hashed, cuts, bits)
    chosen = F.lit(False)
    for group, (lead, take, _) in cuts.items():
        here = F.col("group").eqNullSafe(F.lit(group))
        if bits:
            here = here & (F.shiftright(F.col("hash"), 64 - bits) == lead)
        last = hashed.where(here).orderBy("hash", "key").limit(take).orderBy(F.desc("hash"), F.desc("key")).first()
        pair = F.struct(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))
        bound = F.struct(F.lit(last["hash"]).cast("bigint"), F.lit(last["key"]).cast(df.schema[key].dataType))
        chosen = chosen | (by.eqNullSafe(F.lit(group)) & (pair <= bound))
    return chosen


def ml_sample(frame: DataFrame, rows: int = MOST_TRAINING_ROWS, seed: int = SEED) -> DataFrame:
    """A seeded sample of ``rows`` rows; the whole table when it has no more."""
    return frame.where(quota_condition(frame, F.lit(0), rows=rows, seed=seed))


def stratified_split(frame: DataFrame, share: float = TEST_SHARE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the same class shares."""
    in_test = quota_condition(frame, F.col(LABEL), share=share, seed=seed)
    return frame.where(~in_test), frame.where(in_test)
