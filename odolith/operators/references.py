"""References to records that were not there: missing, already deleted, or not yet delivered.

Parent keys become integer codes, sorted and compressed into runs of consecutive codes: two numbers a run. A reference is
matched as of its code to the run that starts at or before it; a code beyond that run's end has no parent. Only
references inside a run look up their parent's life, to tell those deleted or late at the time of the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import lookup

#: Codes per block. Runs end at block borders, so blocks are matched independently of each other.
BLOCK = 1 << 16


def key_code(key: Column, kind: str) -> tuple[Column, Column]:
    """``(family, code)`` of a key: keys of one family with consecutive codes are neighbours.

    Whole numbers are one family. Text of up to 15 hexadecimal digits is numbered by value in a family per length. Other
    text that ends in up to 15 decimal digits is numbered by these, in a family per text before them and number of
    digits. Text of neither kind is coded by a hash. Within the families other than that of hashed text equal codes are
    equal keys; among hashed ones the look-up of the parent's life compares the whole text.
    """
    if kind != "string":
        return F.lit(""), key.cast("long")
    hexadecimal = key.rlike("^[0-9a-f]{1,15}$")
    digits = F.regexp_extract(key, r"([0-9]{1,15})$", 1)
    before = F.substring(key, F.lit(1), (F.length(key) - F.length(digits)).cast("int"))
    family = F.when(hexadecimal, F.concat(F.lit("x"), F.length(key).cast("string"))).when(digits != "", F.concat(F.lit("d"), F.length(digits).cast("string"), F.lit(":"), before)).otherwise("h")
    code = F.when(hexadecimal, F.conv(key, 16, 10).cast("long")).when(digits != "", digits.cast("long")).otherwise(F.xxhash64(key))
    return family, code


def lives(parent: DataFrame, key: str, loaded: str, removed: str) -> DataFrame:
    """``(key, loaded, removed)``, each key once: repeated rows count once, a key with several different rows lives from the
    first ``loaded`` to the last ``removed``, or without end if any row has none. Null keys are left out."""
    k = F.col(key)
    one = parent.filter(k.isNotNull()).select(k.alias("key"), F.col(loaded).alias("loaded"), F.col(removed).alias("removed"))
    per = one.groupBy("key").agg(F.min("loaded").alias("loaded"), F.max("removed").alias("last"), F.count_if(F.col("removed").isNull()).alias("open"))
    return per.select("key", "loaded", F.when(F.col("open") == 0, F.col("last")).alias("removed"))


def parent_runs(keys: DataFrame) -> DataFrame:
    """``(family, block, start, end)`` of the distinct non-null keys in the column ``key``."""
    family, code = key_code(F.col("key"), dict(keys.dtypes)["key"])
    coded = keys.select(family.alias("family"), code.alias("code")).withColumn("block", F.floor(F.col("code") / BLOCK)).distinct()
    order = Window.partitionBy("family", "block").orderBy("code")
    island = coded.withColumn("island", F.col("code") - F.row_number().over(order))
    return island.groupBy("family", "block", "island").agg(F.min("code").alias("start"), F.max("code").alias("end")).drop("island")


def orphans(refs: DataFrame, parent: DataFrame, *, ref: str, at: str, spread: str, key: str, loaded: str = "loaded_at", removed: str = "removed_at") -> DataFrame:
    """Rows of ``refs`` whose ``ref`` has no living parent at time ``at``, with ``kind``: ``missing``, ``deleted`` or ``late``.

    ``missing``: no parent has exactly that key. ``deleted``: its ``removed`` is at or before the time. ``late``: its
    ``loaded`` is after the time. One that is both deleted and late counts as deleted. Null references are no
    references; with a null time only ``missing`` can be told; a parent without ``loaded`` is never late. An empty
    parent table makes every reference missing. Repeated rows of ``refs`` are each reported. Its columns are packed while
    the match runs, so they may have any names; one called ``kind`` is replaced. References are reduced to distinct keys
    before the match, and looked up again with hot keys split by a hash of the column ``spread``.
    """
    kind = dict(refs.dtypes)[ref]
    life = lives(parent, key, loaded, removed)
    runs = parent_runs(life.select("key"))
    here = refs.filter(F.col(ref).isNotNull()).select(F.struct(*[c for c in refs.columns if c.lower() != "kind"]).alias("row"), F.col(ref).alias("key"), F.col(at).alias("at"), F.xxhash64(spread).alias("spread"))
    counts = here.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    family, code = key_code(F.col("key"), kind)
    none = F.lit(None).cast("long")
    asked = counts.select("key", "n", family.alias("family"), code.alias("code")).withColumn("block", F.floor(F.col("code") / BLOCK))
    both = asked.select("family", "block", "code", none.alias("start"), none.alias("end"), "key").unionByName(runs.select("family", "block", F.col("start").alias("code"), "start", "end", F.lit(None).cast(kind).alias("key")))
    # as of: the last run that starts at or before the code; a run sorts before a reference to its first code
    before = Window.partitionBy("family", "block").orderBy("code", F.col("start").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("end", F.last("end", ignorenulls=True).over(before)).filter(F.col("start").isNull())
    inside = found.select("key", F.coalesce(F.col("code") <= F.col("end"), F.lit(False)).alias("inside"))
    # beyond every run: missing without a look-up; those inside meet the life of their key
    met = inside.filter("inside").select("key").join(life.withColumn("there", F.lit(True)), "key", "left")
    beyond = inside.filter("not inside").select("key", F.lit(None).cast(dict(life.dtypes)["loaded"]).alias("loaded"), F.lit(None).cast(dict(life.dtypes)["removed"]).alias("removed"), F.lit(None).cast("boolean").alias("there"))
    verdict = met.unionByName(beyond).select("key", F.col("there").isNotNull().alias("there"), "loaded", "removed")
    out = lookup(here, verdict, ["key"], ["spread"], counts=counts)
    what = F.when(~F.col("there"), "missing").when(F.col("removed") <= F.col("at"), "deleted").when(F.col("loaded") > F.col("at"), "late")
    return out.withColumn("what", what).filter(F.col("what").isNotNull()).select("row.*", F.col("what").alias("kind"))
