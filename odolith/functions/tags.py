"""Hand-entered tags: telling a missing entry from a value, reading a number out of an entry, highway ranks, lanes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import col

# Entries that say only that nothing is known, after folding case and punctuation.
NOTHING = ("", "na", "n a", "nan", "nil", "none", "null", "not known", "unknown", "undefined", "no data", "not available", "missing")

#: Everything that is neither letter nor digit, in any script.
SEPARATORS = r"[^\p{L}\p{N}]+"


def folded(entry: Column | str) -> Column:
    """Lower case, punctuation and white space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(col(entry)), SEPARATORS, " "))


def is_missing(entry: Column | str) -> Column:
    """True for null, blank, or an entry that only says that nothing is known; never null."""
    entry = col(entry)
    return entry.isNull() | F.coalesce(folded(entry).isin(*NOTHING), F.lit(True))


def first_whole(entry: Column | str, low: int, high: int) -> Column:
    """The first number written in the entry if it is whole and within ``low`` to ``high``, else null.

    A sign belongs to a number only at its very front ("-1" is minus one, "2-3" starts with two); "2.0" is two.
    """
    found = F.regexp_extract(col(entry), r"((?:(?<![\p{L}\p{N}])-)?\d+(?:\.\d+)?)", 1)
    number = found.try_cast("double")
    return F.when((number == F.floor(number)) & number.between(low, high), number.cast("int"))


# Importance of street classes, higher is more important; -1 is no street for motor vehicles.
HIGHWAY_RANKS = {
    "motorway": 7,
    "motorway_link": 7,
    "trunk": 6,
    "trunk_link": 6,
    "primary": 5,
    "primary_link": 5,
    "secondary": 4,
    "secondary_link": 4,
    "tertiary": 3,
    "tertiary_link": 3,
    "residential": 2,
    "road": 2,
    "living_street": 1,
    "pedestrian": 1,
    "unclassified": -1,
    "service": -1,
    "busway": -1,
    "cycleway": -1,
    "footway": -1,
    "path": -1,
    "track": -1,
    "steps": -1,
    "crossing": -1,
    "disused": -1,
}


def highway_rank(tag: Column | str, default: int = -1) -> Column:
    """Rank of a street class; ``default`` for one without a rank."""
    pairs = [F.lit(x) for item in HIGHWAY_RANKS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(tag)), F.lit(default))


def collapse_by_rank(tags: Column | str) -> Column:
    """Of a list of street classes the one of highest rank, the first of equals; null for an empty list."""
    tags = col(tags)
    ranked = F.transform(tags, lambda t, i: F.struct(highway_rank(t).alias("rank"), (-i).alias("at"), t.alias("tag")))
    return F.array_max(ranked)["tag"]


# Street classes that are good to cycle on by themselves.
QUIET = ("cycleway", "footway", "pedestrian", "path", "living_street")


def road_class(tag: Column | str, classes: Mapping[str, float], default: float = 3.0) -> Column:
    """A class of one's own per street tag; ``default`` for others. Of a list the first counts, see ``first_of``."""
    pairs = [F.lit(x) for k, v in classes.items() for x in (k, float(v))]
    found = F.try_element_at(F.create_map(*pairs), col(tag)) if pairs else F.lit(None).cast("double")
    return F.coalesce(found, F.lit(float(default)))


def highway_tier(tag: Column | str) -> Column:
    """``highway`` (rank 6 and more), ``main`` (3 to 5) or ``local``."""
    r = highway_rank(tag)
    return F.when(r >= 6, "highway").when(r >= 3, "main").otherwise("local")


def first_of(values: Column | str) -> Column:
    """The first entry of a list, null for an empty one."""
    return F.try_element_at(col(values), F.lit(1))


def bike_score(tag: Column | str, *, bicycle: Column | None = None, cycleway: Column | None = None) -> Column:
    """1 (busy) to 5 (quiet): 5 on quiet classes and designated ways, 4 on unranked streets, else by rank, the busier the less,
    plus 2 beside a cycle track and 1 beside any other cycleway entry, at most 5."""
    r = highway_rank(tag)
    side = F.lit(None).cast("string") if cycleway is None else cycleway
    bonus = F.when(side.isin("track", "opposite_track"), 2).when(side.isNotNull() & (side != ""), 1).otherwise(0)
    quiet = F.coalesce(col(tag).isin(*QUIET), F.lit(False))
    if bicycle is not None:
        quiet = quiet | F.coalesce(bicycle == "designated", F.lit(False))
    base = F.greatest(F.lit(1), F.least(F.lit(5), 6 - r))
    return F.when(quiet, 5.0).when(r < 0, 4.0).otherwise(F.least(F.lit(5), base + bonus).cast("double"))


def mean_numeric(values: Column | str) -> Column:
    """Mean of the entries that read as numbers, as text; the first entry where none does."""
    values = col(values)
    numbers = F.filter(F.transform(values, lambda v: v.try_cast("double")), lambda v: v.isNotNull())
    mean = F.aggregate(numbers, F.lit(0.0), lambda a, v: a + v) / F.size(numbers)
    return F.when(F.size(numbers) > 0, mean.cast("string")).otherwise(F.try_element_at(values, F.lit(1)))


def lanes_per_direction(lanes: Column | str, oneway: Column | str) -> Column:
    """Lanes of one direction: one where unknown or at most one, all of a one-way street, half of any other."""
    n = first_number(lanes)
    return F.when(n.isNull() | (n <= 1), 1.0).when(F.coalesce(col(oneway), F.lit(False)), n).otherwise(n / 2)


def first_number(entry: Column | str) -> Column:
    """The first number in an entry as a double, or null."""
    return F.regexp_extract(col(entry).cast("string"), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
