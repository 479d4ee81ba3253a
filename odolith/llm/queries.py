"""Queries of this subpackage over the tables of a data folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import NOTHING, SEPARATORS
from ..sources.tables import table
from . import canonical, mixing, packing, spans, topn


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_destinations(table(spark, d, "od_pairs")).select("run_id", "tier", "origin", "dest")


def p1_ranked(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_destinations(table(spark, d, "od_pairs")).select("run_id", "tier", "origin", "rank", "dest", "pop")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    tags, edges, pois = (table(spark, d, t) for t in ("tag_values", "edges", "pois"))
    parts = [canonical.unlisted(edges, "edges", "edge_id", "highway", tags), canonical.unlisted(pois, "pois", "osm_id", "shop", tags), canonical.unlisted(pois, "pois", "osm_id", "amenity", tags)]
    return canonical.map_entries(parts[0].unionByName(parts[1]).unionByName(parts[2]), tags)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("tbl", "field", "rec_key", "canonical").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Per table and field: entries mapped and left unmatched."""
    hit = F.col("canonical") != ""
    return _entries(spark, d).groupBy("tbl", "field").agg(F.count_if(hit).alias("mapped"), F.count_if(~hit).alias("unmatched"), F.count_distinct("canonical").alias("values"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "containers"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_packed(spark, d))


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    sizes = mixing.document_sizes(table(spark, d, "documents"))
    return mixing.mix_report(mixing.mix(sizes, targets), sizes, targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    return spans.coverage(table(spark, d, "documents"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return spans.classes(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (p1_found, p1_ranked, p4_found, p4_report, p6_packed, p6_fill, p7_mixed, p7_shares, p8_found, p8_coverage, p8_classes)}


_RANKED = """
WITH latest AS (
  SELECT run_id, tier, origin, dest, pop, CASE WHEN isfinite(cost) THEN cost ELSE 'infinity'::double END AS cost
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, tier, origin, dest ORDER BY loaded_at DESC) AS newest FROM od_pairs)
  WHERE newest = 1 AND pop IS NOT NULL AND NOT isnan(pop)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, tier, origin ORDER BY pop DESC, cost, dest) AS rank FROM latest
)
"""


_FROM, _TO = "".join(canonical._FOLD).replace("'", "''"), "".join(canonical._FOLD.values())
_NOTHING = ", ".join(f"'{x}'" for x in NOTHING)


def _missing(field: str) -> str:
    return f"({field} IS NULL OR trim(regexp_replace(lower({field}), '{SEPARATORS}', ' ', 'g')) IN ({_NOTHING}))"


def _folded(entry: str, field: str | None) -> str:
    """SQL of the words of an entry."""
    c = rf"regexp_replace(translate(regexp_replace(lower({entry}), '[\p{{Cf}}\p{{Mn}}]+', '', 'g'), '{_FROM}', '{_TO}'), '([\p{{L}}\p{{N}}]\s{{0,3}})\([^()]*\)\s*$', '\1 ')"
    if field:
        named = r"'(?s)^[^\p{L}\p{N}]*([^=:]*?)\s*[=:](.*)$'"
        c = f"CASE WHEN regexp_extract({c}, {named}, 1) = lower({field}) THEN regexp_extract({c}, {named}, 2) ELSE {c} END"
    return rf"trim(regexp_replace({c}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


_GRAMS = """CASE WHEN length({0}) > 0 THEN list_distinct(list_concat(
  flatten(list_transform(string_split({0}, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring(concat('^', w, '$'), i, 2)))),
  list_transform(list_filter(string_split({0}, ' '), lambda w: length(w) BETWEEN 2 AND 4), lambda w: concat('~', array_to_string(list_sort(string_split(w, '')), ''))))) ELSE [] END"""
_LETTERS = "list_sort(string_split({0}, ''))"
_SQUASH = "replace({0}, ' ', '')"
_WORDS = "array_to_string(list_sort(string_split({0}, ' ')), '')"


def _edits(a: str, b: str) -> str:
    n = f"levenshtein({a}, {b})"
    return f"({n} - CASE WHEN {n} >= 2 AND {_LETTERS.format(a)} = {_LETTERS.format(b)} THEN 1 ELSE 0 END) / greatest(length({a}), length({b}), 4)"


_RATIO = f"least({_edits('a', 'b')}, {_edits(_SQUASH.format('a'), _SQUASH.format('b'))}, {_edits(_WORDS.format('a'), _WORDS.format('b'))}, CASE WHEN length(sa) >= 4 AND length(sa) < length(sb) AND length(sa) * 3 >= length(sb) THEN levenshtein(sa, substring(sb, 1, length(sa))) / length(sa) + 0.02 ELSE 2 END)"
# every entry against every name of its field
_MAPPED = f"""
WITH r AS (
  SELECT DISTINCT 'edges' AS tbl, 'highway' AS field, edge_id AS rec_key, highway AS entry FROM edges WHERE edge_id IS NOT NULL AND NOT {_missing('highway')}
  UNION SELECT 'pois', 'shop', osm_id, shop FROM pois WHERE osm_id IS NOT NULL AND NOT {_missing('shop')}
  UNION SELECT 'pois', 'amenity', osm_id, amenity FROM pois WHERE osm_id IS NOT NULL AND NOT {_missing('amenity')}
), u AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM tag_values t WHERE t.tag_key = field AND t.tag_value = entry)),
e AS (SELECT field, entry, {_folded('entry', 'field')} AS a FROM (SELECT DISTINCT field, entry FROM u)),
f AS (SELECT field, a, {_SQUASH.format('a')} AS sa, {_GRAMS.format('a')} AS ta FROM (SELECT DISTINCT field, a FROM e)),
nm AS (SELECT DISTINCT tag_key AS field, {_folded('name', None)} AS b, tag_value FROM (SELECT tag_key, tag_value, unnest([tag_value, label]) AS name FROM tag_values) WHERE name IS NOT NULL),
g AS (SELECT field, b, tag_value, {_SQUASH.format('b')} AS sb, {_GRAMS.format('b')} AS tb FROM nm),
j AS (SELECT *, len(list_intersect(ta, tb)) / (len(ta) + len(tb) - len(list_intersect(ta, tb))) AS jac FROM f JOIN g USING (field) WHERE len(ta) > 0 AND len(tb) > 0),
ok AS (SELECT field, a, tag_value, jac, {_RATIO} AS ratio FROM j WHERE jac >= 0.2 - 1e-9),
best AS (SELECT field, a, (min((round(ratio, 9), -jac, tag_value)))[3] AS canonical FROM ok WHERE ratio <= 0.3 GROUP BY field, a),
m AS (SELECT DISTINCT tbl, u.field, rec_key, coalesce(canonical, '') AS canonical FROM u JOIN e USING (field, entry) LEFT JOIN best ON best.field = e.field AND best.a = e.a)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _MAPPED + "SELECT * FROM m",
        "p4_report": _MAPPED + "SELECT tbl, field, count(CASE WHEN canonical <> '' THEN 1 END) AS mapped, count(CASE WHEN canonical = '' THEN 1 END) AS unmatched, count(DISTINCT canonical) AS \"values\" FROM m GROUP BY tbl, field",
        "p1_found": _RANKED + "SELECT run_id, tier, origin, dest FROM ranked WHERE rank <= 5",
        "p1_ranked": _RANKED + "SELECT run_id, tier, origin, CAST(rank AS INTEGER) AS rank, dest, pop FROM ranked WHERE rank <= 5",
    }
