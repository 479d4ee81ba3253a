"""Reading and writing networks, units and pair tables: parquet, CSV, GraphML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Attributes of a consolidated network and their types; whole numbers may be written as "3.0".
NODE_TYPES = {
    "x": "double",
    "y": "double",
    "is_degree_3": "int",
    "is_degree_4": "int",
    "max_highway_rank": "int",
    "min_highway_rank": "int",
    "is_traffic_signal": "int",
    "is_stop": "int",
    "is_yield": "int",
    "is_roundabout": "int",
}
EDGE_TYPES = {
    "length": "double",
    "speed_kph": "double",
    "oneway": "boolean",
    "lanes_per_direction": "double",
    "density_norm": "double",
    "is_degree_3": "double",
    "is_degree_4": "double",
    "is_traffic_signal": "double",
}


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns read as the given types; text that is no such value becomes null."""
    out = {}
    for name, kind in types.items():
        if name in df.columns:
            c = F.trim(F.col(name).cast("string"))
            out[name] = c.try_cast("double").cast(kind) if kind in ("int", "bigint") else c.try_cast(kind)
    return df.withColumns(out)


def read_graphml(spark: SparkSession, path: str, *, node_types: dict[str, str] | None = None, edge_types: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (``node_id`` and attributes) and edges (``u, v, k`` and attributes) of a GraphML file, or a folder of them.

    Attributes are named by the file's keys, which are few and read first; a value that is absent is null.
    """
    keys = spark.read.format("xml").option("rowTag", "key").option("recursiveFileLookup", "true").schema("_id string, `_attr.name` string, _for string").load(path).filter("_id is not null").distinct().orderBy("_id").collect()  # the file's own header
    data = "data array<struct<_key string, _VALUE string>>".replace("_key string, _VALUE string", "_key: string, _VALUE: string")

    def part(tag: str, own: str, columns: list) -> DataFrame:
        df = spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", "true").schema(f"{own}, {data}").load(path)
        m = F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], d["_VALUE"])))
        return df.withColumn("m", F.coalesce(m, F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))).select(*columns, *[F.try_element_at("m", F.lit(k[0])).alias(k[1]) for k in keys if k[2] in (tag, "all")])

    nodes = part("node", "_id string", [F.col("_id").alias("node_id")])
    edges = part("edge", "_source string, _target string, _id string", [F.col("_source").alias("u"), F.col("_target").alias("v"), F.coalesce(F.col("_id").try_cast("bigint"), F.lit(0)).alias("k")])
    return typed(nodes, NODE_TYPES | (node_types or {})), typed(edges, EDGE_TYPES | (edge_types or {}))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, *, node: str = "node_id", mode: str = "error") -> None:
    """Nodes and edges as a folder of GraphML parts that ``read_graphml`` reads: all attributes as text, absent where null.

    Three folders, ``keys``, ``nodes`` and ``edges``, each written in parallel; ``k`` becomes the edge's id.
    """
    def data(df: DataFrame, names: list[str], prefix: str):
        each = F.array(*[F.struct(F.lit(f"{prefix}_{n}").alias("_key"), F.col(n).cast("string").alias("_VALUE")) for n in names])
        return F.filter(each, lambda d: d["_VALUE"].isNotNull()).alias("data")

    spark = nodes.sparkSession
    at_node, at_edge = [c for c in nodes.columns if c != node], [c for c in edges.columns if c not in ("u", "v", "k")]
    keys = [(f"{p}_{n}", n, tag, "string") for p, tag, names in (("n", "node", at_node), ("e", "edge", at_edge)) for n in names]
    xml = lambda df, tag: df.write.mode(mode).format("xml").option("rowTag", tag).option("rootTag", "graphml")
    xml(spark.createDataFrame(keys, "_id string, `_attr.name` string, _for string, `_attr.type` string"), "key").save(f"{path}/keys")
    k = F.col("k").cast("string") if "k" in edges.columns else F.lit("0")
    xml(nodes.select(F.col(node).cast("string").alias("_id"), data(nodes, at_node, "n")), "node").save(f"{path}/nodes")
    xml(edges.select(F.col("u").cast("string").alias("_source"), F.col("v").cast("string").alias("_target"), k.alias("_id"), data(edges, at_edge, "e")), "edge").save(f"{path}/edges")


def read_csv(spark: SparkSession, path: str, schema: str, *, sep: str = ",") -> DataFrame:
    """A CSV file with a header, read by a given schema (never inferred)."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep)


def write_pairs(od: DataFrame, path: str, *, mode: str = "error") -> None:
    """A pair table as parquet, one folder per tier, so that a tier is read alone."""
    od.write.mode(mode).partitionBy("tier").parquet(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, *, mode: str = "error") -> None:
    df.write.mode(mode).csv(path, header=True)
