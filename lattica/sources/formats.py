"""Dump and load of embeddings (JSON, JSON lines, CSV, Parquet) and graphs (GraphML, GEXF, JSON)."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import insert_missing, upsert

#: Namespaces of the graph formats.
GRAPHML = "http://graphml.graphdrawing.org/xmlns"
GEXF = "http://www.gexf.net/1.2draft"

EMBEDDING = "id string, vector array<float>, content string, doc_id string, metadata map<string,string>"


def encode_vector(v: Iterable[float]) -> bytes:
    """32-bit little-endian length, then 32-bit floats."""
    values = list(v)
    return struct.pack(f"<i{len(values)}f", len(values), *values)


def decode_vector(data: bytes) -> list[float]:
    (n,) = struct.unpack_from("<i", data)
    if n < 0 or len(data) < 4 + 4 * n:
        raise ValueError("invalid vector")
    return list(struct.unpack_from(f"<{n}f", data, 4))


def encode_metadata(m: Column) -> Column:
    """JSON text; a null map is an empty text."""
    return F.coalesce(F.to_json(m), F.lit(""))


def decode_metadata(text: Column) -> Column:
    return F.from_json(F.when(text != "", text), "map<string,string>")


def dump(rows: DataFrame, path: str, kind: str = "jsonl", where: Column | None = None, mode: str = "error") -> None:
    """Write embeddings as a folder of files: jsonl, csv (maps and vectors as JSON text), parquet, or json (one document)."""
    kept = rows if where is None else rows.where(where)
    writer = lambda df: df.write.mode(mode)
    if kind == "jsonl":
        writer(kept).json(path)
    elif kind == "parquet":
        writer(kept).parquet(path)
    elif kind == "csv":
        flat = kept.select("id", "content", "doc_id", F.to_json("metadata").alias("metadata"), F.to_json("vector").alias("vector"))
        writer(flat).option("header", True).option("escape", '"').csv(path)
    elif kind == "json":
        count = kept.agg(F.count("*").alias("count"), F.max(F.size("vector")).alias("dimensions")).select(F.to_json(F.struct(F.lit("2.0").alias("version"), "count", "dimensions")).alias("h")).first()["h"]
        body = kept.select(F.to_json(F.struct(*kept.columns)).alias("value"))
        first = body.sparkSession.createDataFrame([(f'{{"metadata":{count},"embeddings":[',)], "value string")
        # Rows are lines of one document in one file; this form is for exchange of small sets.
        lines = first.withColumn("o", F.lit(0)).unionByName(body.withColumn("o", F.lit(1))).unionByName(first.select(F.lit("]}").alias("value"), F.lit(2).alias("o")))
        joined = lines.groupBy().agg(F.sort_array(F.collect_list(F.struct("o", "value"))).alias("x"))
        text = joined.select(F.concat(F.get("x", F.lit(0))["value"], F.array_join(F.transform(F.filter("x", lambda r: r.o == 1), lambda r: r.value), ","), F.lit("]}")).alias("value"))
        writer(text.coalesce(1)).text(path)
    else:
        raise ValueError(f"unknown format {kind}")


def load(spark: SparkSession, path: str, kind: str = "jsonl") -> DataFrame:
    if kind == "jsonl":
        return spark.read.schema(EMBEDDING).json(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        return spark.read.option("multiLine", True).schema(f"embeddings array<struct<{_fields(EMBEDDING)}>>").json(path).select(F.inline("embeddings"))
    if kind == "csv":
        flat = spark.read.option("header", True).option("escape", '"').schema("id string, content string, doc_id string, metadata string, vector string").csv(path)
        return flat.select("id", F.from_json("vector", "array<float>").alias("vector"), "content", "doc_id", F.from_json("metadata", "map<string,string>").alias("metadata"))
    raise ValueError(f"unknown format {kind}")


def _fields(schema: str) -> str:
    parts = schema.replace("map<string,string>", "map<string#string>").split(", ")
    return ",".join(p.replace(" ", ":", 1).replace("#", ",") for p in parts)


def load_into(old: DataFrame, new: DataFrame, skip_existing: bool = True) -> DataFrame:
    return insert_missing(old, new) if skip_existing else upsert(old, new)


def _xml(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


#: The keys of GraphML data.
GRAPHML_KEYS = (
    ("d0", "node", "content", "string"), ("d1", "node", "type", "string"), ("d2", "node", "vector", "string"), ("d3", "node", "properties", "string"),
    ("d4", "edge", "type", "string"), ("d5", "edge", "weight", "double"), ("d6", "edge", "properties", "string"),
)


def graph_xml_lines(nodes: DataFrame, edges: DataFrame, kind: str = "graphml") -> DataFrame:
    """``section, id, line``: an XML element per node and edge, made where the rows are; ``section`` orders them."""
    c = lambda name, df: F.col(name) if name in df.columns else F.lit(None).cast("string")
    attr = lambda name, value: F.concat(F.lit(f' {name}="'), _xml(value), F.lit('"'))
    if kind == "graphml":
        data = lambda key, value: F.concat(F.lit(f'<data key="{key}">'), _xml(value), F.lit("</data>"))
        # Vectors and properties are JSON texts; a row without any has no element for them.
        more = lambda key, name, df: F.coalesce(F.when(F.col(name).isNotNull(), data(key, F.to_json(name))), F.lit("")) if name in df.columns else F.lit("")
        node = F.concat(F.lit("<node"), attr("id", F.col("id")), F.lit(">"), data("d0", c("content", nodes)), data("d1", c("node_type", nodes)), more("d2", "vector", nodes), more("d3", "properties", nodes), F.lit("</node>"))
        edge = F.concat(F.lit("<edge"), attr("id", F.col("id")), attr("source", F.col("src")), attr("target", F.col("dst")), F.lit(">"), data("d4", c("edge_type", edges)), data("d5", c("weight", edges)), more("d6", "properties", edges), F.lit("</edge>"))
    elif kind == "gexf":
        value = lambda key, v: F.concat(F.lit(f'<attvalue for="{key}"'), attr("value", v), F.lit("/>"))
        node = F.concat(F.lit("<node"), attr("id", F.col("id")), attr("label", c("content", nodes)), F.lit("><attvalues>"), value("0", c("node_type", nodes)), F.lit("</attvalues></node>"))
        edge = F.concat(F.lit("<edge"), attr("id", F.col("id")), attr("source", F.col("src")), attr("target", F.col("dst")), attr("label", c("edge_type", edges)), attr("weight", c("weight", edges)), F.lit("/>"))
    else:
        raise ValueError(f"unknown format {kind}")
    return nodes.select(F.lit(0).alias("section"), "id", node.alias("line")).unionByName(edges.select(F.lit(1).alias("section"), "id", edge.alias("line")))


def export_graph(nodes: DataFrame, edges: DataFrame, kind: str = "graphml") -> str:
    """A graph as one text, assembled on the driver: for graphs that are exchanged as a file. ``graph_xml_lines`` has the distributed form."""
    if kind == "json":
        n = [r[0] for r in nodes.orderBy("id").select(F.to_json(F.struct(*nodes.columns))).toLocalIterator()]
        e = [r[0] for r in edges.dropDuplicates(["id"]).orderBy("id").select(F.to_json(F.struct(*edges.columns))).toLocalIterator()]
        return f'{{"nodes":[{",".join(n)}],"edges":[{",".join(e)}],"metadata":{{"node_count":{len(n)},"edge_count":{len(e)},"format":"json"}}}}'
    parts: dict[int, list[str]] = {0: [], 1: []}
    for row in graph_xml_lines(nodes, edges, kind).orderBy("section", "id").toLocalIterator():
        parts[row["section"]].append(row["line"])
    if kind == "graphml":
        keys = "".join(f'<key id="{k}" for="{f}" attr.name="{n}" attr.type="{t}"/>' for k, f, n, t in GRAPHML_KEYS)
        return f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="{GRAPHML}">{keys}<graph edgedefault="directed">{"".join(parts[0])}{"".join(parts[1])}</graph></graphml>'
    return (
        f'<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="{GEXF}" version="1.2"><graph defaultedgetype="directed"><attributes class="node"><attribute id="0" title="type" type="string"/></attributes>'
        f'<nodes>{"".join(parts[0])}</nodes><edges>{"".join(parts[1])}</edges></graph></gexf>'
    )


def import_graph(spark: SparkSession, text: str, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, content, node_type, vector, properties) and edges (id, src, dst, edge_type, weight, properties) of a graph text."""
    kind = kind or detect_format(text)
    nodes, edges = [], []
    if kind == "json":
        import json

        read = json.loads(text)
        text_of = lambda x: None if x is None else json.dumps(x)
        nodes = [(n["id"], n.get("content"), n.get("node_type"), text_of(n.get("vector")), text_of(n.get("properties"))) for n in read["nodes"]]
        edges = [(e["id"], e["src"], e["dst"], e.get("edge_type"), float(e.get("weight") or 1), text_of(e.get("properties"))) for e in read["edges"]]
    else:
        ns = f"{{{GRAPHML if kind == 'graphml' else GEXF}}}"
        root = ET.fromstring(text)
        for x in root.iter(ns + "node"):
            if kind == "graphml":
                data = {e.get("key"): e.text for e in x.iter(ns + "data")}
                nodes.append((x.get("id"), data.get("d0"), data.get("d1"), data.get("d2"), data.get("d3")))
            else:
                values = {e.get("for"): e.get("value") for e in x.iter(ns + "attvalue")}
                nodes.append((x.get("id"), x.get("label") or None, values.get("0"), None, None))
        for x in root.iter(ns + "edge"):
            data = {e.get("key"): e.text for e in x.iter(ns + "data")} if kind == "graphml" else {"d4": x.get("label"), "d5": x.get("weight")}
            edges.append((x.get("id"), x.get("source"), x.get("target"), data.get("d4"), float(data.get("d5") or 1), data.get("d6")))
    n = spark.createDataFrame(nodes, "id string, content string, node_type string, vector string, properties string")
    e = spark.createDataFrame(edges, "id string, src string, dst string, edge_type string, weight double, properties string")
    properties = F.from_json("properties", "map<string,string>")
    return n.withColumns({"vector": F.from_json("vector", "array<float>"), "properties": properties}), e.withColumn("properties", properties)


def detect_format(text: str) -> str:
    """By the first 512 characters."""
    head = text[:512].lstrip().lower()
    for kind in ("graphml", "gexf"):
        if f"<{kind}" in head:
            return kind
    if head.startswith("{"):
        return "json"
    raise ValueError("unknown graph format")
