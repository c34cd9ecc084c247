"""Tools by name: typed requests as dictionaries, results as rows. The registry is what a service would expose."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import store as St
from . import memory as M
from . import rag as R


@dataclass
class Toolbox:
    """Tables of a store, replaced as tools change them."""

    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame
    records: DataFrame | None = None
    memories: DataFrame | None = None
    tools: dict[str, tuple[str, Callable[..., Any]]] = field(init=False)

    def __post_init__(self) -> None:
        self.tools = {
            "ingest_document": ("chunk a document and add it to the graph", self.ingest_document),
            "upsert_entities": ("add entity nodes", lambda rows: self._set("nodes", rows)),
            "upsert_relations": ("add edges", lambda rows: self._set("edges", rows)),
            "search_text": ("chunks by keywords", self.search_text),
            "search_chunks_by_entities": ("chunks that entities reach", lambda entity_names, max_hops=1: R.chunks_of_entities(self.chunks, self.edges, entity_names, max_hops)),
            "expand_graph": ("neighbourhood of nodes", self.expand_graph),
            "get_nodes": ("nodes by id", lambda node_ids: self.nodes.where(F.col("id").isin(*node_ids))),
            "get_chunks": ("chunks by id", lambda chunk_ids: self.chunks.where(F.col("id").isin(*chunk_ids))),
            "build_context": ("packed context of scored chunks", self.build_context),
            "search_graphrag_lexical": ("keyword seeds, graph expansion, packing", self.search_graph),
            "knowledge_save": ("save records", lambda rows: self._records(R.save_knowledge(self.records, rows))),
            "knowledge_update": ("change fields of records", lambda rows: self._records(R.update_knowledge(self.records, rows))),
            "knowledge_get": ("record by id", lambda knowledge_id: self.records.where(F.col("id") == knowledge_id)),
            "knowledge_search": ("documents by keywords", lambda query, top_k=10: R.knowledge_hits(self._scored(query, 4 * top_k), top_k)),
            "knowledge_delete": ("delete a record", lambda knowledge_id: self._records(self.records.where(F.col("id") != knowledge_id))),
            "memory_save": ("save memories", lambda rows: self._memories(St.upsert(self.memories, rows))),
            "memory_update": ("change fields of memories", lambda rows: self._memories(R.update_knowledge(self.memories, rows))),
            "memory_get": ("memory by id", lambda memory_id: self.memories.where(F.col("id") == memory_id)),
            "memory_search": ("memories of a bucket by keywords", lambda query, bank_id, top_k=10: M.recall(M.alive(self.memories), bank_id, top_k, words=query.split())),
            "memory_delete": ("delete a memory", lambda memory_id: self._memories(self.memories.where(F.col("id") != memory_id))),
        }

    def definitions(self) -> list[dict[str, str]]:
        return [{"name": n, "description": d} for n, (d, _) in self.tools.items()]

    def call(self, name: str, request: dict[str, Any]) -> Any:
        if name not in self.tools:
            raise ValueError(f"unknown tool {name}")
        return self.tools[name][1](**request)

    def _set(self, table: str, rows: DataFrame) -> DataFrame:
        setattr(self, table, St.upsert(getattr(self, table), rows))
        return rows

    def _records(self, rows: DataFrame) -> DataFrame:
        self.records = rows
        return rows

    def _memories(self, rows: DataFrame) -> DataFrame:
        self.memories = rows
        return rows

    def _scored(self, query: str, k: int, keywords: list[str] = ()) -> DataFrame:
        return self.chunks.join(R.lexical_seeds(self.chunks, query, k, keywords), "id")

    def ingest_document(self, rows: DataFrame, **options: int) -> DataFrame:
        chunks, nodes, edges = R.ingest(rows, R.RagOptions(**options))
        for table, new in (("chunks", chunks), ("nodes", nodes), ("edges", edges)):
            self._set(table, new)
        return chunks

    def search_text(self, query: str, top_k: int = 10, keywords: list[str] = ()) -> DataFrame:
        return self._scored(query, top_k or 10, keywords).orderBy(F.desc("score"), "id")

    def expand_graph(self, node_ids: list[str], max_hops: int = 1) -> tuple[DataFrame, DataFrame]:
        starts = self.nodes.where(F.col("id").isin(*node_ids)).select(F.col("id").alias("source"))
        return G.subgraph(self.nodes, self.edges, G.reach(self.edges, starts, max_hops).select(F.col("node").alias("id")))

    def build_context(self, query: str, top_k: int = 8) -> DataFrame:
        return R.context(R.select_and_pack(self._scored(query, top_k), query))

    def search_graph(self, query: str, entity_names: list[str] = (), **options: Any) -> DataFrame:
        o = R.RagOptions(**options)
        return R.search(self.chunks, self.edges, query, R.lexical_seeds(self.chunks, query, o.top_k), o, list(entity_names))
