"""The registered queries of the library's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statuta.plans import (
    aggregate_queries,
    check_queries,
    citation_queries,
    context_queries,
    document_queries,
    filter_queries,
    history_queries,
    legal_queries,
    parser_queries,
    path_queries,
    payload_queries,
    plan_queries,
    provider_queries,
    record_queries,
    retrieval_queries,
    rule_queries,
    runtime_queries,
    store_queries,
    stream_queries,
    write_queries,
)
from statuta.plans.registry import ORACLES, QUERIES, Query

__all__ = ["MODULES", "flagship", "oracle_sql", "queries"]

#: The order in which queries are listed; within it those with few result rows come before those with tens of thousands.
MODULES = (
    legal_queries, rule_queries, check_queries, citation_queries, parser_queries, history_queries, provider_queries, plan_queries, payload_queries, store_queries, stream_queries, write_queries, record_queries, path_queries, retrieval_queries,
    aggregate_queries, filter_queries, document_queries, runtime_queries, context_queries,
)
MANY_ROWS = (
    "win2_latest_version", "jon5_induced_subgraph", "grf14_citable_lift", "jon18_snapshot_diff", "grf12_exact_three_step_path", "snk2_edge_upsert", "snk3_atomic_bundles", "jon2_parent_article", "flt20_embedding_eligibility", "str17_labels_and_embedding_texts", "grf13_path_conformance",
    "jon4_two_hop_neighbourhood", "grf10_document_neighbours", "jon13_structural_labels", "grf11_written_nodes", "win3_first_occurrence", "ref5_all_or_nothing", "jon8_registry_lookup", "grf20_ancestor_chain", "jon1_owning_document", "val9_decision_gate", "win14_bundle_verdict", "str27_structural_type",
    "top13_label_rank_order", "jon12_endpoint_resolution", "flt13_contract_reason", "jon3_citable_lift", "grf1_bounded_trails", "grf1_all_trails", "jon23_anchor_lookup", "ing1_hierarchy", "ref1_mentions",
)


def queries() -> dict[str, Query]:
    place = {m.__name__: i for i, m in enumerate(MODULES)}
    few = sorted((n for n in QUERIES if n not in MANY_ROWS), key=lambda n: place[QUERIES[n].__module__])
    return {n: QUERIES[n] for n in (*few, *MANY_ROWS)}


def oracle_sql() -> dict[str, str]:
    return {n: ORACLES[n] for n in queries() if n in ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's questions over the corpus: vector, full-text and graph channels, fused twice around one expansion."""
    return runtime_queries.ret6_hybrid_retrieval(spark, sf_dir)
