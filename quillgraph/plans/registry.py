"""Collects the registered queries of all plan modules."""

from __future__ import annotations

MODULES = ("text_plans", "retrieval_plans", "graph_plans", "metric_plans", "policy_plans", "document_plans", "question_plans", "evidence_plans", "phrase_plans", "run_plans", "web_plans", "answer_plans")


def _gather(kind: str) -> dict:
    import importlib

    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"quillgraph.plans.{name}"), kind)()
    return found


def queries() -> dict:
    return _gather("queries")


def oracle_sql() -> dict:
    return _gather("oracle_sql")
