"""Registered queries, one module per area."""

from importlib import import_module

AREAS = ("text", "enrichment", "sources", "retrieval", "evaluation", "knowledge", "observations", "answers", "conversations", "streams")


def load_all() -> None:
    for area in AREAS:
        import_module(f"passageworks.plans.{area}")
