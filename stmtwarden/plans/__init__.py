"""Registered queries: each wires derived views to one operator."""

from importlib import import_module

MODULES = ["reports", "normalise", "lists", "sources", "merge", "score", "series", "profile", "lint", "advice", "streaming", "flagship"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"stmtwarden.plans.{name}")
