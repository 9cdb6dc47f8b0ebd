"""Registered queries, one module for each family of operators."""

import importlib

MODULES = ("retrieval", "answers", "documents", "logs", "pages", "library", "questions")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
