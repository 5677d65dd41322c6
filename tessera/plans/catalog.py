"""Every registered query of the engine's own operators, with its SQL."""

from __future__ import annotations

from . import candidates_q, corpus_q, graph_q, linking_q, registry, relations_q, text_q  # noqa: F401  (importing registers)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    return dict(registry.ORACLES)
