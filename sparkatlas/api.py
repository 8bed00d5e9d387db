"""What the engine can be asked to do: commands by name, and the tools that an assistant may call."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from typing import Any

from sparkatlas.operators import bm25, evaluate, federation, fusion, graph, health, incremental, lookup, migrate, models, near_pairs, reports, review, sessions, vectors
from sparkatlas.sources import notes, sinks
from sparkatlas.streaming import convergence, watch

#: Command -> function.
COMMANDS: dict[str, Callable[..., Any]] = {
    "index": watch.reindex,
    "upsert": incremental.upsert,
    "rebuild": sinks.rebuild,
    "status": incremental.index_status,
    "watch": watch.watch,
    "converge": convergence.converge,
    "query": fusion.hybrid,
    "federated-query": federation.search,
    "search": bm25.search,
    "vector-search": vectors.top_k,
    "rerank": models.rerank,
    "similar": vectors.similar,
    "cluster": vectors.leader_clusters,
    "discriminate": near_pairs.near_pairs,
    "discriminate-exact": vectors.similar_pairs,
    "evaluate": evaluate.retrieval_metrics,
    "feedback-grid": evaluate.feedback_grid,
    "feedback-tuning": evaluate.feedback_strategies,
    "compare-models": evaluate.compare_models,
    "export": incremental.export_tables,
    "sync": sinks.write_tables,
    "embed": models.embed,
    "migrate": migrate.migrate,
    "drop-old": migrate.drop_old,
    "tags": lookup.tag_counts,
    "list": notes.list_notes,
    "sessions": sessions.summaries,
    "link-stats": lookup.link_stats,
    "orphans": lookup.without_inlinks,
    "downstream": graph.downstream,
    "reach": graph.symmetric_reach,
    "sole-support": graph.sole_support,
    "edge-stats": reports.edge_stats,
    "health": review.dashboard,
}

#: Tool -> (function, what it does).
TOOLS: dict[str, tuple[Callable[..., Any], str]] = {
    "find_similar": (vectors.similar, "the notes most like a note"),
    "search_vault": (fusion.hybrid, "notes that answer a query"),
    "find_clusters": (near_pairs.near_pairs, "pairs of notes that are nearly the same"),
    "get_inlinks": (lookup.note_links, "how many links lead to a note"),
    "get_outlinks": (lookup.note_edges, "where a note's links lead"),
    "get_tags": (lookup.tag_counts, "all tags and how many notes have them"),
    "read_note": (notes.read_head, "the start of a note"),
    "submit_link": (incremental.judged_links, "whether suggested links may be made"),
    "submit_voice_flag": (partial(incremental.submitted, task="voice_flag"), "put a note whose title is only a topic into the queue"),
    "submit_suspect": (partial(incremental.submitted, task="suspect"), "put a note that needs a closer look into the queue"),
    "find_note": (lookup.find_paths, "the path of a note by its name"),
    "fetch_bodies": (lookup.fetch, "bodies of notes"),
    "list_notes": (notes.list_notes, "paths and tags in order"),
    "suggest_links": (incremental.proposed_links, "notes to link to"),
    "update_queue": (incremental.update_queue, "change and append items of work"),
    "stale": (health.stale, "whether a note needs another look"),
}


def call(name: str, *args: Any, **kwargs: Any) -> Any:
    """Call a command or tool by its name."""
    fn = COMMANDS.get(name) or TOOLS.get(name, (None,))[0]
    if fn is None:
        raise ValueError(f"unknown command or tool {name!r}")
    return fn(*args, **kwargs)
