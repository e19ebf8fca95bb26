"""Prompts for a model behind the adapter, each of a context and a task."""

from __future__ import annotations

#: What each stage asks for; a model's reply is checked by ``functions.replies``.
TASKS = {
    "route": "Decide whether the last message is small talk or needs research in the sources. Reply with direct_answer or research.",
    "clarify": 'Reply with a JSON object: "action" (ask or proceed), "output" (a question back, or the research statement), "scope" (metadata or research) and "is_continuation".',
    "plan": "Choose up to five of the sources by their ids, the likeliest first. Reply with a JSON list of ids.",
    "select_documents": "Choose the documents that can answer the question. Reply with a JSON list of their ids.",
    "select_sections": "Choose sections by their summaries. Reply with a JSON object from document name to a list of section numbers.",
    "synthesise": "Answer the question from this document alone, and say which section each statement comes from.",
    "summarise": "Write one answer from the reports of all sources. Where they disagree, say so.",
}


def prompt(stage: str, context: str, **parts: str) -> str:
    """The stage's task after its context and named parts, in the order given; empty parts are left out."""
    if stage not in TASKS:
        raise ValueError(f"no task for {stage}")
    blocks = [("context", context), *parts.items(), ("task", TASKS[stage])]
    return "\n\n".join(f"<{name}>\n{body}\n</{name}>" for name, body in blocks if body)
