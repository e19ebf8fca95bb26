"""Decisions a model takes, behind small protocols, with deterministic rules as stand-ins."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Protocol

DIRECT, RESEARCH = "direct_answer", "research"
ASK, PROCEED = "ask", "proceed"
METADATA, FULL = "metadata", "research"
#: Words that the rules look for.
GREETINGS = {"hello", "hi", "thanks", "thank", "bye"}
LISTING = {"list", "find", "show", "which", "titles"}
OVERRIDE = {"proceed", "anyway", "continue"}
MOST_SOURCES = 5


class DecisionError(ValueError):
    """A decision that doesn't have the form it must have."""


@dataclass(frozen=True)
class Clarification:
    action: str
    output: str
    scope: str | None
    is_continuation: bool = False

    def checked(self) -> Clarification:
        if self.action not in (ASK, PROCEED) or not self.output:
            raise DecisionError("action and output are required")
        if self.action == PROCEED and self.scope not in (METADATA, FULL):
            raise DecisionError(f"scope must be {METADATA} or {FULL}")
        return self if self.action == PROCEED else Clarification(ASK, self.output, None, self.is_continuation)


class Router(Protocol):
    def __call__(self, messages: list[dict]) -> str: ...


class Clarifier(Protocol):
    def __call__(self, messages: list[dict]) -> Clarification: ...


class Planner(Protocol):
    def __call__(self, statement: str, sources: list[dict]) -> list[str]: ...


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def last_question(messages: list[dict]) -> str:
    return next((m["content"] for m in reversed(messages) if m["role"] == "user"), "")


def route(messages: list[dict]) -> str:
    """Small talk is answered directly; anything else, doubtful cases too, is research."""
    asked = words(last_question(messages))
    return DIRECT if asked and len(asked) <= 4 and GREETINGS & set(asked) else RESEARCH


def clarify(messages: list[dict]) -> Clarification:
    """A question of one word needs context, unless the user says to go on."""
    asked = words(last_question(messages))
    if len(asked) < 2 and not OVERRIDE & set(asked):
        return Clarification(ASK, "What would you like to know about it?", None)
    users = [m["content"] for m in messages if m["role"] == "user"]
    going_on = bool(OVERRIDE & set(asked)) and len(users) > 1
    statement = users[-2] if going_on else users[-1]
    return Clarification(PROCEED, statement, METADATA if LISTING & set(words(statement)) else FULL, going_on)


def plan(statement: str, sources: list[dict]) -> list[str]:
    """Sources by the words they share with the statement, internal before external."""
    asked = set(words(statement))
    score = lambda s: len(asked & set(words(" ".join(str(s.get(k) or "") for k in ("display_name", "description", "content_type", "use_when")))))
    ranked = sorted(sources, key=lambda s: (-score(s), s["key"].startswith("external_"), s["key"]))
    return checked_plan([s["key"] for s in ranked], sources)


def checked_plan(keys: list[str], sources: list[dict]) -> list[str]:
    """At most five registered sources, each once; an empty or unknown choice is an error."""
    known = {s["key"] for s in sources}
    if not keys or any(not isinstance(k, str) or k not in known for k in keys):
        raise DecisionError("a plan names registered sources")
    return list(dict.fromkeys(keys))[:MOST_SOURCES]
