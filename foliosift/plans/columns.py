"""The decisions' deterministic rules over whole tables of messages, for what has been logged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliosift.plans import decisions as d


def words(message: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(message, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def holds(asked: Column, some: set[str]) -> Column:
    return F.arrays_overlap(asked, F.array(*map(F.lit, sorted(some))))


def route(message: Column) -> Column:
    asked = words(message)
    return F.when((F.size(asked) <= 4) & holds(asked, d.GREETINGS), d.DIRECT).otherwise(d.RESEARCH)


def clarify(message: Column) -> tuple[Column, Column]:
    """Action and scope for a message without the ones before it."""
    asked = words(message)
    action = F.when((F.size(asked) < 2) & ~holds(asked, d.OVERRIDE), d.ASK).otherwise(d.PROCEED)
    return action, F.when(action == d.PROCEED, F.when(holds(asked, d.LISTING), d.METADATA).otherwise(d.FULL))


def checked(action: Column, output: Column, scope: Column) -> tuple[Column, Column]:
    """What is wrong with a clarification, null where nothing is, and its scope."""
    wrong = (
        F.when(~F.coalesce(action.isin(d.ASK, d.PROCEED), F.lit(False)), "action must be ask or proceed").when(F.coalesce(output, F.lit("")) == "", "output is required")
        .when((action == d.PROCEED) & ~F.coalesce(scope.isin(d.METADATA, d.FULL), F.lit(False)), f"scope must be {d.METADATA} or {d.FULL}")
    )
    return wrong, F.when(wrong.isNull() & (action == d.PROCEED), scope)
