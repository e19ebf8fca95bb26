"""Reading model replies strictly: ids and section choices."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS, ANY, QUOTES = "digits", "any", "quotes"


def id_list(reply: str, fallback: str = DIGITS) -> list[str]:
    """A reply that is a JSON list of strings gives it, any other JSON nothing. What isn't JSON
    gives its quoted parts: digits only, any that aren't blank, or in either kind of quote."""
    import re

    try:
        found = json.loads(reply)
    except (TypeError, ValueError):
        found = re.findall(r"[\"'](.*?)[\"']" if fallback == QUOTES else r'"([^"]+)"', reply or "")
        return [x for x in found if (x.isdigit() if fallback == DIGITS else x.strip())]
    return found if isinstance(found, list) and all(isinstance(x, str) for x in found) else []


STRING = r'"(?:[^"\\]|\\.)*+"'
LIST = rf"\[\s*(?:{STRING}\s*(?:,\s*{STRING}\s*)*+)?\]"


def id_list_column(reply: Column, fallback: str = DIGITS) -> Column:
    """id_list for a column of replies. from_json alone would turn numbers into strings and
    accept what follows the list, so the whole form is checked."""
    is_list = reply.rlike(rf"(?s)^\s*{LIST}\s*$")
    whole = reply.rlike(r"(?s)^\s*(?:\{.*\}|\[.*\]|-?[0-9][0-9.eE+-]*|true|false|null)\s*$") | reply.rlike(rf"(?s)^\s*{STRING}\s*$")
    looks_json = whole & F.try_parse_json(reply).isNotNull()
    quoted = F.regexp_extract_all(reply, F.lit("[\"'](.*?)[\"']" if fallback == QUOTES else '"([^"]+)"'), F.lit(1))
    kept = F.filter(quoted, lambda x: x.rlike("^[0-9]+$") if fallback == DIGITS else F.trim(x) != "")
    nothing = F.array().cast("array<string>")
    return F.when(is_list, F.from_json(reply, "array<string>")).when(looks_json, nothing).otherwise(F.coalesce(kept, nothing))


def section_choice(reply: str) -> dict[str, list[str]]:
    """From the first brace to the last: an object of lists of strings, or else nothing."""
    start, end = (reply or "").find("{"), (reply or "").rfind("}")
    try:
        found = json.loads(reply[start : end + 1]) if 0 <= start < end else None
    except ValueError:
        return {}
    ok = isinstance(found, dict) and all(isinstance(v, list) and all(isinstance(x, str) for x in v) for v in found.values())
    return found if ok else {}


def braces(reply: Column) -> Column:
    return F.regexp_extract(reply, r"(?s)\{.*\}", 0)


def section_choice_column(reply: Column) -> Column:
    """section_choice for a column of replies; what isn't an object of lists of strings is an empty
    map. from_json would turn [1] into ["1"], so the form is checked first."""
    found = braces(F.coalesce(reply, F.lit("")))
    entry = rf"{STRING}\s*:\s*{LIST}\s*"
    ok = found.rlike(rf"(?s)^\{{\s*(?:{entry}(?:,\s*{entry})*+)?\}}$")
    return F.when(ok, F.from_json(found, "map<string,array<string>>")).otherwise(F.create_map().cast("map<string,array<string>>"))


def checked_arguments(reply: Column, required: dict[str, str], optional: dict[str, str] | None = None) -> tuple[Column, Column]:
    """arguments for a column of replies: an object whose named members have the types given as SQL
    (STRING, BOOLEAN). Returns a struct of them and what is wrong, null where nothing is."""
    parsed = F.try_parse_json(reply)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
    wrong = F.when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT<"), "arguments must be an object")
    for name, sql in required.items():
        wrong = wrong.when(F.coalesce(kind(name), F.lit("VOID")) != sql, f"{name} is missing or not {sql}")
    for name, sql in (optional or {}).items():
        wrong = wrong.when(~F.coalesce(kind(name), F.lit("VOID")).isin(sql, "VOID"), f"{name} is not {sql}")
    members = [F.try_variant_get(parsed, f"$.{name}", sql.lower()).alias(name) for name, sql in {**required, **(optional or {})}.items()]
    return F.when(wrong.isNull(), F.struct(*members)), wrong


def arguments(reply: str, required: dict[str, type], optional: dict[str, type] | None = None) -> dict:
    """A tool call's arguments, checked; raises ValueError that says what is wrong."""
    found = json.loads(reply)
    if not isinstance(found, dict):
        raise ValueError("arguments must be an object")
    for name, kind in required.items():
        if not isinstance(found.get(name), kind):
            raise ValueError(f"{name} is missing or not a {kind.__name__}")
    for name, kind in (optional or {}).items():
        if found.get(name) is not None and not isinstance(found[name], kind):
            raise ValueError(f"{name} is not a {kind.__name__}")
    return found
