"""Reading what language models return instead of JSON: fences, cut-off ends and other key names."""

from __future__ import annotations

import json
import re

_FENCE = re.compile(r"```(?:json)?[ \t]*\n?(.*?)(?:```|\Z)", re.S)
_PAIR = {"{": "}", "[": "]"}

# Other names under which the fields of each result come.
REASONING = ("thought_process", "reasoning", "thoughts", "explanation")
LISTS = {
    "questions": ("competency_questions", "cqs", "cq_list"),
    "classes": ("approved_classes",),
    "properties": ("approved_properties",),
    "validations": ("results", "hierarchy_validations", "validation_results"),
    "corrections": ("fixes", "changes", "repair"),
    "entities": (),
    "relations": (),
}
WITH_REASONING = ("classes", "properties", "corrections")


def _closers(text: str) -> tuple[str, list[int]]:
    """What closes a JSON text as it stands, and the places before which it may be cut to drop an unfinished member."""
    open_, quoted, escaped, cuts = [], False, False, []
    for i, c in enumerate(text):
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in _PAIR:
            open_.append(_PAIR[c])
            cuts.append(i + 1)
        elif c in "}]":
            if open_ and open_[-1] == c:
                open_.pop()
            cuts.append(i + 1)
        elif c == ",":
            cuts.append(i)
    tail = '"' if quoted else ""
    return ("\\" if escaped else "") + tail + "".join(reversed(open_)), cuts


def repair(text: str) -> str:
    """The longest start of a JSON text that can be closed to a valid one; empty if there is none.

    One pass finds the open string and brackets; only the ends of members are tried as cuts, so the work grows with the
    number of members and not with that of characters.
    """
    text = text.strip()
    tail, cuts = _closers(text)
    for part in (text, *(text[:c] for c in reversed(cuts))):
        close = tail if part is text else _closers(part)[0]
        for candidate in (part + close, part.rstrip().rstrip(":,") + close):
            try:
                json.loads(candidate)
                return candidate
            except ValueError:
                continue
    return ""


def extract(text: str) -> object | None:
    """The JSON value in a model's answer: inside a fence, else the text itself, repaired, else its outermost braces; None if there is none."""
    m = _FENCE.search(text)
    body = (m.group(1) if m else text).strip()
    for candidate in (body, repair(body)):
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    m = re.search(r"\{.*\}", text, re.S)
    try:
        return json.loads(m.group(0)) if m else None
    except ValueError:
        return None


def normalize(value: object, kind: str) -> dict:
    """A parsed answer in the form of its result: {kind: [items], reasoning_steps: [...]}.

    kind: one of LISTS. A flat list becomes the list of items; lists under other names are taken; maps from uri become
    items; missing fields get their defaults. What isn't an item is dropped. A flat list has no reasoning.
    """
    out: dict = {}
    body = value if isinstance(value, dict) else {}
    if kind in WITH_REASONING:
        steps = next((body[k] for k in ("reasoning_steps", *REASONING) if k in body), None)
        out["reasoning_steps"] = [steps] if isinstance(steps, str) else list(steps) if steps else ["Extracted via fallback."]
    items = value if isinstance(value, list) else next((body[k] for k in (kind, *LISTS[kind]) if k in body), [])
    if isinstance(items, dict):
        items = [{"uri": u, **(x if isinstance(x, dict) else {"comment": x})} for u, x in items.items() if kind == "classes" or isinstance(x, dict)]
    fixed = (_item(x, kind) for x in items)
    out[kind] = [x for x in fixed if x is not None]
    if kind == "classes":
        terms = body.get("canonical_terms")
        out["canonical_terms"] = terms if isinstance(terms, dict) else {}
    return out


def _item(x: object, kind: str) -> dict | None:
    if kind == "questions":
        x = {"question": x} if isinstance(x, str) else x
        return {"scope": "class", **x} if isinstance(x, dict) else None
    if not isinstance(x, dict):
        return None
    if kind == "classes":
        name = str(x.get("uri", "")).split(":")[-1]
        return {"bfo_parent": "bfo:Entity", "subclass_of": None, "aristotelian_definition": f"A {name} is an Entity.", "comment": "", **x}
    if kind == "properties":
        return {"domain": "ex:Thing", "range": "ex:Thing", "comment": "", **x}
    return x
