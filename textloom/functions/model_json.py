"""JSON out of what a model says: noise around it stripped, the first fragment found, a cut tail closed."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What models put around JSON, in the order in which it goes.
NOISE = [
    (r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", ""),
    (r"(?is)<think(?:ing)?>.*$", ""),
    (r"(?im)^\s*```(?:json)?\s*|(?:(?<!\s)\s+)?```\s*$", ""),  # each run of blanks is tried once, from its start
    (r"^\s+|(?<!\s)\s+$", ""),
    (r"(?i)^(?:here(?:'s| is)|returning|output|result|json)\s*(?:the\s+)?(?:json|response)?\s*[:\-]?\s*", ""),
    (r"^\s+|(?<!\s)\s+$", ""),
]
CLOSERS = {"{": "}", "[": "]"}
#: A string, closed or cut, or one sign outside strings.
PART = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?$)|[{}\[\]]', re.DOTALL)
#: Thoughts, or what opens the first object or array outside them.
START = re.compile(r"<think(?:ing)?>.*?(?:</think(?:ing)?>|\Z)|[{\[]", re.IGNORECASE | re.DOTALL)
#: An escape that was cut at the end, with the half of a pair before it.
CUT_ESCAPE = re.compile(r"(?<!\\)((?:\\\\)*)(?:\\u[dD][89abAB][0-9a-fA-F]{2})?(?:\\(?:u[0-9a-fA-F]{0,3})?)?$")
#: What goes from the end of a cut string: signs that strings of JSON hold only as escapes, and spaces. Unicode's line separators are text.
BLANKS = "\t\n\v\f\r" + "".join(c for c in map(chr, range(0x3001)) if unicodedata.category(c) == "Zs")


def strip_noise(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for pattern, instead in NOISE:
        text = F.regexp_replace(text, pattern, instead)
    return text


def stripped(text: str) -> str:
    for pattern, instead in NOISE:
        text = re.sub(pattern, instead, text)
    return text


def fragment(text: str) -> str | None:
    """The first object or array, up to where it is balanced (by its own kind of bracket), else to the end."""
    found = re.search(r"[{\[]", text)
    if not found:
        return None
    opener, depth = found.group(), 0
    for part in PART.finditer(text, found.start()):
        depth += {opener: 1, CLOSERS[opener]: -1}.get(part.group(), 0)
        if depth == 0:
            return text[found.start() : part.end()]
    return text[found.start() :]


def repaired(text: str) -> str:
    """A cut fragment closed: noise and a comma behind the last string go, an open string (all of it text but a cut escape) and what is open around it are closed, a key without a value gets an empty one."""
    stack, in_string, end = [], False, 0
    for part in PART.finditer(text):
        token = part.group()
        if token in CLOSERS:
            stack.append(CLOSERS[token])
        elif token in "}]":
            if stack and stack[-1] == token:
                stack.pop()
        else:
            in_string, end = re.fullmatch(r'"(?:[^"\\]|\\.)*"', token, re.DOTALL) is None, part.end()
    text = CUT_ESCAPE.sub(r"\1", text.rstrip(BLANKS)) + '"' if in_string else text[:end] + re.sub(r",\s*$", "", stripped(text[end:]))
    return text + '""' * bool(re.search(r":\s*$", text)) + "".join(reversed(stack))


def _tries(text: str, plain: str) -> Iterator[str]:
    """What may be the JSON of an answer, first with all that its strings hold, then without what looks like noise anywhere (`plain`)."""
    if plain[0] not in CLOSERS:
        yield plain
    for found in START.finditer(text):
        if found.group() in CLOSERS:
            part = fragment(text[found.start() :])
            yield from (part, repaired(part))
            break
    yield plain
    if part := fragment(plain):
        yield from (part, repaired(part))
    if start := re.search(r"[{\[]", plain):
        end = plain.rfind(CLOSERS[start.group()])
        if end > start.start():
            yield from (plain[start.start() : end + 1], repaired(plain[start.start() :]))


def extract(text: str | None) -> Any:
    """The JSON value in a model's answer; ValueError if none can be read."""
    text = text or ""
    plain = stripped(text)
    if not plain:
        raise ValueError("the model returned nothing")
    for t in _tries(text, plain):
        try:
            return json.loads(t)
        except json.JSONDecodeError:
            continue
    raise ValueError("the model returned no JSON")


def _or_none(text: str | None) -> str | None:
    try:
        return json.dumps(extract(text), ensure_ascii=False)
    except ValueError:
        return None


@F.arrow_udf(T.StringType())
def model_json(texts: pa.Array) -> pa.Array:
    """Compact JSON of each answer, null where none can be read."""
    return pa.array([_or_none(x) for x in texts.to_pylist()], pa.string())


def _field_or_none(text: str | None, name: str) -> str | None:
    try:
        value = extract(text)
    except ValueError:
        return None
    value = value.get(name) if isinstance(value, dict) else None
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def field(text: Column, name: str) -> Column:
    """A key's value in each answer's object: strings as they are, others as JSON, null without it. Spark's get_json_object gives null for strings of more than 20 million characters."""

    @F.arrow_udf(T.StringType())
    def values(texts: pa.Array) -> pa.Array:
        return pa.array([_field_or_none(x, name) for x in texts.to_pylist()], pa.string())

    return values(text)
