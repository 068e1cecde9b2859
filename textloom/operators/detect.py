"""Whether rows are instruction data already: chat transcripts, or a pair of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of columns, the best first; roles of the two sides of a chat.
INSTRUCTION_NAMES = "instruction instruct prompt question query user human input".split()
OUTPUT_NAMES = "output response completion answer target assistant label".split()
CORPUS_NAMES = "text content body document article passage context raw html markdown page_content".split()
MESSAGES_NAMES = "messages conversations conversation".split()
USER_ROLES = "user human prompter instruction".split()
ASSISTANT_ROLES = "assistant bot gpt model output".split()
MAJORITY, SAMPLE = 0.7, 200


def field_map(names: list[str]) -> dict[str, str]:
    """Names by their folded form; the first of equals."""
    found: dict[str, str] = {}
    for n in names:
        if n.strip():
            found.setdefault(n.casefold().strip(), n)
    return found


def pick(names: list[str], aliases: list[str]) -> str | None:
    """The column of the first alias that is there."""
    found = field_map(names)
    return next((found[a] for a in aliases if a in found), None)


def said(c: Column) -> Column:
    return F.length(F.trim(F.coalesce(c, F.lit("")))) > 0


def role_sides(role: Column, text: Column) -> tuple[Column, Column]:
    """Whether a turn is a user's, and whether an assistant's; neither if it says nothing."""
    r = F.lower(F.trim(role))
    return said(text) & r.isin(USER_ROLES), said(text) & r.isin(ASSISTANT_ROLES)


def transcripts(turns: DataFrame, key: str, role: str, text: str) -> DataFrame:
    """(key, turns, usable) of chats in long form: at least two turns, one of each side."""
    user, assistant = role_sides(F.col(role), F.col(text))
    return turns.groupBy(key).agg(F.count(F.lit(1)).alias("turns"), F.coalesce(F.bool_or(user), F.lit(False)).alias("u"), F.coalesce(F.bool_or(assistant), F.lit(False)).alias("a")).select(
        key, "turns", ((F.col("turns") >= 2) & F.col("u") & F.col("a")).alias("usable")
    )


def is_transcript(messages: Column, kind: T.ArrayType) -> Column:
    """The same of an array of structs, whose role and text may have several names."""
    names = kind.elementType.names
    first = lambda m, options: F.coalesce(*[F.nullif(m[o].cast("string"), F.lit("")) for o in options if o in names], F.lit(None).cast("string"))
    sides = lambda m: role_sides(first(m, ("role", "from", "speaker")), first(m, ("content", "value", "text")))
    return F.coalesce((F.size(messages) >= 2) & F.exists(messages, lambda m: F.coalesce(sides(m)[0], F.lit(False))) & F.exists(messages, lambda m: F.coalesce(sides(m)[1], F.lit(False))), F.lit(False))


def enough(usable: Column, rows: Column) -> Column:
    return usable >= F.greatest(F.lit(1), F.floor(rows * MAJORITY))


def detect(rows: DataFrame, sample: int = SAMPLE) -> dict:
    """What a bounded sample of rows is, with the exact number of all rows. Chats are asked before pairs of columns."""
    total = rows.count()
    head = rows.limit(sample)
    none = {"already_instruct": False, "instruction_field": None, "output_field": None, "row_count": total, "format": None}
    if not total:
        return none
    one = F.lit(1)
    chat = pick(rows.columns, MESSAGES_NAMES)
    i, o = pick(rows.columns, INSTRUCTION_NAMES), pick(rows.columns, OUTPUT_NAMES)
    kind = rows.schema[chat].dataType if chat else None
    chatty = is_transcript(F.col(chat), kind) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else F.lit(False)
    text = lambda c: isinstance(rows.schema[c].dataType, T.StringType)
    paired = said(F.col(i)) & said(F.col(o)) if i and o and i != o and text(i) and text(o) else F.lit(False)
    got = head.agg(F.count(one).alias("n"), F.count_if(chatty).alias("chats"), F.count_if(paired).alias("pairs")).first()
    least = max(1, int(got["n"] * MAJORITY))
    if chat and got["chats"] >= least:
        return none | {"already_instruct": True, "instruction_field": chat, "output_field": chat, "format": "messages"}
    if got["pairs"] >= least and got["pairs"] / got["n"] >= MAJORITY:
        return none | {"already_instruct": True, "instruction_field": i, "output_field": o, "format": "columns"}
    return none


def looks_like_corpus(rows: DataFrame) -> bool:
    return not detect(rows)["already_instruct"] and pick(rows.columns, CORPUS_NAMES) is not None


def detect_all(files: list[DataFrame]) -> dict:
    """Several structured sources: all must qualify; rows are summed, names are the first's."""
    found = [detect(f) for f in files]
    if not found or not all(f["already_instruct"] for f in found):
        return {"already_instruct": False, "instruction_field": None, "output_field": None, "row_count": sum(f["row_count"] for f in found), "format": None}
    return reduce(lambda a, b: a | {"row_count": a["row_count"] + b["row_count"]}, found)
