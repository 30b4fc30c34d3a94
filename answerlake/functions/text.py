"""Cache keys from request messages."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerlake import schema as S


def normalize_model(model: Column) -> Column:
    return F.translate(model, "-.", "__")


def last_content(query: Column) -> Column:
    return F.element_at(query, -1)["content"]


def without_prompt(text: Column, prompts: list) -> Column:
    """Remove every match of the prompt patterns; no prompts leave the text."""
    if not prompts:
        return text
    return F.regexp_replace(text, "|".join(prompts), "")


def all_content(query: Column) -> Column:
    return F.array_join(F.transform(query, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


def with_role(query: Column) -> Column:
    last = F.element_at(query, -1)
    return F.concat(last["role"], F.lit(": "), last["content"])


def multi_splicing(query: Column) -> Column:
    return F.array_join(
        F.transform(query, lambda m: F.concat(
            F.coalesce(m["role"], F.lit("")), F.lit(S.ROLE_MARK),
            F.coalesce(m["content"], F.lit("")))),
        S.MESSAGE_MARK)


def dialog_parts(key: Column) -> Column:
    """Inverse of ``multi_splicing``: array of (role, content).

    Content keeps further role marks; a part without a mark has no role and the
    content ``exception``; empty content becomes null.
    """
    def part(p):
        at = F.locate(S.ROLE_MARK, p)
        content = F.substring(p, at + F.lit(len(S.ROLE_MARK)), F.char_length(p))
        return F.when(
            at > 0,
            F.struct(F.substring(p, F.lit(1), at - 1).alias("role"),
                     F.when(content != "", content).alias("content")),
        ).otherwise(F.struct(F.lit(None).cast("string").alias("role"),
                             F.lit("exception").alias("content")))

    return F.transform(F.split(key, re.escape(S.MESSAGE_MARK)), part)


def length_class(key: Column, limit: int = S.SHORT_TEXT) -> Column:
    return F.when(F.char_length(key) <= limit, "short").otherwise("long")


def mm_type(kind: Column) -> Column:
    """Request kind to stored kind; unknown kinds give null."""
    out = F.lit(None).cast("string")
    for name, stored in S.MM_TYPES.items():
        out = F.when(kind == name, stored).otherwise(out)
    return out


def mm_collection(model: Column, kind: Column) -> Column:
    """Null when the kind is unknown."""
    return F.concat(F.lit(S.MM_COLLECTION), model, F.lit("_"), mm_type(kind))


BLANK = " \t\n\r"


def tokens(text: Column) -> Column:
    """Lower-case tokens between white space."""
    parts = F.split(F.btrim(F.lower(text), F.lit(BLANK)), f"[{BLANK}]+")
    return F.array_remove(parts, "")
