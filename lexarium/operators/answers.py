"""Question answering on retrieved chunks: the flow around a language model that the caller gives.

Retrieval is a Spark job; the model's calls are the caller's functions, and everything else here is a few strings.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.operators.citations import tidy

#: Documents graded in one call, of the whole list at least a third; characters of a graded excerpt and of a remembered answer; follow-ups.
BATCH, SHARE, EXCERPT, REMEMBERED, FOLLOWUPS = 10, 3, 350, 300, 3
UNGROUNDED = "(no grounded answer)"


@dataclass
class Models:
    """Functions of prompts to texts, and of a query to ranked chunks (id, text)."""

    condense: Callable[[str, str], str]
    rewrite: Callable[[str], list[str]]
    retrieve: Callable[[list[str]], DataFrame]
    grade: Callable[[str, list[str]], str]
    generate: Callable[[str, list[str]], str]


@dataclass
class Answer:
    text: str
    followups: list[str] = field(default_factory=list)
    grounded: bool = False


def history(turns: list[tuple[str, str, bool]]) -> str:
    """(role, text, grounded) turns as one text."""
    return "\n".join(f"{r}: {(t if g else UNGROUNDED)[:REMEMBERED] if r == 'assistant' else t}" for r, t, g in turns)


def condensed(question: str, made: str) -> str:
    """What the model made of a question, unless it is empty or far longer."""
    return made if made.strip() and len(made) <= 2 * len(question) + 120 else question


def batches(n: int) -> list[range]:
    size = max(BATCH, n // SHARE) if n > 30 else max(1, n)
    return [range(k, min(n, k + size)) for k in range(0, n, size)]


def graded(reply: str, n: int) -> list[int]:
    """Places that a grader's reply keeps: none, all, or the numbers from 1."""
    up = reply.upper()
    if re.search(r"\bNONE\b", up):
        return []
    if re.search(r"\bALL\b", up):
        return list(range(n))
    return sorted({int(x) - 1 for x in re.findall(r"\d+", reply) if 1 <= int(x) <= n})


def followups(text: str, delimiter: str = "---") -> tuple[str, list[str]]:
    """The answer, and up to three follow-ups of 4 to 60 characters after the delimiter."""
    body, _, rest = text.partition(delimiter)
    found = [re.sub(r"^\s*([-*]|\d+[.)])\s*", "", x).strip() for x in rest.splitlines()]
    return body.strip(), [x for x in found if 4 <= len(x) <= 60][:FOLLOWUPS]


def histories(turns: DataFrame) -> DataFrame:
    """conv_id, history of turns (conv_id, turn, role, text, grounded): history() of each conversation, in order of turn, role and text."""
    own = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "grounded")))
    told = F.pandas_udf(lambda s: s.map(lambda x: history([(t["role"] or "", t["text"] or "", bool(t["grounded"])) for t in x])), "string")
    return turns.groupBy("conv_id").agg(own.alias("turns")).select("conv_id", told("turns").alias("history"))


def condensed_column(question: Column, made: Column) -> Column:
    """condensed() of columns."""
    return F.pandas_udf(lambda q, m: pd.Series([condensed(a or "", b or "") for a, b in zip(q, m, strict=True)]), "string")(question, made)


def graded_column(reply: Column, n: Column) -> Column:
    """graded() of columns."""
    return F.pandas_udf(lambda r, k: pd.Series([graded(a or "", int(b)) for a, b in zip(r, k, strict=True)]), "array<int>")(reply, n)


def followups_column(text: Column, delimiter: str = "---") -> Column:
    """followups() of a column: body, followups."""
    udf = F.pandas_udf(lambda s: pd.DataFrame([followups(t or "", delimiter) for t in s], columns=["body", "followups"]), "body string, followups array<string>")
    return udf(text)


def answer(question: str, turns: list[tuple[str, str, bool]], models: Models, tries: int = 2) -> Answer:
    """Condense, rewrite, retrieve, grade (once more with the bare question if nothing is relevant), generate, cite."""
    asked = condensed(question, models.condense(question, history(turns))) if turns else question
    for k in range(tries):
        rows = models.retrieve(models.rewrite(asked) if k == 0 else [question]).collect()  # a request's few chunks
        texts = [r.text[:EXCERPT] for r in rows]
        kept = [b[i] for b in batches(len(texts)) for i in graded(models.grade(asked, [texts[j] for j in b]), len(b))]
        if kept:
            body, more = followups(models.generate(asked, [rows[i].text for i in kept]))
            return Answer(tidy(body, set(range(1, len(kept) + 1))), more, True)
    return Answer(models.generate(question, []), [], False)
