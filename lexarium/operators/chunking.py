"""Section-aware chunks of bodies. Packing is sequential within a section, so it runs as a function of one text inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.operators.anchors import slug, unique, wrapped_in
from lexarium.sources import shared

_HEADING = re.compile(r"^##(?!#)[ \t]+([^\r\n]+)", re.MULTILINE)
_OTHER = re.compile(r"^(#|#{3,})(?!#)[ \t]+", re.MULTILINE)
_WORDS = re.compile(r"[一-鿿]|[a-zA-Z]+")
#: Breaks in the order in which they are looked for, and how far from the estimated place.
BREAKS = ("。", "！", "？", "；", ".", "!", "?", ";", "\n\n")
REACH = 50


@dataclass(frozen=True)
class Sizes:
    """Words: what a chunk aims at, what a whole section may have, what a chunk must have, and what chunks share; and what parts paragraphs."""

    target: int = 1000
    most: int = 2500
    least: int = 50
    overlap: int = 150
    paragraphs: str = r"\n\s*\n"


def count_words(text: str) -> int:
    return len(_WORDS.findall(text))


def headings(text: str) -> list[tuple[int, str]]:
    """(place, title) of each level-two heading."""
    return [(m.start(), m[1].strip()) for m in _HEADING.finditer(text)]


def sections(text: str) -> list[tuple[str | None, str]]:
    """(heading, text under it): what stands before the first heading, if anything, and each heading's part."""
    marks = headings(text)
    edges = [a for a, _ in marks] + [len(text)]
    out: list[tuple[str | None, str]] = []
    if text[: edges[0]].strip() or not marks:
        out.append((None, text[: edges[0]]))
    return out + [(h, text[edges[k] : edges[k + 1]]) for k, (_, h) in enumerate(marks)]


def violation(text: str) -> str | None:
    """Why a body breaks the heading contract, or None: any other heading than level two, a footnote mark, a title with a link or wrapped in a mark."""
    if m := _OTHER.search(text):
        return "level-one heading" if len(m[1]) == 1 else "deep heading"
    if "[^" in text:
        return "footnote"
    for _, title in headings(text):
        if "](" in title:
            return "link in heading"
        if wrapped_in(title):
            return "emphasised heading"
    return None


def tail(text: str, words: int) -> str:
    """About the last `words` words: from the estimated place, or from behind the last of the first break of BREAKS that occurs near it."""
    total = count_words(text)
    if words <= 0 or total <= words:
        return text if words > 0 else ""
    at = int(len(text) * (1 - words / total))
    low = max(0, at - REACH)
    near = text[low : at + REACH]
    cut = next((low + near.rfind(mark) + 1 for mark in BREAKS if mark in near), at)
    return text[cut:].strip()


def pack(section: str, sizes: Sizes) -> list[str]:
    """A section's chunks: whole if it is short, else paragraphs together until the target, each chunk begun by the last one's tail."""
    if count_words(section) <= sizes.most:
        return [section.strip()]
    out, held, size = [], [], 0
    for p in (x.strip() for x in re.split(sizes.paragraphs, section)):
        if not p:
            continue
        n = count_words(p)
        if held and size + n > sizes.target:
            out.append("\n\n".join(held))
            shared = tail(out[-1], sizes.overlap) if sizes.overlap else ""
            held, size = ([shared], count_words(shared)) if shared else ([], 0)
        held.append(p)
        size += n
    return [*out, "\n\n".join(held)] if held else out


def chunks_of(text: str, sizes: Sizes) -> list[tuple[str | None, str, str, int]]:
    """(heading, anchor, text, words) of the chunks that have enough words; none of a body that breaks the contract."""
    if violation(text):
        return []
    parts = sections(text)
    names = iter(unique([slug(h) for h, _ in parts if h is not None]))
    found = [(h, a, c, count_words(c)) for h, a, s in [(h, next(names) if h is not None else "", s) for h, s in parts] for c in pack(s, sizes)]
    return [x for x in found if x[3] >= sizes.least]


def chunks(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """chunk_id, doc_id, chunk_index, heading, heading_anchor, text, word_count of docs (doc_id, text, and slug, if ids should have it).

    A document without a long enough chunk, with a null text, or one that breaks the heading contract has none."""
    name = F.col("slug") if "slug" in docs.columns else F.col("doc_id").cast("string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(f"{n}_chunk_{k:03d}", d, k, h, a, c, w) for n, d, t in zip(f.name_, f.doc_id, f.text, strict=True) for k, (h, a, c, w) in enumerate(chunks_of(t or "", sizes))]
            yield pd.DataFrame(rows, columns=["chunk_id", "doc_id", "chunk_index", "heading", "heading_anchor", "text", "word_count"])

    return shared.spread(docs.select("doc_id", name.alias("name_"), "text")).mapInPandas(run, f"chunk_id string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, chunk_index int, heading string, heading_anchor string, text string, word_count int")
