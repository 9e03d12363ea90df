"""What readers and the index see of Markdown: plain text by section with exact offsets, and front matter.

A text is cut in blocks by its lines, and each block's inline marks are read in one scan; nothing is rendered. Covered are
headings, paragraphs, lists, quotations, rules, tables, fenced and indented code, HTML blocks, and inline code, links,
images, emphasis, escapes, autolinks and tags. Reference links keep their brackets.

Defined cases: a null text is an empty one; an empty section is left out; NUL is an error in `projected`, and in
`search_documents` gives a row without text whose error says so.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.operators.anchors import slug, unique
from lexarium.operators.chunking import headings

#: Footnote marks, tags that break lines, tags whose content is hidden.
_NOTE = re.compile(r"\[\^[^\]\n]+\]")
BREAKING, HIDDEN = frozenset("br p div li tr".split()), frozenset("script style".split())
_TAG = re.compile(r"<(?:!--.*?-->|(/?)([A-Za-z][A-Za-z0-9-]*)(?:\s[^<>]*)?/?>)", re.DOTALL)
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_ITEM = re.compile(r" {0,3}(?:[-*+]|\d{1,9}[.)])(?:[ \t]+|$)")
_RULE = re.compile(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_UNDER = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_CELLS = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_LINK_TO = re.compile(r"\((?:[^()\s]|\([^()]*\))*(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]+:[^\s<>]*|[^\s<>@]+@[^\s<>@]+)>")
_ESCAPED = frozenset("\\`*_{}[]()#+-.!|<>~\"'&$%,/:;=?@^")


def visible(markup: str) -> str:
    """Text that HTML shows: entities decoded, scripts and styles hidden, a line's end for each tag that breaks lines."""
    out, at, deep = [], 0, 0
    for m in _TAG.finditer(markup):
        if not deep:
            out.append(html.unescape(markup[at : m.start()]))
        at, name = m.end(), (m[2] or "").lower()
        if name in HIDDEN:
            deep = max(0, deep + (-1 if m[1] else 1))
        elif name in BREAKING and not deep and not (m[1] and name == "br"):
            out.append("\n")
    return "".join([*out, "" if deep else html.unescape(markup[at:])])


def inline(s: str) -> str:
    """One block's text without the marks of code, links, images, emphasis and escapes; tags and entities as HTML shows them."""
    out: list[str] = []
    opened: list[tuple[int, bool]] = []  # where in out a label began
    marks: list[tuple[int, str]] = []  # where in out emphasis may begin
    k = 0
    while k < len(s):
        c = s[k]
        if c == "\\" and k + 1 < len(s) and s[k + 1] in _ESCAPED:
            out.append(html.escape(s[k + 1]))
            k += 2
        elif c == "`":
            run = len(s) - k - len(s[k:].lstrip("`"))
            end = next((m.start() for m in re.finditer(r"`+", s[k + run :]) if len(m[0]) == run), -1)
            code = s[k + run : k + run + end].replace("\n", " ") if end >= 0 else None
            if code is not None and len(code) > 2 and code[0] == code[-1] == " " and code.strip():
                code = code[1:-1]
            out.append(html.escape(s[k : k + run] if code is None else code))
            k += run if code is None else run + end + run
        elif c == "[" or s.startswith("![", k):
            opened.append((len(out), c == "!"))
            out.append(s[k : k + 1 + (c == "!")])
            k += 1 + (c == "!")
        elif c == "]" and opened:
            at, _ = opened.pop()
            to = _LINK_TO.match(s, k + 1)
            if to:
                out[at] = ""
            else:
                out.append("]")
            k = to.end() if to else k + 1
        elif c == "<" and (m := _AUTO.match(s, k)):
            out.append(html.escape(m[1]))
            k = m.end()
        elif c == "<" and (m := _TAG.match(s, k)):
            out.append(m[0])
            k = m.end()
        elif c == "<":
            out.append("&lt;")
            k += 1
        elif c in "*_":
            run = len(s) - k - len(s[k:].lstrip(c))
            before, after = s[k - 1 : k] or " ", s[k + run : k + run + 1] or " "
            opens = not after.isspace() and (c == "*" or not before.isalnum())
            closes = not before.isspace() and (c == "*" or not after.isalnum())
            left = run
            while closes and left and marks:
                at = next((i for i in range(len(marks) - 1, -1, -1) if marks[i][1][0] == c), -1)
                if at < 0:
                    break
                n = 2 if min(left, len(marks[at][1])) > 1 else 1
                rest = marks[at][1][n:]
                out[marks[at][0]] = rest
                marks[at:] = [(marks[at][0], rest)] if rest else []
                left -= n
            if left:
                if opens:
                    marks.append((len(out), c * left))
                out.append(c * left)
            k += run
        else:
            n = next((i for i in range(k + 1, len(s)) if s[i] in "\\`[]!<*_"), len(s))
            out.append(s[k:n])
            k = n
    return visible("".join(out))


def blocks(markdown: str) -> Iterator[tuple[str, str]]:
    """("text", lines), ("code", lines) or ("html", lines) of each block, in order."""
    held: list[str] = []
    lines = markdown.split("\n")
    k = 0

    def flush() -> Iterator[tuple[str, str]]:
        if held:
            yield ("html" if re.match(r" {0,3}<(?:/?(?:div|p|table|tr|td|ul|ol|li|script|style|h[1-6]|pre|section|center)\b|!--)", held[0], re.IGNORECASE) else "text"), "\n".join(x.strip() for x in held)
            held.clear()

    while k < len(lines):
        line = lines[k]
        bare = re.sub(r"^(?: {0,3}>[ \t]?)+", "", line)
        if m := _FENCE.match(bare):
            yield from flush()
            end = next((i for i in range(k + 1, len(lines)) if re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", lines[i])), len(lines))
            yield "code", "\n".join(lines[k + 1 : end])
            k = end
        elif not bare.strip():
            yield from flush()
        elif not held and re.match(r"(?: {4}|\t)", bare):
            code = [re.sub(r"^(?: {4}|\t)", "", bare)]
            while k + 1 < len(lines) and re.match(r"(?: {4}|\t)\S", lines[k + 1]):
                k += 1
                code.append(re.sub(r"^(?: {4}|\t)", "", lines[k]))
            yield "code", "\n".join(code)
        elif held and _UNDER.match(bare) and not _ITEM.match(bare + " "):
            yield from flush()
        elif _RULE.match(bare):
            yield from flush()
        elif m := re.match(r" {0,3}#{1,6}(?:[ \t]+|$)", bare):
            yield from flush()
            yield "text", re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", bare[m.end() :]).strip()
        elif "|" in bare and k + 1 < len(lines) and "-" in lines[k + 1] and "|" in lines[k + 1] and _CELLS.match(lines[k + 1]):
            yield from flush()
            for row in [bare, *_table_rows(lines, k + 2)]:
                for cell in re.split(r"(?<!\\)\|", row.strip().removeprefix("|").removesuffix("|")):
                    yield "text", cell.strip()
            k += 1 + len(_table_rows(lines, k + 2))
        else:
            if m := _ITEM.match(bare):
                yield from flush()
                bare = bare[m.end() :]
            if bare.strip():
                held.append(bare)
        k += 1
    yield from flush()


def _table_rows(lines: list[str], k: int) -> list[str]:
    end = next((i for i in range(k, len(lines)) if "|" not in lines[i] or not lines[i].strip()), len(lines))
    return lines[k:end]


def plain(markdown: str) -> str:
    """Link labels, image texts and code stay, targets, note marks and emphasis go; blocks stand apart by a blank line; NFC."""
    found = [s.rstrip() if kind == "code" else visible(s) if kind == "html" else inline(s) for kind, s in blocks(_NOTE.sub("", markdown))]
    return unicodedata.normalize("NFC", "\n\n".join(found).strip())


def projected(markdown: str) -> tuple[str, list[tuple[int, int, str | None, str]]]:
    """The plain text, and (start, end, heading, anchor) of its sections, in code points of that text. A section's text begins with its heading; empty ones are left out."""
    if "\0" in markdown:
        raise ValueError("NUL in a text")
    found = headings(markdown)
    names = unique([slug(h) for _, h in found])
    edges = [a for a, _ in found] + [len(markdown)]
    parts = [(None, "", markdown[: edges[0]])] if edges[0] or not found else []
    parts += [(plain(h), a, markdown[edges[i] : edges[i + 1]]) for i, ((_, h), a) in enumerate(zip(found, names, strict=True))]
    out, at, spans = [], 0, []
    for h, a, part in parts:
        if t := plain(part):
            spans.append((at, at + len(t), h, a))
            out.append(t)
            at += len(t) + 2
    return "\n\n".join(out), spans


def search_documents(docs: DataFrame) -> DataFrame:
    """doc_id, body_text, sections, error of docs (doc_id, text). error is null, or says why there is no text."""

    def one(t: str | None) -> tuple[str | None, list[dict] | None, str | None]:
        try:
            body, spans = projected(t or "")
        except ValueError as e:
            return None, None, str(e)
        return body, [{"start": a, "end": b, "heading": h, "anchor": x} for a, b, h, x in spans], None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [one(t) for t in f.text]
            yield pd.DataFrame({"doc_id": f.doc_id, "body_text": [g[0] for g in got], "sections": [g[1] for g in got], "error": [g[2] for g in got]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, body_text string, sections array<struct<start:int,end:int,heading:string,anchor:string>>, error string")


def front_matter(text: Column | str) -> Column:
    """The `key: value` lines of a `---` header as a map; values in double quotes lose them."""
    head = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    pairs = F.str_to_map(head, F.lit("\r?\n"), F.lit(":"))
    return F.transform_keys(F.transform_values(pairs, lambda _, v: F.regexp_replace(F.trim(v), '^"|"$', "")), lambda k, _: F.trim(k))
