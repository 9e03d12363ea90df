"""Column functions for text: all built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = r"[\p{L}\p{N}]+"


def ascii_lower(text: Column | str) -> Column:
    """Lower-case A-Z only: other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def tokens(text: Column | str) -> Column:
    """Runs of letters and digits, ASCII-lowered, in order."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def word_count(text: Column | str) -> Column:
    """Han characters and runs of Latin letters, counted together."""
    return (F.regexp_count(text, F.lit("[一-鿿]")) + F.regexp_count(text, F.lit("[a-zA-Z]+"))).cast("long")


def clean(text: Column | str) -> Column:
    """Without the inline tags that may stand in bodies (bare ones: what has attributes or is prose with < stays); line ends evened; runs of blank lines one; trimmed."""
    bare = F.regexp_replace(text, r"(?i)</?(?:br|u|b|i|em|strong|center|sup|sub|p)\s*/?>", "")
    even = F.regexp_replace(bare, "\r\n?", "\n")
    few = F.regexp_replace(even, r"\n(?:[^\S\n]*\n){2,}", "\n\n")
    return F.regexp_replace(few, r"^\s+|\s+$", "")


def squeezed(text: Column | str) -> Column:
    """White space collapsed to single spaces, trimmed."""
    return F.regexp_replace(F.regexp_replace(text, "[ \t\r\n]+", " "), "^ | $", "")


def excerpt(text: Column | str, length: int = 160) -> Column:
    s = squeezed(text)
    return F.when(F.length(s) > length, F.concat(F.left(s, F.lit(length)), F.lit("…"))).otherwise(s)


def slug(uri: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(uri, r"\.md$", ""), "/", "_")


def valid_uri(uri: Column | str) -> Column:
    """Relative, ends in .md, without NUL, backslash, or empty, '.' and '..' parts."""
    u = F.col(uri) if isinstance(uri, str) else uri
    return u.rlike(r"\.md$") & ~u.rlike("[\\x00\\\\]") & ~u.rlike("(^|/)(\\.{1,2})?(/|$)")


def _given(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is computed once however often it stands there."""
    return F.get(F.transform(F.array(value), then), 0)


def body(text: Column | str, start: str = "## Body", end: str = "## Appendix") -> Column:
    """Lines after the first line `start`, up to the first later line `end` (blanks around either don't count); empty without `start`."""
    place = lambda a, line: F.array_position(F.transform(a, lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r"))), line)
    before = lambda a, n: F.when(n > 0, F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0)).cast("int"))).otherwise(a)
    after = lambda a, n: F.slice(a, (n + 1).cast("int"), F.greatest(F.size(a) - n, F.lit(0)).cast("int"))
    kept = lambda a: _given(place(a, end), lambda n: F.array_join(before(a, n), "\n"))
    of = lambda a: _given(place(a, start), lambda n: F.when(n > 0, _given(after(a, n), kept)).otherwise(""))
    return _given(F.split(text, "\r\n|\r|\n"), of)


def title(text: Column | str) -> Column:
    """The first `# ` line, links unwrapped, emphasis marks removed."""
    line = F.regexp_extract(text, r"(?m)^# +([^\r\n]+)", 1)
    return F.regexp_replace(F.regexp_replace(line, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"\*\*|__|`", "")


def headings(text: Column | str) -> Column:
    """Titles of the level-two headings."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^##(?!#)[ \t]+([^\r\n]+)"), F.lit(1))


def heading_places(text: Column | str) -> Column:
    """Of each level-two heading its place (code points from 0) and title: what stands before each is cut off at headings and measured."""
    parts = F.split(text, r"(?m)(?=^##(?!#)[ \t]+[^\r\n])")
    placed = F.transform(parts, lambda x, i: F.struct(F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda n, y: n + F.length(y)).alias("place"), F.trim(F.regexp_extract(x, r"^##(?!#)[ \t]+([^\r\n]+)", 1)).alias("title")))
    return F.filter(placed, lambda p: p["title"] != "")


def contract_violation(text: Column | str) -> Column:
    """Why a body breaks the heading contract, or null."""
    t = F.col(text) if isinstance(text, str) else text
    titles = F.transform(headings(t), F.trim)

    def wrapped(x: Column, mark: str) -> Column:
        n = len(mark)
        return (F.length(x) > 2 * n) & F.startswith(x, F.lit(mark)) & F.endswith(x, F.lit(mark)) & ~F.contains(F.substring(x, F.lit(n + 1), F.length(x) - 2 * n), F.lit(mark))

    other = F.regexp_extract(t, r"(?m)^(#|#{3,})(?!#)[ \t]", 1)
    return (
        F.when(other == "#", "level-one heading").when(other != "", "deep heading").when(F.contains(t, F.lit("[^")), "footnote")
        .when(F.exists(titles, lambda x: F.contains(x, F.lit("]("))), "link in heading").when(F.exists(titles, lambda x: wrapped(x, "**") | wrapped(x, "__") | wrapped(x, "`")), "emphasised heading")
    )


def publication_date(text: Column | str, label: str = "Published") -> Column:
    """The date of the header line `label YYYY-MM-DD`, which may go on after a |; null without one."""
    return F.nullif(F.regexp_extract(text, rf"(?m)^{label}[ \t]+(\d{{4}}-\d{{2}}-\d{{2}})[ \t]*(?:\|[^\r\n]*)?\r?$", 1), F.lit(""))


def valid_date(value: Column | str) -> Column:
    """An ISO date or date and time as its date; null for anything else."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(F.left(v, F.lit(10)), F.lit("yyyy-MM-dd")).cast("date"))


def section_label(heading: Column | str, most: int = 12) -> Column:
    """A heading as a short label: links unwrapped, marks off, blanks collapsed, cut with an ellipsis."""
    bare = F.regexp_replace(F.regexp_replace(heading, r"\[([^\[\]]*)\]\([^)]*\)", "$1"), r"\*\*|__|`", "")
    s = squeezed(bare)
    return F.when(F.length(s) > most, F.concat(F.left(s, F.lit(most)), F.lit("…"))).otherwise(s)


def grader_excerpt(title: Column, heading: Column, similarity: Column, text: Column, most: int = 350) -> Column:
    """What a grader reads of a chunk: title, heading, similarity to two places, and the text's first characters, blanks collapsed."""
    return F.concat(title, F.when(heading.isNotNull() & (heading != ""), F.concat(F.lit(" / "), heading)).otherwise(F.lit("")), F.lit(" ("), F.format_number(similarity, 2), F.lit("): "), F.left(squeezed(text), F.lit(most)))


def etag(*columns: Column | str) -> Column:
    """SHA-256 of the columns as JSON, in the order given; nulls count."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
