"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The patterns give the base spans. The field reads the regions of a text that hold digits or @: runs of words between
single blanks, cut into tokens (runs of letters and digits that change more than once, as keys do; digits; letters; single
marks). A candidate is one token of any length, or a run of up to LONGEST tokens and CHARS characters; features of the whole span (digit counts, checksum, shape of its groups, neighbours, words before it) score
it for each kind, and dynamic programming over bounded entities chooses boundaries and kinds together. Chosen spans that
overlap no base span are added: such as a telephone number followed by a card number, which the greedy patterns take for
one number and drop, telephone numbers without +, or secrets (keys and tokens: a kind that the patterns don't have).

The field is fitted by its likelihood on made examples and on at most `sample` regions of the corpus, from documents
chosen by a hash of their id, labelled by the patterns where these speak (documented bounds; every text is read in whole).
Regions of over 200 characters don't train.

Defined cases: a null or empty text has no spans; spans count code points, and equal starts are ordered by kind; a region
may be as long as its text; an entity of several tokens and over CHARS characters is found by the patterns only; repeated rows have the same
spans; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: The patterns. A number begins where no digit stands before, which is where its leftmost match begins.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Tokens and characters of an entity at most, regions of the corpus to train on, documents they come from, passes over them.
LONGEST, CHARS, SAMPLE, DRAWN, PASSES = 16, 256, 400, 8192, 4
#: A run of eight ASCII letters and digits or more that changes between them twice or more is one token, as nothing begins or ends inside it.
TOKEN = re.compile(r"(?=[A-Za-z0-9]{8})(?:[A-Za-z]+[0-9]+[A-Za-z]|[0-9]+[A-Za-z]+[0-9])[A-Za-z0-9]*|[0-9]+|[^\W\d_]+|.", re.DOTALL)
#: Words between single blanks that hold a digit or @; regions don't cross lines. Each word is read once, whatever its length.
REGION = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:[ \t][^\s0-9@]*+[0-9@]\S*+)*+")
#: What the patterns say nothing of, so that a region that has it doesn't train: a run of letters with digits.
SECRET_LIKE = re.compile(r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{16,}")
#: Words before a span that tell of its kind.
BEFORE = (
    ("says_key", re.compile(r"(?:token|key|secret|passw(?:or)?d|pwd|auth|bearer|apikey)\W{0,6}\Z", re.IGNORECASE)),
    ("says_tel", re.compile(r"(?:tel|phone|fax|call|mobile|cell)\W{0,3}\Z", re.IGNORECASE)),
    ("says_card", re.compile(r"(?:card|visa|mastercard|amex)\W{0,3}\Z", re.IGNORECASE)),
    ("says_ip", re.compile(r"(?:ip|host|address|server)\W{0,3}\Z", re.IGNORECASE)),
)
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2]) % 10 == (-sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10


def emails(text: str) -> list[tuple[int, int]]:
    """From each @: what may stand before it, back to the match before, and the domain after it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        own = text[end:at]
        start = end + len(own.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        end = m.end() if m else at + 1
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that hold; a match that fails is dropped and not tried again."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


FEATURES = (
    "span digits0 digits1 digits4 digits7 digits10 digits12 digits14 digits16 digits17 digits20 at one_at dots3 octets plus checksum letters mixed space hyphen paren dot "
    "starts_digit ends_digit ends_letter joined_left joined_right dot_right dot_after_at number grouped even_groups tel_groups long longer quoted one_token_run says_key says_tel says_card says_ip"
).split()
_AT = {name: k for k, name in enumerate(FEATURES)}
_DIGITS = (("digits20", 20), ("digits17", 17), ("digits16", 16), ("digits14", 14), ("digits12", 12), ("digits10", 10), ("digits7", 7), ("digits4", 4), ("digits1", 1), ("digits0", 0))
_GROUPS = re.compile(r"[ .()-]+")


def span_features(text: str, a: int, b: int) -> list[int]:
    """Which of FEATURES hold for text[a:b]."""
    s = text[a:b]
    digits = "".join(DIGIT.findall(s))
    n = len(digits)
    letters = any(c.isalpha() for c in s)
    left, right = text[a - 1 : a] if a else "", text[b : b + 1]
    number = not letters and "@" not in s and re.fullmatch(r"\+?[0-9 ().-]+", s) is not None
    groups = [len(g) for g in _GROUPS.split(s.lstrip("+(")) if g]
    octets = s.count(".") == 3 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in s.split("."))
    before = text[max(0, a - 24) : a]
    found = ["span", next(name for name, least in _DIGITS if n >= least)]
    for name, holds in (
        ("at", "@" in s), ("one_at", s.count("@") == 1), ("dots3", s.count(".") == 3), ("octets", octets), ("plus", s[0] == "+"), ("checksum", number and s[0] != "+" and luhn(digits or "1")), ("letters", letters),
        ("mixed", letters and n > 0 and s.isalnum()), ("space", " " in s), ("hyphen", "-" in s), ("paren", "(" in s or ")" in s), ("dot", "." in s), ("starts_digit", s[0].isdigit()),
        ("ends_digit", s[-1].isdigit()), ("ends_letter", s[-1].isalpha()), ("joined_left", left.isalnum() or left in {"+", "@", "_"}), ("joined_right", right.isalnum() or right in {"@", "_"}),
        ("dot_right", right == "." and text[b + 1 : b + 2].isalnum()), ("dot_after_at", "." in s.partition("@")[2]), ("number", number), ("grouped", number and len(groups) > 1),
        ("even_groups", number and groups == [4, 4, 4, 4]), ("tel_groups", number and groups[-2:] == [3, 4]), ("long", b - a > 24), ("longer", b - a > 31), ("quoted", left in {'"', "'", "`"} and left == right), ("one_token_run", s.isalnum()),
        *((name, pattern.search(before) is not None) for name, pattern in BEFORE),
    ):
        if holds:
            found.append(name)
    return [_AT[f] for f in found]


class Lattice:
    """Tokens of a region, and for each end token its candidates: (start token, features), made when asked for."""

    def __init__(self, text: str, a: int, b: int) -> None:
        self.text = text
        self.starts = [m.start() for m in TOKEN.finditer(text, a, b)]
        self.ends = [*self.starts[1:], b]
        self.firsts = [text[s].isalnum() or text[s] in "+(" for s in self.starts]
        self.lasts = [text[e - 1].isalnum() for e in self.ends]
        self.rich = np.cumsum([0, *(text[s].isdigit() or text[s] == "@" or DIGIT.search(text, s, e) is not None for s, e in zip(self.starts, self.ends, strict=True))]).tolist()
        self.kept: list[list[tuple[int, list[int]]]] = []  # all candidates, where a region is read again and again

    def keep(self) -> Lattice:
        self.kept = [self.into(j) for j in range(len(self) + 1)]
        return self

    def __len__(self) -> int:
        return len(self.starts)

    def into(self, j: int) -> list[tuple[int, list[int]]]:
        """The candidates that end before token j."""
        if self.kept:
            return self.kept[j]
        out = []
        if j and self.lasts[j - 1]:
            for i in range(j - 1, max(0, j - LONGEST) - 1, -1):
                size = self.ends[j - 1] - self.starts[i]
                if size > CHARS and i < j - 1:
                    break
                if size >= 7 and self.firsts[i] and self.rich[j] > self.rich[i]:
                    out.append((i, span_features(self.text, self.starts[i], self.ends[j - 1])))
        return out


class Field:
    """weights[kind, feature] of spans, moves[kind, kind] between neighbouring segments; the last kind is none, of one token."""

    def __init__(self) -> None:
        self.weights = np.zeros((len(KINDS), len(FEATURES)))
        self.moves = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def segments(self, x: Lattice) -> Iterator[list[tuple[int, list[int] | None, np.ndarray]]]:
        """For each end 0..n the segments that end there: start, features, scores. None is kept."""
        none = np.full(len(KINDS) + 1, -np.inf)
        none[-1] = 0.0
        for j in range(len(x) + 1):
            yield [] if j == 0 else [(j - 1, None, none), *((i, f, np.append(self.weights[:, f].sum(1), -np.inf)) for i, f in x.into(j))]

    def best(self, x: Lattice) -> list[tuple[int, int, int]]:
        """(start token, end token, kind) of the entities of the best segmentation."""
        n, k = len(x), len(KINDS)
        score = np.full((n + 1, k + 1), -np.inf)
        score[0, k] = 0.0
        back = np.zeros((n + 1, k + 1, 2), dtype=np.int32)
        for j, into in enumerate(self.segments(x)):
            for i, _, s in into:
                path = score[i][:, None] + self.moves + s[None, :]
                top = path.argmax(0)
                for y in range(k + 1):
                    if path[top[y], y] > score[j, y]:
                        score[j, y] = path[top[y], y]
                        back[j, y] = (i, int(top[y]))
        out, j, y = [], n, int(score[n].argmax())
        while j:
            i, before = back[j, y].tolist()
            if y < k:
                out.append((i, j, y))
            j, y = i, before
        return out[::-1]

    def learn(self, x: Lattice, gold: list[tuple[int, int, int]], rate: float, ridge: float) -> None:
        """A step up the likelihood's gradient: what gold has less what the model expects."""
        n, k = len(x), len(KINDS)
        segments = list(self.segments(x))
        ahead, behind = np.full((n + 1, k + 1), -np.inf), np.full((n + 1, k + 1), -np.inf)
        ahead[0, k], behind[n] = 0.0, 0.0
        for j in range(1, n + 1):
            for i, _, s in segments[j]:
                ahead[j] = np.logaddexp(ahead[j], np.logaddexp.reduce(ahead[i][:, None] + self.moves, axis=0) + s)
        for j in range(n, 0, -1):
            for i, _, s in segments[j]:
                behind[i] = np.logaddexp(behind[i], np.logaddexp.reduce(self.moves + (s + behind[j])[None, :], axis=1))
        total = np.logaddexp.reduce(ahead[n])
        weights, moves = np.zeros_like(self.weights), np.zeros_like(self.moves)
        for j in range(1, n + 1):
            for i, f, s in segments[j]:
                share = np.exp(ahead[i][:, None] + self.moves + (s + behind[j])[None, :] - total)
                moves -= share
                if f is not None:
                    weights[:, f] -= share.sum(0)[:k, None]
        features = {(i, j): f for j in range(1, n + 1) for i, f, _ in segments[j] if f is not None}
        at, before = 0, k
        for i, j, y in [*gold, (n, n, k)]:
            while at < i:
                moves[before, k] += 1
                at, before = at + 1, k
            if j > i:
                weights[y, features[i, j]] += 1
                moves[before, y] += 1
                at, before = j, y
        self.weights += rate * (weights - ridge * self.weights)
        self.moves += rate * (moves - ridge * self.moves)


def gold_of(x: Lattice, spans: list[Span]) -> list[tuple[int, int, int]] | None:
    """The spans as tokens; of overlapping ones the first. None if the lattice lacks one: it would be taught as none."""
    first, last = {s: i for i, s in enumerate(x.starts)}, {e: j + 1 for j, e in enumerate(x.ends)}
    out, end = [], 0
    for a, y, b in sorted(spans):
        if a < end:
            continue
        i, j = first.get(a), last.get(b)
        if i is None or j is None or all(s != i for s, _ in x.into(j)):
            return None
        out.append((i, j, y))
        end = b
    return out


def examples(n: int = 400, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Made lines of patterned parts side by side, with their spans."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = digits(15)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        return number if r.random() < 0.7 else r.choice(" -").join(number[k : k + 4] for k in range(0, 16, 4))

    def secret() -> str:
        return "".join(r.choice(hexes) for _ in range(r.choice((32, 40, 64, 128)))) if (hexes := r.choice(("0123456789abcdef", "0123456789ABCDEF"))) and r.random() < 0.6 else "".join(r.choice("ABCDEFGHJKMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789") for _ in range(r.randrange(20, 44)))

    groups = lambda *sizes: [digits(k) for k in sizes]
    makers = (
        lambda: f"{r.choice(('info', 'a.b', 'jo_hn', 'x'))}{digits(2)}@{r.choice(('mail', 'post'))}{digits(1)}.example.{r.choice(('com', 'org'))}",
        lambda: ".".join(str(r.randrange(256)) for _ in range(4)),
        card,
        lambda: r.choice((f"+{r.randrange(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{r.randrange(1, 99)} {digits(3)} {digits(3)} {digits(4)}", f"+{digits(11)}", f"({digits(3)}) {digits(3)}-{digits(4)}", "-".join(groups(3, 3, 4)))),
        secret,
    )
    says = (("mail ", ""), ("host ", "from "), ("card ", "visa: "), ("tel: ", "call "), ('token = "', "key: ", "secret=", 'password = "', "api_key='"))

    def other() -> str:
        body = digits(15)
        return r.choice((digits(4), f"{digits(2)}.{digits(2)}", digits(8), "-".join(groups(4, 2, 2)), f"{digits(3)}.{r.randrange(256, 999)}.{digits(2)}.{digits(2)}", next(body + c for c in "0123456789" if not luhn(body + c)), f"v{digits(1)}.{digits(1)}.{digits(2)}", f"word{digits(3)}", "".join(r.choice("abcdefgh") for _ in range(30)) + digits(1), "/".join(groups(3, 3, 4))))

    out = []
    for _ in range(n):
        text, spans = r.choice(("", "tel: ", "x ", "(")), []
        for _ in range(r.randrange(1, 4)):
            kind = r.randrange(7)
            part = makers[kind]() if kind < 5 else other()
            said = r.choice(says[kind]) if kind == 4 or (kind < 5 and r.random() < 0.3) else ""
            text += said
            if kind < 5:
                spans.append((len(text), kind, len(text) + len(part)))
            text += part + (said[-1] if said[-1:] in ('"', "'") else "") + r.choice((" ", " ", ", ", ". ", "!! "))
        out.append((text.rstrip(" "), spans))
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """On the made examples and at most `sample` regions of about DRAWN documents, those of which the id's hash falls in a step."""
    docs = common.documents(docs)
    step = max(1, docs.count() // DRAWN)
    rows = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).where(F.col("text").rlike("[0-9@]"))

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = {m[0] for t in b.column("text").to_pylist() for m in REGION.finditer(t) if m.end() - m.start() <= 200}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(own), pa.string())], ["region"])

    drawn = rows.select("text").mapInArrow(regions, "region string").distinct().orderBy(F.xxhash64("region"), "region").limit(sample).collect()
    given = [(r.region, base_spans(r.region)) for r in drawn if not SECRET_LIKE.search(r.region)]
    lattices = []
    for k, (text, spans) in enumerate([*(made := examples()), *given]):
        x = Lattice(text, 0, len(text)).keep()
        gold = gold_of(x, spans)
        if gold is not None:
            lattices.append((x, gold))
        elif k < len(made):
            raise ValueError(f"a made span is no candidate: {text!r}")
    field, r = Field(), random.Random(11)
    for k in range(PASSES):
        r.shuffle(lattices)
        for x, gold in lattices:
            field.learn(x, gold, 0.25 / (1 + k), 1e-4)
    return field


def added_spans(field: Field, text: str, base: list[Span]) -> list[Span]:
    """Entities that the field finds in the text's regions and that overlap no base span."""
    out = []
    for m in REGION.finditer(text):
        if m.end() - m.start() < 7:
            continue
        a, b = m.span()
        if len(inside := [s for s in base if s[0] < b and s[2] > a]) == 1 and inside[0][2] - inside[0][0] > b - a - 7:
            continue  # what is left beside the base span is too short for another
        x = Lattice(text, a, b)
        for i, j, y in field.best(x):
            start, end = x.starts[i], x.ends[j - 1]
            if all(end <= s[0] or start >= s[2] for s in inside):
                out.append((start, y, end))
    return out


def all_spans(field: Field, text: str) -> list[Span]:
    base = base_spans(text)
    return base + (added_spans(field, text, base) if "@" in text or DIGIT.search(text) else [])


def found(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 (of the written base spans), spans (all, written), n_spans, n_secret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                spans = all_spans(field, text)
                out.append((*(sum(s[1] == k for s in base) for k in range(len(BASE_KINDS))), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans), sum(s[1] == len(BASE_KINDS) for s in spans)))
            columns = list(zip(*out, strict=True)) or [()] * len(names[1:])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n, c in zip(names[1:], columns, strict=True))], names)

    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_spans", "n_secret"]
    return common.documents(docs).mapInArrow(run, ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced once."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    docs = common.table(spark, sf_dir, "documents")
    return found(docs, train(docs))
