"""From a query string to units, and a search on a stored index: ranked, filtered, paged, with what to try instead.

A query is a few words, so this part runs on the driver; every row of the corpus is touched by Spark plans only. Word
breaking is a function that the caller may give (`Analyzer`): (word, start, end) of each word, in order.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexarium.operators import ranking, segmentation, snippets, suggest
from lexarium.operators.ranking import MAX_TERM, Unit
from lexarium.operators.segmentation import Analysis, Word, normal, plain_words
from lexarium.operators.segments import Segmented
from lexarium.operators.store import Stored
from lexarium.sources import shared

Analyzer = Callable[[str], list[Word]]
#: Characters of a query, weight of words that only raise scores, groups that an alias may span, results of a page.
MAX_QUERY, INTENT_WEIGHT, ALIAS_SPAN, PAGE = 512, 0.15, 4, 20
#: Parts that a query's results are dealt to before they are ranked.
DEALS = 64
INTENT = frozenset("a an and are about does for from how in is of on or the this to what when where which who why with".split())
QUESTIONS = ("how ", "what ", "when ", "where ", "which ", "who ", "why ", "?", "？")


@dataclass(frozen=True)
class Language:
    """What reading a query depends on: word breaking, words that only weigh little, fragments (pieces that aren't words of
    their own), names with the same meaning, marks of questions."""

    words: Analyzer = plain_words
    by_character: bool = False
    intent: frozenset[str] = INTENT
    fragment: Callable[[str], bool] = lambda w: len(w) == 1 and not w.isascii()
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    questions: tuple[str, ...] = QUESTIONS

    def __hash__(self) -> int:
        return hash((self.words, self.by_character, self.intent, self.fragment, tuple(sorted(self.aliases.items())), self.questions))


def language_of(analysis: Analysis, **more) -> Language:
    """The language whose words are broken as those of an index."""
    return Language(words=analysis.query, by_character=analysis.by_character, fragment=analysis.fragment, **more)


def alias_groups(lines: Iterable[str]) -> dict[str, tuple[str, ...]]:
    """Each name's group: a line has the names of one, parted by tabs or, without a tab, by blanks; # begins a comment line."""
    out: dict[str, tuple[str, ...]] = {}
    for line in lines:
        line = normal(line.strip())
        if line and not line.startswith("#"):
            names = tuple(n.strip() for n in (line.split("\t") if "\t" in line else line.split()) if n.strip())
            out.update(dict.fromkeys(names, names))
    return out


def phrases(words: list[Word], language: Language) -> list[list[Word]]:
    """Words that touch form a phrase where either of each two is a fragment, up to the longest term."""
    out: list[list[Word]] = []
    for word in words:
        before = out[-1][-1] if out else None
        touches = before is not None and before[2] == word[1] and (language.fragment(before[0]) or language.fragment(word[0]))
        if touches and word[2] - out[-1][0][1] <= MAX_TERM:
            out[-1].append(word)
        else:
            out.append([word])
    return out


def with_aliases(found: list[list[Word]], query: str, language: Language) -> list[list[Word]]:
    """Neighbouring groups that together spell an alias are one, of up to ALIAS_SPAN groups, the longest first."""
    out, k = [], 0
    while k < len(found):
        spans = (n for n in range(min(ALIAS_SPAN, len(found) - k), 1, -1) if query[found[k][0][1] : found[k + n - 1][-1][2]] in language.aliases)
        n = next(spans, 1)
        out.append([w for group in found[k : k + n] for w in group])
        k += n
    return out


def unit_of(group: list[Word], name: str, language: Language) -> Unit:
    """A phrase is core; a word is so if it has more than one character and isn't an intent word. Aliases are further spellings."""
    spelled = [group, *(words for other in language.aliases.get(name, ()) if (words := language.words(other)))]
    ways = dict.fromkeys((tuple(w for w, _, _ in words), tuple(a - words[0][1] for _, a, _ in words)) for words in spelled)
    if not language.by_character:
        ways = dict.fromkeys((words, ()) for words, _ in ways)
    parts = next(iter(ways))[0]
    little = len(parts) == 1 and parts[0] in language.intent
    at = tuple(at for _, at in ways) if language.by_character else None
    return Unit(tuple(words for words, _ in ways), INTENT_WEIGHT if little else 1.0, len(parts) > 1 or (len(parts[0]) > 1 and not little), at, name if at and len(parts) > 1 else None)


def parsed(query: str, language: Language = Language()) -> list[Unit]:
    """A query's units, each once. An error for over MAX_QUERY characters, NUL, no word or too many, or a word too long."""
    if len(query) > MAX_QUERY or "\0" in query:
        raise ValueError(f"a query has at most {MAX_QUERY} characters and no NUL")
    low = normal(query)
    units: dict[str, Unit] = {}
    for group in with_aliases(phrases(language.words(low), language), low, language):
        name = low[group[0][1] : group[-1][2]]
        units.setdefault(name, unit_of(group, name, language))
    return ranking.check(list(units.values()))


def split(units: list[Unit], language: Language) -> list[Unit]:
    """Phrases as their words, fragments left out."""
    out: dict[str, Unit] = {}
    for u in units:
        if len(u.spellings[0]) == 1:
            out.setdefault(u.name, u)
        else:
            out.update({w: unit_of([(w, 0, len(w))], w, language) for w in u.spellings[0] if not language.fragment(w) and w not in out})
    return list(out.values())


def is_question(query: str, units: list[Unit], language: Language = Language()) -> bool:
    low = normal(query)
    return any(m in low for m in language.questions) or any(not u.core and len(u.name) > 1 for u in units)


Index = Stored | Segmented


def ranked_many(stored: Index, asked: ranking.Asked) -> DataFrame:
    """query, doc_id, score of a set of queries: ranked, cut at a share of each one's best, then raised by titles."""
    found = shared.staged(ranking.ranked_many(stored.postings, stored.lengths, stored.statistics, asked, stored.analysis.within).select("query", "doc_id", "score"))
    return ranking.with_titles_many(ranking.cut_many(found), stored.documents.select("doc_id", "title_terms"), asked)


def ranked(stored: Index, units: list[Unit]) -> DataFrame:
    """doc_id, score of one query."""
    found = ranking.ranked(stored.postings, stored.lengths, stored.statistics, units, stored.analysis.within)
    return ranking.with_titles(ranking.cut(found), stored.documents.select("doc_id", "title_terms"), units)


def answered(stored: Index, asked: dict[int, str], language: Language | None = None) -> DataFrame:
    """query, doc_id, score of many query strings: each one's units, or its phrases' words where those give nothing. Strings are
    read in sets of ranking.QUERIES, each with one scan of its postings."""
    language = language or language_of(stored.analysis)
    out = None
    keys = sorted(asked)
    for k in range(0, len(keys), ranking.QUERIES):
        units = {q: parsed(asked[q], language) for q in keys[k : k + ranking.QUERIES]}
        one = ranked_many(stored, units)
        phrased = {q: u for q, u in units.items() if any(len(x.spellings[0]) > 1 for x in u)}
        if phrased:
            has = {r.query for r in ranking.found(stored.postings, phrased).select("query").distinct().collect()}  # a row a query
            words = {q: s for q, u in phrased.items() if q not in has and (s := split(u, language))}
            one = one.unionByName(ranked_many(stored, words)) if words else one
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no query")
    return out


def unmatched(stored: Index, units: list[Unit]) -> list[str]:
    """Core words that no document has, by the lexicon."""
    words = [u.spellings[0][0] for u in units if u.core and len(u.spellings[0]) == 1]
    known = {r.term for r in stored.lexicon.where(F.col("term").isin(words)).select("term").collect()} if words else set()
    return [w for w in words if w not in known]


def suggestion(stored: Index, query: str, units: list[Unit]) -> str | None:
    """The query with its unmatched words replaced by their nearest known terms, or None if there are none. A word may take the
    character beside it on either side: a slip may have parted it."""
    low = normal(query)
    for word in unmatched(stored, units):
        at = low.find(word)
        spans = {low[at : at + len(word)], low[at : at + len(word) + 1], low[max(0, at - 1) : at + len(word)]}
        asked = sorted({s.strip() for s in spans if len(s.strip()) > 1})
        near = suggest.suggestions(stored.lexicon, asked).collect()  # a row a span: three at most
        if near:
            best = min(near, key=lambda r: (r.distance, abs(len(r.term) - len(r.word)), -r.df, r.term))
            return low.replace(best.word, best.term, 1)
    return None


@dataclass
class Results:
    units: list[Unit]
    rows: list[Row]
    total: int
    question: bool
    suggestion: str | None = None
    by_source: list[Row] = field(default_factory=list)
    snippets: dict[object, list[Row]] = field(default_factory=dict)


_KEPT: OrderedDict[tuple, Results] = OrderedDict()
#: Pages that the driver keeps, each of PAGE rows or what the caller asks for.
KEPT_PAGES = 256


def first_of_each(found: DataFrame, k: int) -> DataFrame:
    """query, doc_id, score, rank of the k best of each query. Rows are dealt by query and a hash of the document first, so that no task
    ranks all of a query's results: k of each deal are ranked again."""
    order = [F.col("score").desc(), F.col("doc_id")]
    dealt = found.withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(DEALS)))
    few = dealt.withColumn("rank", F.row_number().over(W.partitionBy("query", "deal").orderBy(*order))).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order)).cast("long")).where(F.col("rank") <= k).drop("deal")


def results(stored: Index, query: str, language: Language | None = None, source: str | None = None) -> tuple[DataFrame, list[Unit]]:
    """doc_id, score, title, source (and what else documents have) of all results, and the units that gave them: the query's, or its phrases' words if those give none."""
    language = language or language_of(stored.analysis)
    units = parsed(query, language)
    if any(len(u.spellings[0]) > 1 for u in units) and ranking.hits(stored.postings, units).isEmpty():
        units = split(units, language) or units
    rows = ranked(stored, units).join(stored.documents.drop("title_terms"), "doc_id")
    return (rows if source is None else rows.where(F.col("source") == source)), units


def shown(stored: Index, rows: list[Row], units: list[Unit]) -> dict[object, list[Row]]:
    """Snippets by document of one page: its few texts are looked up by their ids."""
    ids = [r.doc_id for r in rows]
    texts = stored.bodies.where(F.col("doc_id").isin(ids)) if ids else stored.bodies.limit(0)
    terms = [(s, u.weight) for u in units for s in u.spellings]
    out: dict[object, list[Row]] = {}
    for r in snippets.snippets(texts, terms, stored.analysis).orderBy("doc_id", "n").collect():  # snippets.WINDOWS a document
        out.setdefault(r.doc_id, []).append(r)
    return out


def search(stored: Index, query: str, language: Language | None = None, source: str | None = None, page: int = 0, size: int = PAGE, year: int | None = None) -> Results:
    """One page of results with snippets, their number, counts by source over the unfiltered results, and a suggestion if there are
    none. year: of the documents' publication_date."""
    language = language or language_of(stored.analysis)
    key = (stored.at, normal(query), language, source, year, page, size)
    if key in _KEPT:
        _KEPT.move_to_end(key)
        return _KEPT[key]
    every, units = results(stored, query, language)
    every = every.persist()
    try:
        facets = every.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "source").collect()  # a row a source
        kept = every if source is None else every.where(F.col("source") == source)
        kept = kept if year is None else kept.where(F.substring("publication_date", 1, 4) == str(year))
        total = sum(r.n for r in facets if source is None or r.source == source) if year is None else kept.count()
        rows = kept.orderBy(F.round("score", 9).desc(), "doc_id").offset(page * size).limit(size).collect()
    finally:
        every.unpersist()
    out = Results(units, rows, total, is_question(query, units, language), None if total else suggestion(stored, query, units), facets, shown(stored, rows, units))
    _KEPT[key] = out
    if len(_KEPT) > KEPT_PAGES:
        _KEPT.popitem(last=False)
    return out
