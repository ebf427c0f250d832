"""Full-text search: terms with positions, conjunctive match, cover-density rank.

``postings`` is the stored form: a row for each term of a text with its positions, written in the order of terms, so that a
query's filter on its terms skips all other row groups. Where no postings are stored, a query filters each text's tokens to
its terms inside the row; a corpus is never exploded for a query.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from quarry.functions.batches import small_batches
from quarry.functions.stemming import stem

# English words that are no terms (their positions count).
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not only own same so than too
very s t can will just don should now""".split()

_WORD = r"[\p{L}\p{M}\p{N}]+"
_HYPHENED = rf"{_WORD}(?:-{_WORD}){{0,15}}"
_HOST = rf"{_HYPHENED}(?:\.{_HYPHENED}){{0,15}}\.\p{{L}}{{2,}}"
#: What is a token, the first that fits: a scheme, an address of mail, a host with a path or without, a number with points, a word
#: of letters of any script and digits, with hyphens or without. Repeats are bounded, so that odd texts cost no more than others.
TOKEN = "|".join([r"[a-z]+://", rf"{_WORD}(?:[._+-]{_WORD}){{0,15}}@{_HOST}", rf"{_HOST}(?:/(?:[\p{{L}}\p{{M}}\p{{N}}_.~%&=+?#/-]*[\p{{L}}\p{{M}}\p{{N}}/])?)?", r"\p{N}+(?:\.\p{N}+){1,15}", _HYPHENED])
#: What one cover of a query's terms adds at most.
WEIGHT = 0.1


@dataclass(frozen=True)
class Analyzer:
    """How text becomes terms: lower-cased tokens, stop words left out, English stems unless asked otherwise.

    A word with hyphens is a term and each of its parts another; so are a host with a path, the host and the path. Schemes
    are none. Stems are of words of ASCII letters; all other terms stay as they are. Every term has a place of its own.
    """

    stemmed: bool = True
    stop_words: bool = True

    def terms(self, text: Column) -> Column:
        """array<string> of a text's terms; "" for a stop word (its place counts)."""
        if self.stemmed:
            return _analyzed(text, self)
        found = F.flatten(F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), _terms_of))
        if self.stop_words:
            found = F.transform(found, lambda w: F.when(w.isin(STOP_WORDS), "").otherwise(w))
        return found

    def all_terms(self, text: str) -> list[str]:
        """As ``terms``, of one text."""
        out: list[str] = []
        for piece in text.lower().split():  # no token holds white space
            of = _piece_terms if len(piece) <= LONG else _piece_terms.__wrapped__
            out += of(piece, self.stemmed, self.stop_words)
        return out

    def query_terms(self, query: str) -> list[str]:
        """The distinct terms that a text must hold, all of them."""
        return list(dict.fromkeys(w for w in self.all_terms(query) if w))


_STOPS = frozenset(STOP_WORDS)


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(TOKEN)


#: Longer stretches without white space aren't kept; places of terms that a worker holds at a time, or a text's.
LONG, HELD = 64, 1 << 18


@lru_cache(maxsize=1 << 17)
def _piece_terms(piece: str, stemmed: bool, stop_words: bool) -> tuple[str, ...]:
    """The terms of a lower-cased stretch without white space; texts repeat most of theirs."""
    core = piece.strip(string.punctuation)
    if core.isalpha() and "://" not in piece:  # a word alone: no mark around it takes part in a token
        return ("" if stop_words and core in _STOPS else stem(core) if stemmed else core,)
    return tuple("" if stop_words and w in _STOPS else stem(w) if stemmed else w for token in _pattern().findall(piece) for w in _split(token))


def _split(token: str) -> list[str]:
    """The terms of a token."""
    if token.endswith("://"):
        return []
    if "@" in token:
        return [token]
    host, slash, path = token.partition("/")
    if slash:
        return [token, host, slash + path] if path else [token, host]
    if "-" in token and "." not in token:
        return [token, *token.split("-")]
    return [token]


def _terms_of(token: Column) -> Column:
    """As ``_split``."""
    host = F.substring_index(token, "/", 1)
    path = F.substring(token, F.length(host) + 1, F.length(token))
    with_path = F.when(F.length(path) > 1, F.array(token, host, path)).otherwise(F.array(token, host))
    return (
        F.when(token.endswith("://"), F.array().cast("array<string>")).when(F.contains(token, F.lit("@")), F.array(token)).when(F.contains(token, F.lit("/")), with_path)
        .when(F.contains(token, F.lit("-")) & ~F.contains(token, F.lit(".")), F.concat(F.array(token), F.split(token, "-"))).otherwise(F.array(token))
    )


def _analyzed(text: Column, analyzer: Analyzer) -> Column:
    """Tokens, stop words and stems in one step outside the JVM."""

    @F.pandas_udf("array<string>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: analyzer.all_terms(x) if x is not None else None)

    return run(text)


def _places(docs: DataFrame, text_col: str, a: Analyzer, keep: list[Column]) -> DataFrame:
    """The ``keep`` columns, term, pos (from 1) of every term that isn't a stop word."""
    out = docs.select(*keep, F.posexplode(a.terms(F.col(text_col))).alias("_p", "term"))
    return out.filter("term <> ''").withColumn("pos", F.col("_p") + 1).drop("_p")


def places(docs: DataFrame, id_col: str, text_col: str, analyzer: Analyzer | None = None) -> DataFrame:
    """id, term, pos (from 1) of every term that isn't a stop word."""
    return _places(docs, text_col, analyzer or Analyzer(), [F.col(id_col).alias("id")])


def postings(docs: DataFrame, id_col: str, text_col: str, analyzer: Analyzer | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """term, id, positions (from 1, ascending) of every term of every text, their number (``uses``), and the columns ``keep``.

    A text's terms are grouped where it is read: no shuffle is needed, and a worker holds HELD places or those of a text.
    """
    a = analyzer or Analyzer()
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("_text"))
    fields = rows.schema.fields[:-1]
    names = ["term", *[f.name for f in fields], "uses", "positions"]
    of = list(range(len(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(fields))
            terms: list[str] = []
            at: list[int] = []
            uses: list[int] = []
            places: list[int] = []

            def made() -> pa.RecordBatch:
                ends = pa.array(np.concatenate([[0], np.cumsum(uses)]).astype(np.int32))
                kept = b.select(of).take(pa.array(at, pa.int64()))
                found = [pa.array(terms, pa.string()), *kept.columns, pa.array(uses, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(places, pa.int32()))]
                return pa.RecordBatch.from_arrays(found, names)

            for i in range(b.num_rows):
                text = texts[i].as_py()
                if text is None:
                    continue
                held: dict[str, list[int]] = {}
                for pos, w in enumerate(a.all_terms(text), 1):
                    if w in held:
                        held[w].append(pos)
                    elif w:
                        held[w] = [pos]
                terms += held
                at += repeat(i, len(held))
                for found in held.values():
                    uses.append(len(found))
                    places += found
                if len(places) >= HELD:
                    yield made()
                    terms, at, uses, places = [], [], [], []
            if places:
                yield made()

    whole = [TY.StructField("term", TY.StringType()), *fields, TY.StructField("uses", TY.IntegerType()), TY.StructField("positions", TY.ArrayType(TY.IntegerType()))]
    return rows.mapInArrow(run, TY.StructType(whole))


def order() -> list[Column]:
    """How postings lie: of each term the texts that use it most come first, so that a bound on ``uses`` skips row groups and pages."""
    return [F.col("term"), F.col("uses").desc(), F.col("id")]


def write_postings(rows: DataFrame, path: str) -> None:
    """Postings as files in the order of their terms: each file holds a range of them."""
    rows.repartitionByRange(*order()).sortWithinPartitions(*order()).write.mode("overwrite").parquet(path)


def match(docs: DataFrame, query: str, text_col: str, analyzer: Analyzer | None = None) -> DataFrame:
    """The rows whose text holds every term of the query; none for a query of stop words only."""
    a = analyzer or Analyzer()
    terms = a.query_terms(query)
    if not terms:
        return docs.limit(0)
    held = a.terms(F.col(text_col))
    wanted = None
    for t in terms:
        one = F.array_contains(held, t)
        if not a.stemmed:  # a substring test that needs no tokens decides most rows
            one = F.lower(F.col(text_col)).contains(t) & one
        wanted = one if wanted is None else wanted & one
    return docs.filter(wanted)


def positions(docs: DataFrame, query: str, id_col: str, text_col: str, analyzer: Analyzer | None = None) -> DataFrame:
    """id, term, pos of the query's terms in the rows that match it."""
    a = analyzer or Analyzer()
    small_batches(docs.sparkSession)
    wanted = frozenset(a.query_terms(query))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, terms, places = [], [], []
            for i, text in enumerate(b.column(1)):
                held = a.all_terms(text.as_py() or "") if wanted else []
                if wanted and wanted.issubset(held):
                    found = [(w, pos) for pos, w in enumerate(held, 1) if w in wanted]
                    at += repeat(i, len(found))
                    terms += (w for w, _ in found)
                    places += (pos for _, pos in found)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(places, pa.int32())], ["id", "term", "pos"])

    return rows.mapInArrow(run, TY.StructType([rows.schema["id"], TY.StructField("term", TY.StringType()), TY.StructField("pos", TY.IntegerType())]))


def _held(stored: DataFrame, terms: list[str]) -> DataFrame:
    """id, its address (where the postings have one) and _held: of each of ``terms`` the place in the list and the positions, for texts that hold all.

    Only those terms' postings are read; a text has a row for each.
    """
    found = stored.filter(F.col("term").isin(terms or [""]))
    place = F.array_position(F.array(*[F.lit(t) for t in terms or [""]]), F.col("term")).cast("int")
    more = [F.first("address").alias("address")] if "address" in stored.columns else []
    whole = found.groupBy("id").agg(F.collect_list(F.struct(place.alias("place"), "term", "positions")).alias("_held"), *more)
    return whole.filter(F.size("_held") == len(terms))


def matching(stored: DataFrame, query: str, analyzer: Analyzer | None = None) -> DataFrame:
    """term, id, positions of the query's terms in the texts that hold them all; only those terms' postings are read."""
    terms = (analyzer or Analyzer()).query_terms(query)
    return _held(stored, terms).select("id", F.inline("_held")).drop("place")


def rank_stored(stored: DataFrame, query: str, analyzer: Analyzer | None = None) -> DataFrame:
    """id, text_rank (and address, where the postings have one) of the texts that match the query, from stored postings alone."""
    terms = (analyzer or Analyzer()).query_terms(query)
    return _held(stored, terms).withColumn("text_rank", _covers(F.lit(max(1, len(terms))))).drop("_held")


def top_stored(stored: DataFrame, query: str, k: int, analyzer: Analyzer | None = None) -> DataFrame:
    """The ``k`` best rows of ``rank_stored`` (ties by id), from the postings of texts that use every term often enough to be among them.

    A cover starts at the last use of some term before the first use, in it, of a given one; so a text has at most as many covers as
    the query has terms, for each use of the term it uses least, and each adds WEIGHT at most. The first pass reads the postings
    with at least so many uses that each term has some ``SEEN * k`` of them, by counts that read no positions. If the k-th best rank
    is over the bound of all texts with fewer uses, the pass decides; else another reads all postings whose bound reaches that
    rank. That one is always enough where k were found. The result, k rows, is held by the driver.
    """
    terms = (analyzer or Analyzer()).query_terms(query)
    ranked = lambda level: _best(rank_stored(stored.filter(F.col("uses").isNull() | (F.col("uses") >= level)), query, analyzer), k)
    level = _enough(stored, terms, SEEN * k)
    while True:
        found = ranked(level)
        best = found.collect()
        least = best[-1]["text_rank"] if len(best) == k and k else 0.0
        if level <= 1 or least > WEIGHT * len(terms) * (level - 1) + 1e-9:
            return stored.sparkSession.createDataFrame(best, found.schema)
        level = max(1, min(level - 1, math.ceil(least / (WEIGHT * len(terms)) - 1e-9) if least else level // 4))


#: Postings of each term that a first pass reads for a result, and the most uses that are counted apart.
SEEN, MOST_USES = 64, 1 << 10


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.orderBy(F.round("text_rank", 12).desc(), "id").limit(k)


def _enough(stored: DataFrame, terms: list[str], n: int) -> int:
    """The most uses that each term has in ``n`` texts; 1 where a term has fewer texts. Reads no positions; at most MOST_USES counts a term return."""
    of: dict[str, dict[int, int]] = {t: {} for t in terms}
    for r in stored.filter(F.col("term").isin(terms or [""])).groupBy("term", F.least("uses", F.lit(MOST_USES)).alias("uses")).count().collect():
        of[r["term"]][r["uses"] or 0] = r["count"]
    return max(1, min((_reached(by, n) for by in of.values()), default=1))


def _reached(by: dict[int, int], n: int) -> int:
    for uses in sorted(by, reverse=True):
        n -= by[uses]
        if n <= 0:
            return uses
    return 1


#: Bytes of texts that are analysed, cells of a table of uses, and places that are compared, each at a time.
TEXTS, CELLS, PLACES = 1 << 22, 1 << 21, 1 << 20


class BestTexts:
    """The k best texts so far of each of some sets of terms (numbers under ``size``): by rank (to twelve digits), then id.

    A table of uses by term and text says which texts hold a whole set, often enough to be among its best (see ``top_stored``);
    only those texts' places are looked at. What is held doesn't grow with the texts.
    """

    def __init__(self, sets: Sequence[Sequence[int]], size: int, k: int):
        self.size, self.k = size, k
        self.n = np.array([len(s) for s in sets], np.int64)
        self.terms = np.full((len(sets), max([1, *self.n])), size)  # no term: in every text
        for i, s in enumerate(sets):
            self.terms[i, : len(s)] = s
        self.ids = np.full((len(sets), k), np.iinfo(np.int64).max)
        self.keys = np.full((len(sets), k), -1)  # -1: no text here
        self.ranks = np.zeros((len(sets), k))
        self.need = np.ones(len(sets), np.uint8)

    def add(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, pos: np.ndarray) -> None:
        """Compare texts: of their terms' uses the row (in ``ids``), the term and the place."""
        key = row.astype(np.int64) * self.size + term
        order = np.lexsort((pos, key))
        key, pos = key[order], pos[order].astype(np.int64)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        uses, row, term = np.diff(first, append=len(key)), key[first] // self.size, key[first] % self.size
        per = max(1, CELLS // (self.size + 1))
        for lo in range(0, len(ids), per):
            a, b = np.searchsorted(row, [lo, lo + per])
            if a < b:
                self._compare(ids[lo : lo + per], row[a:b] - lo, term[a:b], first[a:b], uses[a:b], pos)

    def _compare(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, first: np.ndarray, uses: np.ndarray, pos: np.ndarray) -> None:
        held = np.zeros((self.size + 1, len(ids)), np.uint8)
        held[term, row] = np.minimum(uses, 255)
        held[self.size] = 255
        at = np.zeros(held.shape, np.int32)
        at[term, row] = np.arange(len(row))
        each = max(1, CELLS // len(ids))
        for lo in range(0, len(self.n), each):
            of = self.terms[lo : lo + each]
            least = held[of[:, 0]]
            for j in range(1, of.shape[1]):
                np.minimum(least, held[of[:, j]], out=least)
            which, text = np.nonzero(least >= self.need[lo : lo + each, None])
            which += lo
            places = np.zeros(len(which), np.int64)
            for j in range(of.shape[1]):
                places += np.where(j < self.n[which], uses[at[self.terms[which, j], text]], 0)
            upto = np.cumsum(places)
            a = 0
            while a < len(which):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PLACES, "right")))
                self._keep(which[a:b], ids[text[a:b]], self._ranks(which[a:b], text[a:b], at, first, uses, pos))
                a = b

    def _ranks(self, which: np.ndarray, text: np.ndarray, at: np.ndarray, first: np.ndarray, uses: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Cover density (see ``cover_density``) of each text for its set."""
        of, slots, places = [], [], []
        for j in range(int(self.n[which].max())):
            here = np.flatnonzero(j < self.n[which])
            i = at[self.terms[which[here], j], text[here]]
            of.append(np.repeat(here, uses[i]))
            places.append(pos[_ranges(first[i], uses[i])])
            slots.append(np.full(len(places[-1]), j))
        pair, place, slot = np.concatenate(of), np.concatenate(places), np.concatenate(slots)
        span = int(place.max()) + 1
        order = np.argsort(pair * span + place, kind="stable")
        pair, place, slot = pair[order], place[order], slot[order]
        n, base, start = self.n[which][pair], pair * span, np.full(len(pair), span)
        for j in range(len(of)):  # the latest place of each term so far says where a stretch that ends here starts
            last = np.maximum.accumulate(np.where(slot == j, base + place, base)) - base
            np.minimum(start, last, out=start, where=j < n)
        new = (start > 0) & ((np.diff(start, prepend=-1) != 0) | (np.diff(pair, prepend=-1) != 0))
        return np.bincount(pair[new], WEIGHT / (1.0 + np.maximum(place - start - (n - 1), 0)[new]), len(which))

    def _keep(self, which: np.ndarray, ids: np.ndarray, ranks: np.ndarray) -> None:
        some = np.unique(which)
        of = np.concatenate([np.repeat(some, self.k), which])
        keys = np.concatenate([self.keys[some].ravel(), np.floor(ranks * 1e12 + 0.5).astype(np.int64)])
        ids, ranks = np.concatenate([self.ids[some].ravel(), ids]), np.concatenate([self.ranks[some].ravel(), ranks])
        order = np.lexsort((ids, -keys, of))
        place = np.arange(len(of)) - np.searchsorted(of[order], of[order])
        best, place = order[place < self.k], place[place < self.k]
        for held, now in ((self.ids, ids), (self.keys, keys), (self.ranks, ranks)):
            held[of[best], place] = now[best]
        least = self.keys[some, -1] * 1e-12 - 1e-9
        self.need[some] = np.clip(np.ceil(least / (WEIGHT * self.n[some])), 1, 255)

    def batch(self) -> pa.RecordBatch:
        """set, id, text_rank and key (the rank to twelve digits, as a number) of all that is held."""
        here = self.keys >= 0
        found = [np.repeat(np.arange(len(self.n)), here.sum(1)), self.ids[here], self.ranks[here], self.keys[here]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["set", "id", "text_rank", "key"])


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ..., ``n`` of them, of each pair."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _uses_of(texts: Sequence[str], number: dict[str, int], a: Analyzer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, term (its ``number``) and pos (from 1) of all uses of some terms in texts: those of ``Analyzer.all_terms``.

    Words alone, most of all stretches without white space, are looked up together, others (and words to stem) once each.
    """
    split = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
    pieces, ends = split.values, split.offsets.to_numpy()
    core = pc.ascii_trim(pieces, string.punctuation)
    alone = pc.and_(pc.utf8_is_alpha(core), pc.invert(pc.match_substring(pieces, "://"))).to_numpy(zero_copy_only=False)
    found = np.full(len(pieces), -1)
    if not a.stemmed:
        words = {w: i for w, i in number.items() if not (a.stop_words and w in _STOPS)}
        at = pc.fill_null(pc.index_in(core, pa.array(list(words), pa.large_string())), len(words)).to_numpy(zero_copy_only=False)
        found = np.where(alone, np.append(np.array(list(words.values()), np.int64), -1)[at], -1)
    rest = np.flatnonzero(~alone | a.stemmed)
    coded = pieces.take(pa.array(rest)).dictionary_encode()
    size, wanted, place, term = [], [], [], []
    for piece in coded.dictionary.to_pylist():
        of = _piece_terms if len(piece) <= LONG else _piece_terms.__wrapped__
        terms = of(piece, a.stemmed, a.stop_words)
        here = [(i, number[w]) for i, w in enumerate(terms) if w in number]
        size.append(len(terms))
        wanted.append(len(here))
        place += [i for i, _ in here]
        term += [t for _, t in here]
    code, wanted = coded.indices.to_numpy(), np.array(wanted, np.int64)
    sizes = np.ones(len(pieces), np.int64)
    sizes[rest] = np.array(size, np.int64)[code]
    before = np.concatenate([[0], np.cumsum(sizes)])
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    before = before[:-1] - np.repeat(before[ends[:-1]], np.diff(ends))  # of the piece's own text
    words, n = np.flatnonzero(found >= 0), wanted[code]
    which, some = _ranges((np.cumsum(wanted) - wanted)[code], n), np.repeat(rest, n)
    terms = np.concatenate([found[words], np.array(term, np.int64)[which]])
    pos = np.concatenate([before[words], before[some] + np.array(place, np.int64)[which]]) + 1
    return row[np.concatenate([words, some])], terms, pos


def top_batched(found: DataFrame, queries: Sequence[tuple[int, Sequence[str]]], k: int, analyzer: Analyzer | None = None) -> DataFrame:
    """query_id, id, text_rank, text_place of the k best texts (ties by id) of each of a block of queries (id, terms: distinct ones).

    ``found`` are stored postings (term, id, positions), of which the queries' terms are dealt by text, each once for all
    queries; or texts (id, content), which are analysed where they are read. A task keeps the best of each set of terms.
    """
    a = analyzer or Analyzer()
    spark = found.sparkSession
    small_batches(spark)
    sets: dict[tuple, int] = {}
    of = [(i, sets.setdefault(tuple(sorted(set(terms))), len(sets))) for i, terms in queries if terms]
    number = {t: i for i, t in enumerate(sorted({t for s in sets for t in s}))}
    numbers, size = [[number[t] for t in s] for s in sets], len(number)

    def from_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestTexts(numbers, size, k)
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            ids, texts, lo = b.column(0).to_numpy(), b.column(1), 0
            upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            while size and lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + TEXTS, "right")))
                best.add(ids[lo:hi], *_uses_of(texts[lo:hi].to_pylist(), number, a))
                lo = hi
        yield best.batch()

    def from_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestTexts(numbers, size, k)
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def add(all_: bool) -> None:
            """Compare what is held; the last text may go on in the next batch."""
            ids, terms, n, places = (np.concatenate(x) for x in zip(*parts, strict=True))
            cut = len(ids) if all_ else int(np.searchsorted(ids, ids[-1]))
            upto = int(n[:cut].sum())
            texts, row = np.unique(ids[:cut], return_inverse=True)
            best.add(texts, np.repeat(row, n[:cut]), np.repeat(terms[:cut], n[:cut]), places[:upto])
            parts[:] = [(ids[cut:], terms[cut:], n[cut:], places[upto:])]

        for b in batches:
            if b.num_rows:
                lists = b.column(2)
                parts.append((b.column(0).to_numpy(), b.column(1).to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy()))
                held += len(parts[-1][3])
                if held >= HELD:
                    add(False)
                    held = len(parts[0][3])
        if parts:
            add(True)
        yield best.batch()

    if "positions" in found.columns:
        wanted = spark.createDataFrame(list(number.items()), "term string, number long")  # a block's
        rows = found.join(F.broadcast(wanted), "term").select("id", "number", "positions")
        made = rows.repartition("id").sortWithinPartitions("id").mapInArrow(from_postings, "set long, id long, text_rank double, key long")
    else:
        made = found.select("id", "content").mapInArrow(from_texts, "set long, id long, text_rank double, key long")
    by = Window.partitionBy("set").orderBy(F.desc("key"), "id")
    best = made.withColumn("text_place", F.row_number().over(by)).filter(F.col("text_place") <= k)
    asked = spark.createDataFrame(of, "query_id long, set long")  # a block
    return best.join(F.broadcast(asked), "set").select("query_id", "id", "text_rank", "text_place")


def ends(docs: DataFrame, id_col: str, text_col: str, analyzer: Analyzer | None = None) -> DataFrame:
    """id, first, last: a text's first and last term that is no stop word; no row for a text without one."""
    a = analyzer or Analyzer()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[w for w in a.all_terms(t or "") if w] for t in b.column(1).to_pylist()]
            at = [i for i, w in enumerate(found) if w]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([found[i][0] for i in at], pa.string()), pa.array([found[i][-1] for i in at], pa.string())], ["id", "first", "last"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, first string, last string")


def _covers(n: Column) -> Column:
    """Cover density (see ``cover_density``) inside the row, from the places of ``n`` terms in ``_held``.

    A text's places are merged in their order, and for each the latest place of every term so far says where a stretch that ends
    there starts. The first end of each start is a cover.
    """
    places = F.array_sort(F.flatten(F.transform("_held", lambda h: F.transform(h["positions"], lambda p: F.struct(p.alias("pos"), (h["place"] - 1).alias("place"))))))

    def step(state: Column, x: Column) -> Column:
        last = F.transform(state["last"], lambda old, i: F.when(i == x["place"], x["pos"]).otherwise(old))
        start = F.array_min(last)
        noise = F.greatest(x["pos"] - start - (n - F.lit(1)), F.lit(0))
        is_new = (start > 0) & (start != state["start"])
        return F.struct(last.alias("last"), start.alias("start"), (state["rank"] + F.when(is_new, F.lit(WEIGHT) / (F.lit(1.0) + noise)).otherwise(0.0)).alias("rank"))

    begin = F.struct(F.array_repeat(F.lit(0), n).alias("last"), F.lit(0).alias("start"), F.lit(0.0).alias("rank"))
    return F.aggregate(places, begin, step, lambda s: s["rank"])


def cover_density(found: DataFrame, terms: list[str]) -> DataFrame:
    """id, text_rank from the positions of all ``terms`` (each row's id has every term).

    A cover is a shortest stretch that holds every term; each adds WEIGHT over one plus the other words in it
    (Clarke, Cormack and Tudhope 1999). For every place the latest earlier one of each term gives where a stretch ending
    there starts; the first end of each start is a cover.
    """
    upto = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("term") == t, F.col("pos"))).over(upto) for t in terms]
    first = F.least(*last) if len(last) > 1 else last[0]
    whole = found.withColumn("_start", F.when(_all_set(last), first))
    covers = whole.filter("_start IS NOT NULL").groupBy("id", "_start").agg(F.min("pos").alias("_end"))
    noise = F.col("_end") - F.col("_start") - F.lit(len(terms) - 1)
    return covers.groupBy("id").agg(F.sum(F.lit(WEIGHT) / (F.lit(1.0) + F.greatest(noise, F.lit(0)))).alias("text_rank"))


def _all_set(columns: list[Column]) -> Column:
    out = columns[0].isNotNull()
    for c in columns[1:]:
        out = out & c.isNotNull()
    return out


def rank(docs: DataFrame, query: str, id_col: str, text_col: str, analyzer: Analyzer | None = None) -> DataFrame:
    """id, text_rank of the rows that match the query."""
    a = analyzer or Analyzer()
    return cover_density(positions(docs, query, id_col, text_col, a), a.query_terms(query) or [""])
