"""Mapping free-entered values to the entries of a reference list.

An automaton over the entries' names and aliases (all in one normal form)
finds embedded mentions; the longest of the non-overlapping ones wins (ties:
the smallest id).  Aliases are a table of the caller's, (alias, name) rows;
usual short forms are derived from the names.  A value without a mention
goes to token-set similarity: its tokens are first led to the list's own
vocabulary (edits of one or two letters by deletion neighbourhoods), then the
entry with the largest weighted overlap of token sets is taken if it reaches a
threshold.  What remains has no entry (-1).

The list must be small enough to send to every task (its size is checked);
values are streamed and never shuffled.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIST_ROWS, LIST_LETTERS = 200_000, 10_000_000  # largest reference list that is sent to every task: each letter takes some hundred bytes of neighbourhoods there

# Words that stand in many institutions' names, and the forms they are typed in; the default of ``forms``.
WORD_FORMS = {
    "univ": ("university", "univ", "uni", "universitat", "universite", "universidad", "universidade", "universita"),
    "technol": ("technology", "technol", "tech"),
    "inst": ("institute", "inst", "institut", "instituto"),
    "sci": ("science", "sci", "sciences"),
    "coll": ("college", "coll"),
    "acad": ("academy", "acad"),
    "polytech": ("polytechnic", "polytech"),
    "med": ("medical", "med"),
    "teachers": ("teachers", "teacher"),
}
COMMON = frozenset(("state", "law"))  # further words that don't tell institutions apart
STOP = frozenset(("of", "the", "de", "la", "and", "for", "du", "da", "do", "der", "fur"))


def words(text: str) -> list[str]:
    """Lower-case words without accents; single letters with dots joined (A.I. -> ai)."""
    t = unicodedata.normalize("NFKD", text).lower()
    t = "".join(c for c in t if not unicodedata.combining(c))
    t = re.sub(r"\b(\w)\.(?=\w\b)", r"\1", t)
    return re.findall(r"[a-z0-9]+", t)


def institution_tokens(text: str, form: dict[str, str] | None = None) -> list[str]:
    """Words in one form each (``form`` maps a typed word to it); names in square brackets before an affiliation are people, not institutions."""
    text = re.sub(r"^\s*\[[^\]]*\]", "", text)
    return [(form or {}).get(w, w) for w in words(text) if w not in STOP]


def keyword_tokens(text: str) -> list[str]:
    """Words without a plural s, so that singular and plural agree."""
    return [w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] != "s" else w for w in words(text) if w not in STOP]


def _deletes(w: str, n: int) -> set[str]:
    out, last = {w}, {w}
    for _ in range(n):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out |= last
    return out


def edits(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours counting one (optimal string alignment); most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


@dataclass
class Matcher:
    """Names and aliases of one reference list, ready to match values."""

    tokenise: callable
    threshold: float = 0.8
    whole: bool = False  # True: compare with all of the value's tokens, False: with those an entry needs
    forms: dict = field(default_factory=dict)  # word -> the forms it is typed in
    aliases: dict = field(default_factory=dict)  # tuple of tokens -> ref id, None if ambiguous
    names: dict = field(default_factory=dict)  # ref id -> tokens
    given: set = field(default_factory=set)  # aliases of the caller's table, which derived ones don't touch

    def add(self, ref_id: int, name: str, short=()) -> None:
        toks = tuple(self.tokenise(name))
        if not toks:
            return
        self.names[ref_id] = toks
        for a in {toks, *map(tuple, short)}:
            if a and a not in self.given:
                self.aliases[a] = ref_id if self.aliases.get(a, ref_id) == ref_id else None

    def give(self, entries: list[tuple[int, str]], aliases) -> None:
        """Aliases of the caller's: (alias, name) rows; the alias also stands with a plural s.  Names off the list are left out."""
        ids: dict = {}
        for i, name in entries:
            ids.setdefault(tuple(self.tokenise(name)), i)
        for alias, name in aliases:
            i = ids.get(tuple(self.tokenise(name)))
            for a in {tuple(self.tokenise(alias)), tuple(self.tokenise(alias + "s")), (alias.lower() + "s",)} if i is not None else ():
                if a:
                    self.aliases[a] = i if self.aliases.get(a, i) == i else None
                    self.given.add(a)

    def build(self) -> Matcher:
        import ahocorasick

        self.form = {w: k for k, ws in self.forms.items() for w in ws}
        self.auto = ahocorasick.Automaton()
        for a, i in self.aliases.items():
            if i is not None:
                s = f" {' '.join(a)} "
                self.auto.add_word(s, (len(s), i))
        self.ready = len(self.auto) > 0
        if self.ready:
            self.auto.make_automaton()
        df: dict[str, int] = {}
        for t in self.names.values():
            for w in set(t):
                df[w] = df.get(w, 0) + 1
        n = max(1, len(self.names))
        self.weight = {w: math.log(1 + n / c) for w, c in df.items()}
        self.vocab = set(df) | {w for a in self.aliases for w in a}
        self.full = set(df) | {f for k in set(df) for f in self.forms.get(k, ())}
        self.near: dict[str, list[str]] = {}
        for w in sorted(self.full):
            if len(w) >= 3:
                for x in _deletes(w, 1 if len(w) < 6 else 2):
                    self.near.setdefault(x, []).append(w)
        self.holders: dict[str, list[int]] = {}
        for i, t in self.names.items():
            for w in set(t):
                self.holders.setdefault(w, []).append(i)
        self.sets = {i: frozenset(t) for i, t in self.names.items()}
        self.mass = {i: sum(self.weight[w] for w in s) for i, s in self.sets.items()}
        self.known: dict[str, str] = {}
        return self

    def mentions(self, toks: list[str]) -> list[int]:
        """Ids of the mentions that don't overlap, longest first; of equally long ones the smallest id, then the first in the text, goes first."""
        if not self.ready or not toks:
            return []
        text = f" {' '.join(toks)} "
        found = sorted((-size, i, end - size + 1, end) for end, (size, i) in self.auto.iter(text))
        out, taken = [], []
        for _, i, start, end in found:
            # Neighbours share the blank between them.
            if all(end <= s or start >= e for s, e in taken):
                taken.append((start, end))
                out.append(i)
        return out

    def _mention(self, toks: list[str]) -> int | None:
        return next(iter(self.mentions(toks)), None)

    def _correct(self, w: str) -> str:
        """The vocabulary's word nearest to w, or w itself."""
        if w in self.vocab or len(w) < 2 or w.isdigit():
            return w
        got = self.known.get(w)
        if got is None:
            got, best = w, 3
            seen = set()
            for x in _deletes(w, 1 if len(w) < 6 else 2):
                for v in self.near.get(x, ()):
                    if v in seen:
                        continue
                    seen.add(v)
                    most = 1 if min(len(v), len(w)) < 6 else 2
                    d = edits(w, v, most)
                    if d <= most and (d < best or d == best and v < got):
                        got, best = v, d
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[w] = got
        return got

    def match(self, value: str) -> tuple[int, str, float]:
        """``ref id, how, score``; -1 where the value has no entry."""
        toks = self.tokenise(value)
        hit = self._mention(toks)
        if hit is not None:
            return hit, "mention", 1.0
        right = [self.form.get(c, c) for c in map(self._correct, toks)]
        hit = self._mention(right)
        if hit is not None:
            return hit, "corrected", 0.95
        have = set(right)
        best, score = -1, 0.0
        # An entry's rarest words decide; common ones can't reach the threshold alone.
        for w in have:
            for i in self.holders.get(w, ()) if self.weight.get(w, 0) * 4 >= self._least_mass else ():
                common = sum(self.weight[x] for x in self.sets[i] & have)
                base = self.mass[i] + (sum(self._typical for x in have - self.sets[i]) if self.whole else 0.0)
                s = common / base
                if s > score or (s == score and i < best):
                    best, score = i, s
        if score < self.threshold and self.whole:
            best, score = self._soft(right)
        return (best, "token set", score) if score >= self.threshold else (-1, "none", score)

    def _soft(self, toks: list[str]) -> tuple[int, float]:
        """Token sets compared with similarities of words; entries must share a word."""
        best, score = -1, 0.0
        for i in sorted({i for w in set(toks) for i in self.holders.get(w, ())}):
            ref = self.names[i]
            if len(ref) != len(toks):
                continue
            sim = [max(1 - edits(w, v, 3) / max(len(w), len(v)) for v in toks) for w in ref]
            s = sum(sim) / len(sim) if min(sim) >= 0.55 else 0.0
            if s > score:
                best, score = i, s
        return best, score

    @property
    def _least_mass(self) -> float:
        if not hasattr(self, "_lm"):
            self._lm = min(self.mass.values(), default=0.0)
            self._typical = sum(self.weight.values()) / max(1, len(self.weight))
        return self._lm


def institution_matcher(entries: list[tuple[int, str]], aliases=(), forms: dict = WORD_FORMS, common: frozenset = COMMON) -> Matcher:
    """Short forms: the distinctive word followed by the initials of the other words (X UT, X SU)."""
    form = {w: k for k, ws in forms.items() for w in ws}
    tokens = functools.partial(institution_tokens, form=form)
    m = Matcher(tokens, 0.9, forms=forms)
    m.give(entries, aliases)
    df: dict[str, int] = {}
    for _, name in entries:
        for w in set(tokens(name)):
            df[w] = df.get(w, 0) + 1
    for i, name in entries:
        t = tokens(name)
        rare = min(range(len(t)), key=lambda k: (t[k] in forms or t[k] in common, df[t[k]])) if t else 0
        rest = t[:rare] + t[rare + 1 :]
        short = [(t[rare], "".join(w[0] for w in rest))] if len(rest) >= 2 else []
        m.add(i, name, short)
    return m.build()


def keyword_matcher(entries: list[tuple[int, str]], aliases=()) -> Matcher:
    """Short forms: initials of three letters or more, with and without a plural s; inverted forms (detection of plagiarism)."""
    m = Matcher(keyword_tokens, 0.75, whole=True)
    m.give(entries, aliases)
    for i, name in entries:
        t = keyword_tokens(name)
        short = []
        if len(t) >= 2:
            ini = "".join(w[0] for w in t)
            if len(ini) >= 3:
                short += [tuple(keyword_tokens(ini)), tuple(keyword_tokens(ini + "s")), (ini + "s",)]
            short.append((t[-1], *t[:-1]))
        m.add(i, name, short)
    return m.build()


def map_values(values: DataFrame, entries: list[tuple[int, str]], matcher, value: str = "val", aliases=()) -> DataFrame:
    """``values`` with ``ref_id, how, score``.

    ``entries`` are (id, name) of the reference list, ``aliases`` (alias, name)
    of further names.  Both are checked in rows and letters before they are
    sent to every task.  Null and blank values
    get -1; equal values get equal results; ties go to the smallest id of
    equally similar entries; an empty list gives -1 throughout.  Extra columns
    are passed on; a column that clashes with a result column is replaced.
    """
    if len(entries) + len(aliases) > LIST_ROWS or sum(len(r[1]) for r in entries) > LIST_LETTERS:
        raise ValueError(f"at most {LIST_ROWS} names and aliases of {LIST_LETTERS} letters together can be sent to every task")
    values = values.drop(*[c for c in ("ref_id", "how", "score") if c in values.columns and c != value])
    out = "struct<ref_id:bigint,how:string,score:double>"

    @F.pandas_udf(out)
    def match(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = matcher(entries, aliases)
        known: dict = {}
        for s in parts:
            got = []
            for v in s:
                r = known.get(v)
                if r is None:
                    r = m.match(v) if isinstance(v, str) else (-1, "none", 0.0)
                    if len(known) > 200_000:
                        known.clear()
                    known[v] = r
                got.append(r)
            yield pd.DataFrame(got, columns=["ref_id", "how", "score"])

    return values.withColumn("_m", match(F.col(value))).select(
        *[F.col(c) for c in values.columns], F.col("_m.ref_id").alias("ref_id"), F.col("_m.how").alias("how"), F.col("_m.score").alias("score")
    )


def read_entries(ref: DataFrame, key: str, name: str) -> list[tuple[int, str]]:
    """The reference list on the driver; more than LIST_ROWS rows are refused."""
    rows = ref.select(key, name).filter(F.col(name).isNotNull()).limit(LIST_ROWS + 1).collect()
    if len(rows) > LIST_ROWS:
        raise ValueError("the reference list is too long to send to every task")
    return sorted((int(r[0]), r[1]) for r in rows)
