"""Lexical analysis with a dictionary: compatibility and case folding, segmentation of unspaced text, user words, stopwords.

The native token rule of ``functions.text`` needs no dictionary and stays inside the JVM; it makes every Han character a term. With
a dictionary of words and their frequencies, text is segmented instead: each run of Han characters, Latin letters and digits is a
lattice of the dictionary's words, and the path with the highest product of relative frequencies is taken (of equal paths the one whose
first words are longer). Characters in no word stand alone; Latin letters and digits that stand alone next to each other are one term. The dictionary is an argument
of known size and goes to the workers once; text is analysed in Arrow batches."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that may stand in one word.
_RUN = re.compile(r"[一-鿕a-zA-Z0-9+#&._%\-]+|\s+|.", re.S)
_LATIN = re.compile(r"[a-zA-Z0-9]")


def normalize(text: str) -> str:
    """Compatibility forms and case folded."""
    return unicodedata.normalize("NFKC", text).casefold()


class Analyzer:
    """Text to terms."""

    def __init__(self, words: Mapping[str, int] | None = None, user_words: Iterable[str] = (), stopwords: Iterable[str] = ()) -> None:
        self.counts = {normalize(w): int(n) for w, n in (words or {}).items() if w and n > 0}
        self.total = max(1, sum(self.counts.values()))
        self._index()
        self.stopwords = frozenset(w for x in stopwords if (w := normalize(x).strip()))
        for word in user_words:
            self.add(word)

    def _index(self) -> None:
        self.starts: set[str] = {w[:i] for w in self.counts for i in range(1, len(w) + 1)}

    def add(self, word: str) -> None:
        """A user word gets the least frequency with which it beats its own segmentation."""
        w = normalize(word).strip()
        if not w:
            raise ValueError("user words must not be blank")
        share = math.prod(self.counts.get(p, 1) / self.total for p in self.segmented(w))
        n = max(int(share * self.total) + 1, self.counts.get(w, 1))
        self.total += n - self.counts.get(w, 0)
        self.counts[w] = n
        self.starts.update(w[:i] for i in range(1, len(w) + 1))

    def _path(self, run: str) -> list[str]:
        n = len(run)
        best: list[tuple[float, int]] = [(0.0, n)] * (n + 1)
        log_total = math.log(self.total)
        for i in range(n - 1, -1, -1):
            options = [(math.log(self.counts.get(run[i], 1)) - log_total + best[i + 1][0], i + 1)]
            j = i + 1
            while j <= n and run[i:j] in self.starts:
                if j > i + 1 and (c := self.counts.get(run[i:j])):
                    options.append((math.log(c) - log_total + best[j][0], j))
                j += 1
            best[i] = max(options)
        out, at, latin = [], 0, ""
        while at < n:
            end = best[at][1]
            word = run[at:end]
            if len(word) == 1 and _LATIN.match(word):
                latin += word
            else:
                out += [latin, word] if latin else [word]
                latin = ""
            at = end
        return [*out, latin] if latin else out

    def segmented(self, text: str) -> list[str]:
        """The parts of a normalized text, marks and spaces included."""
        out: list[str] = []
        for run in _RUN.findall(text):
            out += self._path(run) if len(run) > 1 and not run.isspace() else [run]
        return out

    def terms(self, text: str | None) -> list[str]:
        """Searchable terms in order, repeats kept; dotted decimals are one term. Null gives none."""
        parts, out, i = self.segmented(normalize(text or "")), [], 0
        while i < len(parts):
            term = parts[i]
            if term.isdecimal():
                while i + 2 < len(parts) and parts[i + 1] == "." and parts[i + 2].isdecimal():
                    term, i = f"{term}.{parts[i + 2]}", i + 2
            i += 1
            term = term.strip()
            if any(c.isalnum() for c in term) and term not in self.stopwords:
                out.append(term)
        return out

    def column(self, col: Column) -> Column:
        """The terms of a text column as an array."""

        @F.pandas_udf("array<string>")
        def analysed(s: pd.Series) -> pd.Series:
            return s.map(self.terms)

        return analysed(col)
