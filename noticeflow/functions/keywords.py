"""Many keywords in one pass over each text.

``text.any_keyword`` looks for each keyword on its own, so its cost is keywords times text. Here an Aho-Corasick automaton of all of
them is built once in each Python worker and run over Arrow batches: the cost of a text is its length and its hits, whatever
the number of keywords. Where the automaton's package is missing, or the keywords are FEW, the column expression stands in;
results are the same.

A text holds a keyword if it contains it as a string, as ``contains`` has it: case matters, an empty keyword is in every text.
A null text holds none, null keywords are left out, and no keywords are found nowhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from noticeflow.functions import text

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

FEW = 32
_built: dict[str, object] = {}  # automata of this worker, by digest of their keywords; one at a time


def _automaton(digest: str, words: list[str]):
    if digest not in _built:
        made = ahocorasick.Automaton()
        for i, w in enumerate(words):
            made.add_word(w, i)
        made.make_automaton()
        _built.clear()
        _built[digest] = made
    return _built[digest]


class Keywords:
    def __init__(self, words: Iterable[str | None], few: int = FEW):
        self.words = sorted({w for w in words if w is not None})
        self.few = few

    def _array(self) -> Column:
        return F.array(*map(F.lit, self.words)).cast("array<string>")

    def _shared(self):
        """Everything that a worker needs: the keywords are broadcast, not sent with each task."""
        words = [w for w in self.words if w]
        digest = hashlib.sha256("\0".join(words).encode()).hexdigest()
        return SparkSession.active().sparkContext.broadcast((digest, words))

    @property
    def scanned(self) -> bool:
        return ahocorasick is not None and len(self.words) > self.few and any(self.words)

    def any_in(self, c: Column) -> Column:
        """Whether a text holds any keyword; the first hit ends the scan."""
        if not self.scanned or "" in self.words:
            return text.any_keyword(c, F.array(F.lit("")) if "" in self.words else self._array())
        shared = self._shared()

        @F.pandas_udf("boolean")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            automaton = _automaton(*shared.value)
            for texts in batches:
                yield pd.Series([t is not None and next(automaton.iter(t), None) is not None for t in texts], dtype=bool)

        return run(c)

    def all_in(self, c: Column) -> Column:
        """The keywords that a text holds, in order, each once."""
        if not self.scanned:
            return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.filter(self._array(), lambda k: F.contains(c, k)))
        shared, always = self._shared(), [""] if "" in self.words else []

        @F.pandas_udf("array<string>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            digest, words = shared.value
            automaton = _automaton(digest, words)
            for texts in batches:
                yield pd.Series([[] if t is None else always + [words[i] for i in sorted({i for _, i in automaton.iter(t)})] for t in texts])

        return run(c)
