"""Periodic runs of words, by seeds on diagonals that are extended."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

from pyspark.sql import DataFrame

from tidemark.llm.shared import columns_of, map_rows

#: A run has at least this many words and this many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4


def word_codes(words: list):
    """A number for each word, equal for equal words."""
    import numpy as np

    number = defaultdict(count().__next__)
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def paired(left, right):
    """A number for each pair (left, right), equal for equal pairs."""
    import numpy as np

    pairs = left * (int(right.max()) + 1) + right
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


def seeds(codes) -> Iterator[tuple]:
    """Per class of lags: length of the k-grams, and the places and lags of neighbouring
    occurrences of a k-gram.

    Lags come in classes 1, 2-3, 4-7 and so on. A run of period q has words q apart equal over at
    least max(5, 3q) places (``LEAST_WORDS`` and ``LEAST_PERIODS``), so k-grams of 5 words for lag
    1, and of three times the least lag of a class for the others, are the longest that every run
    of the class must hold twice. They are longer than any lag of the class, so within a run a k-gram
    recurs after exactly one period, never before: the next occurrence is the only one to look at.
    """
    import numpy as np

    n = len(codes)
    names, size = codes, 1
    least = 1
    while n >= max(LEAST_WORDS, LEAST_PERIODS * least):
        k = 5 if least == 1 else 3 * least
        target = 4 if least == 1 else 2 * least
        while size < target:
            names = paired(names[:-size], names[size:])
            size *= 2
        grams = paired(names[: n - k + 1], names[k - size : n - size + 1])
        order = np.argsort(grams, kind="stable")
        again = grams[order[1:]] == grams[order[:-1]]
        if not again.any():
            # Longer k-grams do not recur either.
            return
        place, lag = order[:-1][again], order[1:][again] - order[:-1][again]
        fit = (lag >= least) & (lag < 2 * least)
        yield k, place[fit], lag[fit]
        least *= 2


def stretch(codes, place: int, lag: int, floor: int) -> tuple[int, int]:
    """The widest range of places around ``place`` whose words recur ``lag`` later, not below
    ``floor``; looked at in blocks that grow."""
    import numpy as np

    end, step = place, 16
    while end < len(codes) - lag:
        part = codes[end : end + step]
        same = part[: len(codes) - lag - end] == codes[end + lag : end + lag + step]
        if not same.all():
            end += int(np.argmin(same))
            break
        end += len(same)
        step *= 2
    start, step = place, 16
    while start > floor:
        low = max(floor, start - step)
        same = codes[low:start] == codes[low + lag : start + lag]
        if not same.all():
            start -= int(np.argmin(same[::-1]))
            break
        start = low
        step *= 2
    return start, end


def runs_of(codes) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period.

    Seeds of a lag are taken from left to right; one below the furthest place that a stretch of
    its lag has covered is part of that stretch and is not extended again.
    """
    import numpy as np

    n, found = len(codes), []
    if n < LEAST_WORDS:
        return found
    # Without a 5-gram that recurs there is no run; most texts end here.
    mixed = np.zeros(n - 4, np.uint64)
    for i in range(5):
        mixed = (mixed ^ codes[i : n - 4 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return found
    covered: dict[int, int] = {}
    for _, places, lags in seeds(codes):
        order = np.lexsort((places, lags))
        places, lags = places[order], lags[order]
        # Of seeds side by side only the first is extended.
        first = np.ones(len(places), bool)
        first[1:] = (lags[1:] != lags[:-1]) | (places[1:] != places[:-1] + 1)
        for place, lag in zip(places[first].tolist(), lags[first].tolist()):
            floor = covered.get(lag, 0)
            if place < floor:
                continue
            start, end = stretch(codes, place, lag, floor)
            covered[lag] = end
            length = end - start + lag
            if length >= max(LEAST_WORDS, LEAST_PERIODS * lag):
                found.append((start, length, lag))
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    import numpy as np

    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and
    ``collapsed``, the words that stay, joined by a space.

    Words are cut at white space. A run is a stretch of words with smallest period q and at least
    max(6, 4q) words that no neighbouring word extends; runs of different periods may overlap.
    Whole texts; a null or empty text, or one without words, has no runs and collapses to nothing.
    Every row is looked at alone, so repeated rows and ids give equal rows; ids of any type and null
    stay as they are. Other columns are ignored; an empty table gives none. A text is held by one
    task, in numbers of eight bytes a word.
    """

    def rows(tuples):
        for key, text in tuples:
            words = (text or "").encode().split()
            runs = runs_of(word_codes(words))
            kept = b" ".join(collapsed(words, runs)).decode()
            yield key, len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], kept

    kind = dict(docs.dtypes)[id_col]
    return map_rows(
        columns_of(docs, id=id_col, text=text_col), rows,
        f"id {kind}, n_words long, runs array<struct<start long, length long, period long>>, collapsed string",
    )
