"""Token counts of every prefix of a text, without encoding any prefix again."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import DataFrame

from tidemark.llm.merges import Bounded, Merges
from tidemark.llm.shared import columns_of, map_rows


def printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary file stands for: printable ones
    for themselves, the others in order from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Counter:
    """Token counts by one byte-level vocabulary file, which is read once per worker."""

    def __init__(self, vocabulary_path: str, pattern: str, memo: int = 600_000) -> None:
        import regex

        with open(vocabulary_path, encoding="utf-8") as file:
            stored = json.load(file)
        raw = printable_bytes()
        as_bytes = lambda piece: bytes(raw[c] for c in piece)
        pairs = [tuple(map(as_bytes, m.split(" ") if isinstance(m, str) else m)) for m in stored["model"]["merges"]]
        ranks = {pair: i for i, pair in enumerate(pairs)}
        born, parts = {}, {}
        for i, (left, right) in enumerate(pairs):
            if left + right not in born:
                born[left + right], parts[left + right] = i, (left, right)
        self.merges = Merges(born, lambda left, right: ranks.get((left, right)), parts.get)
        self.specials = [t["content"] for t in stored.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.pattern = regex.compile(pattern)
        self.memo = Bounded(lambda word: self.prefix_counts(word.encode())[-1], memo)

    def prefix_counts(self, word: bytes) -> list[int]:
        """Counts of all prefixes of a word, the empty one included.

        The encoding of a prefix is that of a shorter prefix and one more piece, so each count
        takes one look at the pieces that may end there.
        """
        lasts, counts = [b""], [0]
        for end in range(1, len(word) + 1):
            piece = self.merges.last_piece(word, end, lasts)
            lasts.append(piece)
            counts.append(counts[end - len(piece)] + 1)
        return counts

    def parts(self, text: str) -> list[str]:
        """The stretches of a text between special tokens."""
        return self.special.split(text) if self.special else [text]

    def count(self, text: str) -> int:
        parts = self.parts(text)
        return len(parts) - 1 + sum(sum(map(self.memo.__getitem__, self.pattern.findall(p))) for p in parts)

    def counts(self, text: str) -> list[int]:
        """The count of every prefix of ``text`` by code points, each as if it stood alone.

        Inside a word that splits the same way when it is cut, counts are those of the word's
        own prefixes. White space that a cut leaves at the end joins into one word, and a cut
        contraction or special token is split anew, as the text from the word before it on.
        """
        counts = [0]
        at = 0
        for i, part in enumerate(self.parts(text)):
            if i:
                at = self._cut_special(text, at, counts)
            self._within(part, counts)
            at += len(part)
        return counts

    def _within(self, part: str, counts: list[int]) -> None:
        before = counts[-1]
        space, space_before = None, 0  # where the present run of white space starts
        for match in self.pattern.finditer(part):
            word = match.group()
            inside = self._ends(word)
            if word[0].isspace() and space is None:
                space, space_before = match.start(), before
            for cut in range(1, len(word) + 1):
                tail = part[match.start() : match.start() + cut]
                end = match.start() + cut
                if space is not None and tail.isspace() and space < match.start():
                    counts.append(space_before + self.memo[part[space:end]])
                elif word[0] == "'" and 1 < cut < len(word):
                    counts.append(before + self.count_words(tail))
                else:
                    counts.append(before + inside[cut])
            before += inside[-1]
            if not word.isspace():
                space = None

    def _ends(self, word: str) -> list[int]:
        """Counts at the ends of the characters of a word."""
        counts, place, out = self.prefix_counts(word.encode()), 0, [0]
        for char in word:
            place += len(char.encode())
            out.append(counts[place])
        return out

    def count_words(self, text: str) -> int:
        return sum(map(self.memo.__getitem__, self.pattern.findall(text)))

    def _cut_special(self, text: str, at: int, counts: list[int]) -> int:
        token = self.special.match(text, at).group()
        # The words before a cut token go back to the last one that a cut cannot change.
        since = max(0, at - 1)
        while since and not (text[since - 1].isalnum() and text[since].isspace()):
            since -= 1
        for cut in range(1, len(token)):
            counts.append(counts[since] + self.count(text[since : at + cut]))
        counts.append(counts[at] + 1)
        return at + len(token)

    def prefix_within(self, text: str, budget: int) -> int:
        """Code points of the longest prefix that starts ``text`` and never exceeds ``budget``."""
        for place, count in enumerate(self.counts(text)):
            if count > budget:
                return place - 1
        return len(text)


@lru_cache(maxsize=2)
def counter(vocabulary_path: str, pattern: str) -> Counter:
    return Counter(vocabulary_path, pattern)


def count_tokens(
    docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``n_bytes`` and ``n_tokens`` of whole texts.

    A null text counts as empty: no bytes, no tokens. Special tokens inside a text count as one.
    Repeated rows each give a row; other columns are ignored.
    """

    def rows(tuples):
        tool = counter(vocabulary_path, pattern)
        for key, text in tuples:
            text = text or ""
            yield key, len(text.encode()), tool.count(text)

    kind = dict(docs.dtypes)[id_col]
    return map_rows(columns_of(docs, id=id_col, text=text_col), rows, f"id {kind}, n_bytes long, n_tokens long")


def count_prefixes(
    docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id`` and ``counts``: the tokens of every prefix by code points, the empty one first.

    Whatever a reader asks of a text, its length within a budget or the cost of cutting it at a
    place, is a look into this array.
    """

    def rows(tuples):
        tool = counter(vocabulary_path, pattern)
        for key, text in tuples:
            yield key, tool.counts(text or "")

    kind = dict(docs.dtypes)[id_col]
    return map_rows(columns_of(docs, id=id_col, text=text_col), rows, f"id {kind}, counts array<int>")
