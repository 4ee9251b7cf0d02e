"""SentencePiece encoding and decoding by a streaming Viterbi pass."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.merges import Bounded, Merges
from tidemark.llm.shared import columns_of, map_rows, to_arrow

SPACE = "▁"
#: Texts that are given out in one batch.
ROWS = 256


def streamed(parts: Iterable[str], merges: Merges) -> Iterator[str]:
    """Pieces of an endless text, each as soon as it is certain; the text comes in parts of any size.

    ``lasts`` holds, for every boundary since the last certain one, the piece that ends the best
    path to it. Only the boundaries of the last ``merges.longest`` characters survive, since no piece
    reaches further back. Whenever that window has moved on by its own length, the paths of all
    its boundaries are followed back to the one where they meet; the pieces before it are final,
    are given out, and are forgotten.
    """
    longest, known, fits, reach = merges.longest, merges.pieces.get, merges.fitting, merges.reach.get
    pairs = merges.pairs
    text, lasts, checked = "", [""], 0
    for part in parts:
        text += part
        end, size = len(lasts), len(text)
        while end <= size:
            # No piece that ends in these three characters is longer than ``reach``.
            low = end - reach(text[end - 3 : end], 2) if end > 2 else 0
            for start in range(low if low > 0 else 0, end - 2):
                piece = known(text[start:end])
                if piece is not None and (not lasts[start] or fits[lasts[start], piece]):
                    break
            else:
                piece = pairs.get(text[end - 2 : end]) if end > 1 else None
                if piece is None or lasts[end - 2] and not fits[lasts[end - 2], piece]:
                    piece = text[end - 1 : end]
            lasts.append(piece)
            if end - checked >= longest:
                meeting = met(lasts, longest)
                if meeting:
                    yield from path(lasts, meeting)
                    text, lasts = text[meeting:], lasts[meeting:]
                    end, size = end - meeting, size - meeting
                checked = end
            end += 1
    yield from path(lasts, len(text))


def met(lasts: list[str], longest: int) -> int:
    """The last boundary that the paths to all surviving boundaries go through."""
    alive = set(range(max(0, len(lasts) - longest), len(lasts)))
    while len(alive) > 1:
        last = max(alive)
        alive.remove(last)
        alive.add(last - len(lasts[last]))
    return alive.pop()


def path(lasts: list[str], end: int) -> list[str]:
    pieces = []
    while end > 0:
        pieces.append(lasts[end])
        end -= len(lasts[end])
    return pieces[::-1]


def unit_pattern(pieces: Iterable[str]) -> str:
    """A pattern that cuts a text where no piece of the vocabulary reaches across, so that each
    part can be encoded, and remembered, alone: before white space, at line ends, and between a
    letter and the marks that no piece has after a letter."""
    before: dict[str, set[str]] = {}
    for piece in pieces:
        for left, char in zip(piece, piece[1:]):
            before.setdefault(char, set()).add(left)
    if before.get(SPACE, set()) - {SPACE}:
        return r"(?s).+"
    lines = "" if any("\n" in p and len(p) > 1 for p in pieces) else "\n"
    plain = f"{SPACE}+[^{SPACE}{lines}]*|[^{SPACE}{lines}]+" + ("|\n" if lines else "")
    marks = [m for m in ",.;:!?" if not any(c.isalpha() for c in before.get(m, ()))]
    odd = "".join(sorted(c for m in marks for c in before.get(m, ()) if c.isalnum()))
    return f"{SPACE}*[^\\W\\d_{re.escape(odd)}]+(?=[{''.join(marks)}])|{plain}" if marks else plain


class Codec:
    """Encoder and decoder of one vocabulary file, which is read once per worker."""

    def __init__(self, model_path: str, memo: int = 500_000) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        every = range(model.get_piece_size())
        names = [model.id_to_piece(i) for i in every]
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.bytes = {int(names[i][3:-1], 16): i for i in every if model.is_byte(i)}
        self.unknown = model.unk_id()
        born = {names[i]: int(-model.get_score(i)) for i in plain if len(names[i]) > 1}
        self.merges = Merges(born, lambda left, right: born.get(left + right))
        # A byte stands for itself: below 128 as its character, else as an escaped surrogate.
        shown = {i: chr(b) if b < 128 else chr(0xDC00 + b) for b, i in self.bytes.items()}
        self.shown = [
            shown.get(i, "" if model.is_control(i) else " ⁇ " if model.is_unknown(i) else names[i])
            for i in every
        ]
        self.units = re.compile(unit_pattern(self.ids)).findall
        self.memo = Bounded(self.unit_ids, memo)

    def unit_ids(self, unit: str) -> bytes:
        """Ids of a unit, four bytes each, which keeps the memo small."""
        out = array("i")
        for piece in streamed((unit,), self.merges):
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode())
            else:
                out.append(self.unknown)
        return out.tobytes()

    def packed(self, text: str) -> bytes:
        if not text:
            return b""
        units = self.units((SPACE + text).replace(" ", SPACE))
        return b"".join(map(self.memo.__getitem__, units))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        joined = "".join(map(self.shown.__getitem__, ids)).replace(SPACE, " ")
        return joined.encode("utf-8", "surrogateescape").decode("utf-8", "replace")[joined[:1] == " " :]


@lru_cache(maxsize=2)
def codec(model_path: str) -> Codec:
    return Codec(model_path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``ids`` (array) and ``round_trip``: whether the ids decode to the text again.

    Whole texts, without begin or end marks. A null text counts as empty and has no ids. The
    vocabulary's mark for a space is itself read as a space, which ``round_trip`` allows for.
    Repeated rows each give a row; other columns are ignored.
    """

    kind = dict(docs.dtypes)[id_col]
    texts = columns_of(docs, id=id_col, text=text_col)
    schema = docs.sparkSession.createDataFrame([], f"id {kind}, ids array<int>, round_trip boolean").schema
    arrow = to_arrow(schema)

    def run(batches):
        coder = codec(model_path)
        for batch in batches:
            keys, column = batch.columns
            for low in range(0, batch.num_rows, ROWS):
                texts = [text or "" for text in column.slice(low, ROWS).to_pylist()]
                coded = [array("i", coder.packed(text)) for text in texts]
                same = [coder.decode(ids) == text.replace(SPACE, " ") for ids, text in zip(coded, texts)]
                ends = pa.array([0, *accumulate(map(len, coded))], pa.int32())
                values = pa.Array.from_buffers(pa.int32(), ends[-1].as_py(), [None, pa.py_buffer(b"".join(coded))])
                lists = pa.ListArray.from_arrays(ends, values)
                yield pa.RecordBatch.from_arrays([keys.slice(low, ROWS), lists.cast(arrow.field(1).type), pa.array(same)], schema=arrow)

    return texts.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id`` and ``text`` of rows of ids; null ids give an empty text."""

    def rows(tuples):
        coder = codec(model_path)
        for key, ids in tuples:
            yield key, coder.decode(ids or [])

    kind = dict(encoded.dtypes)[id_col]
    return map_rows(columns_of(encoded, id=id_col, ids=ids_col), rows, f"id {kind}, text string")
