"""Which pieces of a byte-pair vocabulary may stand side by side.

A sequence of pieces is the byte-pair encoding of its text exactly if no merge could have
crossed any of its joints. A joint sees, on its left, the last parts of the left piece as that
piece grew, and, on its right, the first parts of the right piece; each part lives from the
merge that made it to the merge that used it up. Two parts that live at the same time and have a
merge that comes before either is used up would have merged across the joint. Of merges with
equal rank the left one comes first.
"""

from __future__ import annotations

from collections.abc import Callable

NEVER = 1 << 60


class Bounded(dict):
    """A memo of at most ``most`` entries: a missing key is computed. When half of them are used
    the memo starts anew, and takes over what is asked for again from the half before."""

    def __init__(self, compute: Callable, most: int, longest: int = 64) -> None:
        super().__init__()
        self.compute, self.half, self.longest, self.older = compute, most // 2, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Merges:
    """``born``: merged piece to rank; ``rank(left, right)``: rank of a merge or None;
    ``split(piece)``: the two parts of a merged piece, or None where it has no valid ones."""

    def __init__(self, born: dict, rank: Callable, split: Callable | None = None) -> None:
        self.born, self.rank = born, rank
        self.split = split or Bounded(self._split, 1 << 20, NEVER).__getitem__
        self.longest = max(map(len, born), default=1)
        self._lasts = Bounded(lambda p: self._lives(p, 1), 1 << 18, NEVER)
        self._firsts = Bounded(lambda p: self._lives(p, 0), 1 << 18, NEVER)
        #: Whether the second of a pair of pieces may follow the first.
        self.fitting = Bounded(lambda pair: not self.crossed(*pair), 1 << 19, NEVER)
        #: Usable pieces, each by itself: memos hold these objects, not slices of texts.
        self.pieces = {piece: piece for piece in born if self.known(piece)}
        #: The pieces of two units, and the length of the longest piece that ends in these three.
        self.pairs = {piece: piece for piece in self.pieces if len(piece) == 2}
        self.reach: dict = {}
        for piece in self.pieces:
            if len(piece) > 2:
                self.reach[piece[-3:]] = max(len(piece), self.reach.get(piece[-3:], 0))

    def _lives(self, piece, side: int) -> list[tuple]:
        """The parts at one end of a piece, from the whole piece inward: (part, born, used up)."""
        lives, used = [], NEVER
        while True:
            parts = self.split(piece) if len(piece) > 1 and piece in self.born else None
            since = self.born[piece] if parts else -1
            lives.append((piece, since, used))
            if not parts:
                return lives
            piece, used = parts[side], since

    def crossed(self, left, right, before: int = NEVER) -> bool:
        """Whether a merge crosses the joint, or, with ``before``, does so before the two wholes
        merge at that rank."""
        for a, a_born, a_used in self._lasts[left]:
            for b, b_born, b_used in self._firsts[right]:
                if a_born > b_used or b_born >= a_used:
                    continue
                if before != NEVER and a_used == NEVER and b_used == NEVER:
                    continue
                rank = self.rank(a, b)
                if rank is not None and rank < min(a_used, before) and rank <= b_used:
                    return True
        return False

    def _split(self, piece):
        born = self.born[piece]
        for at in range(len(piece) - 1, 0, -1):
            left, right = piece[:at], piece[at:]
            parts_known = all(len(p) == 1 or self.known(p) and self.born[p] <= born for p in (left, right))
            if parts_known and not self.crossed(left, right, born):
                return left, right
        return None

    def known(self, piece) -> bool:
        """Whether the encoding of the piece's own text is the piece."""
        return piece in self.born and self.split(piece) is not None

    def last_piece(self, text, end: int, lasts: list):
        """The one piece that ends the encoding of ``text[:end]``; ``lasts[i]`` is that of
        ``text[:i]``. A single unit that is in no piece stands alone."""
        fits, pieces, longest = self.fitting, self.pieces, self.longest
        for start in range(end - longest if end > longest else 0, end - 1):
            piece = pieces.get(text[start:end])
            if piece is not None and (not start or fits[lasts[start], piece]):
                return piece
        return text[end - 1 : end]
