"""Max-plus scan over a text's segmentation lattice, chunk by chunk.

A cut between chunks has as states all pieces that reach it: (a, b) with a < cut <= b. A chunk's transfer matrix holds,
for each state at its start and each at its end, the best weight of the pieces that begin inside the chunk; matrices
combine by max-plus product, which is associative, and once the best state at each cut is known every chunk finds its
own pieces alone.

Weights come from the model. For a unigram model a piece weighs its score. For a byte-pair model, whose segmentation
is the one in which every two neighbours are what merging their own text gives, a pair of neighbours weighs 0 if that
holds and minus infinity if not; the one path of finite weight is the encoding. No piece spans the place where a space
follows another character, so chunks that hold such a place have a matrix of rank one and what lies between two of
them is encoded as it is.
"""

from __future__ import annotations

import numpy as np

SPACE = "▁"
NEVER = float("-inf")
#: Kept answers about pairs of pieces; beyond that the store is emptied.
PAIRS = 200_000


class Vocabulary:
    """Pieces, scores and both ways of weighing them, on top of a loaded SentencePiece model."""

    def __init__(self, model: bytes, kind: str = "bpe"):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.kind = kind
        n = self.library.vocab_size()
        special = lambda i: self.library.is_control(i) or self.library.is_byte(i) or self.library.is_unknown(i) or self.library.is_unused(i)
        self.ids = {self.library.id_to_piece(i): i for i in range(n) if not special(i)}
        self.scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece spans a space")
        self.unknown_score = min(self.scores.values()) - 10
        self._whole: dict[str, bool] = {}
        self._pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: the best score first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def usable(self, piece: str) -> bool:
        if len(piece) == 1:
            return True
        if piece not in self.ids:
            return False
        if self.kind != "bpe":
            return True
        if piece not in self._whole:
            self._whole[piece] = self.merged(piece) == [piece]
        return self._whole[piece]

    def weight(self, before: str | None, piece: str) -> float:
        if self.kind != "bpe":
            return self.scores.get(piece, self.unknown_score)
        if before is None:
            return 0.0
        key = (before, piece)
        if key not in self._pairs:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            self._pairs[key] = self.merged(before + piece) == [before, piece]
        return 0.0 if self._pairs[key] else NEVER

    def to_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out.extend(self.bytes[b] for b in p.encode("utf-8"))
        return out

    def between(self, text: str) -> list[int]:
        """Ids of escaped text that starts with a space and ends before one."""
        return self.library.encode(text[1:].replace(SPACE, " ")) if self.kind == "bpe" else self.to_ids(best_path(self, text))


def escaped(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def _pieces_at(v: Vocabulary, s: str, a: int) -> list[int]:
    """Ends of the pieces that start at a."""
    return [b for b in range(a + 1, min(len(s), a + v.longest) + 1) if v.usable(s[a:b])]


def states(v: Vocabulary, s: str, cut: int) -> list[tuple[int, int]]:
    """Pieces that start before the cut and reach it."""
    return [(a, b) for a in range(max(0, cut - v.longest), cut) for b in _pieces_at(v, s, a) if b >= cut]


def _is_gate(s: str, i: int) -> bool:
    return s[i] == SPACE and (i == 0 or s[i - 1] != SPACE)


def _spread(v: Vocabulary, s: str, sources: list[tuple[int, int] | None], start: int, end: int) -> dict:
    """Best weight and predecessor for each reached piece and each source. A source is a piece, or None at `start`."""
    reached: dict = {}  # piece -> {source: (weight, piece before)}
    ending: dict[int, list] = {}
    for i, u in enumerate(sources):
        key = u if u is not None else (start, start)
        reached.setdefault(key, {})[i] = (0.0, None)
    for u in list(reached):
        ending.setdefault(u[1], []).append(u)
    for at in range(start, end):
        for u in ending.get(at, ()):
            before = s[u[0] : u[1]] or None
            for b in _pieces_at(v, s, at):
                w = v.weight(before, s[at:b])
                if w == NEVER:
                    continue
                piece = (at, b)
                if piece not in reached:
                    reached[piece] = {}
                    ending.setdefault(b, []).append(piece)
                mine = reached[piece]
                for i, (score, _) in reached[u].items():
                    if i not in mine or score + w > mine[i][0]:
                        mine[i] = (score + w, u)
    return reached


def _trail(reached: dict, piece: tuple[int, int], source: int, s: str, first: int) -> list[str]:
    """Pieces on the way to `piece` that start at or after `first`."""
    out = []
    while piece is not None and piece[0] >= first and piece[0] < piece[1]:
        before = reached[piece][source][1]
        if before is None:
            break
        out.append(s[piece[0] : piece[1]])
        piece = before
    return out[::-1]


def best_path(v: Vocabulary, s: str) -> list[str]:
    """The pieces of the whole text, serially."""
    if not s:
        return []
    reached = _spread(v, s, [None], 0, len(s))
    last = max((p for p in reached if p[1] == len(s) and p[0] < p[1]), key=lambda p: (reached[p][0][0], p))
    return _trail(reached, last, 0, s, 0)


class Chunk:
    """s[first:last] seen with what lies around it; places are those of s."""

    def __init__(self, v: Vocabulary, s: str, first: int, last: int, opens: bool, closes: bool):
        """opens, closes: whether s starts or ends with the text itself."""
        self.v, self.s, self.first, self.last, self.closes = v, s, first, last, closes
        self.entries: list = [None] if opens and first == 0 else states(v, s, first)
        ends = states(v, s, last)
        self.exits = [p for p in ends if p[1] == last] if closes and last == len(s) else ends
        gates = [i for i in range(first, last) if _is_gate(s, i)] if first < last else []
        self.gate, self.lastgate = (gates[0], gates[-1]) if gates else (None, None)

    def _parts(self) -> tuple[dict | None, dict]:
        if self.gate is None:
            return None, _spread(self.v, self.s, self.entries, self.first, self.last)
        left = _spread(self.v, self.s, self.entries, self.first, self.gate)
        return left, _spread(self.v, self.s, [None], self.lastgate, self.last)

    def _reach(self, left: dict, i: int) -> tuple[float, tuple[int, int] | None]:
        """Best weight from entry i to the first gate, and the piece that ends there."""
        found = [(r[i][0], u) for u, r in left.items() if u[1] == self.gate and i in r]
        return max(found, default=(NEVER, None), key=lambda x: (x[0], x[1]))

    def matrix(self) -> np.ndarray:
        left, right = self._parts()
        m = np.full((len(self.entries), len(self.exits)), NEVER)
        for x, piece in enumerate(self.exits):
            for i in range(len(self.entries)):
                if left is None:
                    got = right.get(piece, {}).get(i, (NEVER,))[0]
                else:
                    got = self._reach(left, i)[0] + right.get(piece, {}).get(0, (NEVER,))[0] if piece[0] >= self.lastgate else NEVER
                m[i, x] = got
        if left is not None and self.v.kind != "bpe" and self.lastgate > self.gate:
            m += sum(self.v.scores.get(p, self.v.unknown_score) for p in best_path(self.v, self.s[self.gate : self.lastgate]))
        return m

    def ids(self, entry: int, leave: int) -> list[int]:
        """Ids of the pieces that begin in the chunk, on the best way from one state to another."""
        left, right = self._parts()
        piece = self.exits[leave]
        if left is None:
            return self.v.to_ids(_trail(right, piece, entry, self.s, self.first))
        out = self.v.to_ids(_trail(left, self._reach(left, entry)[1], entry, self.s, self.first))
        if self.lastgate > self.gate:
            out += self.v.between(self.s[self.gate : self.lastgate])
        return out + self.v.to_ids(_trail(right, piece, 0, self.s, self.lastgate))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    if not a.size or not b.size:
        return np.full((a.shape[0], b.shape[1]), NEVER)
    return (a[:, :, None] + b[None, :, :]).max(1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices, by halves: the work is linear and the depth logarithmic."""
    n = len(matrices)
    if n <= 1:
        return list(matrices)
    pairs = scan([product(matrices[i], matrices[i + 1]) for i in range(0, n - 1, 2)])
    out = [matrices[0]]
    for i in range(1, n):
        out.append(pairs[i // 2] if i % 2 else product(pairs[i // 2 - 1], matrices[i]))
    return out


def choose(matrices: list[np.ndarray]) -> list[int] | None:
    """The state at the end of each chunk on the best way through all of them; None if there is no way."""
    ahead = scan(matrices)
    # ways to the end, by the same scan over transposed matrices
    behind = [x.T for x in scan([m.T for m in matrices[::-1]])][::-1]
    out = []
    for k in range(len(matrices)):
        through = ahead[k][0] + (behind[k + 1].max(1) if k + 1 < len(matrices) else 0)
        if out:  # of equally good states one that the last choice leads to
            step = matrices[k][out[-1]] + (behind[k + 1].max(1) if k + 1 < len(matrices) else 0)
            through = step
        if not len(through) or through.max() == NEVER:
            return None
        out.append(int(through.argmax()))
    return out
