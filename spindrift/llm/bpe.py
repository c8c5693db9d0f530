"""Exact byte-level BPE by backtracking from longest matches.

The vocabulary's byte strings are read as Latin-1, so one Aho-Corasick automaton gives, in one
pass over a piece of text, the longest token that begins at each byte. Encoding walks forward
with longest matches and steps back to a shorter token, or over the last token, whenever two
neighbours could not stand side by side after all merges. A sequence in which every pair of
neighbours is compatible is the one the merge rules give, so the ids are exact; each
(position, token) is tried at most once, so time is linear in the text.
"""

from __future__ import annotations

import base64
import os

import ahocorasick
import regex

#: The pattern that splits text before the merges (fixed by the public vocabulary).
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bounds of the memo tables of one Python worker (entries); a full table is emptied, never trusted less.
MEMO_PIECES, MEMO_PAIRS, MEMO_LEN = 200_000, 500_000, 64


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The vocabulary file; SPINDRIFT_TOKENIZERS names another folder."""
    return os.path.join(os.environ.get("SPINDRIFT_TOKENIZERS", "/opt/tokenizers"), name)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class BacktrackBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.text = {v: k for k, v in self.ranks.items()}
        self.auto = ahocorasick.Automaton()
        for s, i in self.ranks.items():
            self.auto.add_word(s, (i, len(s)))
        self.auto.make_automaton()
        self.shorter: dict[int, int] = {}  # token -> longest token that is a proper prefix of it
        for s, i in self.ranks.items():
            for n in range(len(s) - 1, 0, -1):
                if (j := self.ranks.get(s[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.pieces: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(SPLIT_PATTERN)

    def _merge(self, s: str) -> list[int]:
        """The merge rules themselves, on two tokens' bytes only."""
        parts = list(s)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.ranks.get(parts[k] + parts[k + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[(a, b)] = self._merge(self.text[a] + self.text[b]) == [a, b]
        return known

    def _piece(self, s: str) -> list[int]:
        n = len(s)
        longest = [0] * n
        for end, (tok, size) in self.auto.iter(s):
            longest[end - size + 1] = tok  # ends ascend, so the last one kept is the longest
        text, shorter, fits = self.text, self.shorter, self.fits
        dead = bytearray(n + 1)  # positions from which no valid continuation exists
        out: list[int] = []
        pos, tok = 0, longest[0]
        while pos < n:
            placed = False
            while tok is not None:
                end = pos + len(text[tok])
                if not dead[end] and (not out or fits(out[-1], tok)):
                    out.append(tok)
                    pos, placed = end, True
                    tok = longest[pos] if pos < n else None
                    break
                tok = shorter.get(tok)
            if not placed:
                dead[pos] = 1
                tok = out.pop()
                pos -= len(text[tok])
                tok = shorter.get(tok)
                while tok is None and out:  # nothing shorter here either: step back once more
                    dead[pos] = 1
                    last = out.pop()
                    pos -= len(text[last])
                    tok = shorter.get(last)
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; None and "" give []."""
        out: list[int] = []
        if not text:
            return out
        pieces = self.pieces
        for p in self.split.findall(text):
            ids = pieces.get(p)
            if ids is None:
                s = p.encode("utf-8", "surrogatepass").decode("latin-1")
                one = self.ranks.get(s)
                ids = [one] if one is not None and self._merge_is_one(s) else self._piece(s)
                if len(p) <= MEMO_LEN:
                    if len(pieces) >= MEMO_PIECES:
                        pieces.clear()
                    pieces[p] = ids
            out += ids
        return out

    def _merge_is_one(self, s: str) -> bool:
        return len(s) == 1 or self._piece(s) == [self.ranks[s]]


_loaded: dict[int, BacktrackBPE] = {}


def worker_bpe(data: bytes) -> BacktrackBPE:
    """One encoder for each vocabulary and Python worker, reused by its tasks."""
    key = hash(data)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = BacktrackBPE(read_ranks(data))
    return _loaded[key]
