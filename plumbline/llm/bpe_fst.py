"""Byte-level BPE merges compiled into a lazily determinised finite-state transducer.

A string of bytes has one BPE encoding, and so has each of its prefixes. The last token of a prefix's
encoding is the one vocabulary suffix that may follow the last token of the rest, where "may follow" is a property
of two tokens alone. A state therefore holds, for every position from which a longer token could still start, the
trie node of the bytes since and the last token before it; a transition reads a byte and gives the last token of
the encoding up to there. Once no earlier position is live, or all live ones lead back to the same boundary, the
tokens before it are settled and emitted: bounded lookahead. For counting, a state also holds how many tokens each
live position lies behind the end, and a transition carries the change of the count. States and transitions are made when first
met and kept in a table of bounded size.
"""

from __future__ import annotations

import base64
import gc
import json

import regex

#: White space as the tokenizer libraries see it (the Unicode property), not as Python does.
_SPACE = r"\t-\r \x85\xa0  -     　"


def compile_pattern(pattern: str) -> regex.Pattern:
    """The splitting pattern with ``\\s`` and ``\\S`` spelled out."""
    inside = pattern.replace(r"[^\s", f"[^{_SPACE}")
    return regex.compile(inside.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes are
    themselves, the others follow from U+0100 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in set(plain)))
    return out


def load_merges(path: str) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int], dict[str, int]]:
    """(token bytes to id, merge pair to rank, special string to id) from a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges[raw(a), raw(b)] = rank
    return vocab, merges, special


#: Bits for a token in a live position's number, and for how far its count lies behind, which may be less than 0.
_T, _D = 18, 8
_BIAS = 128


class Transducer:
    """Deterministic transducer from bytes to token ids, or to token counts.

    ``merges`` maps a pair of tokens to its rank; without it any two tokens merge whose
    concatenation is in ``vocab``, at that token's id as the rank.
    """

    def __init__(self, vocab, merges=None, counting=False, max_states=100_000):
        self.vocab, self.merges = vocab, merges
        self.counting, self.max_states = counting, max_states
        self.none = (1 << _T) - 1
        if max(vocab.values(), default=0) >= self.none:
            raise ValueError("the vocabulary has too many tokens")
        self.spines: tuple[dict, dict] = ({}, {})
        self.follows: dict[int, bool] = {}
        self.text = {i: t for t, i in vocab.items()}
        self.size = {i: len(t) for t, i in vocab.items()}
        # A trie of the tokens: children by node * 256 + byte, and the token that ends at each node.
        self.child: dict[int, int] = {}
        self.token: list[int | None] = [None]
        inner = set()
        for word, i in vocab.items():
            node = 0
            for byte in word:
                inner.add(node)
                key = node << 8 | byte
                node = self.child.get(key)
                if node is None:
                    node = self.child[key] = len(self.token)
                    self.token.append(None)
            self.token[node] = i
        self.inner = [n in inner for n in range(len(self.token))]
        self._reset()

    def _reset(self):
        #: A state is its live positions, each one number: trie node, count behind the end, last token. The first is the end itself.
        self.states: list[tuple[int, ...]] = [(_BIAS << _T | self.none,)]
        self.ids = {self.states[0]: 0}
        #: (next state, last token or change of the count) by state * 256 + byte.
        self.next: dict[int, tuple[int, int]] = {}

    def _rank(self, a: bytes, b: bytes):
        return self.vocab.get(a + b) if self.merges is None else self.merges.get((a, b))

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes ``token``; None if its bytes merge to something else."""
        parts, last = [token[i : i + 1] for i in range(len(token))], None
        while len(parts) > 1:
            ranks = [(r, i) for i in range(len(parts) - 1) if (r := self._rank(parts[i], parts[i + 1])) is not None]
            if not ranks:
                return None
            _, i = min(ranks)
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return last

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, float]] | None:
        """From the outermost byte up to ``token``: (node, rank of the merge that takes it in)."""
        if (found := self.spines[side].get(token, 0)) != 0:
            return found
        out, node, rank = [], token, float("inf")
        while True:
            out.append((node, rank))
            if len(node) == 1:
                break
            if (parts := self._split(node)) is None:
                out = None
                break
            rank, node = self._rank(*parts), parts[side]
        self.spines[side][token] = out = out and out[::-1]
        return out

    def _may_follow(self, a: int | None, b: int) -> bool:
        """Whether token b may stand right after token a (at the start if None) in an encoding: no
        merge across the seam may come before those that build a and b, leftmost first among equals."""
        left, right = self._spine(self.text[b], 0), None if a is None else self._spine(self.text[a], 1)
        if left is None or a is None:
            return left is not None
        i = j = 0
        (x, px), (y, py) = right[0], left[0]
        while True:
            r = self._rank(x, y)
            if r is not None and r < px and r <= py:
                return False
            if px <= py:
                if px == float("inf"):
                    return True
                i += 1
                x, px = right[i]
            else:
                j += 1
                y, py = left[j]

    def _pair(self, key: int) -> bool:
        if len(self.follows) > self.max_states:
            self.follows.clear()
        last = key >> _T
        ok = self.follows[key] = self._may_follow(None if last == self.none else last, key & ((1 << _T) - 1))
        return ok

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, last token or change of the count); made on first use."""
        child, token, inner, follows = self.child, self.token, self.inner, self.follows
        kept, found, behind = [], None, 0
        for position in self.states[state]:
            node = child.get(position >> _T + _D << 8 | byte)
            if node is None:
                continue
            if found is None and (t := token[node]) is not None:
                key = (position & self.none) << _T | t
                ok = follows.get(key)
                if self._pair(key) if ok is None else ok:
                    found, behind = t, (position >> _T & (1 << _D) - 1) - _BIAS
            if inner[node]:
                kept.append(node << _T + _D | position & (1 << _T + _D) - 1)
        change = 1 - behind
        if self.counting and change:  # what lies behind is held against the new end
            kept = [p + (change << _T) for p in kept]
        live = (_BIAS << _T | found, *kept)
        to = self.ids.get(live)
        if to is None:
            to = self.ids[live] = len(self.states)
            self.states.append(live)
        out = self.next[state << 8 | byte] = (to, change if self.counting else found)
        return out

    def _bounded(self, state: int) -> int:
        """``state``, after the tables were emptied if they are full: its live positions then are a state anew."""
        if len(self.states) <= self.max_states and len(self.next) <= 4 * self.max_states:
            return state
        live = self.states[state]
        self._reset()
        to = self.ids.setdefault(live, len(self.states))
        if to == len(self.states):
            self.states.append(live)
        return to

    def encode(self, word: bytes):
        """The ids of ``word`` as a tuple, or their number if counting. The tables' bound is held within a word too."""
        if not self.counting and len(word) > LOOKAHEAD:
            return self._encode_long(word)
        state, total, last = self._bounded(0), 0, []
        for i in range(0, len(word), LOOKAHEAD):
            if i:
                state = self._bounded(state)
            get, step = self.next.get, self.step
            if self.counting:
                for byte in word[i : i + LOOKAHEAD]:
                    state, n = get(state << 8 | byte) or step(state, byte)
                    total += n
            else:
                for byte in word[i : i + LOOKAHEAD]:
                    state, t = get(state << 8 | byte) or step(state, byte)
                    last.append(t)
        return total if self.counting else self._settle(last, 0, len(last))

    def _settle(self, last: list[int], start: int, end: int) -> tuple[int, ...]:
        """The tokens of a settled stretch, by the last token up to each of its places."""
        size, out = self.size, []
        while end > start:
            t = last[end - 1]
            out.append(t)
            end -= size[t]
        return tuple(out[::-1])

    def _encode_long(self, word: bytes) -> tuple[int, ...]:
        """As ``encode``, emitting what is settled after every stretch of LOOKAHEAD bytes."""
        state, last, out = 0, [], []
        for i in range(0, len(word), LOOKAHEAD):
            state = self._bounded(state)
            for byte in word[i : i + LOOKAHEAD]:
                state, t = self.next.get(state << 8 | byte) or self.step(state, byte)
                last.append(t)
            # Ways back from the live positions, the end and those before it by their nodes' depths, to where they meet.
            ends = {len(last) - self._depth(p >> _T + _D) for p in self.states[state]}
            while len(ends) > 1:
                far = max(ends)
                ends = ends - {far} | {far - self.size[last[far - 1]]}
            (done,) = ends
            out += self._settle(last, 0, done)
            del last[:done]
        return (*out, *self._settle(last, 0, len(last)))

    def _depth(self, node: int) -> int:
        if not hasattr(self, "depths"):
            self.depths = [0] * len(self.token)
            for key, to in self.child.items():  # parents come before their children
                self.depths[to] = self.depths[key >> 8] + 1
        return self.depths[node]


#: Bytes of one piece that are read before what is settled is given out.
LOOKAHEAD = 512


class PieceMemo(dict):
    """Transducer results by piece, for pieces of ordinary length. Two generations of bounded size: when the new
    one is full it becomes the old one, from which pieces still in use come back."""

    def __init__(self, transducer: Transducer, whole=None, size=80_000, longest=48):
        super().__init__()
        self.run, self.whole, self.size, self.longest = transducer.encode, whole or {}, size, longest
        self.old: dict = {}

    def __missing__(self, piece: str):
        out = self.old.get(piece)
        if out is None:
            raw = piece.encode("utf-8", "surrogatepass")
            out = self.whole.get(raw)
            if out is None:
                out = self.run(raw)
            if len(raw) > self.longest:
                return out
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out


def quiet_gc() -> None:
    """For workers that hold large tables without cycles: no full scans of them."""
    gc.collect()
    gc.freeze()
    gc.set_threshold(100_000, 50, 1000)
