"""Byte-level BPE: splitting text into pieces, counting merges, and encoding by prefixes.

Both ways work on one piece (one match of the pattern) at a time and remember the answers for
pieces that were met before, in a dictionary of bounded size that a Python worker keeps between
tasks.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Iterator

import regex

#: Bytes of Latin-1 on which ``re`` with the classes below agrees with the Unicode pattern.
_PLAIN = bytes(
    [*range(0x1C), *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]
)
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN_PATTERN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"
)
#: Pieces that a worker remembers; about 200 bytes each.
CACHE_PIECES = 500_000


def is_plain(text: str) -> bool:
    """Whether all characters are ones on which the cheap pattern agrees with the Unicode one."""
    if text.isascii():
        data = text.encode("ascii")
    else:
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return not data.translate(None, _PLAIN)


class Splitter:
    """Splits a text into the matches of a pattern, the pattern being that of ``public_tokenizers``."""

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)

    def __call__(self, text: str) -> list[str]:
        return _PLAIN_PATTERN.findall(text) if is_plain(text) else self.pattern.findall(text)


def unknown(known: dict, parts: list[list[str]], most: int = CACHE_PIECES) -> list[str]:
    """The pieces of several texts that ``known`` lacks, sorted; it is emptied first if they would
    make it too large."""
    new = set().union(*parts) - known.keys()
    if new and len(known) + len(new) > most:
        known.clear()
        new = set().union(*parts)
    return sorted(new)


class Remembered(dict):
    """piece -> ``compute(piece)``; starts anew when full, so that memory stays bounded."""

    def __init__(self, compute, most: int = CACHE_PIECES):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, piece):
        if len(self) >= self.most:
            self.clear()
        found = self[piece] = self.compute(piece)
        return found


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 token and rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def printable_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabularies in JSON write the 256 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_merges(path: str) -> tuple[dict[tuple[bytes, bytes], int], list[str]]:
    """Pair of symbols -> rank, and the special strings, from a byte-level BPE file in JSON."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = printable_bytes()
    raw = lambda s: bytes(byte[c] for c in s)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    merges = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}
    return merges, [t["content"] for t in spec["added_tokens"] if t["special"]]


class MergeCounter:
    """Token counts by a heap of adjacent pairs over a linked list of symbols.

    The heap gives the lowest-rank pair, leftmost first; merging it links the neighbours anew and
    pushes at most two pairs. A popped pair whose symbols have changed since is stale and skipped.
    The count is the number of bytes less the number of merges: no identifiers are made.
    """

    def __init__(self, merges: dict[tuple[bytes, bytes], int]):
        self.merges = merges

    def __call__(self, piece: str) -> int:
        data = piece.encode("utf-8")
        n = len(data)
        if n < 2:
            return n
        rank = self.merges.get
        symbols: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            r = rank((symbols[i], symbols[i + 1]))
            if r is not None:
                heap.append((r, i))
        heapq.heapify(heap)
        merged = 0
        while heap:
            r, i = heapq.heappop(heap)
            a = symbols[i]
            if a is None or (j := right[i]) >= n or rank((a, symbols[j])) != r:
                continue
            symbols[i], symbols[j] = (a := a + symbols[j]), None
            merged += 1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                s = rank((a, symbols[k]))
                if s is not None:
                    heapq.heappush(heap, (s, i))
            h = left[i]
            if h >= 0:
                s = rank((symbols[h], a))
                if s is not None:
                    heapq.heappush(heap, (s, h))
        return n - merged


class PrefixEncoder:
    """BPE by dynamic programming over the prefixes of a piece.

    BPE output has optimal substructure: the tokens of a prefix, less the last, are the tokens of
    the shorter prefix, and for each prefix just one last token is valid. So for each prefix we
    store that token. A candidate last token ``t`` of prefix ``i`` is valid if it may follow the
    stored last token ``u`` of prefix ``i - len(t)``, that is if BPE would leave the bytes
    ``u + t`` as the two tokens ``u, t``. Appending bytes keeps all stored tokens, and after an
    edit only prefixes from the edit on are computed again.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        #: each suffix of a token -> its own rank if it is a token too, else -1.
        self.suffixes = {t[i:]: -1 for t in ranks for i in range(1, len(t))} | ranks
        #: token -> the two tokens that merge into it, by BPE over lower ranks; None for a byte.
        self.halves: dict[int, tuple[int, int] | None] = {}
        #: token -> whether BPE makes it of its own bytes.
        self.valid: dict[int, bool] = {}
        #: pairs of ids -> whether BPE leaves their bytes as these two.
        self.follows: dict[tuple[int, int], bool] = {}

    def _merge_all(self, data: bytes, below: int) -> list[bytes]:
        """Plain BPE with ranks below a bound: the ground on which tokens are split in halves."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(
                ((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None and r < below),
                default=None,
            )
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def split(self, token: int) -> tuple[int, int] | None:
        """The pair whose merge makes a token; None for a byte, or if no merge makes it."""
        if token not in self.halves:
            data = self.tokens[token]
            parts = self._merge_all(data, token) if len(data) > 1 else [data]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def may_follow(self, u: int, t: int) -> bool:
        """Whether BPE leaves the bytes of tokens ``u``, ``t`` as just these two.

        Undo the merges of both tokens from the latest on, and look at the pair at the border each
        time: had it a rank below the merges undone so far, it would have been merged first.
        """
        known = self.follows.get((u, t))
        if known is not None:
            return known
        if len(self.follows) > 2_000_000:
            self.follows.clear()
        ranks, tokens, a, b, bound = self.ranks, self.tokens, u, t, 1 << 60
        answer = True
        while True:
            pair = ranks.get(tokens[a] + tokens[b])
            if pair is not None and pair < bound:
                answer = False
                break
            if a > b:
                # the later merge is in the left token
                bound, halves = a, self.split(a)
                if halves is None:
                    bound, halves = b + 1, self.split(b)
                    if halves is None:
                        break
                    b = halves[0]
                else:
                    a = halves[1]
            else:
                bound, halves = b + 1, self.split(b)
                if halves is None:
                    bound, halves = a, self.split(a)
                    if halves is None:
                        break
                    a = halves[1]
                else:
                    b = halves[0]
        self.follows[u, t] = answer
        return answer

    def last_tokens(self, data: bytes, stored: list[int] | None = None) -> list[int]:
        """For each prefix of ``data``, longest last, the last token of its encoding.

        ``stored`` are the answers for a prefix of ``data`` that is known already; they are kept.
        """
        last = list(stored or ())
        suffix, known, valid = self.suffixes.get, self.follows.get, self.valid.get
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(end - 1, -1, -1):
                t = suffix(data[start:end])
                if t is None:
                    break  # no token ends in these bytes
                if t < 0:
                    continue
                whole = valid(t)
                if not (self.whole(t) if whole is None else whole):
                    continue
                if start:
                    pair = last[start - 1], t
                    follows = known(pair)
                    if not (self.may_follow(*pair) if follows is None else follows):
                        continue
                last.append(t)
                break
        return last

    def ids_of_sorted(self, pieces: list[str]) -> Iterator[list[int]]:
        """The ids of each of many sorted pieces; what a piece shares with the one before is kept."""
        before, last = b"", []
        for piece in pieces:
            data = piece.encode("utf-8")
            k, most = 0, min(len(before), len(data))
            while k < most and data[k] == before[k]:
                k += 1
            del last[k:]
            before, last = data, self.last_tokens(data, last)
            yield self.ids(data, last)

    def whole(self, token: int) -> bool:
        """Whether BPE makes one token of a token's own bytes."""
        found = self.valid[token] = len(self.tokens[token]) == 1 or self.split(token) is not None
        return found

    def ids(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """The encoding of one piece, read off the stored last tokens from the end."""
        last = self.last_tokens(data) if last is None else last
        out, end = [], len(data)
        while end:
            t = last[end - 1]
            out.append(t)
            end -= len(self.tokens[t])
        return out[::-1]

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """A longer piece and its last tokens, exact without touching those stored."""
        return data + more, self.last_tokens(data + more, last)

    def edit(self, data: bytes, last: list[int], at: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """``data[at:stop]`` replaced by ``new``; prefixes that end before the edit stay."""
        data = data[:at] + new + data[stop:]
        return data, self.last_tokens(data, last[:at])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def split_specials(text: str, specials: list[str]) -> Iterator[tuple[bool, str]]:
    """The parts of a text outside special strings, and these themselves (True), leftmost longest first."""
    if not specials or not any(s in text for s in specials):
        yield False, text
        return
    at = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)))
    done = 0
    for m in at.finditer(text):
        if m.start() > done:
            yield False, text[done : m.start()]
        yield True, m[0]
        done = m.end()
    if done < len(text):
        yield False, text[done:]
