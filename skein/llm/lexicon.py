"""A minimal acyclic transducer from words to token ids, and exact merging of words it doesn't hold.

Words are byte strings. States with equal futures are shared, so suffixes are stored once. A word's number is the
sum of the skips on its way (words passed on earlier edges), and the number selects its ids: that is the output of
the transducer, without a copy of the word. Everything lies in one file of plain arrays that workers map to memory.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np

MAGIC = 0x534B454C
#: Ids at which a memo of resolved words starts anew, per worker.
MEMO_WORDS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by byte-pair merging: always the pair of lowest rank, the leftmost of equals.

    Parts form a linked list and mergeable pairs a heap, so a word of n bytes takes O(n log n) steps, however long it
    is. A pair in the heap counts only while its two parts still begin and end where they did.
    """
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a place
    heap = [(ranks[word[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapify(heap)
    while heap:
        _, left, right, stop = heappop(heap)
        if end[left] != right or right >= n or end[right] != stop:
            continue
        end[left], end[right] = stop, -1
        if stop < n:
            before[stop] = left
            if (rank := ranks.get(word[left : end[stop]])) is not None:
                heappush(heap, (rank, left, stop, end[stop]))
        if (at := before[left]) >= 0 and (rank := ranks.get(word[at:stop])) is not None:
            heappush(heap, (rank, at, left, stop))
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


class Automaton:
    """Minimal automaton of sorted distinct words, built word by word; finished states are looked up and shared."""

    def __init__(self, words: list[bytes]):
        self.edges: list[dict[int, int]] = [{}]
        self.final: list[bool] = [False]
        self.known: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # (parent, byte, child) not yet shared
        before = b""
        for word in words:
            common = 0
            while common < min(len(word), len(before)) and word[common] == before[common]:
                common += 1
            self._share(path, common)
            state = path[-1][2] if path else 0
            for byte in word[common:]:
                self.edges.append({})
                self.final.append(False)
                child = len(self.edges) - 1
                self.edges[state][byte] = child
                path.append((state, byte, child))
                state = child
            self.final[state] = True
            before = word
        self._share(path, 0)

    def _share(self, path: list, down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            future = (self.final[child], tuple(self.edges[child].items()))
            self.edges[parent][byte] = self.known.setdefault(future, child)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted edge codes (state * 256 + byte), targets, skips and final flags of the states in use."""
        order, seen, stack = [], {0: 0}, [0]
        while stack:
            s = stack.pop()
            order.append(s)
            for t in self.edges[s].values():
                if t not in seen:
                    seen[t] = len(seen)
                    stack.append(t)
        total: dict[int, int] = {}

        def count(state: int) -> int:
            todo = [state]
            while todo:
                s = todo[-1]
                missing = [t for t in self.edges[s].values() if t not in total]
                if missing:
                    todo.extend(missing)
                else:
                    total[s] = self.final[s] + sum(total[t] for t in self.edges[s].values())
                    todo.pop()
            return total[state]

        count(0)
        code, target, skip = [], [], []
        for s in order:
            passed = int(self.final[s])
            for byte, t in sorted(self.edges[s].items()):
                code.append(seen[s] * 256 + byte)
                target.append(seen[t])
                skip.append(passed)
                passed += total[t]
        final = np.zeros(len(seen), np.uint8)
        for s in order:
            final[seen[s]] = self.final[s]
        by = np.argsort(np.array(code, np.int64))
        return np.array(code, np.int64)[by], np.array(target, np.int32)[by], np.array(skip, np.int32)[by], final


def compile_lexicon(words: list[str], ranks: dict[bytes, int]) -> bytes:
    """File image of the lexicon of ``words``: header, edge codes, targets, skips, finals, id offsets, ids."""
    keys = sorted({w.encode() for w in words} - {b""})
    ids = [merge_word(w, ranks) for w in keys]
    code, target, skip, final = Automaton(keys).arrays()
    starts = np.zeros(len(ids) + 1, np.int64)
    starts[1:] = np.cumsum([len(x) for x in ids])
    flat = np.array([i for x in ids for i in x], np.int32)
    pad = np.zeros(-len(final) % 8, np.uint8)
    header = np.array([MAGIC, len(code), len(final), len(ids), len(flat), 0, 0, 0], np.int64)
    return b"".join(x.tobytes() for x in (header, code, starts, target, skip, flat, final, pad))


class Lexicon:
    """The lexicon file, mapped read-only: its pages are shared by all workers of a machine."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        head = raw[:64].view(np.int64)
        if head[0] != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        edges, states, words, n_ids = (int(x) for x in head[1:5])
        at = 64

        def take(n: int, kind: type) -> np.ndarray:
            nonlocal at
            size = n * np.dtype(kind).itemsize
            part = raw[at : at + size].view(kind)
            at += size
            return part

        self.code, self.starts = take(edges, np.int64), take(words + 1, np.int64)
        self.target, self.skip, self.ids, self.final = take(edges, np.int32), take(edges, np.int32), take(n_ids, np.int32), take(states, np.uint8)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 if it isn't held. All words walk the automaton together, byte by byte."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(length) - length
        state, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.nonzero(length > 0)[0] if len(self.code) else np.zeros(0, np.int64)
        number[length == 0] = -1
        if not len(self.code):
            number[:] = -1
        step = 0
        while len(live):
            want = state[live] * 256 + data[start[live] + step]
            at = np.minimum(np.searchsorted(self.code, want), len(self.code) - 1)
            found = self.code[at] == want
            number[live[~found]] = -1
            live, at = live[found], at[found]
            state[live] = self.target[at]
            number[live] += self.skip[at]
            step += 1
            ended = length[live] == step
            done = live[ended]
            number[done[self.final[state[done]] == 0]] = -1
            live = live[~ended]
        return number

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()


# The tokenizer's word pattern, and the same for texts of ASCII only.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"""
#: Stretches of ASCII in other texts from which on it pays to split them by the plainer pattern.
ASCII_RUN = r"[\x00-\x7f]{96,}"
#: Where a text may be cut without changing its words: before white space that follows something else.
CUT = r"(?<=[^ \t-\r])[ \t-\r]"


@lru_cache(1)
def _patterns():
    import regex

    return re.compile(ASCII_PATTERN).findall, regex.compile(PATTERN).findall, re.compile(ASCII_RUN).finditer, re.compile(CUT).search


def split(text: str) -> list[str]:
    """The words of a text, which joined give the text again."""
    ascii_words, words, runs, cut = _patterns()
    if text.isascii():
        return ascii_words(text)
    out, at = [], 0
    for run in runs(text):
        first = cut(text, run.start() + 1, run.end())
        last = max(text.rfind(c, run.start(), run.end()) for c in " \n")
        while first and last > first.start() and text[last - 1] in " \t\n\r\f\v":
            last -= 1
        if first and last > first.start():
            out += words(text[at : first.start()])
            out += ascii_words(text[first.start() : last])
            at = last
    return out + words(text[at:])


class Encoder:
    """Words to ids: by the mapped lexicon, all unseen words of a batch at once; the rest by exact merging."""

    def __init__(self, lexicon: str, ranks: str):
        self.lexicon = Lexicon(lexicon)
        self.ranks = read_ranks(ranks)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.start, self.count, self.flat = (np.zeros(0, np.int64) for _ in range(3))

    def learn(self, words: set[str]) -> None:
        """Gives every word a slot: its ids lie in ``flat`` from ``start`` on."""
        new = list(words.difference(self.memo))
        if len(self.memo) + len(new) > MEMO_WORDS:
            self._forget()
            new = list(words)
        if not new:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        numbers = self.lexicon.numbers(raw).tolist()
        ids = [self.lexicon.ids_of(n) if n >= 0 else merge_word(w, self.ranks) for w, n in zip(raw, numbers, strict=True)]
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], np.int64)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids end to end, number of ids per text)."""
        words: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            if t:
                words += split(t)
            ends[i + 1] = len(words)
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        self.learn(set(words))
        slot = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        count = self.count[slot]
        upto = np.zeros(len(words) + 1, np.int64)
        np.cumsum(count, out=upto[1:])
        at = np.repeat(self.start[slot] - upto[:-1], count) + np.arange(upto[-1])
        return self.flat[at].astype(np.int32), np.diff(upto[ends])


@lru_cache(4)
def encoder(lexicon: str, ranks: str) -> Encoder:
    """One per worker process and lexicon."""
    return Encoder(lexicon, ranks)
