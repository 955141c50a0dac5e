"""Byte-level BPE over a public vocabulary file: pre-splitting, heap merging, counting, streaming and decoding.

The vocabulary is read from the path given (a tokenizers JSON file of kind byte-level BPE); nothing of it is kept in
this repository. Each Python worker reads it once.
"""

from __future__ import annotations

import codecs
import heapq
import json
import math
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex

# The published split pattern of byte-level BPE vocabularies of this kind. \s is spelled as the
# Unicode property, as the Rust engine reads it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Words that ``Recent`` remembers: without lists and digits they take less than CACHE_WORDS of those do.
RECENT_WORDS = 600_000
#: Most words that a worker remembers; the memory of a worker is bounded by it and by WORD_BYTES.
CACHE_WORDS = 400_000
#: Words longer than this are never remembered.
WORD_BYTES = 256
#: Most characters of a text that the tiktoken library splits; its pattern engine overflows on longer runs of white space.
LIBRARY_CHARS = 20_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def narrow_split() -> re.Pattern:
    """SPLIT for texts of characters below U+10000: the classes spelled out, as ``regex`` has them, for the faster ``re``."""
    every = "".join(map(chr, range(0x10000)))

    def spelled(kind: str) -> str:
        return "".join(f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in regex.finditer(rf"\p{{{kind}}}+", every))

    blank, letter, number = map(spelled, ("White_Space", "L", "N"))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+")


def split_words(v: Vocabulary, text: str) -> list[str]:
    """The words of the split pattern, by the faster engine where no character is beyond its classes."""
    if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text):
        return narrow_split().findall(text)
    return v.split.findall(text)


def byte_names() -> dict[str, int]:
    """The printable stand-in characters of the vocabulary file, to the bytes they stand for.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, for the characters from U+0100 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and byte strings of a byte-level BPE file.

    ``pairs[(a, b)] = (rank, id of the merged symbol)``; ``token[id]`` are the bytes of an id.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, names = spec["model"], byte_names()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError(f"{path} is no plain byte-level BPE file")
        if spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError(f"{path} splits texts in another way")
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} has added tokens that take white space")
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.token: list[bytes] = [b""] * size
        for s, i in vocab.items():
            if s not in self.specials:
                self.token[i] = bytes(names[c] for c in s)
        for s, i in self.specials.items():
            self.token[i] = s.encode()
        self.first = [0] * 256
        for c, b in names.items():
            self.first[b] = vocab[c]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.split = regex.compile(SPLIT)

    # -- merging ---------------------------------------------------------------------------------------------------

    def merge(self, word: bytes, symbols: bool = True):
        """Byte-pair merging of one word with a heap of adjacent pairs over a linked list.

        Again and again the pair of lowest rank, the leftmost of equal ranks, is popped; an entry whose symbols have
        changed since is stale and skipped. Returns the symbols, or without ``symbols`` only their count: the initial
        symbols minus the merges. O(n log n) in the word's bytes.
        """
        n = len(word)
        if n < 2:
            return [self.first[word[0]]] * n if symbols else n
        pairs, first = self.pairs, self.first
        at = [first[b] for b in word]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if p := pairs.get((at[i], at[i + 1])):
                heap.append((p[0], i, at[i], at[i + 1], p[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if at[i] != a or j >= n or at[j] != b:
                continue
            merges += 1
            at[i], at[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if p := pairs.get((made, at[k])):
                    heapq.heappush(heap, (p[0], i, made, at[k], p[1]))
            h = before[i]
            if h >= 0 and (p := pairs.get((at[h], made))):
                heapq.heappush(heap, (p[0], h, at[h], made, p[1]))
        return [x for x in at if x >= 0] if symbols else n - merges

    def library(self):
        """The tiktoken library's encoder where it merges alike: if ids rise with the merges' ranks, a pair's rank is that
        of the token it makes. Else None."""
        made = [z for _, z in sorted(self.pairs.values())]
        if made != sorted(set(made)) or any(z <= b for z in made[:1] for b in self.first):
            return None
        import tiktoken

        ranks = {b: i for i, b in enumerate(self.token) if b and i not in self.specials.values()}
        return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    # -- lookahead -------------------------------------------------------------------------------------------------

    def lookahead(self) -> int:
        """Bytes beyond a token's end that settle whether the token stands, whatever follows them.

        Let L(m) be the bytes right of the pair (x, y) of merge m that settle whether m takes place once its bytes
        are there. The right part y is taken away only by a merge (y, z) of lower rank, for which z's bytes and
        L of that merge must be seen; and y and z are themselves made by merges of lower rank. So
        L(m) = max(L(merge making y), max over (y, z) of lower rank of |z| + max(L((y, z)), L(merge making z))),
        computed in rank order. The text's lookahead is the greatest value, with the longest token added: the next
        merge that could take the token as its left part must be settled too.
        """
        made: dict[int, int] = {}  # symbol -> L of the merge that makes it
        upto: dict[int, int] = {}  # y -> max over (y, z) seen so far of |z| + L
        worst = 0
        for (x, y), (_, z) in sorted(self.pairs.items(), key=lambda kv: kv[1][0]):
            need = max(made.get(y, 0), upto.get(y, 0))
            made[z] = max(made.get(z, 0), need)
            upto[x] = max(upto.get(x, 0), len(self.token[y]) + max(need, made.get(y, 0)))
            worst = max(worst, need)
        return max([worst, *upto.values()]) + max(map(len, self.token))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def lookahead(path: str) -> int:
    return vocabulary(path).lookahead()


class Memo(dict):
    """word -> what ``make`` gives for its bytes; bounded, so that a worker's memory is too."""

    def __init__(self, make, most: int = CACHE_WORDS):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str):
        out = self.make(raw := word.encode("utf-8"))
        if len(raw) <= WORD_BYTES:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out


class Recent(dict):
    """word -> what ``make`` gives for its bytes, for the words met last: bounded, without forgetting all at once.

    Once half of ``most`` words are held, they become the older ones, and the older ones before them go; an older word that
    is met again moves over. So words that recur stay, however many others come between.
    """

    def __init__(self, make, most: int = RECENT_WORDS):
        super().__init__()
        self.make, self.half, self.older = make, most // 2, {}

    def __missing__(self, word: str):
        if (out := self.older.pop(word, None)) is None:
            out = self.make(raw := word.encode("utf-8"))
            if len(raw) > WORD_BYTES:
                return out
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out


def pieces(v: Vocabulary, text: str) -> Iterator[tuple[int, list[str]]]:
    """The text cut at special strings, as the library's default does: (-1, words) or (id of a special token, [])."""
    if v.special_split is None or not any(s in text for s in v.specials):
        yield -1, v.split.findall(text)
        return
    for part in v.special_split.split(text):
        if part in v.specials:
            yield v.specials[part], []
        elif part:
            yield -1, v.split.findall(part)


def encoder(path: str, kind: str):
    """text -> its ids as bytes of numpy's ``kind``.

    The library splits and merges at once, but fails on very long runs of white space: texts over LIBRARY_CHARS, which
    alone can hold such runs, are split here and merged word by word, with the same ids.
    """
    v = vocabulary(path)
    library = v.library()
    raw = lambda ids: np.array(ids, dtype=kind).tobytes()
    memo = Memo((lambda word: raw(library._encode_single_piece(word))) if library else (lambda word: raw(v.merge(word))))

    def encode(text: str) -> bytes:
        if library and len(text) <= LIBRARY_CHARS and not any(x in text for x in v.specials):
            return raw(library.encode_ordinary(text))
        return b"".join(raw([special]) if special >= 0 else b"".join(map(memo.__getitem__, words)) for special, words in pieces(v, text))

    return encode


# -- streaming -----------------------------------------------------------------------------------------------------


class Machine:
    """What the transducer needs of a vocabulary: the automaton of its tokens, and which tokens stay apart side by side.

    A state is the longest end of what was read that some token begins with. ``ends[state]`` are the tokens that end
    there, longest first; ``open[state]`` are the lengths of the ends with which a longer token begins.
    """

    def __init__(self, v: Vocabulary):
        self.v, own = v, set(v.specials.values())
        self.made = [(-1, -1, -1)] * len(v.token)  # (rank, left, right) of the merge that makes a token
        for (x, y), (rank, z) in v.pairs.items():
            self.made[z] = (rank, x, y)
        self.plain = len({z for _, z in v.pairs.values()}) == len(v.pairs)  # no token is made in two ways
        self.size = [len(x) for x in v.token]
        self.step: dict[int, int] = {}  # state << 8 | byte -> state
        token, inner, depth = [-1], [False], [0]
        for i, raw in enumerate(v.token):
            if not raw or i in own:
                continue
            rank, x, y = self.made[i]
            if len(raw) > 1 and not (rank >= 0 and self.border(x, y, rank) if self.plain else v.merge(raw) == [i]):
                continue  # no text merges to it
            node = 0
            for byte in raw:
                k = node << 8 | byte
                inner[node] = True
                if k not in self.step:
                    self.step[k] = len(token)
                    token.append(-1)
                    inner.append(False)
                    depth.append(depth[node] + 1)
                node = self.step[k]
            token[node] = i
        self.shorter = [0] * len(token)  # the next shorter end that is a state
        self.ends: list[tuple[int, ...]] = [()] * len(token)
        self.open: list[tuple[int, ...]] = [()] * len(token)
        for k, node in sorted(self.step.items(), key=lambda e: depth[e[1]]):
            above, byte = k >> 8, k & 255
            f = self.follow(self.shorter[above], byte) if above else 0
            self.shorter[node] = f
            self.ends[node] = (token[node], *self.ends[f]) if token[node] >= 0 else self.ends[f]
            self.open[node] = (depth[node], *self.open[f]) if inner[node] else self.open[f]
        self.known: dict[int, bool] = {}

    def follow(self, state: int, byte: int) -> int:
        while (to := self.step.get(state << 8 | byte)) is None and state:
            state = self.shorter[state]
        return to or 0

    def border(self, x: int, y: int, before: float) -> bool:
        """Whether no merge of a rank under ``before`` reaches over the border of x and y.

        Goes back in time: of the symbols at the border the one made last is taken apart (of equal ones the right, since the
        left one is made first), and a merge of what then met there must not have come earlier than that; one of equal rank
        would have, if it lies to the left.
        """
        pair, made = self.v.pairs.get, self.made
        (a, xl, xr), (b, yl, yr) = made[x], made[y]
        while True:
            if (p := pair((x, y))) and p[0] < before:
                return False
            if a > b:
                before, x = a, xr
                a, xl, xr = made[x]
            elif b >= 0:
                before, y = b + 1, yl
                b, yl, yr = made[y]
            else:
                return True

    def apart(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together merge to just these two."""
        k = a << 32 | b
        if (out := self.known.get(k)) is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            out = self.known[k] = self.border(a, b, math.inf) if self.plain else self.v.merge(self.v.token[a] + self.v.token[b]) == [a, b]
        return out


@lru_cache(maxsize=2)
def machine(path: str) -> Machine:
    return Machine(vocabulary(path))


class Transducer:
    """Bounded-lookahead BPE of one word that arrives byte by byte; tokens go out once they are stable.

    The last token of every prefix is the one token at its end that stays apart from the last token before it, so each
    byte takes a step of the automaton and a look at the tokens that end there. What follows can only build on the
    end and on the starts at which a longer token is open: the tokens that all their prefixes begin with are stable and go out at
    once. A token that ends ``lookahead`` bytes before the end is the same in all prefixes, so no more than that and the
    longest token is ever held: constant memory, linear time.
    """

    def __init__(self, m: Machine):
        self.m = m
        self.reset()

    def reset(self) -> None:
        # of every place held: the last token before it (at the first place, the last that went out), and where that starts
        self.tok, self.start, self.base, self.state = [-1], [0], 0, 0

    def feed(self, part: bytes) -> list[int]:
        m = self.m
        step, shorter, ends, opened, size, known = m.step.get, m.shorter, m.ends, m.open, m.size, m.known
        tok, start, base, state = self.tok, self.start, self.base, self.state
        out: list[int] = []
        n, low = len(tok) - 1, base
        for byte in part:
            while (to := step(state << 8 | byte)) is None:
                state = shorter[state]
            state = to
            n += 1
            for t in ends[state]:
                j = n - size[t]
                if j >= base:
                    if j == n - 1 or (last := tok[j]) < 0:  # one token fits, and a single byte is the last to try
                        break
                    if (ok := known.get(last << 32 | t)) is None:
                        ok = m.apart(last, t)
                    if ok:
                        break
            tok.append(t)
            start.append(j)
            wide = opened[state]
            at = n - wide[0] if wide else n
            if at <= low:  # no start has closed
                continue
            low = at
            while base < n and at > base:
                e = n
                while start[e] > base:
                    e = start[e]
                for w in wide:
                    i = n - w
                    while start[i] > base:
                        i = start[i]
                    if i != e:
                        break
                else:
                    out.append(tok[e])
                    base = e
                    continue
                break
        if base > 512:  # what went out is forgotten
            tok, start, base = tok[base:], [x - base for x in start[base:]], 0
        self.tok, self.start, self.base, self.state = tok, start, base, state
        return out

    def finish(self) -> list[int]:
        out, i = [], len(self.tok) - 1
        while i > self.base:
            out.append(self.tok[i])
            i = self.start[i]
        self.reset()
        return out[::-1]


def transduce(m: Machine, word: bytes) -> list[int]:
    """The ids of a word through the transducer."""
    t = Transducer(m)
    return t.feed(word) + t.finish()


#: Runs that one word of the split pattern may hold without end: what goes on in the next window if a window ends in it.
RUNS = {k: regex.compile(p) for k, p in (("L", r"\p{L}+"), ("N", r"\p{N}+"), ("O", r"[^\p{White_Space}\p{L}\p{N}]+"), ("S", r"\p{White_Space}+"))}
WINDOW = 1 << 16


def words(v: Vocabulary, chunks: Iterable[str], window: int = WINDOW) -> Iterator[tuple[list[str], str, bool]]:
    """Splits a text that arrives in chunks: (whole words, part of a word that goes on from the call before or begins, whether it ends there).

    All words but the last of what is held are settled, since the pattern looks one character past a word's end; only
    an apostrophe before a last l, r or v may still become 'll, 're or 've, so it waits too. A last word over a window
    long is handed on in parts while its run goes on; of a run of white space the last character stays back, since it
    belongs to what follows unless the text ends. So no more than a window and a chunk is held.
    """
    held, run = "", None
    for chunk in chunks:
        held += chunk
        if run:
            m = RUNS[run].match(held)
            end = m.end() if m else 0
            back = int(run == "S")
            if end == len(held):
                yield [], held[: end - back], False
                held = held[end - back :]
                continue
            yield [], held[: end - back], True
            held, run = held[end - back :], None
        found = split_words(v, held)
        if not found:
            continue
        waits = 2 if len(found) > 1 and found[-2] == "'" and found[-1] in ("l", "r", "v") else 1
        last = found[-1]
        if len(found) > waits:
            yield found[:-waits], "", True
        held = "".join(found[-waits:])
        if len(last) >= window:
            c = last[-1]
            run = next(k for k, p in RUNS.items() if p.match(c))
            back = int(run == "S")
            yield [], last[: len(last) - back], False
            held = last[len(last) - back :]
    if run:
        yield [], held, True
        held = ""
    if held:
        yield split_words(v, held), "", True


class Encoder:
    """Text in chunks -> ids, in portions, as soon as they are settled; every id comes from the transducer.

    Words recur: what the transducer gave for the short ones met last is remembered (bounded), as bytes, which the garbage
    collector needn't visit.
    """

    def __init__(self, path: str, window: int = WINDOW):
        self.v, self.m, self.window = vocabulary(path), machine(path), window
        self.digits = [str(i) for i in range(len(self.v.token))]
        self.one, self.memo = Transducer(self.m), Recent(self.word)

    def word(self, raw: bytes) -> bytes:
        return array("I", self.one.feed(raw) + self.one.finish()).tobytes()

    def plain(self, chunks: Iterable[str]) -> Iterator[tuple[list[int], str]]:
        """(ids, their digits joined by commas) of a text without special strings."""
        memo, t = self.memo, None
        for whole, part, ended in words(self.v, chunks, self.window):
            if whole:
                ids = array("I", b"".join(map(memo.__getitem__, whole))).tolist()
            else:
                t = t or Transducer(self.m)
                ids = t.feed(part.encode("utf-8")) + (t.finish() if ended else [])
            if ids:
                yield ids, ",".join(map(self.digits.__getitem__, ids))

    def stream(self, text: str) -> Iterator[tuple[list[int], str]]:
        parts = self.v.special_split.splititer(text) if self.v.special_split else [text]
        for p in parts:
            if (special := self.v.specials.get(p)) is not None:
                yield [special], str(special)
            elif p:
                yield from self.plain(p[i : i + self.window] for i in range(0, len(p), self.window))


class Decoder:
    """Incremental byte-to-text state machine: ids come in any portions, text goes out as far as its bytes settle it.

    Between portions it holds only the bytes of one unfinished character; bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self, v: Vocabulary):
        self.token = v.token
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.token.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)
