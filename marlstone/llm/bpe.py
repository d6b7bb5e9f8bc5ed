"""BPE encoding and decoding as streaming transducers.

The vocabulary files are the tokenizers library's JSON; its path is a parameter. Encoding splits off the added
tokens, brings the rest to NFC, lower case and white-space-separated pieces, cuts pieces by the file's pattern
and merges the byte signs of each word, whose last sign carries the word-end suffix.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import held, map_batches

#: White_Space of Unicode, which the vocabulary's normaliser folds to one space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Code points of a text, and of texts together, that are handled at once; longest piece that is cached, pieces in
#: a worker's cache, token pairs of which it is kept whether they stay apart.
SLICE_CHARS, HELD_CHARS, CACHED_CHARS, CACHE_WORDS, APART_PAIRS = 1 << 16, 1 << 20, 64, 200_000, 1 << 16
#: Stands for the word-end suffix in a word's signs; no byte has this sign.
END_SIGN = "\0"
#: Signs by which tokens are looked for, and how many of their sequences a worker keeps.
HEAD, HEADS = 4, 1 << 16


def byte_signs() -> list[str]:
    """The printable sign of each byte in byte-level vocabularies: itself if visible, else the next from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    visible = set(seen)
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


# Letters and numbers that Unicode has got since the interpreter's version, and the library knows.
NEWER = {
    "L": "1c89-1c8a a7cb-a7ce a7d2 a7d4 a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 16ea0-16eb8 18cff 1e5d0-1e5ed 1e5f0",
    "N": "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa",
}


@functools.lru_cache(maxsize=4)
def _code_points(kind: str) -> str:
    """The inside of a character class: the code points of a general category's letter, by unicodedata.

    The regular-expression libraries each bring tables of their own version; these are the interpreter's.
    """
    runs: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == kind:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    runs += [[int(x, 16) for x in (r.split("-") * 2)[:2]] for r in NEWER.get(kind, "").split()]
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def _pattern(text: str) -> re.Pattern:
    """A split pattern of a vocabulary file, whose \\p{L}, \\p{N} and \\s stand in character classes or alone."""
    for name, inside in ((r"\p{L}", _code_points("L")), (r"\p{N}", _code_points("N")), (r"\s", WHITE)):
        text = re.sub(rf"(\[[^\]]*?){re.escape(name)}", lambda m, inside=inside: m[1] + inside, text)
        text = text.replace(name, f"[{inside}]")
    return re.compile(text)


class _Lengths(dict):
    """By the next HEAD signs: the lengths of the whole tokens that may start there, the longest first."""

    def __init__(self, whole: dict[str, int]) -> None:
        super().__init__()
        self.whole = whole
        self.longer: dict[str, set[int]] = {}
        for signs in whole:
            if len(signs) > HEAD:
                self.longer.setdefault(signs[:HEAD], set()).add(len(signs))
        held("bpe", self)

    def __missing__(self, head: str) -> tuple[int, ...]:
        if len(self) >= HEADS:
            self.clear()
        found = {k for k in range(1, len(head) + 1) if head[:k] in self.whole} | self.longer.get(head, set())
        lengths = self[head] = tuple(sorted(found, reverse=True))
        return lengths


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted are in sorted keys, and which of them are there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class SideBySide:
    """The transducers of many words at once, as arrays, a sign a step. Words with a common beginning share their
    states, for the token that ends at a sign depends only on what has been read.

    Whole tokens (bytes as codes, and END_CODE for the suffix) make a tree whose nodes link to their longest tails
    in it. So each state knows the tokens that end there, the longest first; the one that stays apart from the token
    before it is the encoding's.
    """

    END_CODE, CODES = 256, 257

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        code = {sign: b for b, sign in enumerate(byte_signs())} | {END_SIGN: self.END_CODE}
        tokens = list(v.whole)
        sizes = np.array([len(t) for t in tokens])
        codes = np.array([code[sign] for t in tokens for sign in t], np.int64)
        ends = np.cumsum(sizes)
        self.edges, node_at, levels, _ = self._tree(codes, ends - sizes, ends)
        nodes = len(self.edges) + 1
        self.token = np.full(nodes, -1)
        self.token[node_at[ends - 1]] = list(v.whole.values())
        self.depth, self.tail, self.said, self.less = (np.zeros(nodes, np.int64) for _ in range(4))
        for depth, (a, b) in enumerate(levels, 1):
            key = self.edges[a - 1 : b - 1]
            self.depth[a:b] = depth
            if depth > 1:
                self.tail[a:b] = self._next(self.tail[key // self.CODES], key % self.CODES)
            self.less[a:b] = self.said[self.tail[a:b]]
            self.said[a:b] = np.where(self.token[a:b] >= 0, np.arange(a, b), self.less[a:b])
        joins = sorted(v.joins.items())
        self.joins, self.join_rank = np.array([k for k, _ in joins], np.int64), np.array([r for _, r in joins], np.int64)
        self.left, self.right, self.rank = (np.array(x, np.int64) for x in (v.left, v.right, v.rank))
        #: Codes of each token.
        self.size = np.ones(v.count, np.int64)
        self.size[list(v.whole.values())] = sizes

    @classmethod
    def _tree(cls, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], np.ndarray]:
        """Of words in codes: the sorted keys (node * CODES + code) that lead to nodes 1, 2 and so on; the node at each
        code; the nodes of each depth; and a place in codes for each node."""
        keys, levels, places = [np.zeros(0, np.int64)], [], [np.zeros(1, np.int64)]
        node_at, node, words, count, depth = np.zeros(len(codes), np.int64), np.zeros(len(starts), np.int64), np.arange(len(starts)), 1, 0
        while len(words := words[starts[words] + depth < ends[words]]):
            at = starts[words] + depth
            key, first, back = np.unique(node[words] * cls.CODES + codes[at], return_index=True, return_inverse=True)
            node[words] = node_at[at] = count + back
            keys.append(key)
            places.append(at[first])
            levels.append((count, count + len(key)))
            count, depth = count + len(key), depth + 1
        return np.concatenate(keys), node_at, levels, np.concatenate(places)

    def _next(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The longest tail, in the tree, of each state and a further code."""
        out, open_ = np.zeros(len(state), np.int64), np.arange(len(state))
        while len(open_):
            at, found = _find(self.edges, state * self.CODES + code)
            out[open_[found]] = at[found] + 1
            go = ~found & (state > 0)
            state, code, open_ = self.tail[state[go]], code[go], open_[go]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Vocabulary.apart() of pairs."""
        out, open_, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), 1 << 40)
        while len(open_):
            at, found = _find(self.joins, a * self.v.count + b)
            crossing = found & (self.join_rank[at] < limit)
            out[open_[crossing]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossing & ((ra >= 0) | (rb >= 0))
            first = (ra > rb)[go]
            limit = np.where(first, ra[go], rb[go] + 1)
            a, b, open_ = np.where(first, self.right[a[go]], a[go]), np.where(first, b[go], self.left[b[go]]), open_[go]
        return out

    def cover(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        edges, node_at, levels, places = self._tree(codes, starts, ends)
        state, last = np.zeros(len(edges) + 1, np.int64), np.full(len(edges) + 1, -1)
        for depth, (a, b) in enumerate(levels, 1):
            key = edges[a - 1 : b - 1]
            state[a:b] = self._next(state[key // self.CODES], key % self.CODES)
            open_, told = np.arange(a, b), self.said[state[a:b]]
            while len(open_):
                if not told.all():
                    raise ValueError("no encoding: the vocabulary lacks a sign")
                token, back = self.token[told], depth - self.depth[told]
                before = np.where(back > 0, last[node_at[places[open_] - self.depth[told]]], -1)
                pair, of = np.unique(before * self.v.count + token, return_inverse=True)
                free = pair < 0
                free[~free] = self.apart(pair[~free] // self.v.count, pair[~free] % self.v.count)
                free = free[of]
                last[open_[free]] = token[free]
                open_, told = open_[~free], self.less[told[~free]]
        taken, words, at = [], np.arange(len(starts)), ends - 1
        while len(words):
            token = last[node_at[at]]
            taken.append((words, token))
            at = at - self.size[token]
            more = at >= starts[words]
            words, at = words[more], at[more]
        word, token = (np.concatenate([t[k] for t in taken[::-1]]) for k in (0, 1))
        return token[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(starts))


_BYTE_OF = {sign: byte for byte, sign in enumerate(byte_signs())}


class Vocabulary:
    """Tokens, merges by rank, and the lookahead that suffices for them.

    ``lookahead``: a merge of left and right at rank r can be undone from its right edge only by a merge of
    lower rank whose left part ends there, which in turn needs its own right part and what may undo that. With
    g(m) the signs to the right of merge m that bear on its right edge, g(m) is the most, over merges m' of
    lower rank whose left part is on the right spine of m's right part, of len(right of m') + g(m'). One pass
    over the merges by rank computes it. A token edge that lies this far behind the last sign read is final.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = _pattern(split["pattern"]["Regex"])
        self.strings = {i: t for t, i in {**self.ids, **self.added}.items()}
        self.merges = {tuple(m): r for r, m in enumerate(tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"])}
        self.size = {t: len(t.removesuffix(self.suffix)) or 1 for t in self.ids} if self.suffix else {t: len(t) for t in self.ids}
        parts: dict[str, tuple[str, str]] = {}
        reach: dict[str, int] = {}

        def edge(token: str) -> int:
            most = 0
            while True:
                most = max(most, reach.get(token, 0))
                if token not in parts:
                    return most
                token = parts[token][1]

        for left, right in self.merges:
            reach[left] = max(reach.get(left, 0), self.size.get(right, 1) + edge(right))
            parts.setdefault(left + right, (left, right))
        self.lookahead = max((edge(t) for t in self.ids), default=0)
        self.longest = max(self.size.values(), default=1)
        self.text_of = {i: t for t, i in self.ids.items()}
        #: By id: the two tokens whose merge gives the token, and the merge's rank; -1 for single signs.
        count = max(self.ids.values(), default=0) + 1
        self.left, self.right, self.rank = ([-1] * count for _ in range(3))
        self.joins = {self.ids[a] * count + self.ids[b]: r for (a, b), r in self.merges.items() if a in self.ids and b in self.ids}
        self.count = count
        for token, (a, b) in parts.items():
            if token in self.ids and a in self.ids and b in self.ids:
                i = self.ids[token]
                self.left[i], self.right[i], self.rank[i] = self.ids[a], self.ids[b], self.merges[a, b]
        #: The tokens that their own signs merge to, with one END_SIGN for the suffix; and the lengths that such
        #: a token may have where HEAD given signs come next.
        self.whole: dict[str, int] = {}
        ready = {i for t, i in self.ids.items() if self.size[t] == 1}
        for token in parts:
            i = self.ids.get(token, -1)
            if i >= 0 and self.left[i] in ready and self.right[i] in ready and self._grows(i):
                ready.add(i)
        for i in ready:
            signs = self.text_of[i]
            if self.suffix and signs.endswith(self.suffix):
                signs = signs.removesuffix(self.suffix) + END_SIGN
            self.whole[signs] = i
        self.lengths = _Lengths(self.whole)
        self.side = SideBySide(self)
        self.known_apart: dict[int, bool] = held("bpe", {})

    def _grows(self, token: int) -> bool:
        """Whether nothing joins over the edge of the token's two parts before both are whole."""
        rank, joins, count = self.rank, self.joins, self.count
        a, b = self.left[token], self.right[token]
        while True:
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra >= rank[token] or rb >= rank[token]:
                return False
            if ra > rb:
                a, grow = self.right[a], ra
            else:
                b, grow = self.left[b], rb + 1
            crossing = joins.get(a * count + b)
            if crossing is not None and crossing < grow:
                return False

    def apart(self, a: int, b: int) -> bool:
        """Whether two tokens next to each other stay two, that is, no merge crosses the edge between them.

        Both sides are unfolded from the edge, the merge of higher rank first; a crossing merge wins if its
        rank is lower than those by which the tokens at the edge grow on. The answer is kept, within a bound.
        """
        rank, joins, count = self.rank, self.joins, self.count
        key, limit, free = a * count + b, len(rank) + len(joins), True
        while True:
            crossing = joins.get(a * count + b)
            if crossing is not None and crossing < limit:
                free = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                a, limit = self.right[a], ra
            else:
                # The same merge on both sides: the left one is made first.
                b, limit = self.left[b], rb + 1
        if len(self.known_apart) >= APART_PAIRS:
            self.known_apart.clear()
        self.known_apart[key] = free
        return free

    def cover(self, signs: str, before: int = -1) -> list[int]:
        """The encoding of signs after the token ``before``: of all sequences of whole tokens that make up the
        signs, the one in which neighbours stay apart, of which there is just one.

        The longest token that stays apart from the one before it is taken first. Where none fits, the last
        one taken is given back. At most one token of an encoding ends at a place, so a place that was left
        once is never tried again, and the work is linear in the signs.
        """
        whole, lengths, known, count = self.whole, self.lengths, self.known_apart, self.count
        n, at, left = len(signs), 0, before
        out: list[int] = []
        starts: list[int] = []
        # The suffix is part of the last sign, so no token ends before it.
        left_places = {n - 1} if signs.endswith(END_SIGN) else set()
        most = n + 1
        while at < n:
            for size in lengths[signs[at : at + HEAD]]:
                end = at + size
                if size < most and end <= n and end not in left_places:
                    token = whole.get(signs[at:end])
                    if token is not None:
                        if left < 0:
                            break
                        free = known.get(left * count + token)
                        if free or free is None and self.apart(left, token):
                            break
            else:
                if not starts:
                    raise ValueError("no encoding: the vocabulary lacks a sign")
                left_places.add(at)
                most = at - starts[-1]
                at = starts.pop()
                out.pop()
                left = out[-1] if out else before
                continue
            out.append(token)
            starts.append(at)
            at, left, most = end, token, n + 1
        return out


class Transducer:
    """Signs in, token ids out. Holds the signs since the last final edge, 2 * (lookahead + longest) at most and
    those of one push; a token is given out once it ends lookahead signs before the last sign but one, for the
    last may still be the word's last, which another sign stands for."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.signs = ""
        self.before = -1

    def push(self, more: Iterable[str]) -> list[int]:
        """Take some signs; give the tokens that have become final."""
        self.signs += more if isinstance(more, str) else "".join(more)
        if len(self.signs) <= 2 * (self.v.lookahead + self.v.longest):
            return []
        final, at, done = len(self.signs) - 1 - self.v.lookahead, 0, []
        for token in self.v.cover(self.signs[:-1], self.before):
            size = self.v.size[self.v.text_of[token]]
            if at + size > final:
                break
            at += size
            done.append(token)
        if done:
            self.signs, self.before = self.signs[at:], done[-1]
        return done

    def finish(self) -> list[int]:
        """The tokens of what is left, at the end of a word; then ready for another one."""
        out = self.v.cover(self.signs + END_SIGN if self.v.suffix else self.signs, self.before) if self.signs else []
        self.signs, self.before = "", -1
        return out


class Encoder:
    """Texts to ids, a slice at a time; words are looked up in a bounded cache first."""

    def __init__(self, path: str) -> None:
        self.v = Vocabulary(path)
        #: Signs by byte. Those of printable ASCII are the characters themselves.
        self.signs = byte_signs()
        self.machine = Transducer(self.v)
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.v.added, key=len, reverse=True)) + ")") if self.v.added else None
        self.white = re.compile(f"[{WHITE}]+")

    def word(self, word: str) -> list[int]:
        """The ids of one word, streamed through the transducer a few signs at a time."""
        out: list[int] = []
        for at in range(0, len(word), CACHED_CHARS):
            part = word[at : at + CACHED_CHARS]
            out += self.machine.push(part if part.isascii() and part.isprintable() else part.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.signs))
        return out + self.machine.finish()

    def piece(self, piece: str) -> list[int]:
        """The ids of a normalised piece without white space."""
        out: list[int] = []
        for m in self.v.pattern.finditer(piece):
            out += self.word(m.group())
        return out

    def normalise(self, text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # sign by sign, so no final sigma
        return text.lower()

    def pieces(self, text: str) -> Iterator[list[str] | list[int]]:
        """Normalised pieces without white space, a slice's at once, and the ids of added tokens between them."""
        parts = self.split_added.split(text) if self.split_added and any(t in text for t in self.v.added) else [text]
        for part in parts:
            if part in self.v.added:
                yield [self.v.added[part]]
                continue
            at = 0
            while at < len(part):
                end = min(len(part), at + SLICE_CHARS)
                while end < len(part) and not self.white.match(part[end]):
                    end += 1
                block = self.normalise(part[at:end])
                yield block.split() if block.isascii() and not any(c in block for c in "\x1c\x1d\x1e\x1f") else [*filter(None, self.white.split(block))]
                at = end

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for block in self.pieces(text):
            for piece in block:
                out += [piece] if isinstance(piece, int) else self.piece(piece)
        return out


class Decoder:
    """Ids to text, as they come. The file names no decoder, so the library's text is the tokens' own strings
    with a space between; ``plain`` gives words instead: byte signs to bytes, word ends to spaces, bytes to
    code points by an incremental UTF-8 machine that holds what may still become one."""

    def __init__(self, vocabulary: Vocabulary, plain: bool = False) -> None:
        self.v, self.plain, self.started = vocabulary, plain, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.added = set(vocabulary.added.values())

    def feed(self, ids: Iterable[int]) -> str:
        strings = self.v.strings
        if not self.plain:
            out = [strings[i] for i in ids if i in strings]
            if not out:
                return ""
            if self.started:
                out[0] = " " + out[0]
            self.started = True
            return " ".join(out)
        out = []
        for i in ids:
            token = strings.get(i)
            if token is None:
                continue
            if i in self.added:
                out.append(self.utf8.decode(token.encode()))
            else:
                ends = bool(self.v.suffix) and token.endswith(self.v.suffix)
                data = bytes(_BYTE_OF[c] for c in (token.removesuffix(self.v.suffix) if ends else token))
                out.append(self.utf8.decode(data + b" " * ends))
        return "".join(out)

    def finish(self) -> str:
        self.started = False
        return self.utf8.decode(b"", True) if self.plain else ""


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker and vocabulary."""
    return Encoder(path)


class Coder(dict):
    """By piece: its ids, as bytes, and their decoded bytes. Of up to CACHE_WORDS short pieces, those are kept that
    were in use since half as many others were new; longer ones are coded each time."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.enc = encoder(path)
        self.decoder = Decoder(self.enc.v)
        self.splits = re.compile(self.enc.v.pattern.pattern + "|\n")
        self.before: dict[str | int, tuple[bytes, bytes]] = held("bpe", {})
        held("bpe", self)

    def _coded(self, ids: list[int]) -> tuple[bytes, bytes]:
        return struct.pack(f"<{len(ids)}I", *ids), (self.decoder.feed(ids) + self.decoder.finish()).encode()

    def __missing__(self, piece: str | int) -> tuple[bytes, bytes]:
        known = self.before.get(piece)
        if known is None:
            known = self._coded([piece] if isinstance(piece, int) else self.enc.piece(piece))
            if not isinstance(piece, int) and len(piece) > CACHED_CHARS:
                return known
        self._make_room(1)
        self[piece] = known
        return known

    def _make_room(self, pieces: int) -> None:
        if len(self) + pieces > CACHE_WORDS // 2:
            self.before.clear()
            self.before.update(self)
            self.clear()

    def learn(self, pieces: Iterable[str | int]) -> None:
        """Code all short new pieces at once; the others stay known until the next call."""
        wanted = [p for p in set(pieces) if p not in self and not isinstance(p, int) and len(p) <= CACHED_CHARS]
        known = [(p, self.before[p]) for p in wanted if p in self.before]
        self._make_room(len(wanted))
        self.update(known)
        new = [p for p in wanted if p not in self]
        if not new:
            return
        words: list[str] = []
        upto = []
        for word in self.splits.findall("\n".join(new)):
            if word == "\n":
                upto.append(len(words))
            else:
                words.append(word)
        upto.append(len(words))
        if not words:
            self.update((p, (b"", b"")) for p in new)
            return
        raw = np.frombuffer(("\n".join(words) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
        over = np.flatnonzero(raw == 10)
        codes = raw.astype(np.int64)
        codes[over] = SideBySide.END_CODE
        ids, counts = self.enc.v.side.cover(codes, np.append(0, over[:-1] + 1), over + 1 if self.enc.v.suffix else over)
        ends = np.append(0, np.cumsum(counts))[upto].tolist()
        data, plain, start, coded = ids.astype("<u4").tobytes(), ids.tolist(), 0, []
        feed, finish = self.decoder.feed, self.decoder.finish
        for end in ends:
            coded.append((data[4 * start : 4 * end], (feed(plain[start:end]) + finish()).encode()))
            start = end
        self.update(zip(new, coded, strict=True))


@functools.lru_cache(maxsize=2)
def _coder(path: str) -> Coder:
    return Coder(path)


def code_texts(texts: Iterable[str], path: str, kept: list[bytes] | None = None) -> list[tuple[int, str, str]]:
    """n_tokens, ids_sha256, decoded_sha256 of each text; kept gets the ids themselves, as bytes.

    Pieces are coded and digested together, HELD_CHARS of texts at a time, whether of many texts or of a long one.
    """
    coder = _coder(path)
    rows: list[list] = []
    waiting: list[tuple[int, list]] = []
    chars = 0

    def flush() -> None:
        coder.learn(p for _, block in waiting for p in block)
        for k, block in waiting:
            row = rows[k]
            ids, said = zip(*map(coder.__getitem__, block), strict=True)
            joined = b"".join(ids)
            row[0] += len(joined) // 4
            row[1].update(joined)
            if kept is not None:
                kept.append(joined)
            if b"" in said:
                said = [x for x in said if x]
            if said:
                row[2].update((b" " if row[3] else b"") + b" ".join(said))
                row[3] = True
        waiting.clear()

    for k, text in enumerate(texts):
        rows.append([0, hashlib.sha256(), hashlib.sha256(), False])
        for block in coder.enc.pieces(text):
            if block:
                waiting.append((k, block))
                chars += min(len(text), SLICE_CHARS)
                if chars >= HELD_CHARS:
                    flush()
                    chars = 0
    flush()
    return [(n, id_hash.hexdigest(), text_hash.hexdigest()) for n, id_hash, text_hash, _ in rows]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with a further column ``tokens`` array<int>, the ids of ``text``; null text is empty."""

    @F.pandas_udf("array<int>")
    def ids(text):
        return text.map(lambda x: encoder(path).encode(x))

    return docs.withColumn("tokens", ids(F.coalesce("text", F.lit(""))))


def decode(tokens: DataFrame, path: str, plain: bool = True) -> DataFrame:
    """tokens with a further column ``decoded``, the text of the ids in ``tokens``; null gives the empty text."""

    @F.pandas_udf("string")
    def text(ids):
        def one(x):
            machine = Decoder(encoder(path).v, plain)
            return machine.feed(x if x is not None else ()) + machine.finish()

        return ids.map(one)

    return tokens.withColumn("decoded", text("tokens"))


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """For each row of docs (doc_id, source, text): doc_id, source, tokens, n_tokens, decoded_sha256.

    Texts are coded as in code_digests(), with the ids themselves. Null and empty texts have no tokens. Rows stay as they are, repeated and null doc_ids
    too; an empty table gives no rows.
    """

    def code(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens: list[bytes] = []
        rows = code_texts(batch.column(2).to_pylist(), path, tokens)
        ends = np.concatenate(([0], np.cumsum([r[0] for r in rows]))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(tokens), "<i4")))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), ids, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows])], names=["doc_id", "source", "tokens", "n_tokens", "decoded_sha256"]
        )

    kinds = [docs.schema[c].dataType.simpleString() for c in ("doc_id", "source")]
    return map_batches(
        docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")), code, f"doc_id {kinds[0]}, source {kinds[1]}, tokens array<int>, n_tokens long, decoded_sha256 string",
        by="text", operator="bpe",
    )


def code_digests(docs: DataFrame, path: str) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text is empty: no tokens, digests of nothing. Rows are coded one by one; repeats get equal rows.
    Further columns are not read. An empty table gives no rows.
    """

    def code(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = code_texts(batch.column(1).to_pylist(), path)
        columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), code, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", by="text", operator="bpe")
