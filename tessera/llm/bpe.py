"""Byte-level BPE encoding by speculation and verification, and decoding.

A word is first cut greedily into the longest tokens. A sequence of tokens is the true encoding exactly
when every adjacent pair is compatible: replaying the merges of both tokens, no merge across their
border would have come first. That is checked for all pairs of a batch at once, and only words with an
incompatible pair are merged step by step in rank order.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import named, received, sent

NO_MERGE = 1 << 62
NEVER = np.int64(NO_MERGE >> 32)
# New words after which a worker forgets those it has not met lately (it remembers twice as many), and
# characters of the texts it handles at once.
MEMO_WORDS = 200_000
BLOCK_CHARS = 1 << 20
SHORT_WORD = 32  # bytes of a word that is merged together with others

# Classes of characters that words are made of.
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# Endings that are words of their own after an apostrophe.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def character_classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            for lo, hi in ((m.start(), min(m.end(), 0xD800)), (max(m.start(), 0xD800), m.end())):
                if lo < hi:
                    shift = 0 if lo < 0xD800 else 0x800
                    out[lo + shift:hi + shift] = kind
    return out


def word_starts(text: str, classes: np.ndarray) -> np.ndarray:
    """Where the words of a text begin.

    Words are runs of letters, numbers or other signs, with one space in front if there is one; runs
    of white space without that space; and English endings after an apostrophe that begins a word.
    """
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    n = len(code)
    kind = classes[code]
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    # the last of a run of white space goes to the next word if it is a space, else stands alone
    last = np.flatnonzero((kind[:-1] == SPACE) & begin[1:])
    begin[last] = True
    begin[last[code[last] == 0x20] + 1] = False
    mark = np.flatnonzero((code[:-1] == 0x27) & begin[:-1] & (kind[1:] == LETTER))
    if len(mark):
        ends = np.append(code, np.zeros(3, code.dtype))
        kinds = np.append(kind, np.full(3, SPACE, kind.dtype))
        first, second = ends[mark + 1], ends[mark + 2]
        short = np.isin(first, [ord(c) for c in SHORT_ENDINGS])
        long = np.zeros(len(mark), bool)
        for a, b in LONG_ENDINGS:
            long |= (first == ord(a)) & (second == ord(b))
        for hit, size in ((short, 1), (long, 2)):
            at = mark[hit]
            begin[at + 1] = False
            rest = at + 1 + size
            rest = rest[kinds[rest] == LETTER]
            begin[rest] = True
    return np.flatnonzero(begin)


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE, as arrays of the vocabulary's size."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids: dict[bytes, int] = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in self.special:
                self.ids[bytes(of[c] for c in token)] = i
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.length = np.fromiter(map(len, self.bytes), np.int64, size)
        self.offset = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        # rank of the merge that makes a token (-1: a byte), and the two tokens it joins
        self.born = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        pairs = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = bytes(of[c] for c in a), bytes(of[c] for c in b)
            i, j, made = self.ids[a], self.ids[b], self.ids[a + b]
            pairs.append((i, j, made))
            if self.born[made] < 0:
                self.born[made], self.left[made], self.right[made] = rank, i, j
        self.merge = {(i, j): (rank, made) for rank, (i, j, made) in reversed(list(enumerate(pairs)))}
        # the same with one number for the pair, and one for rank and token
        self.coded = {i << 32 | j: rank << 32 | made for (i, j), (rank, made) in self.merge.items()}
        self.of_byte = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int64)
        self._hash(np.array(list(self.coded), np.int64), np.array(list(self.coded.values()), np.int64))
        # lengths of the tokens that begin with three given bytes, or are shorter, longest first
        begins: dict[bytes, set[int]] = {}
        for token in self.ids:
            begins.setdefault(token[:3], set()).add(len(token))
        short = {t for t in self.ids if len(t) < 3}
        self.sizes = {
            b: tuple(sorted(n | {k for k in (1, 2) if b[:k] in short}, reverse=True)) for b, n in begins.items()
        }
        self.short_sizes = (2, 1)
        whole = (self.born < 0) | self.compatible(self.left, self.right, self.born)
        for t in np.argsort(self.born, kind="stable"):  # parts come before the tokens they make
            if self.born[t] >= 0:
                whole[t] &= whole[self.left[t]] & whole[self.right[t]]
        self.whole = whole  # tokens that encode to themselves

    @property
    def encoder(self) -> Encoder:
        """This process's encoder: a broadcast vocabulary keeps it, and the words it knows, between tasks."""
        if "_encoder" not in self.__dict__:
            self._encoder = Encoder(self)
        return self._encoder

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_encoder"}

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open hash table of the merges, looked up for whole arrays."""
        self._bits = max(4, (4 * len(keys)).bit_length())
        size = 1 << self._bits
        self._keys, self._values = np.full(size, -1, np.int64), np.full(size, NO_MERGE, np.int64)
        left, slot, self._probes = np.arange(len(keys)), self._slot(keys), 0
        while len(left):
            at = (slot[left] + self._probes) % size
            free = np.flatnonzero(self._keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self._keys[at[won]], self._values[at[won]] = keys[left[won]], values[left[won]]
            left = np.delete(left, won)
            self._probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        h = (key ^ (key >> 15)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self._bits)).astype(np.int64)

    def merges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and token (in one number) of merging each pair; NO_MERGE without a merge."""
        key = (a << 32) | b
        slot = self._slot(key)
        out = np.full(len(key), NO_MERGE, np.int64)
        look = np.arange(len(key))
        for k in range(self._probes):
            at = (slot[look] + k) & ((1 << self._bits) - 1)
            seen = self._keys[at]
            hit = seen == key[look]
            out[look[hit]] = self._values[at[hit]]
            look = look[~hit & (seen >= 0)]
            if not len(look):
                break
        return out

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.merges(a, b) >> 32

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the border of tokens ``a``, ``b`` comes first (before rank ``until``).

        Walks back through the merges on both sides of the border, the later one first. ``x`` exists
        until the merge that takes it into a larger part of ``a``, ``y`` likewise; at the same rank
        the merge further left comes first.
        """
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        x, y = a[live].astype(np.int64), b[live].astype(np.int64)
        end_x = np.full(len(live), NEVER) if until is None else until[live].astype(np.int64)
        end_y = end_x.copy() if until is None else end_x - 1
        while len(live):
            r = self.rank(x, y)
            bad = (r < end_x) & (r <= end_y)
            ok[live[bad]] = False
            bx, by = self.born[x], self.born[y]
            go = ~bad & ((bx >= 0) | (by >= 0))
            back_x = bx > by
            end_x, end_y = np.where(back_x, bx, end_x), np.where(back_x, end_y, by)
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
            live, x, y, end_x, end_y = live[go], x[go], y[go], end_x[go], end_y[go]
        return ok

    def longest(self, word: bytes) -> list[int]:
        """Greedy cut into the longest tokens."""
        out, i, n = [], 0, len(word)
        token, sizes, short = self.ids.get, self.sizes.get, self.short_sizes
        while i < n:
            for size in sizes(word[i:i + 3], short):
                if i + size <= n and (t := token(word[i:i + size])) is not None:
                    out.append(t)
                    i += size
                    break
            else:
                raise ValueError(f"no token for byte {word[i]}")
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact encoding: the merge of the lowest rank first, of equal ranks the leftmost."""
        t = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(t))) + [-1], list(range(-1, len(t) - 1))
        alive = [True] * len(t)
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (hit := self.merge.get((t[i], t[j]))):
                heapq.heappush(heap, (hit[0], i, t[i], t[j]))

        for i in range(len(t)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or t[i] != a or t[j] != b:
                continue
            t[i] = self.merge[a, b][1]
            alive[j] = False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x, a in zip(t, alive) if a]

    def merged_many(self, words: Sequence[bytes]) -> list[list[int]]:
        """``merged`` of many words of at most SHORT_WORD bytes: one merge per word and step."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(size.max(initial=1))
        token = np.full((len(words), wide + 1), -1, np.int64)
        inside = np.arange(wide + 1) < size[:, None]
        token[inside] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        offer = np.full((len(words), wide), NO_MERGE, np.int64)
        pair = inside[:, 1:]
        offer[pair] = self.merges(token[:, :-1][pair], token[:, 1:][pair])
        out, live = token.copy(), np.arange(len(words))
        column = np.arange(wide)
        while True:
            at = offer.argmin(1)
            best = offer[np.arange(len(live)), at]
            go = best < NO_MERGE
            if not go.all():
                out[live[~go]], size[live[~go]] = token[~go], (token[~go] >= 0).sum(1)
                live, token, offer, at, best = live[go], token[go], offer[go], at[go], best[go]
            if not len(live):
                break
            row = np.arange(len(live))
            token[row, at] = best & 0xFFFFFFFF
            keep = column + (column > at[:, None])  # the next token goes, and the pair that was merged
            token[:, :wide] = np.take_along_axis(token, keep, 1)
            token[:, wide] = -1
            offer = np.take_along_axis(offer, np.minimum(column + (column >= at[:, None]), wide - 1), 1)
            offer[:, wide - 1] = NO_MERGE
            for to in (at - 1, at):
                has = np.flatnonzero((to >= 0) & (token[row, np.minimum(to + 1, wide)] >= 0))
                offer[has, to[has]] = self.merges(token[has, to[has]], token[has, to[has] + 1])
            gone = np.flatnonzero(token[row, np.minimum(at + 1, wide)] < 0)
            offer[gone, np.minimum(at[gone], wide - 1)] = NO_MERGE
        return [r[:n] for r, n in zip(out.tolist(), size.tolist())]

    def encode_words(self, words: Sequence[bytes]) -> list[list[int]]:
        """Tokens of distinct words: greedy, checked in one go, merged exactly where the check fails."""
        guess = [self.longest(w) for w in words]
        size = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(guess)), size)
        wrong = np.zeros(len(guess), bool)
        wrong[owner[~self.whole[flat]]] = True
        if len(flat) > 1:
            inside = owner[1:] == owner[:-1]
            pair, at = np.unique((flat[:-1][inside] << 32) | flat[1:][inside], return_inverse=True)
            fine = self.compatible(pair >> 32, pair & 0xFFFFFFFF)
            wrong[owner[:-1][inside][~fine[at]]] = True
        length = np.fromiter(map(len, words), np.int64, len(words))
        for least, most in ((0, 8), (8, 12), (12, 16), (16, SHORT_WORD)):
            some = np.flatnonzero(wrong & (length > least) & (length <= most)).tolist()
            for i, tokens in zip(some, self.merged_many([words[i] for i in some])):
                guess[i] = tokens
        for i in np.flatnonzero(wrong & (length > SHORT_WORD)).tolist():
            guess[i] = self.merged(words[i])
        return guess


class Encoder:
    """Encodes texts with a bounded memory of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.classes = character_classes()
        self._splitter = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self._forget()

    def _forget(self) -> None:
        """Start a new generation of words; those of the one before it are still known."""
        self._before = getattr(self, "_now", {})
        self._now: dict = {}
        live = sorted(set(self._before.values()))
        size = self._size[live] if live else np.empty(0, np.int64)
        begin = np.cumsum(size) - size
        old = self._begin[live] if live else begin
        at = np.repeat(old - begin, size) + np.arange(int(size.sum()))
        self._tokens = self._tokens[at] if live else np.empty(0, np.uint32)
        self._begin, self._size = begin, size
        place = {n: i for i, n in enumerate(live)}
        self._before = {w: place[n] for w, n in self._before.items()}

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        starts = word_starts(text, self.classes).tolist()
        return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]

    def _split(self, text: str) -> list[str]:
    
        if self._splitter is None or not self._splitter.search(text):
            return self._words(text)
        out, at = [], 0
        for m in self._splitter.finditer(text):
            out += [*self._words(text[at:m.start()]), ("special", m.group())]
            at = m.end()
        return out + self._words(text[at:])

    def _learn(self, words: list) -> None:
        plain = [w for w in words if isinstance(w, str)]
        tokens = dict(zip(plain, self.v.encode_words([w.encode() for w in plain])))
        coded = [tokens[w] if isinstance(w, str) else [self.v.special[w[1]]] for w in words]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((t for c in coded for t in c), np.uint32, int(size.sum()))
        self._begin = np.concatenate([self._begin, np.cumsum(size) - size + len(self._tokens)])
        self._size = np.concatenate([self._size, size])
        self._tokens = np.concatenate([self._tokens, flat])
        self._now.update(zip(words, range(len(self._size) - len(words), len(self._size))))

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Token ids of every text; NULL counts as empty."""
        out: list[np.ndarray] = []
        block: list[str] = []
        chars = 0
        for text in texts:
            block.append(text or "")
            chars += len(block[-1])
            if chars >= BLOCK_CHARS:
                out += self._block(block)
                block, chars = [], 0
        return out + self._block(block)

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        words = [self._split(t) for t in texts]
        if len(self._now) > MEMO_WORDS:
            self._forget()
        have, before = self._now, self._before
        count = np.fromiter(map(len, words), np.int64, len(words))
        flat = list(chain.from_iterable(words))
        number = np.fromiter(map(have.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(number < 0).tolist()
        if missing:
            need = dict.fromkeys(flat[i] for i in missing)
            have.update((w, before[w]) for w in need if w in before)
            self._learn([w for w in need if w not in before])
            number[missing] = [have[flat[i]] for i in missing]
        size = self._size[number]
        end = np.cumsum(size)
        at = np.repeat(self._begin[number] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)
        ids = self._tokens[at]
        cut = np.concatenate([[0], end])[np.cumsum(count)]
        return np.split(ids, cut[:-1]) if len(cut) else []


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """Text of token ids; bytes that are no UTF-8 become replacement characters."""
    return decoded_bytes(ids, v).decode("utf-8", errors="replace")


def decoded_bytes(ids: np.ndarray, v: Vocabulary) -> bytes:
    parts = []
    for lo in range(0, len(ids), 1 << 20):
        t = ids[lo:lo + (1 << 20)].astype(np.int64)
        size = v.length[t]
        end = np.cumsum(size)
        at = np.repeat(v.offset[t] - (end - size), size) + np.arange(int(end[-1]))
        parts.append(v.flat[at].tobytes())
    return b"".join(parts)


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the whole text of every row as little-endian unsigned 32-bit ids.

    Special tokens in a text become their ids. NULL and empty texts have no ids; a text of any length is
    encoded whole, also a single run of one sign; equal rows stay as many as they are; other columns are
    not read, whatever their names; an empty table gives an empty result. The vocabulary file is read on the driver and its tables,
    of the vocabulary's size, are broadcast.
    """
    shared = sent(docs.sparkSession, Vocabulary(vocabulary_path))

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = received(shared, Vocabulary).encoder
        for texts in batches:
            yield pd.Series([i.astype("<u4").tobytes() for i in encoder.encode(list(texts))], dtype=object)

    return docs.select(named(docs, id_col).alias("doc_id"), run(named(docs, text_col)).alias("ids"))


def round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, as ``encode`` and ``decode`` give them."""
    shared = sent(docs.sparkSession, Vocabulary(vocabulary_path))

    @F.pandas_udf("n long, ids string, text string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = received(shared, Vocabulary)
        encoder = v.encoder
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for texts in batches:
            rows = []
            for ids in encoder.encode(list(texts)):
                rows.append((len(ids), sha(ids.astype("<u4").tobytes()), sha(decode(ids, v).encode())))
            yield pd.DataFrame(rows, columns=["n", "ids", "text"])

    done = docs.select(named(docs, id_col).alias("doc_id"), run(named(docs, text_col)).alias("r"))
    return done.select("doc_id", F.col("r.n").alias("n_tokens"), F.col("r.ids").alias("ids_sha256"),
                       F.col("r.text").alias("decoded_sha256"))
