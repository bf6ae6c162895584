"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

P(word | h) = P(class | h) P(word | class, h). The most frequent words form classes by rank. All others
are one class, in which the digits of a word's hash are a path of further classes: P(word | class, h) is
the product over the digits, as many as the vocabulary asks for, and of the word's share of the counts at
the end of the path. Every level is a softmax that sums the weights of hashed features of the two words
before: the bigram and the skip over one word, and for classes and frequent words also both together.

Counts cover every learnable text. Texts are tokenized once more into chunks by a hash of the document, so
chunks are the same for any layout of the files. Training is distributed: in each round every chunk of that
round makes gradient updates from the shared weights, and the changes of a row are averaged by the tokens
that met it. The first digits name a shard. What comes after them is never shared: the tokens of a shard
meet in one task, which learns the weights below the shard and scores with them, so shards and weights
follow the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import named, received, remainder, sent
from tessera.llm.rows import FILE, ROW, located, written

HELD_OUT_MOD, HELD_OUT_REST = 7, 2
CLASSES, MEMBERS = 16, 32  # classes of frequent words, and words in each
RARE = CLASSES  # number of the class of all other words
# Words whose counts every task knows; each other one is at most a 300,000th of the corpus.
KNOWN_WORDS = 300_000
BITS = 32  # of the hash of a word; words that agree in it are one to the levels below RARE
LEAST_CODE = 1 << 19  # hashes begin here, numbers of known words are below
DIGIT_BITS = 3
BRANCH = 1 << DIGIT_BITS
SHARD_TOKENS = 1 << 20  # rare tokens of a group of shards, which meet in a task, at most on average
MOST_DIGITS = 5  # that name a shard; beyond, shards are parted by context
CONTEXT_BITS = 24  # of the hash of a rare word as a context
START = (1 << CONTEXT_BITS) - 1  # the context before the first word
FEATURES, PATH_FEATURES = 3, 2
# Rows of a shared table: one for so many tokens, between two bounds; the upper one keeps a broadcast small.
ROW_TOKENS, LEAST_ROWS, MOST_ROWS = 1 << 13, 1 << 14, 1 << 17
SHARD_ROW_TOKENS, LEAST_SHARD_ROWS = 4, 1 << 12  # the same for the table of a shard, without an upper bound
END_TOKENS = 64  # counted tokens at the end of a path, on average
EMPTY = 1e-6  # in place of a count of 0 where the levels of a path start
ROUNDS = 2
CHUNK_TOKENS = 1 << 20  # of a chunk, on average; it makes an update every STEP_TOKENS
PIECE_TOKENS = 1 << 18  # a longer text takes several rows
MOST_PIECES = 1 << 15  # texts in a chunk
STEP_TOKENS = 1 << 15
TASKS_PER_CORE = 2
RATE, DAMPING, L2 = 0.3, 2.0, 1e-3
ROW_BLOCK = 1 << 11  # rows of a table that are updated at once, while they are in the cache
SPLIT_BYTES = 1 << 23  # of text split into words at once; a longer text is alone
COUNTED_BYTES = 1 << 25  # of words counted at once
HELD_BYTES = 1 << 25  # of distinct words and their counts that a task keeps
SALTS = 4
BLOCK_VALUES = 1 << 14  # weights sent in one row when tasks' changes are added
END = b""  # the token after the last word; no word is empty


def power_of_two(x: float) -> int:
    """The least one that is not below ``x``."""
    return 1 << max(0, int(np.ceil(x)) - 1).bit_length()


def table_rows(tokens: int) -> int:
    return min(MOST_ROWS, max(LEAST_ROWS, power_of_two(tokens / ROW_TOKENS)))


class Weights:
    """The shared tables: hashed feature -> class, feature and class -> member, feature and path -> digit."""

    def __init__(self, rows: int = LEAST_ROWS, flat: np.ndarray | None = None):
        widths = (CLASSES + 1, MEMBERS, BRANCH)
        flat = np.zeros(rows * sum(widths), np.float32) if flat is None else flat.astype(np.float32)
        parts = np.split(flat, np.cumsum(widths)[:-1] * rows)
        self.rows = rows
        self.tables = self.of_class, self.of_word, self.of_digit = tuple(x.reshape(rows, -1) for x in parts)

    def flat(self) -> np.ndarray:
        return np.concatenate([t.ravel() for t in self.tables])


def code_of(words: Iterable[bytes], n: int) -> np.ndarray:
    code = np.fromiter(map(crc32, words), np.int64, n)
    return np.where(code < LEAST_CODE, code + LEAST_CODE, code)


def rare_context(code: np.ndarray) -> np.ndarray:
    """Number of a rare word as a context, above those of frequent words."""
    n = CLASSES * MEMBERS
    return n + code % (START - n)


def path_nodes(code: np.ndarray, skip: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, level): number of the node among those of all levels, and the digit chosen there.

    The path of ``depth`` digits begins after the first ``skip`` digits.
    """
    node, digit = np.empty((len(code), depth), np.int64), np.empty((len(code), depth), np.int64)
    for k in range(depth):
        before = (code >> (BITS - DIGIT_BITS * (skip + k))) & ((1 << DIGIT_BITS * k) - 1)
        node[:, k] = before + ((1 << DIGIT_BITS * k) - 1) // (BRANCH - 1)
        digit[:, k] = (code >> (BITS - DIGIT_BITS * (skip + k + 1))) & (BRANCH - 1)
    return node, digit


def path_bias(tokens: np.ndarray, depth: int) -> np.ndarray:
    """(node, digit): log of the digit's share, from the smoothed counts at the ends of all paths."""
    levels = []
    for _ in range(depth):
        levels.append(np.maximum(tokens.reshape(-1, BRANCH), EMPTY))
        tokens = tokens.reshape(-1, BRANCH).sum(1)
    out = np.concatenate(levels[::-1]) if levels else np.ones((0, BRANCH))
    return np.log(out / out.sum(1, keepdims=True)).astype(np.float32)


@dataclass
class Lexicon:
    """Known words in order of frequency with their counts, and the totals of the corpus."""

    words: list[str]
    counts: np.ndarray
    tokens: int  # N
    distinct: int  # V
    digits: int = 0  # of the hash that name a shard
    digit_bias: np.ndarray = field(default_factory=lambda: path_bias(np.zeros(1), 0))
    parts: dict[int, int] = field(default_factory=dict)  # parts of the shards that have more than the others
    least_parts: int = 1  # of every other shard
    shared_shards: int = 1  # neighbouring shards that meet in one task

    def __post_init__(self):
        n = CLASSES * MEMBERS
        self.rare_tokens = self.tokens - int(self.counts[:n].sum())
        self.rare_distinct = self.distinct - min(n, len(self.words))
        if len(self.words) > LEAST_CODE:
            raise ValueError(f"at most {LEAST_CODE} words can be known")
        self.log_count = np.log10(self.counts + 1.0)
        self.code = code_of((w.encode() for w in self.words), len(self.words))
        self.context = np.where(np.arange(len(self.words)) < n, np.arange(len(self.words)), rare_context(self.code))
        # logs of the shares of the classes and of the words in their class: where training starts
        known = self.counts[:n].astype(float)
        classes = np.zeros(CLASSES + 1)
        classes[: CLASSES] = np.bincount(np.arange(len(known)) // MEMBERS, known, CLASSES)
        classes[RARE] = self.rare_tokens
        self.class_bias = np.log((classes + 1) / (classes + 1).sum()).astype(np.float32)
        padded = np.full(n, -np.inf)
        padded[: len(known)] = np.log(known + 1)
        padded = padded.reshape(CLASSES, MEMBERS)
        padded -= np.log(np.maximum(np.exp(padded).sum(1, keepdims=True), 1e-300))
        self.word_bias = np.maximum(padded, -1e4).astype(np.float32)

    @cached_property
    def number(self) -> dict[bytes, int]:
        return {w.encode(): i for i, w in enumerate(self.words)}


def context_hashes(one: np.ndarray, two: np.ndarray, features: int) -> np.ndarray:
    """(feature, token): hashes of the word before ``one``, of the one before that ``two``, and of both."""
    a, b = one.astype(np.uint64), two.astype(np.uint64)
    out = np.empty((features, len(a)), np.uint64)
    for k, x in enumerate((a * np.uint64(2) + np.uint64(1), b * np.uint64(2), (a + np.uint64(1)) * np.uint64(1_000_003) + b + np.uint64(7))[:features]):
        h = (x + np.uint64(k * 0x9E3779B1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        out[k] = h
    return out


def salted_rows(hashes: np.ndarray, salt: np.ndarray | int, size: int) -> np.ndarray:
    """(feature, token): table rows of hashed features under a salt; ``size`` is a power of two."""
    h = hashes ^ (np.asarray(salt).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h >>= np.uint64(65 - int(size).bit_length())
    return h.view(np.int64)


def _exp(z: np.ndarray) -> np.ndarray:
    """exp in place; biases are logs of shares and weights are small, the bound is for safety."""
    np.minimum(z, 60, out=z)
    return np.exp(z, out=z)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = _exp(z)
    p /= _row_sums(p)[:, None]
    return p


def _row_sums(p: np.ndarray) -> np.ndarray:
    """A product with ones adds up short rows faster than a reduction."""
    return p @ np.ones(p.shape[1], p.dtype)


def _log10_share(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """log10 of the softmax at the chosen column."""
    p = _exp(z)
    return np.log10(np.maximum(p[np.arange(len(p)), chosen] / _row_sums(p), 1e-30))


class Batch:
    """Contexts and classes of the tokens of some pieces; ``lead`` tokens before each are contexts only.

    ``times``: how often a piece occurs; equal pieces of a chunk are one.
    """

    def __init__(self, token: np.ndarray, size: np.ndarray, lead: np.ndarray, times: np.ndarray, lexicon: Lexicon):
        n = CLASSES * MEMBERS
        token = token.astype(np.int64)
        known = token < LEAST_CODE
        seen = np.where(known, token, 0)
        words = len(lexicon.words)
        context = np.where(known, lexicon.context[seen], rare_context(token)) if words else rare_context(token)
        one, two = np.empty_like(context), np.empty_like(context)
        one[1:], two[2:] = context[:-1], context[:-2]
        begin = np.cumsum(size) - size
        one[begin] = START
        two[begin] = START
        two[begin[size > 1] + 1] = START
        mine = np.ones(len(token), bool)  # not a leading token
        for k in (0, 1):
            mine[begin[lead > k] + k] = False
        self.one, self.two, self.token = one[mine], two[mine], token[mine]
        known, seen = known[mine], seen[mine]
        self.code = np.where(known, lexicon.code[seen], self.token) if words else self.token
        self.frequent = known & (self.token < n)
        self.klass = np.where(self.frequent, self.token // MEMBERS, RARE)
        self.member = self.token % MEMBERS
        self.owner = np.repeat(np.arange(len(size)), size - lead)
        self.times = times[self.owner]


def _summed_rows(table: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = table.take(rows[0], 0)
    z += bias
    more = np.empty_like(z)
    for r in rows[1:]:
        z += table.take(r, 0, out=more, mode="clip")  # rows are in range; the mode that raises would copy
    return z


def _class_logits(w: Weights, lex: Lexicon, b: Batch, s: slice) -> tuple[np.ndarray, np.ndarray]:
    rows = salted_rows(context_hashes(b.one[s], b.two[s], FEATURES), 0, len(w.of_class))
    return rows, _summed_rows(w.of_class, rows, lex.class_bias)


def _word_logits(w: Weights, lex: Lexicon, b: Batch, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    klass = b.klass[at]
    rows = salted_rows(context_hashes(b.one[at], b.two[at], FEATURES), klass + 1, len(w.of_word))
    return rows, _summed_rows(w.of_word, rows, lex.word_bias.take(klass, 0))


def path_logits(
    table: np.ndarray, bias: np.ndarray, one: np.ndarray, two: np.ndarray, code: np.ndarray, skip: int, depth: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows, logits and chosen digit of every level of every token, the levels of a token one after another."""
    node, digit = (x.ravel() for x in path_nodes(code.astype(np.int64), skip, depth))
    rows = salted_rows(np.repeat(context_hashes(one, two, PATH_FEATURES), depth, axis=1), node + 1, len(table))
    return rows, _summed_rows(table, rows, bias.take(node, 0)), digit


def log10_probs(w: Weights, lex: Lexicon, b: Batch) -> np.ndarray:
    """Per token; a rare word only as far as its class."""
    out = np.empty(len(b.token))
    for lo in range(0, len(out), STEP_TOKENS):
        s = slice(lo, min(lo + STEP_TOKENS, len(out)))
        out[s] = _log10_share(_class_logits(w, lex, b, s)[1], b.klass[s])
        at = np.flatnonzero(b.frequent[s]) + lo
        if len(at):
            out[at] += _log10_share(_word_logits(w, lex, b, at)[1], b.member[at])
    return out


def _update(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, p: np.ndarray) -> None:
    """One step of AdaGrad on sums, damped so that rare features move little; ``p``: softmax minus the truth."""
    size, width = table.shape
    # columns lie apart by no power of two, or they would push each other out of the cache
    error, sums = np.empty((width, len(p) + 16))[:, :len(p)], np.empty((width, size + 16), np.float32)
    for lo in range(0, len(p), ROW_BLOCK):
        error[:, lo:lo + ROW_BLOCK] = p[lo:lo + ROW_BLOCK].T
    total = np.empty(size)
    for c, e in enumerate(error):  # one column at a time stays in the cache
        total.fill(0)
        for r in rows:
            np.add.at(total, r, e)
        sums[c, :size] = total
    for lo in range(0, size, ROW_BLOCK):
        part, root = table[lo:lo + ROW_BLOCK], squares[lo:lo + ROW_BLOCK]
        g = np.ascontiguousarray(sums[:, lo:min(lo + ROW_BLOCK, size)].T)
        g += L2 * part
        step = g * g
        root += step
        np.sqrt(root, out=step)
        step += DAMPING
        g *= RATE
        g /= step
        part -= g


class Trainer:
    """Gradient updates of one chunk on a copy of the shared tables."""

    def __init__(self, start: Weights, lexicon: Lexicon):
        self.w, self.lex = Weights(start.rows, start.flat()), lexicon
        self.squares = [np.zeros_like(t) for t in self.w.tables]
        self.met = np.zeros((len(self.squares), start.rows))  # tokens that met a row

    def _step(self, table: int, rows: np.ndarray, z: np.ndarray, chosen: np.ndarray, times: np.ndarray) -> None:
        p = _softmax(z)
        p[np.arange(len(p)), chosen] -= 1
        once = times.max() == 1
        if not once:
            p *= times[:, None]
        _update(self.w.tables[table], self.squares[table], rows, p)
        self.met[table] += np.bincount(rows.ravel(), None if once else np.tile(times, len(rows)), self.w.rows)

    def learn(self, b: Batch) -> None:
        for lo in range(0, len(b.token), STEP_TOKENS):
            s = slice(lo, min(lo + STEP_TOKENS, len(b.token)))
            self._step(0, *_class_logits(self.w, self.lex, b, s), b.klass[s], b.times[s])
            at = np.flatnonzero(b.frequent[s]) + lo
            if len(at):
                self._step(1, *_word_logits(self.w, self.lex, b, at), b.member[at], b.times[at])
            at = np.flatnonzero(~b.frequent[s]) + lo
            if len(at) and self.lex.digits:
                levels = self.lex.digits
                found = path_logits(self.w.of_digit, self.lex.digit_bias, b.one[at], b.two[at], b.code[at], 0, levels)
                self._step(2, *found, np.repeat(b.times[at], levels))

    def changes(self, start: Weights) -> np.ndarray:
        """Changes of all weights, times the tokens that met their row, and those numbers of tokens."""
        moved = [((t - s) * m[:, None]).ravel() for t, s, m in zip(self.w.tables, start.tables, self.met)]
        return np.concatenate([*moved, self.met.ravel()]).astype(np.float32)


def path_depth(tokens: int, digits: int) -> int:
    """Digits of a path below a shard: as many as leave END_TOKENS counted tokens at each end."""
    depth = 0
    while BRANCH ** (depth + 1) * END_TOKENS <= tokens and DIGIT_BITS * (digits + depth + 1) <= BITS:
        depth += 1
    return depth


def shard_log10_probs(
    w: Weights, lex: Lexicon, codes: np.ndarray, counts: np.ndarray,
    one: np.ndarray, two: np.ndarray, code: np.ndarray, learnt: np.ndarray,
) -> np.ndarray:
    """Per rare token of a shard, given RARE; learns from each as often as ``learnt`` says.

    ``codes`` and ``counts``: the shard's whole vocabulary and its learnable tokens. All words without a
    count are one word, told apart from the others by the smoothed counts. Equal tokens in equal contexts
    are one row with a weight, and rows are taken in the order of a hash, so the result is the same for any
    order of the tokens. A step holds a bounded number of levels.
    """
    mixed = (one.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (two.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (mixed >> np.uint64(29)) ^ code.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    order = np.argsort(mixed).astype(np.uint32)  # rows of one hash are equal
    del mixed
    one, two, code, learnt = (x[order] for x in (one, two, code, learnt))
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (code[1:] != code[:-1])
    group = (np.cumsum(new) - 1).astype(np.uint32)
    one, two, code = one[new], two[new], code[new]
    times = np.bincount(group, learnt, len(code))

    by = np.argsort(codes, kind="stable")
    codes, counts = codes[by], counts[by] + 1  # words that agree in the hash are one
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else by
    codes, n = codes[first], np.add.reduceat(counts, first) if len(first) else counts
    depth = path_depth(int(n.sum()), lex.digits)
    end_of = lambda c: (c.astype(np.int64) >> (BITS - DIGIT_BITS * (lex.digits + depth))) & ((1 << DIGIT_BITS * depth) - 1)
    ends = np.bincount(end_of(codes), n, BRANCH ** depth)
    all_rare = lex.rare_tokens + lex.rare_distinct
    share = np.append(n / np.maximum(ends[end_of(codes)], 1) * all_rare, 1.0) / (all_rare + 1)
    which = np.searchsorted(codes, code)
    which[which == len(codes)] = 0
    counted = codes[which] == code if len(codes) else np.zeros(len(code), bool)
    out = np.log10(share[np.where(counted, which, len(codes))])
    counted = np.flatnonzero(counted).astype(np.uint32)
    del which
    paths = [(w.of_digit, lex.digit_bias, 0, lex.digits)]
    if depth:
        bias = path_bias(ends, depth)
        table = np.zeros((max(LEAST_SHARD_ROWS, power_of_two(times.sum() / SHARD_ROW_TOKENS)), BRANCH), np.float32)
        squares = np.zeros_like(table)
        seen = np.flatnonzero(times).astype(np.uint32)
        for lo in range(0, len(seen), STEP_TOKENS):
            at = seen[lo:lo + STEP_TOKENS]
            rows, z, digit = path_logits(table, bias, one[at], two[at], code[at], lex.digits, depth)
            p = _softmax(z)
            p[np.arange(len(p)), digit] -= 1
            p *= np.repeat(times[at], depth)[:, None]
            _update(table, squares, rows, p)
        paths.append((table, bias, lex.digits, depth))
    for weights, start, skip, levels in paths:
        for lo in range(0, len(counted) if levels else 0, STEP_TOKENS):
            at = counted[lo:lo + STEP_TOKENS]
            _, z, digit = path_logits(weights, start, one[at], two[at], code[at], skip, levels)
            out[at] += _log10_share(z, digit).reshape(-1, levels).sum(1)
    back = np.empty(len(order))
    back[order] = out[group]
    return back


def shard_of(code: np.ndarray, digits: int) -> np.ndarray:
    return code >> (BITS - DIGIT_BITS * digits)


def part_of(one: np.ndarray, two: np.ndarray, shard: np.ndarray, lex: Lexicon) -> np.ndarray:
    """The part of its shard that a context belongs to: all words after a context meet in one task."""
    most = np.full(len(shard), lex.least_parts, np.uint64)
    if lex.parts:
        names = np.array(sorted(lex.parts))
        ways = np.array([lex.parts[x] for x in names.tolist()])
        at = np.minimum(np.searchsorted(names, shard), len(names) - 1)
        most = np.where(names[at] == shard, ways[at], lex.least_parts).astype(np.uint64)
    if not lex.parts and lex.least_parts == 1:
        return np.zeros(len(shard), np.int64)
    h = context_hashes(one, two, FEATURES)[2] * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(33)) % most).astype(np.int64)


def _squeezed(*columns: np.ndarray, by: zstandard.ZstdCompressor | None = None) -> bytes:
    """Columns byte by byte, compressed."""
    raw = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return (by or zstandard.ZstdCompressor(level=1)).compress(b"".join(raw))


def _unsqueezed(data: bytes, *types: str, by: zstandard.ZstdDecompressor | None = None) -> list[np.ndarray]:
    raw = np.frombuffer((by or zstandard.ZstdDecompressor()).decompress(data), np.uint8)
    widths = [np.dtype(t).itemsize for t in types]
    n, out, at = len(raw) // sum(widths), [], 0
    for t, k in zip(types, widths):
        out.append(np.ascontiguousarray(raw[at:at + k * n].reshape(k, n).T).view(t).ravel())
        at += k * n
    return out


TOKEN_TYPES = ("<u2", "<u4", "<u4", "<u4", "<u4")  # piece in the chunk, the two words before, hash, times


def hash_order(code: np.ndarray) -> np.ndarray:
    """Stable order of 32-bit hashes: short numbers are sorted by their digits, in two passes."""
    low = np.argsort(code.astype(np.uint16), kind="stable")
    return low[np.argsort((code >> 16).astype(np.uint16)[low], kind="stable")]


def _to_shards(rare: Sequence[np.ndarray], lex: Lexicon, by: zstandard.ZstdCompressor) -> Iterator[tuple[int, int, bytes]]:
    """(group of shards, part, tokens) of the rare tokens of a chunk, given as columns like TOKEN_TYPES."""
    owner, one, two, code, times = rare
    shard = shard_of(code, lex.digits)
    part = part_of(one, two, shard, lex)
    group = shard // lex.shared_shards
    order = np.lexsort((code, part, group)) if part.any() else hash_order(code)
    owner, one, two, code, times, group, part = (x[order] for x in (owner, one, two, code, times, group, part))
    cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(part) != 0)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(code)]) if len(code) else []:
        # hashes are in order: their differences compress well
        columns = owner[lo:hi], one[lo:hi], two[lo:hi], np.diff(code[lo:hi], prepend=0), times[lo:hi]
        yield int(group[lo]), int(part[lo]), _squeezed(*[x.astype(t) for x, t in zip(columns, TOKEN_TYPES)], by=by)


def _score_shard(rows: pd.DataFrame, w: Weights, lex: Lexicon) -> pd.DataFrame:
    """(chunk, packed): sums over the tokens of these shards per piece of a chunk."""
    press, un = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    words = [_unsqueezed(x, "<u4", "<i8", by=un) for x in rows["packed"][rows["chunk"] < 0]]
    codes, counts = (np.concatenate([x[k] for x in words]) if words else np.empty(0, t) for k, t in enumerate(("<u4", "<i8")))
    rows = rows[rows["chunk"] >= 0]
    packed = [_unsqueezed(x, *TOKEN_TYPES, by=un) for x in rows["packed"]]
    if not packed:
        return pd.DataFrame({"chunk": pd.Series([], dtype="int64"), "packed": pd.Series([], dtype=object)})
    size = [len(x[0]) for x in packed]
    owner, one, two = (np.concatenate([x[k] for x in packed]) for k in range(3))
    code = np.concatenate([np.cumsum(x[3], dtype=np.uint32) for x in packed])
    learnt = np.concatenate([x[4] for x in packed]) * np.repeat(~rows["held_out"].to_numpy(bool), size)
    del packed
    p = np.empty(len(code))
    mine, of = shard_of(code.astype(np.int64), lex.digits), shard_of(codes.astype(np.int64), lex.digits)
    for shard in np.unique(mine):  # each learns on its own
        at, voc = np.flatnonzero(mine == shard), of == shard
        p[at] = shard_log10_probs(w, lex, codes[voc], counts[voc], one[at], two[at], code[at], learnt[at])
    out = []
    for lo, hi in zip(np.cumsum(size) - size, np.cumsum(size)):
        total = np.bincount(owner[lo:hi], p[lo:hi])
        at = np.unique(owner[lo:hi])
        out.append(_squeezed(at.astype("<u2"), total[at].astype("<f4"), by=press))
    return pd.DataFrame({"chunk": rows["chunk"].to_numpy(), "packed": out})


def learnable(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = named(docs, id_col)
    return docs.where(remainder(key, HELD_OUT_MOD) != HELD_OUT_REST).select(key.alias("doc_id"), named(docs, text_col).alias("text"))


def split_texts(texts: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(first text, words of some texts, words of each): the words of ``byte_words``, of a bounded number of bytes at a time."""
    end = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        before = int(end[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(end, before + SPLIT_BYTES, "right")))
        some = pc.fill_null(texts[lo:hi].cast(pa.string()), "")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(some))
        words, cuts = lists.flatten(), lists.offsets.to_numpy()
        full = pc.not_equal(pc.binary_length(words), 0)  # white space at an end leaves an empty word
        before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
        yield lo, words.filter(full), np.diff(before[cuts - cuts[0]])
        lo = hi
    pa.default_memory_pool().release_unused()


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): tokens of all texts; words are counted per task before the shuffle."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, waiting, found = 0, [], []
        for batch in batches:
            for _, words, sizes in split_texts(batch.column(0)):
                ends += len(sizes)
                waiting.append(words)
                if sum(x.nbytes for x in waiting) >= COUNTED_BYTES:
                    found.append(_counted(waiting))
                    waiting = []
                    if sum(x.nbytes for x in found) >= HELD_BYTES:
                        found = [_summed(found)]
                        if found[0].nbytes >= HELD_BYTES:
                            yield found.pop()
        if ends:
            end = pa.RecordBatch.from_arrays([pa.array([END.decode()]), pa.array([ends], pa.int64())], ["word", "n"])
            yield _summed([*found, *([_counted(waiting)] if waiting else []), end])

    parts = texts.select("text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(words: list[pa.Array]) -> pa.RecordBatch:
    counts = pa.chunked_array(words).value_counts()
    return pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "n"])


def _summed(found: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Counts of equal words added up."""
    all_words = pa.concat_arrays([x["word"] for x in found]).dictionary_encode()
    n = np.bincount(all_words.indices, np.concatenate([x["n"] for x in found])).astype(np.int64)
    return pa.RecordBatch.from_arrays([all_words.dictionary, pa.array(n)], ["word", "n"])


def lexicon(counts: DataFrame, known: int = KNOWN_WORDS) -> Lexicon:
    """The most frequent words, at most ``known``, and the totals of all.

    Words are counted by eighths of the logarithm of their count; the driver gets that histogram and
    then only the words above the level where ``known`` is not exceeded.
    """
    level = F.floor(F.log2("n") * 8)
    steps = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    least, room = None, known
    for step in sorted(steps, key=lambda r: -r["level"]):
        room -= step["words"]
        if room < 0:
            break
        least = step["level"]
    top = counts.where(F.lit(False) if least is None else level >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    lex = Lexicon(top["word"].to_pylist(), top["n"].to_numpy(), sum(r["n"] for r in steps), sum(r["words"] for r in steps))
    digits = shard_digits(lex.rare_tokens)
    shift = BITS - DIGIT_BITS * digits

    def shards(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BRANCH ** digits, np.int64)
        for df in batches:
            code = code_of((w.encode() for w in df["word"]), len(df))
            total += np.bincount(code >> shift, df["n"] + 1, len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        if len(at):
            yield pd.DataFrame({"shard": at, "n": total[at]})

    tokens = np.zeros(BRANCH ** digits)
    for r in counts.mapInPandas(shards, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect():
        tokens[r["shard"]] = r["n"]
    n = CLASSES * MEMBERS
    tokens -= np.bincount(lex.code[:n] >> shift, lex.counts[:n] + 1, len(tokens))
    least = max(1, -(-lex.rare_tokens // (BRANCH ** digits * SHARD_TOKENS)))
    groups = min(BRANCH ** digits, power_of_two(lex.rare_tokens / SHARD_TOKENS))
    shared = BRANCH ** digits // groups
    ways = np.ceil(tokens / (2 * SHARD_TOKENS)).astype(int)
    parts = {int(i): int(ways[i]) for i in np.flatnonzero(ways > least)}
    return replace(lex, digits=digits, digit_bias=path_bias(tokens, digits), parts=parts, least_parts=least, shared_shards=shared)


def shard_digits(rare_tokens: int) -> int:
    digits = 0
    while BRANCH ** digits * SHARD_TOKENS < rare_tokens and digits < MOST_DIGITS:
        digits += 1
    return digits


def chunk_count(tokens: int) -> int:
    """Chunks of a corpus: about CHUNK_TOKENS each, one for every round at least."""
    return max(ROUNDS, -(-tokens // CHUNK_TOKENS))


CHUNKS = (
    "chunk long, held_out boolean, turn int, sizes array<int>, leads array<int>, times array<int>, docs array<long>, tokens binary,"
    " doc long, doc_id string, n_tokens long, n_known long, base double, cold string, cold_times array<int>"
)


def tokenized(docs: DataFrame, lex: Lexicon, shared: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """Two kinds of rows, written: chunks of tokens (CHUNKS up to ``tokens``) and documents (``doc_id`` and the rest).

    Documents are dealt to chunks by a hash of id and text, and ordered by it in a chunk, whatever the files; a
    third of equal texts spreads over all chunks and is one piece with a number of times in each. A long
    text is cut into pieces, each with the two words before it. Numbers of chunks and documents are final
    once written.
    """
    n_chunks = chunk_count(lex.tokens)
    rows = located(docs.select(named(docs, id_col).alias("doc_id"), named(docs, text_col).alias("text")))
    held = (remainder(F.col("doc_id"), HELD_OUT_MOD) == HELD_OUT_REST).alias("held_out")
    mixed = F.xxhash64("doc_id", "text")
    # held-out documents have chunks of their own, in proportion
    chunk = F.pmod(mixed, F.lit(n_chunks)) * 2 + held.cast("int")
    # an id travels as text, since a whole number with missing ones would lose digits
    name = F.col("doc_id").cast("string").alias("doc_id")
    rows = rows.select(name, "text", held, chunk.alias("chunk"), mixed.alias("rank"), F.xxhash64(FILE, ROW).alias("place"))
    first = StructType.fromDDL(
        "doc_id string, held_out boolean, chunk long, rank long, place long, piece int, lead int, tokens binary, size int,"
        " n_tokens long, n_known long, base double, cold string, cold_times array<int>"
    )
    second = StructType.fromDDL(CHUNKS)
    piece_types = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.list_(pa.int32())]

    def tokenize(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, press = received(shared, Lexicon), zstandard.ZstdCompressor(level=1)
        known = pa.array(lexicon.words, pa.string())
        end = pc.index(known, END.decode()).as_py()  # -1 if it is not known
        for batch in batches:
            for at, words, sizes in split_texts(batch["text"]):
                found = pc.index_in(words, value_set=known)
                number = pc.fill_null(found, -1).to_numpy()
                cold = words.filter(found.is_null()).cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
                codes = code_of(cold, len(cold))
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                cold_cuts = np.searchsorted(np.flatnonzero(number < 0), cuts).tolist()
                cuts, out = cuts.tolist(), []
                for k in range(len(sizes)):
                    ids = np.append(number[cuts[k]:cuts[k + 1]], end).astype(np.int64)
                    base = float(lexicon.log_count.take(ids[ids >= 0]).sum()) if len(known) else 0.0
                    mine, code = cold[cold_cuts[k]:cold_cuts[k + 1]], codes[cold_cuts[k]:cold_cuts[k + 1]]
                    if end < 0:
                        mine, code = [*mine, END], np.append(code, code_of([END], 1))
                    ids[ids < 0] = code
                    again = Counter(mine)
                    ids = ids.astype("<u4")
                    whole = (len(ids), len(ids) - len(mine), base, b" ".join(again).decode() if again else None, list(again.values()))
                    for piece, lo in enumerate(range(0, len(ids), PIECE_TOKENS)):
                        lead = min(lo, 2)
                        rest = whole if piece == 0 else (0, 0, 0.0, None, None)
                        out.append((at + k, piece, lead, _squeezed(ids[lo - lead:lo + PIECE_TOKENS], by=press), min(len(ids) - lo, PIECE_TOKENS), *rest))
                row, *made = zip(*out)
                columns = [batch[c].take(pa.array(row)) for c in ("doc_id", "held_out", "chunk", "rank", "place")]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, made, piece_types)], first.names)

    def chunks(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cut, pieces, n, doc = None, 0, {}, 0, -1
        press, un = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

        def done() -> Iterator[pd.DataFrame]:
            if pieces:
                parts = [_unsqueezed(t, "<u4", by=un)[0] for t, _ in pieces]
                sizes = [len(t) for t in parts]
                row = {
                    "chunk": now << 20 | cut, "held_out": bool(now & 1), "turn": (now >> 1) % ROUNDS, "sizes": sizes,
                    "leads": [lead for _, lead in pieces], "times": [len(d) for d in pieces.values()],
                    "docs": [d for of in pieces.values() for d in of], "tokens": _squeezed(np.concatenate(parts), by=press),
                }
                yield _frame([tuple(row.get(c) for c in second.names)], second)

        for df in batches:
            heads = []
            for r in df.itertuples(index=False):
                full = n >= 2 * CHUNK_TOKENS or len(pieces) >= MOST_PIECES
                if r.chunk != now or full:
                    yield from done()
                    cut = cut + 1 if r.chunk == now else 0
                    if r.chunk != now:
                        doc = (r.chunk << 32) - 1
                    now, pieces, n = r.chunk, {}, 0
                if r.piece == 0:
                    doc += 1
                    row = {"doc_id": r.doc_id, "held_out": r.held_out, "doc": doc, "n_tokens": r.n_tokens, "n_known": r.n_known,
                           "base": r.base, "cold": r.cold, "cold_times": r.cold_times}
                    heads.append(tuple(row.get(c) for c in second.names))
                known = pieces.setdefault((r.tokens, r.lead), [])
                if not known:
                    n += r.size
                known.append(doc)
            if heads:
                yield _frame(heads, second)
        yield from done()

    dealt = rows.mapInArrow(tokenize, first).repartition("chunk").sortWithinPartitions("chunk", "rank", "doc_id", "place", "piece")
    return written(dealt.mapInPandas(chunks, second), "tokens")


def _frame(rows: list[tuple], schema: StructType) -> pd.DataFrame:
    """Rows as a frame whose whole numbers stay whole where some are missing."""
    df = pd.DataFrame(rows, columns=schema.names, dtype=object)
    whole = {f.name: "Int64" for f in schema.fields if f.dataType.simpleString() in ("bigint", "int")}
    return df.astype(whole)


def batches_of(row: pd.Series, lexicon: Lexicon) -> Iterator[tuple[int, Batch]]:
    """(first piece, batch) of a chunk, a bounded number of tokens at a time."""
    sizes, leads, times = (np.asarray(row[c], np.int64) for c in ("sizes", "leads", "times"))
    token = _unsqueezed(row["tokens"], "<u4")[0]
    end = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        before = int(end[lo] - sizes[lo])
        hi = max(lo + 1, int(np.searchsorted(end, before + PIECE_TOKENS, "right")))
        yield lo, Batch(token[before:int(end[hi - 1])], sizes[lo:hi], leads[lo:hi], times[lo:hi], lexicon)
        lo = hi


def _add_up(parts: DataFrame) -> DataFrame:
    """Sums of equal blocks that meet in a task; memory is one copy of the weights."""

    def add(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for df in batches:
            for block, values in zip(df["block"], df["values"]):
                x = np.frombuffer(values, "<f4").astype(float)
                held[block] = held[block] + x if block in held else x
        for block, x in held.items():
            yield pd.DataFrame({"block": [block], "salt": [0], "values": [x.astype("<f4").tobytes()]})

    return parts.mapInPandas(add, parts.schema)


def train(tokens: DataFrame, lex: Lexicon, known: Broadcast, rounds: int = ROUNDS) -> Weights:
    """Weights after ``rounds``; every learnable chunk takes part in one of each ROUNDS.

    A chunk's changes start from the shared weights and are averaged row by row, by the tokens that met
    the row. A task adds up those of its chunks; the sums leave it in blocks and are added in two steps, the
    first over salted blocks, so no task adds up all tasks' blocks.
    """
    spark = tokens.sparkSession
    weights = Weights(table_rows(lex.tokens))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((weights.rows, weights.flat()))

        def learn(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            start, lexicon, total = Weights(*shared.value), received(known, Lexicon), None
            for df in batches:
                for _, row in df.iterrows():
                    t = Trainer(start, lexicon)
                    for _, b in batches_of(row, lexicon):
                        t.learn(b)
                    moved = t.changes(start)
                    total = moved if total is None else total + moved
            if total is not None:
                salt = TaskContext.get().partitionId() % SALTS
                for lo in range(0, len(total), BLOCK_VALUES):
                    yield pd.DataFrame({"block": [lo // BLOCK_VALUES], "salt": [salt], "values": [total[lo:lo + BLOCK_VALUES].astype("<f4").tobytes()]})

        mine = tokens.where(F.col("tokens").isNotNull() & ~F.col("held_out") & (F.col("turn") == r % ROUNDS))
        # chunks, not tasks, make the updates: fewer tasks only send fewer sums
        mine = mine.select("sizes", "leads", "times", "tokens").coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
        parts = mine.mapInPandas(learn, "block int, salt int, values binary")
        added = _add_up(_add_up(parts.repartition("block", "salt")).repartition("block"))
        got = added.collect()  # as many numbers as the tables have
        shared.unpersist()
        if got:
            flat = np.concatenate([np.frombuffer(x["values"], "<f4") for x in sorted(got, key=lambda x: x["block"])])
            widths = [t.shape[1] for t in weights.tables]
            moved, met = np.split(flat, [weights.rows * sum(widths)])
            met = np.concatenate([np.repeat(m, k) for m, k in zip(met.reshape(len(widths), -1), widths)])
            weights = Weights(weights.rows, weights.flat() + moved / np.maximum(met, 1))
    return weights


def _vocabulary(counts: DataFrame, shared: Broadcast) -> DataFrame:
    """Rows (shard, part, chunk -1, packed): hashes and counts of the rare words of every group of shards.

    A shard's words go to all its parts, so that each part knows the whole vocabulary of its shards.
    """
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, press = received(shared, Lexicon), zstandard.ZstdCompressor(level=1)
        frequent = {w.encode() for w in lexicon.words[:CLASSES * MEMBERS]}
        for df in batches:
            words = [w.encode() for w in df["word"]]
            rare = np.array([w not in frequent for w in words], bool)
            code, times = code_of(words, len(words))[rare], df["n"].to_numpy(np.int64)[rare]
            shard = shard_of(code, lexicon.digits)
            group = shard // lexicon.shared_shards
            parts = np.full(len(code), lexicon.least_parts)
            for k, n_parts in lexicon.parts.items():
                parts[shard == k] = n_parts
            order = np.lexsort((parts, group))
            cuts = np.flatnonzero((np.diff(group[order]) != 0) | (np.diff(parts[order]) != 0)) + 1
            found = [
                (int(group[at[0]]), int(parts[at[0]]), _squeezed(code[at].astype("<u4"), times[at].astype("<i8"), by=press))
                for at in (np.split(order, cuts) if len(order) else [])
            ]
            yield pd.DataFrame(found, columns=["shard", "parts", "packed"])

    rows = counts.mapInPandas(run, "shard long, parts long, packed binary")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    return rows.select("shard", part.alias("part"), F.lit(-1).cast("long").alias("chunk"), F.lit(True).alias("held_out"), "packed")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the rows outside the held-out part. ``base_score`` is the add-one unigram score,
    ``score`` the model's log10 probability of the words and the end of the text. NULL counts as empty:
    one token, the end. Without any learnable row every count is 0 and the model is uniform over
    classes. Equal rows count and stay as often as they occur, long texts are scored in pieces that know
    the words before them, other columns are not read; an empty table gives an empty result. Scores
    do not depend on how rows are spread over files or tasks.
    """
    counts = written(count_words(learnable(docs, id_col, text_col)), "word-counts")
    lex = lexicon(counts, known)
    spark = docs.sparkSession
    words = sent(spark, lex)
    tokens = tokenized(docs, lex, words, id_col, text_col)
    weights = train(tokens, lex, words, rounds)
    shared = spark.sparkContext.broadcast((weights.rows, weights.flat()))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, lexicon, press = Weights(*shared.value), received(words, Lexicon), zstandard.ZstdCompressor(level=1)
        for df in batches:
            for _, row in df.iterrows():
                total = np.zeros(len(row["sizes"]))
                rare: list[list[np.ndarray]] = []
                for lo, b in batches_of(row, lexicon):
                    total[lo:] += np.bincount(b.owner, log10_probs(w, lexicon, b), len(total) - lo)
                    at = np.flatnonzero(~b.frequent)
                    rare.append([x[at].astype(t) for x, t in zip((b.owner + lo, b.one, b.two, b.code, b.times), TOKEN_TYPES)])
                columns = [np.concatenate(x) for x in zip(*rare)]
                found = [(s, p, row["chunk"], bool(row["held_out"]), t) for s, p, t in _to_shards(columns, lexicon, press)]
                times = np.asarray(row["times"], "<i4").tobytes()
                top = times + np.asarray(row["docs"], "<i8").tobytes() + total.astype("<f8").tobytes()
                found.append((-1 - row["chunk"], 0, row["chunk"], bool(row["held_out"]), len(total).to_bytes(4, "little") + top))
                yield pd.DataFrame(found, columns=["shard", "part", "chunk", "held_out", "packed"])

    fields = "shard long, part long, chunk long, held_out boolean, packed binary"
    chunks = tokens.where(F.col("tokens").isNotNull()).select("chunk", "held_out", "sizes", "leads", "times", "docs", "tokens")
    dealt = chunks.mapInPandas(run, fields).unionByName(_vocabulary(counts, words))

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        """The sums of a chunk as they are, those of a shard by chunk."""
        if group["shard"].iloc[0] < 0:
            return group[["chunk", "packed"]].assign(top=True)
        return _score_shard(group, Weights(*shared.value), received(words, Lexicon)).assign(top=False)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        """Sums per document: those of the classes and of all shards, for every document that has the piece."""
        top = group["packed"][group["top"]].iloc[0]
        n = int.from_bytes(top[:4], "little")
        times = np.frombuffer(top, "<i4", n, 4)
        of = np.frombuffer(top, "<i8", int(times.sum()), 4 + 4 * n)
        total = np.frombuffer(top, "<f8", n, 4 + 4 * n + 8 * len(of)).copy()
        un = zstandard.ZstdDecompressor()
        for x in group["packed"][~group["top"]]:
            at, sums = _unsqueezed(x, "<u2", "<f4", by=un)
            total[at] += sums
        return pd.DataFrame({"doc": of, "model": np.repeat(total, times)})

    sums = dealt.groupBy("shard", "part").applyInPandas(finish, "chunk long, packed binary, top boolean")
    model = sums.groupBy("chunk").applyInPandas(add, "doc long, model double").groupBy("doc").agg(F.sum("model").alias("score"))

    # counts of the words that tasks don't know: each is rare, so no key is hot
    heads = tokens.where(F.col("doc").isNotNull())
    cold = heads.where("cold is not null").select("doc", F.explode(F.arrays_zip(F.split("cold", " ").alias("word"), F.col("cold_times").alias("times"))).alias("c"))
    cold = cold.select("doc", F.col("c.word").alias("cold"), "c.times")
    found = cold.join(counts, F.col("cold") == F.col("word"), "left").groupBy("doc").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("logs"),
    )
    below = float(np.log10(lex.tokens + lex.distinct + 1))
    return heads.select("doc", "doc_id", "held_out", "n_tokens", "n_known", "base").join(found, "doc", "left").join(model, "doc").select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)).alias("base_score"), "score",
    )
