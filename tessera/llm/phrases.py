"""Phrase collocations: frequent word sequences whose parts rarely meet by chance.

First pass: every task hashes the word sequences of its texts and sums equal ones into blocks, one per hash
partition. The blocks of a partition meet in one Misra-Gries summary, whose capacity exceeds the
partition's mass divided by the threshold. A summary then undercounts by less than the threshold, so every
frequent sequence survives; summaries and blocks are merged by adding counters and subtracting the
largest one too many. Second pass: only occurrences of survivors are counted, exactly and by their words,
and summed in a task before they meet.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import named, whole_text
from tessera.llm.rows import written
from tessera.scale import BROADCAST_VALUES, rank_per_group

THRESHOLD = 100
LONGEST = 5
TOP = 2000
ABSORB_PERCENT = 100
UNKNOWN = "und"
# Occurrences that one hash partition holds on average: its summary has a 100th as many counters.
PARTITION_MASS = 1 << 25
PORTION_BYTES = 2 << 20  # of texts whose sequences are taken at once
BLOCK_ENTRIES = 3 << 19  # entries a task holds before it sends its blocks
MERGE_ENTRIES = 1 << 20  # entries that wait for a merge into a summary
SLOT_BITS = 32  # of the hash inside a partition; sequences that agree in it share a counter
KNOWN_WORDS = 1 << 20  # words a task keeps numbers of
TASKS_PER_CORE = 2  # of the second count

# Pieces end at . , ; : ! ? and at line feed to carriage return. No UTF-8 text holds this byte.
_EDGE = b"\xff"
_TO_EDGES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _EDGE * 10 + b" ")


@dataclass
class Tokens:
    """Words of some texts in a row, with an edge after each piece."""

    word: np.ndarray  # number of the word
    lang: np.ndarray  # number of the language
    left: np.ndarray  # words up to the next edge, itself included; 0 where no sequence begins
    words: list[bytes]  # by number
    langs: list[str]
    anew: bool = True  # numbers of words began anew


def _word_end(b: bytes, at: int) -> int:
    """Where the word at ``at`` ends."""
    return min((i for i in (b.find(b" ", at), b.find(_EDGE, at)) if i >= 0), default=len(b))


def slices(text: str | None, longest: int, size: int = PORTION_BYTES) -> Iterator[tuple[list[bytes], int, int]]:
    """(words and edges, how many of them are the slice's own, bytes) of a text in slices of about ``size`` bytes.

    After its own words a slice has the next ``longest`` - 1, so that every sequence lies in the slice
    where it begins.
    """
    b = (text or "").encode().lower().translate(_TO_EDGES)
    at = 0
    while True:
        end = _word_end(b, at + size) if at + size < len(b) else len(b)
        own = b[at:end].replace(_EDGE, b" \xff ").split()
        ahead: list[bytes] = []
        pos = end
        while pos < len(b) and len(ahead) < longest - 1:
            stop = _word_end(b, pos)
            if stop > pos:
                ahead.append(b[pos:stop])
                pos = stop
            else:
                if b[pos] == _EDGE[0]:
                    ahead.append(_EDGE)
                pos += 1
        yield own + ahead, len(own), end - at
        if end == len(b):
            return
        at = end


class Numbers(defaultdict):
    """Numbers of words in the order they are met, with a 64-bit hash of each."""

    def __init__(self):
        super().__init__(count().__next__)
        self[_EDGE]  # number 0
        self.hashes = np.zeros(1, np.uint64)

    def hashed(self) -> np.ndarray:
        new = list(self)[len(self.hashes):] if len(self) > len(self.hashes) else []
        if new:
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))])
        return self.hashes


def portions(batches: Iterable[pd.DataFrame], longest: int, size: int = PORTION_BYTES) -> Iterator[tuple[Tokens, np.ndarray]]:
    """Tokens of about ``size`` bytes of text at a time, with the hashes of all numbered words."""
    numbers, anew = Numbers(), True
    langs: dict[str, int] = {}
    ids: list[np.ndarray] = []
    lang: list[tuple[int, int]] = []
    own: list[tuple[int, int]] = []
    held = 0

    def take() -> tuple[Tokens, np.ndarray]:
        word = np.concatenate(ids)
        n = len(word)
        edge = np.where(word == 0, np.arange(n), n)
        left = np.minimum.accumulate(edge[::-1])[::-1] - np.arange(n)
        begins = np.repeat(np.tile([True, False], len(own)), np.array(own).ravel())
        tokens = Tokens(word, np.repeat(*np.array(lang).T), np.where(begins, left, 0), list(numbers), list(langs), anew)
        return tokens, numbers.hashed()

    for df in batches:
        for g, text in zip(df["lang"], df["text"]):
            for words, n_own, n_bytes in slices(text, longest, size):
                words.append(_EDGE)
                ids.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                lang.append((langs.setdefault(g, len(langs)), len(words)))
                own.append((n_own, len(words) - n_own))
                held += n_bytes + 1
                if held >= size:
                    yield take()
                    ids, lang, own, held = [], [], [], 0
                    anew = len(numbers) > KNOWN_WORDS
                    if anew:
                        numbers = Numbers()
    if ids:
        yield take()


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sequence_hashes(t: Tokens, hashes: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(where they begin, hash) of the sequences of 1, 2, .. words; the language is part of the hash."""
    salts = np.fromiter((xxhash.xxh64_intdigest(g, 1) for g in t.langs), np.uint64, len(t.langs))
    word = hashes[t.word]
    h = _mix(word + salts[t.lang])
    for n in range(1, longest + 1):
        if n > 1:
            h = _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[n - 1:])
        at = np.flatnonzero(t.left[: len(h)] >= n)
        yield at, h[at]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")  # merges runs that are in order already
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class MisraGries:
    """Counters of the heaviest keys of a stream whose mass is known.

    No key is overcounted, and none is undercounted by more than ``error``, which stays below the
    threshold: taking d off more than ``capacity`` counters removes more than capacity x d of the mass.
    """

    def __init__(self, mass: int, threshold: int):
        self.capacity = mass // threshold + 1
        self.threshold = threshold
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.error = 0
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting >= max(MERGE_ENTRIES, self.capacity):
            self._merge()

    def _merge(self) -> None:
        parts = [(self.keys, self.counts), *self.waiting]
        self.waiting, self.n_waiting = [], 0
        self.keys, self.counts = summed(*(np.concatenate(x) for x in zip(*parts)))
        over = len(self.keys) - self.capacity
        if over > 0:
            d = int(np.partition(self.counts, over - 1)[over - 1])  # the largest counter without a place
            kept = self.counts > d
            self.keys, self.counts = self.keys[kept], self.counts[kept] - d
            self.error += d

    def survivors(self) -> np.ndarray:
        """Every key counted ``threshold`` times or more in the whole stream, in order, and maybe others."""
        self._merge()
        return self.keys[self.counts + self.error >= self.threshold]


def packed(slots: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted slots and their counts: differences and counts are small, so they compress well."""
    gaps = np.diff(slots, prepend=np.uint32(0)).astype("<u4")
    raw = gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(8, -1)
    number = lambda x: np.ascontiguousarray(x.T).view("<u4").ravel()
    return np.cumsum(number(raw[:4]), dtype=np.uint32), number(raw[4:]).astype(np.int64)


def partition_bits(n_bytes: int, longest: int = LONGEST) -> int:
    """log2 of the number of hash partitions for so many bytes of text, at five bytes a word."""
    return max(1, (n_bytes * longest // (5 * PARTITION_MASS)).bit_length())


def survivors(texts: DataFrame, bits: int, threshold: int = THRESHOLD, longest: int = LONGEST) -> DataFrame:
    """(part, n, slots): hashes of a superset of the sequences with ``threshold`` occurrences or more.

    ``texts``: (lang, text). A key is (partition, slot) = the first ``bits`` and the next 32 bits of
    the hash. Blocks and their masses are sorted by partition in a task, masses first, so a summary
    knows its capacity before its first block and no group is held.
    """

    def blocks(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        def send() -> Iterator[pd.DataFrame]:
            part = (keys >> np.uint64(SLOT_BITS)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(part)) + 1
            first = np.concatenate([[0], cuts])
            mass = np.add.reduceat(counts, first)
            rows = [packed(k.astype(np.uint32), c) for k, c in zip(np.split(keys, cuts), np.split(counts, cuts))]
            yield pd.DataFrame({"part": part[first], "mass": mass, "block": None})
            for lo in range(0, len(rows), 256):
                yield pd.DataFrame({"part": part[first][lo:lo + 256], "mass": 0, "block": rows[lo:lo + 256]})

        for t, hashes in portions(batches, longest):
            found = [h >> np.uint64(64 - bits - SLOT_BITS) for _, h in sequence_hashes(t, hashes, longest)]
            one, n = np.unique(np.concatenate(found), return_counts=True)
            keys, counts = summed(np.concatenate([keys, one]), np.concatenate([counts, n]))
            if len(keys) > BLOCK_ENTRIES:
                yield from send()
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield from send()

    def summaries(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, mass, summary = None, 0, None

        def done() -> Iterator[pd.DataFrame]:
            if summary is not None:
                kept = summary.survivors()
                if len(kept):
                    yield pd.DataFrame({"part": [part], "n": [len(kept)], "slots": [kept.astype("<u4").tobytes()]})

        for df in batches:
            for p, m, block in zip(df["part"], df["mass"], df["block"]):
                if p != part:
                    yield from done()
                    part, mass, summary = p, 0, None
                if block is None:
                    mass += m
                    continue
                if summary is None:
                    summary = MisraGries(mass, threshold)
                slots, counts = unpacked(block)
                summary.add(slots.astype(np.uint64), counts)
        yield from done()

    sent = texts.select("lang", "text").mapInPandas(blocks, "part long, mass long, block binary")
    dealt = sent.repartition(1 << min(bits, 16), "part").sortWithinPartitions("part", F.col("block").isNotNull())
    return dealt.mapInPandas(summaries, "part long, n long, slots binary")


class Sequences:
    """Counts of wanted sequences of the portions of a task, by length, while the numbers of words stay.

    Equal sequences are found by their words, never by hashes: the number of a sequence comes from the
    pair of the numbers of its beginning (its language, if it is one word) and its last word.
    """

    def __init__(self, longest: int):
        self.longest = longest
        self.words, self.langs = [], []
        empty = lambda: [np.empty(0, np.int64) for _ in range(longest)]
        self.pairs, self.numbers = empty(), empty()  # pairs in order, and the number of each
        self.counts, self.keys = empty(), empty()  # by number

    def __len__(self) -> int:
        return sum(map(len, self.pairs))

    def add(self, t: Tokens, hashes: np.ndarray, shift: int, wanted: np.ndarray | None) -> None:
        """Sequences whose key is ``wanted`` (sorted; None: all).

        The beginning of a frequent sequence is frequent, so only sequences whose beginning is wanted are
        looked up.
        """
        self.words, self.langs = t.words, t.langs
        seq = np.full(len(t.word), -1, np.int64)  # number of the wanted sequence of n words that begins here
        for n, (at, h) in enumerate(sequence_hashes(t, hashes, self.longest), 1):
            if n > 1:
                begun = seq[at] >= 0
                at, h = at[begun], h[begun]
            key = h >> np.uint64(shift)
            if wanted is not None:
                place = np.searchsorted(wanted, key)
                hit = place < len(wanted)
                hit[hit] = wanted[place[hit]] == key[hit]
                at, key = at[hit], key[hit]
            if not len(at):
                return
            before = t.lang[at] if n == 1 else seq[at]
            pair, first, which, counts = np.unique(
                before << 32 | t.word[at + n - 1], return_index=True, return_inverse=True, return_counts=True
            )
            seq = np.full(len(t.word), -1, np.int64)
            seq[at] = self._met(n - 1, pair, counts, key[first].view(np.int64))[which]

    def _met(self, size: int, pair: np.ndarray, counts: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Numbers of distinct sequences, whose counts are added."""
        have = self.pairs[size]
        place = np.searchsorted(have, pair)
        new = place == len(have)
        new[~new] = have[place[~new]] != pair[~new]
        number = np.empty(len(pair), np.int64)
        number[~new] = self.numbers[size][place[~new]]
        number[new] = np.arange(len(have), len(have) + np.count_nonzero(new))
        self.pairs[size] = np.insert(have, place[new], pair[new])
        self.numbers[size] = np.insert(self.numbers[size], place[new], number[new])
        self.keys[size] = np.concatenate([self.keys[size], key[new]])
        self.counts[size] = np.concatenate([self.counts[size], np.zeros(np.count_nonzero(new), np.int64)])
        self.counts[size][number] += counts
        return number

    def rows(self) -> Iterator[pd.DataFrame]:
        """(lang, phrase, n, key) of every sequence."""
        words = self.words
        for pairs, numbers, counts, keys in zip(self.pairs, self.numbers, self.counts, self.keys):
            pair = np.empty_like(pairs)
            pair[numbers] = pairs
            before, last = pair >> 32, (pair & 0xFFFFFFFF)[:, None]
            if pairs is self.pairs[0]:
                lang, spelt = before, last
            else:
                lang, spelt = lang[before], np.hstack([spelt[before], last])
            for lo in range(0, len(pair), 1 << 16):
                s = slice(lo, lo + (1 << 16))
                phrases = [b" ".join([words[i] for i in w]).decode() for w in spelt[s].tolist()]
                yield pd.DataFrame({"lang": [self.langs[i] for i in lang[s].tolist()], "phrase": phrases, "n": counts[s], "key": keys[s]})


def counted(t: Tokens, hashes: np.ndarray, longest: int, shift: int, wanted: np.ndarray | None) -> Iterator[pd.DataFrame]:
    """(lang, phrase, n, key) of the sequences of one portion whose key is ``wanted`` (sorted; None: all)."""
    held = Sequences(longest)
    held.add(t, hashes, shift, wanted)
    yield from held.rows()


def summed_portions(
    batches: Iterable[pd.DataFrame], longest: int, shift: int, wanted: np.ndarray | None, size: int = PORTION_BYTES
) -> Iterator[pd.DataFrame]:
    """(lang, phrase, n, key) of all texts of a task, and the words of a language as phrase ''.

    A sequence is one row a task, not one a portion: rows leave when the task ends, when it holds more than
    BLOCK_ENTRIES or when the numbers of words begin anew.
    """
    held, totals = Sequences(longest), Counter()
    for t, hashes in portions(batches, longest, size):
        if t.anew or len(held) > BLOCK_ENTRIES:
            yield from held.rows()
            held = Sequences(longest)
        totals.update(dict(zip(t.langs, np.bincount(t.lang[t.left >= 1], minlength=len(t.langs)).tolist())))
        held.add(t, hashes, shift, wanted)
    yield from held.rows()
    if totals:
        yield pd.DataFrame({"lang": list(totals), "phrase": "", "n": list(totals.values()), "key": -1})


def exact_counts(
    texts: DataFrame, found: DataFrame, bits: int, threshold: int = THRESHOLD, longest: int = LONGEST, room: int | None = None
) -> DataFrame:
    """(lang, phrase, n): sequences with at least ``threshold`` occurrences, and all words of a language as phrase ''.

    Survivors go to the tasks where there are at most ``room`` of them (a bound on numbers that are
    broadcast); beyond it all sequences are counted in the map tasks and joined with the survivors.
    """
    spark = texts.sparkSession
    room = BROADCAST_VALUES if room is None else room
    n_found = found.agg(F.sum("n").alias("n")).head()["n"] or 0
    shared = None
    if n_found <= room:
        rows = sorted(found.select("part", "slots").collect(), key=lambda r: r["part"])
        parts = [np.frombuffer(r["slots"], "<u4").astype(np.uint64) | np.uint64(r["part"] << SLOT_BITS) for r in rows]
        shared = spark.sparkContext.broadcast(np.concatenate(parts) if parts else np.empty(0, np.uint64))
    shift = 64 - bits - SLOT_BITS

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from summed_portions(batches, longest, shift, None if shared is None else shared.value)

    # every task sends a sum of each frequent sequence it meets: fewer tasks only send fewer sums
    dealt = texts.select("lang", "text").coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    rows = dealt.mapInPandas(run, "lang string, phrase string, n long, key long")
    if shared is None:
        slot = F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))
        byte = lambda i: F.conv(F.hex(F.substring("slots", F.col("i") * 4 + 4 - i, F.lit(1))), 16, 10)
        four = [byte(i).cast("long") * (1 << (8 * (3 - i))) for i in range(4)]
        keys = found.select("part", "slots", slot.alias("i")).select((F.col("part") * (1 << SLOT_BITS) + sum(four[1:], four[0])).alias("key"))
        sums = rows.groupBy("lang", "phrase", "key").agg(F.sum("n").alias("n")).where((F.col("n") >= threshold) | (F.col("phrase") == ""))
        rows = sums.join(keys.union(spark.range(1).select(F.lit(-1).cast("long"))), "key", "left_semi")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(
        (F.col("phrase") == "") & (F.col("n") > 0) | (F.col("phrase") != "") & (F.col("n") >= threshold)
    )


def frequent(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: int = THRESHOLD, longest: int = LONGEST, room: int | None = None
) -> DataFrame:
    """(lang, phrase, n), written: all sequences of 1 to ``longest`` words that occur ``threshold`` times or more in a language.

    A-Z are lower-cased; texts are cut at ``.,;:!?`` and line ends into pieces, those at spaces and tabs
    into words, and sequences lie within a piece; overlapping occurrences count. The phrase '' holds the
    number of all words of a language. A NULL text is empty, a NULL language ``und``. Texts of any
    length are read whole, in slices.
    """
    texts = docs.select(F.coalesce(named(docs, lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), whole_text(named(docs, text_col)).alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).head()["n"] or 0
    bits = partition_bits(n_bytes, longest)
    found = written(survivors(texts, bits, threshold, longest), "survivors")
    return written(exact_counts(texts, found, bits, threshold, longest, room), "phrases")


def mine(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: int = THRESHOLD, longest: int = LONGEST,
    top: int = TOP, absorb_percent: int = ABSORB_PERCENT, room: int | None = None,
) -> DataFrame:
    """The ``top`` phrases of two or more words of every language: (lang, rank, phrase, a, l, r, n, score).

    ``a``: occurrences of the phrase; ``l``, ``r``: of its two parts at the cut with the lowest score (the
    shortest first part of equals); ``n``: words of the language; ``score`` = floor(1000 a n / (l r)), in
    whole numbers of 38 digits. A phrase goes when its words lie inside a longer frequent phrase with at
    least ``absorb_percent`` of its occurrences. Rows are ranked by score and a, highest first, then by
    phrase. See ``frequent`` for words and odd texts; equal rows count as often as they occur, other
    columns are not read, an empty table gives no rows.
    """
    counts = frequent(docs, text_col, lang_col, threshold, longest, room)
    totals = counts.where("phrase = ''").select("lang", F.col("n").alias("words"))
    known = counts.where("phrase != ''")
    candidates = known.where(F.instr("phrase", " ") > 0).withColumn("size", F.size(F.split("phrase", " ")))

    first, rest = F.expr("substring_index(phrase, ' ', k)"), F.expr("substring(phrase, length(first) + 2)")
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("first", first).withColumn("rest", rest)
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.expr("cast(a as decimal(16,0)) * cast(words as decimal(16,0)) * 1000BD div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a", "words")).alias("b")
    ).select("lang", "phrase", "b.a", "b.l", "b.r", F.col("b.words").alias("n"), "b.score")

    w = F.split("phrase", " ")
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(w, i, m), " ")),
    ))
    longer = candidates.where("size > 2").select("lang", "n", F.explode(F.array_distinct(inner)).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * whole("longer") < absorb_percent * whole("a"))
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return rank_per_group(kept.drop("longer"), ["lang"], order, top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
