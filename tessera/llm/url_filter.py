"""URL filters: all wildcard rules at once in one bit-parallel automaton.

A glob is a chain of states, one per character. The chains of all globs lie side by side in a few
64-bit words, and one step of shift, AND and OR moves every glob over the next byte of every URL of a
batch (Shift-And with self-loops for the wildcards). Globs are matched against the canonical URL,
``host + path``:

``*``  any run of characters without ``/``     ``**``  any run of characters
``?``  one character other than ``/``          ``\\``  takes the next character as it is
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import named

# Numbers of the state matrix (rows x words) that one step handles.
STATE_WORDS = 1 << 20


class Rule(NamedTuple):
    """Host and all its subdomains, paths that start with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        plain = "".join("\\" + c if c in "*?\\" else c for c in self.text)
        return [plain + "**", "*." + plain + "**"]


# Rules by host and path; the longest that fits decides.
RULES = (
    Rule("com", "/", True),
    Rule("example.com", "/en/", False),
    Rule("www.example.com", "/en/", True),
    Rule("net", "/es/", False),
    Rule("net", "/fr/", False),
)
# Hosts that are blocked where no rule fits.
BLOCK_HOSTS = (
    "*casino*", "*-bets.*", "*bets-*", "*poker*", "*-pills.*", "*adult-*", "*porn*", "*spam-*", "*ads-track*",
)


class Automaton:
    """Masks of a set of globs. ``advance[c]``: states that byte c leads into; ``loop[c]``: states
    that byte c stays in. Fixed size: 2 x 256 x (states / 64) words."""

    def __init__(self, globs: Sequence[str]):
        chains = [self._chain(g) for g in globs]
        n_states = sum(len(steps) + 1 for steps, _ in chains)
        n_words = max(1, -(-n_states // 64))
        bits_in = np.zeros((256, n_words * 64), bool)
        bits_stay = np.zeros((256, n_words * 64), bool)
        start = np.zeros(n_words * 64, bool)
        self.last = np.empty(len(globs), np.int64)
        at = 0
        for g, (steps, stays) in enumerate(chains):
            start[at] = True
            for k, allowed in enumerate(steps):
                bits_in[allowed, at + k + 1] = True
            for k, allowed in stays:
                bits_stay[allowed, at + k] = True
            at += len(steps) + 1
            self.last[g] = at - 1
        pack = lambda b: np.packbits(b, axis=-1, bitorder="little").view("<u8")
        self.advance, self.loop, self.start = pack(bits_in), pack(bits_stay), pack(start)

    @staticmethod
    def _chain(glob: str):
        """Allowed bytes of each step, and (state, bytes that stay in it)."""
        any_byte = np.arange(256)
        no_slash = any_byte[any_byte != ord("/")]
        follow = np.arange(0x80, 0xC0)  # bytes inside a character
        steps, stays = [], []
        i = 0
        while i < len(glob):
            if glob.startswith("**", i):
                stays.append((len(steps), any_byte))
                i += 2
                continue
            if glob[i] == "*":
                stays.append((len(steps), no_slash))
            elif glob[i] == "?":
                steps.append(np.setdiff1d(no_slash, follow))
                stays.append((len(steps), follow))
            else:
                if glob[i] == "\\" and i + 1 < len(glob):
                    i += 1
                steps += [np.array([b]) for b in glob[i].encode()]
            i += 1
        return steps, stays

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix (text, glob): the glob covers the whole text."""
        out = np.zeros((len(texts), len(self.last)), bool)
        block = max(1, STATE_WORDS // self.advance.shape[1])
        for lo in range(0, len(texts), block):
            out[lo:lo + block] = self._block(texts[lo:lo + block])
        return out

    def _block(self, texts: Sequence[bytes]) -> np.ndarray:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")  # longest first: unfinished texts are a prefix
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        size = size[order]
        begin = np.cumsum(size) - size
        state = np.tile(self.start, (len(texts), 1))
        one, carry = np.uint64(1), np.uint64(63)
        live = len(texts)
        for i in range(int(size[0]) if len(size) else 0):
            while live and size[live - 1] <= i:
                live -= 1
            now = state[:live]
            byte = flat[begin[:live] + i]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> carry
            state[:live] = (moved & self.advance[byte]) | (now & self.loop[byte])
        hit = (state[:, self.last // 64] >> (self.last % 64).astype(np.uint64)) & one
        out = np.empty(hit.shape, bool)
        out[order] = hit.astype(bool)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for NULL or without ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), upper, lower), F.coalesce(path, F.lit(""))


def judge(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[Rule] = RULES,
    block_hosts: Sequence[str] = BLOCK_HOSTS,
) -> DataFrame:
    """Verdict on every URL: (page_id, host, path, rule, verdict, matched_host_glob).

    The longest rule that fits decides (a tie: block). Where none fits, ``rule`` is NULL and a URL is
    blocked if its host matches one of ``block_hosts``, else allowed. A NULL URL, or one without
    ``://``, has an empty host and path and is allowed unless a glob covers the empty host. One row per
    input row, equal rows included; a URL of any length is matched whole; other columns are not read,
    whatever their names; an empty table gives no rows.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.allow, r.text))
    globs = [g for r in ranked for g in r.globs()] + [g for h in block_hosts for g in (h, h + "/**")]
    n_rules = len(ranked)

    @F.pandas_udf("long")
    def decide(host: pd.Series, path: pd.Series) -> pd.Series:
        """Number of the first rule that fits, n_rules + the block glob, or -1."""
        hits = automaton.matches([(h + p).encode() for h, p in zip(host, path)])
        fits = hits[:, : 2 * n_rules].reshape(len(hits), n_rules, 2).any(2)
        blocks = hits[:, 2 * n_rules:].reshape(len(hits), len(block_hosts), 2).any(2)
        either = np.concatenate([fits, blocks], axis=1)
        code = np.where(either.any(1), either.argmax(1), -1) if either.shape[1] else np.full(len(hits), -1)
        return pd.Series(code)

    automaton = Automaton(globs)
    names = [*[r.text for r in ranked], *[None] * len(block_hosts)]
    blocked = [*[not r.allow for r in ranked], *[True] * len(block_hosts)]
    pick = lambda values, kind: F.get(
        F.array(*[F.lit(v).cast(kind) for v in values]) if values else F.array().cast(f"array<{kind}>"), F.col("code").cast("int")
    )
    host, path = host_and_path(named(pages, url_col))
    parted = pages.select(named(pages, id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    coded = parted.withColumn("code", decide("host", "path"))
    return coded.select(
        "page_id", "host", "path",
        pick(names, "string").alias("rule"),
        F.when(F.coalesce(pick(blocked, "boolean"), F.lit(False)), "block").otherwise("allow").alias("verdict"),
        pick([*[None] * n_rules, *block_hosts], "string").alias("matched_host_glob"),
    )
