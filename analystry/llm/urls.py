"""URL filter: all glob rules run at once, as bits of one multiword Shift-And automaton.

Every glob is a chain of bits: a start bit and one bit per literal. Reading a byte c turns the state D into
((D << 1) & MOVE[c]) | (D & STAY[c]); MOVE has the literals that accept c, STAY the places where a wildcard waits. All globs
lie one behind the other in 64-bit words, so one step moves all of them, and NumPy steps a whole batch of URLs together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with the rule's path.
SITE_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)

#: Globs over host and path for URLs that no site rule fits: `*` is any run without a slash, `**` any run, `?` any one byte.
BLOCK_GLOBS = (
    "ads.**", "**/ads/**", "**/login*", "**/cart/**", "**/wp-admin/**", "**.exe", "**.zip", "**/tag/*/page/**",
    "*casino*/**", "*.onion/**",
)

#: Bytes of one padded block of URLs.
BLOCK_BYTES = 1 << 23


class GlobAutomaton:
    """Many globs in one bit-parallel automaton."""

    def __init__(self, globs: Sequence[str]):
        self.globs = list(globs)
        plans, size = [], 0
        for glob in self.globs:
            plan = self._parse(glob.encode())
            plans.append((size, plan))
            size += len(plan)
        words = max(1, -(-size // 64))
        self.move = np.zeros((256, words), np.uint64)
        self.stay = np.zeros((256, words), np.uint64)
        self.start = np.zeros(words, np.uint64)
        self.final = []
        slash = ord("/")
        for first, plan in plans:
            for k, (literal, wait) in enumerate(plan):
                word, bit = divmod(first + k, 64)
                flag = np.uint64(1 << bit)
                if k == 0:
                    self.start[word] |= flag
                elif literal is None:
                    self.move[:, word] |= flag
                else:
                    self.move[literal, word] |= flag
                if wait:
                    self.stay[:, word] |= flag
                    if wait == 1:
                        self.stay[slash, word] &= ~flag
            self.final.append(divmod(first + len(plan) - 1, 64))

    @staticmethod
    def _parse(glob: bytes) -> list[tuple[int | None, int]]:
        """States in order: (byte that leads here or None for any, 0 none / 1 `*` / 2 `**` waiting here)."""
        states: list[tuple[int | None, int]] = [(None, 0)]
        k = 0
        while k < len(glob):
            if glob[k] == ord("*"):
                double = glob[k:k + 2] == b"**"
                states[-1] = (states[-1][0], max(states[-1][1], 2 if double else 1))
                k += 2 if double else 1
            else:
                states.append((None if glob[k] == ord("?") else glob[k], 0))
                k += 1
        return states

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix texts x globs."""
        out = np.zeros((len(texts), len(self.globs)), bool)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        first = 0
        while first < len(order):
            widest = max(1, int(lengths[order[first]]))
            chosen = order[first:first + max(1, BLOCK_BYTES // widest)]
            first += len(chosen)
            padded = np.zeros((widest, len(chosen)), np.uint8)
            for column, row in enumerate(chosen):
                padded[:lengths[row], column] = np.frombuffer(texts[row], np.uint8)
            state = self._run(padded, lengths[chosen])
            for glob, (word, bit) in enumerate(self.final):
                out[chosen, glob] = (state[:, word] >> np.uint64(bit)) & np.uint64(1)
        return out

    def _run(self, padded: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Final states; columns come longest first, so the running ones are a prefix."""
        state = np.tile(self.start, (padded.shape[1], 1))
        one, top = np.uint64(1), np.uint64(63)
        running = np.searchsorted(-lengths, -np.arange(padded.shape[0]), side="left")
        for at in range(padded.shape[0]):
            active = state[:running[at]]
            byte = padded[at, :running[at]]
            moved = active << one
            moved[:, 1:] |= active[:, :-1] >> top
            state[:running[at]] = (moved & self.move[byte]) | (active & self.stay[byte])
        return state


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", site_rules=SITE_RULES, block_globs=BLOCK_GLOBS) -> DataFrame:
    """One row per row of `pages`: key, host, path, rule, verdict and the first block glob that matched.

    The verdict is that of the longest fitting site rule; without one, `block` if a glob matches and `allow` if not. A null
    URL or one without `://` has an empty host and path, no rule and is allowed unless a glob matches the empty string.
    Repeated rows are judged each; other columns of `pages` are not read; an empty table gives an empty result.
    """
    rules = sorted(site_rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    globs = [g for host, path, _ in rules for g in (f"{host}{path}**", f"*.{host}{path}**")] + list(block_globs)
    names = [host + path for host, path, _ in rules]
    verdicts = [verdict for _, _, verdict in rules]
    blocked = list(block_globs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton(globs)
        for batch in batches:
            host, path = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            hit = automaton.matches([(h + p).encode() for h, p in zip(host, path)])
            by_rule = hit[:, :2 * len(names)].reshape(len(host), len(names), 2).any(axis=2)
            by_glob = hit[:, 2 * len(names):]
            rule = np.where(by_rule.any(axis=1), by_rule.argmax(axis=1), -1) if names else np.full(len(host), -1)
            glob = np.where(by_glob.any(axis=1), by_glob.argmax(axis=1), -1) if blocked else np.full(len(host), -1)
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("host"), batch.column("path"),
                pa.array([names[r] if r >= 0 else None for r in rule], pa.string()),
                pa.array([verdicts[r] if r >= 0 else "block" if g >= 0 else "allow" for r, g in zip(rule, glob)], pa.string()),
                pa.array([blocked[g] if g >= 0 else None for g in glob], pa.string()),
            ], ["key", "host", "path", "rule", "verdict", "matched_glob"])

    parts = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    parts = parts.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    kind = parts.schema["key"].dataType.simpleString()
    judged = parts.mapInArrow(judge, f"key {kind}, host string, path string, rule string, verdict string, matched_glob string")
    return judged.withColumnRenamed("key", key)
