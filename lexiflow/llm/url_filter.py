"""URL filtering with a bit-parallel wildcard automaton.

All glob rules are packed into one row of 64-bit words: a bit per state, a state per literal
character and one before it. Reading one character of a URL moves every rule at once: shift all
bits by one, keep those whose literal is that character, and keep those standing on a wildcard
that takes it. A batch of URLs is simulated together, so each step is a handful of array
operations over (URLs x words).

``*`` takes any run of characters but ``/``, ``**`` any run at all, ``?`` one character. A canonical
URL is its host, A-Z in lower case, followed by its path.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains and a prefix of the path; the longest that fits decides."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[str, str]:
        return f"{self.text}**", f"*.{self.text}**"


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)
#: Any of these blocks a URL on which no rule has a say.
BLOCK_GLOBS = ("**spam**", "**casino**", "**porn**", "**viagra**")


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z in lower case, and path of a URL; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    cut = min(ends, default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    ends = [i for i in map(rest.find, "?#") if i >= 0]
    return host.translate(_ASCII_LOWER), rest[: min(ends, default=len(rest))]


class Automaton:
    """Globs compiled to masks. ``match`` gives a boolean row per text, a column per glob."""

    def __init__(self, globs: Sequence[str]) -> None:
        literal: dict[str, list[int]] = {}
        anyone: list[int] = []
        loops: list[int] = []
        wide: list[int] = []
        starts, ends = [], []
        state = 0
        for glob in globs:
            starts.append(state)
            i = 0
            while i < len(glob):
                if glob[i] == "*":
                    deep = glob[i : i + 2] == "**"
                    (wide if deep else loops).append(state)
                    i += 2 if deep else 1
                    continue
                state += 1
                if glob[i] == "?":
                    anyone.append(state)
                else:
                    literal.setdefault(glob[i], []).append(state)
                i += 1
            ends.append(state)
            state += 1
        self.n_words = max(1, -(-state // 64))
        self.classes = {c: k + 1 for k, c in enumerate(sorted(set(literal) | {"/"}))}
        n = len(self.classes) + 1
        self.step = np.zeros((n, self.n_words), np.uint64)
        self.stay = np.zeros((n, self.n_words), np.uint64)
        for c in range(n):
            self._set(self.step[c], anyone)
            self._set(self.stay[c], wide + (loops if c != self.classes["/"] else []))
        for char, states in literal.items():
            self._set(self.step[self.classes[char]], states)
        self.start = np.zeros(self.n_words, np.uint64)
        self._set(self.start, starts)
        self.last = np.zeros(self.n_words, np.uint64)
        self._set(self.last, ends)
        self.ends = np.array(ends, np.int64)

    @staticmethod
    def _set(words: np.ndarray, bits: Sequence[int]) -> None:
        for b in bits:
            words[b >> 6] |= np.uint64(1 << (b & 63))

    def match(self, texts: Sequence[str]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        table = np.zeros(0x110000, np.uint8 if len(self.classes) < 255 else np.uint32)
        for char, k in self.classes.items():
            table[ord(char)] = k
        kinds = table[codes]
        order = np.argsort(-lengths, kind="stable")
        begin = (np.cumsum(lengths) - lengths)[order]
        sorted_lengths = lengths[order]
        states = np.tile(self.start, (len(texts), 1))
        one, carry = np.uint64(1), np.uint64(63)
        for t in range(int(sorted_lengths[0]) if len(texts) else 0):
            live = int(np.searchsorted(-sorted_lengths, -t, "left"))  # texts longer than t stand first
            kind = kinds[begin[:live] + t]
            now = states[:live]
            # A glob's last state never moves on into the next glob's first one.
            free = now & ~self.last
            moved = free << one
            moved[:, 1:] |= free[:, :-1] >> carry
            states[:live] = (moved & self.step[kind]) | (now & self.stay[kind])
        found = (states[:, self.ends >> 6] >> (self.ends & 63).astype(np.uint64)) & one
        out = np.empty((len(texts), len(self.ends)), bool)
        out[order] = found.astype(bool)
        return out


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES, block_globs: Sequence[str] = BLOCK_GLOBS) -> DataFrame:
    """One row per input row: ``id_col``, host, path, rule, verdict, matched_glob.

    The longest rule that fits decides (of equally long ones, the first listed). Without one, rule
    is null and the verdict is ``block`` if a block glob matches (matched_glob: the first of them),
    else ``allow``. A null URL, or one without ``://``, has an empty host and path and is allowed.
    Repeated rows give repeated rows, an empty table none; other columns are not looked at.
    """
    rules, block_globs = list(rules), list(block_globs)
    globs = [g for r in rules for g in r.globs] + block_globs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        rank = sorted(range(len(rules)), key=lambda k: -len(rules[k].text))
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            hit = automaton.match([h + p for h, p in parts])
            of_rule = hit[:, : 2 * len(rules)].reshape(len(parts), len(rules), 2).any(axis=2)
            of_glob = hit[:, 2 * len(rules) :]
            chosen = [next((k for k in rank if row[k]), None) for row in of_rule]
            glob = [block_globs[int(row.argmax())] if row.any() else None for row in of_glob]
            verdict = [rules[k].verdict if k is not None else "block" if g else "allow" for k, g in zip(chosen, glob, strict=True)]
            columns = [[h for h, _ in parts], [p for _, p in parts], [None if k is None else rules[k].text for k in chosen], verdict, glob]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.string()) for c in columns)], ["id", "host", "path", "rule", "verdict", "matched_glob"])

    out = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, "id long, host string, path string, rule string, verdict string, matched_glob string")
    return out.withColumnRenamed("id", id_col)
