"""Rule-based quality filter with a short-circuit cascade.

Every rule is a condition on a few figures of the text. A rule costs what its
figures cost. Cost and rejection share of each rule are measured on a bounded
sample, and the rules then run in the order of rejection per cost: a document
that one rule rejects is not looked at by the next ones. The order changes the
time, never the verdict, because a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import words

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_TAIL = (np.arange(256) & 0xC0) == 0x80
_UPPER = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)
_LETTER = words.LETTER & ~_TAIL
REPEAT_WINDOW = 3


class Texts:
    """A block of texts with figures that are worked out on first use."""

    def __init__(self, block: words.Block):
        self.block = block
        self._have: dict[str, np.ndarray] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._have:
            self._have[name] = getattr(self, "_" + name)()
        return self._have[name]

    def _per_text(self, flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.block.offsets[1:]] - sums[self.block.offsets[:-1]]

    def _runs(self):
        return self.block.words()

    def _word_hashes(self):
        starts, ends, _ = self["runs"]
        return self.block.hashes(starts, ends)

    def _n_words(self):
        return np.diff(self["runs"][2])

    def _word_chars(self):
        return self._per_text(~words.BLANK[self.block.data] & ~_TAIL[self.block.data])

    def _n_symbols(self):
        return self._per_text(_SYMBOL[self.block.data])

    def _n_upper(self):
        return self._per_text(_UPPER[self.block.data])

    def _n_letters(self):
        return self._per_text(_LETTER[self.block.data])

    def _n_dup_lines(self):
        """Lines with a word that equal an earlier line of the text."""
        breaks = np.ones(256, bool)
        breaks[0x0A] = False
        starts, ends, offsets = self.block.runs(breaks)
        word_starts = self["runs"][0]
        worded = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
        text = words.owners(offsets)
        key = words.mix(self.block.hashes(starts, ends) + text.astype(np.uint64))
        key, text = key[worded], text[worded]
        _, first = np.unique(key, return_index=True)
        n = len(self.block)
        return np.bincount(text, minlength=n) - np.bincount(text[first], minlength=n)

    def _n_repeat_words(self):
        """Words inside three-word windows that the text has twice or more."""
        offsets = self["runs"][2]
        value, ends = words.windows(self["word_hashes"], offsets, REPEAT_WINDOW)
        text = words.owners(ends)
        key = words.mix(value + text.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[inverse] > 1)
        covered = np.zeros(offsets[-1] + 1, bool)
        begin = at - ends[text[at]] + offsets[text[at]]
        for k in range(REPEAT_WINDOW):
            covered[begin + k] = True
        sums = np.concatenate([[0], np.cumsum(covered, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def part(self, which: np.ndarray) -> Texts:
        """The chosen texts as a block of their own."""
        b = self.block
        sizes = np.diff(b.offsets)[which]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(offsets[-1]) + np.repeat(b.offsets[:-1][which] - offsets[:-1], sizes)
        return Texts(words.Block(0, b.raw[at], offsets, False))


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps texts to a boolean array, True where the text goes."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


# Integer arithmetic only, so that every engine decides alike.
BASE_RULES = (
    Rule("too_few_words", lambda t: t["n_words"] < 50),
    Rule("repeated_words", lambda t: 100 * t["n_repeat_words"] > 50 * t["n_words"]),
)
RULES = (
    Rule("symbols", lambda t: 10 * t["n_symbols"] > 3 * t["n_words"]),
    Rule("shouting", lambda t: 2 * t["n_upper"] > t["n_letters"]),
    Rule("word_length", lambda t: (t["word_chars"] < 2 * t["n_words"]) | (t["word_chars"] > 20 * t["n_words"])),
    Rule("repeated_lines", lambda t: 10 * t["n_dup_lines"] > 3 * t["n_words"]),
    Rule("few_letters", lambda t: 2 * t["n_letters"] < t["word_chars"]),
)


def measure(sample: pa.Array, rules: tuple[Rule, ...] = RULES) -> dict[str, tuple[float, float]]:
    """Seconds and rejected share of each rule, each run on its own over a sample."""
    out = {}
    for rule in rules:
        seen = rejected = 0
        began = time.process_time()
        for block in words.blocks(sample, lower=False):
            bad = rule.rejects(Texts(block))
            seen, rejected = seen + len(bad), rejected + int(bad.sum())
        out[rule.name] = (time.process_time() - began, rejected / max(seen, 1))
    return out


def ordered(rules: tuple[Rule, ...], measured: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """Rules by rejected share per second, the best first; ties by name."""
    return tuple(sorted(rules, key=lambda r: (-measured[r.name][1] / max(measured[r.name][0], 1e-9), r.name)))


def cascade(texts: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """Number of the rule that rejects each text, -1 where none does.

    Later rules see only the texts that are left, unless so few are gone that a
    copy of the rest would cost more than it saves.
    """
    verdict = np.full(len(texts.block), -1)
    left = np.arange(len(texts.block))
    for number, rule in enumerate(rules):
        fresh = rule.rejects(texts) & (verdict[left] < 0)
        verdict[left[fresh]] = number
        still = verdict[left] < 0
        if not still.any():
            break
        if 4 * (~still).sum() > len(left):
            left, texts = left[still], texts.part(np.flatnonzero(still))
    return verdict


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rules(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    base: tuple[Rule, ...] = BASE_RULES,
    rules: tuple[Rule, ...] = RULES,
    sample_rows: int = 2000,
) -> DataFrame:
    """One row per row of ``docs``: id, figures, base_failed, kept, failed_rule.

    ``sample_rows`` bounds the sample on which cost and selectivity are
    estimated. Texts that a base rule rejects do not enter the cascade.
    NULL and empty texts have no words and fail the base; repeated ids and texts
    give one row each; an empty table gives an empty result; other columns are
    not read.
    """
    # A hash thins the rows out first, so that no partition sends a sample of its own.
    step = max(1, docs.count() // (2 * sample_rows))
    thin = F.pmod(F.xxhash64(id_column, text_column), F.lit(step)) == 0
    picked = docs.where(thin).select(F.col(text_column).alias("text")).where(F.col("text").isNotNull()).limit(sample_rows)
    chosen = ordered(rules, measure(picked.toArrow()["text"].combine_chunks(), rules))
    names = [rule.name for rule in (*base, *chosen)]
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in FIGURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column(1), lower=False):
                texts = Texts(block)
                columns = [batch.column(0).slice(block.first, len(block))]
                columns += [pa.array(texts[c].astype(np.int64)) for c in FIGURES]
                fail = np.full(len(block), -1)
                for number in reversed(range(len(base))):
                    fail[base[number].rejects(texts)] = number
                good = np.flatnonzero(fail < 0)
                if len(good):
                    verdict = cascade(texts if len(good) == len(block) else texts.part(good), chosen)
                    fail[good] = np.where(verdict < 0, -1, verdict + len(base))
                columns.append(pa.array((fail >= 0) & (fail < len(base))))
                columns.append(pa.array(fail < 0))
                columns.append(pa.array([names[k] if k >= 0 else None for k in fail], pa.string()))
                yield pa.RecordBatch.from_arrays(
                    columns, [id_column, *FIGURES, "base_failed", "kept", "failed_rule"]
                )

    return docs.select(id_column, text_column).mapInArrow(
        run, f"{schema}, base_failed boolean, kept boolean, failed_rule string"
    )
