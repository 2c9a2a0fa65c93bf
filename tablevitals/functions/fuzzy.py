"""Weighted fuzzy similarity of short texts, 0 to 100.

The score is the published "WRatio" of the fuzzy-matching libraries:

* ``ratio`` = 200 * LCS / (len a + len b), LCS the longest common subsequence;
* similar lengths (longer / shorter < 1.5): the larger of ``ratio`` and 0.95
  times the token ratio (words sorted, or compared as sets);
* otherwise: the larger of ``ratio``, the best window of the longer text times
  a scale, and the same over sorted words times 0.95 and the scale.

``best_match_udf`` scores lists of values against lists of candidates
and ``wratio_udf`` two columns; both run in Arrow batches. LCS lengths come from
the bit-parallel recurrence, over all candidates in one numpy operation.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The UDFs carry this module's code to the executors, which need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = 64  # texts up to this length use the numpy form, longer ones Python integers

# Fixed values of the score's definition.
UNBASE_SCALE = 0.95
LENGTH_RATIO_PARTIAL = 1.5
LENGTH_RATIO_FAR = 8.0
PARTIAL_SCALE = 0.9
PARTIAL_SCALE_FAR = 0.6


def char_masks(text: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(text):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    return masks


def lcs_length(a: str, b: str) -> int:
    masks, full = char_masks(a), (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def window_ratio(shorter: str, longer: str) -> float:
    """Best ``ratio`` of the shorter text with any window of its length, cut at both ends."""
    size = len(shorter)
    if not size:
        return 0.0 if longer else 100.0
    if size > WORD:
        return max(
            ratio(shorter, longer[max(0, i) : i + size]) for i in range(1 - size, len(longer))
        )
    masks = char_masks(shorter)
    cells = np.zeros(len(longer) + 2 * (size - 1), dtype=np.uint64)
    cells[size - 1 : size - 1 + len(longer)] = [masks.get(ch, 0) for ch in longer]
    lcs = _windows_lcs(cells, size, len(longer) + size - 1)
    start = np.arange(1 - size, len(longer))
    width = np.minimum(start + size, len(longer)) - np.maximum(start, 0)
    return float((200.0 * lcs / (size + width)).max())


def _windows_lcs(cells: np.ndarray, size: int, windows: int) -> np.ndarray:
    """LCS of a text of ``size`` with every window of that many cells."""
    row = np.full(windows, ~np.uint64(0))
    for k in range(size):
        mask = cells[k : k + windows]
        hit = row & mask
        row = (row + hit) | (row - hit)
    return np.bitwise_count(~row & np.uint64((1 << size) - 1)).astype(np.int64)


def partial_ratio(a: str, b: str) -> float:
    shorter, longer = (a, b) if len(a) <= len(b) else (b, a)
    best = window_ratio(shorter, longer)
    return max(best, window_ratio(longer, shorter)) if len(a) == len(b) else best


def sorted_words(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_set_ratio(a: str, b: str) -> float:
    words_a, words_b = set(a.split()), set(b.split())
    if not words_a or not words_b:
        return 0.0
    shared, only_a, only_b = words_a & words_b, words_a - words_b, words_b - words_a
    if shared and not (only_a and only_b):
        return 100.0
    rest_a, rest_b = " ".join(sorted(only_a)), " ".join(sorted(only_b))
    common = len(" ".join(sorted(shared)))
    gap = 1 if common else 0
    full_a, full_b = common + gap + len(rest_a), common + gap + len(rest_b)
    distance = len(rest_a) + len(rest_b) - 2 * lcs_length(rest_a, rest_b)
    scores = [100.0 - 100.0 * distance / (full_a + full_b)]
    if common:
        scores += [100.0 - 100.0 * (gap + len(r)) / (common + f) for r, f in ((rest_a, full_a), (rest_b, full_b))]
    return max(scores)


def token_ratio(a: str, b: str) -> float:
    return max(ratio(sorted_words(a), sorted_words(b)), token_set_ratio(a, b))


def partial_token_ratio(a: str, b: str) -> float:
    words_a, words_b = set(a.split()), set(b.split())
    if words_a & words_b:
        return 100.0
    best = partial_ratio(sorted_words(a), sorted_words(b))
    return max(best, partial_ratio(" ".join(sorted(words_a)), " ".join(sorted(words_b))))


def wratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    far = max(len(a), len(b)) / min(len(a), len(b))
    base = ratio(a, b)
    if far < LENGTH_RATIO_PARTIAL:
        return max(base, UNBASE_SCALE * token_ratio(a, b))
    scale = PARTIAL_SCALE if far <= LENGTH_RATIO_FAR else PARTIAL_SCALE_FAR
    return max(base, scale * partial_ratio(a, b), UNBASE_SCALE * scale * partial_token_ratio(a, b))


class TextBlock:
    """Candidate texts laid out so that one text is compared with all of them at once."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        self.fits = self.length <= WORD
        self.full = np.array([(1 << n) - 1 if n <= WORD else 0 for n in self.length.tolist()], dtype=np.uint64)
        self.masks: dict[str, np.ndarray] = {}
        for i, text in enumerate(texts):
            if len(text) <= WORD:
                for ch, mask in char_masks(text).items():
                    self.masks.setdefault(ch, np.zeros(len(texts), dtype=np.uint64))[i] = mask
        self.none = np.zeros(len(texts), dtype=np.uint64)
        self.code = {ch: n + 1 for n, ch in enumerate(sorted({ch for t in texts for ch in t}))}
        self.windows_of_size = lru_cache(maxsize=WORD)(self._windows_of_size)

    def lcs(self, text: str) -> np.ndarray:
        row = np.full(len(self.texts), ~np.uint64(0))
        for ch in text:
            hit = row & self.masks.get(ch, self.none)
            row = (row + hit) | (row - hit)
        result = np.bitwise_count(~row & self.full).astype(np.int64)
        for i in np.flatnonzero(~self.fits):
            result[i] = lcs_length(self.texts[i], text)
        return result

    def _windows_of_size(self, size: int):
        """All candidates longer than ``size`` in one code array, padded apart."""
        rows = np.flatnonzero(self.length > size)
        pad = [0] * (size - 1)
        codes, starts = list(pad), []
        for i in rows:
            starts.append(len(codes) - len(pad))
            codes += [self.code[ch] for ch in self.texts[i]] + pad
        filled = np.concatenate(([0], np.cumsum(np.array(codes, dtype=np.int64) > 0)))
        windows = max(len(codes) - size + 1, 0)
        width = filled[size : size + windows] - filled[:windows]
        return rows, np.array(codes, dtype=np.int64), np.array(starts, dtype=np.int64), width

    def windows(self, text: str, wanted: np.ndarray) -> np.ndarray:
        """``partial_ratio`` of ``text`` with the ``wanted`` candidates of another length."""
        result = np.zeros(len(self.texts))
        size = len(text)
        longer = wanted & (self.length > size)
        if longer.any() and size <= WORD:
            rows, codes, starts, width = self.windows_of_size(size)
            table = np.zeros(len(self.code) + 1, dtype=np.uint64)
            for ch, mask in char_masks(text).items():
                if ch in self.code:
                    table[self.code[ch]] = mask
            lcs = _windows_lcs(table[codes], size, len(width))
            scores = 200.0 * lcs / (size + width)
            result[rows] = np.maximum.reduceat(scores, starts)
            longer = np.zeros_like(longer)
        shorter = wanted & (self.length < size) & self.fits & (self.length > 0)
        picks = np.flatnonzero(shorter)
        if len(picks):
            widest = int(self.length[picks].max())
            edge = widest - 1
            cells = np.zeros((size + 2 * edge, len(picks)), dtype=np.uint64)
            for p, ch in enumerate(text):
                cells[edge + p] = self.masks.get(ch, self.none)[picks]
            windows = size + edge
            row = np.full((windows, len(picks)), ~np.uint64(0))
            for k in range(widest):
                hit = np.where(k < self.length[picks], row & cells[k : k + windows], np.uint64(0))
                row = (row + hit) | (row - hit)
            lcs = np.bitwise_count(~row & self.full[picks]).astype(np.int64)
            start = np.arange(-edge, size)[:, None]
            width = np.maximum(np.minimum(start + self.length[picks], size) - np.maximum(start, 0), 0)
            result[picks] = (200.0 * lcs / (self.length[picks] + width)).max(axis=0)
        for i in np.flatnonzero(longer | (wanted & ~self.fits & (self.length < size))):
            result[i] = partial_ratio(text, self.texts[i])
        return result


class CandidateScorer:
    """``wratio`` of one text with every candidate."""

    def __init__(self, candidates: list[str]):
        self.candidates = candidates
        self.plain = TextBlock(candidates)
        self.words = [t.split() for t in candidates]
        self.sorted = TextBlock([" ".join(sorted(w)) for w in self.words])
        self.all_sorted = self.sorted.texts == candidates
        self.repeats = np.array([len(set(w)) < len(w) for w in self.words])
        self.with_word: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            for word in set(w):
                self.with_word.setdefault(word, []).append(i)
        self.without = lru_cache(maxsize=256)(self._without)

    def _without(self, shared: tuple[str, ...]) -> TextBlock:
        """The candidates' distinct words, sorted, without the shared ones."""
        return TextBlock([" ".join(sorted(set(w).difference(shared))) for w in self.words])

    def _set_ratios(self, words: set[str], shared_bits: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """``token_set_ratio`` for ``rows``, one pass per set of words shared with the text."""
        result = np.zeros(len(self.candidates))
        order = sorted(words)
        for bits in np.unique(shared_bits[rows]).tolist():
            shared = tuple(w for j, w in enumerate(order) if bits >> j & 1)
            rest = " ".join(w for w in order if w not in shared)
            block = self.without(shared)
            common = len(" ".join(shared))
            gap = 1 if common else 0
            full, fulls = common + gap + len(rest), common + gap + block.length
            distance = len(rest) + block.length - 2 * block.lcs(rest)
            score = 100.0 - 100.0 * distance / np.maximum(full + fulls, 1)
            if common:
                score = np.maximum(score, 100.0 - 100.0 * (gap + len(rest)) / (common + full))
                score = np.maximum(score, 100.0 - 100.0 * (gap + block.length) / (common + fulls))
                score[(block.length == 0) | (not rest)] = 100.0
            picks = rows & (shared_bits == bits)
            result[picks] = score[picks]
        return result

    def scores(self, text: str, floor: float | None = None) -> np.ndarray:
        """All scores. With ``floor``, scores that can reach neither the floor nor
        the best score may be left lower than they are."""
        count = len(self.candidates)
        if not text or not count:
            return np.zeros(count, dtype=np.float32)
        words = text.split()
        distinct = set(words)
        ordered = " ".join(sorted(words))
        if len(distinct) > 60:  # more words than the bit set holds
            return np.array([wratio(text, c) for c in self.candidates], dtype=np.float32)
        shared_bits = np.zeros(count, dtype=np.int64)
        for j, word in enumerate(sorted(distinct)):
            shared_bits[self.with_word.get(word, [])] |= 1 << j
        repeated = self.repeats | (len(distinct) < len(words))
        lengths = self.plain.length
        shortest = np.minimum(lengths, len(text))
        far = np.maximum(lengths, len(text)) / np.maximum(shortest, 1)
        near = far < LENGTH_RATIO_PARTIAL
        common = self.plain.lcs(text)
        best = 200.0 * common / (lengths + len(text))
        reorders = not (self.all_sorted and ordered == text)
        common_words = self.sorted.lcs(ordered) if reorders else common
        if reorders:
            by_words = 200.0 * common_words / np.maximum(self.sorted.length + len(ordered), 1)
            best = np.where(near, np.maximum(best, UNBASE_SCALE * by_words), best)
        sets = near & ((shared_bits > 0) | repeated)
        if sets.any():
            best = np.where(sets, np.maximum(best, UNBASE_SCALE * self._set_ratios(distinct, shared_bits, sets)), best)
        scale = np.where(far <= LENGTH_RATIO_FAR, PARTIAL_SCALE, PARTIAL_SCALE_FAR)
        best = np.where(~near & (shared_bits > 0), np.maximum(best, 100.0 * UNBASE_SCALE * scale), best)
        best[lengths == 0] = 0.0
        # No window has a longer common subsequence than the whole texts.
        wanted = ~near & (lengths > 0)
        if floor is not None:
            reach = scale * 200.0 * common / np.maximum(shortest + common, 1)
            shortest_words = np.minimum(self.sorted.length, len(ordered))
            reach_words = UNBASE_SCALE * scale * 200.0 * common_words / np.maximum(shortest_words + common_words, 1)
            reach = np.maximum(reach, np.where(repeated, 100.0, reach_words))
            wanted &= reach >= max(floor, best.max()) - 1e-6
        if wanted.any():
            parts = scale * self.plain.windows(text, wanted)
            words_wanted = wanted & (shared_bits == 0)
            if reorders and words_wanted.any():
                uneven = words_wanted & (self.sorted.length != len(ordered))
                parts = np.maximum(parts, UNBASE_SCALE * scale * self.sorted.windows(ordered, uneven))
                for i in np.flatnonzero(words_wanted & (~uneven | repeated)):
                    parts[i] = max(parts[i], UNBASE_SCALE * scale[i] * partial_token_ratio(text, self.candidates[i]))
            best = np.where(wanted, np.maximum(best, parts), best)
        return best.astype(np.float32)


MATCH_TYPE = T.ArrayType(T.StructType([T.StructField("match_no", T.IntegerType()), T.StructField("score", T.FloatType())]))


def best_match_udf(floor: float):
    """UDF ``(values, candidates) -> [(match_no, score), …]``: for every value of a list its best candidate.

    Candidates are in preference order; of equal scores the earlier one wins.
    Scores under ``floor`` need not be exact. Declared non-deterministic so that
    the optimizer runs it once, where it stands, and not again inside filters on
    its result.
    """

    @F.pandas_udf(MATCH_TYPE)
    def best_match(values: pd.Series, candidates: pd.Series) -> pd.Series:
        known, scorer, result = None, None, []
        for texts, names in zip(values, candidates):
            names = list(names)
            if names != known:
                known, scorer = names, CandidateScorer(names)
            found = []
            for text in texts:
                scores = scorer.scores(text, floor)
                at = int(scores.argmax())
                found.append({"match_no": at, "score": float(scores[at])})
            result.append(found)
        return pd.Series(result)

    return best_match.asNondeterministic()


@F.pandas_udf(T.FloatType())
def wratio_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    """``wratio`` of two text columns, pair by pair; null if either is."""
    seen: dict[tuple[str, str], float] = {}
    result = []
    for a, b in zip(left, right):
        if a is None or b is None:
            result.append(None)
            continue
        if (a, b) not in seen:
            seen[a, b] = wratio(a, b)
        result.append(seen[a, b])
    return pd.Series(result, dtype="float32")
