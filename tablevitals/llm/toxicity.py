"""Toxicity scores: gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are densities of a weighted lexicon, how near its hits stand to
words of address, capitals, punctuation and disguised spellings. Lexicon, trees
and calibration are learned from labelled rows; nothing but the text is scored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.llm.common import carries_its_code, fresh, map_column, text_crc32, written

carries_its_code(__name__)

# Rows whose crc32(doc_id) mod 4 is this one are never learned from.
HELD_OUT = 2
# Words of address in the languages of the corpus.
ADDRESS = re.compile(
    r"\b(?:you|your|yours|yourself|u|ur|du|dich|dir|dein\w*|ihr|euch|sie|tu|te|toi|ton|ta|tes|vous|votre|vos|usted\w*|tú|ti|tus?|vosotros)\b"
)
WORD = re.compile(r"[^\W\d_]+")
# Signs that may stand for or between letters, before a letter.
SIGNS = re.compile(r"[@$!*0134578._\-]{1,3}(?=[^\W\d_])")
PLAIN_LETTER = str.maketrans({"@": "a", "$": "s", "!": "i", "*": "", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s",
                              "7": "t", "8": "b", ".": "", "_": "", "-": ""})
PREFIX_LENGTHS = (4, 5, 6)
NEAR_CHARS = 40
FEATURES = 13
# Terms that a task counts before it passes them on.
TERMS_AT_ONCE = 100_000


class Lexicon:
    """Weighted whole words and word beginnings (``term*``), all found with one automaton."""

    def __init__(self, weights: dict[str, float]):
        both: dict[str, list[float]] = {}
        for term, weight in weights.items():
            both.setdefault(term.rstrip("*"), [0.0, 0.0])[term.endswith("*")] = weight
        self.automaton = ahocorasick.Automaton()
        for plain, (whole, start) in both.items():
            self.automaton.add_word(plain, (len(plain), whole, start))
        self.automaton.make_automaton()
        self.empty = not both

    def hits(self, text: str) -> dict[int, float]:
        """Places of the words found in lower-case ``text``, each with its largest weight."""
        found: dict[int, float] = {}
        if self.empty:
            return found
        n = len(text)
        for end, (length, whole, start) in self.automaton.iter(text):
            begin = end - length + 1
            if begin and text[begin - 1].isalpha():
                continue
            ends = end + 1 == n or not text[end + 1].isalpha()
            weight = max(whole, start) if ends else start
            if weight > found.get(begin, 0.0):
                found[begin] = weight
        return found


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of one whole text; zeros for an empty one."""
    n = len(text)
    if n == 0:
        return [0.0] * FEATURES
    words = text.count(" ") + text.count("\n") + 1
    low = text.lower()
    if len(low) != n:  # a few letters grow; places must stay comparable
        n = len(low)
    hits = lexicon.hits(low)
    weights = sorted(hits.values(), reverse=True)
    near = 0
    if hits:
        address = np.array([m.start() for m in ADDRESS.finditer(low)])
        if len(address):
            places = np.array(sorted(hits))
            at = np.searchsorted(address, places)
            gap = np.minimum(np.abs(places - address[np.minimum(at, len(address) - 1)]),
                             np.abs(places - address[np.maximum(at - 1, 0)]))
            near = int((gap <= NEAR_CHARS).sum())
    disguised = disguised_hits = 0
    done = 0
    for m in SIGNS.finditer(low):
        begin, end = m.start(), m.end()
        if begin < done or begin == 0 or not low[begin - 1].isalpha():
            continue
        while begin > done and not low[begin - 1].isspace():
            begin -= 1
        while end < n and not low[end].isspace():
            end += 1
        done = end
        disguised += 1
        disguised_hits += bool(lexicon.hits(low[begin:end].translate(PLAIN_LETTER)))
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    capitals = int(((data >= 65) & (data <= 90)).sum())
    marks = sum(map(text.count, ".,;:?"))
    per = 100.0 / words
    return [
        float(len(hits)),
        len(hits) * per,
        sum(weights),
        sum(weights) * per,
        weights[0] if weights else 0.0,
        weights[1] if len(weights) > 1 else 0.0,
        near * per,
        capitals / n,
        text.count("!") * per,
        marks * per,
        disguised * per,
        float(disguised_hits),
        float(np.log1p(words)),
    ]


def term_counts(df: DataFrame, text: str, label: str) -> DataFrame:
    """Number of toxic and other texts with each word or word beginning; like texts count once.

    Texts with the same smallest hash of five words are taken as copies of one another,
    so that what a copied text happens to contain doesn't look like a sign.
    """

    def smallest(text: str) -> int:
        words = text.lower().split()
        return min(zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4)))

    def signature(texts: list) -> list:
        return [[smallest(t or "") for t in texts]]

    (key,) = fresh(df, "signature")
    signed = map_column(df.select(F.col(text).alias("original"), label), "original", f"{key} long", lambda: signature)
    single = signed.select("original", label, key).dropDuplicates([key, label])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()

        def passed_on() -> pa.RecordBatch:
            terms = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(terms, pa.string()), *(pa.array([counts[k][t] for t in terms], pa.int64()) for k in (1, 0))]
            counts[0].clear()
            counts[1].clear()
            return pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "other"])

        for batch in batches:
            for content, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set(WORD.findall((content or "").lower()))
                counts[toxic].update(found)
                counts[toxic].update({f"{w[:k]}*" for w in found for k in PREFIX_LENGTHS if len(w) >= k})
                if len(counts[0]) + len(counts[1]) > TERMS_AT_ONCE:
                    yield passed_on()
        yield passed_on()

    partial = single.select("original", label).mapInArrow(run, "term string, toxic long, other long")
    return partial.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn_lexicon(sample: DataFrame, text: str, label: str, size: int, least: int) -> dict[str, float]:
    """Terms with the largest log odds of toxic against other texts, beyond what chance would give."""
    counts = term_counts(sample, text, label)
    totals = sample.groupBy(label).count().collect()
    n = {r[0]: r[1] for r in totals}
    toxic, other = n.get(1, 0) + 1.0, n.get(0, 0) + 1.0
    odds = F.log((F.col("toxic") + 0.25) / (toxic - F.col("toxic") + 0.25)) - F.log(
        (F.col("other") + 0.25) / (other - F.col("other") + 0.25)
    )
    error = F.sqrt(1 / (F.col("toxic") + 0.25) + 1 / (F.col("other") + 0.25))
    rows = (
        counts.filter((F.col("toxic") >= least) & (F.col("toxic") / toxic > 4 * F.col("other") / other))
        .select("term", odds.alias("odds"), (odds / error).alias("surety"))
        .filter("odds > 1.5 AND surety > 3")
        .orderBy(F.desc("surety"), "term")
        .limit(size)
        .collect()
    )
    return {r["term"]: float(r["odds"]) for r in rows}


@dataclass
class BoostedTrees:
    """Trees of equal depth as arrays: a feature and threshold per inner node, a value per leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    knots: np.ndarray
    heights: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return np.clip(np.interp(self.margin(x), self.knots, self.heights), 0.0, 1.0)


def boost(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float, bins: int = 64, ridge: float = 2.0,
          least: int = 20) -> BoostedTrees:
    """Logistic gradient boosting over binned features; all nodes of a level are split together."""
    n, width = x.shape
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if n else 1e-3
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) if n else np.zeros(1) for j in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]) if n else None
    inner = 2**depth - 1
    trees = ([], [], [])
    margin = np.full(n, base)
    for _ in range(rounds if n else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            place = node - first
            gain = np.full(wide, 1e-9)
            for j, c in enumerate(cuts):
                size = len(c) + 1
                cell = place * size + binned[:, j]
                g, h, k = (
                    np.bincount(cell, v, wide * size).reshape(wide, size).cumsum(1) for v in (gradient, curve, np.ones(n))
                )
                g_all, h_all, k_all = g[:, -1:], h[:, -1:], k[:, -1:]
                better = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
                better[(k < least) | (k_all - k < least)] = 0
                best = better[:, :-1].argmax(1) if size > 1 else np.zeros(wide, dtype=np.int64)
                value = better[np.arange(wide), best]
                for i in np.flatnonzero(value > gain):
                    if size > 1:
                        gain[i], feature[first + i], threshold[first + i] = value[i], j, c[best[i]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        place = node - inner
        leaf = rate * np.bincount(place, gradient, inner + 1) / (np.bincount(place, curve, inner + 1) + ridge)
        margin += leaf[place]
        for kept, part in zip(trees, (feature, threshold, leaf)):
            kept.append(part)
    shape = (len(trees[0]), -1)
    feature, threshold, leaf = (np.array(t).reshape(shape) if t else np.zeros((0, 1)) for t in trees)
    return BoostedTrees(base, feature.astype(np.int64), threshold, leaf, np.array([base]), np.array([share]))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and heights of the non-decreasing fit of ``y`` (pool adjacent violators, equal margins pooled first)."""
    values, at = np.unique(margin, return_inverse=True)
    weight = np.bincount(at).astype(float)
    mean = np.bincount(at, y) / weight
    blocks: list[list[float]] = []  # mean, weight, first, last
    for v, m, w in zip(values, mean, weight):
        blocks.append([m, w, v, v])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, last = blocks.pop()
            m1, w1, first, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last])
    knots = [k for _, _, first, last in blocks for k in ((first, last) if last > first else (first,))]
    heights = [m for m, _, first, last in blocks for _ in range(2 if last > first else 1)]
    return np.array(knots), np.array(heights)


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    trees: BoostedTrees


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labels: int) -> DataFrame:
    """``text, label, fold``: at most ``max_labels`` different (doc_id, text) outside the held-out remainder.

    Every chosen doc_id gives one text before any gives a second, so that a
    repeated doc_id neither crowds out others nor counts more than once a text.
    """
    usable = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(F.pmod(text_crc32("doc_id"), F.lit(4)) != HELD_OUT)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labels)
    )
    # The sample is bounded by its parameter: 16 bytes a row, and the text's hash.
    chosen = usable.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)))
    mark = F.coalesce(F.md5("text"), F.lit(""))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("mark", mark)
    keys = written(found.select("doc_id", "mark").distinct().withColumn("place", F.xxhash64("doc_id", "mark")))
    first = keys.groupBy("doc_id").agg(F.min("place").alias("first"))
    ranked = keys.join(F.broadcast(first), "doc_id").orderBy(F.col("place") > F.col("first"), "place", "doc_id", "mark")
    picked = ranked.limit(max_labels).select("doc_id", "mark")
    rows = found.join(F.broadcast(picked), ["doc_id", "mark"]).distinct()
    return written(rows.select("text", "label", "fold"))


def train_toxicity(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, lexicon_size: int = 400,
                   rounds: int = 60, depth: int = 3, rate: float = 0.15) -> ToxicityModel:
    """Learns from at most ``max_labels`` different labelled rows outside the held-out remainder, those with the smallest hash.

    Two thirds of them train the trees, a third the calibration. A doc_id with
    several labels counts as toxic if one says so; null and other labels are
    ignored. Without usable labels every score is the base rate of 0.001.
    """
    sample = labelled_sample(docs, labels, max_labels)
    weights = learn_lexicon(sample.filter("fold > 0").select("text", "label"), "text", "label", lexicon_size, 5)

    def start() -> Callable[[list], list]:
        lexicon = Lexicon(weights)
        return lambda texts: [[features(t or "", lexicon) for t in texts]]

    rows = map_column(sample, "text", "x array<double>", start).select("label", "fold", "x").toArrow()
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, FEATURES)
    y = rows.column("label").to_numpy().astype(float)
    fit = rows.column("fold").to_numpy() > 0
    trees = boost(x[fit], y[fit], rounds, depth, rate)
    if (~fit).any():
        trees.knots, trees.heights = isotonic(trees.margin(x[~fit]), y[~fit])
    return ToxicityModel(weights, trees)


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``) for each whole text.

    Null counts as empty; an empty text has features of zero and a score like
    any other. Repeated rows give repeated rows, an empty table none; columns
    with the new names are replaced.
    """

    def start() -> Callable[[list], list]:
        lexicon = Lexicon(model.weights)

        def compute(texts: list) -> list:
            x = np.array([features(t or "", lexicon) for t in texts], dtype=float).reshape(-1, FEATURES)
            score = model.trees.probability(x)
            return [score, (score >= threshold).astype(np.int32)]

        return compute

    return map_column(df, text, "score double, predicted int", start)
