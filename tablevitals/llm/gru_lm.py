"""Document log-likelihoods from a gated recurrent language model, beside a smoothed unigram score.

Counts of all training words come from one distributed count. The network is
trained with numpy by truncated backpropagation: every task starts from the
same parameters, trains on its own documents, and the parameters are averaged
by tokens; so all training documents take part and the number of tasks does not
matter to the driver. The softmax is factored into word classes of about equal
mass. Hidden state is carried from window to window through the whole document.

All words are symbols of the network, read and predicted in context: frequent
ones alone, all others by runs of the alphabet of about equal mass. Both grow
with the square root of the distinct words, and so do the softmax's classes with
that of the symbols. The probability of a word of a run is the run's times a
smoothed unigram probability among its words, counted over the whole corpus. A
word's final probability mixes the network's with the plain unigram's; the share
is the one that fits training documents best which the network has not seen.
Counts of frequent words go to the tasks in a table of bounded size; all other
words are joined to their counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablevitals.llm.common import carries_its_code, fresh, release_kept, text_crc32, written

carries_its_code(__name__)

HELD_OUT = 1  # remainder of crc32(doc_id) mod 5 that is never learned from
END = "\n"  # no word holds white space
LN10 = math.log(10.0)
# Distinct words that a task counts before it passes them on.
COUNTED_AT_ONCE = 300_000
SOFTMAX_CELLS = 65_536  # of a softmax worked on at once: they stay in a processor's cache
LANE_CELLS = 2_000_000  # tokens of a group of documents, padding included
# Tokens of a window at least: the more there are, the less each costs.
TRAINED_TOKENS, SCORED_TOKENS = 2_048, 65_536
# Tokens from which on the documents held by a task are run before more are read.
HELD_TOKENS = 8_000_000
# Scored rows go back in pieces: so many at most, and no more after so many tokens.
PIECE_ROWS, PIECE_TOKENS = 1_000, 500_000


@dataclass(frozen=True)
class GruParameters:
    hidden: int = 8
    vocabulary: int = 512  # words alone, the end and a run included: so many even where the distinct words' root is less
    classes: int = 16  # at least; else the square root of the symbols
    head: int = 100_000  # frequent words whose counts travel as one table
    lanes: int = 512
    window: int = 32
    rounds: int = 2  # averagings; the training documents are dealt to the rounds
    passes: int = 1  # over the training documents, whatever their number
    rate: float = 0.03
    check: int = 8  # one in so many training documents is not trained on, but decides how much the network counts
    seed: int = 9


def words_of(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case; ``bytes`` lower and split know no other letters or white space."""
    return text.encode().lower().split() if text else []


def run_numbers(words: list[bytes], borders: np.ndarray) -> np.ndarray:
    """The run of the alphabet that each word is in; ``borders`` are where the second and later ones begin."""
    return np.searchsorted(borders, keys_of(words), "right")


def keys_of(words: list[bytes]) -> np.ndarray:
    """The first eight bytes as a number, in the order of the bytes."""
    return np.array(words, "S8").view(">u8").astype(np.uint64)


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words, and of document ends, of all texts of a task."""
    counts: Counter = Counter()
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def passed_on() -> pa.RecordBatch:
        words = [w.decode() for w in counts]
        batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)
        counts.clear()
        return batch

    for batch in batches:
        counts[END.encode()] += batch.num_rows
        for text in batch.column(0).to_pylist():
            counts.update(words_of(text))
            if len(counts) > COUNTED_AT_ONCE:
                yield passed_on()
    if counts:
        yield passed_on()


class Network:
    """Parameters in one vector: input columns (gates below each other), recurrent matrix, class and word outputs.

    Arrays hold one column for each lane, so that all reductions run along the first axis.
    """

    def __init__(self, p: GruParameters, counts: np.ndarray, vector: np.ndarray | None = None):
        h, v = p.hidden, len(counts)
        self.h = h
        # Words are in order of count, runs of words in that of the alphabet; classes are neighbours of about equal mass.
        share, classes = (counts + 1.0) / (counts + 1.0).sum(), max(p.classes, math.isqrt(v))
        label = np.minimum((np.cumsum(share) - share / 2) * classes, classes - 1).astype(int)
        _, number = np.unique(label, return_inverse=True)
        self.c = int(number.max()) + 1
        self.word_class = number.astype(np.int16 if self.c < 2**15 else np.int64)  # short numbers are sorted faster
        self.first = np.searchsorted(self.word_class, np.arange(self.c + 1))
        self.shapes = [(3 * h, v), (3 * h, h), (self.c, h), (self.c, 1), (v, h), (v, 1)]
        self.sizes = [int(np.prod(s)) for s in self.shapes]
        if vector is None:
            rng = np.random.default_rng(p.seed)
            vector = np.concatenate([rng.normal(0, s, n) for s, n in zip((0.1, 0.25, 0.1, 0, 0.1, 0), self.sizes)])
            mass = np.bincount(self.word_class, share)
            vector[-v:] = np.log(share / mass[self.word_class])
            vector[sum(self.sizes[:3]) : sum(self.sizes[:4])] = np.log(mass)
        self.vector = vector.astype(np.float32)
        self.e, self.u, self.wc, self.bc, self.wo, self.bo = self.parts(self.vector)

    def parts(self, vector: np.ndarray) -> list[np.ndarray]:
        return [x.reshape(s) for x, s in zip(np.split(vector, np.cumsum(self.sizes)[:-1]), self.shapes)]

    def steps(self, state: np.ndarray, inputs: np.ndarray, active: list[int], keep: bool):
        """Runs ``len(active)`` steps; lane i takes part in a step while i < active. Returns states, and what backpropagation needs."""
        h, half = self.h, np.float32(0.5)
        states, saved = [], []
        for t, a in enumerate(active):
            old = state[:, :a]
            x = self.e.take(inputs[t, :a], axis=1)
            g = self.u @ old
            gates = x[: 2 * h]
            gates += g[: 2 * h]
            gates *= half
            np.tanh(gates, out=gates)
            gates *= half
            gates += half
            z, r = gates[:h], gates[h:]
            n = x[2 * h :]
            n += r * g[2 * h :]
            np.tanh(n, out=n)
            new = old - n
            new *= z
            new += n
            if keep:
                saved.append((old, z, r, n, g[2 * h :]))
            states.append(new)
            state = new
        return state, states, saved

    def log_probability(self, hidden: np.ndarray, target: np.ndarray, grads: list | None = None):
        """Natural log probability of each target; with ``grads``, also the gradient for the hidden states."""
        cls, n = self.word_class[target], len(target)
        order = np.argsort(cls, kind="stable")
        cls, target = cls[order].astype(np.intp), target[order].astype(np.intp)
        border = np.searchsorted(cls, np.arange(self.c + 1)).tolist()
        # Targets of a class are neighbours; a row of ones takes the biases along.
        states = np.ones((self.h + 1, n), np.float32)
        hidden.take(order, axis=1, out=states[: self.h], mode="clip")
        result, lanes = np.zeros(n, np.float32), np.arange(min(n, SOFTMAX_CELLS))
        d_states = np.zeros_like(states) if grads is not None else None

        def softmax(weights: np.ndarray, label: np.ndarray, begin: int, end: int) -> np.ndarray | None:
            """Adds one level's log probabilities and gradients for neighbours; the weights' gradients."""
            total_grads, width = None, max(1, SOFTMAX_CELLS // len(weights))
            for low in range(begin, end, width):
                high = min(low + width, end)
                x = states[:, low:high]
                own = label[low:high] * (high - low) + lanes[: high - low]
                e = weights @ x
                cells = e.reshape(-1)
                result[low:high] += cells[own]
                if not small:
                    np.minimum(e, np.float32(80), out=e)
                np.exp(e, out=e)
                total = ones[: len(e)] @ e
                result[low:high] -= np.log(total)
                if d_states is not None:
                    cells[own] -= total
                    d = weights.T @ e
                    d /= total
                    d_states[:, low:high] += d
                    more = e @ (x / total).T
                    total_grads = more if total_grads is None else total_grads + more
            return total_grads

        outer, inner = np.hstack([self.wc, self.bc]), np.hstack([self.wo, self.bo])
        # No state is beyond 1, so what goes into an exponential has a bound.
        small, ones = max(np.abs(outer).sum(axis=1).max(), np.abs(inner).sum(axis=1).max()) < 80, np.ones(len(inner), np.float32)
        g = softmax(outer, cls, 0, n)
        if g is not None:
            grads[2] += g[:, :-1]
            grads[3] += g[:, -1:]
        for c in range(self.c):
            low, high = self.first[c], self.first[c + 1]
            if border[c] == border[c + 1] or high - low == 1:
                continue
            g = softmax(inner[low:high], target - low, border[c], border[c + 1])
            if g is not None:
                grads[4][low:high] += g[:, :-1]
                grads[5][low:high] += g[:, -1:]
        back = np.empty_like(order)
        back[order] = np.arange(n)
        return result[back], d_states[:-1].take(back, axis=1) if grads is not None else None

    def backward(self, saved: list, inputs: np.ndarray, d_states: list[np.ndarray], grads: list) -> None:
        """Gradients of one window; nothing flows to the window before."""
        h, v = self.h, self.e.shape[1]
        d_next, gradients, ids = None, [], []
        for t in range(len(saved) - 1, -1, -1):
            old, z, r, n, gn = saved[t]
            d = d_states[t]
            if d_next is not None:
                d[:, : d_next.shape[1]] += d_next
            dx = np.empty((3 * h, old.shape[1]), np.float32)
            dz, dr, dn = dx[:h], dx[h : 2 * h], dx[2 * h :]
            keep = 1 - z
            np.subtract(old, n, out=dz)
            dz *= d
            dz *= z
            dz *= keep
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= d
            dn *= keep
            dg = dx.copy()
            dg[2 * h :] *= r
            np.multiply(dg[2 * h :], gn, out=dr)
            dr *= 1 - r
            dg[h : 2 * h] = dr
            gradients.append(dx)
            ids.append(inputs[t, : old.shape[1]])
            grads[1] += dg @ old.T
            d *= z
            d_next = d
            d_next += self.u.T @ dg
        at, dx = np.concatenate(ids).astype(np.intp), np.concatenate(gradients, axis=1)
        for row in range(3 * h):
            grads[0][row] += np.bincount(at, dx[row], v)


def lane_groups(documents: list[np.ndarray], lanes: int) -> Iterator[list[int]]:
    """Numbers of documents that run side by side: alike in length, longest first, with bounded padding."""
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    at = 0
    while at < len(order):
        width = max(1, min(lanes, LANE_CELLS // len(documents[order[at]])))
        yield order[at : at + width]
        at += width


def run_group(
    network: Network, documents: list[np.ndarray], end: int, window: int, update: Callable | None = None, value: Callable | None = None
) -> np.ndarray:
    """Log probability of each whole document; with ``update``, a training step after each window.

    Where few documents are left, a window goes on until it has ``TRAINED_TOKENS`` or ``SCORED_TOKENS``. ``value``
    changes the tokens' log probabilities, given with the tokens, before they are added up.
    """
    lengths = np.array([len(d) for d in documents])
    table = np.full((lengths[0] + 1, len(documents)), end, dtype=np.int32)
    for i, d in enumerate(documents):
        table[1 : len(d) + 1, i] = d
    total = np.zeros(len(documents))
    state = np.zeros((network.h, len(documents)), np.float32)
    running = np.searchsorted(-lengths, -np.arange(lengths[0]))
    behind = np.append(0, np.cumsum(running))
    least, stop = SCORED_TOKENS if update is None else TRAINED_TOKENS, 0
    while stop < lengths[0]:
        begin = stop
        stop = min(max(begin + window, int(np.searchsorted(behind, behind[begin] + least))), int(lengths[0]))
        active = running[begin:stop].tolist()
        inputs, targets = table[begin:stop], table[begin + 1 : stop + 1]
        state, states, saved = network.steps(state, inputs, active, update is not None)
        hidden = np.concatenate(states, axis=1)
        target = np.concatenate([targets[t, :a] for t, a in enumerate(active)])
        grads = None if update is None else update.grads if isinstance(update, Adam) else network.parts(np.zeros_like(network.vector))
        result, d_hidden = network.log_probability(hidden, target, grads)
        if update is not None:
            network.backward(saved, inputs, np.split(d_hidden, np.cumsum(active)[:-1], axis=1), grads)
            update(grads, len(target))
        else:
            result = result if value is None else value(result, target)
            total += np.bincount(np.concatenate([np.arange(a) for a in active]), result, len(documents))
    return total


# Tokens behind a step: where few long documents go on alone, several windows make one.
STEP_TOKENS = 1024
ADAM_CELLS = 16_384  # parameters changed at once: what belongs to them stays in a processor's cache


class Adam:
    """Updates of one network's parameters; gradients are added up in ``grads``, taken per token and clipped."""

    def __init__(self, network: Network, rate: float):
        self.network, self.rate, self.t = network, rate, 0
        self.m, self.v = np.zeros_like(network.vector), np.zeros_like(network.vector)
        self.waiting, self.tokens = np.zeros_like(network.vector), 0
        self.grads = network.parts(self.waiting)

    def __call__(self, grads: list[np.ndarray], tokens: int) -> None:
        if grads is not self.grads:
            for own, more in zip(self.grads, grads):
                own += more
        self.tokens += tokens
        if self.tokens < STEP_TOKENS:
            return
        scale = 1 / self.tokens
        norm = float(np.sqrt(self.waiting @ self.waiting)) * scale
        if norm > 1.0:
            scale /= norm
        self.t += 1
        rate = np.float32(self.rate * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        for at in range(0, len(self.waiting), ADAM_CELLS):
            g, m, v = (x[at : at + ADAM_CELLS] for x in (self.waiting, self.m, self.v))
            g *= np.float32(scale)
            step = g - m
            step *= np.float32(0.1)
            m += step
            g *= g
            g -= v
            g *= np.float32(0.01)
            v += g
            np.sqrt(v, out=step)
            step += np.float32(1e-8)
            np.divide(m, step, out=step)
            step *= rate
            self.network.vector[at : at + ADAM_CELLS] -= step
        self.waiting[:], self.tokens = 0, 0


@dataclass
class LanguageModel:
    """Network parameters and the counts that scoring needs."""

    parameters: GruParameters
    vector: np.ndarray | None
    head: list[str]  # frequent words, most frequent first; the first of them are symbols alone
    head_counts: np.ndarray
    symbol_of: np.ndarray  # the network's number for each place in the head, and after these for each run
    end: int
    symbol_counts: np.ndarray
    train_tokens: int
    distinct: int
    other_tokens: np.ndarray  # of each run
    other_distinct: np.ndarray
    share: float = 0.5  # of the network in the mixture
    borders: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # of the runs, see ``run_numbers``

    def sent(self) -> tuple:
        """The fields as plain values: a broadcast of the class itself would need the package where it is read."""
        return (tuple(vars(self.parameters).values()), *[v for k, v in vars(self).items() if k != "parameters"])

    def parts_of_mixture(self, logs: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each token by the network and as a unigram; of a word of a run, divided by its count + 0.5."""
        whole, runs = self.train_tokens + 0.5 * (self.distinct + 1), self.runs()
        unigram = (self.symbol_counts + 0.5) / whole
        scale = np.ones(len(unigram))
        unigram[runs], scale[runs] = 1 / whole, 1 / (self.other_tokens + 0.5 * (self.other_distinct + 1))
        return np.exp(logs.astype(np.float64)) * scale[tokens], unigram[tokens]

    def mixed(self, logs: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        by_network, alone = self.parts_of_mixture(logs, tokens)
        return np.log(self.share * by_network + (1 - self.share) * alone)

    def network(self) -> Network:
        return Network(self.parameters, self.symbol_counts, self.vector)

    def runs(self) -> np.ndarray:
        """The runs' numbers in the network."""
        return self.symbol_of[len(self.head) :]

    def places(self) -> Callable[[list[bytes]], np.ndarray]:
        """A function from words to their places in the head, or its length and more by their run."""
        find = {w.encode(): i for i, w in enumerate(self.head)}.get
        none, borders = len(self.head), self.borders

        def found(words: list[bytes]) -> np.ndarray:
            at = np.fromiter(map(find, words, repeat(none)), dtype=np.int32, count=len(words))
            others = np.flatnonzero(at == none)
            at[others] += run_numbers([words[i] for i in others.tolist()], borders).astype(np.int32)
            return at

        return found

    def symbols(self) -> Callable[[list[bytes]], np.ndarray]:
        """A function from words to the network's numbers and the end's; its table has words alone, all others are found by their run."""
        runs, end, borders = self.runs(), self.end, self.borders
        first = runs[0]  # runs have the highest numbers
        find = {w.encode(): n for w, n in zip(self.head, self.symbol_of.tolist()) if n < first}.get

        def found(words: list[bytes]) -> np.ndarray:
            at = np.fromiter(chain(map(find, words, repeat(-1)), (end,)), dtype=np.int32, count=len(words) + 1)
            others = np.flatnonzero(at < 0)
            at[others] = runs[run_numbers([words[i] for i in others.tolist()], borders)]
            return at

        return found


def received(sent: tuple) -> LanguageModel:
    return LanguageModel(GruParameters(*sent[0]), *sent[1:])


def documents_of(texts: pa.Array, symbols: Callable[[list[bytes]], np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Symbols of each text and its end, as many texts together as ``HELD_TOKENS`` allows; one text at a time is a Python string."""
    documents, tokens = [], 0
    for text in texts:
        documents.append(symbols(words_of(text.as_py())))
        tokens += len(documents[-1])
        if tokens >= HELD_TOKENS:
            yield documents
            documents, tokens = [], 0
    if documents:
        yield documents


def counted_words(train: DataFrame, text: str) -> DataFrame:
    return train.select(text).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def run_borders(words: list[bytes], counts: np.ndarray, runs: int) -> np.ndarray:
    """Where runs after the first begin, so that all have about the same share of the counts."""
    keys, at = np.unique(keys_of(words), return_inverse=True)
    if len(keys) < 2:
        return np.empty(0, np.uint64)
    mass = np.bincount(at, counts)
    label = ((np.cumsum(mass) - mass / 2) * (runs / mass.sum())).astype(int)
    return keys[1:][np.diff(label) > 0]


def counted_runs(counts: DataFrame, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each run, all words counted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(borders) + 1), np.int64)
        for batch in batches:
            at = run_numbers(batch.column(0).cast(pa.binary()).to_pylist(), borders)
            np.add.at(sums[0], at, batch.column(1).to_numpy())
            sums[1] += np.bincount(at, minlength=sums.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.shape[1])), pa.array(sums[0]), pa.array(sums[1])], names=["run", "n", "words"])

    rows = counts.filter(F.col("word") != END).select("word", "n").mapInArrow(run, "run long, n long, words long")
    table = rows.groupBy("run").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).toArrow()
    sums = np.zeros((2, len(borders) + 1), np.int64)
    for row, name in zip(sums, ("n", "words")):
        row[table.column("run").to_numpy()] = table.column(name).to_numpy()
    return sums[0], sums[1]


def model_from_counts(counts: DataFrame, p: GruParameters) -> LanguageModel:
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.filter(F.col("word") == END).first()
    end_count = ends["n"] if ends else 0
    table = counts.filter(F.col("word") != END).orderBy(F.desc("n"), "word").limit(p.head).toArrow()
    head = table.column("word").to_pylist()
    head_counts = np.array(table.column("n").to_numpy(), dtype=np.int64)
    root = math.isqrt(int(totals[1]))
    known = min(len(head), max(p.vocabulary - 2, root))
    texts = [w.encode() for w in head]
    at = known if known < len(head) else 0  # where a small table has words alone only, these tell how others lie
    borders = run_borders(texts[at:], head_counts[at:], max(1, root))
    # Each run has all its words, those of the head and the many outside it, but for the words alone.
    other_tokens, other_distinct = counted_runs(counts, borders)
    alone = run_numbers(texts[:known], borders)
    np.subtract.at(other_tokens, alone, head_counts[:known])
    np.subtract.at(other_distinct, alone, 1)
    # Words alone and the end are numbered by count, then runs by the alphabet, so that classes are runs of numbers.
    raw = np.append(head_counts[:known], end_count)
    order = np.argsort(-raw, kind="stable")
    number = np.empty_like(order)
    number[order] = np.arange(len(order))
    runs = known + 1 + np.arange(len(borders) + 1)
    symbol_of = np.concatenate([number[:known], runs[run_numbers(texts[known:], borders)], runs]).astype(np.int32)
    return LanguageModel(
        p, None, head, head_counts, symbol_of, int(number[known]), np.append(raw[order], other_tokens).astype(float),
        int(totals[0]), int(totals[1]), other_tokens, other_distinct, borders=borders,
    )


def train_network(train: DataFrame, text: str, part: str, model: LanguageModel) -> np.ndarray:
    """Parameters after all averagings; in each, every task trains on its documents of that round's part.

    Every document takes part in every pass; how many there are doesn't depend on the corpus.

    Tasks emit their parameters times their tokens, one row per place, and
    Spark sums them: the driver receives one vector whatever the number of tasks.
    """
    p = model.parameters
    spark = train.sparkSession
    vector = model.network().vector
    for number in range(p.rounds * p.passes):
        shared = spark.sparkContext.broadcast((model.sent(), vector))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, start = received(shared.value[0]), shared.value[1]
            network = Network(p, known.symbol_counts, start)
            update, symbols, tokens = Adam(network, p.rate), known.symbols(), 0
            for batch in batches:
                for documents in documents_of(batch.column(0), symbols):
                    tokens += sum(map(len, documents))
                    for group in lane_groups(documents, p.lanes):
                        run_group(network, [documents[i] for i in group], known.end, p.window, update)
            if tokens:
                values = np.append(network.vector.astype(np.float64), 1.0) * tokens
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["place", "value"]
                )

        rows = train.filter(F.col(part) == number % p.rounds).select(text).mapInArrow(run, "place int, value double")
        summed = rows.groupBy("place").agg(F.sum("value").alias("value")).toArrow()
        shared.destroy()
        if summed.num_rows:
            values = np.zeros(len(vector) + 1)
            values[summed.column("place").to_numpy()] = summed.column("value").to_numpy()
            vector = (values[:-1] / values[-1]).astype(np.float32)
    return vector


SHARES = [k / 20 for k in range(20)]


def best_share(checked: DataFrame, text: str, model: LanguageModel) -> float:
    """The network's share in the mixture that makes documents it was not trained on likeliest; half if there are none."""
    shared = checked.sparkSession.sparkContext.broadcast(model.sent())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = received(shared.value)
        network, symbols, sums = known.network(), known.symbols(), np.zeros(len(SHARES))

        def value(logs: np.ndarray, tokens: np.ndarray) -> np.ndarray:
            by_network, alone = known.parts_of_mixture(logs, tokens)
            for k, share in enumerate(SHARES):
                sums[k] += np.log(share * by_network + (1 - share) * alone).sum()
            return logs

        for batch in batches:
            for documents in documents_of(batch.column(0), symbols):
                for group in lane_groups(documents, known.parameters.lanes):
                    run_group(network, [documents[i] for i in group], known.end, known.parameters.window, value=value)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["k", "value"])

    found = checked.select(text).mapInArrow(run, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()
    shared.destroy()
    total = {r["k"]: r["value"] for r in found}
    return SHARES[max(total, key=lambda k: (total[k], -k))] if any(total.values()) else 0.5


SUMS = "struct<n:long,head:long,logs:double,other_logs:double,network:double,rest:array<struct<w:string,n:long>>>"


def scored_batches(batches: Iterable[pa.RecordBatch], known: LanguageModel, name: str) -> Iterator[pa.RecordBatch]:
    """Columns before the last, which is the text, and as ``name`` the token sums of each text (``SUMS``).

    A batch's documents run side by side as numbers. Words outside the head are
    in Arrow arrays from the first piece on: as Python objects they take
    several times the text's memory.
    """
    p, network, places = known.parameters, known.network(), known.places()
    none, runs = len(known.head), known.runs()
    logs = np.append(np.log10(known.head_counts + 0.5), np.zeros(len(runs)))

    def piece(texts: pa.Array, row: int) -> tuple[list[np.ndarray], list[pa.Array], pa.Array]:
        """Documents from ``row`` on, their sums before the network's, and their words outside the head."""
        documents, sums, rest, times, borders, tokens = [], [], [], [], [0], 0
        while row < len(texts) and len(documents) < PIECE_ROWS and tokens < PIECE_TOKENS:
            words = words_of(texts[row].as_py())
            at = places(words)
            symbols, log = known.symbol_of[at], logs[at]
            documents.append(np.append(symbols, known.end).astype(np.int32))
            sums.append((len(words) + 1, int((at < none).sum()), float(log.sum()), float(log[symbols >= runs[0]].sum())))
            others = Counter([words[i] for i in np.flatnonzero(at >= none)])
            rest.extend(others)
            times.extend(others.values())
            borders.append(len(rest))
            tokens += len(words) + 1
            row += 1
        entries = pa.StructArray.from_arrays([pa.array(rest, pa.string()), pa.array(times, pa.int64())], names=["w", "n"])
        columns = [pa.array(x, t) for x, t in zip(zip(*sums), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        return documents, columns, pa.ListArray.from_arrays(pa.array(borders, pa.int32()), entries)

    for batch in batches:
        texts, row = batch.column(batch.num_columns - 1), 0
        while row < batch.num_rows:
            documents, pieces, tokens, first = [], [], 0, row
            while row < batch.num_rows and tokens < HELD_TOKENS:
                more, columns, rest = piece(texts, row)
                pieces.append((row, columns, rest))
                documents += more
                tokens += sum(map(len, more))
                row += len(more)
            scores = np.empty(len(documents))
            for group in lane_groups(documents, p.lanes):
                scores[group] = run_group(network, [documents[i] for i in group], known.end, p.window, value=known.mixed) / LN10
            for at, columns, rest in pieces:
                own = pa.array(scores[at - first : at - first + len(rest)])
                found = pa.StructArray.from_arrays([*columns, own, rest], names=["n", "head", "logs", "other_logs", "network", "rest"])
                others = batch.slice(at, len(rest))
                yield pa.RecordBatch.from_arrays([*others.columns[:-1], found], names=[*batch.schema.names[:-1], name])


def score_documents(df: DataFrame, text: str = "text", key: str = "doc_id", parameters: GruParameters = GruParameters()) -> DataFrame:
    """``df`` without its text, with ``held_out``, token counts, ``base_score`` and ``score`` of each whole text.

    Learned from rows whose crc32 of the key written as text leaves another
    remainder than 1 by 5; a null key is learned from. ``score`` is the model's
    log10 probability of the words and the end, ``base_score`` the unigram's.
    Null and empty texts are one end token. Of words as frequent as the last in
    a table of bounded size, those that come first by text are in it; the counts
    of the others are joined, so which is where changes no count. Repeated rows
    count and stay; an empty table gives no rows; columns with the new names are
    replaced.
    """
    p = parameters
    new = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    df = df.drop(*[c for c in new if c not in (text, key)])
    row, found, part = fresh(df, "row_at", "token_sums", "round_part")
    spark = df.sparkSession
    remainder = F.pmod(text_crc32(key), F.lit(5))
    docs = df.withColumn("held_out", F.coalesce(remainder == HELD_OUT, F.lit(False)))
    train = docs.filter(~F.col("held_out")).withColumn(part, F.pmod(F.xxhash64(F.lit(p.seed), key, text), F.lit(p.rounds)))
    checked = F.pmod(F.xxhash64(F.lit(p.seed + 1), key, text), F.lit(p.check)) == 0
    counts = written(counted_words(train, text))
    model = model_from_counts(counts, p)
    model.vector = train_network(train.filter(~checked), text, part, model)
    model.share = best_share(train.filter(checked), text, model)
    shared = spark.sparkContext.broadcast(model.sent())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        yield from scored_batches(batches, received(shared.value), found)

    kept = [c for c in docs.columns if c != text]
    read = docs.select(*[docs[f"`{c}`"] for c in kept], docs[f"`{text}`"])
    scored = read.mapInArrow(run, T.StructType([*[docs.schema[c] for c in kept], *T.StructType.fromDDL(f"`{found}` {SUMS}").fields]))
    scored = written(scored.withColumn(row, F.monotonically_increasing_id()))
    rest = scored.select(F.col(row).alias("at"), F.explode(f"{found}.rest").alias("r")).select("at", "r.w", F.col("r.n").alias("k"))
    # Words of the head are not among the rest; the rare ones are matched with their counts.
    least = int(model.head_counts[-1]) if len(model.head) == p.head else 0
    rare = counts.filter((F.col("n") <= least) & (F.col("word") != END)) if least else counts.limit(0)
    matched = rest.join(rare, rest["w"] == rare["word"], "left")
    per_row = matched.groupBy("at").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest_logs"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("rest_known"),
    )
    end_seen = model.symbol_counts[model.end]
    whole = math.log10(model.train_tokens + 0.5 * (model.distinct + 1))
    t, rest_logs = F.col(found), F.coalesce("rest_logs", F.lit(0.0))
    (at,) = fresh(scored, "at_row")
    per_row = per_row.withColumnRenamed("at", at)
    joined = scored.join(per_row, scored[row] == per_row[at], "left")
    return joined.select(
        *[c for c in docs.columns if c != text],
        t["n"].alias("n_tokens"),
        (t["head"] + F.coalesce("rest_known", F.lit(0)) + F.lit(int(end_seen > 0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (t["logs"] + rest_logs + math.log10(end_seen + 0.5) - t["n"] * whole).alias("base_score"),
        (t["network"] + t["other_logs"] + rest_logs).alias("score"),
    )
