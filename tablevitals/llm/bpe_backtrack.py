"""BPE encoding by longest matches with backtracking, and decoding through an offset table.

An Aho-Corasick automaton over the vocabulary gives the longest token at every
place of a piece. Two neighbouring tokens are kept only if merging by rank
could have left a border between them; a table remembers that for pairs seen.
Where no token fits, the last one is taken back and its place is not tried
again, so each place fails once and the work is linear in the piece. The result
is the one that merging by rank gives.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from tablevitals.llm.bpe_heap import byte_letters
from tablevitals.llm.common import carries_its_code, kept_by_worker, map_column

carries_its_code(__name__)

# Fixed value: how the word-end vocabulary cuts normalised text into pieces; what lies between is dropped.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
WORD_END = "</w>"
REMEMBERED_WORDS = 80_000  # twice: those met lately, and those of the turn before
REMEMBERED_CHARS = 64
REMEMBERED_PAIRS = 100_000


class BacktrackingBpe:
    """Encoder and decoder of a BPE whose identifiers grow with merge rank and whose words end in ``</w>``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        size = max(vocabulary.values()) + 1
        self.left, self.right = list(range(size)), list(range(size))
        self.joined: dict[tuple[int, int], int] = {}
        made = -1
        for a, b in pairs:
            token = vocabulary[a + b]
            if token <= made:
                raise ValueError("identifiers must grow with merge rank")
            made = token
            self.left[token], self.right[token] = vocabulary[a], vocabulary[b]
            self.joined[vocabulary[a], vocabulary[b]] = token
        letters = byte_letters()
        self.inner = [chr(vocabulary[c]) for c in letters]
        self.last = [chr(vocabulary[c + WORD_END]) for c in letters]
        # Every token as a string of its initial symbols, one character for each.
        spelled = [chr(t) for t in range(size)]
        for token in sorted(self.joined.values()):
            spelled[token] = spelled[self.left[token]] + spelled[self.right[token]]
        self.length = [len(s) for s in spelled]
        self.pair_fits: dict[int, bool] = {}
        automaton = ahocorasick.Automaton()
        for token in vocabulary.values():
            # A token that merging never leaves as a whole cannot be part of a result.
            if self.length[token] == 1 or self.apart(self.left[token], self.right[token], token):
                automaton.add_word(spelled[token], token)
        self.shorter = [-1] * size
        for token in vocabulary.values():
            for n in range(self.length[token] - 1, 0, -1):
                if (found := automaton.get(spelled[token][:n], -1)) >= 0:
                    self.shorter[token] = found
                    break
        automaton.make_automaton()
        self.matches = automaton.iter
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # Decoding: all token texts in one string, with the offset of each.
        texts = [""] * (max([size - 1, *self.special.values()]) + 1)
        for text, token in [*vocabulary.items(), *self.special.items()]:
            texts[token] = text
        self.offsets = np.cumsum([0, *map(len, texts)]).tolist()
        self.texts = "".join(texts)

    def apart(self, a: int, b: int, limit: int = 1 << 62) -> bool:
        """Whether merges before ``limit`` leave a border between tokens ``a`` and ``b``.

        The merges that made both are undone from the last to the first; at
        each step the two symbols at the border must not have merged earlier.
        """
        left, right, joined = self.left, self.right, self.joined
        while True:
            if joined.get((a, b), limit) < limit:
                return False
            # The later-made of the two is undone; at the same age the right one is.
            part_a, part_b = right[a], left[b]
            if a > b and part_a != a:
                limit, a = a, part_a
            elif part_b != b:
                limit, b = b + 1, part_b
            elif part_a != a:
                limit, a = a, part_a
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.pair_fits.get(key)
        if known is None:
            if len(self.pair_fits) >= REMEMBERED_PAIRS:
                self.pair_fits.clear()
            known = self.pair_fits[key] = self.apart(a, b)
        return known

    def encode_word(self, word: str) -> list[int]:
        """Identifiers of one piece of text."""
        data = word.encode()
        inner = self.inner
        symbols = "".join([inner[b] for b in data[:-1]]) + self.last[data[-1]]
        n, length, shorter, known_fits = len(symbols), self.length, self.shorter, self.pair_fits.get
        longest = [-1] * n
        for end, token in self.matches(symbols):
            longest[end - length[token] + 1] = token  # later ends are longer
        if length[longest[0]] == n:
            return [longest[0]]
        failed = bytearray(n + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                if not failed[at + length[token]]:
                    if not tokens:
                        break
                    ok = known_fits(tokens[-1] << 20 | token)
                    if ok or (ok is None and self.fits(tokens[-1], token)):
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                failed[at] = 1
                token = tokens.pop()
                at -= length[token]
                token = shorter[token]
        return tokens

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by spaces, as for a vocabulary without a decoder of its own."""
        texts, offsets = self.texts, self.offsets
        return " ".join([texts[offsets[i] : offsets[i + 1]] for i in ids])


def lowered(text: str) -> str:
    """Lower case letter by letter: a sigma at the end of a word is like any other."""
    return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()


def text_encoder(path: str, known_bpe: BacktrackingBpe | None = None) -> tuple[BacktrackingBpe, Callable[[str], list[tuple[int, str, str]]]]:
    """The encoder, and a function from text to (count, identifiers as text, decoded text) of each piece.

    The function remembers words, the encoder does not: a worker that waits holds the encoder only.
    """
    bpe = known_bpe or BacktrackingBpe(path)
    words = regex.compile(WORDS).findall
    special = regex.compile("(" + "|".join(map(regex.escape, bpe.special)) + ")") if bpe.special else None
    names = list(map(str, range(len(bpe.offsets))))
    seen: dict[str, tuple[int, str, str]] = {}
    before: dict[str, tuple[int, str, str]] = {}

    def described(ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join([names[i] for i in ids]), bpe.decode(ids)

    def missed(word: str) -> tuple[int, str, str]:
        piece = before.get(word) or described(bpe.encode_word(word))
        if len(word) <= REMEMBERED_CHARS:
            if len(seen) >= REMEMBERED_WORDS:
                before.clear()
                before.update(seen)
                seen.clear()
            seen[word] = piece
        return piece

    known = seen.get

    def encode(text: str) -> list[tuple[int, str, str]]:
        result = []
        for i, part in enumerate(special.split(text) if special else [text]):
            if i % 2:
                result.append(described([bpe.special[part]]))
            else:
                pieces = words(lowered(unicodedata.normalize("NFC", part)))
                result.extend([known(word) or missed(word) for word in pieces])
        return result

    return bpe, encode


def encode_documents(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` of every whole text in place of the text.

    No begin, end or padding is added; special strings inside a text become
    their identifiers. Null counts as empty: no identifiers. Repeated rows give
    repeated rows, an empty table none; a column called ``ids`` is replaced.
    """

    def start() -> Callable[[list], list]:
        _, encode = text_encoder(tokenizer, kept_by_worker(("backtracking", tokenizer), lambda: BacktrackingBpe(tokenizer)))
        return lambda texts: [
            [[int(i) for piece in encode(t) for i in piece[1].split(" ")] if t else [] for t in texts]
        ]

    return map_column(df, text, "ids array<int>", start, keeps=True, drops=True).drop(text)


def decode_documents(df: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``df`` with the decoded ``text`` of every list of identifiers in place of the list; null for null.

    Repeated rows give repeated rows, an empty table none; a column called
    ``text`` is replaced.
    """

    def start() -> Callable[[list], list]:
        bpe = BacktrackingBpe(tokenizer)
        return lambda rows: [[None if row is None else bpe.decode(row) for row in rows]]

    return map_column(df, ids, "text string", start).drop(ids)


def encode_and_decode(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``n_tokens`` and digests of the identifiers and of the decoded text.

    Both directions in one pass over each whole text: every piece is encoded,
    and what is decoded comes from its identifiers. Null counts as empty. Repeated
    rows give repeated rows, an empty table none. New columns replace those of
    the same name.
    """

    def start() -> Callable[[list], list]:
        _, encode = text_encoder(tokenizer, kept_by_worker(("backtracking", tokenizer), lambda: BacktrackingBpe(tokenizer)))

        def digest(texts: list[str]) -> str:
            return hashlib.sha256(" ".join(texts).encode()).hexdigest()

        def compute(texts: list) -> list:
            counts, ids, decoded = [], [], []
            for text in texts:
                pieces = encode(text or "")
                counts.append(sum([p[0] for p in pieces]))
                ids.append(digest([p[1] for p in pieces]))
                decoded.append(digest([p[2] for p in pieces]))
            return [counts, ids, decoded]

        return compute

    return map_column(df, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", start, keeps=True, drops=True).drop(text)
