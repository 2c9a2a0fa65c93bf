"""Token counts by byte-pair merging with a heap of pairs over a linked list of symbols.

The lowest-rank adjacent pair is popped and merged again and again; a piece's
count is its number of symbols less its number of merges. No identifier is
made.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from heapq import heappop, heappush

import regex
from pyspark.sql import DataFrame

from tablevitals.llm.common import carries_its_code, map_column

carries_its_code(__name__)

# Fixed value: how byte-level vocabularies of this family cut text into pieces.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# Counts of seen pieces are remembered up to this number per task, then forgotten all at once.
REMEMBERED_PIECES = 400_000
# Longer pieces are counted each time.
REMEMBERED_CHARS = 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {b: chr(b) for b in printable}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(printable)))
    return [letters[b] for b in range(256)]


class MergeRules:
    """Merges of a vocabulary: symbol numbers, and rank and result for each pair."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        numbers: dict[str, int] = {}
        for text in [*byte_letters(), *(a for p in pairs for a in (*p, p[0] + p[1]))]:
            numbers.setdefault(text, len(numbers))
        self.bytes = [numbers[c] for c in byte_letters()]
        self.shift = len(numbers).bit_length()
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges.setdefault(numbers[a] << self.shift | numbers[b], (rank, numbers[a + b]))
        self.special = [t["content"] for t in spec["added_tokens"]]


def merged_length(symbols: list[int], merges: dict[int, tuple[int, int]], shift: int) -> int:
    """Symbols left when all merges are done: initial ones minus merges."""
    n = len(symbols)
    if n < 2:
        return n
    find = merges.get
    heap: list[int] = []
    place_bits = n.bit_length()
    for i in range(n - 1):
        rule = find(symbols[i] << shift | symbols[i + 1])
        if rule is not None:
            heap.append(rule[0] << place_bits | i)
    if not heap:
        return n
    heap.sort()
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    mask = (1 << place_bits) - 1
    left = n
    while heap:
        entry = heappop(heap)
        i = entry & mask
        symbol = symbols[i]
        j = after[i]
        if symbol < 0 or j == n:
            continue
        rule = find(symbol << shift | symbols[j])
        if rule is None or rule[0] != entry >> place_bits:
            continue  # one side has been merged since
        symbol = symbols[i] = rule[1]
        symbols[j] = -1
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rule = find(symbol << shift | symbols[k])
            if rule is not None:
                heappush(heap, rule[0] << place_bits | i)
        h = before[i]
        if h >= 0:
            rule = find(symbols[h] << shift | symbol)
            if rule is not None:
                heappush(heap, rule[0] << place_bits | h)
    return left


def token_counter(path: str) -> Callable[[str], int]:
    """A function from text to its number of tokens; special strings inside the text count as one token each."""
    rules = MergeRules(path)
    merges, shift, numbers = rules.merges, rules.shift, rules.bytes
    pieces = regex.compile(PIECES).findall
    special = regex.compile("|".join(map(regex.escape, rules.special))) if rules.special else None
    seen: dict[str, int] = {}

    def count(text: str) -> int:
        parts = special.split(text) if special else [text]
        total = len(parts) - 1
        for part in parts:
            for piece in pieces(part):
                n = seen.get(piece)
                if n is None:
                    n = merged_length([numbers[b] for b in piece.encode()], merges, shift)
                    if len(piece) <= REMEMBERED_CHARS:
                        if len(seen) >= REMEMBERED_PIECES:
                            seen.clear()
                        seen[piece] = n
                total += n
        return total

    return count


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``df`` without its text, with ``n_bytes``, ``n_tokens`` and ``over_limit`` for each whole text.

    ``tokenizer`` is the path of a byte-level BPE in JSON, readable on every
    executor. Null counts as empty: 0 bytes and tokens. Repeated rows give
    repeated rows; an empty table gives none; columns with the new names are
    replaced. A text of any length is read piece by piece, in n log n time.
    """

    def start() -> Callable[[list], list]:
        count = token_counter(tokenizer)

        def compute(texts: list) -> list:
            texts = [t or "" for t in texts]
            tokens = [count(t) for t in texts]
            return [[len(t.encode()) for t in texts], tokens, [n > limit for n in tokens]]

        return compute

    kept = [c for c in df.columns if c != text]
    read = df.select(*[df[f"`{c}`"] for c in kept], df[f"`{text}`"])
    return map_column(read, text, "n_bytes long, n_tokens long, over_limit boolean", start).drop(text)
