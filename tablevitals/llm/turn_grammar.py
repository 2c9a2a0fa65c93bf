"""Cheapest repair of conversations, by dynamic programming over a grammar of their turns.

Every row becomes a symbol of its role and fault. Re-Pair replaces the most
frequent adjacent symbols of all conversations by new ones, round after round.
Each symbol has a transfer matrix: for every state before and after it the least
cost and the edits that reach it, as a rope of its parts' edits. A rule's matrix
is the min-plus product of its two parts', worked out once and shared by all
conversations in which the rule occurs. A conversation is the product over the
few symbols that it has left.

Of equally cheap edits the least string counts. Strings of equal cost between
the same two states never are prefixes of one another, as each further letter
over the same rows is an insertion that costs more; so the least string of a
whole is made of least strings of its parts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tablevitals.llm.common import WORD_SPACE, carries_its_code, text_crc32, written

carries_its_code(__name__)

# Costs of the edits, and what a truncated row that stays costs.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# A role counts by its initial; X is any other.
ROLES = "sua"
FINE, CUT, GONE = 0, 1, 2  # GONE: blank or duplicate
# States: nothing yet, after s, after u, after a. A conversation may end in the first and the last.
STATES, ENDS = range(4), (0, 3)
INSERTED = {0: 2, 1: 2, 2: 3, 3: 2}  # state after an inserted turn, which is of the only role allowed there
FOLLOWS = {("s", "u"), ("u", "a"), ("a", "u")}


@dataclass(frozen=True)
class GrammarParameters:
    rounds: int = 8
    rules_per_round: int = 32
    chunk: int = 4096  # symbols of a conversation in one row


def after(state: int, role: str) -> int | None:
    """State after a turn of a role, None where it may not follow."""
    if role == "s":
        return 1 if state == 0 else None
    if role == "u":
        return 2 if state != 2 else None
    return 3 if role == "a" and state == 2 else None


def symbol(role: Column, fault: Column) -> Column:
    """One letter from A to L for a role's place in ``suax`` and a fault."""
    return F.char(F.lit(ord("A")) + 3 * role + fault)


# A rope is a string, or (left rope, right rope, length).


def length(rope: str | tuple) -> int:
    return len(rope) if isinstance(rope, str) else rope[2]


def tied(left: str | tuple, right: str | tuple) -> str | tuple:
    size = length(left) + length(right)
    if isinstance(left, str) and isinstance(right, str) and size <= 64:
        return left + right
    return (left, right, size) if length(left) and length(right) else left if length(left) else right


def leaves(rope: str | tuple) -> Iterator[str]:
    open_ = [rope]
    while open_:
        part = open_.pop()
        if isinstance(part, str):
            yield part
        else:
            open_ += [part[1], part[0]]


def flat(rope: str | tuple) -> str:
    return "".join(leaves(rope))


def less(one: str | tuple, two: str | tuple) -> bool:
    """Whether a rope's text comes first; shared parts are passed over unread."""
    a, b = [one], [two]
    while a and b:
        x, y = a.pop(), b.pop()
        if x is y:
            continue
        if isinstance(x, str) and isinstance(y, str):
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x < y
            if len(x) > n:
                a.append(x[n:])
            if len(y) > n:
                b.append(y[n:])
        elif isinstance(y, str) or (not isinstance(x, str) and x[2] >= y[2]):
            a += [x[1], x[0]]
            b.append(y)
        else:
            b += [y[1], y[0]]
            a.append(x)
    return bool(b)


Cell = tuple[int, "str | tuple"]


def better(old: Cell | None, new: Cell) -> Cell:
    if old is None or new[0] < old[0] or (new[0] == old[0] and less(new[1], old[1])):
        return new
    return old


def times(row: list, matrix: list) -> list:
    """The min-plus product of one row of cells with a matrix."""
    out: list = [None] * len(STATES)
    for middle, cell in enumerate(row):
        if cell is None:
            continue
        for end, step in enumerate(matrix[middle]):
            if step is not None:
                cost = cell[0] + step[0]
                if out[end] is None or cost <= out[end][0]:
                    out[end] = better(out[end], (cost, tied(cell[1], step[1])))
    return out


@dataclass(frozen=True)
class Value:
    """What a symbol stands for: its matrix, and the illegal neighbours inside between its first and last role."""

    matrix: list
    illegal: int
    first: str
    last: str


def with_insertions(state: int) -> Iterator[tuple[int, int, str]]:
    """States that inserted turns reach, with their cost and letters; a third insertion would only come back."""
    cost, letters = 0, ""
    for _ in range(3):
        yield state, cost, letters
        state, cost, letters = INSERTED[state], cost + INSERT, letters + "I"


def single(role: int, fault: int) -> Value:
    """The value of one row: insertions before it, then keep, rerole or delete."""
    name = ROLES[role] if role < len(ROLES) else "x"
    matrix: list = [[None] * len(STATES) for _ in STATES]
    for start in STATES:
        for state, cost, letters in with_insertions(start):
            steps = [(state, DELETE, "D")]
            if fault != GONE:
                more = TRUNCATED if fault == CUT else 0
                steps.append((after(state, name), KEEP + more, "K"))
                steps += [(after(state, new), REROLE + more, "R") for new in "ua"]
            for end, price, letter in steps:
                if end is not None:
                    matrix[start][end] = better(matrix[start][end], (cost + price, letters + letter))
    return Value(matrix, 0, name, name)


def joined(one: Value, two: Value) -> Value:
    matrix = [times(row, two.matrix) for row in one.matrix]
    return Value(matrix, one.illegal + two.illegal + ((one.last, two.first) not in FOLLOWS), one.first, two.last)


def values(rules: list[str]) -> dict[str, Value]:
    """The value of every symbol, rules from the bottom up; rule k replaces its two symbols by chr(256 + k)."""
    value = {chr(ord("A") + 3 * role + fault): single(role, fault) for role in range(4) for fault in (FINE, CUT, GONE)}
    for k, (left, right) in enumerate(rules):
        value[chr(256 + k)] = joined(value[left], value[right])
    return value


def compressed(symbols: str, rules: list[str], start: int = 0) -> str:
    for k in range(start, len(rules)):
        symbols = symbols.replace(rules[k], chr(256 + k))
    return symbols


class Fold:
    """The product over the symbols of one conversation, from the state in which nothing is written yet."""

    def __init__(self, value: dict[str, Value]):
        self.value = value
        self.row: list = [(0, ""), None, None, None]
        self.illegal, self.last = 0, None

    def take(self, symbols: str) -> None:
        for s in symbols:
            v = self.value[s]
            self.row = times(self.row, v.matrix)
            self.illegal += v.illegal + (self.last is not None and (self.last, v.first) not in FOLLOWS)
            self.last = v.last

    def result(self) -> tuple[int, str, int]:
        """Cost, audit and illegal neighbours."""
        best = None
        for state, cell in enumerate(self.row):
            if cell is not None:
                for end, cost, letters in with_insertions(state):
                    if end in ENDS:
                        best = better(best, (cell[0] + cost, tied(cell[1], letters)))
        return best[0], flat(best[1]), self.illegal


def learn_rules(sequences: DataFrame, p: GrammarParameters) -> list[str]:
    """Re-Pair over ``symbols, n``: in every round the most frequent pairs that share no symbol become rules.

    A round is one pass that counts adjacent pairs of all sequences; only the
    most frequent ``rules_per_round`` pairs are fetched. Sequences stay whole
    whatever is left of them; rules only say what is worked out once.
    """
    rules: list[str] = []
    for _ in range(p.rounds):
        known = list(rules)

        def count(batches: Iterable[pa.RecordBatch], known: list[str] = known) -> Iterator[pa.RecordBatch]:
            pairs: Counter = Counter()
            for batch in batches:
                for symbols, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    rest = compressed(symbols, known)
                    for left, right in zip(rest, rest[1:]):
                        pairs[left + right] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(pairs), pa.string()), pa.array(list(pairs.values()), pa.int64())], names=["pair", "n"])

        pairs = sequences.select("symbols", "n").mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        often = pairs.filter("n > 1").orderBy(F.desc("n"), "pair").limit(p.rules_per_round).collect()
        taken: set[str] = set()
        for r in often:
            if not taken & set(r["pair"]):
                rules.append(r["pair"])
                taken |= set(r["pair"])
        if len(rules) == len(known):
            break
    return rules


def hashed(role: str = "role", text: str = "text") -> Column:
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def read_turns(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, role, text`` with one space for a null role or text."""
    space = F.lit(" ")
    return df.select(
        F.col(f"`{conversation}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), space).alias("role"), F.coalesce(F.col(f"`{text}`"), space).alias("text"),
    )


def faulted(turns: DataFrame) -> DataFrame:
    """``conv, turn, role, h, m, cls, blank, cut, first``: equal rows are one with their number ``m``.

    ``first`` says that no earlier row of the conversation has this role and text.
    """
    end = F.rtrim("text", F.lit(WORD_SPACE))
    cls = F.instr(F.lit(ROLES), F.substring("role", 1, 1)) - 1
    cls = F.when((F.octet_length("role") > 0) & (cls >= 0), cls).otherwise(len(ROLES))
    narrow = turns.select(
        "conv", "turn", "role", hashed().alias("h"), cls.cast("int").alias("cls"),
        (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    rows = written(narrow.groupBy("conv", "turn", "role", "h").agg(
        F.count("*").alias("m"), F.first("cls").alias("cls"), F.first("blank").alias("blank"), F.first("cut").alias("cut")))
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    firsts = rows.groupBy(F.col("conv").alias("c"), F.col("h").alias("k")).agg(F.min(place).alias("least"))
    met = rows.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("h") == F.col("k")))
    return written(met.withColumn("first", F.col("turn").eqNullSafe(F.col("least.turn"))).drop("c", "k", "least"))


def segments(rows: DataFrame, p: GrammarParameters) -> DataFrame:
    """``conv, part, number, symbols``: conversations in order, in rows of at most ``chunk`` symbols.

    Rows are dealt by ranges of their place, so a conversation of any length is spread over tasks.
    """
    gone = symbol(F.col("cls"), F.lit(GONE))
    own = F.when(F.col("first") & ~F.col("blank"), symbol(F.col("cls"), F.when(F.col("cut"), CUT).otherwise(FINE))).otherwise(gone)
    pieces = rows.select("conv", "turn", "role", "h", F.concat(own, F.repeat(gone, (F.col("m") - 1).cast("int"))).alias("piece"))
    place = ["conv", "turn", "role", "h"]
    ordered = pieces.repartitionByRange(*place).sortWithinPartitions(*place).select("conv", "piece")
    schema = StructType([rows.schema["conv"], *StructType.fromDDL("part int, number int, symbols string").fields])
    chunk = p.chunk

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[str] = []
        size, number, now, any_ = 0, 0, None, False

        def row(symbols: str, kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now], kind), pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([symbols])],
                names=["conv", "part", "number", "symbols"],
            )

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for conv, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if any_ and (conv != now or size >= chunk):
                    if held:
                        yield row("".join(held), kind)
                    number = 0 if conv != now else number + 1
                    held, size = [], 0
                now, any_ = conv, True
                while size + len(piece) > chunk:
                    yield row("".join([*held, piece[: chunk - size]]), kind)
                    piece, held, size, number = piece[chunk - size :], [], 0, number + 1
                held.append(piece)
                size += len(piece)
        if held:
            yield row("".join(held), kind)

    return written(ordered.mapInArrow(run, schema))


def evaluated(parts: DataFrame, rules: list[str]) -> DataFrame:
    """``conv, cost, audit, illegal`` of every conversation with rows."""
    schema = StructType([parts.schema["conv"], *StructType.fromDDL("cost long, audit string, illegal long").fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = values(rules)
        known: dict[str, tuple] = {}  # results of whole conversations by their symbols
        held: list[str] = []
        now, any_, fold = None, False, None

        def finished() -> tuple:
            if fold is not None:
                fold.take(compressed(held[0], rules))
                return fold.result()
            if held[0] not in known:
                if len(known) >= 10_000:
                    known.clear()
                one = Fold(value)
                one.take(compressed(held[0], rules))
                known[held[0]] = one.result()
            return known[held[0]]

        for batch in batches:
            out: list[tuple] = []
            kind = batch.column(0).type
            for conv, symbols in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if any_ and conv == now:
                    fold = fold or Fold(value)
                    fold.take(compressed(held[0], rules))
                elif any_:
                    out.append((now, *finished()))
                    fold = None
                held, now, any_ = [symbols], conv, True
            if out:
                yield table(out, kind)
        if any_:
            yield table([(now, *finished())], kind)

    def table(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv", "cost", "audit", "illegal"])

    ordered = parts.repartition("conv").sortWithinPartitions("conv", "part", "number")
    return ordered.select("conv", "symbols").mapInArrow(run, schema)


class Walk:
    """Applies an audit to the rows of a conversation, one after another, and gives the repaired turns."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", "assistant" if self.state == 2 else "user", ""
            self.state = INSERTED[self.state]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            role = "assistant" if self.state == 2 else "user"
        if letter != "D":
            self.state = after(self.state, role[0])
            yield letter, role, text


FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def judged(turns: DataFrame, ids: DataFrame, p: GrammarParameters) -> DataFrame:
    """``conv`` and its figures for every conversation of ``ids``, those without rows included."""
    rows = faulted(turns)
    parts = segments(rows, p)
    sequences = written(parts.groupBy("symbols").agg(F.count("*").alias("n")))
    best = written(evaluated(parts, learn_rules(sequences, p)).withColumnRenamed("conv", "c"))
    m, blank, first = F.col("m"), F.col("blank"), F.col("first")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    none = F.lit(0)
    counts = rows.groupBy(F.col("conv").alias("k")).agg(
        F.coalesce(span, none).cast("long").alias("gaps"),
        F.sum(F.when(blank, m).otherwise(none)).alias("blank"),
        F.sum(F.when(~blank, m - F.when(first, 1).otherwise(0)).otherwise(none)).alias("duplicate"),
        F.sum(F.when(~blank & first & F.col("cut"), 1).otherwise(none)).alias("truncated"),
    )
    every = ids.join(counts, F.col("conv").eqNullSafe(F.col("k")), "left").join(best, F.col("conv").eqNullSafe(F.col("c")), "left")
    numbers = [F.coalesce(c, none).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv", *numbers, F.coalesce("audit", F.lit("")).alias("audit"))


def walked(turns: DataFrame, heads: DataFrame, start: Callable, schema: StructType) -> DataFrame:
    """Brings every conversation's rows in order behind its figures; ``start()`` gives what makes rows of them.

    That is a function of (conversation, figures or None, role, text), called
    with the figures first, then for each row, and at last with none of all. A
    conversation is read as a stream: a task never holds more than one batch.
    """
    empty = F.lit(None)
    figures = [f.name for f in StructType.fromDDL(FIGURES)]
    head = heads.select("conv", F.lit(0).alias("kind"), *[empty.cast(t).alias(c) for c, t in (("turn", turns.schema["turn"].dataType), ("h", "binary"), ("role", "string"), ("text", "string"))], F.struct(*figures).alias("head"))
    body = turns.select("conv", F.lit(1).alias("kind"), "turn", hashed().alias("h"), "role", "text", empty.cast(head.schema["head"].dataType).alias("head"))
    ordered = head.unionByName(body).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "h")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, table = start()
        kind = None
        for batch in batches:
            out: list[tuple] = []
            kind = batch.column(0).type
            for conv, role, text, top in zip(*(batch.column(c).to_pylist() for c in range(4))):
                out += take(conv, top, role, text)
            if out:
                yield table(out, kind)
        if kind is not None and (out := take(None, None, None, None)):
            yield table(out, kind)

    return ordered.select("conv", "role", "text", "head").mapInArrow(run, schema)


def as_table(names: list[str], kinds: list[pa.DataType]) -> Callable:
    def table(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [kind, *kinds])], names=names)

    return table


def every_id(turns: DataFrame, ids: DataFrame | None, conversation: str) -> DataFrame:
    all_ids = turns.select("conv")
    if ids is not None:
        all_ids = all_ids.union(ids.select(F.col(f"`{conversation}`")))
    return all_ids.distinct()


def repair_conversations(
    df: DataFrame,
    ids: DataFrame | None = None,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    parameters: GrammarParameters = GrammarParameters(),
) -> DataFrame:
    """Faults and cheapest repair of every conversation, with the SHA-256 of the repaired turns.

    ``conversation, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``; ``ids`` may add conversations without rows, which have
    zeros, an empty audit and the hash of nothing. A row's first fault counts:
    blank (no word character), duplicate (role and text of an earlier row), or
    truncated (last word character not one of ``.!?``). Keeping costs 0, a new
    role 3, deletion 4, an inserted empty turn 3, and a truncated row that stays
    3 more; blank rows and duplicates are deleted. The audit is the edits'
    letters in order. Repaired initials are nothing or ``s?(ua)+``.

    Rows follow each other by turn, nulls first; rows of the same turn by role
    and then by MD5 of role and text, which makes equal rows neighbours. A null
    role or text is one space. A null conversation is one like others. Repeated
    rows are duplicates of each other. An empty table gives no rows but those
    of ``ids``. Texts of any length are read whole; other columns take no part.
    """
    turns = read_turns(df, conversation, turn, role, text)
    heads = judged(turns, every_id(turns, ids, conversation), parameters)
    schema = StructType([turns.schema["conv"], *StructType.fromDDL(f"{FIGURES}, repaired_sha256 string").fields])
    names = schema.names

    def start() -> tuple[Callable, Callable]:
        walk, top, id_, sha, lines = None, None, None, None, 0

        def write(turns: Iterable) -> None:
            nonlocal lines
            for _, who, said in turns:
                sha.update((("\n" if lines else "") + f"{who}:{said}").encode())
                lines += 1

        def take(conv, head, role, text) -> list[tuple]:
            nonlocal walk, top, id_, sha, lines
            if role is not None:
                write(walk.row(role, text))
                return []
            done = []
            if walk is not None:
                write(walk.inserted())
                done = [(id_, *top.values(), sha.hexdigest())]
            if head is not None:
                walk, top, id_, sha, lines = Walk(head["audit"]), head, conv, hashlib.sha256(), 0
            return done

        return take, as_table(names, [*[pa.int64()] * 6, pa.string(), pa.string()])

    return walked(turns, heads, start, schema).withColumnRenamed("conv", conversation)


def repaired_turns(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    parameters: GrammarParameters = GrammarParameters(),
) -> DataFrame:
    """The turns of all conversations after their cheapest repair: ``conversation, place, edit, role, text``.

    ``place`` counts from 0, ``edit`` is K, R or I. Order, ties, nulls, repeated
    rows and empty tables as in ``repair_conversations``; a conversation of
    which nothing is left has no rows.
    """
    turns = read_turns(df, conversation, turn, role, text)
    heads = judged(turns, every_id(turns, None, conversation), parameters)
    schema = StructType([turns.schema["conv"], *[StructField(f.name, f.dataType) for f in StructType.fromDDL("place long, edit string, role string, text string")]])

    def start() -> tuple[Callable, Callable]:
        walk, id_, place = None, None, 0

        def numbered(turns: Iterable) -> list[tuple]:
            nonlocal place
            out = []
            for edit, who, said in turns:
                out.append((id_, place, edit, who, said))
                place += 1
            return out

        def take(conv, head, role, text) -> list[tuple]:
            nonlocal walk, id_, place
            if role is not None:
                return numbered(walk.row(role, text))
            done = numbered(walk.inserted()) if walk is not None else []
            if head is not None:
                walk, id_, place = Walk(head["audit"]), conv, 0
            return done

        return take, as_table(schema.names, [pa.int64(), pa.string(), pa.string(), pa.string()])

    return walked(turns, heads, start, schema).withColumnRenamed("conv", conversation)


def damaged(df: DataFrame) -> DataFrame:
    """``conversations`` with faults planted by ``crc32(conv_id:turn) % 20``; nulls are one space there and in the rows.

    0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes its role user.
    """
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    code = F.pmod(text_crc32(F.concat(name[0], F.lit(":"), name[1])), F.lit(20))
    rows = df.select(
        "conv_id", "turn", code.alias("code"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).filter("code <> 0")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
