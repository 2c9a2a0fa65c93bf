"""Conversation repair, whitening and minwise trees against plain counterparts, with odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablevitals.llm import polarisation, turn_grammar
from tablevitals.llm.blocks import compare, emit_links, in_blocks, similar_sets
from tablevitals.llm.minwise_trees import TreeParameters, near_duplicates
from tablevitals.llm.polarisation import whiten
from tablevitals.llm.queries import QUERIES
from tablevitals.llm.turn_grammar import GrammarParameters, damaged, repair_conversations, repaired_turns

SPACES = r"[^\x20\x09-\x0D]"
SHAPE = re.compile(r"(s?(ua)+)?")
PREFIX = re.compile(r"s?(ua)*u?")

# ---- conversations


def plain_damage(rows):
    """(conv, turn, role, text) after damage."""
    out = []
    for conv, turn, role, text in rows:
        name = [" " if x is None else str(x) for x in (conv, turn)]
        code = zlib.crc32(":".join(name).encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        words = re.findall(SPACES, text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def scripts(rows, faults, shape, cost, audit, turns):
    """All edits of all rows that can still end in the right order; no more than two insertions side by side."""
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    for new in inserts:
        here = shape + "".join(r[0] for r in new)
        if not PREFIX.fullmatch(here):
            continue
        spent, letters, so_far = cost + 3 * len(new), audit + "I" * len(new), turns + [(r, "") for r in new]
        if not rows:
            if SHAPE.fullmatch(here):
                yield spent, letters, so_far
            continue
        (role, text), fault = rows[0], faults[0]
        choices = [(4, "D", None)]
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            choices += [(more, "K", role), (3 + more, "R", "user"), (3 + more, "R", "assistant")]
        for price, letter, who in choices:
            after = here if who is None else here + (who[:1] if who[:1] in ("s", "u", "a") else "x")
            if PREFIX.fullmatch(after):
                yield from scripts(rows[1:], faults[1:], after, spent + price, letters + letter, so_far + ([(who, text)] if who is not None else []))


def text_hash(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain_repair(rows, ids):
    """What ``repair_conversations`` gives, by trying every edit."""
    by_id = defaultdict(list)
    for conv, turn, role, text in rows:
        by_id[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv in ids:
        mine = sorted(by_id[conv], key=lambda r: (*r[:3], text_hash(r[2], r[3])))
        turns = [t for given, t, *_ in mine if given]
        said = [r[2:] for r in mine]
        faults = plain_faults(said)
        initials = [r[:1] for r, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, fixed = min(scripts(said, faults, "", 0, "", []), key=lambda s: s[:2])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest, fixed)
    return out


def talk(rng, conv, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u", "anna"]
    texts = ["Yes.", "No!", "so it goes", " \t", "", None, "Why?", "\x85", "ends. \n", "é", "?  x"]
    rows = []
    for k in range(n):
        role = roles[k % 2] if rng.random() < 0.6 else rng.choice(roles)
        turn = rng.choice([k, k, k, k + 2, None])
        rows.append((conv, turn, role, rng.choice(texts) if rng.random() < 0.6 else f"said {rng.random()}."))
    if rows and rng.random() < 0.3:
        rows.append(rng.choice(rows))
    return rows


CONVERSATION = "conv_id long, turn long, role string, text string, conv string, head string, h int, kind string, symbols string"


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(11)
    rows = [r for conv in range(70) for r in talk(rng, conv, rng.randrange(1, 5))]
    rows += talk(rng, None, 3)
    return rows


def test_repair(spark, talks):
    extra = [(*r, "a", "b", 1, "c", "d") for r in talks]
    df = spark.createDataFrame(extra, CONVERSATION).repartition(5)
    ids = spark.createDataFrame([(900,), (None,), (3,)], "conv_id long")
    want = plain_repair(talks, {r[0] for r in talks} | {900})
    got = {r["conv_id"]: tuple(r)[1:] for r in repair_conversations(df, ids).collect()}
    assert got.keys() == want.keys()
    assert {k: v for k, v in got.items()} == {k: v[:-1] for k, v in want.items()}
    assert got[900] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {c for v in got.values() for c in v[6]} == set("KRDI")
    turns = defaultdict(list)
    for r in repaired_turns(df).orderBy("conv_id", "place").collect():
        assert r["place"] == len(turns[r["conv_id"]])
        turns[r["conv_id"]].append((r["role"], r["text"]))
    assert dict(turns) == {k: v[-1] for k, v in want.items() if v[-1]}
    none = spark.createDataFrame([], CONVERSATION)
    assert repair_conversations(none).count() == 0 and repaired_turns(none).count() == 0
    assert repair_conversations(none, ids).count() == 3


def test_repair_query(spark, talks, folder):
    rows = [r for r in talks for _ in range(1)] + [(500 + k, 7, "user", "Hm.") for k in range(60)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    got = {r["conv_id"]: r for r in QUERIES["op11_turn_grammar_repair"](spark, folder).collect()}
    want = plain_repair(plain_damage(rows), {r[0] for r in rows})
    names = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert {k: tuple(r[n] for n in names) for k, r in got.items()} == {k: v[:-1] for k, v in want.items()}
    assert any(not v[6] for v in want.values())  # a conversation without rows after damage
    planted = Counter(tuple(r) for r in damaged(spark.read.parquet(f"{folder}/conversations.parquet")).collect())
    assert planted == Counter(plain_damage(rows))


def test_long_conversation_in_chunks(spark):
    """A conversation over many rows of symbols and tasks equals the same without grammar and chunks."""
    rng = random.Random(12)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", f"b{k}", f"c{k}.", ""])) for k in range(3000)]
    rows += [(2, k, *r[2:]) for k, r in enumerate(rows[:40])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    got = repair_conversations(df, parameters=GrammarParameters(chunk=16)).filter("conv_id = 1").first()
    faults = plain_faults([r[2:] for r in rows[:3000]])
    place = {"": 0, "truncated": 1}
    symbols = "".join(chr(65 + 3 * "sua".index(r[2][0]) + place.get(f, 2)) for r, f in zip(rows, faults))
    fold = turn_grammar.Fold(turn_grammar.values([]))
    fold.take(symbols)
    assert (got["cost"], got["audit"], got["illegal"]) == fold.result()
    assert set(got["audit"]) == set("KRDI") and len(got["audit"].replace("I", "")) == 3000


def test_ropes():
    rng = random.Random(13)

    def rope(depth):
        return "".join(rng.choice("DK") for _ in range(rng.randrange(1, 40))) if not depth else turn_grammar.tied(rope(depth - 1), rope(depth - 1))

    for _ in range(300):
        start, a, b = rope(3), rope(2), rope(3)
        one, two = turn_grammar.tied(start, a), turn_grammar.tied(start, b)
        assert turn_grammar.flat(one) == turn_grammar.flat(start) + turn_grammar.flat(a)
        assert turn_grammar.less(one, two) == (turn_grammar.flat(one) < turn_grammar.flat(two))
        assert not turn_grammar.less(one, one)


def test_grammar_rules(spark):
    rows = spark.createDataFrame([("DHDHDHDH", 5), ("ADHDHB", 2), ("", 1)], "symbols string, n long")
    rules = turn_grammar.learn_rules(rows, GrammarParameters())
    assert rules[0] == "DH" and len(turn_grammar.compressed("DHDHDHDH", rules)) < 4
    value = turn_grammar.values(rules)
    one, two = turn_grammar.Fold(value), turn_grammar.Fold(value)
    one.take("DHDHDHDH")
    two.take(turn_grammar.compressed("DHDHDHDH", rules))
    assert one.result() == two.result()


# ---- whitening


def plain_whitening(vectors):
    x = [[math.floor(64 * c) + 10**6 for c in v] for v in vectors]
    n, size = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(size)]
    y = [[n * r[j] - s[j] for j in range(size)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(size)] for i in range(size)])
    return y, v


def test_whiten(spark):
    rng = np.random.default_rng(14)
    base = rng.normal(0, 1, (300, 6)) @ rng.normal(0, 1, (6, 6)) + rng.normal(0, 50, 6)
    rows = [(i, v.tolist(), "x", 1, 2) for i, v in enumerate(base)] + [(7, base[7].tolist(), "x", 1, 2), (None, base[8].tolist(), "x", 1, 2)]
    odd = [(900, None), (901, []), (902, [1.0] * 5), (903, [math.nan] * 6), (904, [math.inf] * 6), (905, [None] * 6)]
    df = spark.createDataFrame([*rows, *[(*r, "x", 1, 2) for r in odd]], "vec_id long, embedding array<double>, k string, w int, component int")
    got = whiten(df.repartition(5)).collect()
    y, v = plain_whitening([r[1] for r in rows])
    values, axes = np.linalg.eigh(v)
    assert len(got) == len(rows) * 6 and {r["component"] for r in got} == set(range(1, 7))
    deviation = Counter((r[0], sum(c * c for c in z)) for r, z in zip(rows, y))
    assert Counter((r["vec_id"], int(r["deviation"])) for r in got if r["component"] == 1) == deviation
    n = len(rows)
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    for k in range(6):
        e, u = values[-1 - k], axes[:, -1 - k]
        mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == k + 1}
        theirs = {r[0]: float(np.array([c / n for c in z]) @ u / math.sqrt(e)) for r, z in zip(rows, y)}
        sign = 1 if mine[0] * theirs[0] > 0 else -1
        assert all(abs(sign * mine[i] - theirs[i]) < 1e-6 for i in theirs)
        share = next(r["explained"] for r in got if r["component"] == k + 1)
        assert abs(share / (e / np.trace(v)) - 1) < 1e-9
    assert whiten(df.limit(0)).count() == 0 and whiten(df.filter("vec_id = 3")).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 4, "vec_id long, embedding array<float>")).count() == 0


def test_whiten_leaves_out_axes_without_variance(spark):
    rng = np.random.default_rng(15)
    rows = [(i, [float(a), float(b), float(a + b), 3.0]) for i, (a, b) in enumerate(rng.integers(-40, 40, (200, 2)))]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1, 2} and got[0]["identity_error"] < 1e-9


def test_sums_beyond_64_bits(spark):
    rng = np.random.default_rng(16)
    d = rng.integers(-(2**40), 2**40, (5, 3))
    exact = [sum(int(r[i]) ** 2 if i == j else (int(r[i]) + int(r[j])) ** 2 for r in d) for i in range(3) for j in range(i, 3)]
    assert polarisation.pair_squares(d) == exact and polarisation.pair_squares(d % 1000) != exact
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(d)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    y, _ = plain_whitening([r[1] for r in rows])
    assert {r["vec_id"]: r["deviation"] for r in whiten(df).collect()} == {i: Decimal(sum(c * c for c in z)) for i, z in enumerate(y)}
    with pytest.raises(Exception, match="no 64-bit whole number"):
        whiten(df.withColumn("embedding", F.array(F.lit(1e300), F.lit(2.0))))


def test_whiten_query(spark):
    got = QUERIES["op12_polarisation_whitening"](spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"
    rows = got.collect()
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    assert len(rows) == 32 * len(vectors) and rows[0]["identity_error"] <= 1e-4


# ---- minwise trees


def plain_components(rows, numerator=85, denominator=100):
    sets = []
    for _, text in rows:
        words = re.findall(f"{SPACES}+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if denominator * both >= numerator * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = find(i)
        known = [k for k in (least.get(r), key) if k is not None]
        least[r] = min(known) if known else None
    return Counter((key, len(s), least[find(i)], key == least[find(i)]) for i, ((key, _), s) in enumerate(zip(rows, sets)))


def near_copies(rng, n, length):
    """One text with its own word changed in each copy, some of them changed more."""
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.choice([1, 1, 2, 4, 7])):
            copy[rng.randrange(length)] = f"x{i}-{rng.randrange(99)}"
        out.append(" ".join(copy))
    return out


def test_trees(spark):
    rng = random.Random(17)
    texts = [" ".join(f"t{rng.randrange(300)}" for _ in range(rng.randrange(1, 80))) for _ in range(80)]
    texts += near_copies(rng, 120, 150) + [texts[0], texts[0].upper(), texts[0].replace(" ", "\t\n"), "", "", " \n ", None, None]
    texts += ["one two", "one two", "one  TWO", "one", "É a", "é a", " ".join(f"v{k}" for k in range(40_000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (None, "lonely words"), (None, "lonely words"), (2, texts[2]), (2, texts[3])]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], "doc_id long, text string, key string, u string, path string, t string")
    want = plain_components(rows)
    for node in (1024, 4):  # with small nodes the trees branch to the lowest level
        got = near_duplicates(df.repartition(4), TreeParameters(node=node)).collect()
        assert Counter(tuple(r) for r in got) == Counter((k, n, c, kept) for (k, n, c, kept), m in want.items() for _ in range(m))
    assert near_duplicates(df.limit(0)).count() == 0
    assert near_duplicates(df.filter("text is null")).collect()[0]["kept"]


def test_trees_recall():
    """Chance to find a pair at the threshold, from random equal tokens and paths."""
    p = TreeParameters()
    rng = np.random.default_rng(18)
    n, second = 200_000, 1 / p.similarity - 1
    equal = rng.random((n, p.depth, 2)) < p.similarity

    def found(level, rows):
        if level == p.depth:
            return np.ones(len(rows), bool)
        first = rng.integers(0, 2, len(rows))
        hit = equal[rows, level, first] & found(level + 1, rows)
        again = equal[rows, level, 1 - first] & (rng.random(len(rows)) < second) & found(level + 1, rows)
        return hit | again

    assert abs(found(0, np.arange(n)).mean() - p.found_by_tree) < 0.005
    assert (1 - p.found_by_tree) ** p.trees <= 1 - p.recall


def test_blocks_of_one_large_bucket(spark):
    """2,000 sets in one bucket, dealt over blocks of about 100: every pair is judged once."""
    rng = random.Random(19)
    sets = {f"{i:05d}".encode(): np.unique(np.array([rng.randrange(40) for _ in range(12)], np.uint64)) for i in range(2000)}
    rows = spark.createDataFrame([(bytearray(u), bytearray(s.tobytes()), [5, 9]) for u, s in sets.items()], "u binary, grams binary, shared array<long>")
    found = rows.select(F.explode("shared").alias("path"), "u", F.octet_length("grams").alias("size"))
    blocked = in_blocks(found, texts=100)
    assert blocked.agg(F.max("blocks")).first()[0] == 20
    links = compare(blocked, rows, "grams", similar_sets(7, 10), emit_links, "u binary, links long, root binary")
    got = {bytes(r["u"]): r["n"] for r in links.groupBy("u").agg(F.sum("links").alias("n")).collect()}
    table = np.zeros((2000, 40), np.int64)
    for row, s in enumerate(sets.values()):
        table[row, s.astype(int)] = 1
    both, size = table @ table.T, table.sum(axis=1)
    similar = 10 * both >= 7 * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(similar, False)
    assert got == {u: int(n) for u, n in zip(sets, similar.sum(axis=1)) if n}


def test_large_group_of_near_copies(spark):
    """5,000 different near copies of one text: all of the links of the join, and the components of the trees."""
    from tablevitals.llm.chosen_path import jaccard_join

    rng = random.Random(20)
    texts = near_copies(rng, 5000, 120) + [" ".join(f"q{rng.randrange(900)}" for _ in range(60)) for _ in range(300)]
    rows = list(enumerate(texts))
    number: dict = {}
    owner, gram = [], []
    for i, t in rows:
        words = t.split()
        for g in {tuple(words[k : k + 5]) for k in range(len(words) - 4)}:
            owner.append(i)
            gram.append(number.setdefault(g, len(number)))
    size = np.bincount(owner, minlength=len(rows))
    times = np.bincount(gram)
    keep = times[gram] > 1
    columns, at = np.unique(np.array(gram)[keep], return_inverse=True)
    table = np.zeros((len(rows), len(columns)), np.float32)
    table[np.array(owner)[keep], at] = 1
    both = table @ table.T
    union = size[:, None] + size[None, :] - both
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)

    def plain(share):
        similar = both >= share * union - 1e-6
        np.fill_diagonal(similar, False)
        label = np.arange(len(rows))
        while True:
            new = np.minimum(label, np.where(similar, label[None, :], len(rows)).min(axis=1))
            if (new == label).all():
                return similar.sum(axis=1), label
            label = new

    links, label = plain(0.8)
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard_join(df).collect()}
    share_found = sum(got[i][0] for i in got) / links.sum()
    assert share_found > 0.999 and all(got[i][0] <= links[i] for i in got)
    assert [got[i][1] for i in range(len(rows))] == label.tolist()
    _, label = plain(0.85)
    reached = {r["doc_id"]: r["component_id"] for r in near_duplicates(df).collect()}
    assert [reached[i] for i in range(len(rows))] == label.tolist()


# ---- edges of earlier operators


def test_code_travels_without_the_package(tmp_path):
    """Functions of all operators load where the package can't be imported, and so does what the language model sends."""
    import importlib
    import pickle
    import subprocess
    import sys
    import types
    from pathlib import Path

    from pyspark import cloudpickle

    from tablevitals import llm
    from tablevitals.llm.gru_lm import GruParameters, LanguageModel

    model = LanguageModel(GruParameters(), np.zeros(3), ["a"], np.ones(1, np.int64), np.zeros(2, np.int32), 0, np.ones(3), 5, 2, 1, 1)
    assert b"tablevitals" not in pickle.dumps(model.sent())
    functions = []
    for file in Path(llm.__file__).parent.glob("[a-z]*.py"):
        if file.stem not in ("queries", "mixing"):  # of these nothing runs in tasks
            module = importlib.import_module(f"tablevitals.llm.{file.stem}")
            functions += [f for f in vars(module).values() if isinstance(f, (types.FunctionType, type)) and f.__module__ == module.__name__]
    assert len(functions) > 100
    path = tmp_path / "functions"
    path.write_bytes(b"".join(len(b).to_bytes(8) + b for b in map(cloudpickle.dumps, functions)))
    code = f"""
import pickle, sys
sys.modules["tablevitals"] = None
data, at = open({str(path)!r}, "rb").read(), 0
while at < len(data):
    n = int.from_bytes(data[at : at + 8])
    pickle.loads(data[at + 8 : at + 8 + n])
    at += 8 + n
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_language_model_beats_its_unigram(spark, sf):
    scores = QUERIES["op9_gru_log_likelihood"](spark, f"/root/testdata/{sf}")
    for r in scores.groupBy("held_out").agg(*[(F.sum(c) / F.sum("n_tokens")).alias(c) for c in ("base_score", "score")]).collect():
        assert r["score"] > r["base_score"] + 0.03, r


def test_quality_with_clashing_names(spark):
    from tablevitals.llm.quality_mcd import quality_rules

    rng = random.Random(21)
    texts = [(i, " ".join(f"word{rng.randrange(200)}" for _ in range(40)), "en", "s") for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    names = "group x start key pool count small judged centre inverse scale middle spread bound w d2 distance".split()
    clashing = df.withColumns({n: F.lit(f"{n} of the table") for n in names})
    got = {r["doc_id"]: r for r in quality_rules(clashing).collect()}
    assert {i: r["kept"] for i, r in got.items()} == {r["doc_id"]: r["kept"] for r in quality_rules(df).collect()}
    assert {r["group"] for r in got.values()} == {"group of the table"} and {r["x"] for r in got.values()} == {"x of the table"}


def test_search_with_large_components(spark):
    from tablevitals.llm.balltree import BallTree, top_inner_products

    schema = "vec_id long, embedding array<double>"
    rng = np.random.default_rng(22)
    for size in (2.0**24, 3e7 * 2.0**0):  # products on either side of 2**62
        rows = [(i, (rng.uniform(-size / 4, size / 4, 4)).tolist()) for i in range(60)]
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_inner_products(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0).collect()}
        v = {i: [math.floor(256 * c) for c in x] for i, x in rows}
        for q in (0, 50):
            best = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)[:5]
            assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    large = [(int(rng.integers(2**31, 2**33)), int(rng.integers(-(2**33), 2**33))) for _ in range(40)]
    v = np.array(large, dtype=np.int64)
    tree = BallTree(v, np.arange(40), leaf=4)
    with pytest.raises(OverflowError, match="no 64-bit number"):
        tree.search(v[:2], np.arange(2), 3, np.full(2, -np.inf))
    with pytest.raises(Exception, match="no 64-bit number after scaling"):
        top_inner_products(spark.createDataFrame([(50, [1e300, 1.0]), (1, [1.0, 2.0])], schema), F.col("vec_id") % 50 == 0).collect()


# ---- the pipeline as a whole

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents():
    rng = random.Random(23)
    rows = [(i, " ".join(f"word{rng.randrange(400)}" for _ in range(rng.randrange(20, 60))), "en" if i % 3 else None, f"s{i % 3}") for i in range(120)]
    near = rows[5][1].split()
    near[30 % len(near)] = "changed"
    rows += [(200, " ".join(near * 4), "en", "s0"), (201, " ".join(near * 4), "en", "s1"), (201, " ".join(near * 4), "en", "s1")]
    rows += [(202, " ".join((near * 4)[:-1]), "en", "s1"), (203, "mail a.b@c.example.com or 10.0.0.1 now", "en", None)]
    rows += [(204, None, "en", "s1"), (205, "", "en", "s1"), (206, "", None, "s1"), (None, "of nobody", "en", "s2"), (207, " ".join(f"long{k}" for k in range(30_000)), "en", "s2")]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.mark.parametrize("extra", [(), ("score", "predicted", "group", "u", "path", "key", "pass_no")])
def test_pipeline_on_odd_documents(spark, folder, extra):
    """Every stage keeps the columns and what it should keep; the whole run equals the stages one after another."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from tablevitals.llm.queries import tokenizer_path

    rows = odd_documents()
    docs = spark.createDataFrame(rows, DOCUMENT).withColumns({n: F.lit(f"{n} of the table") for n in extra}).repartition(3)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs)
    everything = Counter(r[0] for r in rows)
    assert ids(kept[0]) == everything  # nothing toxic is known
    assert ids(kept[1]) == Counter(i for i in everything if i not in (201, 202, 206))
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept[2].collect()}
    assert ids(kept[2]) == ids(kept[1]) and texts[203][0] == "mail <EMAIL> or <IP> now" and texts[204] == (None, None) and texts[205] == ("", 0)
    assert all(texts[r[0]] == (r[1], r[4]) for r in rows if r[0] in texts and r[0] not in (203, 204))
    mixed = ids(kept[3])
    assert set(mixed) == set(ids(kept[2])) and max(mixed.values()) <= 2
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = Counter((i, len(library.encode(texts[i][0] or "", add_special_tokens=False).ids)) for i in mixed.elements())
    got = corpus_pipeline.run(spark, folder)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want


def test_pipeline_on_empty_tables(spark, folder):
    import corpus_pipeline

    spark.createDataFrame([], DOCUMENT).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
