"""Each operator on small inputs: nulls, empty and repeated rows, clashing names, empty tables, and a plain counterpart."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablevitals.llm import chosen_path, gru_lm, pii_weak, toxicity
from tablevitals.llm.balltree import BallTree, top_inner_products
from tablevitals.llm.bpe_backtrack import BacktrackingBpe, decode_documents, encode_and_decode, encode_documents, text_encoder
from tablevitals.llm.bpe_heap import count_tokens, token_counter
from tablevitals.llm.chosen_path import JoinParameters, jaccard_join, one_of_each_class
from tablevitals.llm.gru_lm import GruParameters, score_documents
from tablevitals.llm.mixing import temperature_mix
from tablevitals.llm.queries import tokenizer_path
from tablevitals.llm.quality_mcd import quality_rules, repeated_words
from tablevitals.llm.sharding import communication_matrix, hypergeometric, shard_uniformly
from tablevitals.llm.toxicity import isotonic, score_toxicity, train_toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, u string, path string"


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(60):
        text = words(rng, rng.randrange(20, 90))
        rows.append((i, text, "en" if i % 3 else "de", f"s{i % 4}", len(text)))
    base = words(rng, 120).split()
    for i in range(60, 66):  # near copies
        copy = list(base)
        copy[5 + i - 60] = "changed"
        rows.append((i, " ".join(copy), "en", "s0", 1))
    rows += [(70, rows[0][1], "en", "s0", 1), (71, rows[0][1], None, None, None), (71, rows[0][1], None, None, None)]
    rows += [(80, None, "en", "s1", 0), (81, "", "en", None, 0), (None, "one two", None, "s1", 7), (82, "\x1c \x85 é", "fr", "s2", 4)]
    rows += [(90, words(rng, 30_000), "en", "s0", 1)]
    return [(*r, "a", "b", "c", "d") for r in rows]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, COLUMNS).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def test_shards(docs, none, corpus):
    rows = shard_uniformly(docs, 7, rows_per_block=3).collect()
    assert len(rows) == len(corpus)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by_shard) == list(range(7)) and max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in corpus)
    assert shard_uniformly(none, 7).count() == 0


def test_communication_matrix():
    matrix = np.array(communication_matrix([10, 0, 25, 7], [14, 14, 14], 1))
    assert matrix.sum(axis=1).tolist() == [10, 0, 25, 7] and matrix.sum(axis=0).tolist() == [14, 14, 14]
    rng = np.random.default_rng(5)
    large = [hypergeometric(rng, 3 * 10**9, 10**9, 10_000) for _ in range(400)]
    assert abs(np.mean(large) - 7500) < 10 and 35 < np.std(large) < 52


def test_toxicity(spark, none):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = words(rng, 40).split()
        if toxic:
            for place in (7, 20, 31):
                text[place] = rng.choice(["idiotic", "scumbag", "worthless"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(None, None), (1000, "")], "doc_id long, text string")
    truth = spark.createDataFrame([*labels, (3, None), (4, 7), (None, 1)], "doc_id long, toxic int")
    got = score_toxicity(docs, train_toxicity(docs, truth)).collect()
    held = [r for r in got if r["doc_id"] in range(600) and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(got) == 602 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 == 0) for r in held]) > 0.95
    empty = train_toxicity(none.select("doc_id", "text"), truth.limit(0))
    assert score_toxicity(none, empty).count() == 0


def test_repeated_labelled_rows(spark, monkeypatch):
    """Repeats of a labelled row are learned from once, and rows with many texts don't exceed the sample."""
    learned = []
    for name, at in (("boost", 1), ("isotonic", 1)):
        plain = getattr(toxicity, name)
        monkeypatch.setattr(toxicity, name, lambda *a, plain=plain, at=at: (learned.append(len(a[at])), plain(*a))[1])
    rows = [(i, f"text {i}") for i in range(60)] + [(0, "text 0")] * 200 + [(1, f"other {i}") for i in range(200)] + [(3, None)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    usable = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    different = {r for r in rows if r[0] in usable}
    assert {0, 1, 3} & set(usable)
    train_toxicity(docs, truth)
    assert sum(learned) == len(different)
    learned.clear()
    train_toxicity(docs, truth, max_labels=len(usable))
    assert sum(learned) == len(usable)
    texts = [r["text"] for r in toxicity.labelled_sample(docs, truth, len(usable)).collect()]
    assert len(texts) == len(usable) and sum((t or "").startswith("other") for t in texts) <= 1


def test_isotonic():
    knots, heights = isotonic(np.array([0.0, 1, 2, 3, 3]), np.array([0.0, 1, 0, 1, 1]))
    assert np.all(np.diff(heights) >= 0) and heights[0] == 0 and heights[-1] == 1 and len(knots) == len(heights)


def test_quality(docs, none, corpus):
    rows = quality_rules(docs).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        text = next(c[1] for c in corpus if c[0] == r["doc_id"]) or ""
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
        covered = {i + k for i in range(len(found) - 4) if windows[tuple(found[i : i + 5])] > 1 for k in range(5)}
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(found), sum(map(len, found)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(found) < 10 or 100 * len(covered) > 20 * len(found))
        assert not (r["base_failed"] and r["kept"])
    assert repeated_words("a b c d e a b c d e".split()) == 10
    assert quality_rules(none).count() == 0


def test_quality_rejects_outliers(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 80), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "###" for w in words(rng, 80).upper().split()), "en", "s") for i in range(20)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(kept[1000 + i] for i in range(20)) and sum(kept[i] for i in range(300)) >= 298


def odd_texts():
    rng = random.Random(7)
    pool = [chr(c) for c in [*range(0x250), *range(0x370, 0x400), 0x3000, 0x2028, 0x1F600, 0x4E2D, 0x301]]
    made = ["".join(rng.choice(pool if rng.random() < 0.5 else "aabe 's<|endoftext|>  \n\t01!Σσς") for _ in range(rng.randrange(60))) for _ in range(600)]
    return [*made, "", "  ", "<|endoftext|>a<|startoftext|>", "a" * 3000, "don't I'LL", "ΑΣ Σ"]


def test_token_counts(docs, none, corpus):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library, count = Tokenizer.from_file(path), token_counter(path)
    assert [count(t) for t in odd_texts()] == [len(e.ids) for e in library.encode_batch(odd_texts(), add_special_tokens=False)]
    rows = count_tokens(docs, path).collect()
    assert Counter((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == Counter(
        (len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for _, t, *_ in corpus
    )
    assert count_tokens(none, path).count() == 0


def test_backtracking_bpe(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library, (_, encode) = Tokenizer.from_file(path), text_encoder(path)
    for text in odd_texts():
        ids, pieces = library.encode(text, add_special_tokens=False).ids, encode(text)
        assert " ".join(p[1] for p in pieces) == " ".join(map(str, ids))
        assert " ".join(p[2] for p in pieces) == library.decode(ids, skip_special_tokens=False)
    ids = encode_documents(docs.select("doc_id", "text"), path)
    decoded = {r["doc_id"]: r["text"] for r in decode_documents(ids, path).collect()}
    assert decoded[0] == BacktrackingBpe(path).decode(next(r["ids"] for r in ids.collect() if r["doc_id"] == 0))
    assert encode_and_decode(docs, path).count() == docs.count() and encode_and_decode(none, path).count() == 0


def test_mixing(docs, none, corpus):
    rows = temperature_mix(docs, target_entropy=0.99, max_repeats=2.0, blocks=4).collect()
    times = Counter(r["doc_id"] for r in rows)
    assert set(times) == {r[0] for r in corpus} and all(0 <= r["mix_block"] < 4 for r in rows)
    per_row = Counter(r[0] for r in corpus)
    assert all(times[i] <= 3 * per_row[i] for i in times)
    whole = Counter(r["doc_id"] for r in rows if r["pass_no"] == 0)
    assert whole == per_row
    small = temperature_mix(docs, budget_tokens=500).agg(F.count("*")).first()[0]
    assert 0 < small < len(corpus)
    assert temperature_mix(none, target_entropy=0.9).count() == 0


def test_search(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(0, 1, 8).round(2).tolist(), "x") for i in range(400)]
    vectors += [(400, vectors[0][1], "x"), (450, None, "x"), (500, [float("nan")] * 8, "x"), (550, [], "x"), (None, [1.0] * 8, "x"), (650, [1.0, 2.0], "x")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score string")
    got = top_inner_products(df, F.col("vec_id") % 50 == 0, shard_rows=60, query_rows=4).collect()
    usable = {i: [math.floor(256 * x) for x in v] for i, v, _ in vectors if i is not None and v and not any(map(math.isnan, v))}
    expected = set()
    for q in (i for i in usable if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
        expected |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:5])}
    assert {tuple(r) for r in got} == expected
    assert top_inner_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_ball_tree_with_large_numbers():
    rng = np.random.default_rng(9)
    v = rng.integers(-(2**29), 2**29, (300, 4))
    tree = BallTree(v, np.arange(300), leaf=16)
    place, ids, score = tree.search(v[:5], np.arange(5), 3, np.full(5, -np.inf))
    for q in range(5):
        exact = sorted((-sum(int(a) * int(b) for a, b in zip(v[q], v[i])), i) for i in range(300) if i != q)[:3]
        assert [(-int(s), int(i)) for i, s in zip(ids[place == q], score[place == q])] == exact


def test_base_spans():
    rng = random.Random(10)

    def plain(text):
        spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in re.finditer(r"[0-9]([ -]?[0-9])+", text):
            digits = re.sub("[ -]", "", m.group())
            doubled = [int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))]
            if 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
                spans.append(("card", *m.span()))
        spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m.group())) <= 15]
        return spans

    for _ in range(5000):
        text = "".join(rng.choice("0123456789.@+- a_()é1127") for _ in range(rng.randrange(60)))
        assert plain(text) == pii_weak.base_spans(text)


def test_personal_data(spark, docs, none, corpus):
    texts = ["mail a.b@c.example.com now", "ip 10.0.0.1, card 4539578763621486", 'set token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" here', None, "", "clean text"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii_weak.digests(pii_weak.find_personal_data(df)).collect()}
    assert rows[0]["spans"] == "email:5:22" and rows[1]["n_ip"] == rows[1]["n_card"] == 1
    assert "secret:13:53" in rows[2]["spans"] and rows[3]["spans"] == rows[4]["spans"] == rows[5]["spans"] == ""
    masked = {r["doc_id"]: r["text"] for r in pii_weak.redact(df).collect()}
    assert masked[0] == "mail <EMAIL> now" and masked[3] is None and masked[5] == "clean text" and "24be" not in masked[2]
    assert pii_weak.find_personal_data(docs).count() == len(corpus) and pii_weak.find_personal_data(none).count() == 0


def test_language_model(docs, none, corpus):
    rows = score_documents(docs, parameters=GruParameters(head=50, vocabulary=20, lanes=8, window=5)).collect()
    assert len(rows) == len(corpus)
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t, *_ in corpus if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        mine = tokens(next(c[1] for c in corpus if c[0] == r["doc_id"]))
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(r["doc_id"]), len(mine), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in mine)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in mine), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert score_documents(none).count() == 0


def test_columns_travel_once(spark):
    """The column read goes to a task once, and not back where it isn't wanted; words remembered end with their task."""
    from tablevitals.llm import common

    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    start = lambda: lambda texts: [[len(t or "") for t in texts]]
    size = common.map_column(df, "text", "size long", start)
    assert [tuple(r) for r in size.collect()] == [(1, "a b", 3), (2, None, 0)]
    assert "value_read" not in size._jdf.queryExecution().analyzed().toString()
    dropped = common.map_column(df, "text", "size long", start, drops=True)
    assert dropped.columns == ["doc_id", "size"] and [tuple(r) for r in dropped.collect()] == [(1, 3), (2, 0)]
    assert [tuple(r) for r in common.map_column(df, "text", "text long", start).collect()] == [(1, 3), (2, 0)]
    bpe = BacktrackingBpe(tokenizer_path("word_bpe_49k.json"))
    held = set(vars(bpe))
    assert text_encoder("", bpe)[1]("some words") == text_encoder("", bpe)[1]("some words") and set(vars(bpe)) == held


def test_scoring_holds_little_beside_its_texts(spark, monkeypatch):
    """Texts don't travel back from scoring, rows go back in small pieces, and rare words are no Python objects meanwhile."""
    import tracemalloc

    import pyarrow as pa

    sent = []
    df = spark.createDataFrame([(i, f"a b c{i}") for i in range(20)], "doc_id long, text string")
    kind = type(df)
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema, *a, g=kind.mapInArrow, **b: (sent.append((f, self.columns, schema)), g(self, f, schema, *a, **b))[1])
    score_documents(df, parameters=GruParameters(head=5, vocabulary=5, lanes=64, window=8))
    run, columns, schema = next(x for x in sent if "rest" in getattr(x[2], "simpleString", str)())
    assert "text" not in schema.names
    rare = [" ".join(f"w{i}x{j}" for j in range(100)) for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([{"doc_id": pa.array(range(3000)), "text": pa.array(rare)}.get(c, pa.array([False] * 3000)) for c in columns], names=columns)
    rare.clear()
    tracemalloc.start()
    rows, ids, rest = [], [], []
    for out in run(iter([batch])):
        rows.append(out.num_rows)
        ids += out.column(out.schema.get_field_index("doc_id")).to_pylist()
        rest.append(out.column(out.num_columns - 1).field("rest").flatten().field("n").to_numpy().sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == list(range(3000)) and max(rows) <= 1000 and sum(rest) == 300_000
    assert peak < 10 * batch.nbytes, (peak, batch.nbytes)


def test_pieces_of_a_batch_score_alike(docs, monkeypatch):
    """Pieces and the groups held at a time may end anywhere in a batch."""
    import pyarrow as pa

    texts = [r["text"] for r in docs.select("text").collect()]
    p = GruParameters(head=50, vocabulary=20, lanes=8, window=5)
    model = gru_lm.model_from_counts(gru_lm.counted_words(docs, "text"), p)
    found = []
    for held, rows, tokens in ((8_000_000, 1_000, 500_000), (40, 3, 10)):
        for name, value in (("HELD_TOKENS", held), ("PIECE_ROWS", rows), ("PIECE_TOKENS", tokens)):
            monkeypatch.setattr(gru_lm, name, value)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["i", "text"])
        found.append([(r["i"], r["x"]) for out in gru_lm.scored_batches([batch], model, "x") for r in out.to_pylist()])
        assert [d.tolist() for part in gru_lm.documents_of(batch.column(1), model.symbols()) for d in part] == [
            [int(model.symbol_of[i]) for i in model.places()(gru_lm.words_of(t))] + [model.end] for t in texts
        ]
    for (i, a), (j, b) in zip(*found, strict=True):
        assert i == j and math.isclose(a.pop("network"), b.pop("network"), rel_tol=1e-4) and a == b


def test_windows_with_few_documents_go_on(monkeypatch):
    """A score doesn't depend on how far a window goes, and a step's gradients are those of a window's."""
    rng = np.random.default_rng(11)
    documents = [rng.integers(0, 30, n).astype(np.int32) for n in (90, 40, 3)]
    p, counts = GruParameters(hidden=3, vocabulary=30, classes=4), np.arange(30, 0, -1).astype(float)
    scores, vectors = [], []
    for least in (1, 25, 10_000):
        monkeypatch.setattr(gru_lm, "SCORED_TOKENS", least)
        monkeypatch.setattr(gru_lm, "TRAINED_TOKENS", least)
        monkeypatch.setattr(gru_lm, "SOFTMAX_CELLS", 7 * least)  # pieces of a softmax may end anywhere
        scores.append(gru_lm.run_group(gru_lm.Network(p, counts), documents, 0, 4))
    assert np.allclose(scores[0], scores[1], atol=1e-4) and np.allclose(scores[0], scores[2], atol=1e-4)
    for held in (gru_lm.ADAM_CELLS, 50):
        monkeypatch.setattr(gru_lm, "ADAM_CELLS", held)
        network, grads = gru_lm.Network(p, counts), []
        start, update = network.vector.copy(), gru_lm.Adam(network, 0.01)
        monkeypatch.setattr(gru_lm, "STEP_TOKENS", 1)
        gru_lm.run_group(gru_lm.Network(p, counts), documents, 0, 4, lambda g, n: grads.append(np.concatenate([x.ravel() for x in g]) / n))
        gru_lm.run_group(network, documents, 0, 4, update)
        vectors.append(network.vector)
        assert update.t == len(grads) == 1
        # The first step of Adam goes by the sign of each gradient.
        moved = np.abs(grads[0]) > 1e-4
        assert np.allclose((network.vector - start)[moved], -0.01 * np.sign(grads[0][moved]), atol=1e-4)
    assert np.array_equal(*vectors)


def test_every_word_is_predicted_in_context(spark):
    """Documents of words in "a" and of words in "z", none of them frequent: the words read tell which ones come."""
    rng = random.Random(9)
    texts = [(i, " ".join(f"{'az'[i % 2]}{rng.randrange(300)}" for _ in range(20))) for i in range(4000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    for head in (10, 1000):  # words of the table of frequent ones, and words outside it
        rows = score_documents(df, parameters=GruParameters(head=head, vocabulary=4, lanes=64, window=8)).filter("held_out").collect()
        assert sum(r["score"] - r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows) > 0.15, head


def test_symbols_grow_with_the_words(spark):
    """Words alone and runs of others hold all words together, each of them one of the other."""
    rng = random.Random(10)
    for n, head in ((100, 100), (2500, 400), (2500, 5000)):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 14))) + str(i) for i in range(n)]
        counts = Counter(w for i, w in enumerate(words) for _ in range(1 + n // (1 + i)))
        df = spark.createDataFrame([(w, c) for w, c in counts.items()] + [("\n", 50)], "word string, n long")
        model = gru_lm.model_from_counts(df, GruParameters(head=head, vocabulary=5))
        root, runs = math.isqrt(n + 1), model.runs()
        assert root / 2 <= len(runs) <= root + 1 and len(model.symbol_counts) == root + 1 + len(runs)
        symbol = dict(zip(words, model.symbols()([w.encode() for w in words]).tolist()))
        assert [symbol[w] for w in words] == model.symbol_of[model.places()([w.encode() for w in words])].tolist()
        for s, held in enumerate(model.symbol_counts):
            mine = [w for w in words if symbol[w] == s]
            assert held == (50 if s == model.end else sum(counts[w] for w in mine)) and (s >= runs[0] or len(mine) == (s != model.end))
            if s >= runs[0]:
                assert (model.other_tokens[s - runs[0]], model.other_distinct[s - runs[0]]) == (held, len(mine))
        # Neighbours in the alphabet share a run, and all probabilities together are 1 but for words never seen.
        others = sorted((w for w in words if symbol[w] >= runs[0]), key=str.encode)
        assert [symbol[w] for w in others] == sorted(symbol[w] for w in others)
        hidden = np.full((8, len(model.symbol_counts)), 0.5, np.float32)
        logs, _ = model.network().log_probability(hidden, np.arange(len(model.symbol_counts)))
        by_network, _ = model.parts_of_mixture(logs, np.arange(len(model.symbol_counts)))
        unseen = by_network[runs] * 0.5
        whole = sum(by_network[symbol[w]] * (1 if symbol[w] < runs[0] else counts[w] + 0.5) for w in words) + by_network[model.end] + unseen.sum()
        assert math.isclose(whole, 1, rel_tol=1e-4)


def test_training_is_the_same_for_any_size(docs):
    """A corpus called larger is trained on as often."""
    p = GruParameters(head=50, vocabulary=20, lanes=8, window=5)
    train = docs.filter("doc_id < 60").coalesce(1).withColumn("part", F.col("doc_id") % p.rounds)
    vectors = []
    for times in (1, 10**6):
        model = gru_lm.model_from_counts(gru_lm.counted_words(train, "text"), p)
        model.train_tokens *= times
        vectors.append(gru_lm.train_network(train, "text", "part", model))
    assert np.array_equal(*vectors)


def test_network_gradient_and_windows():
    p = GruParameters(hidden=3, vocabulary=12, classes=4, window=4)
    counts = np.arange(12, 0, -1).astype(float)
    network = gru_lm.Network(p, counts)
    documents = [np.array([1, 5, 2, 0, 7, 3], np.int32), np.array([4, 0, 9], np.int32)]
    grads = []
    gru_lm.run_group(network, documents, 0, 100, lambda g, n: grads.append(np.concatenate([x.ravel() for x in g])))
    at = np.argsort(-np.abs(grads[0]))[:12]
    for k in at:
        value = network.vector[k]
        network.vector[k] = value + 1e-2
        high = gru_lm.run_group(network, documents, 0, 100).sum()
        network.vector[k] = value - 1e-2
        low = gru_lm.run_group(network, documents, 0, 100).sum()
        network.vector[k] = value
        assert abs((low - high) / 2e-2 - grads[0][k]) < 0.05 * max(1, abs(grads[0][k]))
    # State is carried: the window's length makes no difference to a score.
    assert np.allclose(gru_lm.run_group(network, documents, 0, 2), gru_lm.run_group(network, documents, 0, 100), atol=1e-4)


def test_join(spark, docs, none, corpus):
    rows = jaccard_join(docs, JoinParameters(bucket=4)).collect()  # small buckets: splits and blocks are used
    sets = {}
    for _, t, *_ in corpus:
        if t is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            sets[t] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links = {t: sum(1 for o in sets if o != t and s and sets[o] and 5 * len(s & sets[o]) >= 4 * len(s | sets[o])) for t, s in sets.items()}
    assert sum(links.values()) > 10 and len(rows) == len(corpus)
    for r in rows:
        text = next(c[1] for c in corpus if c[0] == r["doc_id"])
        assert r["n_links"] == links.get(text, 0)
        assert r["n_copies"] == (1 if text is None else sum(c[1] == text for c in corpus))
    classes = {r["doc_id"]: r["class_id"] for r in rows}
    assert {classes[i] for i in range(60, 66)} == {60} and classes[70] == classes[71] == classes[0] == 0 and classes[1] == 1
    kept = Counter(r["doc_id"] for r in one_of_each_class(docs).collect())
    assert kept[60] == kept[0] == kept[80] == 1 and not {61, 65, 70, 71} & set(kept) and max(kept.values()) == 1
    assert jaccard_join(none).count() == 0 and one_of_each_class(none).count() == 0


def test_recall_over_shared_coordinates():
    """The runs miss no more than stated where all of them see the same equal coordinates."""
    p = JoinParameters()
    rng = np.random.default_rng(1)
    q = rng.binomial(chosen_path.COORDINATES, p.similarity, 400_000) / chosen_path.COORDINATES
    second = 1 / p.similarity - 1
    apart = (1 - second) * (1 - q) + second * (1 - q) ** 2
    missed = ((1 - (1 - apart) ** p.depth) ** p.runs).mean()
    assert missed < 1.1 * (1 - p.recall)
    with pytest.raises(ValueError):
        JoinParameters(recall=1 - 1e-12).runs


def test_a_text_is_in_a_bucket_once(spark):
    sketch = bytearray(np.arange(chosen_path.COORDINATES, dtype=np.uint32).tobytes())
    rows = spark.range(5000).select(F.lit(bytearray(b"a")).alias("u"), F.lit(sketch).alias("sketch"), F.col("id").alias("path"))
    got = chosen_path.split(rows, JoinParameters()).collect()
    assert len(got) > 6000 and len({r["path"] for r in got}) == len(got)


def test_components(spark):
    edges = [(f"n{i:03d}".encode(), f"n{i + 1:03d}".encode()) for i in range(30) if i != 14]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary")
    roots = {bytes(r["u"]): bytes(r["root"]) for r in chosen_path.components(df).collect()}
    assert {roots[f"n{i:03d}".encode()] for i in range(1, 15)} == {b"n000"} and {roots[f"n{i:03d}".encode()] for i in range(16, 31)} == {b"n015"}


def test_pipeline_stages_keep_columns(spark, none):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "source_mixing", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
