"""Each operator against its plain definition, and its defined results for odd input."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, decontam, langid, lm, mixing, neardup, pii, quality, substring, tokens
from quarry.llm._spark import join_split

WORDS = [f"w{i}" for i in range(60)] + ["Der", "die", "Über", "naïve", "日本", "x.y", "a-b", "IT'S"]
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, key int, fp string, n string, state int, row int, rep int, own_0 string, own_1 string, t string, kept boolean, mix_slot int"


def framed(spark, docs):
    """Documents as a table with further columns, some named as operators' own."""
    rows = [(d, t, ["de", "en", None][i % 3], f"s{i % 3}", len(t or ""), i, "f", "n", i, i, i, "o", "p", "t", False, 7) for i, (d, t) in enumerate(docs)]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def odd_docs(rng=None):
    """Null, empty, blank and very long texts, copies, near copies, shared passages and chains of edits."""
    rng = rng or random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    docs = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, "two words"), (7, text(20_000)), (8, "a\x0bb\x1cc\x85d e")]
    base = text(120)
    docs += [(10 + i, base) for i in range(15)]
    for i in range(20):  # edits of one original, most not alike among themselves
        w = base.split()
        for _ in range(4):
            w[rng.randrange(len(w))] = f"edit{i}{rng.random()}"
        docs.append((100 - i, " ".join(w)))
    w = text(200).split()
    for i in range(12):  # a chain: each differs a little from the one before
        for _ in range(5):
            w[rng.randrange(len(w))] = f"chain{rng.random()}"
        docs.append((200 + 5 * i % 12, " ".join(w)))
    shared = text(40)
    docs += [(300 + i, f"{text(rng.randrange(30))} {shared} {text(rng.randrange(30))}") for i in range(9)]
    docs += [(400 + i, text(rng.randrange(1, 90))) for i in range(40)]
    rng.shuffle(docs)
    return docs


@pytest.fixture(scope="module")
def docs():
    out = odd_docs()
    assert len({d for d, _ in out}) == len(out)
    return out


EMPTY: list = []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_joined_in_parts(spark, how):
    sizes = {"hot": 700, "warm": 90, "cold": 3, "alone": 2}
    left = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)] + [(None, 1)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("warm", 3), ("cold", 4), ("none", 5)], "o string, v int")
    plainly = left.join(right, F.col("k") == F.col("o"), how)
    for least in (10, 100, 10_000):
        found = join_split(left, "k", right, "o", how=how, least=least, most=10_000)
        assert rows(found, "k", "i", "v") == rows(plainly, "k", "i", "v")
    given = left.groupBy(F.col("k").alias("split_key")).agg(F.count(F.lit(1)).alias("split_n"))
    assert rows(join_split(left, "k", right, "o", 796, given, how, 10, 10_000), "k", "i", "v") == rows(plainly, "k", "i", "v")


# 1: token counts


def test_token_counts_are_the_librarys(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    more = [(900, "<|endoftext|> x<|startoftext|>y  it's <|endoftext|>"), (901, "é ́e ﬁ　Å b 'S 12345"), (902, "x" * 30_000), (903, "it 's they 're"), (None, "no id"), (4, "one")]
    every = docs + more
    found = rows(tokens.count_tokens(framed(spark, every), path), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for d, t in every:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 2048))
    assert found == sorted(want, key=repr)
    assert rows(tokens.count_tokens(framed(spark, EMPTY), path), "*") == []


def test_token_counts_of_odd_texts_with_split_ranges(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "GATHER", 2000)
    monkeypatch.setattr(tokens, "TASK", 500)
    rng = random.Random(3)
    signs = [*"abAB zZ  019.,;:<>|'\"!?-_%@\x00\x1c\x85\xa0\t\n", "é", "É", "×", "÷", "ß", "\u0301", "\u0338", "ﬁ", "İ", "ſ", "日", "½", "’", "…", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'re", "'LL"]
    some = [(i, "".join(rng.choices(signs, k=rng.randint(0, 40)))) for i in range(1000)]
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = [(d, len(tok.encode(t, add_special_tokens=False).ids)) for d, t in some]
    assert rows(tokens.count_tokens(framed(spark, some), path), "doc_id", "n_tokens") == sorted(want, key=repr)


# 2: nearest neighbours


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 24))).astype(np.float32)
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors[40] = (40, vectors[41][1])  # equal ones
    vectors += [(3000 + i, vectors[60][1]) for i in range(40)]
    odd = [(5000, None), (5020, []), (5040, [0.0] * 24), (5060, [float("nan")] + [1.0] * 23), (5080, [None] + [1.0] * 23), (5100, [float("inf")] + [1.0] * 23), (None, vectors[3][1]), (5120, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in vectors + odd], "vec_id long, embedding array<float>, label int, vec string, id int").repartition(4)
    got: dict = {}
    for q, rank, i, score in rows(ann.search(frame, lambda c: c % 20 == 0, 20), "query_id", "rank", "vec_id", "score"):
        got.setdefault(q, {})[rank] = (i, score)
    want = plain.nearest(vectors, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        assert sorted(got[q]) == list(range(1, 21))
        order = [(-got[q][r][1], got[q][r][0]) for r in range(1, 21)]
        assert order == sorted(order)
        hits += len({i for i, _ in best} & {i for i, _ in got[q].values()})
        exact = dict(plain.nearest(vectors, lambda i, q=q: i == q, 10**6)[q]) if q < 100 else {}
        assert all(math.isclose(s, exact[i], abs_tol=1e-9) for i, s in got[q].values() if i in exact)
    assert hits / (20 * len(want)) >= 0.95
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(none, lambda c: c % 20 == 0, 20).count() == 0
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert rows(ann.search(few, lambda c: c % 20 == 0, 20), "query_id", "rank", "vec_id", "score") == [(20, 1, 2, 1.0), (20, 2, 1, 0.0)]


def _recall(spark, x):
    """Of the 20 nearest of every 20th row of ``x``."""
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for q, i in rows(ann.search(frame, lambda c: c % 20 == 0, 20), "query_id", "vec_id"):
        got.setdefault(q, set()).add(i)
    queries = range(0, len(x), 20)
    return sum(len(set([i for i in np.argsort(-(x @ x[q])) if i != q][:20]) & got.get(q, set())) for q in queries) / (20 * len(queries))


@pytest.mark.parametrize("norms", ["one longer", "log-normal"])
def test_nearest_neighbours_of_unequal_norms(spark, norms):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 64))[rng.integers(0, 20, 2000)] + 0.5 * rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "one longer":
        x[7] *= 20
    else:
        x *= rng.lognormal(0, 1, (2000, 1))
    assert _recall(spark, x) >= 0.95


def test_nearest_neighbours_of_few_unrelated_vectors(spark):
    x = np.random.default_rng(5).normal(size=(21, 64))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for n, k in ((21, 20), (10, 20)):
        found = rows(ann.search(frame.where(F.col("vec_id") < n), lambda c: c % 5 == 0, k), "query_id", "rank", "vec_id")
        want = [(q, r + 1, i) for q in range(0, n, 5) for r, i in enumerate([i for i in np.argsort(-(x[:n] @ x[q])).tolist() if i != q])]
        assert sorted(found) == want


@pytest.mark.parametrize("n", [2, 3, 12, 19, 22, 30, 40])
def test_nearest_neighbours_are_complete_at_any_size(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = rows(ann.search(frame, lambda c: c % 20 == 0, 20), "query_id", "vec_id")
    assert Counter(q for q, _ in found) == {q: min(20, n - 1) for q in range(0, n, 20)}


def test_nearest_neighbours_when_no_number_of_cells_is_enough(spark, monkeypatch):
    monkeypatch.setattr(ann, "MOST_PROBES", 1)
    x = np.random.default_rng(8).normal(size=(600, 32))
    assert _recall(spark, x) == 1.0


def test_cells_of_a_query_are_the_nearest_ones():
    rng = np.random.default_rng(3)
    for width, entries in ((4, 500), (8, 3000), (16, 40), (2, 5000)):
        h = ann.Hashing(width, entries, 2, 1)
        x = rng.normal(size=(20, width))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for t in range(2):
            total = np.zeros((20, 1))
            for y in h.nearness(x, t):
                total = (total[:, :, None] + y[:, None, :]).reshape(20, -1)
            assert total.shape[1] == h.cells and (h.cell(x, t) == total.argmax(1)).all()
            for probes in (1, 3, 17, h.cells):
                cells, sums = h.nearest(x, t, probes)
                probes = min(probes, h.cells)
                assert np.allclose(np.sort(sums, 1), np.sort(total, 1)[:, -probes:])
                assert np.allclose(np.take_along_axis(total, cells, 1), sums) and all(len(set(c)) == probes for c in cells.tolist())
            at = rng.integers(0, h.cells, 20)
            assert np.allclose(h.at(x, t, at), total[np.arange(20), at])


def test_share_of_vectors_met_falls_as_rows_grow():
    """With the cells that unrelated vectors need, the hardest case."""
    rng = np.random.default_rng(6)
    shares = []
    for n in (1000, 30_000):
        x = rng.normal(size=(n, 32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        h = ann.Hashing(32, n, 6, 5)
        near = [x[[j for j in np.argsort(-(x @ q)) if j != i][:20]] for i, q in enumerate(x[:60])]
        probes = ann.probes_for(h, x[:60], near, 0.96)
        met = np.zeros((60, n), bool)
        for t in range(6):
            cell, visited = h.cell(x, t), h.nearest(x[:60], t, probes)[0]
            for i, v in enumerate(visited):
                met[i] |= np.isin(cell, v)
        shares.append(met.mean())
    assert shares[1] < 0.6 * shares[0]


def test_nearest_neighbours_ties_go_to_smaller_ids(spark):
    ones = [(1000 - i, [1.0, i * 1e-6]) for i in range(1, 200)]  # distinct, all of the same product
    frame = spark.createDataFrame([(0, [1.0, 0.0]), *ones], "vec_id long, embedding array<double>")
    found = rows(ann.search(frame, lambda c: c == 0, 20), "rank", "vec_id", "score")
    assert sorted(found) == [(r + 1, 801 + r, 1.0) for r in range(20)]


# 3: near duplicates


@pytest.mark.parametrize(("words", "percent"), [(4, 80), (5, 80)])
def test_near_duplicates(spark, docs, words, percent):
    found = neardup.near_duplicates(framed(spark, docs), words, percent)
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(plain.near_duplicates(docs, words, percent), key=repr)


def test_near_duplicates_in_random_groups(spark):
    """Groups whose members are alike to very different degrees, around the threshold."""
    rng = random.Random(11)
    docs, d = [], 0
    for _ in range(12):
        base = [f"v{rng.randrange(4000)}" for _ in range(rng.choice([30, 80, 150]))]
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 18))):
                w[rng.randrange(len(w))] = f"v{rng.randrange(4000)}"
            docs.append((d, " ".join(w)))
            d += 1
    rng.shuffle(docs)
    found = neardup.near_duplicates(framed(spark, docs), 4, 80)
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(plain.near_duplicates(docs, 4, 80), key=repr)


def test_near_duplicates_odd_ids(spark):
    long = " ".join(f"k{i}" for i in range(30))
    docs = [(7, long), (7, "quite another text here"), (9, "quite another text here"), (None, long), (None, "alone in this"), (3, None)]
    found = neardup.near_duplicates(framed(spark, docs), 4, 80)
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == sorted([(7, 27, 7, True), (7, 1, 7, True), (9, 1, 7, False), (None, 27, 7, False), (None, 1, None, True), (3, 0, 3, True)], key=repr)
    assert neardup.near_duplicates(framed(spark, EMPTY), 4, 80).count() == 0
    kept = neardup.keep_one(framed(spark, docs), 5, 80)
    assert kept.columns == framed(spark, docs).columns
    assert sorted((repr(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted((repr(d), t) for d, t in docs if d != 9)


@pytest.mark.parametrize("tile", [4096, 7])
def test_rare_pairs_miss_nothing(spark, monkeypatch, tile):
    """Crowds of altered copies, small and large: every pair over the threshold is among the candidates, and few others."""
    monkeypatch.setattr(neardup, "TILE", tile)
    rng = np.random.default_rng(4)
    sets: list = []
    for size in (3, 20, 60, 150, 400, 900, 1300):
        base = rng.integers(0, 2**62, size)
        spare = rng.integers(0, 2**62, size)  # alterations that several copies have
        for _ in range(25):
            s = set(rng.choice(base, size - int(rng.integers(0, max(1, size // 6))), replace=False).tolist())
            s |= set(rng.choice(spare, int(rng.integers(0, max(1, size // 8))), replace=False).tolist())
            sets.append(sorted(s))
    rows_ = [(i, i, s, neardup.registers(np.array(s).view(np.uint64), neardup.FINE).tobytes() if len(s) > neardup.LONG else b"") for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows_, "id long, g long, set array<long>, fine binary")
    labels = spark.createDataFrame([(i, i) for i in range(len(sets))], "node long, label long")
    found = {(r["a"], r["b"]) for r in neardup._rare_pairs(frame, labels, 80).collect()}
    plain_sets = [set(s) for s in sets]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(plain_sets[i] & plain_sets[j]) >= 80 * len(plain_sets[i] | plain_sets[j])}
    assert len(want) > 200 and want <= found and len(found) < 3 * len(want)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(2)
    for common, own in ((40, 10), (300, 100), (3000, 300), (5, 2)):
        errors = []
        for _ in range(30):
            x = rng.integers(0, 2**63, common + 2 * own, dtype=np.uint64)
            a, b = np.sort(x[: common + own]), np.sort(x[own:])
            s = neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
            errors.append(s - common / (common + 2 * own))
        assert abs(np.mean(errors)) < 0.05


# 5: benchmark decontamination


@pytest.mark.parametrize("most_words", [1_000_000, 40])
def test_decontamination(spark, docs, most_words):
    rng = random.Random(5)
    texts = [t for _, t in docs if t and 30 < len(t) < 2000]
    items = [(i, " ".join(rng.choice(texts).split()[5:25])) for i in range(12)]
    items += [(50, None), (51, ""), (52, "?!"), (53, "ONE"), (54, "two words"), (55, "a b"), (56, "unseen words only here"), (57, items[0][1]), (58, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    every = [*docs, (700, "w1 " * 50), (None, "ONE more"), (4, "one"), (701, "two, WORDS; two words")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    found = decontam.find(framed(spark, every), bench, 10, most_words)
    assert rows(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(plain.decontamination(every, items, 10), key=repr)
    clean = decontam.remove_contaminated(framed(spark, every), bench, 10)
    assert clean.columns == framed(spark, every).columns
    assert rows(clean, "doc_id", "text") == sorted([x for x, y in zip(every, plain.decontamination(every, items, 10), strict=True) if not y[-1]], key=repr)


def test_decontamination_locations(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(14))), (2, "short one")], "item_id long, text string")
    docs = [(1, "x y " + " ".join(f"W{i}" for i in range(12)) + " z short one"), (2, "nothing of it"), (3, None)]
    got = {r["doc_id"]: (r["longest_match"], [tuple(x) for x in r["locations"]]) for r in decontam.find(framed(spark, docs), bench, 10, places=True).collect()}
    assert got == {1: (12, [(2, 14), (15, 17)]), 2: (0, []), 3: (0, [])}


def test_decontamination_odd_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    empty = plain.sha("")
    assert rows(decontam.find(framed(spark, [(1, "a b"), (2, None)]), none, 10), "*") == [(1, 2, 0, 0, 0, empty, False), (2, 0, 0, 0, 0, empty, False)]
    assert decontam.find(framed(spark, EMPTY), none, 10).count() == 0
    item = spark.createDataFrame([(1, " ".join(f"z{i}" for i in range(30)))], "item_id long, text string")
    long = framed(spark, [(1, "x " + " ".join(f"z{i}" for i in range(4, 27)) + " y")])
    assert decontam.find(long, item, 10).select("longest_match", "n_hit").first() == (23, 23)


# 6: language model


def test_language_model(spark, docs):
    every = [d for d in docs if d[0] != 7] + [(600 + i, " ".join(["the same few words", "again and again"][i % 2].split() * 5)) for i in range(60)] + [(None, "w1 w2")]
    held, dev = (F.coalesce(F.col("doc_id") % 7 == k, F.lit(False)) for k in (2, 3))
    got = {r["doc_id"]: r for r in lm.score(framed(spark, every), held, dev).collect()}
    want = plain.base_score(every, lambda d: d is not None and d % 7 == 2)
    assert len(got) == len(every)
    for d, (n, known, total, base) in want.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] <= 0 and r["held_out"] == (d is not None and d % 7 == 2)
    ours, theirs = (sum(got[d][c] for d in want if d and d % 7 == 2) for c in ("score", "base_score"))
    assert ours > theirs  # word pairs help on texts not learnt from
    assert lm.score(framed(spark, EMPTY), held, dev).count() == 0
    only = lm.score(framed(spark, [(2, "a b"), (9, None)]), held, dev).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in only} == {(2, 3, 0, 0, 0.0), (9, 1, 0, 0, 0.0)}


def test_language_model_against_plain_counts(spark):
    """Bigram, unigram and uniform parts by hand; the weights are those the operator learns on the same cells."""
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcd") + rng.choice("xy") for _ in range(rng.randrange(1, 30)))) for i in range(80)]
    held, dev = F.col("doc_id") % 7 == 2, F.col("doc_id") % 7 == 3
    got = {r["doc_id"]: r["score"] for r in lm.score(framed(spark, docs), held, dev).collect()}
    toks = {d: [*t.split(), None] for d, t in docs}

    def counted(keep):
        one, two, starts = Counter(), Counter(), 0
        for d, w in toks.items():
            if keep(d):
                starts += 1
                one.update(w)
                two.update(zip([0, *w], w, strict=False))
        return one, two, starts

    less = counted(lambda d: d % 7 not in (2, 3))
    every = counted(lambda d: d % 7 != 2)
    kinds = len(every[0])

    def parts(c, d):
        one, two, starts = c
        w = toks[d]
        for v, x in zip([0, *w], w, strict=False):
            before = starts if v == 0 else one[v]
            yield before, two[v, x] / max(before, 1), one[x] / max(1, sum(one.values()))

    cells = Counter()
    for d in toks:
        if d % 7 == 3:
            for before, p2, p1 in parts(less, d):
                log = lambda p: max(lm.LOWEST + 1, round(lm.STEPS * math.log2(p))) if p > 0 else lm.LOWEST
                cells[int(lm._bucket(np.array([float(before)]))[0]), log(p2), log(p1)] += 1
    mixture = lm.expectation_maximisation(np.array([(*k, n) for k, n in cells.items()], float), 1 / (kinds + 1))
    for d in toks:
        want = 0.0
        for before, p2, p1 in parts(every, d):
            w = mixture[int(lm._bucket(np.array([float(before)]))[0])]
            want += math.log10(w[0] * p2 + w[1] * p1 + w[2] / (kinds + 1))
        assert math.isclose(got[d], want, rel_tol=1e-9, abs_tol=1e-9)
    assert np.allclose(mixture.sum(1), 1)


def test_language_model_of_triples_against_plain_counts(spark):
    """All four parts by hand, weights by the context of two words where it was seen."""
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("abc") + rng.choice("xy") for _ in range(rng.randrange(1, 25)))) for i in range(70)]
    docs += [(i, docs[i - 70][1]) for i in range(70, 100)]
    held, dev = F.col("doc_id") % 7 == 2, F.col("doc_id") % 7 == 3
    got = {r["doc_id"]: r["score"] for r in lm.score(framed(spark, docs), held, dev, 3).collect()}
    toks = {d: [0, 0, *t.split(), None] for d, t in docs}

    def counted(keep):
        runs, contexts = [Counter() for _ in range(3)], [Counter() for _ in range(3)]
        for d, w in toks.items():
            for i in range(2, len(w) * keep(d)):
                for k in range(3):
                    runs[k][tuple(w[i - k : i + 1])] += 1
                    contexts[k][tuple(w[i - k : i])] += 1
        return runs, contexts

    def parts(c, d):
        runs, contexts = c
        w = toks[d]
        for i in range(2, len(w)):
            before = [contexts[k][tuple(w[i - k : i])] for k in range(3)]
            chance = [runs[k][tuple(w[i - k : i + 1])] / max(1, before[k]) for k in range(3)]
            bucket = lm._bucket(np.array([float(x) for x in before]))
            yield int(lm.BUCKETS + bucket[2] if before[2] else bucket[1]), chance[::-1]

    less, every = counted(lambda d: d % 7 not in (2, 3)), counted(lambda d: d % 7 != 2)
    kinds, cells = len(every[0][0]), Counter()
    for d in toks:
        if d % 7 == 3:
            for bucket, chance in parts(less, d):
                cells[bucket, *(max(lm.LOWEST + 1, round(lm.STEPS * math.log2(p))) if p > 0 else lm.LOWEST for p in chance)] += 1
    mixture = lm.expectation_maximisation(np.array([(*k, n) for k, n in cells.items()], float), 1 / (kinds + 1))
    assert mixture.shape == (2 * lm.BUCKETS, 4) and np.allclose(mixture.sum(1), 1) and (mixture[: lm.BUCKETS, 0] == 0).all()
    for d in toks:
        want = sum(math.log10(mixture[bucket] @ [*chance, 1 / (kinds + 1)]) for bucket, chance in parts(every, d))
        assert math.isclose(got[d], want, rel_tol=1e-9, abs_tol=1e-9)
    # A part that is the best everywhere gets all the weight.
    sure = lm.expectation_maximisation(np.array([(lm.BUCKETS + 3, 0, -8, -40, 1000.0)]), 1e-6)
    assert sure[lm.BUCKETS + 3, 0] > 0.99


# 7: personal data


PERSONAL = [
    "mail joe.doe+x@mail.example.org, or a@b, c@d.e@f.g", "at 10.0.0.1 and 999.1.1.1 and 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +44 (20) 7946-0958, +1 2, or (415) 555-2671",
    "4111111111111111 4111111111111111", "+12345678901234567890", "@", "x@y.z" * 50, "1" * 5000, "1." * 3000, "é+33 1 23 45 67 89é 日本@例え.jp", "api_key = '9f86d081884c7d659a2feaa0c55ad015'", "a@b.c d@e.f  +4 5555 5555 5 00.01.002.255",
]


def test_personal_data_base_spans(spark, docs):
    rng = random.Random(4)
    every = [(d, t) for d, t in docs if d != 7] + [(800 + i, t) for i, t in enumerate(PERSONAL)]
    alphabet = "0123456789" * 2 + " .-+@()ab\n"
    every += [(1000 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(120)))) for i in range(300)] + [(None, "a@b.c"), (4, "one")]
    frame = framed(spark, every)
    found = pii.spans(frame, pii.fit(frame))
    want = []
    for d, t in every:
        base = plain.personal(t)
        want.append((d, *(sum(s[0] == k for s in base) for k in pii.KINDS), plain.sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))))
    assert rows(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)
    have = {r["doc_id"]: set(r["spans"].split(",")) - {""} for r in found.collect()}
    for d, t in every:
        assert {f"{k}:{a}:{b}" for k, a, b in plain.personal(t)} <= have[d] or d == 4
        assert all(0 <= int(s.split(":")[1]) < int(s.split(":")[2]) <= len(t) for s in have[d])


def test_personal_data_model(spark):
    model = pii.train(["write to jane@firm.example or call +44 20 7946 0958", "in 2011 there were 12345 cases", "server 10.20.30.40 answered"] * 5)
    text = "You can call (415) 555-2671 or 415-555-2671 in 2011."
    base, more = pii.find(text, model)
    assert base == [] and ("phone", 13, 27) in more and not any(text[a:b] == "2011" for _, a, b in more)
    assert pii.find("token = 'a3f5c9d2e8b14706a3f5c9d2e8b14706'", model)[1][0][0] == "secret"
    assert pii.find("plain words, 3 of them", model) == ([], [])


def test_segmentation_is_the_best_one():
    """The dynamic programme against all segmentations of short texts, and the forward sum likewise."""
    model = pii.train(PERSONAL[:6])

    def every(cuts, arcs, j):
        if j == 0:
            return [(0.0, ())]
        out = every(cuts, arcs, j - 1)
        for i, t, f in arcs[j]:
            out = out + [(s + model.score(f), (*x, (pii.TYPES[t], cuts[i], cuts[j]))) for s, x in every(cuts, arcs, i)]
        return out

    for text in ("+1 415 555 26", "10.0.0.1", "4111 1111 1111 1111", "a.b@c.de"):
        cuts, arcs = pii._lattice(text, 0, len(text))
        found = every(cuts, arcs, len(cuts) - 1)
        best = pii.decode(model, text, 0, len(text))
        got = max((s for s, x in found if list(x) == best), default=None)
        assert got is not None and math.isclose(got, max(s for s, _ in found), abs_tol=1e-9)
        assert math.isclose(pii._forward(model, cuts, arcs)[-1], np.logaddexp.reduce([s for s, _ in found]), abs_tol=1e-9)


def test_lattice_holds_every_segment():
    """The ends that are tried against all ends within reach."""
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices([*"0123456789" * 2, *" .()+-@_a%", "\n", "x9", "4111 1111 1111 1111", "1.2.3.4", "a.b@c.de", "+44 20 7946 0958"], k=rng.randint(1, 40)))
        cuts, arcs = pii._lattice(text, 0, len(text))
        assert cuts == [0, *(m.end() for m in pii._TOKEN.finditer(text))]
        for j in range(1, len(cuts)):
            want = []
            for i in range(max(0, j - 2 * pii.LONGEST), j):
                if text[cuts[i]] in pii._LOCAL or text[cuts[i]] == "(":
                    want += [(i, t, f) for t, kind in enumerate(pii.TYPES) if (kind != "secret" or j == i + 1) and (f := pii.features(text, cuts[i], cuts[j], kind))]
            assert arcs[j] == want


def test_training_parts_have_the_whole_likelihood():
    model = pii.train(PERSONAL[:6])
    for text in [*PERSONAL, "1 2 3 +1 415 555 2671 and 7 8 10.0.0.1 9", "5 " * 500 + "4111 1111 1111 1111" + " 6" * 500]:
        cuts, arcs = pii._lattice(text, 0, len(text))
        total = 0.0
        for x, y in pii._parts(cuts, arcs):
            own = [[(i - x, t, f) for i, t, f in s] for s in arcs[x : y + 1]]
            own[0] = []
            assert all(i >= 0 for s in own for i, *_ in s)
            total += pii._forward(model, cuts[x : y + 1], own)[-1]
        assert math.isclose(total, pii._forward(model, cuts, arcs)[-1], abs_tol=1e-6)


def test_personal_data_in_long_texts_of_numbers():
    model = pii.train(PERSONAL[:6])
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10 ** rng.randint(1, 9))) for _ in range(20_000))
    base, more = pii.find(text, model)
    assert base == pii.base_spans(text)
    # The segmentation of an island doesn't depend on what is far away.
    early = pii.find(text[:3000], model)[1]
    assert [s for s in more if s[2] < 2500] == [s for s in early if s[2] < 2500]


def test_redaction(spark):
    docs = [(1, "write to a.b@c.org now"), (2, None), (3, ""), (4, "nothing 1 here"), (None, "+44 20 7946 0958")]
    frame = framed(spark, docs)
    out = pii.redact(frame, pii.fit(frame))
    assert out.columns == frame.columns
    assert rows(out, "doc_id", "text", "n_chars") == sorted([(1, "write to <EMAIL> now", 20), (2, None, None), (3, "", 0), (4, "nothing 1 here", 14), (None, "<PHONE>", 7)], key=repr)
    assert pii.redact(framed(spark, EMPTY), pii.fit(framed(spark, EMPTY))).count() == 0


# 4 and 10: what is learnt


def test_quality(spark):
    rng = random.Random(6)
    good = ["the careful reader", "finds a well made", "argument in this", "chapter of the book"]
    bad = ["click here", "buy now!!!", "$$$ free", "xx99 zz"]
    docs = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(40))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (None, "the careful reader"), (5, docs[5][1])]
    frame = framed(spark, docs)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (7, None, 0), (99_999, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(frame, labels, lambda c: c < 200)
    got = {r["doc_id"]: r["score"] for r in quality.score(frame, model).collect()}
    assert len(got) == 303 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] > 0.5) == (i % 2) for i in range(200, 300)]) > 0.97
    kept = quality.keep_good(frame, model, 0.3)
    assert kept.columns == frame.columns
    assert rows(kept, "doc_id", "text") == rows(frame.where(F.col("doc_id").isin([d for d, s in got.items() if d is not None and s >= 0.3]) | F.col("doc_id").isNull()), "doc_id", "text")
    none = quality.fit(framed(spark, EMPTY), labels.limit(0), lambda c: F.lit(True))
    assert {r["score"] for r in quality.score(frame, none).collect()} == {0.5}
    assert quality.score(framed(spark, EMPTY), model).count() == 0


def test_quality_calibration_does_not_depend_on_the_number_of_labels():
    rng = np.random.default_rng(2)
    y = np.repeat([0.0, 1.0], [300, 700])
    x = rng.normal(0.02 * (2 * y - 1), 0.015)
    weight = np.where(y == 1, 2.0, 0.5)
    bias, slope = quality._logistic(x, y, weight)
    for times in (1e-3, 1e3, 1e9):
        assert np.allclose(quality._logistic(x, y, weight * times), (bias, slope))
    # A plain maximum of the weighted likelihood, by small steps from there.
    loss = lambda b, s: (weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (b + s * x))).sum()
    best = loss(bias, slope)
    assert all(best < loss(bias + b, slope + s) + 0.05 for b in (-0.1, 0, 0.1) for s in (-5, 0, 5))
    assert np.mean((1 / (1 + np.exp(-(bias + slope * x))) > 0.5) == y) > 0.85


def test_quality_scores_are_alike_when_labels_are_repeated(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["plain", "even", "prose", "of", "a", "book"] if i % 2 else ["win", "cash", "now", "!!", "click", "a"]) for _ in range(30))) for i in range(120)]
    frame = framed(spark, docs)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    many = labels.crossJoin(spark.range(1000)).select("doc_id", "quality")
    one, other = (quality.fit(frame, x, lambda c: F.lit(True)) for x in (labels, many))
    assert np.isclose(one.slope, other.slope, rtol=0.02) and np.isclose(one.bias, other.bias, atol=0.05)


def test_quality_difference_is_that_of_plain_compression(spark):
    import zstandard

    rng = random.Random(4)
    parts = [[" ".join(rng.choice(w) for _ in range(30)) for _ in range(60)] for w in (["alpha", "beta", "gamma"], ["rho", "sigma", "tau"])]
    good, bad = (quality._dictionary([t.encode() for t in p], 4096) for p in parts)
    model = quality.QualityModel(good, bad, 0.3, 7.0)
    texts = ["", "alpha beta gamma " * 3, "rho sigma tau " * 3, "neither of them", "alpha rho " * 3000, "é" * 5000]

    def plain_score(t):
        raw, sizes = t.encode(), []
        for d in (good, bad):
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048)))
        return 1 / (1 + math.exp(-(0.3 + 7.0 * ((sizes[1] - sizes[0]) / sum(sizes) if raw else 0.0))))

    rows_ = [*enumerate(texts), (1, texts[1]), (None, None)]
    wide = framed(spark, rows_).withColumns({"score": F.lit("x"), "model": F.lit(1)})
    got = sorted((r["doc_id"], r["score"]) for r in quality.score(wide, model).collect() if r["doc_id"] is not None)
    assert np.allclose([s for _, s in got], [plain_score(texts[d]) for d, _ in got])
    kept = quality.keep_good(wide, model, 0.6)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(d for d, t in rows_ if d is not None and plain_score(t) >= 0.6)


def test_language_id(spark):
    rng = random.Random(9)
    vocab = {k: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(80)] for k, letters in (("aa", "abcdeé"), ("bb", "abcdfgh"), ("cc", "nopqrst"))}
    docs = [(i, " ".join(rng.choice(vocab["abc"[i % 3] * 2]) for _ in range(12)), "abc"[i % 3] * 2) for i in range(240)]
    docs += [(500, None, "aa"), (501, "", None), (502, "12 34 ?!", "bb"), (503, "日本語", None), (None, docs[0][1], None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"names": F.lit(1), "rate": F.lit(2)})
    model = langid.fit(frame, lambda c: c < 180)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(frame, model).collect()}
    assert len(got) == len(docs) and all(0 <= s <= 1 for _, s in got.values())
    assert got[500] == got[501] == got[502] == ("und", 0.0) and got[503][0] in model.names and got[None][0] == "aa"
    assert np.mean([got[i][0] == lang for i, _, lang in docs[180:240]]) > 0.95
    empty = frame.limit(0)
    assert langid.predict(empty, langid.fit(empty, lambda c: F.lit(True))).count() == 0
    assert {r["lang_pred"] for r in langid.predict(frame, langid.fit(empty, lambda c: F.lit(True))).collect()} == {"und"}


def test_language_of_short_texts(spark):
    words_ = {"aa": ["the", "of", "and", "is", "a"], "bb": ["ja", "und", "nein", "ist", "zu"], "cc": ["oui", "les", "et", "à", "est"]}
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(words_[k], k=8)), k) for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(frame, lambda c: F.lit(True))
    short = [(i, t, k) for i, (t, k) in enumerate((w, k) for k, ws in words_.items() for w in [*ws, f"  {ws[1]}!", f"{ws[0]}."])]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(framed(spark, [(i, t) for i, t, _ in short]), model).collect()}
    assert got == {i: k for i, _, k in short}


def test_language_against_plain_counts(spark):
    """Grams by slicing, and each one's languages bit by bit."""
    rng = random.Random(4)
    docs = [(i, " ".join("".join(rng.choices("abcé" if i % 2 else "xyzñ", k=rng.randint(1, 6))) for _ in range(20)), "ab"[i % 2]) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(frame, lambda c: c < 40)
    texts = [t for _, t, _ in docs] + ["", None, "a", "é", "..x", "ab 12 ÉA-x", "zz\n\nz", "abcé " * 5000, "xyz", "日本"]
    texts += texts[:3]

    def grams(t):
        low = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in (t or "").lower())
        raw = b" " + b" ".join(low.encode().split(b" ")) + b" "
        while b"  " in raw:
            raw = raw.replace(b"  ", b" ")
        out = [raw[i : i + 5] for i in range(len(raw) - 4)]
        return out + [b" " + w + b" " for w in raw.split() if len(w) < 3]

    def held(g, i):
        slots = langid._slots(np.array([int.from_bytes(g, "little")], np.uint64))
        return all(int(model.planes[0, s[0]]) >> i & 1 for s in slots)

    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(framed(spark, list(enumerate(texts))).withColumn("lang", F.lit(3)), model).collect()}
    for k, t in enumerate(texts):
        if not t:
            assert got[k] == "und"
            continue
        g = grams(t)
        hits = [max(0.0, (sum(held(x, i) for x in g) - fp * len(g)) / (1 - fp + 1e-9)) for i, fp in enumerate(model.false_rate)]
        assert got[k] == model.names[int(np.argmax(hits))], t


def test_language_filters_hold_what_was_learnt():
    """No n-gram learnt is ever missed, and the fill says how often others seem present."""
    rng = np.random.default_rng(3)
    g = rng.integers(0, 2**40, 20_000, dtype=np.uint64)
    plane = np.zeros(langid.SLOTS, np.uint64)
    for s in langid._slots(g):
        plane[s] |= np.uint64(1)
    test = lambda x: np.bitwise_and.reduce([plane[s] for s in langid._slots(x)]) == 1
    assert test(g).all()
    others = rng.integers(2**40, 2**41, 200_000, dtype=np.uint64)
    assert abs(test(others).mean() - plane.mean() ** langid.HASHES) < 0.002


# 8: mixing


@pytest.mark.parametrize("shares", [{"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 333, "b": 333, "c": 334}, {"a": 500, "b": 499, "c": 1}, {f"s{i}": i + 1 for i in range(44)}])
def test_schedule_stays_within_a_block(shares):
    period = sum(shares.values())
    done = dict.fromkeys(shares, 0)
    for s, j, slot, due in mixing.schedule(shares):
        assert (j - 1) * period // shares[s] <= slot < due == -(-j * period // shares[s])
        done[s] += 1
        assert all(abs(done[k] - shares[k] * (slot + 1) / period) < 1 for k in shares)
    assert done == shares


def test_mixing(spark):
    docs = [(i, f"t{i}", ["big"] * 8 + ["mid"] * 3 + [None]) for i in range(1200)]
    frame = spark.createDataFrame([(i, t, s[i % 12], 5, "z") for i, t, s in docs] + [(None, "n", "big", 5, "z"), (3, "again", "mid", 5, "z")], "doc_id long, text string, source string, mix_slot int, rank string").repartition(5)
    out = mixing.mix(frame, period=100, block=4)
    got = [r.asDict() for r in out.collect()]
    assert sorted((repr(r["doc_id"]), r["text"], repr(r["source"])) for r in got) == sorted((repr(r["doc_id"]), r["text"], repr(r["source"])) for r in frame.collect())
    assert len({r["mix_position"] for r in got}) == len(got)
    sources: dict = {}
    for r in got:
        assert r["mix_position"] // 4 == r["mix_slot"] < r["mix_deadline"]
        sources.setdefault(r["mix_slot"], set()).add(r["source"])
    assert all(len(s) == 1 for s in sources.values())
    counts = Counter(r["source"] for r in got)
    shares = mixing.whole_shares({k or "": v**0.5 for k, v in counts.items()}, 100)
    inside = sorted({r["mix_slot"] for r in got if r["in_target"]})
    assert inside == list(range(len(inside))) and len(inside) > 20
    done: Counter = Counter()
    for slot in inside:
        done[next(iter(sources[slot])) or ""] += 1
        assert all(abs(done[k] - shares[k] * (slot + 1) / 100) < 1 for k in shares)
    again = mixing.mix(frame.repartition(2), period=100, block=4)
    assert rows(again.where("doc_id is not null and doc_id <> 3"), "doc_id", "mix_position") == rows(out.where("doc_id is not null and doc_id <> 3"), "doc_id", "mix_position")


@pytest.mark.parametrize("at_once", [37, 1 << 20])
def test_mixing_holds_unrounded_weights(spark, monkeypatch, at_once):
    monkeypatch.setattr(mixing, "AT_ONCE", at_once)
    sources = ["big"] * 1600 + [f"s{i % 99}" for i in range(4000)]
    frame = spark.createDataFrame(list(enumerate(sources)), "doc_id long, source string")
    got = mixing.mix(frame, {"big": 99.0} | {f"s{i}": 1.0 for i in range(99)}, block=4).collect()
    assert len(got) == len({r["mix_position"] for r in got}) == len(sources)
    owner = {r["mix_slot"]: (r["source"], r["in_target"]) for r in got}
    assert all(r["mix_slot"] < r["mix_deadline"] for r in got)
    lasting = [s for s in sorted(owner) if owner[s][1]]
    assert lasting == list(range(len(lasting))) and len(lasting) > 700
    target = {s: (99 if s == "big" else 1) / 198 for s in set(sources)}
    done: Counter = Counter()
    for slot in lasting:
        done[owner[slot][0]] += 1
        assert all(abs(done[s] - w * (slot + 1)) < 1 for s, w in target.items())


def test_mixing_odd(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string")).count() == 0
    many = spark.createDataFrame([(i, f"s{i}") for i in range(1500)], "doc_id long, source string")
    out = mixing.mix(many)
    assert out.count() == 1500 and out.select("mix_position").distinct().count() == 1500
    given = mixing.mix(spark.createDataFrame([(i, "ab"[i % 2]) for i in range(64)], "doc_id long, source string"), {"a": 3, "b": 1}, period=4, block=1)
    first = Counter(r["source"] for r in given.where("mix_slot < 8").collect())
    assert first == {"a": 6, "b": 2}
    # Rows without an id, other rows repeated, and columns named like the operator's own.
    odd = spark.createDataFrame([(None, f"t{i}", "a") for i in range(300)] + [(7, "same", "a")] * 20 + [(i, "x", None) for i in range(50)], "doc_id long, text string, source string")
    out = mixing.mix(odd.withColumns({"rank": F.lit("r"), "slots": F.lit(2), "before": F.lit(3)}), {"a": 1.0, None: 1.0})
    assert out.count() == 370 and out.select("mix_position").distinct().count() == 370 and {"rank", "slots", "before"} <= set(out.columns)
    places = [r["mix_position"] for r in out.where("doc_id IS NULL").collect()]
    assert max(places) - min(places) > 300
    half = Counter(r["source"] for r in out.where("mix_slot < 10").collect())
    assert half == {"a": 40, None: 40}


# 9: repeated passages


@pytest.mark.parametrize("window", [13, 6])
def test_substring(spark, docs, window):
    every = [*docs, (None, docs[-1][1]), (docs[3][0], docs[3][1]), (950, "again " * 40), (951, "again " * 14)]
    found = substring.remove_repeats(framed(spark, every), window)
    assert rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(plain.substring(every, window), key=repr)
    assert substring.remove_repeats(framed(spark, EMPTY), window).count() == 0


def test_substring_crowded(spark):
    """One passage in most documents, and a filter so small that it lets nearly all windows pass."""
    rng = random.Random(12)
    passage = " ".join(rng.choice(WORDS) for _ in range(25))
    docs = [(i, " ".join([*(rng.choice(WORDS) for _ in range(rng.randrange(20))), passage, *(rng.choice(WORDS) for _ in range(20))])) for i in range(300)]
    want = sorted(plain.substring(docs, 13), key=repr)
    old = substring.TASK
    substring.TASK = 500
    try:
        found = substring.remove_repeats(framed(spark, docs), 13)
        assert rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    finally:
        substring.TASK = old


def test_substring_tells_windows_of_one_key_apart(spark, docs, monkeypatch):
    class Narrow(substring.Piece):
        """Windows have one of four keys."""

        def keys(self, length):
            return substring.Piece.keys(self, length) & np.uint64(3 << 62)

    monkeypatch.setattr(substring, "Piece", Narrow)
    some = docs[:60]
    found = substring.remove_repeats(framed(spark, some), 13)
    assert rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(plain.substring(some, 13), key=repr)


def test_found_at_equal_keys():
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, 6, (200, 2)).astype(np.uint64), axis=0)
    known, check = pairs.T
    k, c = rng.integers(0, 8, (2, 500)).astype(np.uint64)
    at = substring.found_at(known, check, k, c)
    where = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    assert at.tolist() == [where.get((x, y), -1) for x, y in zip(k.tolist(), c.tolist(), strict=True)]
