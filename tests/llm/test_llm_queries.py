"""The registered queries on the driver's small tables: against SQL, plain definitions, recall and held-out accuracy."""

from __future__ import annotations

import glob
import math
import os
import zlib

import duckdb
import numpy as np
import plain
import pytest

from quarry.llm.queries import ORACLE_SQL, QUERIES

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def connected(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="module")
def docs():
    return connected(SMALL).execute("SELECT doc_id, text FROM documents").fetchall()


def run(spark, name, folder=SMALL):
    (key,) = [k for k in QUERIES if k.startswith(f"{name}_")]
    return [r.asDict() for r in QUERIES[key](spark, folder).collect()]


def crc(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("folder", [SMALL, LARGER])
def test_against_sql(spark, name, folder):
    df = QUERIES[name](spark, folder)
    found = connected(folder).execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


def test_op1(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_padding()
    tok.no_truncation()
    want = {d: len(tok.encode(t or "", add_special_tokens=False).ids) for d, t in docs}
    got = {r["doc_id"]: r for r in run(spark, "op1")}
    assert {d: r["n_tokens"] for d, r in got.items()} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got.values())
    assert {d: r["n_bytes"] for d, r in got.items()} == {d: len((t or "").encode()) for d, t in docs}


@pytest.mark.parametrize("folder", [SMALL, LARGER])
def test_op2_recall(spark, folder):
    rows = connected(folder).execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got: dict = {}
    for r in run(spark, "op2", folder):
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    queries = np.flatnonzero(ids % 20 == 0)
    assert set(got) == set(ids[queries].tolist())
    hits = 0
    for q in queries:
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        mine = got[int(ids[q])]
        assert sorted(mine) == list(range(1, 21))
        at = {int(i): k for k, i in enumerate(ids)}
        assert all(math.isclose(v, s[at[i]], rel_tol=1e-9, abs_tol=1e-9) for i, v in mine.values())
        hits += len({int(ids[i]) for i in order} & {i for i, _ in mine.values()})
    assert hits / (20 * len(queries)) >= 0.9


def test_op4_held_out(spark):
    con = connected(LARGER)
    labels = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    got = run(spark, "op4", LARGER)
    assert len(got) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (crc(r["doc_id"], 5) == 0) for r in got)
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    area = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert area > 0.8


def test_op6(spark, docs):
    want = plain.base_score(docs, lambda d: crc(d, 7) == 2)
    got = {r["doc_id"]: r for r in run(spark, "op6")}
    assert set(got) == set(want)
    for d, (n, known, total, base) in want.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, crc(d, 7) == 2)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op7(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op7")}
    assert len(got) == len(docs)
    for d, t in docs:
        base = plain.personal(t)
        assert tuple(got[d][f"n_{k}"] for k in ("email", "ip", "card", "phone")) == tuple(sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone"))
        assert got[d]["base_sha256"] == plain.sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[d]["spans"].split(","))


def test_op10_held_out(spark):
    con = connected(LARGER)
    langs = dict(con.execute("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL AND regexp_matches(text, '[a-zA-Z]{2}')").fetchall())
    got = run(spark, "op10", LARGER)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (crc(r["doc_id"], 4) == 2) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in langs]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.9
    assert {r["lang_pred"] for r in got} <= {*langs.values(), "und"}


def test_op8_is_native(spark):
    plan = QUERIES["op8_mix_sources"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
