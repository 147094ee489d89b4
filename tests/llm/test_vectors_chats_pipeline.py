"""Vectors, components, conversations and the pipeline against plain versions; registered queries against their SQL."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
from check import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm import ball_simhash, chat, components, decontaminate, langid, near_vectors, pieces, pii, queries

TABLES = Path("/root/testdata/sf0.001")


def plain_parts(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_chains_hubs_and_noise(spark):
    draw = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(500, 900)] + [(-5, 3), (3, 3), (None, 4), (9, None)]
    links += [(draw.randrange(2000, 2300), draw.randrange(2000, 2300)) for _ in range(150)]
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    want = plain_parts({n for p in real for n in p}, real)
    assert {r.node: r.component for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(draw):
    rows, n = [], 0
    for label in (0, 1):
        centres = draw.standard_normal((30, 24))
        for c in centres:
            for _ in range(draw.integers(1, 6)):
                rows.append((n, (c + draw.standard_normal(24) * draw.uniform(0.02, 0.3)).tolist(), label))
                n += 1
    rows += [(n + k, rows[0][1], 0) for k in range(4)] + [(n + 4, [2 * x for x in rows[0][1]], 0), (n + 5, rows[0][1], None), (n + 6, rows[0][1], 1)]
    rows += [(n + 10, None, 0), (n + 11, [0.0] * 24, 0), (n + 12, [float("nan")] * 24, 0), (n + 13, [1.0, None] * 12, 0), (n + 14, [float("inf")] * 24, 0), (n + 15, [], 0)]
    rows += [(n + 20, [1.0, 2.0], 0), (n + 21, [1.0, 2.1], 0), (n + 22, [1e200] * 24, 1), (n + 23, [1e200] * 24, 1)]
    return rows


def good(v):
    return v and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_vectors_match_brute_force(spark):
    rows = vectors(np.random.default_rng(8))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("component_id", F.lit(0))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(table, block_rows=16).collect()}
    unit = {i: (np.array(v) / np.abs(v).max()) / np.linalg.norm(np.array(v) / np.abs(v).max()) for i, v, _ in rows if good(v)}
    links = [
        (i, j) for i, v, a in rows for j, w, b in rows
        if i < j and a is not None and a == b and i in unit and j in unit and len(v) == len(w) and float(unit[i] @ unit[j]) >= 0.93
    ]
    parts = plain_parts([r[0] for r in rows], links)
    want = {i: (sum(i in p for p in links), parts[i], parts[i] == i) for i, _, _ in rows}
    assert got == want and len(links) > 50
    assert near_vectors.near_vectors(table.limit(0)).count() == 0


def test_recall_at_the_threshold():
    plan = near_vectors.calibrate(0.93)
    assert plan.recall >= 0.999
    draw = np.random.default_rng(1)
    a = draw.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = draw.standard_normal(a.shape)
    side -= (side * a).sum(axis=1)[:, None] * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * side / np.linalg.norm(side, axis=1)[:, None]
    p, q = a @ near_vectors.directions(64, 41), b @ near_vectors.directions(64, 41)
    hit = ((np.abs(p - q)[:, 1:] <= plan.other).sum(axis=1) >= plan.needed) & (np.abs(p - q)[:, 0] <= plan.first)
    assert hit.mean() >= 0.995


CHATS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello </s> [INST] \\A \\e"), (2, 0, "user", None), (2, 1, "assistant", ""),
    (3, 0, "assistant", "first"), (4, 0, "user", "a"), (4, 1, "user", "b"), (5, 0, "tool", "[NAME] x"), (5, 1, None, "no role"), (6, 0, "system", "alone"),
    (7, 0, "user", "tie"), (7, 0, "user", "tie"), (7, None, "assistant", "early"), (None, 0, "user", "no id"), (8, 0, "user", " </s>"), (8, 1, "assistant", "[INST] "),
] + [(9, k, "user" if k % 2 == 0 else "assistant", f"turn {k}\n" * (k % 3)) for k in range(1500)]


def test_chats_read_back(spark):
    table = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.segments(table)).collect()}
    convs = {}
    for c, turn, role, text in CHATS:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest()), c
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest()), c
        roles = [r for _, _, r, _ in turns]
        then = {"": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}
        valid = all(b in then.get(a, set()) for a, b in zip(["", *roles], roles)) and roles[-1] in ("user", "assistant")
        assert r.valid == valid, c
    assert chat.digests(chat.segments(table.limit(0))).count() == 0


@pytest.mark.skipif(not TABLES.exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, name):
    ok, note = compare(spark, connect(str(TABLES)), str(TABLES), queries.QUERIES[name], queries.SQL.get(name), may_be_empty=True)
    assert ok, note


@pytest.mark.skipif(not TABLES.exists(), reason="driver tables are not here")
def test_pipeline_stages_follow_their_operators(spark):
    docs = spark.read.parquet(str(TABLES / "documents.parquet"))
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "1 2 3", "en", "s", 5), (9004, "x " * 30_000, None, None, None)], docs.schema)
    docs = docs.union(odd)
    steps = [docs.withColumn("extra", F.lit(1))]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, steps[-1], str(TABLES))
        assert out.columns == list(corpus_pipeline.COLUMNS)
        steps.append(out.cache())
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4]
    assert not ids[1] & {9001, 9002, 9003}
    found = {r.doc_id: r.component_id for r in ball_simhash.near_duplicates(steps[1]).collect()}
    assert ids[2] == {d for d in ids[1] if found[d] == d}
    leaks = decontaminate.contaminated(steps[2], spark.read.parquet(str(TABLES / "benchmark.parquet")))
    assert ids[3] == ids[2] - {r.doc_id for r in leaks.collect()}
    again = pii.report(steps[4]).where("n_email + n_ip + n_card + n_phone > 0")
    assert again.count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, steps[4], str(TABLES))
    assert last.where("not round_trip").count() == 0 and {r.doc_id for r in last.select("doc_id").collect()} == ids[4]
    back = pieces.decode(last.where("sample = 1"), pieces.load_lexicon()).select("doc_id", F.col("text").alias("t"))
    assert back.join(steps[4], "doc_id").where("t <> text").count() == 0


@pytest.mark.skipif(not TABLES.exists(), reason="driver tables are not here")
def test_pipeline_decides_per_row(spark):
    docs = spark.read.parquet(str(TABLES / "documents.parquet"))
    item = spark.read.parquet(str(TABLES / "benchmark.parquet")).where("length(text) > 200").orderBy("item_id").first().text
    fair = docs.where("lang = 'en' AND n_chars BETWEEN 1500 AND 6000").orderBy("doc_id").limit(8).collect()
    a, b, c, d, e, f, g, h = [" ".join(reversed(r.text.split())) for r in fair]  # words of one language, no near copy of a document
    rows = [
        (None, a, "null, unique"), (None, b, "null, unique too"),
        (5000, c, "5, C"), (5000, d, "5, D"), (3000, d.upper(), "3, copy of D"), (None, d, "null, copy of D"),
        (7000, f"{e} {item} {e}", "7, leaks"), (7000, e[: len(e) // 2], "7, clean"), (None, f"{g} {item}", "null, leaks"),
        (8000, f, "equal rows"), (8000, f, "equal rows"), (None, h, "null, equal rows"), (None, h, "null, equal rows"),
    ]
    now = docs.union(spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], docs.schema))
    left = []
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(TABLES)).cache()
        left.append(sorted(r.source for r in now.collect() if r.source in {s for *_, s in rows}) if "source" in now.columns else None)
    assert left[0] == sorted(s for *_, s in rows)
    single = sorted({s for *_, s in rows} - {"5, D", "null, copy of D"})
    assert left[1] == single
    assert left[2] == left[3] == sorted(set(single) - {"7, leaks", "null, leaks"})
    ids = [r.doc_id for r in now.where("sample = 1 AND (doc_id IS NULL OR doc_id >= 3000)").collect()]
    assert sorted(map(str, ids)) == sorted(["None"] * 3 + ["3000", "5000", "7000", "8000"]) and now.where("NOT round_trip").count() == 0


@pytest.mark.skipif(not TABLES.exists(), reason="driver tables are not here")
def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, str(TABLES)).count() > 0
    assert langid.remainder and corpus_pipeline.ORACLE_SQL is None


def test_repeated_ids_stand_each_for_their_own_row(spark):
    """Ids shared across labels, vectors and validity, against brute force by row."""
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((6, 8))
    rows = [(int(draw.integers(0, 12)), (centres[k % 6] + draw.standard_normal(8) * 0.05).tolist(), int(draw.integers(0, 3))) for k in range(60)]
    rows += [(5, None, 0), (5, None, 0), (1, [0.0] * 8, 1), (None, rows[0][1], rows[0][2]), (3, rows[0][1], None), rows[0], rows[0]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    fine = [k for k, (i, v, a) in enumerate(rows) if i is not None and a is not None and good(v)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in fine}
    links = [(j, k) for j in fine for k in fine if j < k and rows[j][2] == rows[k][2] and float(unit[j] @ unit[k]) >= 0.93]
    root = list(range(len(rows)))
    for _ in rows:
        for j, k in links:
            root[j] = root[k] = min(root[j], root[k])
    low = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in set(root)}
    want = sorted((i is None, i or 0, sum(k in p for p in links), low[root[k]] is None, low[root[k]] or 0, i == low[root[k]]) for k, (i, _, _) in enumerate(rows))
    got = near_vectors.near_vectors(table, block_rows=8).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id is None, r.component_id or 0, r.kept) for r in got) == want
    assert len(links) > 40
