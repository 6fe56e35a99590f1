"""The Jaccard join, hard negatives, whitening, nearest neighbours and deep pages against plain versions."""

import itertools
import math
import os
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ecospark.llm import html, jaccard, negatives, neighbours, whitening
from ecospark.sources.tables import checkpointed, scratch_root
from pyspark.sql import functions as F


# ---- n-gram Jaccard join


def plain_sets(texts, size=4):
    out = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = max(1, len(words) - size + 1) if words else 0
        out.append({" ".join(words[i:i + size]) for i in range(n)})
    return out


def plain_components(ids, sets):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            if ids[a] <= ids[b]:
                root[b] = a
            else:
                root[a] = b
    return {ids[i]: (len(sets[i]), ids[find(i)]) for i in range(len(ids))}


def edited(rng, words, share):
    return [w if rng.random() > share else f"x{rng.integers(10**6)}" for w in words]


def jaccard_texts():
    """Chains of near copies, copies at the threshold, a passage many share, short and empty texts."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    passage = " ".join(rng.choice(vocabulary, 60))
    for _ in range(12):
        base = list(rng.choice(vocabulary, int(rng.integers(8, 150))))
        for share in (0.0, 0.004, 0.01, 0.02, 0.03, 0.04):
            texts.append(" ".join(edited(rng, base, share)))
        texts.append(" ".join(base[: int(len(base) * 0.9)]).upper())
        texts.append(" ".join(base) + "\n" + passage)
    for _ in range(25):
        texts.append(" ".join(rng.choice(vocabulary, int(rng.integers(20, 60)))) + " " + passage)
    texts += ["", "  \t\n", None, "one", "One", "one two", "one two three four", "ONE\x0btwo three\tfour", "é two", "É two"]
    # Sets that differ in one of 20 shingles: 19 / 21 links; and 17 / 20 exactly at the threshold.
    row = [f"t{i}" for i in range(23)]
    texts += [" ".join(row), " ".join([*row[:22], "other"]), " ".join(row[:20])]
    return texts


@pytest.mark.parametrize("group", [100, 1 << 17])
def test_jaccard_equals_all_pairs(spark, group):
    texts = jaccard_texts()
    ids = list(np.random.default_rng(1).permutation(len(texts)).tolist())
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("N_Shingles", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(docs, group=group).collect()}
    assert got == plain_components(ids, plain_sets(texts))


def test_jaccard_of_a_large_group_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(edited(rng, base, 0.01)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (7, None), (None, texts[9]), (None, None)]
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_components(list(range(300)), plain_sets(texts))
    assert len(got) == len(rows)
    for r in got:
        if r["n_shingles"] == 0:
            assert r["component_id"] == r["doc_id"]
        elif r["doc_id"] is None:
            assert r["component_id"] == want[9][1]
        else:
            assert r["component_id"] == want[r["doc_id"]][1]


def test_jaccard_of_no_rows_and_long_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar_documents(none).collect() == []
    words = [str(i) for i in range(60_000)]
    rows = [(3, " ".join(words)), (2, " ".join([*words[:59_000], "end"])), (1, " ".join(words[:40_000]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: 2, 2: 2, 1: 1}


def test_prefix_bounds_lose_no_link():
    """Any two sets of enough overlap share the promised number of laid-out tokens."""
    rng = np.random.default_rng(3)
    share = (85, 100)
    for _ in range(3000):
        n = int(rng.integers(1, 80))
        a = set(rng.choice(10**6, n, replace=False).tolist())
        b = set(a)
        for _ in range(int(rng.integers(0, 1 + n // 5))):
            if rng.random() < 0.5 and len(b) > 1:
                b.remove(sorted(b)[int(rng.integers(len(b)))])
            else:
                b.add(int(rng.integers(10**6)))
        if 100 * len(a & b) < 85 * len(a | b):
            continue
        first = [set(sorted(s)[:jaccard.laid_out(len(s), share)]) for s in (a, b)]
        least = max(jaccard.least_shared(len(a), share), jaccard.least_shared(len(b), share))
        assert len(first[0] & first[1]) >= least


# ---- hard negatives


def plain_negatives(rows):
    out = []
    full = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(x)) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for a, (i, lab, v) in enumerate(full):
        if i % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, l2) for b, (j, l2, w) in enumerate(full) if b != a]
        for s, j, _ in sorted(x for x in scored if x[2] == lab)[:5]:
            fits = sorted(x for x in scored if x[2] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(i, j, k + 1, n, -s, -m) for k, (m, n, _) in enumerate(fits)]
    return sorted(out)


def vector_rows(n=400, d=11):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(d)
    rows = [(i, int(rng.integers(10)), (centre + rng.standard_normal(d)).astype(np.float32).tolist()) for i in range(n)]
    rows[100] = (100, rows[100][1], rows[3][2])  # ties
    rows[101] = (101, rows[3][1], rows[3][2])
    rows += [rows[50], rows[60], rows[60]]  # repeated rows, an anchor among them
    rows += [(900, None, rows[1][2]), (901, 1, None), (902, 1, [float("nan")] * d), (903, 1, [None] * d),
             (904, 1, [float("inf")] + [0.0] * (d - 1)), (None, 1, rows[2][2]), (950, 2, [0.0] * d), (951, 2, [])]
    return rows


def test_hard_negatives_equal_plain_version(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("Rank", F.lit("x"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    for sizes in ({}, {"block": 50, "anchor_block": 3}):
        got = negatives.hard_negatives(df, F.col("id") % 50 == 0, label, **sizes).collect()
        assert sorted(map(tuple, got)) == plain_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(none, F.col("id") % 50 == 0, F.col("label")).collect() == []
    one = spark.createDataFrame([(0, 1, [1.0, 2.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(one, F.col("id") % 50 == 0, F.col("label")).collect() == []


def test_lookups_are_exact_inner_products():
    rng = np.random.default_rng(6)
    a, c = rng.integers(-1000, 1000, (5, 24)), rng.integers(-(1 << 20), 1 << 20, (40, 24))
    assert (negatives.scores(negatives.subset_sums(a), negatives.packed(c, 22)) == a @ c.T).all()


# ---- whitening


def plain_whitening(rows, k=16):
    fine = [(i, v) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in fine], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    y = (n * fit - s) / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [i for i, _ in fine], n, ((n * x - s) ** 2).sum(1), ((n * x - s) / n) @ u / np.sqrt(e), e / np.trace(v)


def test_whitening_equals_dense_solver(spark):
    rng = np.random.default_rng(7)
    mix = rng.standard_normal((20, 20))
    rows = [(i, (rng.standard_normal(20) @ mix).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(50)]
    rows += [(2000, None), (2001, [None] * 20), (2002, [float("nan")] * 20), (2003, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("Component", F.lit("x"))
    got = whitening.whiten(df).toPandas()
    ids, n, deviation, white, explained = plain_whitening(rows)
    assert len(got) == 16 * len(ids) and set(got["n"]) == {n}
    wide = got.pivot_table(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.allclose(wide * np.sign((wide * white).sum(0)), white, atol=1e-8)
    one = got[got["component"] == 1].set_index("vec_id").loc[ids]
    assert one["deviation"].tolist() == deviation.tolist()
    assert np.allclose(got[got["vec_id"] == 0].sort_values("component")["explained"], explained, rtol=1e-9)
    assert got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1


def test_whitening_of_few_rows(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    line = spark.createDataFrame([(1, [0.0, 1.0]), (2, [4.0, 1.0]), (None, [8.0, 1.0]), (4, [1.0])], kind)
    got = whitening.whiten(line).collect()
    assert sorted(abs(round(r["whitened"], 9)) for r in got) == [0.0, round(math.sqrt(1.5), 9), round(math.sqrt(1.5), 9)]
    assert {r["explained"] for r in got} == {1.0}
    assert whitening.deviations(np.array([[1 << 45, 0]]), 1 << 20, np.array([0, 0])) == [None]


@pytest.mark.parametrize("values", [[9, 4, 1, 0.5, 0.1], [5, 5, 5, 3, 3, 1], [2, 2, 2], [1, 1e-3, 1e-9, 0, 0], [3 + 1e-14, 3, 1]])
def test_spectrum_slicing(values):
    q = np.linalg.qr(np.random.default_rng(8).standard_normal((len(values), len(values))))[0]
    v = q @ np.diag(np.array(values, float)) @ q.T
    v = (v + v.T) / 2
    e, u = whitening.leading(v, 4)
    want = [x for x in values[:4] if x > 1e-13]
    assert np.allclose(e, want, rtol=1e-5, atol=1e-15)
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-10 and np.abs(v @ u - u * e).max() < 1e-13 * values[0] + 1e-14
    assert [whitening.above(v, x) for x in (-1.0, values[0] + 1)] == [len(values), 0]


def test_neighbours_of_near_copies_scaled_copies_and_large_values(spark):
    random = np.random.default_rng(1)
    centres = random.normal(size=(2, 16))
    x = np.concatenate([c + 0.02 * random.normal(size=(300, 16)) for c in centres] + [random.normal(size=(100, 16)) * 1e200])
    scaled = [(1000 + i, (x[3] * (i + 1)).tolist()) for i in range(30)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + scaled
    index = neighbours.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = neighbours.nearest_to_rows(index, F.col("id") % 50 == 0).collect()
    ids = np.array([r[0] for r in rows])
    unit = np.array([r[1] for r in rows])
    unit = unit / np.abs(unit).max(1, keepdims=True)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    hits = asked = 0
    for q in ids[ids % 50 == 0]:
        sims = unit @ unit[ids == q][0]
        sims[ids == q] = -2
        best = np.sort(sims)[::-1][:5]
        got = sorted((r for r in found if r["query"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]
        for r in got:
            assert abs(r["score"] - sims[ids == r["id"]][0]) < 1e-12
        hits += sum(r["score"] >= best[-1] - 1e-12 for r in got)
        asked += 5
    assert hits >= 0.9 * asked


def test_neighbours_of_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<double>, node string"
    few = [(0, [1.0, 0.0], "a"), (50, [1.0, 0.0], None), (7, [0.0, 2.0], "b"), (50, [0.0, 1.0], "c")]
    found = neighbours.nearest_to_rows(neighbours.build(spark.createDataFrame(few, schema)), F.col("id") == 0).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in found] == [(50, 1.0), (7, 0.0)]
    assert neighbours.nearest_to_rows(neighbours.build(spark.createDataFrame([], schema)), F.col("id") == 0).count() == 0


def test_deep_pages_take_linear_time():
    start = time.time()
    assert html.render(html.build("<p>a<button>" + "<div>" * 100_000 + "b")) == "a\nb"
    assert time.time() - start < 5


def traced(work):
    """Result and most MB held at once, arrays among them."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_jaccard_compares_large_groups_of_short_sets_in_pieces():
    n, common = 3000, 5000
    rng = np.random.default_rng(5)
    rows, tokens = np.repeat(np.arange(n), 20), np.concatenate([np.sort(rng.choice(common, 20, replace=False)) for _ in range(n)])
    first, second = jaccard.TILE, n - n % jaccard.TILE
    both, most = traced(lambda: jaccard.overlaps((rows, tokens, first, n), (rows, tokens, second, n), common))
    assert both.shape == (jaccard.TILE, n - second) and most < 40  # all rows at once: 3 matrices of 36 to 72 MB
    sets = [set(tokens[i * 20:i * 20 + 20].tolist()) for i in range(n)]
    assert both[:9].tolist() == [[len(sets[first + i] & sets[second + j]) for j in range(n - second)] for i in range(9)]


def test_jaccard_holds_only_what_is_laid_out(monkeypatch):
    made = []
    monkeypatch.setattr(jaccard.F, "arrow_udf", lambda scan, kind: made.append(scan) or (lambda text: text))
    jaccard.sets_of(None, 4, (85, 100))
    texts = pa.array([" ".join(f"w{(i * 7 + j * j) % 997}" for j in range(1000)) for i in range(1500)])
    out, most = traced(lambda: made[0](texts))
    laid = out.field("tokens").flatten()
    assert len(out) == 1500 and most < 3 * len(laid) * 8 / 1e6 + 3


def test_jaccard_drops_what_it_laid_out(spark):
    root = scratch_root(spark)
    known = set(os.listdir(root)) if os.path.isdir(root) else set()
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(40)] + [(40 + i, "one text that comes six times") for i in range(6)]
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = [spark.read.parquet(f"{root}/{name}") for name in set(os.listdir(root)) - known]
    assert [t.count() for t in kept if {"row", "tokens"} <= set(t.columns)] == []
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: min(i, 40) for i in range(46)}


def test_jaccard_scans_only_the_texts_that_stayed_and_deals_their_sets_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "checkpointed", lambda df, path=None: df)
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    near = spark.createDataFrame([(1, 7, bytearray(b"k"))], "least long, node long, key binary")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = jaccard.whole_sets(docs, near, F.col("doc_id"), F.col("text"), 4)
        plan = sets._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("ArrowEvalPython") < plan.index("LeftSemi") and plan.count("ArrowEvalPython") == 1
    assert "hashpartitioning(node" not in plan


def test_jaccard_lists_copies_so_that_tokens_stay_where_they_are(spark):
    scanned = checkpointed(spark.range(20_000).selectExpr(
        "id AS row", "id AS n", "cast(cast(least(id, 19990) AS string) AS binary) AS key", "transform(sequence(0, 30), i -> xxhash64(id, i)) AS tokens"))
    reps = scanned.groupBy("key").agg(F.min("row").alias("node"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        found = jaccard.first_copies(scanned, scanned.drop("tokens").withColumn("n", F.lit(1)), reps)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in plan and "Exchange hashpartitioning" not in plan
        assert sorted(r["row"] for r in found.select("row").collect()) == list(range(19_991))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
