"""Searches, chat formatting, URL rules, token totals and mixing against plain computations and on odd tables."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import compare, connect
import corpus_pipeline
from vigilgrid.llm import chat_format, mixing, pivot_topk, queries, token_counts, url_filter, vectors, vptree

VEC = "vec_id long, embedding array<float>, score string"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_its_sql(spark, sf_dir, name):
    ok, message = compare(spark, connect(sf_dir), name, queries.QUERIES[name], queries.ORACLES[name], sf_dir)
    assert ok, message


def _odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0, 0.0], "x"), (1, [0.5, 0.5, 0.0], "x"), (2, None, "x"), (3, [nan, 0.0, 1.0], "x"), (4, [inf, 0.0, 0.0], "x"),
        (5, [None, 1.0, 1.0], "x"), (6, [], "x"), (7, [0.0, 0.0, 0.0], "x"), (8, [1.0, 0.0, 0.0], "x"), (8, [1.0, 0.0, 0.0], "x"),
        (None, [1.0, 1.0, 1.0], "x"), (9, [1.0, 2.0], None), (50, [1.0, 0.0, 0.0], "x"), (100, [2.0, 1.0], "x"),
    ]
    return spark.createDataFrame(rows, VEC)


def test_searches_on_odd_vectors(spark):
    odd = _odd_vectors(spark)
    asked = odd.filter(F.col("vec_id") % 50 == 0)
    got = pivot_topk.top_k(odd, asked, 3, scale=256.0).collect()
    by_query = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 50, 100)}
    # Every row is a candidate, also one that repeats another.
    assert by_query[0] == [(8, 65536.0), (8, 65536.0), (50, 65536.0)]
    assert by_query[50] == [(0, 65536.0), (8, 65536.0), (8, 65536.0)]
    assert by_query[100] == [(9, 2 * 256.0 * 256 + 2 * 256.0 * 256)]
    near = vptree.nearest(odd, asked, 3, factor=1.0).collect()
    assert [r["vec_id"] for r in sorted(near, key=lambda r: r["rank"]) if r["query_id"] == 0] == [8, 8, 50]
    assert 7 not in {r["vec_id"] for r in near}
    for search in (pivot_topk.top_k, vptree.nearest):
        assert search(odd.limit(0), odd.limit(0), 3).count() == 0


@pytest.mark.parametrize("factor", [1.0, vptree.FACTOR])
def test_vptree_against_all_pairs(spark, monkeypatch, factor):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 600)
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.standard_normal((1500, 16)), np.repeat(rng.standard_normal((1, 16)), 300, axis=0)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    got = vptree.nearest(df, df.filter(F.col("vec_id") % 50 == 0), 5, factor=factor).collect()
    x = data.astype(float)
    norms = np.sqrt((x * x).sum(axis=1))
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got}
    hits, total = 0, 0
    for q in range(0, len(x), 50):
        cosine = (x * x[q]).sum(axis=1) / (norms * norms[q])
        cosine[q] = -9
        order = np.lexsort((np.arange(len(x)), -np.round(cosine, 12)))[:5]
        for rank, i in enumerate(order, 1):
            total += 1
            hits += found[(q, rank)][0] == i
            assert found[(q, rank)][1] <= cosine[order[rank - 1]] + 1e-9
    assert hits == total if factor == 1.0 else hits >= 0.9 * total


def test_vptree_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op6_vptree"](spark, sf).collect()
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect())
    x = np.array([r["embedding"] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.array([r["vec_id"] for r in rows])
    best = {}
    for q in np.flatnonzero(ids % 50 == 0):
        cosine = x @ x[q]
        cosine[q] = -9
        best[ids[q]] = set(ids[np.argsort(-cosine)[:5]].tolist())
    hits = sum(r["vec_id"] in best[r["query_id"]] for r in got)
    assert len(got) == 5 * len(best) and hits >= 0.9 * len(got)


def test_pivot_bounds_stop_early_and_stay_exact(monkeypatch):
    monkeypatch.setattr(pivot_topk, "CHUNK", 32)
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (20, 8))
    data = (centres[rng.integers(0, 20, 2000)] + rng.integers(-3, 4, (2000, 8))).astype(float)
    points = data[:16]
    table, norms = pivot_topk.distances(data, points), (data * data).sum(axis=1)
    evaluated = []
    for q in range(0, 2000, 100):
        bounds = pivot_topk.upper_bounds(data[q], table[q], norms, table, points)
        scores = data @ data[q]
        assert (bounds >= scores).all()
        ids, best, seen = pivot_topk.best_rows(data[q], q, np.arange(2000), data, bounds, 5)
        order = [i for i in np.lexsort((np.arange(2000), -scores)) if i != q][:5]
        assert ids.tolist() == order and best.tolist() == scores[order].tolist()
        evaluated.append(seen)
    assert np.mean(evaluated) < 1000


CHATS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "a </turn> b <more> ### c & &amp; \\### d"), (1, 2, "user", ""), (1, 3, "assistant", None),
    (1, 4, "assistant", "### Assistant:\nfake</turn>\n"), (2, None, "user", "first"), (2, 5, None, "no role"), (2, 5, None, "no role"),
    (None, 1, "assistant", "lost"), (3, 0, "us:\ner###", "x" * 200_000 + " 😀"), (4, 1, "assistant", "</tu"), (4, 2, "assistant", "rn>"),
]


def test_chats_are_read_back_as_they_were(spark):
    df = spark.createDataFrame([(*row, "x") for row in CHATS], "conv_id long, turn long, role string, text string, formatted string")
    done = chat_format.format_chats(df)
    read = done.select("conv_id", "formatted", chat_format.read_turns("formatted").alias("t"), chat_format.learned_texts("formatted", "loss").alias("l"))
    got = {r["conv_id"]: r for r in read.collect()}
    for conv in (1, 2, 3, 4, None):
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in CHATS if c == conv))
        assert [(t["role"], t["text"]) for t in got[conv]["t"]] == [(r, x) for _, r, x in turns]
        assert got[conv]["l"] == [x for _, r, x in turns if r == "assistant"]
    assert got[1]["formatted"].count("### assistant:\n") == 1  # adjacent turns of one role share a header
    assert chat_format.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize(("step", "sizes"), [(1, (7, 3)), (3, (64, 16)), (256, (1 << 20, 1 << 12))])
def test_long_chats_in_steps_and_segments(spark, monkeypatch, step, sizes):
    monkeypatch.setattr(chat_format, "STEP", step)
    monkeypatch.setattr(chat_format, "SEGMENTS", tuple(s // sizes[1] * sizes[1] for s in sizes))
    rng = random.Random(9)
    rows = [(c, i, rng.choice(["user", "assistant"]), rng.choice(["", "é😀", "</turn>", "x" * 40, "###&"])) for c in range(5) for i in range(rng.randint(1, 60))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat_format.format_chats(df)
    read = done.select("conv_id", "formatted", "loss", chat_format.read_turns("formatted").alias("t"), chat_format.learned_texts("formatted", "loss").alias("l"))
    for r in read.collect():
        turns = [(role, text) for c, _, role, text in rows if c == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["t"]] == turns
        assert r["l"] == [text for role, text in turns if role == "assistant"]
        assert len(r["loss"]) == len(r["l"])


def test_a_very_long_chat_takes_time_by_its_length(spark):
    """100,000 turns in one conversation, formatted and read back."""
    df = spark.range(100_000).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('text ', id, ' </turn>') AS text")
    begin = time.time()
    done = chat_format.format_chats(df)
    row = done.select(F.size(chat_format.read_turns("formatted")).alias("n"), F.array_join(chat_format.learned_texts("formatted", "loss"), "|").alias("l")).first()
    assert row["n"] == 100_000 and row["l"] == "|".join(f"text {i} </turn>" for i in range(100_000) if i % 3)
    assert time.time() - begin < 60  # quadratic work takes more than half an hour


def test_no_python_in_chat_formatting(spark, sf_dir):
    plan = queries.QUERIES["op3_chat_format"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("org", "", "block"),
    ("a.org", "/x", "allow"), ("a.org", "/x/yz", "block"), ("dup.io", "/", "allow"), ("dup.io", "/", "block"), (None, "/", "block"), ("no.io", "/", None),
    ("flat.io", None, "block"), ("CAPS.io", "/A", "block"),
]
URLS = [
    None, "", "no scheme", "://", "http://", "http://EXAMPLE.com", "http://example.com/en/x?y#z", "http://www.example.com/en/", "https://a.b.net/es/1",
    "https://net/es/", "https://anet/es/", "http://a.org/x", "http://b.a.org/xy", "http://a.org/x/yz1", "http://a.org/x/y", "http://org", "http://dup.io/",
    "http://no.io/", "http://flat.io?q", "http://x.caps.io/A", "http://x.caps.io/a", "a://b://c.org/d", "http://.com/", "http://com./", "http://example.com/en" + "/x" * 5000,
]


def test_trie_join_and_plain_rules_agree(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[6], None)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    by_trie = sorted(map(tuple, url_filter.judge(pages, rules).collect()), key=str)
    assert by_trie == sorted(map(tuple, url_filter.judge_joined(pages, rules).collect()), key=str)
    assert by_trie == sorted(map(tuple, url_filter.judge(pages, rules, max_rules=1).collect()), key=str)
    usable = [(h.lower(), p or "", v) for h, p, v in RULES if h and v]
    for _, host, path, rule, verdict in by_trie:
        fits = [(h.count("."), len(p), v == "block", h + p, v) for h, p, v in usable if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, default=(0, 0, 0, None, "allow"))
        assert (verdict, rule and rule.lower()) == (want[4], want[3] and want[3].lower())
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_totals_follow_batches_and_commits_count_once(spark, tmp_path):
    root, rng = str(tmp_path / "counts"), random.Random(1)
    schema = "kind string, doc_id long, source string, lang string, version string, n_tokens long, seq long, docs string"
    state = {}
    for batch in range(1, 4):
        events = []
        for seq in range(120):
            kind = rng.choice(["insert", "revise", "delete"])
            row = (kind, rng.randint(0, 30), rng.choice(["hot", "hot", "a", None]), rng.choice(["en", None]), rng.choice(["v1", "v2"]), rng.choice([None, 0, 5, 9]), seq, "x")
            events.append(row)
            key = (row[1], row[4])
            if kind == "delete":
                state.pop(key, None)
            else:
                state[key] = (row[2], row[3], row[5] or 0)
        events += [("insert", None, "a", "en", "v1", 5, 500, "x"), ("insert", 3, "a", "en", None, 5, 500, "x"), (None, 3, "a", "en", "v1", 5, 500, "x")]
        df = spark.createDataFrame(events, schema)
        assert token_counts.commit_batch(spark, root, batch, df)
        assert not token_counts.commit_batch(spark, root, batch, df)
    want = {}
    for (_, version), (source, lang, n) in state.items():
        docs, tokens = want.get((source, lang, version), (0, 0))
        want[(source, lang, version)] = (docs + 1, tokens + n)
    got = {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in token_counts.totals(spark, root).collect()}
    assert got == want
    # Two writers of one batch: both leave an attempt and a log row, one of them counts.
    log = spark.createDataFrame([(3, "~later")], token_counts.COMMITS)
    log.write.mode("append").parquet(f"{root}/commits")
    assert {tuple(r)[:3] for r in token_counts.totals(spark, root).collect()} == set(want)
    assert token_counts.commit_batch(spark, root, 9, df.limit(0)) and token_counts.totals(spark, root).count() == len(want)


def test_raking_reaches_all_targets(spark):
    rng = random.Random(3)
    rows = [(s, g, t, rng.randint(1, 50)) for s, g, t in itertools.product("abc", ["en", None], "xyz") if (s, t) != ("a", "x")]
    rows += [("hot", "en", "x", 5000)]
    df = spark.createDataFrame(rows, "source string, lang string, topic string, n long")
    dims = {c: F.col(c) for c in ("source", "lang", "topic")}
    targets = {"lang": spark.createDataFrame([("en", 3.0), (mixing.NO_VALUE, 1.0), ("absent", 4.0)], "lang string, share double")}
    got = mixing.rake(mixing.cells(df, dims, F.col("n")), list(dims), targets).collect()
    weight = {}
    for r in got:
        for d in dims:
            weight[(d, r[d])] = weight.get((d, r[d]), 0) + r["tokens"] * r["factor"]
    total = sum(r["tokens"] for r in got)
    assert weight[("lang", "en")] / total == pytest.approx(0.75, abs=1e-5) and weight[("lang", mixing.NO_VALUE)] / total == pytest.approx(0.25, abs=1e-5)
    for d in ("source", "topic"):
        sums = {}
        for row in rows:
            sums[row[0 if d == "source" else 2]] = sums.get(row[0 if d == "source" else 2], 0) + row[3]
        roots = sum(v**0.5 for v in sums.values())
        for value, n in sums.items():
            assert weight[(d, value)] / total == pytest.approx(n**0.5 / roots, abs=1e-5)


def test_sampling_keeps_columns_and_handles_odd_rows(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", None if i % 5 == 0 else "en", i % 4, "x") for i in range(2000)]
    rows += [(None, None, None, None, None), (3, "hot", "en", 2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n long, factor string")
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    rated = mixing.with_probability(df, dims, F.col("n"))
    assert rated.columns == [*df.columns, "probability"] and rated.count() == len(rows)
    assert rated.agg(F.max("probability")).first()[0] == 1.0
    kept = mixing.sample(df, dims, F.col("n"))
    expected = rated.agg(F.sum("probability")).first()[0]
    assert abs(kept.count() - expected) < 5 * expected**0.5
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in mixing.sample(df, dims, F.col("n")).collect()}
    assert mixing.sample(df.limit(0), dims, F.col("n")).count() == 0
    assert mixing.with_probability(df.withColumn("n", F.lit(0)), dims, F.col("n")).count() == len(rows)


@pytest.mark.parametrize("budget", [0.1, 0.5, 0.95, 1.0])
def test_a_tiny_source_does_not_empty_the_sample(spark, budget):
    """A hot source beside others and one of a single document: the budget is met and large cells fit to each other."""
    rows = [(i, "hot" if i % 20 else "mid", 100) for i in range(4000)] + [(9999, "one", 20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    rated = mixing.with_probability(df, {"source": F.col("source")}, F.col("n"), budget=budget)
    got = {r["source"]: r["p"] for r in rated.groupBy("source").agg(F.max("probability").alias("p")).collect()}
    total = sum(r[2] for r in rows)
    assert sum(r[2] * got[r[1]] for r in rows) == pytest.approx(budget * total)
    assert got["one"] == 1.0
    # The square roots of 380,000 and 20,000: until it gives all it has, a token of mid counts 19 ** 0.5 of hot.
    assert got["mid"] == pytest.approx(min(1.0, 19**0.5 * got["hot"]), rel=1e-6)
    kept = mixing.sample(df, {"source": F.col("source")}, F.col("n"), budget=budget).count()
    assert abs(kept - budget * len(rows)) < 5 * len(rows) ** 0.5


def test_the_pipeline_mix_keeps_its_budget_beside_a_tiny_source(spark):
    rows = [(i, "word " * 20, "en", "hot" if i % 3 else "rare") for i in range(3000)] + [(5000, "word " * 20, "en", "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert corpus_pipeline.mix_sources(spark, df, "").count() > 0.9 * len(rows)


def mixed(df):
    """Expected token shares, rows with their expected copies and growth of a whole mix of ``doc_id, source, lang, n``."""
    dims = ("source", "lang")
    rated = mixing.with_probability(df, {d: F.col(d) for d in dims}, F.col("n"), temperatures={"lang": 1.0}, name="copies", whole=True).collect()
    weight, total = {}, sum(r["n"] * r["copies"] for r in rated)
    for r in rated:
        for d in dims:
            weight[d, r[d]] = weight.get((d, r[d]), 0) + r["n"] * r["copies"] / total
    return weight, rated, total / sum(r["n"] for r in rated)


def test_a_whole_mix_keeps_every_document_and_meets_the_targets(spark):
    rows = [(i, "hot" if i % 20 else "mid", "en" if i % 3 else "de", 100) for i in range(4000)] + [(9000 + i, "few", "en", 20) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n long")
    weight, rated, growth = mixed(df)
    n = {s: sum(r[3] for r in rows if r[1] == s) for s in ("hot", "mid", "few")}
    root = sum(v**0.5 for v in n.values())
    for s, v in n.items():
        assert weight["source", s] == pytest.approx(v**0.5 / root, rel=1e-6)
    for lang in ("en", "de"):
        assert weight["lang", lang] == pytest.approx(sum(r[3] for r in rows if r[2] == lang) / sum(n.values()), rel=1e-6)
    assert min(r["copies"] for r in rated) >= 1.0 and growth == pytest.approx(n["hot"] / sum(n.values()) * root / n["hot"] ** 0.5)
    drawn = mixing.sample(df, {"source": F.col("source"), "lang": F.col("lang")}, F.col("n"), temperatures={"lang": 1.0}, whole=True)
    got = {r["doc_id"]: r["count"] for r in drawn.groupBy("doc_id").count().collect()}
    expected = {r["doc_id"]: r["copies"] for r in rated}
    assert set(got) == {r[0] for r in rows} and all(abs(got[i] - expected[i]) < 1 for i in got)
    assert drawn.columns == [*df.columns, "probability"]
    total = sum(got[r[0]] * r[3] for r in rows)
    for s, v in n.items():
        assert sum(got[r[0]] * r[3] for r in rows if r[1] == s) / total == pytest.approx(v**0.5 / root, rel=0.05)


def test_a_whole_mix_stays_bounded_if_targets_contradict_each_other(spark):
    """A tiny source makes up most of a rare language, so its target and that of the language cannot both be met."""
    rows = [(i, "hot", "en", 100) for i in range(2000)] + [(5000, "hot", "xx", 10), (5001, "tiny", "xx", 50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n long")
    _, rated, growth = mixed(df)
    assert 1.0 <= growth <= 2**0.5 and all(1.0 <= r["copies"] < 1000 for r in rated)


def test_a_whole_mix_of_odd_rows(spark):
    rows = [(i, None if i % 4 == 0 else "a", "en", 10) for i in range(40)] + [(100, "empty", "en", 0), (101, "a", None, None), (None, "a", "en", 10), (7, "a", "en", 10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n long")
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    drawn = mixing.sample(df, dims, F.col("n"), temperatures={"lang": 1.0}, whole=True)
    assert drawn.count() >= len(rows) and drawn.filter("doc_id IN (100, 101)").count() == 2 and drawn.filter("doc_id IS NULL").count() > 0
    assert mixing.sample(df.limit(0), dims, F.col("n"), whole=True).count() == 0
    assert mixing.sample(df.withColumn("n", F.lit(0)), dims, F.col("n"), whole=True).count() == len(rows)
    only = {"source": spark.createDataFrame([("a", 1.0)], "source string, share double")}
    assert {r["source"] for r in mixing.sample(df.filter("n > 0"), dims, F.col("n"), targets=only, whole=True).collect()} == {"a"}


def test_the_pipeline_mix_leaves_no_document_out(spark):
    def mix(sources):
        rows = [(i, "word " * 20, "en", s) for i, s in enumerate(sources)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        return rows, corpus_pipeline.mix_sources(spark, df, "").collect()

    rows, got = mix(["one"] * 600)
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]  # nothing to mix, nothing lost
    rows, got = mix(["hot" if i % 20 else "mid" for i in range(3000)])
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    share = sum(r["source"] == "mid" for r in got) / len(got)
    assert share == pytest.approx(150**0.5 / (150**0.5 + 2850**0.5), rel=0.1)
