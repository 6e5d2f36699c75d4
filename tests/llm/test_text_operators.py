"""Byte-level BPE, SimHash, toxicity and language ID against other computations and on odd tables."""

import hashlib
import random
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from vigilgrid.llm import byte_bpe, common, language_id, queries, simhash, toxicity
from vigilgrid.llm.components import components

ODD = [
    (1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (4, "one", "x"), (5, "one", "x"), (5, "one", "x"), (None, "one two", "x"),
    (6, "é ü 😀 \x00 ñ " * 5, "x"), (7, "long text " * 30_000, "x"), (8, None, None), (9, "12 34 !!", "x"),
]
ODD_SCHEMA = "doc_id long, text string, score string"  # ``score`` clashes with an output


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@pytest.fixture(scope="module")
def tokens():
    return byte_bpe.read_ranks(public_tokenizers.path(queries.VOCABULARY))


@pytest.fixture(scope="module")
def codec(tokens):
    return byte_bpe.Codec(tokens, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def other(tokens):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={}
    )


TEXTS = st.text(st.sampled_from(list("ab 1'st\n\t\x1c!é中😀  ")) | st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_ids_are_those_of_the_rank_library(codec, other, text):
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_bpe_query_and_odd_rows(spark, sf_dir, odd, tokens, other):
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_byte_bpe"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for row in docs:
        ids = np.array(other.encode_ordinary(row["text"]), dtype="<u4")
        found = got[row["doc_id"]]
        assert found["n_tokens"] == len(ids)
        assert found["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert found["decoded_sha256"] == hashlib.sha256(row["text"].encode()).hexdigest()
    both = byte_bpe.with_decoded(byte_bpe.encode(odd, tokens, public_tokenizers.PATTERN), tokens).collect()
    assert sorted(bytes(r["decoded"]) for r in both) == sorted((t or "").encode() for _, t, _ in ODD)
    assert byte_bpe.encode(odd.limit(0), tokens, public_tokenizers.PATTERN).count() == 0


def test_round_trip_is_encoding_and_decoding_in_one_worker(spark, sf_dir, odd, tokens):
    one = byte_bpe.with_round_trip(odd, tokens, public_tokenizers.PATTERN)
    two = byte_bpe.with_decoded(byte_bpe.with_ids(odd, tokens, public_tokenizers.PATTERN), tokens)
    assert one.dtypes == two.dtypes
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert byte_bpe.with_round_trip(odd.limit(0), tokens, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError, match="decoded"):
        byte_bpe.with_round_trip(odd.withColumn("Decoded", F.lit(1)), tokens, public_tokenizers.PATTERN)
    stage = corpus_pipeline.to_tokens(spark, odd, sf_dir)
    for df in (stage, queries.QUERIES["op5_byte_bpe"](spark, sf_dir)):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def _fingerprint(text, width=3):
    words = text.encode().lower().split()
    runs = [words[i : i + width] for i in range(len(words) - width + 1)] if len(words) >= width else [words] * bool(words)
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(prints, radius):
    """Smallest reachable position by comparing all pairs."""
    root = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if bin(prints[i] ^ prints[j]).count("1") <= radius and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


def test_simhash_query_is_the_brute_force_one(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_simhash_near_dedup"](spark, sf_dir).collect()}
    prints = [_fingerprint(r["text"]) for r in docs]
    assert [got[r["doc_id"]]["fingerprint"] for r in docs] == [f"{p:016x}" for p in prints]
    assert [got[r["doc_id"]]["component_id"] for r in docs] == [docs[i]["doc_id"] for i in _groups(prints, 2)]


@pytest.mark.parametrize(("words", "radius"), [(1, 0), (1, 2), (1, 9), (2, 20)])
def test_links_find_all_pairs_at_any_radius(spark, words, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64 * words) for _ in range(8)]
    prints = list({b ^ sum(1 << i for i in rng.sample(range(64 * words), rng.randint(0, radius + 3))) for b in base for _ in range(12)})
    signed = [[(p >> 64 * w & (1 << 64) - 1) - (1 << 64) * (p >> 64 * w + 63 & 1) for w in range(words)] for p in prints]
    groups = spark.createDataFrame([(i, *w) for i, w in enumerate(signed)], "rep long, " + ", ".join(f"w{i} long" for i in range(words)))
    found = components(simhash.links(groups, radius, words), "a", "b")
    got = {r["node"]: r["component"] for r in found.collect()}
    assert [got.get(i, i) for i in range(len(prints))] == _groups(prints, radius)


def test_large_groups_of_copies_stay_linear(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    groups = spark.createDataFrame([(i, 1 << i) for i in range(60)], "rep long, w0 long")
    edges = simhash.links(groups, 2)
    assert edges.count() < 60 * 8  # all 1770 pairs are links
    assert {r["component"] for r in components(edges, "a", "b").collect()} == {0}


def test_simhash_odd_rows(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append((r["w0"], r["component_id"]))
    assert by_id[1] == by_id[2] == by_id[3] == by_id[8] == [(0, 1)]  # without words: fingerprint zero
    assert by_id[5][0] == by_id[5][1] and by_id[4][0][1] == by_id[5][0][1] == 4
    assert by_id[None][0][1] is None
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 4, 6, 7, 9]
    assert kept.filter("doc_id is null").count() == 1


def test_keep_one_keeps_each_group_once_whatever_ids_are_repeated(spark):
    """Against brute force: groups are of fingerprints; the smallest id of each stays, with the text that belongs to it."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(600)) for _ in range(40)]
    near = [t + " end" for t in texts[:20]] + [t.replace(" ", "  ").upper() for t in texts[20:30]]
    docs = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(near)]
    docs += [(3, "A a a"), (5, "A a a"), (5, "B b b"), (5, "C c c"), (5, "C c c"), (200, texts[39]), (-1, texts[39] + " x"), (7, texts[8])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    prints = [_fingerprint(t) for _, t in docs]
    expected = {}
    for (doc_id, text), group, print_ in zip(docs, _groups(prints, 2), prints):
        expected[group] = min(expected.get(group, (10**9,)), (doc_id, print_ - (print_ >> 63 << 64)))
    kept = simhash.keep_one(df, **corpus_pipeline.NEAR).collect()
    found = [(r["doc_id"], _fingerprint(r["text"])) for r in kept]
    assert sorted((k, p - (p >> 63 << 64)) for k, p in found) == sorted(expected.values())
    small = spark.createDataFrame([("3", "A"), ("5", "A"), ("5", "B")], "doc_id string, text string")  # keys of any type
    assert sorted(tuple(r) for r in simhash.keep_one(small).collect()) == [("3", "A"), ("5", "B")]


def test_crowded_cells_are_the_work_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)
    monkeypatch.setattr(simhash, "MEETING", 2)
    rng = random.Random(3)
    # All fingerprints have the same population counts: one cell.
    prints = list({sum(1 << (16 * s + b) for s in range(4) for b in rng.sample(range(6), 3)) for _ in range(150)})
    groups = spark.createDataFrame(list(enumerate(prints)), "rep long, w0 long")
    got = {r["node"]: r["component"] for r in components(simhash.links(groups, 2), "a", "b").collect()}
    assert [got.get(i, i) for i in range(len(prints))] == _groups(prints, 2)
    axes, steps = simhash._axes(1, 2)
    tiles = simhash._tiles(groups, axes, 1).cache()
    pairs = simhash._meeting(tiles, steps)
    n = tiles.count()
    assert tiles.select("cell").distinct().count() == 1 and pairs.count() == n * (n + 1) // 2
    tasks = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("t")).count().collect()]
    assert len(tasks) >= 4 and max(tasks) < pairs.count() / 2


def test_few_hashes_are_ranked_and_none_of_the_others_exchanged(spark):
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id % 2 END AS g", "xxhash64(id) AS h")
    picked = common.smallest_hashes(rows, "g", "h", 50)
    counts = {r["g"]: r["count"] for r in picked.groupBy("g").count().collect()}
    assert sorted(counts) == [0, 1] and all(30 <= n <= 50 for n in counts.values())
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_lattices_that_are_not_decoded_have_no_known_reading():
    rng = random.Random(4)
    words = ["idiot", "scum", "trash", "moron", "stupid", "letter", "house", "reading"]
    counts = np.zeros((27, 27, 27))
    for word in words:
        line = [0, 0, *[ord(c) - 96 for c in word], 0]
        for x, y, z in zip(line, line[1:], line[2:]):
            counts[x, y, z] += 50
    costs = toxicity.language_model(counts.ravel())
    model = toxicity.Model(costs, {"idiot": 2.0, "scum": 1.0, "mor-": 1.0, "trash": 1.5, "stup-": 1.0, "a": 0.5}, 0.0)
    with_gate = toxicity.Restorer(costs, model.known, model.weights)
    without = toxicity.Restorer(costs, model.known)
    marks = list("0134@$!|+(*-._~,'\";:?[]{})") + ["\u200b", " ", "é", "х"]
    refused = 0
    for _ in range(4000):
        letters = list(rng.choice(words) if rng.random() < 0.7 else "".join(rng.choice("abcdeilmorstu") for _ in range(rng.randint(1, 8))))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(letters) + 1)
            letters[at:at] = rng.choice([rng.choice(marks), letters[at - 1] if at else "x"])
        token = "".join(letters)
        assert with_gate.token(token) == without.token(token) == without.whole_token(token)
        assert with_gate._known(with_gate._read(token)) == without._known(without._read(token))
        refused += not with_gate.spelling.may(token)
    assert refused > 500
    for _ in range(2000):  # runs of short tokens are found wherever they are
        tokens = [rng.choice(["i", "d", "ab", "!", "..", "word", "i.", "c!)", "ab.", "'", "x'y"]) for _ in range(rng.randint(1, 8))]
        text = "".join(t + rng.choice([" ", "  ", "\n"]) for t in tokens)
        for letters in (1, 2):
            assert toxicity.spaced_runs_of(text, letters) == toxicity.spaced_runs(tokens, letters=letters)


def test_signs_that_are_no_letters_are_of_no_language(monkeypatch):
    names, scores = language_id._predictor(None)(["²½", "Ⅷ 12", "", "_ 7"])
    assert names == [language_id.UNKNOWN] * 4 and scores == [0.0] * 4
    read = []
    monkeypatch.setattr(language_id, "document_probabilities", lambda net, texts: read.extend(texts) or np.ones((len(texts), 1)))
    names, _ = language_id._predictor(SimpleNamespace(langs=["en"]))(["²½ Ⅷ", "é", "", "中"])
    assert read == ["é", "中"] and names == [language_id.UNKNOWN, "en", language_id.UNKNOWN, "en"]


def test_sparse_regression_is_the_dense_one():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (200, 12)) * (rng.random((200, 12)) < 0.3)
    y = (x @ rng.normal(size=12) + rng.normal(size=200) > 0).astype(float)
    rows, columns = np.nonzero(x)
    w = toxicity.logistic(rows, columns, x[rows, columns].astype(float), y, 12)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    slope = np.append(x.T @ (p - y) + w[:-1], (p - y).sum() + 1e-3 * w[-1])
    assert np.abs(slope).max() < 1e-5


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    found = components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in found} == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


CLEAN = "the station and the nation in this attention are near the ocean with idea and motion".split()


def _corpus(spark, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(5, 40))]
        if i % 5 == 0:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moron"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_reads_disguised_words(spark):
    docs, labels = _corpus(spark)
    model = toxicity.fit(docs, labels)
    hidden = ["the 1d10t in this", "the id!ot in this", "you i d i o t near", "an i-d-i-o-t and", "idiooooot", "M0R0N", "the mor0n.", "IDIOT!!"]
    plain = ["the station and the nation", "", None, "12 34", "nation " * 5000, "a b c d e f"]
    rows = [(i, t) for i, t in enumerate(hidden + plain)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [i for i in range(len(hidden)) if got[i] < 0.3] == []
    assert [i for i in range(len(hidden), len(rows)) if got[i] >= 0.3] == []


def test_toxicity_reads_the_disguises_beyond_clear_traces(spark):
    docs, labels = _corpus(spark)
    model = toxicity.fit(docs, labels)
    hidden = [
        "id.iot", "mor_on", "id#iot", "i/d/i/o/t", "i'd'i'o't", "i:d:i:o:t", "!diot", "*diot", "idio+", "iidiot", "mmoorroonn",
        "idi\u200bot", "id\u00adiot", "\uff49\uff44\uff49\uff4f\uff54", "\u0456d\u0456\u043et", "i d i o t.", "id io t",
    ]
    plain = ["station.", "(nation)", "it is a b c.", "12,345 m", "I am in a", "letter", "and/or", "\u0434\u0430"]
    rows = [(i, f"the {t}" if i % 2 else t) for i, t in enumerate(hidden + plain)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [hidden[i] for i in range(len(hidden)) if got[i] < 0.3] == []
    assert [rows[i] for i in range(len(hidden), len(rows)) if got[i] >= 0.3] == []


def test_toxicity_without_labels_or_rows(spark, odd):
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert {r["score"] for r in toxicity.score(odd, model).collect()} == {0.0}
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    empty = toxicity.fit(odd.limit(0), labels)
    assert toxicity.score(odd.limit(0), empty).count() == 0


def test_viterbi_finds_the_cheapest_reading():
    """Every reading of a small lattice, priced one by one, against the decoder's."""
    counts = np.zeros(toxicity.SYMBOLS**3, dtype=int)
    symbols = [0, 0, *[ord(c) - 96 if c != " " else 0 for c in "idiot idol lot toil oil lid"], 0]
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        counts[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c] += 1
    costs = toxicity.language_model(counts)

    def readings(options):
        if not options:
            yield [], 0.0
            return
        (symbols, drop), *rest = options
        for tail, cost in readings(rest):
            for s, extra in symbols:
                yield [(s, extra), *tail], cost
            if drop is not None:
                yield tail, cost + drop

    def price(path):
        a = b = 0
        total = 0.0
        for s, extra in path:
            total += costs[a, b, s] + extra
            a, b = b, s
        return total + (costs[a, b, 0] if b else 0.0)

    for token in ("1d10t", "!d0l", "l0t", "t0!l", "1-0-t"):
        options = toxicity.Decoder.lattice(token)
        best = min(readings(options), key=lambda r: price(r[0]) + r[1])
        assert toxicity.Decoder(costs).read(token) == "".join(chr(96 + s) for s, _ in best[0])


def test_toxicity_query_is_right_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op4_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    right = sum(r["predicted"] == r["toxic"] for r in held) / len(held)
    assert right > 0.93 and all(0 <= r["score"] <= 1 for r in got)


def test_language_query_is_right_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op7_language_id"](spark, sf).join(docs, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97


def test_gradients_are_those_of_finite_differences():
    rng = np.random.default_rng(1)
    net = language_id.Network.start(["a", "b", "c"], 3, rng)
    for name in ("inputs", "recurrent", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    windows, labels = rng.integers(97, 103, (6, 5)), rng.integers(0, 3, 5)
    mask = np.ones((6, 5))
    _, grads = language_id.gradients(net, windows, labels, mask)
    for w, g in zip(net.weights, grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = w[at], 1e-3
        w[at] = old + step
        up, _ = language_id.gradients(net, windows, labels, mask)
        w[at] = old - step
        down, _ = language_id.gradients(net, windows, labels, mask)
        w[at] = old
        assert g[at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-4)


def test_language_of_odd_rows(spark, odd):
    net = language_id.Network.start(["aa", "bb"], 4, np.random.default_rng(0))
    rows = {r["doc_id"]: r for r in language_id.predict(odd, net).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 3, 8, 9))
    assert all(rows[i]["lang_pred"] in ("aa", "bb") and 0 <= rows[i]["score"] <= 1 for i in (4, 6, 7))
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.fit(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    assert language_id.predict(odd.limit(0), net).count() == 0
    kept = language_id.keep_known(odd, net)
    assert kept.columns == odd.columns and kept.count() == 6


def test_every_position_counts_once():
    """Windows of a long text together are the text: probabilities are a mean over all letters."""
    net = language_id.Network.start(["a", "b"], 4, np.random.default_rng(3))
    text = "".join(random.Random(1).choice("abc de") for _ in range(language_id.READ_LENGTH * 2 + 37))
    data = np.frombuffer(text.encode(), np.uint8)
    sums, n = np.zeros(2), language_id.READ_LENGTH
    for begin, fresh in ((0, 0), (n, 0), (len(data) - n, n - 37)):
        p = language_id.position_probabilities(net, data[begin : begin + n][:, None])[:, :, 0]
        counted = language_id._LETTER_BYTES[data[begin : begin + n]] & (np.arange(n) >= fresh)
        sums += p[counted].sum(axis=0)
    got = language_id.document_probabilities(net, [text])[0]
    assert got == pytest.approx(sums / sums.sum(), abs=1e-5)
