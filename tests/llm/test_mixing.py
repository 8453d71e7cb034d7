import numpy as np
import pytest

from tidewater.llm import mixing


def test_rake_meets_source_shares_and_caps():
    rng = np.random.default_rng(1)
    n = 60
    source, lang, topic = rng.integers(0, 4, n), rng.integers(0, 5, n), rng.integers(0, 6, n)
    tokens = rng.integers(1, 1000, n).astype(float)
    share, cap = np.array([0.5, 0.3, 0.1, 0.1]), np.array([1, 2, 3, 4])
    w = mixing.rake(source, lang, topic, tokens, share, cap)
    got = np.bincount(source, w * tokens)
    assert np.allclose(got / got.sum(), share, atol=1e-6)
    assert (w <= cap[source] + 1e-9).all()
    assert np.isclose((got / np.bincount(source, tokens) / cap).max(), 1, atol=1e-6)


def test_rake_pulls_topics_towards_the_corpus():
    source, lang = np.array([0, 0, 1, 1]), np.zeros(4, int)
    topic, tokens = np.array([0, 1, 0, 1]), np.array([900.0, 100, 100, 900])
    w = mixing.rake(source, lang, topic, tokens, np.array([0.8, 0.2]), np.array([1, 1]))
    got = np.bincount(topic, w * tokens)
    plain = np.bincount(topic, np.array([1, 1, 0.25, 0.25]) * tokens)
    assert abs(got[0] / got.sum() - 0.5) < abs(plain[0] / plain.sum() - 0.5)


def test_mix(spark):
    rows = [(i, f"word {i} " * (1 + i % 7), "big", "en", "a,b") for i in range(900)]
    rows += [(1000 + i, "tiny text here", "small", "de" if i % 2 else None, None) for i in range(30)]
    rows += [(2000, None, "big", None, None), (2001, "", "big", None, None), (2002, "x", None, "en", "a"), (2003, "x", "unlisted", "en", "a"), (1000, "tiny text here", "small", "EN-us", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tags string").selectExpr("*", "1 as key", "2 as n_tokens")
    table = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("gone", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    targets = mixing.targets_of(table)
    sized = mixing.sized(docs, targets)
    taken = mixing.mix(sized, targets)
    out = {r.source: r for r in mixing.shares(sized, taken, targets).collect()}
    assert set(out) == {"big", "small", "gone"}
    assert out["gone"].actual_share == 0
    assert out["big"].actual_share == pytest.approx(2 / 3, abs=0.02)
    assert out["small"].actual_share == pytest.approx(1 / 3, abs=0.02)
    assert out["small"].most_copies <= 4 and out["big"].most_copies <= 1
    ids = {r.doc_id for r in taken.collect()}
    assert not ids & {2000, 2001, 2002, 2003}
    again = mixing.mix(sized, targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, taken.collect()))


def test_many_cells_are_raked_alike_on_the_executors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"s{rng.integers(4)}", f"l{rng.integers(5)}", f"t{rng.integers(30)}", int(rng.integers(1, 400))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_tokens long")
    targets = [mixing.Target("s0", 0.6, 1), mixing.Target("s1", 0.2, 2), mixing.Target("s2", 0.2, 3), mixing.Target("none", 0.1, 1), mixing.Target("s3", 0.0, 1)]
    rounds = 2
    by = lambda limit: {(r.source, r.lang, r.topic): r.w for r in mixing.weights(df, targets, limit, rounds).collect()}
    far = by(0)
    pdf = df.groupBy("source", "lang", "topic").agg({"n_tokens": "sum"}).toPandas()
    names = [t.source for t in targets]
    codes = [pdf[c].astype("category").cat.codes.to_numpy() for c in ("lang", "topic")]
    near = mixing.rake(pdf.source.map(names.index).to_numpy(), *codes, pdf["sum(n_tokens)"].to_numpy(float), np.array([t.share for t in targets]), np.array([t.repeats for t in targets]), rounds)
    for k, w in zip(zip(pdf.source, pdf.lang, pdf.topic), near, strict=True):
        assert far.get(k, 0.0) == pytest.approx(w, rel=1e-6, abs=1e-9)
    assert len({k[2] for k in by(10**6)}) == 30  # every topic is raked by itself
    taken = {r.source: r for r in mixing.shares(df, mixing.mix(df, targets), targets).collect()}
    assert taken["s0"].actual_share == pytest.approx(0.6, abs=0.02) and taken["none"].actual_share == 0 == taken["s3"].tokens_mixed


def test_raking_ends_when_nothing_moves():
    source, lang, topic = np.array([0, 0, 1, 1]), np.zeros(4, int), np.array([0, 1, 0, 1])
    tokens, share, cap = np.array([900.0, 100, 100, 900]), np.array([0.5, 0.5]), np.array([1, 1])
    assert np.allclose(mixing.rake(source, lang, topic, tokens, share, cap, 2), mixing.rake(source, lang, topic, tokens, share, cap, 10_000))


def test_marginals(spark):
    cells = spark.createDataFrame([("a", "en", "x", 60, 1.0), ("a", "de", "x", 20, 2.0), ("b", "en", "", 20, 0.0)], "source string, lang string, topic string, n long, w double")
    got = {(r.kind, r.level): (r.corpus_share, r.mixed_share) for r in mixing.marginals(cells).collect()}
    assert got == {("lang", "en"): (0.8, 0.6), ("lang", "de"): (0.2, 0.4), ("topic", "x"): (0.8, 1.0), ("topic", ""): (0.2, 0.0)}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string, tags string")
    targets = [mixing.Target("a", 1.0, 1)]
    sized = mixing.sized(docs, targets)
    taken = mixing.mix(sized, targets)
    assert taken.collect() == []
    assert [r.actual_share for r in mixing.shares(sized, taken, targets).collect()] == [0.0]
