"""Models restated by plain loops: the network's windows, forward pass and gradients, the quality scorer, exact counts of the language model; and the whole pipeline on odd rows."""

import math

import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm import language_model, quality, toxicity
from tests.conftest import SF
from tests.llm.test_operators import ODD, zipf_texts

TEXTS = ["you are a nice person", "", "bad " * 40 + "words here", " ".join(f"w{i}" for i in range(100)), "one", " ".join(f"v{i}" for i in range(32)), " ".join(f"v{i}" for i in range(57))]


def test_windows_cover_every_word():
    t = toxicity.Texts(TEXTS)
    places, of = t.windows()
    for i, text in enumerate(TEXTS):
        n, starts = len(text.split()), [0]
        while starts[-1] + toxicity.STRIDE <= n - toxicity.LONG:
            starts.append(starts[-1] + toxicity.STRIDE)
        if starts[-1] + toxicity.LONG < n:
            starts.append(n - toxicity.LONG)
        own = places[of == i]
        words = t.inverse[t.off[i] : t.off[i + 1]].tolist()
        assert own.tolist() == [(words[s : s + toxicity.LONG] + [-1] * toxicity.LONG)[: toxicity.LONG] for s in starts]


def logit(p, words, rows):
    """The network over one window, a number at a time. rows: each word's input."""
    k, sig = toxicity.HIDDEN, lambda x: 1 / (1 + math.exp(-x))

    def gru(xs, u):
        h, out = [0.0] * k, []
        for x in xs:
            s = [sum(h[i] * u[i, j] for i in range(k)) for j in range(3 * k)]
            z, r = [sig(x[j] + s[j]) for j in range(k)], [sig(x[k + j] + s[k + j]) for j in range(k)]
            n = [math.tanh(x[2 * k + j] + r[j] * s[2 * k + j]) for j in range(k)]
            h = [(1 - z[j]) * n[j] + z[j] * h[j] for j in range(k)]
            out.append(h)
        return out

    xs = [rows[w] if w >= 0 else np.zeros(toxicity.WORD_DIM + toxicity.CHAR_DIM) for w in words]
    forward, backward = ([x @ p[w] + p[b] for x in xs] for w, b in (("wf", "bf"), ("wb", "bb")))
    states = [a + b for a, b in zip(gru(forward, p["uf"]), gru(backward[::-1], p["ub"])[::-1], strict=True)]
    e = [sum(math.tanh(sum(h[i] * p["a"][i, j] for i in range(2 * k))) * p["v"][j] for j in range(k)) - (1e4 if w < 0 else 0) for h, w in zip(states, words, strict=True)]
    weights = [math.exp(x - max(e)) for x in e]
    pooled = [sum(w * h[i] for w, h in zip(weights, states, strict=True)) / sum(weights) for i in range(2 * k)]
    return sum(x * y for x, y in zip(pooled, p["o"], strict=True)) + p["c"][0]


def test_forward_pass_restated():
    p = {k: v.astype(np.float64) for k, v in toxicity._start(np.random.default_rng(5)).items()}
    t = toxicity.Texts(TEXTS)
    places, _ = t.windows()
    rows = []
    for i in range(len(t.words)):
        tri = t.char_rows[t.edge[i] : t.edge[i + 1]]
        rows.append(np.concatenate((p["word"][t.word_rows[i]], p["char"][tri].mean(0))))
    got = toxicity._logits({k: v.astype(np.float32) for k, v in p.items()}, t, places)
    assert got.tolist() == pytest.approx([logit(p, w, rows) for w in places.tolist()], abs=2e-4)


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(6)
    p, t = toxicity._start(rng), toxicity.Texts(TEXTS)
    places, of = t.windows()
    y = (of % 2).astype(np.float32)
    g, _ = toxicity._step(p, t, places, y)
    loss = lambda q: float(np.mean(np.logaddexp(0, (s := toxicity._logits(q, t, places).astype(float))) - y * s))
    for name in p:
        at = np.unravel_index(np.argsort(-np.abs(g[name]), axis=None)[:3], g[name].shape)
        for place in zip(*at, strict=True):
            values = []
            for sign in (1, -1):
                q = {k: v.copy() for k, v in p.items()}
                q[name][place] += np.float32(sign * 0.01)
                values.append(loss(q))
            assert (values[0] - values[1]) / 0.02 == pytest.approx(float(g[name][place]), rel=0.05, abs=2e-4)


def test_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i % 40, f"{i} " + "x" * 500) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    texts, toxic = toxicity.labelled_sample(docs, labels, 1500, 4_000)
    assert 0 < sum(len(x) for x, y in zip(texts, toxic, strict=True) if y) <= 4_000 and len(texts) == len(set(texts))
    texts, toxic = toxicity.labelled_sample(docs.repartition(3), labels)
    assert sorted(texts) == sorted(min(f"{j} " + "x" * 500 for j in range(i, 200, 40)) for i in range(40)) and toxic.sum() == 20


def test_quality_scorer_restated(spark):
    """The scorer as plain sums over a text's shapes, with the weights that gradient steps over the whole sample give."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(rng.choice(["Good", "words", "of", "the", "###", "SHOUT", "a1b2", "12345"], rng.integers(1, 90)))) for i in range(80)] + [(90, None), (91, "")]
    got = {r["doc_id"]: r for r in quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    counts = {}
    for r in got.values():
        counts[r["pattern"]] = counts.get(r["pattern"], 0) + 1
    weak, _, _ = quality.vote_posteriors(counts)
    assert all(r["weak"] == pytest.approx(weak[r["pattern"]]) for r in got.values())
    features = {}
    for d, text in rows:
        if text is not None:
            seen = quality.Seen([text])
            x = np.bincount(seen.row, minlength=quality.ROWS).astype(float)
            features[d] = np.append(x / math.sqrt((x * x).sum() + quality.FEW), 1.0)
    x, y = np.array(list(features.values())), np.array([weak[got[d]["pattern"]] for d in features])
    w = v = np.zeros(x.shape[1])
    for i in range(quality.FIT_STEPS):  # the sample is all texts here, so its order does not count
        step = v - 2.0 * (x.T @ (1 / (1 + np.exp(-x @ v)) - y) / len(y) + 1e-5 * v)
        v, w = step + i / (i + 3) * (step - w), step
    for d, f in features.items():
        assert got[d]["score"] == pytest.approx(1 / (1 + math.exp(-f @ w)), abs=2e-3)
        assert got[d]["keep"] == (got[d]["score"] >= quality.KEEP)


def test_language_model_has_wide_codes_and_exact_sums(spark, monkeypatch):
    rows = zipf_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, fold int")
    runs = []
    for narrow, tokens in ((1 << 16, 1_200_000), (4, 1_200_000), (4, 50)):
        monkeypatch.setattr(language_model, "NARROW", narrow)
        monkeypatch.setattr(language_model, "SHARD_TOKENS", tokens)
        runs.append({r["doc_id"]: r["score"] for r in language_model.log_scores(docs).collect()})
    assert runs[1] == runs[0]
    assert runs[2] == {d: pytest.approx(x, rel=1e-9) for d, x in runs[0].items()}


def test_pipeline_on_odd_rows_and_empty_tables(spark):
    """Null, empty, repeated and very long rows pass all stages; a row without id or words is in no group and stays."""
    rows = [(d, t, None, None, None, 1) for d, t in ODD] + [(20 + i, "The quick brown fox jumps over the lazy dog near the river bank today. " * 3, "en", "s", 5, 1) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans int")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.select("doc_id").collect(), stage(spark, docs, SF)
        docs = docs.cache()
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert {i for i in ids} <= {r["doc_id"] for r in before}, name
        if name == "near_dedup":
            assert sum(i in (20, 21, 22) for i in ids) <= 1 and sum(i in (5, 6, 7) for i in ids) <= 1
            assert ids.count(1) == sum(r["doc_id"] == 1 for r in before)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF).cache()
        assert empty.count() == 0
    assert "ids" in empty.columns


def test_decontamination_with_an_empty_benchmark(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).count() == 2
