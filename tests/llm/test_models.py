import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_words import plain_words

from limpid.llm import language, packing, recurrent, url_rules


@pytest.fixture(scope="module")
def corpus(spark):
    """Four invented languages with their own words and some that all use."""
    r = np.random.default_rng(9)
    parts = {"xa": ["tha", "ing", "wor", "ent"], "xb": ["eau", "oux", "ère", "çon"], "xc": ["sch", "ung", "üb", "ich"], "xd": ["ción", "ñar", "ella", "oso"]}
    lists = {k: ["".join(r.choice(v, 2)) for _ in range(60)] + ["la", "de", "no"] for k, v in parts.items()}
    rows = []
    for i in range(400):
        k = list(parts)[i % 4]
        rows.append((i, " ".join(r.choice(lists[k], r.integers(5, 60))), k if i % 9 else None))
    for i in range(400, 420):
        a, b = r.choice(lists["xa"], 60), r.choice(lists["xb"], 25)
        rows.append((i, " ".join([*a, *b]), None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_languages_of_held_out_texts(corpus):
    model = language.fit(corpus)
    assert model.languages == ["xa", "xb", "xc", "xd"]
    got = {r["doc_id"]: r for r in language.predict(corpus, model).collect()}
    for r in corpus.filter("doc_id < 400").collect():
        assert got[r["doc_id"]]["lang_pred"] == ["xa", "xb", "xc", "xd"][r["doc_id"] % 4]
    for i in range(400, 420):  # two languages, shares near those of their words
        assert got[i]["languages"].split(",")[:2] == ["xa", "xb"] and abs(got[i]["score"] - 60 / 85) < 0.12
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_mixture_is_a_maximum(corpus):
    """Proportions found for a text are no worse than any others on a grid."""
    model = language.fit(corpus)
    text = corpus.filter("doc_id = 405").first()["text"]
    words = language.Words(pa.array([text]), space=language.NOT_LETTER)
    codes, at = words.distinct()
    p = np.exp(model.words(words, at)[codes].astype(float))
    shares, _ = language.mixtures(pa.array([text]), model)
    best = np.log(p @ shares[0]).sum()
    for a in np.linspace(0, 1, 21):
        assert np.log(p @ np.array([a, 1 - a, 0, 0]) + 1e-300).sum() <= best + 0.05


def test_languages_of_odd_tables(odd, none, corpus):
    model = language.fit(corpus)
    rows = language.predict(odd, model).collect()
    assert len(rows) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in rows:
        if r["doc_id"] is not None:
            letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    assert language.predict(none, model).collect() == [] and language.fit(none).languages == []
    assert {r["lang_pred"] for r in language.predict(odd, language.fit(none)).collect()} == {"und"}
    kept = language.accept(odd, model)
    assert kept.columns == odd.columns and language.accept(none, model).collect() == []
    assert all(any(c.isalpha() for c in r["text"]) for r in kept.collect())


def test_sample_does_not_decide_much(corpus):
    few = language.fit(corpus, per_language=15)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(corpus, few).collect()}
    assert np.mean([got[i] == ["xa", "xb", "xc", "xd"][i % 4] for i in range(400)]) > 0.95


# ---- recurrent model

def base_of(rows):
    counts = {}
    for i, t in rows:
        if fold(i, 7) != 2:
            for w in plain_words(t) + [None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    return n, {i: (len(plain_words(t)) + 1, sum(w in counts for w in plain_words(t) + [None]),
                   sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in plain_words(t) + [None])) for i, t in rows}


@pytest.fixture(scope="module")
def scored(corpus):
    return recurrent.score(corpus).collect()


def test_base_scores_match_brute_force(corpus, scored):
    n, want = base_of([(r["doc_id"], r["text"]) for r in corpus.collect()])
    assert len(scored) == len(want)
    for r in scored:
        tokens, known, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
        assert abs(r["base_score"] - base) < 1e-6 and r["held_out"] == (fold(r["doc_id"], 7) == 2)


def test_model_beats_base_on_held_out_texts(scored):
    held = [r for r in scored if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in scored)


def test_rare_words_meet_their_counts(corpus, monkeypatch):
    """With few words sent to all tasks, the rest comes by the join and gives the same base."""
    monkeypatch.setattr(recurrent, "KNOWN", 20)
    monkeypatch.setattr(recurrent, "ROUNDS", 1)
    _, want = base_of([(r["doc_id"], r["text"]) for r in corpus.collect()])
    for r in recurrent.score(corpus).collect():
        assert abs(r["base_score"] - want[r["doc_id"]][2]) < 1e-6 and r["n_known"] == want[r["doc_id"]][1]


def test_network_is_fitted_on_all_training_texts(spark, monkeypatch):
    """Far more texts than any fixed sample: the rounds together pass every token of every training text once."""
    rows = [(i, f"a{i % 50} b{i % 70} c") for i in range(9000)]
    seen, fit = [], recurrent.fit_network
    def keep(*args):
        seen.append(fit(*args))
        return seen[-1]
    monkeypatch.setattr(recurrent, "fit_network", keep)
    got = recurrent.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert seen[0][1] == 4 * sum(fold(i, 7) != 2 for i, _ in rows) == got[0]["train_tokens"]


def test_lanes_hold_every_token_once():
    texts = [np.full(n, i % 1000, np.int16) for i, n in enumerate([200_000, 5, 1, 9000, *[300] * 900])]
    x, fresh = recurrent.in_lanes(texts)
    assert (np.bincount(x[x >= 0].astype(int), minlength=904) == [len(t) for t in texts]).all()
    assert x.size < 4 * sum(map(len, texts)) and fresh[0].all()


def test_shards_grow_with_tokens():
    assert recurrent.shards_of(0) == 6 and recurrent.shards_of(4 * 10**9) == 2000


def test_probabilities_sum_to_one():
    network, r = recurrent.Network.fresh(), np.random.default_rng(0)
    h = np.tile(r.standard_normal((1, recurrent.HIDDEN)).astype(np.float32), (recurrent.TYPES, 1))
    value, _ = network.losses(h, np.arange(recurrent.TYPES))
    assert abs(np.exp(value.astype(float)).sum() - 1) < 1e-4


def test_gradients_are_differences():
    r = np.random.default_rng(1)
    text = r.integers(0, recurrent.TYPES, 9)
    network = recurrent.Network({k: v.astype(np.float64) for k, v in recurrent.Network.fresh().w.items()})
    caught = {}

    class Stop(Exception):
        pass

    original, zeros = recurrent.Network.losses, np.zeros_like
    def keep(self, h, x, grads=None):
        caught["grads"] = grads
        return original(self, h, x, grads)
    recurrent.Network.losses = keep
    try:
        copy = recurrent.Network({k: v.copy() for k, v in network.w.items()})
        recurrent.train(copy, [text])
    finally:
        recurrent.Network.losses = original
    scale = len(text) / recurrent.LANES
    for name in ("x", "u", "c", "i"):
        g = caught["grads"][name]
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        values = []
        for e in (1e-4, -1e-4):
            w = {k: v.copy() for k, v in network.w.items()}
            w[name][at] += e
            values.append(-recurrent.score_types(recurrent.Network(w), [text])[0])
        slope = (values[0] - values[1]) / 2e-4
        assert abs(slope - g[at] * scale) < 2e-2 * max(1, abs(slope)), name


def test_state_runs_through_long_texts():
    network, r = recurrent.Network.fresh(), np.random.default_rng(2)
    texts = [r.integers(0, recurrent.TYPES, n) for n in (1, 70, 33, 200, 5, 1)]
    got = recurrent.score_types(network, texts)
    for t, value in zip(texts, got):
        h, total = np.zeros((1, recurrent.HIDDEN), np.float32), 0.0
        for x in t:
            total += network.losses(h, np.array([x]))[0][0]
            h = network.step(h, np.array([x]))[0]
        assert abs(total - value) < 1e-2


def test_gradients_of_all_weights():
    """In double precision, with several texts in a lane: along any direction the gradients are the slope of the scores."""
    r = np.random.default_rng(4)
    texts = [r.integers(0, recurrent.TYPES, n) for n in (*[7] * 20, *[5] * 15, *[2] * 12)]
    network = recurrent.Network({k: v.astype(np.float64) for k, v in recurrent.Network.fresh().w.items()})
    caught, original = [], recurrent.Network.losses
    def keep(self, h, x, grads=None):
        caught.append(grads)
        return original(self, h, x, grads)
    recurrent.Network.losses = keep
    try:
        recurrent.train(recurrent.Network({k: v.copy() for k, v in network.w.items()}), texts)
    finally:
        recurrent.Network.losses = original
    assert len(caught) == 1
    for name, g in caught[0].items():
        way, values = r.standard_normal(g.shape), []
        for e in (1e-5, -1e-5):
            w = {k: v + e * way if k == name else v for k, v in network.w.items()}
            values.append(-recurrent.score_types(recurrent.Network(w), texts).sum())
        slope = (values[0] - values[1]) / 2e-5
        assert abs(slope - (g * way).sum() * sum(map(len, texts)) / recurrent.LANES) < 1e-4 * max(1, abs(slope)), name


def test_state_goes_on_in_the_next_window(monkeypatch):
    text = np.random.default_rng(5).integers(0, recurrent.TYPES, 2 * recurrent.WINDOW)
    network, seen, original = recurrent.Network.fresh(), [], recurrent.Network.losses
    def keep(self, h, x, grads=None):
        seen.append(h.copy())
        return original(self, h, x, grads)
    monkeypatch.setattr(recurrent.Network, "losses", keep)
    recurrent.train(recurrent.Network({k: v.copy() for k, v in network.w.items()}), [text])
    h = np.zeros((1, recurrent.HIDDEN), np.float32)
    for t in range(recurrent.WINDOW):
        assert np.allclose(seen[0][t], h, atol=1e-5)
        h = network.step(h, text[t:t + 1])[0]
    assert len(seen) == 2 and np.allclose(seen[1][0], h, atol=1e-5)


def test_head_words_are_not_worked_on_class_by_class(monkeypatch):
    """The exponentials of all head words are taken together, however many classes they are in."""
    network, r, calls, exp = recurrent.Network.fresh(), np.random.default_rng(6), [], np.exp
    h, x = r.uniform(-1, 1, (900, recurrent.HIDDEN)).astype(np.float32), r.integers(0, recurrent.TYPES, 900)
    def counted(*args):
        calls.append(1)
        return exp(*args)
    monkeypatch.setattr(np, "exp", counted)
    network.losses(h, x, {k: np.zeros_like(v) for k, v in network.w.items()})
    assert len(calls) <= 2


def test_texts_follow_each_other_in_lanes(monkeypatch):
    """Scores do not depend on the lanes, and few positions are left to lanes that run on alone."""
    network, r = recurrent.Network.fresh(seed=3), np.random.default_rng(7)
    texts = [r.integers(0, recurrent.TYPES, n).astype(np.int16) for n in (300, *[40] * 30, 1, 0, *r.integers(1, 70, 40))]
    want = [recurrent.score_types(network, [t])[0] for t in texts]
    monkeypatch.setattr(recurrent, "BESIDE", 8)
    monkeypatch.setattr(recurrent, "BESIDE_LEAST", 4)
    steps, advance = [], recurrent.Network.advance
    def counted(h, *args):
        steps.append(len(h))
        return advance(h, *args)
    monkeypatch.setattr(recurrent.Network, "advance", staticmethod(counted))
    assert np.allclose(recurrent.score_types(network, texts), want, rtol=1e-5)
    assert sum(steps) == sum(map(len, texts)) and len(steps) <= sum(map(len, texts)) / 8 + 70


def test_scores_of_odd_tables(odd, none):
    rows = recurrent.score(odd).collect()
    assert len(rows) == odd.count() and all(np.isfinite(r["score"]) for r in rows)
    empty = [r for r in rows if r["n_tokens"] == 1]
    assert empty and len({round(r["score"], 4) for r in empty}) == 1
    assert recurrent.score(none).collect() == []


# ---- URL rules

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
URLS = {"http://a.com/x": ("a.com", "/x", "com/", "allow"), "https://Example.COM/en/1?q#f": ("example.com", "/en/1", "example.com/en/", "block"),
        "http://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"), "http://www.example.com/en/x": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"), "http://x.net/es": ("x.net", "/es", None, None), "http://notcom/": ("notcom", "/", None, None),
        "http://a.com": ("a.com", "", None, None), "http://a.com?x=/": ("a.com", "", None, None), "no scheme": ("", "", None, None), None: ("", "", None, None),
        "": ("", "", None, None), "x://y://z/w": ("y:", "//z/w", None, None), "http://com/": ("com", "/", "com/", "allow"), "http://ÄB.com/É": ("Äb.com", "/É", "com/", "allow")}


def test_given_rules(spark):
    table = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_rules.judge(table, RULES).collect()}
    for i, (host, path, rule, verdict) in enumerate(URLS.values()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")


def test_mined_rules(spark):
    rows = [(["h:spam", "p:a"], "block")] * 40 + [(["h:good", "p:a"], "allow")] * 50 + [(["h:good", "p:ads"], "block")] * 20 + [(["p:ads", "h:x"], "block")] * 5 + [(["p:z"], None)] * 30
    rules = {tuple(r["items"]): r for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.05, 0.9).collect()}
    assert rules[("h:spam",)]["label"] == "block" and rules[("p:ads",)]["confidence"] == 1.0
    assert ("h:good", "p:a") in rules and ("h:good",) not in rules
    assert ("h:spam", "p:a") not in rules and ("h:good", "p:ads") not in rules  # shorter ones are as sure
    pages = spark.createDataFrame([(1, ["h:spam", "p:q"]), (2, ["h:good", "p:a", "p:ads"]), (3, ["h:good"]), (4, [])], "page_id long, tokens array<string>")
    found = {r["page_id"]: r["label"] for r in url_rules.match(pages, url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.05, 0.9)).collect()}
    assert found[1] == "block" and found[2] in ("block", "allow") and 3 not in found and 4 not in found
    brute = max(((r["confidence"], r["support"], r["rule_id"]), r["label"]) for r in rules.values() if set(r["items"]) <= {"h:good", "p:a", "p:ads"})[1]
    assert found[2] == brute


def test_no_pages(spark):
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string, verdict string"), RULES).collect() == []


# ---- packing

def check_packing(pieces, sized, capacity):
    rows = {}
    for r in sized:
        rows.setdefault(r["doc_id"], []).append(r)
    bins, cover = {}, {}
    for p in pieces:
        bins.setdefault(p["bin_id"], []).append(p)
        cover[p["doc_id"]] = cover.get(p["doc_id"], 0) + p["n_tokens"]
    for i, same in rows.items():
        assert cover.get(i, 0) == sum(r["n_tokens"] for r in same)
    for b, inside in bins.items():
        assert sum(p["n_tokens"] for p in inside) <= capacity and abs(inside[0]["bin_fill"] - sum(p["n_tokens"] for p in inside) / capacity) < 1e-9
        for field in ("source", "cluster"):
            values = [rows[p["doc_id"]][0][field] for p in inside]
            values = [v for v in values if v is not None]
            assert len(values) == len(set(values))
    return bins


def test_packing_keeps_its_rules(spark, docs):
    sized = packing.sized(docs)
    bins = check_packing(packing.pack(sized, 100, 64).collect(), sized.collect(), 64)
    assert len(bins) > 10


def test_packing_many(spark):
    r = np.random.default_rng(5)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 50}", f"c{i // 2}" if i % 10 == 0 else f"d{i}", int(r.integers(1, 400))) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, source string, cluster string, n_tokens long")
    pieces = packing.pack(table, 3000, 512).collect()
    bins = check_packing(pieces, table.collect(), 512)
    assert len(bins) < 1.35 * sum(n for *_, n in rows) / 512


def test_best_fit_takes_the_tightest_compatible_bin():
    """Against a search through all bins."""
    r, bins, state = np.random.default_rng(6), packing.Bins(50), []
    for _ in range(400):
        size, s, c = int(r.integers(1, 51)), int(r.integers(0, 6)), None if r.random() < 0.5 else int(r.integers(0, 5))
        fit = [(room, b) for b, (room, ss, cs) in enumerate(state) if room >= size and s not in ss and c not in cs and room > 0]
        b = bins.place(size, s, c)
        if fit:
            assert b == min(fit)[1]
        else:
            assert b == len(state)
            state.append((50, set(), set()))
        room, ss, cs = state[b]
        state[b] = (room - size, ss | {s}, cs | ({c} if c is not None else set()))


def test_packing_of_odd_tables(odd, none):
    sized = packing.sized(odd)
    pieces = packing.pack(sized, odd.count(), 64).collect()
    assert sum(p["n_tokens"] for p in pieces) == sum(r["n_tokens"] for r in sized.collect())
    assert packing.pack(packing.sized(none), 0).collect() == []
