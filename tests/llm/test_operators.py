"""Each operator against a brute-force version."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import langid, minhash, mixing, packing, quality, quotes, substring, textkit, topk, toxicity, urlfilter

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def docs(spark):
    """Real documents with odd ones added: nulls, empty and repeated rows, a long one, white space of all kinds."""
    real = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    base = real.text[3]
    odd = [
        (None, base, "en", None, 1), (10_001, None, None, "src1", None), (10_002, "", "en", "", 0), (10_003, " \t\n\x0b\f\r ", "en", "src2", 7), (10_004, "one", None, None, 3),
        (10_005, base, "en", "src1", 1), (10_005, base, "en", "src1", 1), (10_006, " ".join(["again and again the same"] * 40), "en", "src1", 1), (10_007, base * 30, "en", "src3", 1),
        (10_008, "é x y \x1cz", "fr", "src1", 1), (10_009, "\n".join(["a line", "a line", " ", "a line "]), "en", "src1", 1), (10_010, "One", "en", "src1", 3),
        (None, None, None, None, None), (10_011, base.upper(), "en", "src4", 1), (10_012, "1234 5678 !!! 99", "en", "src4", 1),
    ]
    rows = [tuple(r) for r in real.itertuples(index=False)] + odd
    rows = [tuple(None if v is None or v != v else int(v) if isinstance(v, (float, np.integer)) else v for v in r) for r in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [r.asDict() for r in docs.collect()]


def test_words_and_windows_hash_alike():
    texts = ["a bb  ccc", "", "bb ccc", " \t", "ccc", "x" * 5000 + " y"]
    data = "".join(texts).encode()
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = textkit.words_of(np.frombuffer(data, np.uint8), offs)
    assert got.counts.tolist() == [len(words(t)) for t in texts]
    assert [data[a:b].decode() for a, b in zip(got.starts, got.ends)] == [w for t in texts for w in words(t)]
    h = got.hashes()
    assert h[1] == h[3] and h[2] == h[4] == h[5] and len(set(h.tolist())) == 5
    runs = textkit.Rolling(h).runs(2)
    assert runs[1] == runs[3] and len(set(runs.tolist())) == len(runs) - 1


def test_mixing(docs, rows):
    got = mixing.Mix(docs).table().toPandas()
    assert len(got) == len(rows)
    frame = pd.DataFrame(rows)
    db = duckdb.connect()
    db.register("documents", frame.astype({"doc_id": "Int64", "n_chars": "Int64"}))
    want = db.sql(mixing.MIX_SQL).df()
    key = ["doc_id", "size", "taken"]
    a = sorted(got[key].fillna(-1).astype(int).itertuples(index=False, name=None))
    assert a == sorted(want[key].fillna(-1).astype(int).itertuples(index=False, name=None))
    assert np.allclose(sorted(got.target), sorted(want.target))
    totals = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), most=("size", "max"))
    assert (abs(totals.taken - totals.target) <= totals.most / 2 + 1e-6).all() and (totals.target <= 3 * totals["size"] + 1e-6).all()
    assert abs(totals.target.sum() - got["size"].sum()) < 1e-6


def test_many_sources_are_shared_out_by_aggregation(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    rng = random.Random(7)
    names = [f"s{i}" for i in range(40)] + ["é", "🙂", "", None]
    sizes = [(n, int(10 ** rng.uniform(0, 6)) if rng.random() < 0.9 else 0) for n in names]
    frame = spark.createDataFrame(sizes, "source string, source_size long").repartition(5)
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1000)
    want = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    assert got == want and len(got) == len(names)
    assert mixing.source_targets(spark.createDataFrame([], "source string, source_size long")).count() == 0


def test_mixed_documents(docs):
    mix = mixing.Mix(docs)
    taken = mix.table().agg(F.sum("copies")).first()[0]
    out = mix.documents(docs)
    assert out.columns == docs.columns and out.count() == taken


def test_targets_are_reshared(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 1), ("c", 10), ("d", 0), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    target, left, free = {}, 1511.0, {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    size = {"a": 1000, "b": 1, "c": 10, "d": 0, None: 500}
    while True:
        unit = left / sum(free.values())
        over = [k for k in free if unit * free[k] > 3 * size[k]]
        if not over:
            target |= {k: unit * w for k, w in free.items()}
            break
        for k in over:
            target[k] = 3.0 * size[k]
            left -= target[k]
            del free[k]
    assert got == pytest.approx(target)


def test_quality(docs, rows):
    got = quality.apply_policy(quality.ledger(docs)).toPandas()
    want = []
    for r in rows:
        text = r["text"] or ""
        w = words(text)
        times = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want.append((-1 if r["doc_id"] is None else r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(got[cols].fillna(-1).astype(int).itertuples(index=False, name=None)) == sorted(want)
    rules = quality.Rules()
    short = got.n_words < 10
    assert ((got.fail_bits & rules.bit("too_short") > 0) == short).all() and not got.kept[short].any()
    book = quality.ledger(docs)
    for r in quality.ablations(book).collect():
        bit, mask = rules.bit(r.rule), rules.mask(quality.POLICIES["v1"])
        b = got.fail_bits & mask
        assert (r.fails, r.fails_alone, r.kept_without) == ((b & bit > 0).sum(), (b == bit).sum(), (b & ~bit == 0).sum())


def test_quality_of_labelled_documents(spark):
    kept = quality.apply_policy(quality.ledger(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    got = kept.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert not got.kept[got.quality == 0].any()
    base = (got.fail_bits & quality.Rules().mask(quality.BASE)) != 0
    assert got.kept[(got.quality == 1) & ~base].all()


def test_forward_backward():
    rng = np.random.default_rng(0)
    first = np.concatenate([[0], np.cumsum(rng.integers(0, 90, 30))])
    n, stay, start = first[-1], np.array([[0.9, 0.1], [0.4, 0.6]]), np.array([0.7, 0.3])
    potential = rng.normal(-1, 2, n)
    marginal, moved = toxicity.forward_backward(potential, first, stay, start)
    want, pairs = np.zeros(n), np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        e = [np.array([1, np.exp(potential[k])]) for k in range(a, b)]
        alpha, beta = [], [np.ones(2)]
        for k in range(b - a):
            x = (start if k == 0 else alpha[-1] @ stay) * e[k]
            alpha.append(x / x.sum())
        for k in range(b - a - 1, 0, -1):
            y = stay @ (e[k] * beta[0])
            beta.insert(0, y / y.sum())
        for k in range(b - a):
            q = alpha[k] * beta[k]
            want[a + k] = q[1] / q.sum()
            if k:
                z = alpha[k - 1][:, None] * stay * (e[k] * beta[k])[None]
                pairs += z / z.sum()
    assert np.allclose(marginal, want) and np.allclose(moved, pairs)


def brute_tokens(text):
    """(start, end) in bytes and (word, starts) of each token, by characters."""
    data = text.encode()
    out, at, run = [], 0, None
    for c in text + " ":
        n = len(c.encode())
        wide = 0x3000 <= ord(c) <= 0x9FFF
        part = c.isascii() and not c.isalnum() or 0x2000 <= ord(c) <= 0x207F
        if run is not None and (part or wide):
            out.append((run, at, False))
            run = None
        if wide:
            out.append((at, at + n, True))
        elif not part and run is None:
            run = at
        at += n
    fold = lambda b: bytes(x + 32 if 65 <= x <= 90 else x for x in b)
    tokens = []
    for i, (a, b, wide) in enumerate(out):
        if wide:
            both = i + 1 < len(out) and out[i + 1][0] == b and out[i + 1][2]
            starts = (None, None, data[a : b + 3] if both else None)
        else:
            starts = tuple(fold(data[a : a + s]) if b - a >= s else None for s in toxicity.STARTS)
        tokens.append((a, b, fold(data[a:b]), *starts))
    return tokens


ODD_TEXTS = ["", "One, two-three...FOUR", "x" * 300 + " " + "x" * 299 + "y", "«é» ünï “quoted” a–b", "日本語のテキスト abc 語", "a", " \t\n", "don't (((stop)))", "語", "日本", "🙂🙂 smile", "wort wort wörter"]


def test_tokens_and_features_equal_brute_force():
    data = "".join(ODD_TEXTS).encode()
    offs = np.cumsum([0, *(len(t.encode()) for t in ODD_TEXTS)])
    words, features = toxicity.token_features(np.frombuffer(data, np.uint8), offs)
    known = {}
    for i, text in enumerate(ODD_TEXTS):
        want = brute_tokens(text)
        at = slice(words.first[i], words.first[i + 1])
        assert [(a - offs[i], b - offs[i]) for a, b in zip(words.starts[at], words.ends[at])] == [t[:2] for t in want], text
        for got, token in zip(features[at], want, strict=True):
            for kind, (value, piece) in enumerate(zip(got, token[2:], strict=True)):
                assert (value == 0) == (piece is None)
                if piece is not None:
                    assert known.setdefault((kind, piece), value) == value
    assert len(set(known.values())) == len(known)


def random_field(rng, keys):
    return toxicity.Field(keys, np.append(rng.normal(size=(3, len(keys))), np.zeros((3, 1)), 1), -1.0, np.array([[0.8, 0.3], [0.2, 0.9]]), np.array([0.7, 0.3]), rng.normal(size=4))


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(5)
    first, k = np.array([0, 4, 4, 9]), 6
    field = random_field(rng, np.arange(1, k + 1, dtype=np.uint64))
    at, label = rng.integers(-1, k, (9, toxicity.KINDS)).astype(np.int32), rng.integers(0, 2, 9).astype(float)

    def likelihood():
        p, total = field.potentials(at, first), 0.0
        for a, b in zip(first, first[1:]):
            if b > a:
                path = lambda states: np.prod([(field.start[s] if i == 0 else field.stay[states[i - 1], s]) * np.exp(p[a + i] * s) for i, s in enumerate(states)])
                total += np.log(path(label[a:b].astype(int))) - np.log(sum(path(x) for x in itertools.product((0, 1), repeat=b - a)))
        return total

    weights, bias, moves = toxicity.gradient(field, at, first, label)
    step = 1e-5
    for index in itertools.product(range(3), range(k)):
        field.weights[index] += step
        up = likelihood()
        field.weights[index] -= 2 * step
        assert abs((up - likelihood()) / (2 * step) - weights[index]) < 1e-5
        field.weights[index] += step
    for s, t in itertools.product((0, 1), repeat=2):
        before = field.stay[s, t]
        field.stay[s, t] = before * np.exp(step)
        up = likelihood()
        field.stay[s, t] = before * np.exp(-step)
        assert abs((up - likelihood()) / (2 * step) - moves[s, t]) < 1e-5
        field.stay[s, t] = before
    field.bias += step
    up = likelihood()
    field.bias -= 2 * step
    assert abs((up - likelihood()) / (2 * step) - bias) < 1e-5


def test_scores_and_spans_equal_brute_force(spark):
    """All states of a text are walked one after the other, with weights by feature."""
    data = "".join(ODD_TEXTS).encode()
    _, features = toxicity.token_features(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in ODD_TEXTS)]))
    field = random_field(np.random.default_rng(6), np.unique(features[features != 0])[::2])
    field.keys = np.array(list({int(x) % toxicity.SLOTS: x for x in field.keys}.values()), np.uint64)
    field.keys.sort()
    field.weights = field.weights[:, -len(field.keys) - 1 :]
    number = {int(x): i for i, x in enumerate(field.keys)}
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate([*ODD_TEXTS, None])), "doc_id long, text string").repartition(2), field).collect()}
    for i, text in enumerate([*ODD_TEXTS, None]):
        raw = (text or "").encode()
        words_, features = toxicity.token_features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        w = lambda row, x: field.weights[row, number[int(x)]] if int(x) in number else 0.0  # noqa: E731, B023
        n = len(features)
        e = [np.array([1, np.exp(field.bias + sum(w(0, x) for x in features[t]) + (w(1, features[t - 1, 0]) if t else 0) + (w(2, features[t + 1, 0]) if t + 1 < n else 0))]) for t in range(n)]
        alpha, beta = [], [np.ones(2)]
        for t in range(n):
            alpha.append((field.start if t == 0 else alpha[-1] @ field.stay) * e[t])
        for t in range(n - 1, 0, -1):
            beta.insert(0, field.stay @ (e[t] * beta[0]))
        marginal = np.array([a[1] * b[1] / (a @ b) for a, b in zip(alpha, beta)]) if n else np.zeros(0)
        most, total = np.clip(marginal.max(), 1e-4, 1 - 1e-4) if n else 0, marginal.sum()
        x = np.array([1, np.log(most / (1 - most)), np.log(total + 1e-3), np.log(total / n + 1e-3)]) if n else np.array([1, -9, np.log(1e-3), np.log(1e-3)])
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-x @ field.layer)), rel=1e-6)
        spans = []
        for t in np.flatnonzero(marginal >= 0.5):
            a, b = (len(raw[: int(x)].decode()) for x in (words_.starts[t], words_.ends[t]))
            if spans and t and marginal[t - 1] >= 0.5:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
        assert [(s["start"], s["end"]) for s in got[i].spans] == spans


def test_feature_counts_equal_brute_force():
    import pyarrow as pa

    toxic = [i % 3 == 0 for i in range(len(ODD_TEXTS))]
    got = Counter()
    for batch in toxicity.count_features(iter([pa.RecordBatch.from_arrays([pa.array(list(map(int, toxic))), pa.array(ODD_TEXTS)], ["toxic", "text"])])):
        for r in batch.to_pylist():
            got += Counter({(r["feature"], 1): r["toxic"], (r["feature"], 0): r["clean"]})
    want = Counter()
    for text, bad in zip(ODD_TEXTS, toxic, strict=True):
        raw = text.encode()
        _, features = toxicity.token_features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        want.update((int(x), int(bad)) for x in {*features.view(np.int64).ravel().tolist()} - {0})
    assert got == want


def test_held_out_toxicity(spark):
    """Learnt from two thirds of the labels: held-out documents are told apart."""
    from weftgraph.llm.queries import op3_toxicity

    sf = "/root/testdata/sf0.01"
    got = op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert got.predicted[got.toxic == 0].mean() <= 0.02 and got.predicted[got.toxic == 1].mean() >= 0.7


def test_toxicity_spans(spark):
    rng = random.Random(1)
    plain = ["la", "miro", "teno", "sula", "kore", "vani"]
    data = []
    for i in range(600):
        w = [rng.choice(plain) + rng.choice(["", "ta", "ri"]) for _ in range(rng.randint(3, 40))]
        toxic = i % 5 == 0
        if toxic:
            w.insert(rng.randint(0, len(w)), "Grobx" + rng.choice(["", "en", "ul", "ist", "or,"]))
        data.append((" ".join(w), int(toxic)))
    learn = lambda some, **kw: toxicity.teach(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(some)], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, (_, y) in enumerate(some)], "doc_id long, toxic int"), **kw)
    field = learn(data[:450])
    held = data[450:] + [("miro grobxani la", 1), ("Grobxula!", 1), ("", 0), (None, 0)]
    got = toxicity.score(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(held)], "doc_id long, text string"), field).toPandas().sort_values("doc_id")
    assert all((s >= 0.7) == bool(y) for s, (_, y) in zip(got.score, held, strict=True)) and got.score.between(0, 1).all()
    for spans, (text, y) in zip(got.spans, held, strict=True):
        assert len(spans) >= y and all("grobx" in text[s["start"] : s["end"]].lower() for s in spans)
    assert learn(data[1:5]) is None and learn(data[:450], training=lambda c: c < 0) is None
    assert len(learn(data[:450], training=lambda c: c < 200).keys) > 0
    assert toxicity.score(spark.createDataFrame([(1, "x")], "doc_id long, text string"), None).first().score == 0


def test_url_rules(spark):
    rng = random.Random(3)
    urls = [r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").select("url").collect()]
    urls += [None, "", "no host", "://", "http://", "HTTP://A.Example.COM/en/7", "http://example.com/en/7#x", "http://xexample.com/en/7", "ftp://com/en/?q=/en/7", "http://b.org/es/", "http://org", "http://é.com/en/", "http://x.example.net/de/81?a", "http://net/de/8", "http://host?x=http://y/z"]
    urls += [f"http://{rng.choice(['a.', ''])}example.{rng.choice(['com', 'net', 'org'])}{rng.choice(['/en/', '/de/', '/es/', ''])}{rng.randint(1, 99)}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = urlfilter.judge(pages).toPandas().sort_values("page_id")
    for url, r in zip(urls, got.itertuples(), strict=True):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = "".join(c.lower() if c.isascii() else c for c in re.split(r"[/?#]", rest)[0])
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fits = [x for x in urlfilter.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.text), default=None)
        assert (r.host, r.path) == (host, path), url
        assert (r.rule, r.verdict) == (best.text, best.verdict) if best else r.rule is None and r.verdict in ("allow", "block")


def test_url_model_tells_classes_apart(spark):
    rng = random.Random(5)
    make = lambda good, i: f"http://{'garden' if good else 'casino'}{rng.randint(0, 99)}.{rng.choice(['a', 'b'])}.{{}}/{'flowers' if good else 'win-cash'}/{i}"
    rows = [(i, make(i % 2, i).format(("ok" if i % 2 else "bad") if i < 400 else "zz")) for i in range(500)]
    rules = (urlfilter.Rule("allow", "ok", "/"), urlfilter.Rule("block", "bad", "/"))
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).filter("rule IS NULL").toPandas()
    right = (got.verdict == np.where(got.page_id % 2 == 1, "allow", "block")).mean()
    assert len(got) == 100 and right >= 0.95


def brute_url_scores(rows, held):
    """Scores of all URLs from rows of (url, ruled): counts in dicts, the recursion character by character."""
    pad, counts, after = "\x02" * urlfilter.ORDER, {k: Counter() for k in ("allow", "block")}, {k: defaultdict(set) for k in ("allow", "block")}
    totals, letters = Counter(), {c for url, _ in rows for c in url.lower()}
    for url, ruled in rows:
        if ruled is None or held(url):
            continue
        text = pad + url.lower()
        for i in range(urlfilter.ORDER, len(text)):
            for order in range(urlfilter.ORDER + 1):
                context = text[i - order : i]
                counts[ruled][context, text[i]] += 1
                after[ruled][context].add(text[i])
    for k in counts:
        for (context, _), n in counts[k].items():
            totals[k, context] += n

    def probability(k, context, c):
        if not context:
            return (counts[k]["", c] + 1) / (totals[k, ""] + len(letters))
        lower = probability(k, context[1:], c)
        n, kinds = totals[k, context], len(after[k][context])
        return lower if n < urlfilter.EVIDENCE else (counts[k][context, c] + kinds * lower) / (n + kinds)

    def score(url):
        text = pad + url.lower()
        ratios = [np.log(probability("allow", text[i - urlfilter.ORDER : i], text[i])) - np.log(probability("block", text[i - urlfilter.ORDER : i], text[i])) for i in range(urlfilter.ORDER, len(text))]
        return float(np.mean(ratios)) if ratios else 0.0

    return score


@pytest.mark.parametrize("broadcast", [True, False])
def test_url_scores_and_verdicts_equal_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:  # the model is joined by a shuffle, but for its hot grams
        monkeypatch.setattr(urlfilter, "small", lambda df: False)
    urls = [r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").select("url").collect()][:150] + ["http://é日本🙂.zz/пример/Ω", "no rule", "", "http://" + "long" * 300 + ".zz/"]
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).toPandas().sort_values("page_id")
    ruled = [None if pd.isna(r) else v for r, v in zip(got.rule, got.verdict, strict=True)]
    held = lambda url: int(hashlib.md5(url.encode()).hexdigest()[:8], 16) % urlfilter.HELD == 0
    score = brute_url_scores(list(zip(urls, ruled, strict=True)), held)
    want = np.array([round(score(u), 9) for u in urls])
    free = got.rule.isna().to_numpy()
    assert free.sum() > 20 and np.allclose(got.score.to_numpy()[free], want[free], atol=2e-9) and got.score[~free].isna().all()
    known = [(want[i], ruled[i]) for i in range(len(urls)) if ruled[i] and held(urls[i])]
    assert {k for _, k in known} == {"allow", "block"}
    least, most = (f(s for s, v in zip(want[free], got.verdict[free]) if v == k) for f, k in ((min, "allow"), (max, "block")))
    assert most < least  # one cut
    share = lambda cut: sum(np.mean([(s >= cut) == (k == "allow") for s, k in known if k == kind]) for kind in ("allow", "block"))
    width = (max(s for s, _ in known) - min(s for s, _ in known)) / urlfilter.STEPS
    assert max(share(c) for c in np.linspace(most, least, 50)) >= max(share(s) for s, _ in known) - 2 / len(known) or least - most < width


@pytest.mark.parametrize("length,seed", [(35, 5), (6, 2), (4, 4)])
def test_substring(spark, docs, rows, length, seed):
    if length < 10:  # few words, so that repeats overlap in every way
        rng = random.Random(length)
        rows = [{"doc_id": i, "text": " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))} for i in range(60)]
        docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    got = substring.remove_repeats(docs, length, seed, digest=True).select("row.doc_id", "n_words", "n_removed", "kept").collect()
    plain = substring.remove_repeats(docs, length, seed).select("row.doc_id", "kept").collect()
    all_words = [words(r["text"]) for r in rows]
    times = Counter(tuple(w[i : i + length]) for w in all_words for i in range(len(w) - length + 1))
    want, texts = [], []
    for r, w in zip(rows, all_words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if times[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((r["doc_id"] or -1, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
        texts.append((r["doc_id"] or -1, kept if any(gone) else r["text"] or ""))
    assert sorted((r.doc_id or -1, *r[1:]) for r in got) == sorted(want)
    assert sorted((r.doc_id or -1, words(r.kept)) for r in plain) == sorted((d, words(t)) for d, t in texts)


def test_language_equals_brute_force(spark):
    """Trigrams bound one by one, bundled in dicts, and cosines by the definition."""
    rng = random.Random(4)
    alphabet = {"aa": "abcde é", "bb": "klmno -", "cc": "вгде ж"}
    docs = [(i, rng.choice(sorted(alphabet))) for i in range(60)]
    docs = [(i, "".join(rng.choice(alphabet[k] + "xyz ") for _ in range(rng.randint(1, 80))), k) for i, k in docs] + [(90, "", "aa"), (91, None, "bb"), (92, "12 34", "cc"), (93, "Ünï e", None), (94, "日本 x", "aa"), (None, "abc", "aa")]
    names, prototypes = langid.teach(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3))
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), (names, prototypes)).collect()}
    base = np.random.Generator(np.random.PCG64(7)).integers(0, 2, (langid.SYMBOLS, langid.DIMENSIONS), np.int8) * 2 - 1

    def bundle(text):
        symbols = [1 + ord(c) % (langid.SYMBOLS - 1) if c.isalpha() else 0 for c in f" {(text or '').lower()} "]
        symbols = [s for i, s in enumerate(symbols) if i == 0 or s or symbols[i - 1]]
        out = np.zeros(langid.DIMENSIONS)
        for i in range(len(symbols) - 2 if any(symbols) else 0):
            bound = np.ones(langid.DIMENSIONS)
            for place in range(3):
                bound *= np.roll(base[symbols[i + place]], place)
            out += bound
        return out

    sums = {}
    for i, text, k in docs:
        v = bundle(text)
        if i is not None and k is not None and v.any():
            sums[k] = sums.get(k, 0) + v / np.linalg.norm(v)
    assert names == sorted(sums)
    for i, text, _ in docs:
        v = bundle(text)
        if not v.any():
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        cosines = [v @ sums[k] / np.linalg.norm(v) / np.linalg.norm(sums[k]) for k in names]
        best = int(np.argmax(cosines))
        assert got[i].score == pytest.approx(max(cosines[best], 0), abs=1e-5)
        assert got[i].lang_pred == names[best] or max(cosines) - cosines[names.index(got[i].lang_pred)] < 1e-5


def test_only_so_many_languages_are_taught(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    docs = [(i, f"text {k}", f"l{k}") for k in range(6) for i in range(k * 10, k * 10 + k + 1)]
    assert langid.teach(spark.createDataFrame(docs, "doc_id long, text string, lang string"))[0] == ["l3", "l4", "l5"]


def test_language(spark):
    all_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = langid.teach(all_docs.filter(~held), per_language=200)
    got = langid.identify(all_docs.filter(held), model).join(all_docs, "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() >= 0.97 and got.score.between(0, 1).all()
    odd = langid.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 9"), (4, "\n")], "doc_id long, text string"), model).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in odd)


def quoted_talks():
    """Messages that quote earlier ones: whole, wrapped anew, in part, and quotes of quotes."""
    rng = random.Random(11)
    out = []
    for conv in range(25):
        own = []
        for turn in range(rng.randint(1, 9)):
            body = ["\n".join(" ".join(rng.choice(["wort", "mot", "Word", "ÉTÉ", "x1"]) + str(rng.randrange(9)) for _ in range(rng.randint(1, 7))) + rng.choice([".", "!", "", "?"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3))]
            text = []
            for _ in range(rng.choice([0, 0, 1, 2]) if own else 0):
                passage = rng.choice(rng.choice(own))
                words_, level = passage.split(), rng.choice([1, 1, 2, 3])
                lines = {0: passage.split("\n"), 1: [" ".join(words_[i : i + 4]) for i in range(0, len(words_), 4)], 2: passage.split("\n")[:1], 3: ["never said before"]}[rng.randrange(4)]
                text += [rng.choice(["On Monday Bot wrote:", "well"])] + [rng.choice([">", "> ", "\t>"]) * level + x.upper() for x in lines] + [rng.choice(["", ">", "  "])]
            out.append((conv, turn, rng.choice(["user", None]), "\n".join([*text, *"\n\n".join(body).split("\n")])))
            own.append(body)
    return out + [out[3], (None, 1, "user", "> x"), (4, None, "user", "> x"), (5, 90, None, None), (5, 91, "user", "")]


def test_quotes_equal_their_sql(spark):
    from weftgraph.llm.sql import QUOTES

    talks = quoted_talks()
    got = quotes.link(spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").repartition(3))
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", talks)
    want = db.sql(QUOTES)
    assert got.filter("reply_to IS NOT NULL").count() > 20 and got.filter("thread <> reply_to").count() > 5
    assert sorted(map(repr, map(tuple, got.select(want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_quotes(spark):
    turns = [
        (1, 0, "user", "How do I bake bread?\nI have flour."), (1, 1, "assistant", "Use yeast.\nKnead well, and for a long time,\nuntil it is smooth"),
        (1, 2, "user", "On Monday Bot wrote:\n> Use   YEAST.\n>> How do I bake bread?\nWhich yeast?"), (1, 3, "assistant", "> I have flour.\nGood flour."),
        (1, 4, "user", "> Which yeast?\n\n> unknown line\nTell me."), (1, 5, "user", "> use yeast. knead well,\n> and for a long time, until\n> it is smooth\nHow long?"),
        (2, 0, "user", "> Use yeast.\nalone"), (1, 1, "assistant", "Use yeast.\nKnead well, and for a long time,\nuntil it is smooth"), (None, 0, "user", "> Use yeast."), (3, None, None, None), (3, 1, "user", ""),
        (4, 0, "user", ">" * 1_000_000 + " deep"), (4, 1, "user", "> " * 300_000), (4, 2, "user", "a\n" * 100_000),
    ]
    got = quotes.link(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(turns)
    by = {(r.conv_id, r.turn): r for r in got}
    see = lambda c, t: tuple(by[c, t][k] for k in ("reply_to", "thread", "n_quoted", "n_linked", "depth", "text"))
    assert see(1, 0) == (None, 0, 0, 0, 0, "How do I bake bread?\nI have flour.")
    assert see(1, 2) == (1, 1, 2, 2, 2, "Which yeast?")
    assert see(1, 3) == (0, 0, 1, 1, 1, "Good flour.")
    assert see(1, 4) == (2, 1, 2, 1, 1, "\nTell me.")
    assert see(1, 5) == (1, 1, 1, 1, 1, "How long?")  # wrapped anew
    assert see(2, 0) == (None, 0, 1, 0, 1, "alone")
    assert see(None, 0)[:2] == (None, 0) and see(3, None) == (None, None, 0, 0, 0, None) and see(3, 1)[-1] == ""
    assert see(4, 0)[2:] == (1, 0, 1_000_000, "") and see(4, 1)[2:] == (0, 0, 300_000, "") and len(see(4, 2)[-1]) == 200_000


def test_packing(docs, rows):
    tokenizer = packing.Encoder(packing.TOKENIZER).tokenizer
    got = packing.pack(docs, 256).toPandas()
    ids = got.ids.map(lambda b: np.frombuffer(b, "<u4").tolist())
    stream = [x for _, one in sorted(zip(zip(got.sequence_id, got.offset), ids, strict=True)) for x in one]
    assert got.groupby("sequence_id").length.sum().iloc[:-1].eq(256).all() and (got.length == ids.map(len)).all()
    whole = Counter()
    place = got.assign(ids=ids, at=got.sequence_id * 256 + got.offset).sort_values("at")
    assert (place["at"].to_numpy() == np.concatenate([[0], place.length.cumsum()[:-1]])).all()
    current: list = []
    for r in place.itertuples():
        assert r.start == len(current)
        current += r.ids
        if len(current) == r.doc_tokens:
            whole[(-1 if pd.isna(r.doc_id) else int(r.doc_id), tuple(current))] += 1
            current = []
    want = Counter((-1 if r["doc_id"] is None else r["doc_id"], (*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1)) for r in rows)
    assert whole == want and len(stream) == sum(len(k[1]) * n for k, n in want.items())


def test_encoder_equals_the_tokenizer():
    rng = random.Random(2)
    parts = ["a", "B", " ", "\n", "é", "É", "ß", "İ", "'s", "'", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", ".", ",", "!!", "$$$", "%%%%", "€", "\x01", "\x1c", " ", "12", "½", "ñ.", "日本", "🙂", "ab.", "×.", "÷,", "|", "<", "|>", "don't", "́", " "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(2000)]
    encoder = packing.Encoder(packing.TOKENIZER)
    encoder.MOST = 3000  # so that it forgets
    got = []
    import pyarrow as pa

    for _, _, data, offs in textkit.text_chunks(pa.array(texts), 2000):
        ids, sizes = encoder.ids(data, offs)
        got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def brute_components(rows, percent=85):
    sets = []
    for r in rows:
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(r["text"])]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    near = {(a, b) for g in where.values() if len(g) > 1 for k, a in enumerate(g) for b in g[k + 1 :]}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = []
    for g in groups.values():
        ids = [rows[i]["doc_id"] for i in g if rows[i]["doc_id"] is not None]
        out += [(rows[i]["doc_id"] or -1, len(sets[i]), min(ids, default=None)) for i in g]
    return sorted(out, key=repr)


def test_near_duplicates(docs, rows):
    got = minhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_in_a_large_group(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**9)}"
        rows.append({"doc_id": i, "text": " ".join(w)})
    rows += [{"doc_id": 1000 + i, "text": " ".join(f"u{i}_{j}" for j in range(rng.randint(1, 9)))} for i in range(50)]
    rows += [{"doc_id": 2000 + i, "text": " ".join(f"t{j}" for j in range(12 + i % 3))} for i in range(20)]
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    got = minhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)


def test_near_duplicates_of_random_variants(spark):
    """200 groups of variants at once, each of one text, with 1 to 6 edits; every component equals that of brute force."""
    rng = random.Random(17)
    rows = []
    for group in range(200):
        length, n = rng.randint(60, 200), rng.choice([40, 40, 60, 150])
        base = [f"g{group}_{i}" for i in range(length)]
        most = rng.choice([2, 4, 6])
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randint(1, most)):
                at = rng.randrange(len(w))
                rng.choice([lambda: w.__setitem__(at, f"x{rng.randrange(10**9)}"), lambda: w.pop(at), lambda: w.insert(at, "y")])()  # noqa: B023
            rows.append({"doc_id": len(rows), "text": " ".join(w)})
    rng.shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").repartition(4)).collect()
    assert sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)


def test_near_duplicates_under_one_id(spark):
    """A third of the rows share an id and have texts of their own; another third are one row."""
    rng = random.Random(3)
    text = lambda k, *changed: " ".join(f"t{k}_{j}" if j not in changed else f"x{rng.randrange(10**6)}" for j in range(100))
    rows = [{"doc_id": 50, "text": text(k % 70, k % 90)} for k in range(400)]
    rows += [{"doc_id": 60, "text": text(1, 5)}] * 400 + [{"doc_id": 70 + k, "text": text(k % 90, 3, k % 80)} for k in range(200)] + [{"doc_id": 9, "text": text(2, 40)}, {"doc_id": 50, "text": ""}, {"doc_id": None, "text": text(3)}]
    got = minhash.near_duplicates(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)


def families():
    """Texts of one core, just unlike each other, of which some pairs are alike: no centre is like them."""
    rng = random.Random(8)
    core = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        own = core + [f"x{i}_{j}" for j in range(20)]
        rows.append({"doc_id": 2 * i, "text": " ".join(own)})
        if i % 2:
            own[rng.randrange(200, 220)] = f"y{i}"
            rows.append({"doc_id": 2 * i + 1, "text": " ".join(own)})
    return rows


@pytest.mark.parametrize("group", [minhash.GROUP, 20])
def test_near_duplicates_unlike_every_centre(spark, monkeypatch, group):
    monkeypatch.setattr(minhash, "GROUP", group)
    rows = families()
    got = minhash.near_duplicates(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert len({c for _, _, c in want}) == 120
    assert sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in got), key=repr) == want


def test_pipeline_drops_near_duplicates_from_80_percent(spark):
    rows = [{"doc_id": d, "text": " ".join(f"t{k}_{j}" if j not in changed else f"x{d}" for j in range(100))} for k in range(6) for d, changed in ((2 * k, ()), (2 * k + 1, ((20,), (20, 50), (20, 50, 80))[k % 3]))]
    real = spark.read.parquet(f"{DATA}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text")
    docs = real.unionByName(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string"))
    want = brute_components([r.asDict() for r in docs.collect()], 80)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {0 if d == -1 else d for d, _, c in want if d == c or d == -1} and 3 not in kept and 5 in kept


def test_pipeline_drops_near_duplicates_without_ids(spark):
    text = lambda k, *changed: " ".join(f"t{k}_{j}" if j not in changed else f"x{j}" for j in range(100))
    rows = [(None, text(1)), (None, text(1)), (None, text(1, 20)), (7, text(2)), (None, text(2)), (None, text(2, 50)), (8, text(3)), (8, text(3, 40)), (None, text(4)), (None, None), (None, ""), (8, text(5)), (9, text(6)), (9, text(6)), (11, text(7)), (10, text(7, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    groups = Counter((r[1] or "none").split("_")[0] for r in kept)
    assert groups == {"t1": 1, "t2": 1, "t3": 1, "t4": 1, "t5": 1, "t6": 1, "t7": 1, "none": 2}
    assert {rows[3], rows[8], rows[11], rows[12], rows[15]} <= set(kept)  # the least id stays, and one without an id only alone


def test_pipeline_equals_brute_force(spark):
    """All five stages on a small table, each with the documents that the one before kept."""
    rng = random.Random(21)
    vocabulary = [f"{a}{b}" for a in ("ta", "lo", "mi", "ren", "su") for b in ("ka", "de", "vor", "nim", "pel", "qua", "zo")]
    line = lambda n: [rng.choice(vocabulary) + str(rng.randrange(50)) for _ in range(n)]
    passage, rows = line(60), []
    for i in range(40):
        w = line(rng.randint(40, 120))
        if i % 8 == 0:
            w[20:20] = passage
        rows.append((i, " ".join(w), "en", rng.choice(["a", "b", None]), 0))
        if i % 5 == 0:  # a near copy, and an exact one
            v = list(w)
            v[3] = "other"
            rows += [(100 + i, " ".join(v), "en", "c", 0), (200 + i, " ".join(w), "en", "a", 0)]
    rows += [(300, "too short", "en", "a", 0), (301, "again and again " * 40, "en", "a", 0), (302, None, None, None, None), (303, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)

    good = [r for r in rows if r[0] < 300]
    single_ids = {d for d, _, c in brute_components([{"doc_id": r[0], "text": r[1]} for r in good], 80) if (0 if d == -1 else d) == c}
    single = [r for r in good if (r[0] or -1) in single_ids]
    assert len(single) == 40
    times = Counter(tuple(w[i : i + 35]) for r in single for w in [words(r[1])] for i in range(len(w) - 34))
    clean = []
    for r in single:
        w = words(r[1])
        gone = {j for i in range(len(w) - 34) if times[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        text = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else r[1]
        clean.append((r[0], text, r[2], r[3], len(text)))
    assert sum(len(words(r[1])) for r in clean) == sum(len(words(r[1])) for r in single) - 60 * 5
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", clean)
    taken = {d: t // s for d, s, t in db.sql(f"SELECT doc_id, size, taken FROM ({mixing.MIX_SQL})").fetchall()}
    tokenizer = packing.Encoder(packing.TOKENIZER).tokenizer
    want = Counter({(r[0], tuple(tokenizer.encode(r[1], add_special_tokens=False).ids) + (1,)): taken[r[0]] for r in clean if taken[r[0]]})

    now = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, "")
    assert sorted(tuple(r) for r in now.select("doc_id", "text", "lang", "source", "n_chars").collect()) == sorted(clean)
    mixed = corpus_pipeline.mix_sources(spark, now, "")
    pieces = corpus_pipeline.pack_sequences(spark, mixed, "").collect()
    place, got, current = sorted(pieces, key=lambda r: (r.sequence_id, r.offset)), Counter(), []
    for r in place:
        assert r.ids_crc32 == zlib.crc32(r.ids)
        current += np.frombuffer(r.ids, "<u4").tolist()
        if len(current) == r.doc_tokens:
            got[r.doc_id, tuple(current)] += 1
            current = []
    assert got == want and not current


def test_common():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 6000, rng.integers(1, 4000)).astype(np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    off = ~np.eye(len(sets), dtype=bool)
    assert (minhash._common(sets)[off] == np.array(want)[off]).all()


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(minhash, "ONE_TASK", one_task)
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(6, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.id: r.component for r in minhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}
    find = lambda x: x if parent.get(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("dims,k,bucket,block,spread", [(8, 5, 16, 7, 1.0), (3, 2, 5, 3, 40.0), (16, 5, 2048, 4096, 3.0)])
def test_top_k(spark, dims, k, bucket, block, spread):
    rng = np.random.default_rng(dims)
    vectors = [[float(x) for x in rng.normal(size=dims) * rng.uniform(1 / spread, spread)] for _ in range(150)]
    vectors += [vectors[0]] * 60 + [[0.0] * dims, vectors[1][:2], None, [1.0, None], [float("nan")] * dims, [float("inf")] * dims, []]
    ids = [*range(len(vectors) - 1), 10]  # one id stands twice
    table = spark.createDataFrame([(i, v, 0) for i, v in zip(ids, vectors, strict=True)] + [(None, vectors[2], 0)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(table, lambda c: c % 10 == 0, k, bucket, block).collect())
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in zip(ids, vectors, strict=True) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (i, q) in enumerate(whole):
        if i % 10 == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(whole) if a != b)[:k]
            want += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores, 1)]
    assert got == sorted(want)


def test_pruning_keeps_all_that_reach_the_bound():
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(400, 6)) * rng.uniform(0.2, 3, (400, 1)) * 100
    sizes = np.linalg.norm(vectors, axis=1)
    order = np.argsort(-sizes)
    vectors, sizes = vectors[order], sizes[order]
    for q in rng.normal(size=(40, 6)) * 50:
        scores = vectors @ q
        for share in (0.3, 0.6, 0.9, 1.0, 1.1):
            bound = scores.max() * share
            if bound <= 0:
                continue
            left = topk.survivors(q, np.linalg.norm(q), sizes, vectors / sizes[:, None], bound)
            assert set(np.flatnonzero(scores >= bound)) <= set(left.tolist())


@pytest.mark.parametrize("block,bucket,partitions", [(4096, 512, 8), (100, 64, 3), (7, 2048, 5)])
def test_top_k_answers_every_query_of_every_block(spark, block, bucket, partitions):
    """Many blocks over uneven ranges; a third of all rows are copies of one vector."""
    rng = np.random.default_rng(block)
    n, most = (12_200, 12_200) if block == 4096 else (1500, 1500)
    vectors = rng.normal(size=(n, 6)) * np.exp(rng.normal(size=(n, 1)) * rng.choice([0, 2], (n, 1)))
    vectors[: n // 3] = vectors[0]
    table = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>").repartition(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = topk.top_k(table, lambda c: c < most, 5, bucket, block).toPandas().sort_values(["query_id", "rank"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    whole = np.floor(vectors * 256)
    assert len(got) == 5 * n
    ids, scores = got.vec_id.to_numpy().reshape(n, 5), got.score.to_numpy().reshape(n, 5)
    for lo in range(0, n, 500):
        score = whole[lo : lo + 500] @ whole.T
        score[np.arange(len(score)), np.arange(lo, lo + len(score))] = -np.inf
        order = np.argsort(-score, axis=1, kind="stable")[:, :5]
        assert (ids[lo : lo + 500] == order).all()
        assert (scores[lo : lo + 500] == np.take_along_axis(score, order, 1)).all()


def test_top_k_sends_a_bucket_only_where_it_can_serve(spark):
    buckets = spark.createDataFrame([(i, float(10 - i)) for i in range(10)], "bucket long, longest double")
    blocks = spark.createDataFrame([(0, 0.0), (1, 5.0), (2, 99.0)], "bucket long, least double")
    got = sorted((r.block, r.bucket) for r in topk.served(buckets, blocks).collect())
    assert got == [(0, i) for i in range(10)] + [(1, i) for i in range(6)]


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for top in (100, 2000, 1 << 20, 1 << 28):
        a, b = rng.integers(-top, top, (7, 9)), rng.integers(-top, top, (5, 6))
        want = a[:, :6].astype(object) @ b.T.astype(object)
        assert (topk.products(topk._narrow(a), topk._narrow(b)).astype(np.int64) == want).all()


def test_crc_of_pieces():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")
