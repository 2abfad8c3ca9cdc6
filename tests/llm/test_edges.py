"""Every operator and stage on empty tables, nulls everywhere, extra columns and repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from weftgraph.llm import langid, minhash, mixing, packing, quality, quotes, substring, topk, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["size", "hash", "row", "node", "rep", "k1", "k2", "told", "kept", "u", "v", "_s", "_none", "ledger", "component", "id", "part", "at", "ids", "url", "gram", "lines", "turn", "a.b", "DOC", "_size", "_row"]


def with_clashes(df):
    for i, c in enumerate(CLASH):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(f"x{i}"))
    return df


def model():
    return ["en"], np.ones((1, langid.DIMENSIONS), np.float32)


def field():
    """A field in which the word w7 is toxic."""
    _, features = toxicity.token_features(np.frombuffer(b"w7", np.uint8), np.array([0, 2]))
    keys = features[0, :1]
    return toxicity.Field(keys, np.array([[9.0, 0], [0.5, 0], [0.5, 0]]), -5.0, np.array([[0.9, 0.1], [0.5, 0.5]]), np.array([0.9, 0.1]), np.array([1.0, 1, 0, 0]))


def operators(spark):
    return {
        "mix": lambda d: mixing.Mix(d).table(),
        "mixed": lambda d: mixing.Mix(d).documents(d),
        "ledger": quality.ledger,
        "with_ledger": quality.with_ledger,
        "substring": lambda d: substring.remove_repeats(d).select("row", "kept"),
        "digest": lambda d: substring.remove_repeats(d, digest=True),
        "near": minhash.near_duplicates,
        "pack": packing.pack,
        "language": lambda d: langid.identify(d, model()),
        "toxic": lambda d: toxicity.score(d, field()),
    }


@pytest.fixture(scope="module")
def frames(spark):
    nulls = [(None, None, None, None, None)] * 3
    text = " ".join(f"w{i}" for i in range(80))
    odd = [(1, "", "en", "a", 0), (2, text, None, "a", None), (2, text, None, "a", None), (3, text, "en", None, 3), (None, text, "en", "b", 3), (4, " \n\t", "xx", "b", 3), (5, "\n" * 50 + text * 20, "en", "a", 1), (6, "🙂 é x", "en", "a", 1)]
    return {
        "empty": spark.createDataFrame([], DOCS),
        "nulls": spark.createDataFrame(nulls, DOCS),
        "odd": spark.createDataFrame(odd, DOCS),
        "one": spark.createDataFrame(odd[:1], DOCS),
    }


@pytest.mark.parametrize("name", ["mix", "mixed", "ledger", "with_ledger", "substring", "digest", "near", "pack", "language", "toxic"])
def test_odd_documents(spark, frames, name):
    run = operators(spark)[name]
    for kind, df in frames.items():
        plain = run(df)
        rows = plain.collect()
        if name not in ("mixed", "pack"):
            assert len(rows) == df.count(), kind
        if kind == "odd":
            extra = run(with_clashes(df))
            shared = [c for c in plain.columns if c in extra.columns and c not in ("row", "ledger")]
            order = lambda d: sorted(map(repr, d.select(*(f"`{c}`" for c in shared)).collect()))
            assert order(extra) == order(plain)


def test_null_texts_pack_as_one_token(frames):
    assert {(r.start, r.length, r.doc_tokens) for r in packing.pack(frames["nulls"]).collect()} == {(0, 1, 1)}


def test_teaching_from_odd_tables(spark, frames):
    labels = "doc_id long, quality int, toxic int"
    some = spark.createDataFrame([(1, None, 1), (2, 0, 0), (2, 0, 1), (3, 1, 0), (5, None, 0), (None, 1, 1), (4, 1, None), (6, 1, 7)], labels)
    none, nulls = spark.createDataFrame([], labels), spark.createDataFrame([(None, None, None)] * 2, labels)
    for kind, docs in frames.items():
        for known in (none, nulls, some):
            got = toxicity.teach(docs, known)
            assert (got is not None) == (kind == "odd" and known is some), kind
            assert toxicity.score(docs, got).filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
        names, prototypes = langid.teach(docs)
        assert names == {"odd": ["en"], "one": []}.get(kind, []) or kind == "odd" and set(names) <= {"en", "xx"}
        assert len(prototypes) == len(names) and langid.identify(docs, (names, prototypes)).count() == docs.count()
    extra = with_clashes(frames["odd"])
    assert np.array_equal(toxicity.teach(extra, some).layer, toxicity.teach(frames["odd"], some).layer)


def test_odd_pages_messages_and_vectors(spark):
    pages = "page_id long, url string, html string"
    assert urlfilter.judge(spark.createDataFrame([], pages)).count() == 0
    rows = urlfilter.judge(with_clashes(spark.createDataFrame([(None, None, None), (1, "", None), (1, "", None), (2, "http://a.net/de/1", "x")], pages).drop("turn"))).collect()
    assert len(rows) == 4 and {r.verdict for r in rows} == {"allow"}
    talk = "conv_id long, turn long, role string, text string"
    assert quotes.link(spark.createDataFrame([], talk)).count() == 0
    assert quotes.link(spark.createDataFrame([(None, None, None, None)] * 2 + [(1, 0, None, "> a\n>")], talk)).count() == 3
    vec = "vec_id long, embedding array<float>, label int"
    every = lambda c: c % 1 == 0
    assert topk.top_k(spark.createDataFrame([], vec), every).count() == 0
    assert topk.top_k(spark.createDataFrame([(None, None, None), (1, None, 1), (2, [None], 1)], vec), every).count() == 0
    assert topk.top_k(spark.createDataFrame([(1, [1.0], 1)], vec), every).count() == 0
    two = topk.top_k(with_clashes(spark.createDataFrame([(1, [1.0], 1), (1, [2.0], 1)], vec)), every).collect()
    assert sorted(tuple(r) for r in two) == [(1, 1, 1, 131072)] * 2


def test_stages(spark, frames):
    for kind, df in frames.items():
        for name, stage in p.STAGES[:-1]:
            for one in (df, with_clashes(df)) if kind == "odd" else (df,):
                out = stage(spark, one, "")
                assert out.columns == one.columns, (name, kind)
                assert name == "mix" or out.count() <= one.count()
        assert p.pack_sequences(spark, df, "").count() >= df.count()


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = p.keep_good(spark, docs, sf)
    single = p.drop_near_duplicates(spark, good, sf)
    assert minhash.near_duplicates(single).filter("NOT kept").count() == 0
    clean = p.drop_repeated_passages(spark, single, sf)
    assert clean.count() == single.count() and clean.filter("n_chars <> length(text)").count() == 0
    assert clean.agg(F.sum("n_chars")).first()[0] < single.agg(F.sum("n_chars")).first()[0]
    packed = p.run(spark, sf).toPandas()
    assert packed.groupby("sequence_id").length.sum().iloc[:-1].eq(packing.LENGTH).all()
    assert set(packed.doc_id) <= {r.doc_id for r in clean.select("doc_id").collect()}
