"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables, for each operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from procspark.llm import cdc, decontam, divergence, licenses, lines, mixing, quality, radix, rpforest, simhash, spelling, tokens, toxicity
from procspark.llm.common import scratch_dir

LONG = " ".join(f"word{i % 997}" for i in range(60_000))
PASSAGE = " ".join(f"common{i}" for i in range(70)) + "."
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, h long, size long, copies int, spans string, c0 string, __s string"
TEXTS = [
    (1, PASSAGE + " All rights reserved. SPDX-License-Identifier: MIT OR GPL-2.0"), (1, PASSAGE + " All rights reserved. SPDX-License-Identifier: MIT OR GPL-2.0"),
    (1, "another text with the same id"), (None, PASSAGE), (None, None), (None, PASSAGE), (5, None), (6, ""), (7, LONG), (8, LONG), (9, "  \n\t "), (10, "é ü ß 日本"),
]
N = len(TEXTS)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(d, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", None, 0.5, 1, 2, 3, 4, "x", "y", "z") for i, (d, t) in enumerate(TEXTS)]
    path = str(tmp_path_factory.mktemp("edges") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 0, 1), (5, None, 0), (None, 1, 1), (7, 1, 0), (7, 1, None), (8, 1, 0), (99, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (None, "x"), (3, ""), (3, "ü ß")], "item_id long, text string")


def key(rows, *columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in rows)


def test_toxicity(spark, docs, none, labels):
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == N and all(0 <= r.score <= 1 for r in got) and all(r.held_out for r in got if r.doc_id is None)
    assert len({r.score for r in got if r.doc_id in (5, 6, 9)}) == 1
    assert toxicity.classify(none, labels).count() == 0
    blank = toxicity.classify(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in blank} == {(0.5, 1)}
    assert toxicity.reject(docs, labels.limit(0)).count() == N and toxicity.reject(docs, labels).columns == docs.columns


def test_licenses(docs, none):
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == N and licenses.scan_licenses(none).count() == 0
    first = next(r for r in got if r.doc_id == 1 and r.n_base)
    assert (first.base_labels, first.labels, first.expressions) == ("reserved", "gpl-2.0,mit,reserved", ["mit gpl-2.0 or"])
    assert all((r.n_words, r.n_base, r.first_word, r.labels, r.score) == (0, 0, None, "", 0.0) for r in got if r.doc_id in (5, 6, 9))


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == N and simhash.near_duplicates(none).count() == 0
    zero = {r.component_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {5} and {r.component_id for r in got if r.doc_id in (7, 8)} == {7}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and simhash.keep_one(none).count() == 0
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None and r.doc_id > 1) == [5, 7, 10]
    assert len([r for r in rows if r.doc_id == 1]) == 2 and len([r for r in rows if r.doc_id is None and r.text == PASSAGE]) in (0, 1)


def test_decontamination(spark, docs, none, benchmark):
    got = decontam.decontaminate(docs, benchmark).collect()
    assert len(got) == N and decontam.decontaminate(none, benchmark).count() == 0
    hit = [r for r in got if r.contaminated]
    assert key(hit, "doc_id", "item_ids") == sorted(["(1, ['1'])"] * 2 + ["(None, ['1'])"] * 2 + ["(10, ['3'])"])
    assert all(r.n_words == r.n_hit == 0 for r in got if r.doc_id in (5, 6, 9))
    assert not any(r.n_hit for r in decontam.decontaminate(docs, benchmark.limit(0)).collect())
    clean = decontam.clean(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == N - len(hit)


def test_mixing(spark, docs, none):
    got = mixing.digest(mixing.mix(docs)).collect()
    assert len(got) == N and mixing.digest(mixing.mix(none)).count() == 0
    assert all(0 <= r.taken <= 2 * r.size for r in got) and {r.size for r in got if r.doc_id in (5, 6, 9)} == {0}
    repeated = mixing.replicate(mixing.mix(docs))
    assert repeated.columns == docs.columns
    assert repeated.count() == mixing.mix(docs).agg(F.sum("__mix.copies")).first()[0]
    named = docs.withColumns({"__mix": F.lit(1), "__copy": F.lit(2), "copy": F.lit(3)})
    clash = mixing.replicate(mixing.mix(named))
    assert clash.columns == named.columns and clash.count() == repeated.count()
    blank = docs.where("text is null")
    assert {r.taken for r in mixing.digest(mixing.mix(blank)).collect()} == {0}


def test_tokens(spark, docs, none):
    path = scratch_dir(spark)
    layout = tokens.materialise(docs, path)
    got = tokens.read_shards(spark, path).collect()
    t = tokens.Tokenizer(open(tokens.RANKS, "rb").read())
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert sum(r.n_tokens for r in got) == sum(len(t.ids(x or "")) + 1 for _, x in TEXTS)
    assert [r.ids for r in got if r.doc_id == 5] == [[t.end]] and len([r for r in got if r.doc_id is None and r.seq_no == 0]) == 3
    for df in (none, docs.orderBy("text").withColumn("x", F.lit(1))):
        other = scratch_dir(spark)
        assert tokens.materialise(df, other).count == (0 if df is none else layout.count)
        assert tokens.read_shards(spark, other).count() == (0 if df is none else len(got))


@pytest.mark.parametrize("operator", [cdc.dedup_chunks, radix.repeated_windows])
def test_substrings(docs, none, operator):
    got = cdc.digest(operator(docs)).collect()
    assert len(got) == N and operator(none).count() == 0
    removed = {(r.doc_id, r.n_bytes): r.n_removed for r in got}
    size = len(LONG)
    assert removed[7, size] == 0 and removed[8, size] > 0.99 * size and removed[1, len(TEXTS[0][1])] == 0
    assert removed[None, len(PASSAGE)] > 0.6 * len(PASSAGE) and removed[5, 0] == removed[6, 0] == 0


def test_quality(docs, none):
    got = quality.classify(docs).collect()
    assert len(got) == N and all(0 <= r.score <= 1 for r in got) and quality.classify(none).count() == 0
    assert len({r.score for r in got if r.doc_id in (5, 6)}) == 1


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1),
            (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (None, [2.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit(9)).withColumn("least", F.lit(9))
    got = rpforest.near_vectors(df).collect()
    assert len(got) == len(rows)
    links = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.n_links}
    assert links == {(1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False)}
    assert all(r.component_id == r.vec_id and r.kept for r in got if not r.n_links)
    assert rpforest.near_vectors(df.limit(0)).count() == 0


def test_stages(spark, docs, none, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, none):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            path = str(tmp_path / f"{name}-{table is docs}")
            stage(spark, now, str(tmp_path)).write.parquet(path)
            now = spark.read.schema(docs.schema).parquet(path)
            assert now.columns == docs.columns
        out = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert (out.count() > 0) == (table is docs)


def test_lines(docs, none):
    clash = docs.withColumns({c: F.lit(1) for c in ("__lines", "doc", "t", "pos", "line", "k", "g", "row", "own_t", "c1", "bits", "n_dropped")})
    out = lines.dedup_lines(clash)
    assert out.columns == [*clash.columns, "__lines_"] and lines.dedup_lines(none).count() == 0
    got = lines.digest(out).collect()
    assert len(got) == N and {(r.n_lines, r.n_dropped) for r in got if r.doc_id in (5, 6)} == {(1, 0)}
    assert not any(r.n_dropped for r in got)  # two documents with ids hold a line at most
    more = docs.where(F.col("text") == PASSAGE).unionByName(docs.where(F.col("text") == LONG)).unionByName(docs.where("doc_id = 7")).withColumn("doc_id", F.monotonically_increasing_id())
    assert sorted(r.n_dropped for r in lines.digest(lines.dedup_lines(more)).collect()) == [0, 0, 0, 1, 1]


def test_spelling(docs, none):
    clash = docs.withColumns({c: F.lit(1) for c in ("word", "n", "id", "doc", "form", "root")})
    got = {r.word: r for r in spelling.spelling_variants(clash).collect()}
    assert spelling.spelling_variants(none).count() == 0 and all(r.n >= 5 and len(r.word) >= 6 for r in got.values())
    assert got["common"].n >= 60 * 4 and spelling.spelling_variants(docs.where("text is null")).count() == 0


def test_divergence(docs, none):
    clash = docs.withColumns({c: F.lit(1) for c in ("term", "n", "d", "part", "item", "value", "rank", "p", "v")})
    got = divergence.audit(clash).collect()
    assert divergence.audit(none).count() == 0 and {r.part for r in got} >= {"pair"}
    groups = {(r.lang or "", r.source or "") for r in docs.select("lang", "source").collect()}
    assert {(r.lang, r.source) for r in got if r.part == "pair"} == {g for g in groups if any(h != g and h[0] == g[0] for h in groups)}
