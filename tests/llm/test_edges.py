"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import corpus_pipeline
import pytest

from sparkloom.llm import hilbert, licenses, lm_scoring, minhash, mixing, packing, quality_rules, spherical, substring, token_output
from sparkloom.llm.common import written

LONG = "This is a sentence with several words in it. " * 20000
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRAS = ["n_words", "copies", "lines", "kept_lines", "hilbert", "shard_id", "n_tokens", "token_ids", "node", "chunk", "id", "band", "bin_id", "__words", "__runs", "__doc", "__gone", "__copies", "__x0", "__size"]
OPERATORS = {
    "shard": hilbert.shard, "tokens": token_output.tokenize, "clean": quality_rules.clean, "report": lambda d: quality_rules.clean(d, report=True), "repeats": substring.repeats, "remove": substring.remove, "pack": packing.pack,
    "groups": minhash.groups, "deduplicate": minhash.deduplicate, "score": lm_scoring.score, "selected": lambda d: mixing.selected(d).drop("__words", "__copies"), "mixed": mixing.mixed, "licenses": licenses.scan,
}
KEEPS_COLUMNS = {"shard", "tokens", "clean", "report", "remove", "deduplicate", "mixed"}


def hard(spark):
    good = "The quick brown fox jumps over the lazy dog near the river bank today."
    rows = [(0, good, "en", "src0", len(good)), (0, good, "en", "src0", len(good)), (1, None, "en", "src1", None), (2, "", None, "src2", 0), (3, " \n\t\n ", "fr", None, 5), (None, good, "en", "src0", 1), (None, None, None, None, None), (4, LONG, "en", "src12", len(LONG)), (5, LONG, "de", "src19", len(LONG)), (6, "é漢\U0001f600", "es", "srcX", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in EXTRAS:
        df = df.withColumn(c, df["lang"])
    return df


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(spark, name):
    df = hard(spark)
    out = written(OPERATORS[name](df), "edges")
    rows = out.collect()
    if name in KEEPS_COLUMNS:
        assert set(df.columns) - {"text"} <= set(out.columns)
        assert all(r["__gone"] == r["lang"] for r in rows)
    if name in ("shard", "tokens", "score"):
        assert len(rows) == 10
    if name == "groups":
        assert [(r["doc_id"], r["duplicate_of"]) for r in rows] == [(5, 4)]
    if name == "deduplicate":
        assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows if r["doc_id"] is not None) == [(False, k) for k in (0, 0, 1, 2, 3, 4, 6)] and len(rows) == 9
    if name == "clean":
        assert {r["doc_id"] for r in rows} == {0, None}  # the long texts are one sentence over and over
    if name == "remove":
        assert {r["doc_id"] for r in rows} >= {0, 1, 2, 3, 4, 6, None} and 5 not in {r["doc_id"] for r in rows}
    if name == "pack":
        assert {r["doc_id"] for r in rows} == {0, None, 4, 5, 6}
        assert sum(r["n_words"] for r in rows if r["doc_id"] == 4) == 180000
    if name == "score":
        assert all((r["mean_log_score"] is None) == (r["n_words"] == 0) for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    df = spark.createDataFrame([], SCHEMA)
    out = OPERATORS[name](df)
    assert out.columns and out.count() == 0


def test_empty_vectors(spark):
    assert spherical.classes(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    rows = [(1, [1.0, 0.0], "x"), (2, [1.0, 0.0], "y"), (2, [1.0, 0.0], "y"), (3, None, None), (None, [1.0, 0.0], "z"), (4, [0.0, 1.0], "w"), (7, [1.0] * 20000, "v"), (8, [2.0] * 20000, "v")]
    got = spherical.classes(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n_links string")).collect()
    assert sorted((r["vec_id"], r["class_id"], r["n_links"]) for r in got) == [(1, 1, 1), (2, 1, 1), (4, 4, 0), (7, 7, 1), (8, 7, 1)]


def test_names_in_another_case(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "src0", 5, "x", "y")], SCHEMA + ", Hilbert string, N_Tokens string")
    assert [c.lower() for c in hilbert.shard(df).columns].count("hilbert") == 1
    assert [c.lower() for c in token_output.tokenize(df).columns].count("n_tokens") == 1


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, sf_dir, k):
    stage = corpus_pipeline.STAGES[k][1]
    df = hard(spark)
    out = stage(spark, df, sf_dir)
    if k < 4:
        assert out.columns == df.columns
    out.count()
    assert stage(spark, spark.createDataFrame([], SCHEMA), sf_dir).count() == 0


def test_ties_in_mixing(spark):
    """Copies of one row are all of one kind: what is taken doesn't depend on the order of rows."""
    rows = [(i // 3, "a b c d", "en", f"src{i % 20}", 7) for i in range(300)]
    a = mixing.mixed(spark.createDataFrame(rows, SCHEMA)).collect()
    b = mixing.mixed(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
