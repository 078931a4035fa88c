"""Every query of the library against its SQL; those without SQL against brute force."""

from collections import defaultdict

import pytest
from comparison import compare
from pyspark.sql import functions as F

from sparkloom import catalog
from sparkloom.functions import text as X
from sparkloom.operators import graph, log, rel
from sparkloom.plans import governance


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, sf_dir, name):
    assert compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], sf_dir) == ""


def union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (205, 200), (7, 7), (300, 300)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "src int, dst int")).collect()}
    assert got == union_find(pairs)


def test_communities(spark):
    """Ids are strings; three dense groups come out whole, and modularity beats that of single nodes."""
    groups = [range(0, 6), range(10, 16), range(20, 26)]
    pairs = [(f"n{a:02}", f"n{b:02}", 5) for g in groups for a in g for b in g if a < b] + [("n05", "n10", 1), ("n15", "n20", 1)]
    df = spark.createDataFrame(pairs, "a string, b string, weight int")
    labels = graph.checkpointed(graph.communities(df))
    by = defaultdict(set)
    for r in labels.collect():
        by[r["community"]].add(r["node"])
    assert sorted(map(sorted, by.values())) == [[f"n{i:02}" for i in g] for g in groups]
    assert set(by) == {"n00", "n10", "n20"}
    single = labels.select("node", F.col("node").alias("community"))
    assert graph.modularity(df, labels).first()[0] > max(0.6, graph.modularity(df, single).first()[0])


def test_closure(spark):
    """Depth of the first round that reaches a node, with the best confidence of the paths of that length; cycles end."""
    rows = [("a", "b", 0.9), ("a", "c", 0.5), ("b", "d", 0.4), ("c", "d", 0.6), ("d", "a", 1.0), ("x", "a", 1.0)]
    got = {(r["subject"], r["node"]): (r["depth"], r["confidence"]) for r in graph.closure(spark.createDataFrame(rows, "src string, dst string, confidence double"), spark.createDataFrame([("a",), ("d",)], "subject string")).collect()}
    assert got == {("a", "a"): (0, 1.0), ("a", "b"): (1, 0.9), ("a", "c"): (1, 0.5), ("a", "d"): (2, 0.5), ("d", "d"): (0, 1.0), ("d", "a"): (1, 1.0), ("d", "b"): (2, 0.9), ("d", "c"): (2, 0.5)}


def test_layers(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("e", "f")], "a string, b string")
    got = {(r["seed"], r["node"]): r["depth"] for r in graph.layers(pairs, spark.createDataFrame([("s", "c"), ("s", "a")], "seed string, node string"), 1).collect()}
    assert got == {("s", "c"): 0, ("s", "a"): 0, ("s", "b"): 1, ("s", "d"): 1}


def chained(spark):
    df = spark.createDataFrame([(u, i, f"e{u}{i}", f"p{u}{i}", "created" if i == 1 else "work") for u in (1, 2) for i in range(1, 6)], "u int, i int, id string, payload string, kind string")
    return graph.checkpointed(log.chain(df, ["u"], ["i"], F.col("payload")))


def faults(df):
    return {(r["u"], r["sequence"], r["reason"]) for r in log.verify_chain(df, ["u"], "id", F.col("payload"), F.col("kind") == "created").collect()}


def test_chain_commits_to_history(spark):
    """Each hash is that of the one before it and the event's digest, worked out here by hand."""
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for u in (1, 2):
        before = None
        for r in sorted((r for r in chained(spark).collect() if r["u"] == u), key=lambda r: r["sequence"]):
            assert r["previous_hash"] == before and r["event_hash"] == sha((before or "") + "|" + sha(r["payload"]))
            before = r["event_hash"]


def test_chain_finds_tampering(spark):
    df = chained(spark)
    assert faults(df) == set()
    third = (F.col("u") == 1) & (F.col("sequence") == 3)
    changed = df.withColumn("payload", F.when(third, "x").otherwise(F.col("payload")))
    assert faults(changed) == {(1, 3, "hash-mismatch")}
    # An event that is altered and hashed anew no longer fits the link that follows.
    again = changed.withColumn("event_hash", F.when(third, F.sha2(F.concat_ws("|", "previous_hash", F.sha2("payload", 256)), 256)).otherwise(F.col("event_hash")))
    assert faults(again) == {(1, 4, "link-mismatch")}
    assert faults(df.where("NOT (u = 2 AND i = 2)")) == {(2, 3, "sequence-gap"), (2, 3, "link-mismatch")}
    assert faults(df.withColumn("id", F.when((F.col("u") == 1) & (F.col("i") == 5), "e14").otherwise(F.col("id")))) == {(1, 5, "duplicate-id")}
    assert faults(df.withColumn("kind", F.when((F.col("u") == 2) & (F.col("i") == 4), "created").otherwise(F.col("kind")))) == {(2, 4, "second-start")}
    assert faults(df.withColumn("kind", F.lit("work"))) == {(1, 1, "missing-start"), (2, 1, "missing-start")}


def test_first_wins_and_upsert(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "k string, ord int, v string")
    assert {tuple(r) for r in rel.distinct_on(df, ["k"], [F.col("ord")]).collect()} == {("a", 1, "x"), ("b", 1, "z")}
    new = spark.createDataFrame([("b", 9, "new"), ("c", 9, "new")], df.schema)
    assert {r["v"] for r in rel.upsert(df, new, ["k"]).where("k = 'b'").collect()} == {"new"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_normal_paths(spark):
    cases = {"a/b/c/d/../../../../x": "x", ".github/../x": "x", "a//b/./c/": "a/b/c", "../a/../../b": "../../b", "": ".", "https://host/a/../b?q#f": "host/b", "a\\b": "a/b", "/": "."}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", X.normal_path(F.col("p")).alias("n")).collect()
    assert {r["p"]: r["n"] for r in rows} == cases


def test_batches(spark):
    """At most eight files and 256,000 bytes a batch, in order."""
    sizes = [100] * 9 + [200_000, 60_000, 300_000, 1]
    df = spark.createDataFrame([("s", "en", i, n) for i, n in enumerate(sizes)], "source string, lang string, doc_id bigint, bytes bigint")
    got = [r["batch"] for r in sorted(governance.packed(df, governance.BATCH_BYTES, governance.BATCH_FILES).collect(), key=lambda r: r["doc_id"])]
    assert got == [0] * 8 + [1, 1, 2, 3, 4]


def test_retrieval_tokens(spark):
    r = spark.createDataFrame([("getUserName of v2.HTMLPage 漢字",)], "t string").select(X.tokens(F.col("t")).alias("x")).first()
    assert r["x"] == ["get", "user", "name", "of", "v2", "htmlpage", "漢字"]


def test_redaction(spark):
    cases = {"password: two words": "password: [REDACTED]", "api_key = x=y": "api_key = [REDACTED]", "token: a = b": "token: a = [REDACTED]"}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", X.redacted(F.col("p")).alias("n")).collect()
    assert {r["p"]: r["n"] for r in rows} == cases
