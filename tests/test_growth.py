"""What keeps queries within their limits on large tables: that work isn't done twice, and that intermediate rows grow with the input."""

import random

import pytest
from comparison import compare
from pyspark.sql import functions as F

from sparkloom import catalog
from sparkloom.functions import text as X
from sparkloom.functions.rules import may_match, required, telling
from sparkloom.operators import graph
from sparkloom.plans import program, scans, views


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


LINES = [
    "import Home from './Home'", "import './style.css'", "const x = require('../store')", "import('./x')", "import java.util.List;", "from app import x", '"fmt"', "use std::io;", "class A extends B", "function f()", "const f = async (x)", "type Props = {", "record P", "async def f(x)", "func (s) Serve(x)",
    "pub struct S", "export default class Z", "export const q = 1", "{ path: '/home' }", '<Route a="b" path="/cart">', "app.get('/users', list)", "@GetMapping(value = \"/x\")", "<user-card>", "@Service", "router.push('/done')", "axios.post('/a')", "createRoot(node)", "createApp(App)", "<button>", "onClick={save}", "@click=",
    "toast.success('saved')", 'role="alert"', "setTotal(1)", "commit('cart/add')", "beforeEach", "navigate('/x')", "await load()", ".then(", "describe('x'", "data: {", "emit('saved')", "v-if=", "ref(count)", "a plain sentence, nothing else", "", "LOCALHOST", "console.log(", "debugger", "?Token=", "TODO", "todo", "http://x",
]


def test_words_lose_no_match(spark):
    """Whatever a pattern matches has its words, in each of the rule tables."""
    patterns = [f[3] for f in scans.FACTS] + [r[-1] for r in X.LINE_RULES + X.QUALITY_RULES]
    said = spark.createDataFrame([(x,) for x in LINES], "t string").select(F.array(*[F.col("t").rlike(p) for p in patterns]).alias("hit"), F.array(*[may_match(F.col("t"), p) for p in patterns]).alias("may"), "t").collect()
    assert [(r["t"], p) for r in said for p, hit, may in zip(patterns, r["hit"], r["may"]) if hit and not may] == []
    assert sum(any(r["hit"]) for r in said) >= len(LINES) - 2
    words = telling([f[3] for f in scans.FACTS])
    assert [r["t"] for r in said if any(r["hit"][: len(scans.FACTS)]) and not any(w in r["t"] for w in words)] == []
    assert required("(?i)a?(?:bc|de)+f") == ([["bc", "de"], ["f"]], True)


def test_patterns_are_tried_once(spark):
    """Before, Spark worked out what is exploded a second time to test its size."""
    df = spark.createDataFrame([("r", 1, "a/x.ts", "import A from './a'\nfoo")], "repo string, file_id bigint, path string, text string")
    for found in (scans.facts(scans.code_lines(df)), scans.hits(df, X.LINE_RULES)):
        assert "size(" not in plan(found)
    assert [r["name"] for r in scans.facts(scans.code_lines(df)).collect()] == ["./a"]


def test_facts_are_read_once(spark, sf_dir):
    """Queries over several uses of the facts don't scan the texts for each."""
    for name in ("handler_bindings", "request_dependants", "unknowns", "resolved_imports", "import_resolution_rate"):
        assert "content#" not in plan(catalog.QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["change_map", "community_members", "atlas_degrees", "change_sets", "domain_relations"])
def test_counts_need_no_pairs(spark, sf_dir, monkeypatch, name):
    """What is counted over tests' edges follows from the sizes of stems; before, all pairs of a stem's files were built and written."""

    def never(*_):
        raise AssertionError("pairs are built")

    monkeypatch.setattr(program, "paired", never)
    monkeypatch.setattr(views, "paired", never)
    assert compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], sf_dir) == ""


def test_pairs_are_not_written(spark, sf_dir):
    """The pairs of a stem are a stream: above their join the plan has no exchange."""
    own = spark.createDataFrame([("r", "a/x.test.ts", "t1", "x", "c", True), ("r", "a/x.ts", "m1", "x", "c", False), ("r", "b/x.ts", "m2", "x", "d", False), ("r", "b/y.ts", "m3", "y", "d", False)], "repo string, path string, node_id string, stem string, community string, is_test boolean")
    got = program.paired(own)
    assert sorted((r["src"], r["dst"]) for r in got.collect()) == [("t1", "m1"), ("t1", "m2")]
    above = got._jdf.queryExecution().sparkPlan().toString().split("Join")[0]
    assert "Exchange" not in above and "Aggregate" not in above
    skip = spark.createDataFrame([("t1", "m2")], "src string, dst string")
    assert [(r["src"], r["dst"]) for r in program.paired(own, skip).collect()] == [("t1", "m1")]


def test_ancestors(spark):
    """Against a walk from each subject, with cycles, and with hubs of any size."""
    rnd = random.Random(3)
    pairs = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(70)} | {(i, 50) for i in range(12)} | {(50, 60), (60, 51), (51, 61)}
    want = {}
    for s in range(62):
        seen, todo = {s}, [s]
        while todo:
            x = todo.pop()
            for a, b in pairs:
                if b == x and a not in seen:
                    seen.add(a)
                    todo.append(a)
        want[f"n{s}"] = len(seen - {50} | {s}) - 1
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    subjects = spark.createDataFrame([(k,) for k in want if k != "n50"], "subject string")
    for hub in (2, 64):
        got = {r["subject"]: r["n"] for r in graph.ancestors(edges, subjects, F.col("node") == "n50", hub).collect()}
        assert got == {k: v for k, v in want.items() if k != "n50"}


def test_scores_are_not_sorted(spark, sf_dir):
    """Each task gives the best of its documents; before, the score of every query and document was shuffled and sorted."""
    df = catalog.QUERIES["retrieval_rank"](spark, sf_dir)
    assert "MapInArrow" in plan(df) and "Join" not in plan(df)
    for name in ("retrieval_rank", "hit_at_k_mrr"):
        assert compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], sf_dir) == ""


def test_journeys_shuffle_no_texts(spark, sf_dir):
    """Only the beginning of a turn's text is asked for; before, the whole text went through each exchange."""
    assert "substring(text" in plan(catalog.QUERIES["journey_reasons"](spark, sf_dir))
