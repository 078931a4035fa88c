"""The pipeline against a brute-force version on a small fixture."""

import random
from collections import Counter

import corpus_pipeline
import duckdb
import pandas as pd
from test_brute_force import COLUMNS, covered, prose, similarities

from sparkloom.llm import minhash, mixing, packing, quality_rules
from sparkloom.llm.common import written_folder


def corpus():
    rng = random.Random(9)
    sentence = lambda n: " ".join(prose(rng, n, 1_000_000)).capitalize() + "."
    passage = sentence(90)
    texts = ["\n".join(sentence(rng.randrange(8, 30)) for _ in range(rng.randrange(2, 8))) for _ in range(80)]
    texts += [t + "\n" + sentence(9) for t in texts[:12]] + texts[:8]
    texts += [sentence(40) + "\n" + passage + "\n" + sentence(30) for _ in range(6)]
    texts += ["Home | About | Contact | More\n" * 5 + sentence(12), "click here\n" * 9, "", "%%%%% ##### @@@@@ !!!!!"]
    return [(i, t, "en" if i % 3 else "fr", f"src{i % 20}", len(t)) for i, t in enumerate(texts)]


def test_against_brute_force(spark, tmp_path):
    rows = corpus()
    folder = written_folder(spark, "pipeline-test")
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    clean = {r[0]: r[1] for r in duckdb.sql(quality_rules.clean_sql()).fetchall()}
    ids = sorted(clean)
    root = {i: i for i in ids}
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j, s in similarities([clean[i] for i in ids]):
        assert not 0.42 < s < 0.58, "the fixture is clear-cut"
        if s >= minhash.THRESHOLD:
            a, b = sorted((find(ids[i]), find(ids[j])))
            root[b] = a
    kept = [i for i in ids if find(i) == i]
    gone = covered([clean[i] for i in kept], 50)
    words = {i: [w for j, w in enumerate(clean[i].split()) if (k, j) not in gone] for k, i in enumerate(kept)}
    words = {i: w for i, w in words.items() if w}

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.written(stage(spark, docs, folder), "test")
    assert {r["doc_id"]: r["text"].split() for r in docs.collect()} == words
    copies = Counter({r["doc_id"]: r["__copies"] for r in mixing.selected(docs).collect()})
    packed = corpus_pipeline.run(spark, folder).collect()
    total = Counter()
    for r in packed:
        total[r["doc_id"]] += r["n_words"]
    assert total == Counter({i: n * len(words[i]) for i, n in copies.items()})
    fill = Counter()
    for r in packed:
        fill[r["bin_id"]] += r["n_words"]
    assert max(fill.values()) <= packing.CAPACITY
