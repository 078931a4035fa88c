"""Each operator against a brute-force version, SQL, an exact round trip or a property."""

import itertools
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from comparison import compare

from sparkloom.llm import hilbert, licenses, minhash, mixing, packing, queries, spherical, substring, token_output
from sparkloom.llm.common import table, written_folder

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, texts, source="src0"):
    return spark.createDataFrame([(i, t, "en", source, len(t)) for i, t in enumerate(texts)], COLUMNS)


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    assert compare(spark, queries.QUERIES[name], queries.ORACLES[name], sf_dir) == ""


def test_hilbert_neighbours(spark):
    bits, dims = 2, ["a", "b", "c", "d"]
    grid = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=4)), "a int, b int, c int, d int")
    keep = grid.selectExpr(*dims, *[f"{x} as {x}k" for x in dims])
    rows = sorted((r["hilbert"], r["ak"], r["bk"], r["ck"], r["dk"]) for r in hilbert.hilbert_index(keep, dims, bits).collect())
    assert [r[0] for r in rows] == list(range(256))
    assert all(sum(abs(x - y) for x, y in zip(p[1:], q[1:])) == 1 for p, q in zip(rows, rows[1:]))


def test_tokens_round_trip(spark, sf_dir):
    import pyarrow.parquet as pq
    from pathlib import Path

    docs = table(spark, sf_dir, "documents").limit(60)
    docs = docs.union(spark.createDataFrame([(-1, "", "en", "s", 0), (-2, None, "en", "s", 0), (-3, "a  b\n\n é 漢字 \U0001f600", "en", "s", 0)], docs.schema)).repartition(2).cache()
    path = token_output.default_vocabulary()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for encoding in ("delta", "dictionary"):
        folder = written_folder(spark, "tokens-test")
        token_output.write_tokens(token_output.tokenize(docs), folder, encoding)
        found = spark.read.parquet(folder)
        assert "text" not in found.columns
        rows = found.collect()
        assert len(rows) == len(texts)
        for r in rows:
            want = texts[r["doc_id"]]
            assert (r["token_ids"] is None) == (want is None)
            if want is not None:
                assert token_output.decode(r["token_ids"], path) == want and r["n_tokens"] == len(r["token_ids"])
        one = pq.ParquetFile(next(Path(folder.replace("file:", "")).glob("*.parquet"))).metadata.row_group(0)
        column = next(one.column(i) for i in range(one.num_columns) if one.column(i).path_in_schema.startswith("token_ids"))
        assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")
        assert column.has_column_index and column.has_offset_index


def test_ids_of_whole_texts(spark):
    """The ids are the library's for the whole text, whatever signs meet."""
    rng = random.Random(21)
    signs = list("aZ s dmtlvre'''\"  \t\n\r.,!?09é漢ß²½  \x1c\x85\u200b\U0001f600x-_")
    texts = ["", "it's we'll they've 'til ''s x'S  'd 'sun", " " * 9, "x" * 3000 + " y", "word " * 5000, *["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]]
    whole = token_output.encoding_of(token_output.default_vocabulary()).encode_ordinary
    rows = {r["doc_id"]: r["token_ids"] for r in token_output.tokenize(frame(spark, texts)).collect()}
    assert all(rows[i] == whole(t) for i, t in enumerate(texts))


def test_collisions_of_pieces():
    """Pieces of one hash are told apart by their bytes."""
    pieces = token_output.Pieces(token_output.encoding_of(token_output.default_vocabulary())._encode_single_piece)
    find = pieces.find
    pieces.find = lambda h: find(np.full_like(h, 5))
    pieces.enter(np.array([5], np.uint64), pieces.add([b"abc"]))
    n, ids = pieces.encode(np.frombuffer(b"abcabdab", np.uint8), np.array([0, 3, 6]))
    assert ids.tolist() == [*pieces.single(b"abc"), *pieces.single(b"abd"), *pieces.single(b"ab")]


def test_selective_reads(spark):
    """A filter on doc_id reads few row groups of the token files, and metadata are read without the ids."""
    from pathlib import Path

    import pyarrow.parquet as pq

    rng = random.Random(2)
    docs = frame(spark, [" ".join(prose(rng, 400)) for _ in range(3000)]).coalesce(1)
    folder = written_folder(spark, "tokens-test")
    token_output.write_tokens(token_output.tokenize(docs), folder, row_group_bytes=1 << 19)
    file = pq.ParquetFile(next(Path(folder.replace("file:", "")).glob("*.parquet")))
    groups, at = file.metadata.num_row_groups, file.schema_arrow.names.index("doc_id")
    hit = [g for g in range(groups) if (s := file.metadata.row_group(g).column(at).statistics).min <= 1500 <= s.max]
    assert groups > 3 and len(hit) == 1
    plan = spark.read.parquet(folder).where("doc_id = 1500").select("n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,1500)]" in plan and "token_ids" not in plan.split("ReadSchema")[1]


def test_shards_prune(spark, sf_dir):
    folder = written_folder(spark, "shards-test")
    docs = table(spark, sf_dir, "documents")
    hilbert.write_shards(docs, folder, 20_000)
    shards = spark.read.parquet(folder)
    assert shards.count() == docs.count() and shards.select("shard_id").distinct().count() > 5
    spans = shards.groupBy("shard_id").agg({"doc_id": "min", "source": "count"}).count()
    hit = shards.where("source = 'src3'").select("shard_id").distinct().count()
    assert hit < 0.6 * spans


def test_clean_in_other_scripts(spark):
    texts = ["这是一个完整的中文句子，没有任何问题。", "これは日本語の文章です。\n次の行もあります。", "यह एक वाक्य है।", "短い", "Accept all cookies\nAlle Rechte vorbehalten"]
    from sparkloom.llm import quality_rules

    assert {r["doc_id"] for r in quality_rules.clean(frame(spark, texts)).collect()} == {0, 1, 2}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    assert rows or name == "op10_license_scan"


def covered(texts, least):
    """(doc, word) of every word in a window of least words that occurs earlier."""
    first, out = {}, set()
    for d, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - least + 1):
            key = tuple(w[i : i + least])
            if key in first:
                out |= {(d, j) for j in range(i, i + least)}
            else:
                first[key] = d
    return out


@pytest.mark.parametrize("vocabulary", [400, 1_000_000])
def test_repeats(spark, vocabulary):
    """With few words, copies by chance go on one word further in a document that is neither the first nor the nearest:
    such single words at an edge may be left out (see the module). Without chance, the result is the brute force's."""
    rng = random.Random(3)
    prose = lambda r, n: [f"w{r.randrange(vocabulary)}" for _ in range(n)]
    shared = [prose(rng, n) for n in (50, 60, 120, 400)]
    texts = []
    for d in range(40):
        parts = [prose(rng, rng.randrange(5, 80))]
        for s in rng.sample(shared, rng.randrange(0, 3)):
            parts += [s, prose(rng, rng.randrange(0, 30))]
        texts.append(" ".join(sum(parts, [])))
    texts += [texts[3], texts[3] + " tail", "x " * 300, " ".join(shared[3] + shared[3])]
    rows = substring.repeats(frame(spark, texts)).collect()
    got, want = {(r["doc_id"], j) for r in rows for j in range(r["start_word"], r["start_word"] + r["n_words"])}, covered(texts, 50)
    assert got <= want and (got == want or vocabulary == 400 and len(got) > 0.998 * len(want))
    for r in rows:
        a, b = texts[r["doc_id"]].split(), texts[r["ref_doc_id"]].split()
        s, q, n = r["start_word"], r["ref_start_word"], r["n_words"]
        assert a[s : s + n] == b[q : q + n] and (r["ref_doc_id"], q) < (r["doc_id"], s)
        if set(a) == {"x"}:  # one word only: every place is on many diagonals, each extended by REACH
            continue
        assert s + n == len(a) or q + n == len(b) or a[s + n] != b[q + n]
        assert s == 0 or q == 0 or a[s - 1] != b[q - 1]
    kept = {r["doc_id"]: r["text"].split() for r in substring.remove(frame(spark, texts)).collect()}
    for d, t in enumerate(texts):
        assert kept.get(d, []) == [w for j, w in enumerate(t.split()) if (d, j) not in got]


def test_repeats_of_any_partner(spark):
    """The only aligned block of a 60-word repeat has a first and a nearest occurrence in shorter contexts; and few words, where many edges agree by chance."""
    rng = random.Random(12)
    fresh = lambda n: prose(rng, n, 1_000_000)
    long = fresh(60)
    stock = long[15:45]
    texts = [fresh(40), fresh(30) + stock + fresh(30), *[fresh(60) for _ in range(3)], fresh(33) + long + fresh(20), fresh(70), fresh(60), fresh(41) + stock + fresh(30), fresh(10) + long + fresh(25), fresh(30) * 9]
    few = [" ".join(sum((rng.choice(parts) for _ in range(8)), [])) for parts in [[prose(rng, n, 3) for n in (7, 11, 13, 17, 24)]] for _ in range(60)]
    for case in ([" ".join(t) for t in texts], few):
        rows = substring.repeats(frame(spark, case)).collect()
        got, want = {(r["doc_id"], j) for r in rows for j in range(r["start_word"], r["start_word"] + r["n_words"])}, covered(case, 50)
        assert want and got == want
        for r in rows:
            a, b, s, q, n = case[r["doc_id"]].split(), case[r["ref_doc_id"]].split(), r["start_word"], r["ref_start_word"], r["n_words"]
            assert a[s : s + n] == b[q : q + n] and (r["ref_doc_id"], q) < (r["doc_id"], s)


def test_packing(spark):
    rng = random.Random(5)
    sizes = [rng.choice([0, 1, 7, 300, 1000, 1500, 2048, 2049, 9000]) + rng.randrange(40) for _ in range(400)]
    docs = frame(spark, ["a " * n for n in sizes]).repartition(12)
    rows = packing.pack(docs).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append((r["bin_offset"], r["n_words"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    words = Counter()
    for r in rows:
        words[r["doc_id"]] += r["n_words"]
        assert r["start_word"] % packing.CAPACITY == 0
    assert words == Counter({i: n for i, n in enumerate(sizes) if n})
    assert len(bins) <= 1.03 * sum(sizes) / packing.CAPACITY + 2
    again = packing.pack(docs.repartition(3)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)), "the bins don't depend on how rows are split"


def test_packing_of_what_fits_nowhere(spark):
    """Documents above half of the capacity are bins of their own; none of them goes up the tree."""
    rows = packing.pack(frame(spark, ["a " * n for n in (1100, 1200, 1300) * 50])).collect()
    assert len({r["bin_id"] for r in rows}) == len(rows) == 150


def test_best_fit():
    rng = random.Random(2)
    for _ in range(50):
        sizes = sorted((rng.randrange(1, 60) for _ in range(40)), reverse=True)
        free, got = [], packing.best_fit(sizes, 60)
        for s in sizes:  # the fullest bin with room
            fit = [i for i, f in enumerate(free) if f >= s]
            i = min(fit, key=lambda i: free[i]) if fit else len(free)
            free[i:] = free[i:] or [60]
            free[i] -= s
        assert sorted(60 - sum(sizes[i] for i in b) for b in got) == sorted(free)


def near_classes(ids, v):
    """{id: (least id of its component, number of near ids)} by all pairs."""
    v = np.asarray(v, np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= spherical.THRESHOLD
    np.fill_diagonal(near, False)
    root = list(range(len(ids)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in zip(*np.nonzero(near)):
        a, b = sorted((find(i), find(j)), key=lambda x: ids[x])
        root[b] = a
    return {ids[i]: (ids[find(i)], int(near[i].sum())) for i in range(len(ids))}


VECTORS = "vec_id bigint, embedding array<float>"


def test_caps(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((700, 48))
    near = [base[i] / np.linalg.norm(base[i]) + rng.standard_normal(48) * s / math.sqrt(48) for i in range(150) for s in (0.2, 0.4, 0.45)]
    v = np.concatenate([base, near, base[:20]]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9000, None), (9001, [0.0] * 48), (9002, [float("nan")] * 48), (None, v[0].tolist()), (9003, [1.0]), (9004, []), (0, v[0].tolist())]
    found = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in spherical.classes(spark.createDataFrame(rows, VECTORS)).collect()}
    want = near_classes(range(len(v)), v)
    assert found.pop(9003) == (9003, 0) and set(found) == set(want)
    linked = sum(n for _, n in want.values())
    assert linked > 400 and sum(n for _, n in found.values()) >= 0.9 * linked
    assert all(found[i][1] <= want[i][1] for i in want) and sum(found[i] == want[i] for i in want) >= 0.95 * len(want)


def test_caps_of_a_large_group(spark, monkeypatch):
    """A third of all vectors are near copies of one, in filters of several tiles: no link is lost and each is counted."""
    monkeypatch.setattr(spherical, "TILE", 64)
    rng = np.random.default_rng(9)
    one = rng.standard_normal(32)
    group = one + 0.12 * rng.standard_normal((400, 32))
    v = np.concatenate([rng.standard_normal((800, 32)), group, np.repeat(one[None], 50, 0)]).astype(np.float32)
    found = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in spherical.classes(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], VECTORS)).collect()}
    assert found == near_classes(range(len(v)), v)


def test_caps_of_several_lengths(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for dim, n in ((48, 200), (32, 150), (3, 12), (2, 6), (1, 3)):
        base = rng.standard_normal((n, dim))
        v = np.concatenate([base, base + 0.2 * rng.standard_normal((n, dim)), base[:2]]).astype(np.float32)
        want |= {i: (c, k, dim) for i, (c, k) in near_classes(range(len(rows), len(rows) + len(v)), v).items()}
        rows += [(len(rows) + i, x.tolist()) for i, x in enumerate(v)]
    found = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in spherical.classes(spark.createDataFrame(rows, VECTORS)).collect()}
    assert set(found) == set(want) and all(found[i][1] <= want[i][1] for i in want)
    for dim in (48, 32, 3, 2, 1):
        own = {i for i, x in want.items() if x[2] == dim}
        assert sum(found[i][1] for i in own) >= 0.9 * sum(want[i][1] for i in own) > 0


def test_caps_in_rounds(spark, monkeypatch):
    """One rotation at a time, codes in a projection, filters of several tiles."""
    monkeypatch.setattr(spherical, "ROUND", 1)
    monkeypatch.setattr(spherical, "FOLD", 24)
    monkeypatch.setattr(spherical, "TILE", 64)
    rng = np.random.default_rng(12)
    base = rng.standard_normal((600, 64))
    v = np.concatenate([base, base[:200] + 0.4 * rng.standard_normal((200, 64)), base[0] + 0.12 * rng.standard_normal((200, 64))]).astype(np.float32)
    found = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in spherical.classes(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], VECTORS)).collect()}
    want = near_classes(range(len(v)), v)
    assert set(found) == set(want) and all(found[i][1] <= want[i][1] for i in want)
    single = [i for i, (_, k) in want.items() if k == 1]
    assert len(single) > 200 and sum(found[i] == want[i] for i in single) >= 0.9 * len(single)
    assert all(found[i] == want[i] for i in want if want[i][1] > 100)


def test_caps_plan_in_bounded_memory():
    """The driver's plan: a million vectors, 15 million (6 GB), 80 million (30 GB), and very long ones."""
    for n, dim in ((1_000_000, 64), (15_000_000, 64), (80_000_000, 64), (1_000_000, 4096)):
        tracemalloc.start()
        p = spherical.plan(n, dim, spherical.THRESHOLD, spherical.RECALL, 11)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200e6, (n, dim, peak)
        assert n * p["filters"] / math.prod(p["sides"]) < 4 * spherical.FILL and p["filters"] < 8, (n, dim, p["filters"])


def shingled(text):
    w = re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return Counter(zip(w, w[1:])) if len(w) > 1 else Counter((x,) for x in w)


def similarities(texts):
    sets = [shingled(t) for t in texts]
    df = Counter(x for s in sets for x in s)
    weight = [{k: n * math.log(1 + len(texts) / df[k]) for k, n in s.items()} for s in sets]
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = weight[i], weight[j]
        low = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
        yield i, j, low / (sum(a.values()) + sum(b.values()) - low)


def near_texts():
    rng = random.Random(8)
    texts = [" ".join(prose(rng, rng.randrange(30, 200), 3000)) for _ in range(60)]
    for i in range(25):
        w = texts[i].split()
        for _ in range(max(1, len(w) // 25)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    return texts + texts[:10] + [texts[0].upper()] * 30 + ["one", "one", "", "two words"]


def test_groups(spark):
    texts = near_texts()
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    values = []
    for i, j, s in similarities([t for t in texts if t]):
        values.append(s)
    live = [i for i, t in enumerate(texts) if t]
    for (i, j, s) in similarities([texts[i] for i in live]):
        if s >= minhash.THRESHOLD:
            a, b = sorted((find(live[i]), find(live[j])))
            root[b] = a
    assert not any(0.4 < s < 0.6 for s in values), "the fixture is clear-cut"
    got = {r["doc_id"]: r["duplicate_of"] for r in minhash.groups(frame(spark, texts)).collect()}
    assert got == {i: find(i) for i in live if find(i) != i}
    kept = {r["doc_id"] for r in minhash.deduplicate(frame(spark, texts)).collect()}
    assert kept == set(range(len(texts))) - set(got)


def test_recall_near_threshold(spark):
    """Pairs of similarity 0.5 and a little above, each apart from all others, so nothing but their own bands finds them."""
    rng = random.Random(14)
    texts = []
    for _ in range(400):
        w = prose(rng, rng.randrange(80, 140), 1_000_000)
        other = list(w)
        for i in rng.sample(range(1, len(w) - 1, 2), round(len(w) * rng.uniform(0.12, 0.15))):
            other[i] = f"c{rng.randrange(1_000_000)}"
        texts += [" ".join(w), " ".join(other)]
    want = {(j, i): s for i, j, s in similarities(texts) if s >= minhash.THRESHOLD}
    got = {(r["doc_id"], r["duplicate_of"]) for r in minhash.groups(frame(spark, texts)).collect()}
    low = {p for p, s in want.items() if s < 0.56}
    assert len(low) > 200 and got <= set(want)
    assert len(low & got) >= 0.9 * len(low) and len(got) >= 0.9 * len(want), (len(low & got), len(low), len(got), len(want))


def test_bucket_of_many(spark):
    """Every pair of a large bucket whose components differ is compared, whatever the least doc_id is like."""
    rng = random.Random(1)
    a = prose(rng, 200, 5000)
    texts = [" ".join(a[:k] + prose(rng, 200 - k, 5000)) for k in (120, 110, 100)] + [" ".join(a)] * 200
    got = {r["doc_id"]: r["duplicate_of"] for r in minhash.groups(frame(spark, texts)).collect()}
    assert all(i in got for i in range(4, 203))


def test_flow():
    for a, b, c, q1, q2 in itertools.product((0, 1, 3), (0, 2), (0, 1, 2), (0, 2, 5), (1, 4)):
        flow = mixing.min_cost_flow({1: a, 2: b, 3: c}, [q1, q2], 2)
        cost = lambda x, s: max(0, x - s)
        best = min(((-(x + y + z + w), cost(x, a) + cost(y, b) + cost(z + w, c)) for x in range(2 * a + 1) for y in range(2 * b + 1) for z in range(2 * c + 1) for w in range(2 * c + 1 - z) if x + z <= q1 and y + w <= q2))
        got = (-sum(flow.values()), sum(cost(flow.get(p, 0), s) for p, s in ((1, a), (2, b), (3, c))))
        assert got == best


def test_flow_of_many_sources():
    """16 sources and every pattern of them: the flow meets all quotas that it can, and repeats nothing before all is used once."""
    supply = {p: 1 + p % 7 for p in range(1, 1 << 12)}
    total = sum(supply.values())
    flow = mixing.min_cost_flow(supply, [total // 12] * 12, 4)
    assert sum(flow.values()) == total // 12 * 12 and all(flow[p] <= supply[p] for p in flow)
    flow = mixing.min_cost_flow(supply, [total // 6] * 12, 4)
    assert sum(flow.values()) == total // 6 * 12 and all(supply[p] <= flow[p] <= 2 * supply[p] for p in flow)


def test_mixing_meets_quotas(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chosen = mixing.selected(docs).collect()
    supply = Counter()
    for r in docs.collect():
        n = len(re.findall(r"[^ \t\n\r\x0b\x0c]+", r["text"]))
        k = int(r["source"][3:])
        supply[(k < 10) * 1 | (10 <= k < 15) * 2 | (k >= 15) * 4 | (r["lang"] != "en") * 8 | (n >= 1000) * 16] += n
    total = sum(supply.values())
    flow = mixing.min_cost_flow(supply, [int(total * w) for w in mixing.WEIGHTS.values()], mixing.EPOCHS)
    got = Counter()
    for r in chosen:
        got[r["__pattern"]] += r["__words"] * r["__copies"]
        assert 1 <= r["__copies"] <= mixing.EPOCHS
    longest = max(r["__words"] for r in chosen)
    for p, f in flow.items():
        assert f - longest <= got[p] <= f
    assert sum(r["__copies"] for r in chosen) == mixing.mixed(docs).count()


def test_short_templates(spark):
    short = {"two": "MIT License", "four": "Released under MIT License"}
    texts = ["This is under the MIT license today", "Released under MIT License", "no licence", "MIT", "license MIT"]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(frame(spark, texts), short).collect()}
    assert got == {(0, "two"), (1, "two"), (1, "four")}
    with pytest.raises(ValueError):
        licenses.scan(frame(spark, texts), {"one": "MIT"})


def test_licenses(spark):
    rng = random.Random(6)
    texts, want = [], set()
    for name, template in licenses.TEMPLATES.items():
        for k in range(3):
            w = template.split()
            if k == 2 and len(w) > 40:
                w[len(w) // 2] = "altered"
            texts.append(" ".join(prose(rng, rng.randrange(0, 40)) + w + prose(rng, 30)))
            want.add((len(texts) - 1, name))
    texts += [" ".join(prose(rng, 500)), "license", ""]
    words = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", t.lower())
    every = set()
    for d, t in enumerate(texts):
        own = words(t)
        for name, template in licenses.TEMPLATES.items():
            m = words(template)
            s, slack = set(zip(m, m[1:])), max(2, len(m) // 5)
            for i in range(-slack, len(own)):
                part = own[max(0, i - slack) : i + len(m) + slack]
                if len(s & set(zip(part, part[1:]))) >= licenses.CONTAINMENT * len(s):
                    every.add((d, name))
                    break
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(frame(spark, texts)).collect()}
    assert want <= got <= every and len(got) >= 0.9 * len(every)
