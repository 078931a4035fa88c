"""Manifests, code facts, paths and streams on small fixtures."""

from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import log
from sparkloom.sources import manifests
from sparkloom.sources.tables import table
from sparkloom.streaming import replay

MANIFESTS = {
    "a/package.json": '{"name": "a", "dependencies": {"left": "^1.0", "@s/right": "2.x"}, "devDependencies": {"t": "3"}}',
    "b/requirements.txt": "# note\nnumpy==2.0\nrequests[socks] >= 2.1 ; python_version > '3'\nplain\n",
    "c/go.mod": "module example.com/c\n\ngo 1.22\n\nrequire (\n\tgithub.com/x/y v1.2.3\n)\nrequire golang.org/x/net v0.1.0\n",
    "d/Cargo.toml": '[package]\nname = "d"\n\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.3", features = ["full"] }\n\n[dev-dependencies]\nquick = "0.2"\n',
    "e/pom.xml": "<project><dependencies><dependency><groupId>g</groupId><artifactId>core</artifactId><version>5.1</version></dependency></dependencies></project>",
    "f/App.csproj": '<Project><ItemGroup><PackageReference Include="Json" Version="13.0" /></ItemGroup></Project>',
    "g/Gemfile": "gem 'rails', '~> 7'\ngem 'puma'\n",
    "h/build.gradle": "dependencies {\n  implementation 'org.x:lib:1.1'\n}\n",
    "i/composer.json": '{"require": {"v/p": "^8"}}',
    "j/package.json": "not json",
    "k/readme.md": "x",
}


def test_dependencies(spark):
    got = {tuple(r) for r in manifests.dependencies(spark.createDataFrame(list(MANIFESTS.items()), "path string, text string")).select("path", "name", "version", "scope").collect()}
    d = "dependencies"
    assert got == {
        ("a/package.json", "left", "^1.0", d), ("a/package.json", "@s/right", "2.x", d), ("a/package.json", "t", "3", "devDependencies"), ("b/requirements.txt", "numpy", "==2.0", d), ("b/requirements.txt", "requests", ">= 2.1", d), ("b/requirements.txt", "plain", "", d),
        ("c/go.mod", "github.com/x/y", "v1.2.3", d), ("c/go.mod", "golang.org/x/net", "v0.1.0", d), ("d/Cargo.toml", "serde", "1.0", d), ("d/Cargo.toml", "tokio", "1.3", d), ("d/Cargo.toml", "quick", "0.2", "devDependencies"),
        ("e/pom.xml", "core", "5.1", d), ("f/App.csproj", "Json", "13.0", d), ("g/Gemfile", "rails", "~> 7", d), ("g/Gemfile", "puma", "", d), ("h/build.gradle", "org.x:lib", "1.1", d), ("i/composer.json", "v/p", "^8", d),
    }


def test_paths(spark):
    cases = {"./a/../b//c": "b/c", "http://h/x?q#f": "h/x", "a\\b\\": "a/b", "": ".", "/": "."}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", X.normal_path(F.col("p"))).collect()} == cases


def test_fnv(spark):
    def fold(s):
        h, out = 2166136261, ""
        for c in s:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        while h:
            h, r = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
        return out

    texts = ["", "a", "héllo", "漢字", "\U0001f600 x"]
    assert {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.fnv1a32(F.col("t"))).collect()} == {t: fold(t) for t in texts}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "events")
    events = table(spark, sf_dir, "events")
    events.repartition(3).write.parquet(folder)
    stream = replay.running_state(replay.event_stream(spark, folder, 1))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("state").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = log.latest(events, ["user_id"], ["event_id"], ["event_type", "props"])
    assert sorted(map(tuple, spark.table("state").collect())) == sorted(map(tuple, want.collect()))
    counts = replay.windowed_counts(replay.event_stream(spark, folder))
    q = counts.writeStream.outputMode("update").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("hours").agg(F.sum("events")).first()[0] == events.count()
    q = replay.write_view(replay.first_arrivals(replay.event_stream(spark, folder)), str(tmp_path / "out"), str(tmp_path / "c3"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_stores(spark, tmp_path):
    import json

    from sparkloom.sources import stores

    rows = [("c1", "a", 0.5), ("c2", None, 1.0), ("c3", "é\n\"x\"", 0.0)]
    df = spark.createDataFrame(rows, "claim_id string, object string, confidence double")
    path = str(tmp_path / "claims")
    stores.write_lines(df, path)
    assert sorted(map(tuple, stores.read_lines(spark, path, df.schema).collect())) == sorted(rows)
    stores.append_lines(df, path)
    assert stores.read_lines(spark, path, df.schema).count() == 6
    bad = df.where("confidence > 0.9").selectExpr("claim_id AS subject", "'TOO_SURE' AS issue")
    try:
        stores.write_checked(df, [bad], str(tmp_path / "never"))
        raise AssertionError
    except stores.Invalid as e:
        assert "TOO_SURE" in str(e)
    assert not (tmp_path / "never").exists()
    folder = tmp_path / "analyses"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([{"id": "1", "claim": "x"}, {"id": "2", "claim": "y"}], indent=2))
    (folder / "b.json").write_text(json.dumps({"id": "3", "claim": None}, indent=2))
    assert sorted(r["id"] for r in stores.read_documents(spark, str(folder), "id string, claim string").collect()) == ["1", "2", "3"]
    assert stores.first_existing(spark, [str(tmp_path / "no"), path]) == path


def test_embedded_json(spark):
    from sparkloom.sources import stores

    cases = {"a ```json\n{\"k\": 1}\n``` b": '{"k": 1}', "x [1, 2] y": "[1, 2]", "x {\"k\": {\"j\": 2}} y": '{"k": {"j": 2}}', "nothing": None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", stores.embedded_json(F.col("t")).alias("j")).collect()
    assert {r["t"]: r["j"] for r in rows} == cases
