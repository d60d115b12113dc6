import pytest

from skein.operators import extract, lookup, retrieval
from skein.operators.retrieval import Index
from skein.sources.files import Settings, demo_sources
from skein.streaming import reindex


def test_index_search_and_ask(spark):
    p = extract.entities(demo_sources(spark))
    i = Index(spark)
    assert sum(r["count"] for r in i.add(p).collect()) == i.chunks.count()
    n = i.chunks.count()
    i.add(p)
    assert i.chunks.count() == n
    got = i.search("Which function sums cart prices", k=3).collect()
    assert 0 < len(got) <= 3 and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert all(r.entity_type == "function" for r in i.search("login", entity_type="function").collect())
    a = i.ask("Where do people log in?")
    assert a["answer"].startswith("[mock]") and a["sources"]


def test_persistent_index(spark, tmp_path):
    i = Index(spark, str(tmp_path / "i"))
    i.add(extract.entities(demo_sources(spark)))
    assert i.chunks.count() > 4


def test_rerank_and_context(spark):
    c = spark.createDataFrame([("a", "alpha beta", "alpha"), ("b", "gamma", "x"), ("c", "z" * 500, "y")], "chunk_id string, content string, entity_name string")
    q = spark.createDataFrame([(1, "alpha beta")], "query_id int, text string")
    f = spark.createDataFrame([(1, "b", 0.02, 1), (1, "a", 0.01, 2), (1, "c", 0.005, 3)], "query_id int, chunk_id string, score double, rank int")
    assert [r.chunk_id for r in retrieval.rerank(f, c, q).orderBy("rank").collect()] == ["a", "b", "c"]
    assert retrieval.contexts(f, c, 300).first().context == "gamma\n---\nalpha beta\n---\n" + "z" * 285 + "..."


def test_questions():
    assert lookup.parse_question("Find all functions named Foo") == ("function", "foo")
    assert lookup.parse_question("list all classes that inherit from ABC") == ("inherit", "abc")
    assert lookup.parse_question("what is this") == ("search", "what is this")
    assert "## A" in lookup.render({"a": [1, 2]}, "markdown") and lookup.render({"a": 1}) == '{\n  "a": 1\n}'
    assert "Question: q" in retrieval.format_prompt("nope", "q", "c")


def test_settings(tmp_path):
    s = Settings(profile="engine", security=False)
    s.save(str(tmp_path / "s.json"))
    assert Settings.load(str(tmp_path / "s.json"), {}) == s
    assert Settings.load(None, {"SKEIN_SECURITY": "false"}).security is False


def test_stream(spark, tmp_path):
    d = spark.createDataFrame([("a.py", "def f(x):\n    return eval(x)\n", "1")], reindex.SOURCE)
    d.write.parquet(str(tmp_path / "in"))
    q = reindex.watch(reindex.source_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [r.call for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["eval"]


def test_driver_helpers():
    from skein.functions.driver import parallel_map, timed_cache, timer

    calls = []
    f = timed_cache(60)(lambda x: calls.append(x) or x)
    assert f(1) == f(1) == 1 and calls == [1]
    assert parallel_map(lambda x: 1 // x, [1, 0, 2]) == [1, None, 0]
    with timer("t") as t:
        pass
    assert t["seconds"] >= 0


def test_index_is_opened_again_and_replaced_in_place(spark, tmp_path):
    at, p = str(tmp_path / "i"), extract.entities(demo_sources(spark))
    assert not Index(spark, at).is_indexed() and Index(spark, at).stats().count() == 0
    Index(spark, at).add(p.where("file_path like '%cart%'"))
    again = Index(spark, at)
    first = again.chunks.count()
    again.add(p)
    assert again.chunks.count() == again.chunks.select("chunk_id").distinct().count() > first
    assert len(list((tmp_path / "i").iterdir())) == 1  # the old version is gone
    Index(spark, at).add(p.where("file_path like '%flow%'"), clear=True)
    assert {r.file_path for r in Index(spark, at).chunks.collect()} == {"shop/flow.py"}
    again.clear()
    assert not Index(spark, at).is_indexed()


def test_settings_factories_and_models(spark):
    s = retrieval.RetrievalSettings.of(embedder="mock", dimension=8, nonsense=1, top_k=3)
    assert s.to_dict()["top_k"] == 3 and s.store == "table"
    for bad in ({"embedder": "nope"}, {"model": "nope"}, {"store": "nope"}):
        with pytest.raises(ValueError):
            retrieval.Index(spark, settings=retrieval.RetrievalSettings(**bad))
    assert retrieval.model_for(retrieval.RetrievalSettings(model="openai")).name == "mock-model"
    assert isinstance(retrieval.store_for(spark, retrieval.RetrievalSettings(store="memory", path="x")), retrieval.MemoryStore)

    class Loud:
        name = "loud"

        def generate(self, prompt, context=""):
            return prompt.upper()

        def generate_stream(self, prompt, context=""):
            yield from prompt.upper().split(" ")

    retrieval.MODELS["loud"] = lambda s: Loud()
    try:
        i = Index(spark)
        i.add(extract.entities(demo_sources(spark)))
        assert i.model.name == "loud"  # what is registered goes before the mock
        a = i.ask("Which function sums prices?")
        assert "QUESTION: WHICH FUNCTION SUMS PRICES?" in a["answer"]
        assert " ".join(i.ask_stream("Which function sums prices?")) == a["answer"]
        assert list(i.ask_stream("zzz", threshold=2.0)) == [retrieval.NOTHING] and i.ask("zzz", threshold=2.0)["sources"] == []
    finally:
        del retrieval.MODELS["loud"]
    assert retrieval.MockModel().generate("q", "[class] A\nx\n[b] c") == "[mock] q\n[class]\n[b]"


def test_queries_in_blocks(spark, monkeypatch):
    c = spark.createDataFrame([(str(i), [float(i % 7), 1.0], f"alpha w{i}") for i in range(30)], "chunk_id string, embedding array<double>, content string")
    q = spark.createDataFrame([(i, [float(i), 2.0], f"alpha w{i}") for i in range(9)], "query_id int, embedding array<double>, text string")
    get = lambda: (sorted(map(str, retrieval.semantic(c, q, 3, -1.0).collect())), sorted(map(str, retrieval.keyword(c, q, 3).collect())))
    want = get()
    monkeypatch.setattr(retrieval, "MANY_QUERIES", 2)
    assert get() == want and len(want[0]) == 27


def test_command_line(spark, tmp_path, capsys):
    from skein.plans import cli
    from skein.sources.files import DEMO

    for p, t in DEMO.items():
        (tmp_path / "src" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / p).write_text(t)
    src, store = str(tmp_path / "src"), str(tmp_path / "store")
    assert cli.main(["init", str(tmp_path / "skein.json")]) == 0 and cli.main(["init", str(tmp_path / "skein.json")]) == 1
    assert cli.main(["rag", "stats", "--store", store]) == 1
    assert cli.main(["rag", "index", src, "--store", store, "-f", "json"]) == 0
    assert '"class": 1' in capsys.readouterr().out
    assert cli.main(["rag", "ask", "Where do people log in?", "--store", store, "-f", "json"]) == 0 and "[mock]" in capsys.readouterr().out
    assert cli.main(["rag", "search", "cart", "--store", store, "--top", "2", "--entity", "class", "-f", "json"]) == 0 and '"Cart"' in capsys.readouterr().out
    assert cli.main(["rag", "clear", "--store", store]) == 0 and cli.main(["rag", "stats", "--store", store]) == 1
    for what, has in (("summary", "Code Analysis Report"), ("metrics", "cyclomatic"), ("analyze", "code_injection")):
        assert cli.main([what, src]) == 0 and has in capsys.readouterr().out
    assert cli.main(["query", src, "find class Cart", "-f", "json", "-o", str(tmp_path / "o.json")]) == 0 and "Cart" in (tmp_path / "o.json").read_text()


def test_functions_settings_and_cache(spark, tmp_path):
    import skein.api as api
    from skein.plans.engine import Engine

    f = tmp_path / "a.py"
    f.write_text('"""A."""\nPASSWORD = "letmein-now"\n\n\ndef go(x):\n    """Go."""\n    return eval(x)\n')
    assert api.metrics_of(f, spark).first().cyclomatic == 1 and api.parse_file(f, spark).count() == 1
    assert {r.kind for r in api.security_of(tmp_path, spark).collect()} >= {"password", "code_injection"}
    assert set(api.patterns_of(f, spark)) == {"design_patterns", "anti_patterns", "smells"}
    assert api.query_code(f, "find function go", spark).count() == 1 and "Issues Found" in api.summary_of(f, spark=spark)
    assert '"issues"' in api.summary_of(f, "json", spark) and api.errors_of(f, spark).count() == 0 and api.parse_code("x = 1", spark=spark).count() == 1
    Settings(profile="engine").save(str(tmp_path / "skein.json"))
    assert Settings.discover(tmp_path, {}).profile == "engine" and Settings.discover(tmp_path / "none", {"SKEIN_PROFILE": "x"}).profile == "x"

    e = Engine(spark, parse_cache=True)
    one = spark.createDataFrame([("a.py", "x = 1"), ("b.py", "y = 2")], "file_path string, content string")
    two = spark.createDataFrame([("a.py", "x = 1"), ("b.py", "def f():\n    pass"), ("c.py", "")], "file_path string, content string")
    assert e.analyze(one).parsed.count() == 2 and e.cache.info() == {"size": 2}
    assert {r.file_path: len(r.callables) for r in e.analyze(two).parsed.collect()} == {"a.py": 0, "b.py": 1, "c.py": 0}
    e.cache.clear()
    assert e.cache.info() == {"size": 0}


def test_cycles_of_a_project(spark):
    from skein.plans.engine import Engine

    files = [("a.py", "import b\n"), ("b.py", "import c\n"), ("c.py", "import a\n"), ("x.py", "import y\n"), ("y.py", "import x\n"), ("z.py", "import a\n")]
    got = Engine(spark).analyze(spark.createDataFrame(files, "file_path string, content string")).circular_dependencies.collect()
    assert sorted((r.graph_id, tuple(r.cycle)) for r in got) == [("a.py", ("a.py", "b.py", "c.py", "a.py")), ("x.py", ("x.py", "y.py", "x.py"))]


def test_tables_are_deleted(spark):
    from skein import runtime

    made = []

    def make():
        made.append(runtime.table(spark.range(5), "inner"))
        return made[0].where("id > 2")

    out = runtime.settled(make, "outer")
    from pathlib import Path

    assert out.count() == 2 and not Path(made[0]._skein_path.replace("file://", "")).exists()
    runtime.drop_table(out)
