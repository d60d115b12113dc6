"""Chunks of code, embeddings, and hybrid retrieval.

Searches take a stated table of queries(query_id, text); chunks are the large side and never
move: queries are sent to them in blocks of a checked size, scores (ranking.py) are cut to
the first k within each task before they meet.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import keywords, truncate
from skein.functions.vectors import hash_embedding
from skein.operators import ranking

MANY_QUERIES = 10_000


def chunk_id(path, kind, name) -> Column:
    return F.substring(F.md5(F.concat_ws(":", path, kind, name)), 1, 16)


def _typed(params) -> Column:
    return F.array_join(F.transform(params, lambda p: F.concat(p["name"], F.when(F.coalesce(p["annotation"], F.lit("")) != "", F.concat(F.lit(": "), p["annotation"])).when(p["default"].isNotNull(), F.concat(F.lit("="), p["default"])).otherwise(""))), ", ")


def chunks(parsed: DataFrame, size: int = 1500) -> DataFrame:
    """chunk_id, content, file_path, module_name, entity_type, entity_name, parent_name, start_line, end_line, ord."""
    p = parsed.where("error is null")
    top = F.filter("classes", lambda c: c["depth"] == 0)
    funcs = F.filter("callables", lambda c: c["class_ord"].isNull())
    names = lambda a: F.array_join(F.transform(F.slice(a, 1, 5), lambda x: x["name"]), ", ")
    imps = F.array_distinct(F.transform("imports", lambda i: F.element_at(F.split(i["module"], r"\."), 1)))
    body = F.concat_ws("\n", F.concat(F.lit("# Module: "), "name"), F.concat(F.lit("File: "), "file_path"), F.substring("doc", 1, 500), F.when(F.size(imps) > 0, F.concat(F.lit("Imports: "), F.array_join(F.slice(imps, 1, 10), ", "))), F.when(F.size(top) > 0, F.concat(F.lit("Classes: "), names(top))), F.when(F.size(funcs) > 0, F.concat(F.lit("Functions: "), names(funcs))))
    none = F.lit(None).cast("string")
    cols = lambda content, kind, name, parent, a, e, o: [content.alias("content"), F.col("file_path"), F.col("module_name"), kind.alias("entity_type"), name.alias("entity_name"), parent.alias("parent_name"), a.alias("start_line"), e.alias("end_line"), o.alias("ord")]
    m = p.withColumn("module_name", F.col("name")).select(*cols(body, F.lit("module"), F.col("name"), none, F.lit(1), F.coalesce(F.try_element_at(top, F.lit(1))["start_line"], F.col("total_lines")), F.lit(0))).where(F.length("content") >= 50)
    c = p.select("file_path", F.col("name").alias("module_name"), F.explode(top).alias("c"), "callables", "variables")
    c = c.withColumn("own", F.filter("callables", lambda x: x["class_ord"] == F.col("c.ord"))).withColumn("vars", F.filter("variables", lambda x: x["class_ord"] == F.col("c.ord")))
    text = F.concat_ws("\n", F.concat(F.lit("class "), "c.name", F.when(F.size("c.bases") > 0, F.concat(F.lit("("), F.array_join("c.bases", ", "), F.lit(")"))).otherwise("")), F.substring("c.doc", 1, 300), F.when(F.col("c.is_abstract"), "abstract"), F.when(F.col("c.is_dataclass"), "dataclass"), F.when(F.size("vars") > 0, F.concat(F.lit("Variables: "), names(F.col("vars")))), F.when(F.size("own") > 0, F.array_join(F.transform("own", lambda x: F.concat(F.lit("def "), x["name"], F.lit("("), _typed(x["params"]), F.lit(")"))), "\n")))
    k = c.select(*cols(truncate(text, size), F.lit("class"), F.col("c.name"), none, F.col("c.start_line"), F.col("c.end_line"), F.col("c.ord") + 1))
    each = c.where(F.size("own") > 3).select("file_path", "module_name", F.col("c.name").alias("cls"), F.explode("own").alias("x"))
    deco = F.array_join(F.transform("x.decorators", lambda d: F.concat(F.lit("@"), d["name"])), "\n")
    line = F.concat(F.when(F.col("x.is_async"), "async def ").otherwise("def "), F.col("x.name"), F.lit("("), _typed(F.col("x.params")), F.lit(")"))
    mt = F.concat_ws("\n", F.concat(F.lit("Class: "), "cls"), F.nullif(deco, F.lit("")), line, F.col("x.doc"), F.when(F.col("x.is_property"), "property"), F.when(F.col("x.is_static"), "static"), F.when(F.col("x.is_classmethod"), "classmethod"), F.when(F.col("x.is_abstract"), "abstract"))
    meth = each.select(*cols(mt, F.lit("method"), F.col("x.name"), F.col("cls"), F.col("x.start_line"), F.col("x.end_line"), F.col("x.ord") + 1))
    f = p.select("file_path", F.col("name").alias("module_name"), F.explode(funcs).alias("x"))
    ft = F.concat_ws("\n", line, F.when(F.coalesce(F.col("x.returns"), F.lit("")) != "", F.concat(F.lit("returns "), F.col("x.returns"))), F.substring("x.doc", 1, 200))
    fun = f.select(*cols(ft, F.lit("function"), F.col("x.name"), none, F.col("x.start_line"), F.col("x.end_line"), F.col("x.ord") + 1))
    out = m.unionByName(k).unionByName(meth).unionByName(fun)
    return out.select(chunk_id("file_path", "entity_type", F.concat_ws(".", "parent_name", "entity_name")).alias("chunk_id"), "*")


def embed(chunks_: DataFrame, embedder: Callable[[Column], Column] | None = None, col: str = "content", dimension: int = 64) -> DataFrame:
    """Adds embedding. embedder: a Column -> Column function, such as an iterator pandas_udf around a model."""
    return chunks_.withColumn("embedding", embedder(F.col(col)) if embedder else hash_embedding(F.col(col), dimension))


def _blocks(queries: DataFrame) -> list[DataFrame]:
    """The stated queries in blocks of about MANY_QUERIES, each to be sent to the chunks."""
    n = queries.count()
    many = max(1, -(-n // MANY_QUERIES))
    return [queries if many == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(many)) == k) for k in range(many)]


def _over(queries: DataFrame, fn) -> DataFrame:
    """fn for each block of queries, together."""
    return reduce(DataFrame.unionByName, map(fn, _blocks(queries)))


def _first(scored: DataFrame, k: int) -> DataFrame:
    """The first k of each query among those of all tasks."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def semantic(chunks_: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.5) -> DataFrame:
    """query_id, chunk_id, score, rank. chunks_: chunk_id, embedding; queries: query_id, embedding."""
    q = queries.select("query_id", F.col("embedding").cast("array<double>"))
    c = chunks_.select("chunk_id", F.col("embedding").cast("array<double>"))
    return _first(_over(q, lambda q: ranking.best(c, q, k, ranking.Cosines)), k).where(F.col("score") >= threshold)


def keyword_score(content: Column, terms: Column) -> Column:
    """What keyword() ranks by, for one text and one list of terms."""
    low = F.lower(content)
    n = lambda t: ((F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t))
    total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.when(low.contains(t), (1 + n(t)) / (1 + F.size(terms))).otherwise(0.0))
    return F.when((F.size(terms) > 0) & F.forall(terms, lambda t: low.contains(t)), total * 1.5).otherwise(total)


def keyword(chunks_: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, chunk_id, score (at most 1), rank. queries: query_id, text."""
    q = queries.select("query_id", keywords(F.col("text")).alias("terms"))
    c = chunks_.select("chunk_id", F.lower("content").alias("low"))
    return _first(_over(q, lambda q: ranking.best(c, q, k, ranking.by_keywords)), k).withColumn("score", F.least(F.lit(1.0), "score"))


def inverted_index(chunks_: DataFrame) -> DataFrame:
    """term, chunk_id, tf: the share of a chunk's terms."""
    w = keywords(F.col("content"))
    t = chunks_.select("chunk_id", F.size(w).alias("n"), F.explode(w).alias("term"))
    return t.groupBy("term", "chunk_id").agg((F.count("*") / F.first("n")).alias("tf"))


def fuse(sem: DataFrame, kw: DataFrame, weight: float = 0.7, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion; ties go to the semantic list's order, then the other's."""
    a, b = sem.select("query_id", "chunk_id", F.col("rank").alias("r1")), kw.select("query_id", "chunk_id", F.col("rank").alias("r2"))
    j = a.join(b, ["query_id", "chunk_id"], "full")
    part = lambda w, r: F.coalesce(F.lit(w) / (constant + F.col(r)), F.lit(0.0))
    j = j.withColumn("score", part(weight, "r1") + part(1 - weight, "r2"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("r1"), F.asc_nulls_last("r2"))
    return j.withColumn("rank", F.row_number().over(w)).select("query_id", "chunk_id", "score", "rank")


def rerank(found: DataFrame, chunks_: DataFrame, queries: DataFrame) -> DataFrame:
    q = queries.select("query_id", F.lower("text").alias("q"), F.array_distinct(keywords(F.col("text"))).alias("terms"))
    d = found.join(chunks_.select("chunk_id", "content", "entity_name"), "chunk_id").join(q, "query_id")
    low, name = F.lower("content"), F.lower("entity_name")
    cover = F.when(F.size("terms") > 0, F.size(F.filter("terms", lambda t: low.contains(t))) / F.size("terms")).otherwise(0.0)
    d = d.withColumn("score", F.col("score") + F.when(low.contains(F.col("q")), 0.3).otherwise(0.0) + 0.2 * cover + F.when(F.exists("terms", lambda t: name.contains(t)), 0.2).otherwise(0.0))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return d.withColumn("rank", F.row_number().over(w)).select("query_id", "chunk_id", "score", "rank")


def hybrid(chunks_: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.5, weight: float = 0.7) -> DataFrame:
    f = fuse(semantic(chunks_, queries, 2 * k, threshold), keyword(chunks_, queries, 2 * k), weight)
    return rerank(f, chunks_, queries).where(F.col("rank") <= k)


def contexts(found: DataFrame, chunks_: DataFrame, limit: int = 12_000) -> DataFrame:
    """query_id, context: contents in order of rank up to limit; the last one is cut if over 200 characters are left."""
    d = found.join(chunks_.select("chunk_id", "content"), "chunk_id")
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("end", F.sum(F.length("content")).over(w)).withColumn("left", limit - (F.col("end") - F.length("content")))
    piece = F.when(F.col("end") <= limit, F.col("content")).when((F.col("left") > 200) & (F.col("left") <= limit), F.concat(F.expr("left(content, int(left))"), F.lit("...")))
    g = d.withColumn("piece", piece).where("piece is not null").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "piece"))).alias("p"))  # at most k rows a query
    return g.select("query_id", F.array_join(F.transform("p", lambda x: x["piece"]), "\n---\n").alias("context"))


PROMPTS = {
    "qa": "Answer the question from the code below.\n\n{context}\n\nQuestion: {question}\nAnswer:",
    "explain": "Explain this code.\n\n{context}\n\nAsked: {question}",
    "search": "Say where in the code below this is.\n\n{context}\n\nLooking for: {question}",
    "summarize": "Sum up the code below.\n\n{context}\n\nFocus: {question}",
    "bugs": "Point out faults in the code below.\n\n{context}\n\nFocus: {question}",
    "architecture": "Describe how the code below is built.\n\n{context}\n\nFocus: {question}",
}


def format_prompt(kind: str, question: str, context: str) -> str:
    return PROMPTS.get(kind, PROMPTS["qa"]).format(question=question, context=context)


class MockModel:
    """A model that repeats what it is asked, and of a context the first five headings in brackets."""

    name = "mock-model"

    def generate(self, prompt: str, context: str = "") -> str:
        seen = [x.split("]")[0] + "]" for x in context.split("\n") if x.startswith("[") and "]" in x][:5]
        return "\n".join([f"[mock] {prompt}", *seen])

    def generate_stream(self, prompt: str, context: str = ""):
        yield from (w + " " for w in self.generate(prompt, context).split())


@dataclass
class RetrievalSettings:
    """What an index does. embedder, model and store are names known to the functions below."""

    embedder: str = "mock"
    dimension: int = 64
    model: str = "auto"
    store: str = "table"
    path: str | None = None
    metric: str = "cosine"
    chunk_size: int = 1500
    top_k: int = 10
    threshold: float = 0.5
    hybrid: bool = True
    semantic_weight: float = 0.7
    rerank: bool = True
    context: int = 12_000

    @classmethod
    def of(cls, **given) -> RetrievalSettings:
        """Settings with what is given; unknown names are ignored."""
        return cls(**{k: v for k, v in given.items() if k in cls.__dataclass_fields__})

    def to_dict(self) -> dict:
        return asdict(self)


EMBEDDERS: dict[str, Callable] = {"mock": lambda s: lambda c: hash_embedding(c, s.dimension)}
MODELS: dict[str, Callable] = {"mock": lambda s: MockModel()}


def _plugged(name: str, known: dict, outside: dict[str, tuple[str, str]], settings: RetrievalSettings):
    """What is registered under a name. A known outside service without its key, package or plug-in falls back to the mock; other names are errors."""
    name = name.lower()
    if name in known:
        return known[name](settings)
    if name not in outside:
        raise ValueError(f"unknown provider: {name}")
    logging.getLogger(__name__).warning("no plug-in for %s is registered, using the mock", name)
    return known["mock"](settings)


def embedder_for(settings: RetrievalSettings) -> Callable[[Column], Column]:
    return _plugged(settings.embedder, EMBEDDERS, {"openai": ("OPENAI_API_KEY", "openai"), "sentence-transformers": ("", "sentence_transformers")}, settings)


def model_for(settings: RetrievalSettings):
    """auto takes the first registered model that is not the mock."""
    name = settings.model.lower()
    if name == "auto":
        name = next((k for k in MODELS if k != "mock"), "mock")
    return _plugged(name, MODELS, dict.fromkeys(("openai", "anthropic", "google", "gemini"), ("", "")), settings)


class MemoryStore:
    """Chunks of this session; a chunk of a known id takes the old one's place."""

    def __init__(self, spark):
        self.spark, self.held = spark, None

    def read(self) -> DataFrame | None:
        return self.held

    def add(self, chunks_: DataFrame) -> None:
        from skein.sources.files import upsert

        self.held = (chunks_ if self.held is None else upsert(self.held, chunks_, "chunk_id")).cache()

    def clear(self) -> None:
        if self.held is not None:
            self.held.unpersist()
        self.held = None


class TableStore:
    """Chunks as Parquet in a folder that can be opened again; a chunk of a known id takes the old one's place.

    Each change writes a new version beside the last and drops that when it is whole, so a
    reader or a failed job never meets half a table.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        """Whole versions, in order."""
        fs, p = self._fs()
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(make(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        v = self._versions()
        return self.spark.read.parquet(f"{self.path}/v{v[-1]}") if v else None

    def add(self, chunks_: DataFrame) -> None:
        from skein.sources.files import upsert

        v, old = self._versions(), self.read()
        new = chunks_ if old is None else upsert(old, chunks_, "chunk_id")
        new.write.parquet(f"{self.path}/v{(v[-1] if v else 0) + 1}")
        self._drop(v)

    def _drop(self, versions: list[int]) -> None:
        fs, _ = self._fs()
        for n in versions:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{n}"), True)

    def clear(self) -> None:
        self._drop(self._versions())


def store_for(spark, settings: RetrievalSettings):
    if settings.store not in ("table", "memory"):
        raise ValueError(f"unknown store: {settings.store}")
    return TableStore(spark, settings.path) if settings.store == "table" and settings.path else MemoryStore(spark)


class Index:
    """Chunks with embeddings in a store; a folder given as path is opened again if it holds an index."""

    def __init__(self, spark, path: str | None = None, model=None, embedder=None, dimension: int = 64, settings: RetrievalSettings | None = None):
        self.spark = spark
        self.settings = settings or RetrievalSettings(dimension=dimension, path=path, threshold=0.0)
        self.store, self.model, self.embedder = store_for(spark, self.settings), model or model_for(self.settings), embedder or embedder_for(self.settings)

    @property
    def chunks(self) -> DataFrame | None:
        return self.store.read()

    def is_indexed(self) -> bool:
        return self.chunks is not None and not self.chunks.isEmpty()

    def add(self, parsed: DataFrame, clear: bool = False) -> DataFrame:
        if clear:
            self.store.clear()
        self.store.add(embed(chunks(parsed, self.settings.chunk_size).dropDuplicates(["chunk_id"]), self.embedder))
        return self.stats()

    def stats(self) -> DataFrame:
        """entity_type, count"""
        held = self.chunks
        return self.spark.createDataFrame([], "entity_type string, count long") if held is None else held.groupBy("entity_type").count()

    def clear(self) -> None:
        self.store.clear()

    def queries(self, *texts: str) -> DataFrame:
        q = self.spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
        return embed(q, self.embedder, "text")

    def _found(self, chunks_: DataFrame, text: str, k: int, threshold: float) -> DataFrame:
        s, q = self.settings, self.queries(text)
        if not s.hybrid:
            return semantic(chunks_, q, k, threshold)
        f = fuse(semantic(chunks_, q, 2 * k, threshold), keyword(chunks_, q, 2 * k), s.semantic_weight)
        return (rerank(f, chunks_, q) if s.rerank else f).where(F.col("rank") <= k)

    def search(self, text: str, k: int | None = None, entity_type: str | None = None, threshold: float | None = None) -> DataFrame:
        c = self.chunks if entity_type is None else self.chunks.where(F.col("entity_type") == entity_type)
        found = self._found(c, text, k or self.settings.top_k, self.settings.threshold if threshold is None else threshold)
        return found.join(c.drop("embedding"), "chunk_id").orderBy("rank")

    def _prompt(self, question: str, kind: str, k: int | None, threshold: float | None) -> tuple[str | None, DataFrame]:
        found = self._found(self.chunks, question, k or self.settings.top_k, self.settings.threshold if threshold is None else threshold)
        got = contexts(found, self.chunks, self.settings.context).first()
        return (format_prompt(kind, question, got.context) if got else None), found

    def ask(self, question: str, kind: str = "qa", k: int | None = None, threshold: float | None = None) -> dict:
        prompt, found = self._prompt(question, kind, k, threshold)
        if prompt is None:
            return {"question": question, "answer": NOTHING, "sources": []}
        src = [r.asDict() for r in found.join(self.chunks.select("chunk_id", "file_path", "entity_name"), "chunk_id").orderBy("rank").collect()]  # at most k rows
        return {"question": question, "answer": self.model.generate(prompt), "sources": src}

    def ask_stream(self, question: str, kind: str = "qa", k: int | None = None, threshold: float | None = None):
        """The answer bit by bit, as the model gives it."""
        prompt, _ = self._prompt(question, kind, k, threshold)
        if prompt is None:
            yield NOTHING
        else:
            yield from self.model.generate_stream(prompt)


NOTHING = "Nothing in the index fits this question."


def full_name() -> Column:
    """A chunk's name with its module and class."""
    return F.concat_ws(".", "module_name", "parent_name", "entity_name")


def prompts(queries: DataFrame, found: DataFrame, chunks_: DataFrame, kind: str = "qa", limit: int = 12_000) -> DataFrame:
    """query_id, prompt: for many questions at once, without the driver."""
    form = PROMPTS.get(kind, PROMPTS["qa"])
    before, _, rest = form.partition("{context}")
    mid, _, after = rest.partition("{question}")
    c = contexts(found, chunks_, limit).join(queries.select("query_id", "text"), "query_id")
    return c.select("query_id", F.concat(F.lit(before), "context", F.lit(mid), "text", F.lit(after)).alias("prompt"))
