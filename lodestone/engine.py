"""One repository's tables behind the operations that a service would offer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut, new_folder
from .operators import agent, codemap, findings, graph, mining, refresh, retrieval, views, wiki
from .operators.inverted import InvertedIndex
from .operators.model_stage import ModelStage
from .operators.ordering import numbered
from .operators.vector_index import VectorIndex
from .sources import python_code, repository, sinks
from .sources.snapshots import SnapshotTable

Model = Callable[[str], str]
TABLES = ("files", "commits", "commit_files", "issues", "symbols", "edges", "references")


def numbered_symbols(found: DataFrame) -> DataFrame:
    """Symbols with their ids: their places by file and line."""
    return numbered(found, ("repo_id",), "file_path", "start_line", "qualified_name", "kind").withColumnRenamed("place", "id")


@dataclass
class Repository:
    """Tables of one repository (all with repo_id) and what is asked of them."""

    spark: SparkSession
    info: dict
    files: DataFrame
    commits: DataFrame
    commit_files: DataFrame
    issues: DataFrame
    symbols: DataFrame
    edges: DataFrame
    model: Model | None = None
    #: What symbols refer to, as their sources say it; a refresh needs it.
    references: DataFrame | None = None
    traces: codemap.TraceCache = field(default_factory=codemap.TraceCache)
    #: Where the search's indexes are, or will be.
    folder: str | None = None
    #: What makes vectors of texts; without it searches go by words alone.
    embedder: retrieval.Embedder | None = None
    #: Where the model's answers about files are kept.
    answers: str | None = None

    @classmethod
    def ingest(cls, spark: SparkSession, path: str, *, url: str = "", repo_id: int = 1, issues: list[str] | DataFrame | None = None, max_commits: int | None = None, model: Model | None = None) -> Repository:
        """Files, history, issues, symbols and the dependency graph of a working tree."""
        branch, sha = repository.head_info(path)
        files = repository.read_files(spark, path, repo_id).cache()
        commits, changes = repository.read_history(spark, path, repo_id, max_commits)
        raw = issues if isinstance(issues, DataFrame) else spark.createDataFrame([(x,) for x in issues or []], "json string")
        symbols = numbered_symbols(python_code.symbols(files)).cache()
        references = python_code.references(symbols).cache()
        edges, _ = graph.resolve_references(references, symbols)
        edges = edges.withColumn("confidence", F.col("tenths") / 10).cache()
        info = {"id": repo_id, "url": url, "name": path.rstrip("/").rsplit("/", 1)[-1], "default_branch": branch, "head_sha": sha}
        return cls(spark, info, files, commits, changes, repository.parse_issues(raw, repo_id), symbols, edges, model, references)

    def refreshed(self, path: str, *, repo_id: int | None = None, issues: list[str] | DataFrame | None = None, max_commits: int | None = None) -> Repository:
        """This repository as its working tree is now, equal to what ingest would make of it.

        Files are compared by content; those that are the same are not parsed again, and only edges that
        may differ are resolved again. History is read anew, issues where they are given. repo_id: the
        number of the result, this one's by default.
        """
        number = F.lit(self.info["id"] if repo_id is None else repo_id)
        old = {name: getattr(self, name).withColumn("repo_id", number) for name in ("files", "symbols", "edges", "references", "issues")}
        branch, sha = repository.head_info(path)
        repo_id = self.info["id"] if repo_id is None else repo_id
        files = repository.read_files(self.spark, path, repo_id).cache()
        commits, changed = repository.read_history(self.spark, path, repo_id, max_commits)
        changes = cut(refresh.delta(old["files"], files))
        at = changes.select("repo_id", F.col("path").alias("file_path"))
        kept = old["symbols"].withColumnRenamed("id", "old_id").join(at, ["repo_id", "file_path"], "left_anti")
        parsed = python_code.symbols(files.join(changes, ["repo_id", "path"], "left_semi")).withColumn("old_id", F.lit(None).cast("long"))
        symbols = numbered_symbols(kept.unionByName(parsed)).cache()
        ids = symbols.where("old_id is not null").select("repo_id", F.col("old_id").alias("src"), "id")
        known = old["references"].join(ids, ["repo_id", "src"]).drop("src").withColumnRenamed("id", "src")
        references = known.unionByName(python_code.references(symbols.where("old_id is null"))).cache()
        edges = refresh.refreshed_edges(old["edges"], old["references"], old["symbols"], references, symbols, changes)
        edges = edges.withColumn("confidence", F.col("tenths") / 10).cache()
        if issues is not None:
            raw = issues if isinstance(issues, DataFrame) else self.spark.createDataFrame([(x,) for x in issues], "json string")
            old["issues"] = repository.parse_issues(raw, repo_id)
        info = {**self.info, "id": repo_id, "default_branch": branch, "head_sha": sha}
        return Repository(self.spark, info, files, commits, changed, old["issues"], symbols.drop("old_id"), edges, self.model, references, embedder=self.embedder)

    def store(self, folder: str) -> None:
        """Keep the tables below a folder; each is replaced at once for this repository alone."""
        for name in TABLES:
            SnapshotTable(self.spark, f"{folder}/{name}").replace(getattr(self, name), [self.info["id"]])

    @classmethod
    def load(cls, spark: SparkSession, folder: str, info: dict, model: Model | None = None) -> Repository:
        """A repository that store kept."""
        tables = {name: SnapshotTable(spark, f"{folder}/{name}").read(values=[info["id"]]) for name in TABLES}
        return cls(spark, info, **tables, model=model, folder=f"{folder}/index/{info['id']}", answers=f"{folder}/answers")

    def status(self) -> dict:
        return {"counts": {n: getattr(self, n).count() for n in ("files", "commits", "issues", "symbols", "edges")}, "model": self.model is not None, "repo": self.info}

    def overview(self) -> dict:
        hot = mining.hotspots(self.edges, self.symbols, self.commit_files).orderBy(F.desc("raw"), "path").limit(5).collect()
        degree = mining.file_degree(self.edges, self.symbols).where(F.col("path").startswith("src/")).orderBy(F.desc("degree"), "path").limit(6).collect()
        return {"most_central": degree[0]["path"].rsplit("/", 1)[-1] if degree else "—", "reading_path": [r["path"] for r in degree], "hotspots": [{"path": r["path"], "score": round(r["score"], 2)} for r in hot]}

    def tree(self) -> DataFrame:
        return mining.tree(self.files, self.symbols).orderBy("path")

    def files_by_folder(self, part: str = "") -> DataFrame:
        return views.files_by_folder(self.files, part)

    def file(self, path: str) -> dict | None:
        row = self.files.where(F.col("path") == path).select("path", "language", "content").first()
        own = self.symbols.where((F.col("file_path") == path) & (F.col("kind") != "import")).orderBy("start_line").select("id", "kind", "qualified_name", "start_line", "end_line")
        return row.asDict() | {"symbols": [r.asDict() for r in own.collect()]} if row else None

    def symbol_index(self) -> DataFrame:
        return mining.symbol_index(self.symbols, self.edges)

    def definitions(self) -> DataFrame:
        """(name, ids): a name's symbols, the most called first."""
        return mining.definitions(self.symbols, self.edges).drop("repo_id")

    def symbol(self, symbol_id: int) -> DataFrame:
        return mining.symbol_detail(self.edges, self.symbols, symbol_id).orderBy("side", F.desc("tenths"), "id")

    def entrypoints(self) -> DataFrame:
        return mining.entrypoints(self.symbols, self.files)

    def entrypoints_by_kind(self) -> DataFrame:
        return self.entrypoints().groupBy("kind").agg(F.count("*").alias("n"))

    def dead_code(self) -> DataFrame:
        return mining.dead_code(self.symbols, self.edges, self.entrypoints())

    def folders(self) -> DataFrame:
        return mining.folder_heat(self.edges, self.symbols)

    def coupling(self, limit: int = 12) -> DataFrame:
        return mining.coupling(self.commits, self.commit_files).orderBy(F.desc("strength"), F.desc("co_changes"), "a", "b").limit(limit)

    def communities(self) -> DataFrame:
        return graph.describe_communities(graph.merged_communities(self.edges, self.symbols), self.edges, self.symbols)

    def call_graph(self, symbol_id: int, depth: int = 3) -> tuple[list, list]:
        return graph.call_flow(self.edges, symbol_id, max(1, min(depth, 5)))

    def impact(self, symbol_id: int) -> dict:
        """Who calls a symbol, near and far and in tests, which files change with its own, and the risk."""
        own = self.symbols.where(F.col("id") == symbol_id).select("id", "qualified_name", "kind", "file_path", "start_line").first()
        if own is None:
            return {"error": "Symbol not found"}
        entry = self.entrypoints().where(F.col("symbol_id") == symbol_id).count() > 0
        start = self.spark.createDataFrame([(symbol_id, entry)], "id long, entrypoint boolean")
        callers = [r.asDict() for r in mining.impact_callers(self.edges, self.symbols, start).orderBy("place").drop("start", "place").collect()]
        direct, tested = [c for c in callers if c["depth"] == 1], [c for c in callers if c["tests"]]
        counts = self.spark.createDataFrame([(len(direct), len(tested), entry)], "n int, tests int, entry boolean")
        risk = counts.select(mining.risk(F.col("n"), F.col("tests"), F.col("entry")).alias("level"), mining.risk_reason(F.col("n"), F.col("tests"), F.col("entry")).alias("reason")).first()
        coupled = mining.coupled_files(mining.coupling(self.commits, self.commit_files), own["file_path"])
        return {
            "symbol": own.asDict(),
            "direct_callers": sorted(direct, key=lambda c: (c["qualified_name"], c["id"])),
            "transitive_callers": [c for c in callers if c["depth"] > 1],
            "test_callers": sorted(tested, key=lambda c: (c["qualified_name"], c["id"])),
            "coupled_files": [r.asDict() for r in coupled.collect()],
            "is_entrypoint": entry,
            "fan_in": len(direct),
            "risk": risk.asDict(),
        }

    def architecture(self) -> dict:
        """Labelled top folders, the primary package's parts, whether they are layered."""
        top = mining.top_folders(self.files).orderBy(F.desc("files"), "folder").drop("repo_id").collect()
        parts = mining.submodules(self.files, self.symbols).orderBy(F.desc("symbols"), "submodule").drop("repo_id").collect()
        return {"folders": [r.asDict() for r in top], "submodules": [r.asDict() for r in parts], "layered": any(r["submodule"] in mining.LAYERS for r in parts)}

    def ego(self, symbol_id: int) -> DataFrame:
        """The edges of a symbol and its direct neighbours."""
        return views.ego(self.edges, symbol_id)

    def evidence(self) -> DataFrame:
        return retrieval.evidence_documents(self.files, self.commits, self.issues)

    def _code(self) -> DataFrame:
        return self.symbols.where("kind <> 'import'").withColumn("id", F.col("id").cast("string"))

    def _docs(self) -> DataFrame:
        return self.evidence().withColumn("id", F.concat_ws(":", "stream", "ref_id"))

    def index(self, name: str) -> InvertedIndex:
        """The stored index of code or of evidence; it is made when it is asked for first."""
        self.folder = self.folder or new_folder(self.spark, "index")
        made = InvertedIndex(self.spark, f"{self.folder}/{name}")
        if not made.exists():
            if name == "code":
                made.replace(self._code(), list(retrieval.CODE_FIELDS), facets=("kind",))
            else:
                made.replace(self._docs(), list(retrieval.EVIDENCE_FIELDS), facets=("stream",))
        return made

    def vectors(self, name: str) -> VectorIndex:
        """The stored index of the vectors of code or of evidence; it is made when it is asked for first."""
        self.folder = self.folder or new_folder(self.spark, "index")
        made = VectorIndex(self.spark, f"{self.folder}/{name}-vectors")
        if not made.log.versions():
            if name == "code":
                facets = self._code().select("id", "kind")
                texts = retrieval.symbol_embedding_text(self.symbols).select(F.col("id").cast("string").alias("id"), "text")
            else:
                facets = self._docs().select("id", "stream")
                texts = self._docs().select("id", F.concat_ws("\n", "title", "text").alias("text"))
            made.replace(retrieval.embed(texts, self.embedder).join(facets, "id"), facets=tuple(c for c in facets.columns if c != "id"))
        return made

    def search_table(self, queries: DataFrame, streams: list[str] | None = None, k: int = 8, kind: str | None = None) -> DataFrame:
        """(query_id, source, id, score, rank): hits of queries(query_id, text) over code and evidence, fused by rank.

        By words, and by vectors where there is an embedder. streams: those to look in, all by default;
        kind: symbols of this kind alone.
        """
        lists = []
        if streams is None or "code" in streams:
            found = self.index("code").search(queries, retrieval.CODE_FIELDS, 15, None if kind is None else F.col("kind") == kind)
            lists.append(found.withColumn("source", F.lit("code")))
        where = None if streams is None else F.col("stream").isin(streams)
        lists.append(self.index("evidence").search(queries, retrieval.EVIDENCE_FIELDS, 15, where).withColumn("source", F.lit("evidence")))
        if self.embedder is not None:
            asked = retrieval.embed(queries, self.embedder, key="query_id").select(F.col("id").cast(queries.schema["query_id"].dataType).alias("query_id"), "vector")
            if streams is None or "code" in streams:
                lists.append(self.vectors("code").search(asked, 15, None if kind is None else F.col("kind") == kind).withColumn("source", F.lit("code")))
            lists.append(self.vectors("evidence").search(asked, 15, where).withColumn("source", F.lit("evidence")))
        return retrieval.search_streams(lists, k)

    def search(self, text: str, streams: list[str] | None = None, k: int = 8, kind: str | None = None) -> list[dict]:
        """Hits of one question, the best first, with what they cite."""
        asked = self.spark.createDataFrame([(0, text)], "query_id int, text string")
        hits = self.search_table(asked, streams, k, kind).orderBy("rank").collect()
        code = self._code().select("id", F.concat_ws(":", "file_path", "start_line").alias("citation"), F.col("qualified_name").alias("title"), F.col("code").alias("body"))
        known = {"code": code, "evidence": self._docs().select("id", "citation", "title", F.col("text").alias("body"), "stream")}
        rows: dict[tuple[str, str], dict] = {}
        for source in {h["source"] for h in hits}:
            wanted = known[source].where(F.col("id").isin([h["id"] for h in hits if h["source"] == source]))
            rows |= {(source, r["id"]): r.asDict() for r in wanted.collect()}
        return [{"stream": "code", **rows[h["source"], h["id"]], "score": h["score"]} for h in hits]

    def candidates(self, question: str) -> list[int]:
        return [int(h["id"]) for h in self.search(question, ["code"], codemap.CANDIDATES)]

    def ask(self, question: str, history: list[dict] | None = None) -> dict:
        return agent.ask(question, self.search, self.model, history)

    def investigate(self, question: str, history: list[dict] | None = None) -> dict:
        return agent.investigate(question, lambda q, s: self.search(q, s, 6), self.model, expand=self._facts, history=history)

    def investigate_events(self, question: str) -> Iterator[str]:
        """The investigation's steps as server-sent events."""
        return sinks.server_events(agent.investigate_steps(question, lambda q, s: self.search(q, s, 6), self.model, expand=self._facts))

    def _facts(self, names: list[str]) -> list[dict]:
        out = []
        for s in self.symbols.where(F.col("name").isin(names) & (F.col("kind") != "import")).orderBy("id").limit(len(names)).collect():
            users = [r["qualified_name"] for r in mining.symbol_detail(self.edges, self.symbols, s["id"]).where("side = 'caller'").limit(15).collect()]
            path = graph.call_path(self.edges, s["id"], 2).join(self.symbols, F.col("node") == F.col("id")).where("depth > 0").orderBy("depth", "node").limit(15).collect()
            out.append(agent.fact_card(s["qualified_name"], users, [(r["depth"], r["qualified_name"]) for r in path]))
        return out

    def codemap(self, question: str) -> dict:
        return codemap.codemap(self.edges, self.symbols, self.candidates(question))

    def codemap_file(self, path: str) -> dict:
        return codemap.file_codemap(self.edges, self.symbols, path)

    def codemap_extend(self, shown: list[int], question: str) -> dict:
        return codemap.extend(self.edges, self.symbols, shown, self.candidates(question))

    def explain_edge(self, src: int, dst: int, edge_type: str = "call") -> str:
        return codemap.explain_edge(self.symbols, src, dst, edge_type, self.model)

    def simulate(self, ids: list[int], question: str = "") -> dict:
        key = (self.info["head_sha"], tuple(ids), question)
        return self.traces.get(key, lambda: codemap.simulate(self.symbols, ids, question, self.model))

    def wiki(self) -> list[dict]:
        package = mining.packages(self.files.where("category = 'code'")).orderBy(F.desc("files"), "package").first()
        return wiki.sections(self.info["name"], package["package"] if package else "", self.files, self.symbols, self.edges, self.entrypoints())

    def wiki_xhtml(self) -> dict[str, str]:
        return {p["title"]: sinks.page_xhtml(p["blocks"]) for p in self.wiki()}

    def snapshot(self) -> dict:
        return wiki.snapshot(self.info, self.files, self.symbols, self.edges, self.commits, self.commit_files, self.entrypoints())

    def graph_page(self) -> str:
        links = graph.file_graph(self.edges, self.symbols)
        return sinks.graph_html(self.info["name"], graph.file_graph_nodes(links).drop("repo_id"), links.drop("repo_id"))

    def scan(self, scan_all: bool = False) -> tuple[DataFrame, list[str]]:
        """Findings of the files most worth a look, and what was left out.

        Tasks ask the model, and its answers are kept: a file whose path and content were asked about is not
        asked about again. If a file gets no answer that is an error, and a later scan asks only for the rest.
        """
        churn = mining.churn(self.commit_files)
        chosen = cut(findings.prompts(findings.select_files(self.files, churn, None if scan_all else findings.MAX_FILES)))
        total = findings.select_files(self.files, churn, None).count()
        n, long = chosen.agg(F.count("*"), F.count_if("cut")).first()
        notes = findings.cap_notes(n, total, long, self.model is not None)
        if self.model is None:
            return self.spark.createDataFrame([], findings.FOUND), notes
        self.answers = self.answers or new_folder(self.spark, "answers")
        stage = ModelStage(self.spark, self.answers, getattr(self.model, "model", "model"), getattr(self.model, "bare", self.model), attempts=1)
        if hasattr(self.model, "calls"):
            self.model.calls.kept[stage.path] = stage.calls
        answered = cut(stage.ask(chosen))
        failed, error = answered.agg(F.count("error"), F.min("error")).first()
        if failed:
            raise RuntimeError(f"{failed} of {n} files got no answer: {error}")
        return findings.found(answered), notes
