"""The seven tools over analysed repositories. A tool's error is data, never an exception."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, wraps

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.operators import graph, imports, lookup, modules, search
from loamline.providers import Embedder
from loamline.sources import repos


@dataclass
class ToolError:
    reason: str


def _safe(tool: Callable) -> Callable:
    @wraps(tool)
    def run(*args, **kwargs):
        try:
            return tool(*args, **kwargs)
        except (PySparkException, ValueError) as e:
            return ToolError(str(e)[:500])

    return run


class Workspace:
    """Repositories as tables. The parse and the graph are built on first use; modules and ranks only for questions that need them."""

    def __init__(self, files: DataFrame, vectors: DataFrame | None = None, embedder: Embedder | None = None):
        self.files, self.vectors, self.embedder = files, vectors, embedder

    @cached_property
    def parsed(self) -> DataFrame:
        return repos.parse(self.files).persist()

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        own = repos.imports(self.parsed)
        python = imports.resolve_python(own.where("language = 'python'"), self.files)
        script = imports.alias_targets(own.where("language = 'typescript'"), imports.repository_aliases(self.files))
        script = imports.resolve_typescript(script, self.files).drop("aliased")
        return {k: v.persist() for k, v in imports.graph_tables(python.unionByName(script)).items()}

    @cached_property
    def clusters(self) -> DataFrame:
        return modules.cluster(self.files.join(self.parsed.where("status = 'parsed'").select("repo_id", "path"), ["repo_id", "path"], "left_semi"), self.tables["edges"]).persist()

    def _of(self, repo: str, df: DataFrame) -> DataFrame:
        return df.where(F.col("repo_id") == repo)

    @_safe
    def list_repos(self) -> DataFrame:
        return repos.inventory(self.files).orderBy("repo_id")

    @_safe
    def read_repo_structure(self, repo: str, directory: str = "") -> DataFrame:
        return lookup.list_directory(self._of(repo, self.files), directory)

    @_safe
    def read_file(self, repo: str, path: str, start: int = 1, end: int | None = None) -> DataFrame:
        return lookup.read_slice(self._of(repo, self.files), path, start, end)

    @_safe
    def find_definition(self, repo: str, name: str, path_part: str | None = None) -> DataFrame:
        return lookup.definitions(self._of(repo, repos.symbols(self.parsed)), name, path_part)

    @_safe
    def find_references(self, repo: str, name: str) -> DataFrame:
        return lookup.references(self._of(repo, repos.symbols(self.parsed)), self._of(repo, self.tables["edges"]), self._of(repo, self.files), name)

    @_safe
    def query_dependencies(self, repo: str, path: str | None = None):
        edges = self._of(repo, self.tables["edges"])
        if path:
            return graph.dependencies(edges, path)
        sizes = self._of(repo, self.clusters).groupBy("name").agg(F.count(F.lit(1)).alias("n_files"))
        return graph.overview(graph.cycles(edges), sizes)

    @_safe
    def search_code(self, repo: str, question: str, limit: int = 5):
        if self.vectors is None or self.embedder is None:
            raise ValueError("index_missing")
        if not question.strip():
            raise ValueError("empty_question")
        spark = self.files.sparkSession
        asked = spark.createDataFrame([(self.embedder.embed([question])[0],)], "embedding array<double>")
        return search.top_k(self._of(repo, self.vectors), asked, search.clamp(limit, 5))
