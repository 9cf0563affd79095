from pyspark.sql import functions as F

from loamline.api import ToolError, Workspace
from loamline.operators import chunks, payloads, search
from loamline.providers import HashEmbedder

TREE = {
    "app/main.py": "from app import core\n\ndef main():\n    return core.run()\n", "app/core.py": "import json\n\ndef run():\n    return json.dumps({})\n", "app/__init__.py": "x = 1\ny = 2\n",
    "web/index.ts": 'import { a } from "./a";\nexport function go() {\n  return a();\n}\n', "web/a.ts": "export const a = () => {\n  return 1;\n};\n",
}


def workspace(spark):
    files = spark.createDataFrame([("r", p, len(t), t) for p, t in TREE.items()], "repo_id string, path string, size long, text string")
    c = chunks.chunk(files).withColumn("digest", F.lit("d"))
    v = search.build_index(c, HashEmbedder()).withColumn("repo_id", F.lit("r"))
    return Workspace(files, v, HashEmbedder())


def test_seven_tools(spark):
    w = workspace(spark)
    assert [r.total_files for r in w.list_repos().collect()] == [5]
    assert [r["name"] for r in w.read_repo_structure("r").collect()] == ["app", "web"]
    assert [r.content for r in w.read_file("r", "app/core.py", 3, 3).collect()] == ["def run():"]
    assert [(r.path, r.start_line) for r in w.find_definition("r", "run").collect()] == [("app/core.py", 3)]
    assert {r.path for r in w.find_references("r", "run").collect()} == {"app/core.py", "app/main.py"}
    assert {(r.direction, r.other) for r in w.query_dependencies("r", "app/core.py").collect()} == {("imported_by", "app/main.py")}
    rings, largest = w.query_dependencies("r")
    assert rings.count() == 0 and {r.n_files for r in largest.collect()} == {2, 3}
    hit = w.search_code("r", "def run return json dumps").collect()
    assert hit[0].chunk_id.startswith("app/core.py") and len(hit) == 5


def test_errors_are_data(spark):
    w = workspace(spark)
    assert isinstance(w.search_code("r", "  "), ToolError)
    assert isinstance(Workspace(w.files).search_code("r", "x"), ToolError)


def test_payloads(spark):
    files = spark.createDataFrame([("m", f"f{i:02}") for i in range(15)], "name string, path string")
    p = payloads.planner_payload(spark.createDataFrame([("m", 0.123456)], "name string, score double"), files).first()
    assert (p.score, len(p.files), p.left_out) == (0.1235, 12, 3)
    found = spark.createDataFrame([("r", "a", "k")], "repo_id string, path string, kind string")
    targets = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [payloads.file_findings(found, targets, x).first().state for x in "abc"] == ["findings", "clean", "not_reviewed"]
    e = spark.createDataFrame([(f"f{i:02}", f"x{j}") for i in range(3) for j in range(8)], "src string, dst string")
    s = spark.createDataFrame([("f00", f"s{j:02}") for j in range(12)], "path string, qualified_name string")
    t = payloads.task_payload(files, e, s).first()
    assert len(t.files) == 15 and [len(n.targets) for n in t.neighbours] == [6, 6, 6] and len(t.symbols[0].names) == 10
