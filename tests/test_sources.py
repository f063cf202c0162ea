"""Sources against small files."""

from quillon.sources import edges_json, python_source

TEXT = "class A(B):\n    def f(self):\n        self.g()\n\ndef h():\n    A()\n"


def test_python_source(spark):
    files = spark.createDataFrame([("p/m.py", TEXT), ("bad.py", "def ("), ("none.py", None)], "path string, text string")
    got = {tuple(r) for r in python_source.parse_files(files).select("row", "src", "kind", "name", "start_line").collect()}
    assert got == {("symbol", "p.m.A", "class", "A", 1), ("edge", "p.m.A", "extends", "B", 1), ("symbol", "p.m.A#f", "method", "f", 2), ("edge", "p.m.A#f", "calls", "#g", 3), ("symbol", "p.m#h", "function", "h", 5), ("edge", "p.m#h", "calls", "A", 6)}


def test_edges_json(spark, tmp_path):
    rows = [("a", "f", None, "calls", "b", "g", 1, 2, "exact", 1.0)]
    edges_json.write_edges(spark.createDataFrame(rows, edges_json.SCHEMA), str(tmp_path / "e"))
    assert [tuple(r) for r in edges_json.read_edges(spark, str(tmp_path / "e")).collect()] == rows
