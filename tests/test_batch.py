"""Batches: every kind through its branch, one model per file, short files, choices by hand."""

import pytest

from waterloom.plans import batch, model_text
from waterloom.sources import parts

DRAWING = """0
SECTION
2
ENTITIES
0
LWPOLYLINE
8
DN110
90
3
10
0.0
20
0.0
10
{x}
20
0.0
10
{x}
20
10.0
0
INSERT
8
_AEP
2
VanneDN90
10
5.0
20
0.1
0
ENDSEC
"""
FILES = {
    "a/net.dxf": DRAWING.format(x="10.0"), "b/net.DXF": DRAWING.format(x="20.0"),
    "proxy.dxf": "0\nSECTION\n2\nENTITIES\n0\nLINE\n8\nC-STRM-PIPE\n0\nENDSEC\n",
    "nodes.csv": "id;elevation;demand\n" + "".join(f"J{i};{100 + i};0.5\n" for i in range(30)),
    "b/nodes.csv": "id;elevation;demand\n" + "".join(f"J{i};{200 + i};0.25\n" for i in range(30)),
    "many.csv": "Section,c1,c2,c3\nJUNCTIONS,J1,5\nPIPES,P1,J1,J2\nOPTIONS,Units,LPS\nPATTERNS,A,1,2\n",
    "short.csv": "id;elevation\n\n", "empty.csv": "", "odd.csv": "q;w;e\nx;y;z\nz;x;y\n",
    "old.inp": "[JUNCTIONS]\nJ1\t5\t0\n[PIPES]\nP1\tJ1\tJ2\t10\t100\t140\t0\tOpen\n[COORDINATES]\nJ1\t1\t2\n",
    "data.json": '{"items": [{"id": "a"}, {"id": "b"}]}', "notes.txt": "x\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("batch")
    for name, text in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    return root


def named(df, root):
    cut = len(f"file:{root}/")
    return [r.asDict() | {"file": r["file"][cut:]} for r in df.collect()]


def texts(lines, root):
    out = {}
    for r in sorted(named(lines, root), key=lambda r: (r["file"], r["part"], r["row"])):
        out.setdefault(r["file"], []).append(r["line"])
    return out


def test_every_kind_runs_its_branch(spark, folder, tmp_path):
    b = batch.Batch(spark, str(folder))
    assert {r["file"]: r["branch"] for r in named(b.files, folder)} == {
        "a/net.dxf": "drawing", "b/net.DXF": "drawing", "proxy.dxf": "proxy", "nodes.csv": "table",
        "b/nodes.csv": "table", "many.csv": "sectioned", "short.csv": None, "empty.csv": None,
        "odd.csv": "table", "old.inp": "model", "data.json": "extracted", "notes.txt": None}
    assert {r["file"]: r["error"] for r in named(b.errors, folder)} == {
        "short.csv": batch.SHORT, "empty.csv": batch.SHORT, "notes.txt": batch.UNKNOWN}
    assert [r["file"] for r in named(b.tables.waiting, folder)] == ["odd.csv"]
    # tables: the same identifiers in two files stay two models
    models = texts(b.tables.models(), folder)
    assert set(models) == {"nodes.csv", "b/nodes.csv", "many.csv"}
    assert "J7\t107.000\t0.500000\t\t;" in models["nodes.csv"]
    assert "J7\t207.000\t0.250000\t\t;" in models["b/nodes.csv"]
    assert len([x for x in models["nodes.csv"] if x.startswith("J")]) == 30
    many = models["many.csv"]
    assert many[many.index("[OPTIONS]") + 1] == "Units\t\tLPS" and "[PATTERNS]" in many
    assert "P1\tJ1\tJ2\t0.0000\t0.0\t140.0\t0.0000\tOpen\t;" in many and "A\t1.000000\t2.000000\t;" in many
    assert "[PATTERNS]" not in models["nodes.csv"] and models["nodes.csv"][-2:] == ["[END]", ""]
    project = [r["line"] for r in b.tables.project().orderBy("part", "row").collect()]
    # file names in order: b/nodes.csv, many.csv, nodes.csv
    at = [project.index(x) for x in ("J7\t207.000\t0.250000\t\t;", "J1\t5.000\t0.000000\t\t;",
                                     "J7\t107.000\t0.500000\t\t;")]
    assert at == sorted(at)
    # drawings: clashing entity numbers, one network each
    supply = texts(b.supply_models(), folder)
    assert set(supply) == {"a/net.dxf", "b/net.DXF"}
    for name, length in (("a/net.dxf", "10.0000"), ("b/net.DXF", "20.0000")):
        assert f"P1\tJ1\tJ2\t{length}\t110.0\t140.0\t0.0000\tOpen" in supply[name]
        assert "P2\tJ2\tJ3\t10.0000\t110.0\t140.0\t0.0000\tOpen" in supply[name]
        assert "V1\tJ1\tJ2\t90.0\tFCV\t0.0\t0.0000" in supply[name]
        assert not any("Topology" in x for x in supply[name])
    assert set(texts(b.sewer_models(), folder)) == {"a/net.dxf", "b/net.DXF"}
    assert [r["id"] for r in b.model_tables["pipes"].collect()] == ["P1"]
    found = b.extracted("items array<struct<id:string>>").selectExpr("inline(items)").collect()
    assert [r.id for r in found] == ["a", "b"]
    assert b.proxies["pipes"].count() == 0
    b.write(str(tmp_path / "out"))
    written = parts.read_parts(spark, str(tmp_path / "out" / "models"))
    got = {r["file"]: bytes(r["content"]).decode() for r in named(written, folder)}
    assert got == {n: "".join(x + "\n" for x in t) for n, t in models.items()}


def test_choices_by_hand(spark, folder):
    odd = f"file:{folder}/odd.csv"
    chosen = spark.createDataFrame([(odd, "pipes")], "file string, section string")
    plain = batch.Batch(spark, str(folder / "odd.csv"), chosen=chosen).tables
    # no header says anything: columns by their place
    assert "x\ty\tz\t0.0000\t0.0\t140.0\t0.0000\tOpen\t;" in texts(plain.models(), folder)["odd.csv"]
    over = spark.createDataFrame(
        [(odd, "q", "node1", False), (odd, "w", "node2", False), (odd, "e", None, True)],
        "file string, header string, field string, ignored boolean")
    by_hand = batch.Batch(spark, str(folder / "odd.csv"), chosen=chosen, overrides=over).tables
    lines = texts(by_hand.models(), folder)["odd.csv"]
    assert any(x.startswith("P1\tx\ty\t") for x in lines) and any(x.startswith("P2\tz\tx\t") for x in lines)


def test_long_models_are_cut_and_read_the_same(spark, tmp_path):
    rows = [("a", 1, i, f"line {i}") for i in range(-3, 50)] + [("a", 0, 1 << 62, "end"), ("b/c", 2, 0, "x")]
    lines = spark.createDataFrame(rows, "file string, part int, row bigint, line string").repartition(4)
    for size in (7, 1000):
        out = tmp_path / str(size)
        model_text.write_models(lines, str(out), rows=size)
        got = {}
        for r in parts.read_parts(spark, str(out)).orderBy("part").collect():
            got[r.file] = got.get(r.file, b"") + bytes(r.content)
        assert got == {"a": "".join(x + "\n" for x in ["end", *[f"line {i}" for i in range(-3, 50)]]).encode(),
                       "b/c": b"x\n"}
        assert (len(list((out / "a").iterdir())) > 5) == (size == 7)


def test_a_file_without_rows_has_a_model_of_its_own(spark):
    files = spark.createDataFrame([("a",), ("b",)], "file string")
    pipes = spark.createDataFrame([("a", 1, "P1", "x", "y")],
                                  "file string, row_no int, id string, node1 string, node2 string")
    lines = model_text.table_models(files, {"pipes": pipes}).where("part = 5").orderBy("file", "row")
    got = {}
    for r in lines.collect():
        got.setdefault(r.file, []).append(r.line)
    assert len(got["a"]) == 4 and got["b"] == ["[PIPES]", model_text.HEADERS["PIPES"], ""]
