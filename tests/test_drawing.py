"""Drawing scan and network plan on a small drawing written by the test."""

import json
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from waterloom.plans import features, model_text, update
from waterloom.plans.drawing import Drawing, keyword_network, sewer_layers
from waterloom.sources import dxf, inp, proxy
from waterloom.sources.lines import read_lines


def tag(*pairs):
    return "".join(f"{c}\n{v}\n" for c, v in pairs)


def poly(layer, pts, count=None, closed=0):
    head = tag((0, "LWPOLYLINE"), (8, layer), (90, count or len(pts)), (70, closed))
    return head + "".join(tag((10, x), (20, y)) for x, y in pts)


def insert(layer, x, y, block="REGARD"):
    return tag((0, "INSERT"), (8, layer), (2, block), (10, x), (20, y))


def text(layer, s, x=0.0, y=0.0, kind="TEXT"):
    return tag((0, kind), (8, layer), (10, x), (20, y), (1, s))


PROFILE = "EU 1_PL_1_Textes"


def drawing():
    body = insert("EU 1_Regards", 0.0, 0.0) + insert("EU 1_Regards", 100.0, 0.0)
    body += insert("EU 1_Regards", 500.0, 900.0)
    body += text("EU 1_Regards_Habillage", "R1\\PCT : 10.5\\PCR : 8.5\\PP : 2.0", 1, 1, "MTEXT")
    body += text("EU 1_Regards_Habillage", "R2\\PCT : 9.5\\PCR : 7.5\\PP : 2.0", 101, 2, "MTEXT")
    body += text("EU 1_Regards_Habillage", "R9\\PCT : 1\\PCR : 2\\PP : 3", 5000, 5000, "MTEXT")
    body += poly("EU 1_Canalisations", [(0, 0), (60, 0), (100, 0)])
    body += poly("EU 1_Canalisations", [(0, 500), (0, 530)])
    body += text("EU 1_Canalisations_Habillage", "CR16-0315  30.00 ml", 1, 515)
    body += text("EU 1_Canalisations_Habillage", "-0.55 % -->", 2, 517)
    body += text("EU 1_Canalisations_Habillage", "CR16-0400  9.00 ml", 900, 900)
    body += poly("DN 200", [(0, 0), (5, 5), (9, 9)], count=2)
    body += poly("DN110", [(0, 0), (10, 0), (10, 10)]) + poly("DN160", [(50, 50), (60, 50)])
    body += insert("_AEP", 5, 0.5, "VanneDN110") + insert("_AEP", 10, 10, "Té03Brides_DN63")
    body += poly("_RESEAU INCENDIE", [(200, 0), (210, 0)]) + insert("_RESEAU INCENDIE", 200, 0, "PI")
    body += tag((0, "LINE"), (8, "assai 250"), (10, 1), (20, 2), (11, 4), (21, 6))
    for v in ("100", "98", "Cotes Terrain Naturel", "R1", "R2", "Numéros des regards", "95", "94",
              "Cotes fil d'eau", "100", "Distances partielles", "0", "100", "Distances cumulées",
              "PVC-315", "Dimensions et Matériaux", "Profil entre les noeuds R1-R2", "left over"):
        body += text(PROFILE, v)
    out = tag((0, "SECTION"), (2, "HEADER"), (9, "$ACADVER"), (1, "AC1009"), (0, "ENDSEC"))
    out += tag((0, "SECTION"), (2, "BLOCKS"), (0, "INSERT"), (8, "EU 1_Regards"), (2, "no"),
               (10, 7), (20, 7), (0, "ENDSEC"))
    return out + tag((0, "SECTION"), (2, "ENTITIES")) + body + tag((0, "ENDSEC"), (0, "EOF"))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("dxf")
    (where / "a.dxf").write_bytes(drawing().encode("latin-1"))
    (where / "b.dxf").write_bytes(drawing().replace("\n", "\r\n").encode("latin-1"))
    return str(where)


@pytest.fixture(scope="module")
def built(spark, folder):
    return Drawing.read(spark, folder)


def short(df):
    return df.where(F.col("file").endswith("a.dxf"))


def test_scan_over_many_splits(spark, folder):
    whole = {(r["file"], r["line_no"]): r["text"] for r in read_lines(spark, folder).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        split = read_lines(spark, folder)
        assert split.select("block").distinct().count() > 4
        assert {(r["file"], r["line_no"]): r["text"] for r in split.collect()} == whole
        tags = dxf.tags_from_lines(split)
        marked = dxf.mark_entities(tags)
        kept = dxf.model_space(marked, dxf.ENTITY_TYPES, dxf.relevant_layer(F.col("value")))
        n = {r["type"]: r["count"] for r in short(dxf.entities(kept)).groupBy("type").count().collect()}
        assert n == {"INSERT": 3, "MTEXT": 3, "LWPOLYLINE": 3, "TEXT": 21, "LINE": 1}
        v = short(dxf.vertices(kept)).orderBy("ent_no", "v_no").collect()
        assert [(r["v_no"], r["x"]) for r in v] == [(1, 0.0), (2, 60.0), (3, 100.0), (1, 0.0),
                                                    (2, 0.0), (1, 0.0), (2, 5.0)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    lines = drawing().split("\n")
    assert [whole[k] for k in sorted(whole) if k[0].endswith("b.dxf")] == lines[:-1]


def test_networks(built):
    m = {(r["id"], r["x"], r["y"], r["matched"]) for r in short(built.manholes).collect()}
    assert m == {("R1", 0.0, 0.0, True), ("R2", 100.0, 0.0, True), ("R9", 5000.0, 5000.0, False),
                 ("R?", 500.0, 900.0, False)}
    labels = short(built.pipe_labels).collect()
    assert [(r["material"], r["diam"], r["length"], r["slope"], r["dir"]) for r in labels] == [
        ("CR16", "0315", "30.00", "-0.55", "-->")]
    assert short(built.dn_pipes).first()["diam"] == "200"
    assert {r["diam"] for r in short(built.supply_pipes).collect()} == {"110", "160"}
    assert [r["id"] for r in short(built.fire_nodes).collect()] == ["Incendie1"]
    assert short(built.second_lines).first()["diam"] == "250"


def test_profiles(built):
    p = short(built.profiles).first()
    assert (p["from_node"], p["to_node"], p["material"], p["diam"]) == ("R1", "R2", "PVC-315", 315)
    s = short(built.profile_segments).first()
    assert (s["from_node"], s["to_node"], s["length_m"]) == ("R1", "R2", 100.0)
    assert abs(s["slope"] + 0.01) < 1e-12 and (s["x1"], s["x2"]) == (0.0, 100.0)
    pipes = {r["profile_idx"]: r for r in short(built.annotated_pipes).collect()}
    assert pipes[0]["diam"] == 315 and pipes[0]["total_length"] == 100.0
    assert pipes[-1]["diam"] == 315 and pipes[-1]["label_slope"] == -0.55
    m = {r["id"]: r for r in short(built.enriched_manholes).collect()}
    assert m["R1"]["profile_invert"] == 95.0 and m["R2"]["profile_ground"] == 98.0
    assert m["R9"]["profile_id"] is None


def test_report_and_layers(spark, built, tmp_path):
    r = short(built.report()).first()
    assert (r["manholes"], r["pipes"], r["profiles"], r["profile_segments"]) == (4, 2, 1, 1)
    assert (r["with_label"], r["with_insert"], r["manholes_matched"], r["labels_unmatched"],
            r["inserts_unlabelled"]) == (3, 3, 2, 1, 1)
    assert (r["polylines"], r["pipe_texts"], r["dn_pipes"], r["dn200"]) == (2, 3, 1, 1)
    # 100 + 30 in plan; the line of two of its three vertices is sqrt(50)
    assert (r["pipe_length"], r["dn_length"], r["dn200_length"]) == (130.0, 7.07, 7.07)
    built.write_report(str(tmp_path / "report"))
    doc = next(d for p in sorted((tmp_path / "report" / "report").glob("*.json"))
               for d in map(json.loads, p.read_text().splitlines()) if d["meta"]["file"].endswith("a.dxf"))
    assert doc["manholes"] == {"count": 4, "withLabel": 3, "withInsert": 3, "labeledAndMatched": 2,
                               "labeledUnmatched": 1, "unlabeledInserts": 1}
    assert doc["dn200"] == {"count": 1, "totalLength": 7.07}
    segs = spark.read.parquet(str(tmp_path / "report" / "profile_segments"))
    assert [(s["length_m"], s["slope_pct"]) for s in short(segs).collect()] == [(100.0, -1.0)]
    assert [r["layer"] for r in short(sewer_layers(built.entities)).collect()] == [
        "DN 200", "DN110", "DN160", "EU 1_Canalisations", "EU 1_Canalisations_Habillage", PROFILE,
        "EU 1_Regards", "EU 1_Regards_Habillage", "_AEP", "_RESEAU INCENDIE", "assai 250"]
    pipes, lines, people = keyword_network(built)
    assert short(lines).count() == 1 and short(people).count() == 3


def test_features(built):
    f = features.drawing_features(built).cache()
    kinds = {r["type"]: r["count"] for r in short(f).groupBy("type").count().collect()}
    assert kinds["regard"] == 4 and kinds["pipe"] == 1 and kinds["aep_pipe"] == 2
    line = short(features.feature_json(f)).where("type = 'pipe_dn'").first()["value"]
    assert '"type":"LineString"' in line and '"properties":{"type":"pipe_dn","diam_mm":200' in line


def test_models(spark, built, tmp_path):
    a = built.supply_pipes.where(F.col("file").endswith("a.dxf"))
    pipes = a.select(F.lit("supply").alias("family"), "ent_no", "diam")
    verts = short(built.vertices).join(pipes, "ent_no").select("family", "ent_no", "v_no", "x", "y")
    nodes = short(built.supply_nodes).select(F.lit("supply").alias("family"), "ent_no", "x", "y",
                                             "block_name")
    net = model_text.geometry_network(pipes, verts, nodes)
    lines = [r["line"] for r in model_text.geometry_model(spark, net).orderBy("part", "row").collect()]
    assert "; Topology warning: 1 of 2 components disconnected from source" in lines
    assert "P1\tJ1\tJ2\t10.0000\t110.0\t140.0\t0.0000\tOpen" in lines
    assert "V1\tJ1\tJ2\t110.0\tFCV\t0.0\t0.0000" in lines
    assert "J3\t0.000\t0.000000\t\t;Té03Brides_DN63" in lines
    # the written model reads back
    model_text.write_lines(model_text.geometry_model(spark, net), str(tmp_path / "inp"))
    back = inp.model_tables(inp.read_sections(spark, str(tmp_path / "inp" / "*.txt")))
    assert back["pipes"].count() == 3

    m = short(built.enriched_manholes).withColumn("row_no", F.col("part") * 1000 + F.col("turn"))
    segs = short(built.profile_segments).withColumn("row_no", F.col("pos"))
    sewer = [r["line"] for r in model_text.sewer_model(
        spark, model_text.sewer_tables(m, segs)).orderBy("part", "row").collect()]
    assert "C1\tR1\tR2\t100.00\t0.012\t\t\t0\t0" in sewer and "C1\tCIRCULAR\t1.03\t\t\t\t1" in sewer


def test_update_and_rename(spark, folder, built):
    j = spark.createDataFrame([("A", 1, 0.2, 0.0), ("B", 2, 10.0, 0.1), ("C", 3, 10.0, 10.0),
                               ("O", 4, 0.0, 0.0)], "id string, row_no int, x double, y double")
    p = spark.createDataFrame([("A", "B", 1, 90.4), ("C", "B", 2, 63.0)],
                              "node1 string, node2 string, row_no int, diameter double")
    v = spark.createDataFrame([("C", 1, 40.0)], "node string, row_no int, diameter double")
    heads = short(built.supply_pipes)
    verts = short(built.vertices).join(heads.select("ent_no"), "ent_no", "left_semi")
    new = update.update_pipes(heads, update.pipe_diameters(verts, j, p, 1.0))
    got = {r["old_layer"]: (r["layer"], r["diam"]) for r in new.collect()}
    assert got == {"DN110": ("DN90", "90"), "DN160": ("DN160", "160")}
    nodes = update.update_nodes(short(built.supply_nodes), j, p, v, 1.0)
    assert {r["block_name"] for r in nodes.collect()} == {"VanneDN110", "Té03Brides_DN40"}
    lines = read_lines(spark, folder)
    out = dxf.rename_in_lines(lines, update.rename_table(new, "old_layer", "layer"),
                              update.rename_table(nodes, "old_block", "block_name"))
    rows = out.where(F.col("file").endswith("b.dxf")).orderBy("line_no").collect()
    text_ = "".join(r["text"] + r["ending"] for r in rows)
    want = drawing().replace("8\nDN110\n", "  8\nDN90\n").replace(
        "2\nTé03Brides_DN63\n", "  2\nTé03Brides_DN40\n").replace("\n", "\r\n")
    assert text_ == want


def test_proxy(spark, tmp_path):
    def chunk(code, body):
        return struct.pack("<II", len(body) + 8, code) + body

    line = chunk(6, struct.pack("<I6d", 2, 0, 0, 0, 3, 4, 0))
    label = chunk(36, struct.pack("<9d", 1, 2, 0, 0, 0, 1, 0, 1, 0) + struct.pack("<3d", 2.5, 1, 0)
                  + "Né".encode("utf-16-le") + b"\0\0\0\0")
    bad = chunk(6, struct.pack("<I", 9))
    blob = (b"\0" * 8 + line + bad + label).hex().upper()
    body = "".join(
        tag((0, "ACAD_PROXY_ENTITY"), (5, h), (8, layer), (92, len(blob) // 2),
            (310, blob[:60]), (310, blob[60:]), (93, 1), (310, "FFFF"))
        for h, layer in (("A1", "C-STRM-PIPE"), ("A2", "C-SSWR-TEXT"), ("A3", "OTHER")))
    body += insert("X", 5, 6, "MH")
    path = tmp_path / "p.dxf"
    path.write_bytes((tag((0, "SECTION"), (2, "ENTITIES")) + body + tag((0, "ENDSEC"))).encode())
    tags = dxf.read_tags(spark, str(path))
    marked = dxf.mark_entities(tags)
    assert dxf.drawing_format(tags).first()["format"] == "proxy"
    blobs = dxf.proxy_entities(marked)
    assert {r["handle"]: r["hex"] for r in blobs.collect()} == {"A1": blob, "A2": blob}
    subs = proxy.decode_proxies(blobs).where("handle = 'A1'").orderBy("sub_no").collect()
    assert [r["kind"] for r in subs] == ["POLYLINE", "ERROR", "TEXT"]
    assert subs[2]["text"] == "Né" and abs(subs[2]["rotation"] - 90) < 1e-9
    net = features.proxy_network(blobs, dxf.insert_blocks(marked))
    assert net["pipes"].first()["length_m"] == 5.0
    assert net["labels"].first()["text"] == "Né"
    assert features.proxy_features(net).count() == 3


def test_written_bytes(spark, tmp_path):
    lines = {"a.dxf": b"  0\r\nSECTION\r\n  8\r\nR\xe9gard\r\n", "b.dxf": b"  8\nvoil\xe0\n\n"}
    for name, raw in lines.items():
        (tmp_path / name).write_bytes(raw)
    read = read_lines(spark, str(tmp_path / "*.dxf"))
    out = tmp_path / "out"
    model_text.write_numbered(read.repartition(3), str(out))
    for name, raw in lines.items():
        parts = sorted((out / name).glob("part-*"))
        assert b"".join(p.read_bytes() for p in parts) == raw
    text = spark.createDataFrame([(0, 0, 0, "Té"), (0, 1, 0, "日ü")],
                                 "part int, row int, sub int, line string")
    model_text.write_drawing(text, str(tmp_path / "drawing"))
    parts = sorted((tmp_path / "drawing").glob("part-*"))
    assert b"".join(p.read_bytes() for p in parts) == b"T\xe9\n?\xfc\n"
    assert sorted(r.text for r in read_lines(spark, str(tmp_path / "drawing")).collect()) == [
        "?ü", "Té"]
    names = spark.createDataFrame([("a.dxf", "Régard", "Été")], "file string, old string, new string")
    renamed = dxf.rename_in_lines(
        read.withColumn("file", F.element_at(F.split("file", "/"), -1)), names.select("old", "new"))
    model_text.write_numbered(renamed, str(tmp_path / "renamed"))
    parts = sorted((tmp_path / "renamed" / "a.dxf").glob("part-*"))
    assert b"".join(p.read_bytes() for p in parts) == lines["a.dxf"].replace(b"R\xe9gard", b"\xc9t\xe9")


def test_tags_by_split_are_tags_in_sequence(spark, tmp_path):
    rnd = random.Random(9)
    for i in range(4):
        lines = [rnd.choice([str(rnd.randint(0, 99)), " 7", "text", "", "8x", "R\xe9"])
                 for _ in range(400)]
        lines[-1] = "end"  # an empty last line without an end is no line
        lines[100:160] = [str(rnd.randint(0, 9)) for _ in range(60)]  # a split without any text
        (tmp_path / f"{i}.dxf").write_bytes("\r\n".join(lines).encode("latin-1"))
    want = set()
    for f in tmp_path.glob("*.dxf"):
        lines, i = f.read_bytes().decode("latin-1").split("\r\n"), 0
        while i < len(lines):
            code = re.match(r"\s*([+-]?[0-9]+)", lines[i])
            if code and i + 1 < len(lines):
                want.add((f.name, i, int(code[1]), lines[i + 1]))
            i += 2 if code else 1
    before = {k: spark.conf.get(k) for k in (
        "spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    held = dxf.HELD_SPLITS
    try:
        for size, rows, few in (("128m", "10000", held), ("100b", "10000", held),
                                ("100b", "3", held), ("150b", "7", 0)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            dxf.HELD_SPLITS = few
            got = [(r.file.split("/")[-1], r.tag_no, r.code, r.value)
                   for r in dxf.read_tags(spark, str(tmp_path / "*.dxf")).collect()]
            assert len(got) == len(want) and set(got) == want
    finally:
        dxf.HELD_SPLITS = held
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rows_by_vertex_are_not_broadcast(spark):
    points = spark.range(40).selectExpr("cast(id as string) id", "id row_no", "id * 3.0 + 1 x", "1.0 y")
    pipes = spark.range(39).selectExpr("cast(id as string) node1", "cast(id + 1 as string) node2",
                                       "id row_no", "id % 4 * 10.0 diameter")
    corners = spark.range(40).selectExpr("id div 5 ent_no", "id v_no", "id * 3.0 + 1.25 x", "1.0 y")
    got = update.pipe_diameters(corners, points, pipes)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    of = {i: [j % 4 * 10 for j in range(5 * i, 5 * i + 4)] for i in range(8)}
    expected = {i: max(of[i], key=of[i].count) for i in of}
    assert {r["ent_no"]: r["diameter"] for r in got.collect()} == expected


def test_read_lines_are_numbered_without_moving_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(model_text, "RUN", 3)
    text = ["0", "SECTION", "2", "ENTITIES"]
    for n in range(5):
        text += ["0", "LWPOLYLINE", "8", "", "90", str(n + 2)]
        for v in range(n + 2):
            text += ["10", f"{n}.5", "20", f"{v}.25"]
    text += ["0", "ENDSEC", "0", "EOF"]
    for i, at in enumerate(range(0, len(text), 11)):
        (tmp_path / f"part-{i:05d}.txt").write_text("\n".join(text[at:at + 11]) + "\n")
    parts = read_lines(spark, str(tmp_path)).selectExpr(
        "file AS part", "line_no AS row", "text AS line")
    got = model_text.numbered_lines(parts, counted=True)
    plain = model_text.numbered_lines(parts)
    assert {tuple(r) for r in got.drop("block").collect()} == {tuple(r) for r in plain.collect()}
    assert all(r.block == r.line_no // 3 for r in got.collect())
    assert "rangepartitioning" not in got._jdf.queryExecution().toString()

    def shapes(numbered):
        kept = dxf.model_space(dxf.mark_entities(dxf.tags_from_lines(numbered)), ["LWPOLYLINE"])
        return sorted(tuple(r) for r in dxf.vertices(kept).collect())
    assert shapes(got) == shapes(plain)
    assert [r[2:] for r in shapes(got)] == [
        (v + 1, n + 0.5, v + 0.25) for n in range(5) for v in range(n + 2)]
