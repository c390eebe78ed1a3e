"""Detection, profiling, validation and merging on the shapes the tables arrive in."""

import itertools

import pytest
from pyspark.sql import functions as F

from waterloom import schema
from waterloom.sources import csvfiles
from waterloom.operators import detect, merge, ordered, profiling, validate

FILES = {
    "junctions": ("id,elevation,demand", "J1,73.2,0.16", "J2,68.3,0.19", "J3,65.5,0.23"),
    "fuzzy": ("noeud,alt,consommation", "N1,73.2,0.16", "N2,68.3,0.19"),
    "pipes": ("id,node1,node2,length,diameter,roughness", "P1,J1,J2,100,200,140",
              "P2,J2,J3,150,150,130"),
    "alias": ("id,from,to,length_m,diam", "P1,1,2,100,200", "P2,2,3,150,150"),
    "valves": ("id,node1,node2,diameter,type,setting", "V1,J1,J2,200,PRV,50",
               "V2,J3,J4,150,FCV,30"),
    "nonsense": ("foo,bar,baz", "1,hello,world", "2,foo,bar"),
    "by_values": ("code,elev,dem", "J1,100,1", "J2,200,2", "J3,300,3"),
    "suggest": ("id,from,to,len,diam,roughn", "P1,J1,J2,100,200,140", "P2,J2,J3,200,150,130"),
    "positional": ("qqq,www,zzz", "A,5,x", "B,6,y"),
}


def cells(spark, files):
    rows = []
    for name, lines in files.items():
        headers = lines[0].split(",")
        for n, line in enumerate(lines[1:], 1):
            for i, (h, v) in enumerate(zip(headers, line.split(","))):
                rows.append((name, n, i, h, v))
    return spark.createDataFrame(rows, "file string, row_no int, col_no int, header string, value string")


@pytest.fixture(scope="module")
def matched(spark):
    c = cells(spark, FILES)
    m = detect.column_matches(c, ["file"]).cache()
    return c, m


def test_detect_types(matched):
    _, m = matched
    found = {r["file"]: r for r in
             detect.detect_tables(detect.table_scores(m, ["file"]), ["file"]).collect()}
    assert found["junctions"]["detected_type"] == "JUNCTIONS"
    assert found["junctions"]["confidence"] > 0.5
    assert found["fuzzy"]["detected_type"] == "JUNCTIONS" and found["fuzzy"]["confidence"] > 0.3
    assert found["pipes"]["detected_type"] == "PIPES" and found["pipes"]["confidence"] > 0.5
    assert found["alias"]["detected_type"] == "PIPES"
    assert found["valves"]["detected_type"] == "VALVES"
    assert "nonsense" not in found or found["nonsense"]["confidence"] < 0.4


def test_suggested_fields(matched):
    _, m = matched
    d = detect.detect_tables(detect.table_scores(m, ["file"]), ["file"])
    got = {(r["file"], r["header"]): r["field"]
           for r in detect.suggest_fields(m, d, ["file"]).collect()}
    assert got["by_values", "code"] == "id"
    assert got["alias", "from"] == "node1" and got["alias", "diam"] == "diameter"


def test_suggest_for_type(spark):
    c = cells(spark, {k: FILES[k] for k in ("suggest", "positional")})
    got = {(r["file"], r["header"]): (r["field"], r["score"])
           for r in detect.suggest_for_type(c, "PIPES", ["file"]).collect()}
    assert got["suggest", "diam"][0] == "diameter"
    assert got["suggest", "from"][0] == "node1"
    assert got["suggest", "roughn"][0] == "roughness"
    assert got["positional", "qqq"] == ("id", 0.5) and got["positional", "zzz"] == ("node2", 0.5)


def test_overrides_and_coverage(spark, matched):
    _, m = matched
    d = detect.detect_tables(detect.table_scores(m, ["file"]), ["file"])
    s = detect.suggest_fields(m, d, ["file"]).where("file = 'junctions'")
    o = spark.createDataFrame([("junctions", "demand", None, True),
                               ("junctions", "elevation", "head", False)],
                              "file string, header string, field string, ignored boolean")
    got = {r["header"]: r["field"] for r in detect.apply_overrides(s, o, ["file"]).collect()}
    assert got == {"id": "id", "elevation": "head"}
    cover = detect.mapping_coverage(s, "JUNCTIONS", ["file"]).first()
    assert cover["covered"] == 2 and cover["share"] == 1.0


def test_confidence(spark):
    rows = spark.createDataFrame([("id", True), ("elevation", True), ("demand", True)],
                                 "field string, matched boolean")
    assert detect.match_confidence(rows, "JUNCTIONS").first()[0] > 0.9
    assert detect.match_confidence(rows.where("field = 'demand'"), "JUNCTIONS").first()[0] < 0.5


def test_every_field_has_words_and_no_word_twice():
    for section in schema.REQUIRED:
        for field in schema.all_fields(section):
            folded = [schema.fold(w) for w in schema.synonyms(section, field)]
            assert folded and len(folded) == len(set(folded)), (section, field)
    assert schema.fold("Node_ID") in {schema.fold(w) for w in schema.synonyms("JUNCTIONS", "id")}
    assert schema.synonyms("PIPES", "nope") == ["nope"]


def test_the_earlier_word_wins_a_tie(spark):
    # one letter from "len" and from "lng": equally similar, "len" is listed first
    h = spark.createDataFrame([("leng",), ("lon",)], "header string")
    got = {(r.header, r.section, r.field): r.word for r in detect.header_matches(
        h, sections=["PIPES", "COORDINATES"]).collect()}
    words = schema.synonyms("PIPES", "length")
    assert words.index("len") < words.index("lng")
    assert got["lon", "COORDINATES", "x"] == "lon"
    scores = {w: _plain_similarity("leng", schema.fold(w)) for w in words}
    best = max(scores.values())
    assert got["leng", "PIPES", "length"] == next(w for w in words if scores[w] == best)
    twice = spark.createDataFrame(
        [("PIPES", "length", 3, "abx", 0), ("PIPES", "length", 3, "aby", 1)],
        "section string, field string, field_ord int, word string, word_ord int")
    one = detect.header_matches(spark.createDataFrame([("abz",)], "header string"),
                                synonyms=twice, sections=["PIPES"]).first()
    assert one.word == "abx"


def _plain_similarity(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            rows[i].append(min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y)))
    return 1 - rows[-1][-1] / max(len(a), len(b))


def test_profile_and_junk(spark):
    rows = [(i, "n", str(10 * (i + 1))) for i in range(5)]
    rows += [(i, "c", v) for i, v in enumerate(["Open", "Closed", "Open", "Closed"])]
    rows += [(i, "id", f"J{i}") for i in range(5)] + [(i, "j", ";") for i in range(5)]
    rows += [(i, "empty", "") for i in range(3)]
    df = spark.createDataFrame(rows, "row_no int, header string, value string")
    p = {r["header"]: r for r in profiling.column_profile(df, ["header"]).collect()}
    assert (p["n"]["min"], p["n"]["max"], p["n"]["mean"], p["n"]["unique"]) == (10, 50, 30, 5)
    assert p["c"]["categorical"] and p["c"]["category_values"] == ["closed", "open"]
    assert p["id"]["uniqueness"] == 1.0 and not p["id"]["categorical"]
    assert p["empty"]["categorical"] and p["empty"]["total"] == 0
    assert [r["header"] for r in profiling.junk_columns(df, ["header"]).collect()] == ["j"]


def test_mean_of_numbers_whose_sum_is_large(spark):
    big = 4.0e12  # under 2**42; three of them are beyond 2**43
    df = spark.createDataFrame([(i, "n", str(int(big) + i)) for i in range(12)],
                               "row_no int, header string, value string")
    got = profiling.column_profile(df.unionByName(df), ["header"]).first()
    assert got["mean"] == big + 5.5 and got["total"] == 24
    values = spark.createDataFrame([(i, v) for i, v in enumerate([big, 0.25, -3 * big, big, big, -0.5] * 4)],
                                   "i int, v double")
    summed = ordered.Sequence(values, [], "i").running_sum(s=F.col("v")).df.orderBy("i").collect()
    assert [r["s"] for r in summed] == list(itertools.accumulate(r["v"] for r in summed))


def test_discriminator(spark):
    rows = [(0, "Section", v) for v in ("JUNCTIONS", "PIPES", "JUNCTIONS", "PIPES")]
    rows += [(1, "col1", v) for v in ("a", "b", "c", "d")]
    df = spark.createDataFrame(rows, "col_no int, header string, value string")
    got = profiling.discriminator_columns(df, []).collect()
    assert got[0]["header"] == "Section" and got[0]["match_ratio"] == 1.0


def findings(spark, field, values, ids=None):
    df = spark.createDataFrame([(field, i, v) for i, v in enumerate(values)],
                               "field string, row_no int, value string")
    idf = spark.createDataFrame([(i,) for i in ids], "id string") if ids else None
    f = validate.field_findings(df, ids=idf)
    sev = validate.column_severity(df, f).first()["severity"]
    return {(r["check"], r["row_no"]) for r in f.collect()}, sev


def test_field_findings(spark):
    got, sev = findings(spark, "elevation", ["100", "200", "9500"])
    assert got == {("out_of_range", 2)} and sev == "warning"
    got, sev = findings(spark, "elevation", ["100", "200", "N/A", "400", "-", "600"])
    assert got == {("nullable", 2), ("nullable", 4)} and sev == "blocking"
    got, sev = findings(spark, "elevation", ["x", "99999"])
    assert got == {("type_mismatch", 0)} and sev == "blocking"
    got, sev = findings(spark, "diameter", ["100", "-50", "200"])
    assert ("negative", 1) in got and sev == "warning"
    got, sev = findings(spark, "demand", ["100", "-", "300"])
    assert got == {("default", 1)} and sev == "ok"
    got, sev = findings(spark, "node1", ["J1", "J2", "J99"], ["J1", "J2"])
    assert got == {("missing_ref", 2)} and sev == "blocking"
    got, sev = findings(spark, "id", ["J1", "J2", "J1"])
    assert got == {("duplicate_id", 2)} and sev == "blocking"
    got, sev = findings(spark, "id", ["a" * 32])
    assert got == {("too_long", 0)} and sev == "warning"
    got, sev = findings(spark, "parameters", ["HEAD 8", "invalid", "HEAD 10"])
    assert got == {("compound_format", 1)} and sev == "warning"
    got, sev = findings(spark, "status", ["open", "weird"])
    assert got == {("invalid_categorical", 1)}


def test_references_and_gate(spark):
    j = spark.createDataFrame([("J1", 1), ("J2", 2), ("J1", 3)], "id string, row_no int")
    r = spark.createDataFrame([("R1", 1)], "id string, row_no int")
    p = spark.createDataFrame([("P1", "J1", "J99", 1), ("P2", "R1", "J1", 2)],
                              "id string, node1 string, node2 string, row_no int")
    v = spark.createDataFrame([("V1", "J1", "", 1)],
                              "id string, node1 string, node2 string, row_no int")
    tables = {"junctions": j, "reservoirs": r, "pipes": p, "valves": v}
    got = {(x["type"], x["section"], x["id"], x["field"], x["value"], x["message"])
           for x in validate.reference_findings(tables).collect()}
    assert got == {
        ("duplicate_id", "JUNCTIONS", "J1", None, None, "Duplicate junction ID: J1"),
        ("missing_ref", "PIPES", "P1", "Node2", "J99", 'Pipe P1 Node2 "J99" not found in nodes'),
    }
    gate = validate.project_gate(tables).first()
    assert gate["blocking"] == 1 and not gate["can_generate"] and gate["warnings"] == 3
    ok = validate.project_gate({**tables, "pipes": p.where("id = 'P2'")}).first()
    assert ok["can_generate"]
    split = {x["id"]: x["valid"] for x in validate.split_links(p, j.unionByName(r)).collect()}
    assert split == {"P1": False, "P2": True}


SCHEMA = "id string, elevation double, _source string, row_no int"


def test_merge(spark):
    stored = spark.createDataFrame([("J1", 100.0, "a", 1)], SCHEMA)

    def run(rows, columns=SCHEMA):
        res = merge.merge_elements(stored, spark.createDataFrame(rows, columns), source="b")
        return res, sorted(r["status"] for r in res.incoming.collect())

    res, status = run([("J1", 100.0, "b", 1)])
    assert status == ["identical"] and res.elements.count() == 1
    res, status = run([("J1", 200.0, "b", 1)])
    assert status == ["conflict"] and res.elements.count() == 1
    res, status = run([("J2", 1.0, "b", 1), ("J2", 2.0, "b", 2), (None, 3.0, "b", 3)])
    assert status == ["conflict", "new", "new"] and res.elements.count() == 3
    res, status = run([("J1", 1)], "id string, row_no int")
    assert status == ["compatible"] and res.elements.count() == 2


def test_resolve_remove_and_edit(spark):
    stored = spark.createDataFrame([("J1", 100.0, "a", 1), ("J2", 5.0, "b", 2)], SCHEMA)
    incoming = spark.createDataFrame([("J1", 200.0, "b", 1)], SCHEMA)
    res = merge.merge_elements(stored, incoming, source="c")

    def after(how):
        d = spark.createDataFrame([("J1", how)], "id string, resolution string")
        out = merge.resolve_conflicts(res.elements, res.conflicts, d)
        return sorted((r["id"], r["elevation"], r["_source"]) for r in out.collect())

    assert after("keep_existing") == [("J1", 100.0, "a"), ("J2", 5.0, "b")]
    assert after("replace") == [("J1", 200.0, "c"), ("J2", 5.0, "b")]
    assert after("rename") == [("J1", 100.0, "a"), ("J1_new", 200.0, "c"), ("J2", 5.0, "b")]
    assert [r["id"] for r in merge.remove_source(stored, "a").collect()] == ["J2"]
    pipes = spark.createDataFrame([(1, "90", "DN 90"), (2, "110", "DN110")],
                                  "k int, diam string, layer string")
    got = merge.change_diameter(pipes, "90", "125").orderBy("k").collect()
    assert [(r["diam"], r["layer"]) for r in got] == [("125", "DN125"), ("110", "DN110")]
    one = merge.edit_rows(pipes, spark.createDataFrame([(2, "63")], "k int, diam string"), "k",
                          layer="layer", spaced=True).orderBy("k").collect()
    assert [(r["diam"], r["layer"]) for r in one] == [("90", "DN 90"), ("63", "DN 63")]


def test_similar_ids(spark):
    ids = spark.createDataFrame([("J511",), ("J512",), ("J100",)], "id string")
    got = detect.similar_ids(ids, ["J-511"]).orderBy(F.col("similarity").desc()).collect()
    assert got[0]["id"] == "J511" and "J100" not in [r["id"] for r in got]


def test_differences(spark):
    a = spark.createDataFrame([(1, "x", 2.0), (2, "y", 3.0)], "id int, a string, b double")
    b = spark.createDataFrame([(1, "x", 2.5), (2, None, 3.0)], "id int, a string, b double")
    got = {(r["id"], r["field"]) for r in merge.field_differences(a, b, ["id"]).collect()}
    assert got == {(1, "b"), (2, "a")}


def test_blank_lines_have_no_row_number(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n\nid;elevation\n\nJ1;5\n  \nJ2;7\n")
    (tmp_path / "b.csv").write_text("id,elevation\nJ3,1\n")
    rows = csvfiles.read_rows(spark, str(tmp_path / "*.csv"))
    got = sorted((r.file[-5], r.row_no, r.cells) for r in rows.collect())
    assert got == [("a", 0, ["id", "elevation"]), ("a", 1, ["J1", "5"]), ("a", 2, ["J2", "7"]),
                   ("b", 0, ["id", "elevation"]), ("b", 1, ["J3", "1"])]


def test_similar_ids_by_kind_are_those_of_all_pairs(spark):
    stored = [("pipe", f"P-{i}") for i in range(40)] + [("node", "J511"), ("node", "J5"), ("node", ""),
                                                       ("node", "Conduite principale"), ("pipe", "J511")]
    new = [("node", "J-511"), ("pipe", "P-3x"), ("node", "conduite principal"), ("pipe", "")]
    a = spark.createDataFrame(stored, "kind string, id string")
    b = spark.createDataFrame(new, "kind string, new_id string")
    got = {(r.id, r.new_id) for r in detect.similar_ids(a, b, keys=["kind"]).collect()}
    pairs = a.withColumnRenamed("kind", "k").join(b, F.col("k") == F.col("kind")).withColumn(
        "s", detect.similarity(F.col("new_id"), F.col("id"))).where("s > 0.7 AND s < 1 AND id <> ''")
    assert got == {(r.id, r.new_id) for r in pairs.collect()} and ("J511", "J-511") in got
