"""Files stored byte for byte: renamed drawings, parts of attempts, equal names."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waterloom.plans import model_text
from waterloom.sources import dxf, parts
from waterloom.sources.lines import read_lines


def stored(folder, name):
    return b"".join(p.read_bytes() for p in sorted((folder / name).glob("part-*")))


def plain_rename(raw, layers, blocks):
    """One line after the other, as a reader of the format goes."""
    lines = raw.split(b"\n")
    tail = lines.pop() if not raw.endswith(b"\n") else lines.pop() or None
    ends = [b"\r\n" if x.endswith(b"\r") else b"\n" for x in lines]
    texts = [x[:-1] if e == b"\r\n" else x for x, e in zip(lines, ends)]
    if tail:
        cr = tail.endswith(b"\r")
        texts.append(tail[:-1] if cr else tail)
        ends.append(b"\r" if cr else b"")
    texts = [t.decode("latin-1") for t in texts]
    i = 0
    while i < len(texts):
        code = re.match(r"\s*([+-]?[0-9]+)", texts[i])
        if not code:
            i += 1
            continue
        if i + 1 < len(texts) and int(code[1]) in (2, 8):
            c, v = int(code[1]), texts[i + 1]
            new = layers.get(v) or (blocks.get(v) if c == 2 else None)
            if new is not None:
                texts[i], texts[i + 1] = f"{c:>3}", new
        i += 2
    return b"".join(t.encode("latin-1", "replace") + e for t, e in zip(texts, ends))


LAYERS = {"Régard": "Été", "A": "B", "B": "C", "8": "eight"}
BLOCKS = {"A": "never, the layer comes first", "VALVE": "VANNE日"}


def random_file(rnd, end):
    values = ["Régard", "A", "B", "8", "VALVE", "text", "", " 8", "x\ry"]
    lines = [rnd.choice([*values, "  8", "2", " 2", "0", "10", "8x"]) for _ in range(rnd.randrange(1, 400))]
    return end.join(lines).encode("latin-1") + rnd.choice([b"", end.encode(), b"\r"])


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in (
        "spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_renamed_files_are_equal_elsewhere(spark, tmp_path, small_splits):
    rnd = random.Random(6)
    files = {f"{d}/{n}": random_file(rnd, rnd.choice(["\n", "\r\n"]))
             for d in ("a", "b") for n in ("x.dxf", "y.dxf", "z.dxf")}
    files |= {"a/empty.dxf": b"", "a/one.dxf": b"8", "b/pair.dxf": b"8\nA", "b/blank.dxf": b"\n\n",
              "b/é &=1.dxf": b"  8\r\nA\r\n"}
    for name, raw in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(raw)
    layers = spark.createDataFrame(list(LAYERS.items()), "old string, new string")
    blocks = spark.createDataFrame(list(BLOCKS.items()), "old string, new string")
    splits, held = dxf.HELD_SPLITS, dxf.HELD_NAMES
    try:
        for i, (size, rows, few, most) in enumerate((
                ("128m", "10000", splits, held), ("60b", "10000", splits, held),
                ("90b", "3", splits, held), ("150b", "7", 0, held), ("100b", "5", splits, 1))):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            dxf.HELD_SPLITS, dxf.HELD_NAMES = few, most
            out = tmp_path / f"out{i}"
            got = dxf.rename_files(spark, str(tmp_path / "in" / "*"), str(out), layers, blocks)
            assert {r.target for r in got.collect()} == set(files)
            for name, raw in files.items():
                assert stored(out, name) == plain_rename(raw, LAYERS, BLOCKS), (i, name)
    finally:
        dxf.HELD_SPLITS, dxf.HELD_NAMES = splits, held
    listed = {}
    for r in parts.list_parts(spark, str(out)).orderBy("part").collect():
        listed[r.file] = listed.get(r.file, 0) + r.bytes
    assert listed == {n: len(plain_rename(raw, LAYERS, BLOCKS)) for n, raw in files.items()}
    back = {}
    for r in parts.read_parts(spark, str(out)).orderBy("part").collect():
        back[r.file] = back.get(r.file, b"") + bytes(r.content)
    assert back == {n: plain_rename(raw, LAYERS, BLOCKS) for n, raw in files.items()}


def test_files_of_equal_name_stay_apart(spark, tmp_path):
    for d in "ab":
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.dxf").write_bytes(b"".join(f"{d}{i}\n".encode() for i in range(50)))
    lines = read_lines(spark, str(tmp_path / "*" / "x.dxf")).repartition(5)
    model_text.write_numbered(lines, str(tmp_path / "out"))
    for d in "ab":
        assert stored(tmp_path / "out", f"{d}/x.dxf") == (tmp_path / d / "x.dxf").read_bytes()


def test_only_parts_of_the_attempts_that_count_stay(tmp_path):
    folder = str(tmp_path / "out")
    writer = parts.PartWriter(folder)

    def batch(*rows):
        return pa.RecordBatch.from_pydict({
            "file": [r[0] for r in rows], "part": [r[1] for r in rows], "value": [r[2] for r in rows]})

    rows = batch(("f", "0", b"ab"), ("f", "0", b"c"), ("f", "1", b"d"))
    lost = writer.write(iter([rows]))  # an executor that is lost after it has written
    again = writer.write(iter([rows]))
    other = writer.write(iter([batch(("g/h", "0", None))]))

    def failing():
        yield batch(("f", "2", b"half"))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(failing())
    assert lost.parts != again.parts
    writer.commit([again, other, None])
    assert stored(tmp_path / "out", "f") == b"abcd" and stored(tmp_path / "out", "g/h") == b""
    assert len(list((tmp_path / "out").rglob("part-*"))) == 3
    failed = parts.PartWriter(str(tmp_path / "bad"))
    failed.abort([failed.write(iter([rows])), None])
    assert not list((tmp_path / "bad").rglob("part-*"))


def test_columns_are_checked(spark, tmp_path):
    spark.dataSource.register(parts.PartFiles)
    wrong = spark.range(1).select(F.lit("a").alias("file"))
    with pytest.raises(Exception, match="columns must be"):
        wrong.write.format("part_files").mode("append").save(str(tmp_path / "x"))
