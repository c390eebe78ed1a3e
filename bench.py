"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import pathlib
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from waterloom.plans import model_text  # noqa: E402
from waterloom.queries import QUERIES, tracks  # noqa: E402
from waterloom.sources import dxf  # noqa: E402

HEADLINES = [
    "track_length", "points_at_distance", "nearest_within", "nearest_any", "nearest_value",
    "components", "mode_first_to_max", "encounter_ids", "normalise_text", "column_profile",
    "field_findings", "missing_refs", "merge_status", "merged_elements", "section_gather",
    "mapped_projection", "fixed_decimals", "name_similarity", "detect_tables", "split_links",
]
#: Drawing text scanned, half in many files and half in one.
SCAN_BYTES = 300_000_000


def timed(fn):
    start = time.time()
    fn()
    return round(time.time() - start, 3)


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINES
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("waterloom-bench")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    for name in wanted:
        def run(fn=QUERIES[name]):
            fn(spark, folder).write.format("noop").mode("overwrite").save()
        cold = timed(run)  # the warm-up
        out[name] = statistics.median(timed(run) for _ in range(3))
        print(f"{name}: {cold} cold, {out[name]} median of three", file=sys.stderr, flush=True)
    extra = {}
    if not sys.argv[1:]:
        # tag scan throughput on a drawing written from the tracks
        where = tempfile.mkdtemp(prefix="waterloom-bench-")
        line = tracks(spark, folder, numbered=True).selectExpr(
            "user_id AS ent_no", "v_no", "x", "y")
        heads = line.select("ent_no").distinct().selectExpr(
            "ent_no", "concat('L', ent_no) AS layer", "false AS closed")
        model_text.write_drawing(model_text.drawing_text(
            spark, polylines_=[(heads, line)]), f"{where}/one")
        text = b"".join(f.read_bytes() for f in sorted(pathlib.Path(where).glob("one/part-*")))
        times = -(-SCAN_BYTES // 2 // len(text))
        for i in range(times):  # half the text in many files, half in one
            pathlib.Path(where, f"many-{i}.dxf").write_bytes(text)
        with pathlib.Path(where, "big.dxf").open("wb") as f:
            for _ in range(times):
                f.write(text)
        for name in ("many-*", "big"):
            def scan(name=name):
                dxf.read_tags(spark, f"{where}/{name}.dxf").write.format("noop").mode(
                    "overwrite").save()
            scan()
            took = statistics.median(timed(scan) for _ in range(3))
            out[f"tag_scan_{name.strip('-*')}"] = took
            size = times * len(text) / 1e6
            extra |= {f"tag_scan_{name.strip('-*')}_mb": round(size, 1),
                      f"tag_scan_{name.strip('-*')}_mb_per_s": round(size / took, 2)}
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(out.values()), 3),
        "unit": "sec", "queries": out, "sf": pathlib.Path(folder).name.removeprefix("sf"), **extra,
    }))


if __name__ == "__main__":
    main()
