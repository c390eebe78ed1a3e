"""Decode proxy-graphic blobs into polyline and text rows, one Arrow batch at a time."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Chunk types that carry content.
POLYLINE, POLYGON, NORMALS = 6, 7, 32
TEXTS = {10: ("latin-1", 1), 36: ("utf-16-le", 2)}
LONG_TEXTS = {11: ("latin-1", 1), 38: ("utf-16-le", 2)}
COLOUR, LAYER, TRUE_COLOUR = 14, 16, 22

SCHEMA = (
    "file string, ent_no long, handle string, layer string, network string, sub_no int, "
    "kind string, vertices array<struct<x:double,y:double>>, closed boolean, x double, y double, "
    "text string, height double, width double, rotation double, sub_layer string, colour long, "
    "error string"
)


def _padded_text(data: bytes, at: int, encoding: str, unit: int) -> tuple[str, int]:
    end = at
    while end + unit <= len(data) and any(data[end : end + unit]):
        end += unit
    return data[at:end].decode(encoding, "replace"), (end + unit + 3) & ~3


def _chunk(code: int, data: bytes) -> dict | None:
    """Content of one chunk, None for chunks that draw nothing."""
    if code in (POLYLINE, POLYGON, NORMALS):
        (count,) = struct.unpack_from("<I", data, 0)
        xyz = np.frombuffer(data, "<f8", count * 3, 4).reshape(-1, 3)
        if count < 2:
            return None
        points = [{"x": float(x), "y": float(y)} for x, y, _ in xyz]
        return {"kind": "POLYLINE", "vertices": points, "closed": code == POLYGON}
    if code in TEXTS or code in LONG_TEXTS:
        place = struct.unpack_from("<9d", data, 0)
        if code in TEXTS:
            height, width, _ = struct.unpack_from("<3d", data, 72)
            text, _ = _padded_text(data, 96, *TEXTS[code])
        else:
            text, at = _padded_text(data, 72, *LONG_TEXTS[code])
            height, width = struct.unpack_from("<2d", data, at + 8)
        return {
            "kind": "TEXT", "x": place[0], "y": place[1], "text": text, "height": height,
            "width": width, "rotation": math.degrees(math.atan2(place[7], place[6])),
        }
    return None


def decode_blob(hex_text: str) -> Iterator[dict]:
    """Sub-entities of one blob in order; a chunk that cannot be read becomes an error row."""
    data = bytes.fromhex("".join(hex_text.split()))
    at, colour, layer = 8, 256, "0"
    while at + 8 <= len(data):
        size, code = struct.unpack_from("<II", data, at)
        body = data[at + 8 : at + size]
        try:
            if code == COLOUR:
                colour = struct.unpack_from("<I", body)[0]
                colour = colour if colour <= 256 else 256
            elif code == TRUE_COLOUR:
                struct.unpack_from("<I", body)
                colour = 256
            elif code == LAYER:
                layer = str(struct.unpack_from("<I", body)[0])
            else:
                found = _chunk(code, body)
                if found:
                    yield {**found, "sub_layer": layer, "colour": colour}
        except (struct.error, ValueError) as problem:
            yield {"kind": "ERROR", "error": f"type {code}, size {size}: {problem}"}
        if size < 8:
            yield {"kind": "ERROR", "error": f"chunk size {size} at byte {at}"}
            return
        at += size


def decode_proxies(blobs: DataFrame) -> DataFrame:
    """One row per sub-entity of every proxy entity."""
    names = [part.split()[0] for part in SCHEMA.replace("<x:double,y:double>", "").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                base = {"file": r.file, "ent_no": r.ent_no, "handle": r.handle,
                        "layer": r.layer, "network": r.network}
                try:
                    found = list(decode_blob(r.hex))
                except ValueError as problem:
                    found = [{"kind": "ERROR", "error": str(problem)}]
                rows += [{**base, "sub_no": i, **f} for i, f in enumerate(found)]
            yield pd.DataFrame(rows, columns=names).astype(object).where(
                lambda d: d.notna(), None)

    columns = ["file", "ent_no", "handle", "layer", "network", "hex"]
    return blobs.select(*columns).mapInPandas(run, SCHEMA)
