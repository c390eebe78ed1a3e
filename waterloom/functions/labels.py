"""Patterns of drawing annotations: pipe labels, manhole labels, profile texts, layer names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waterloom.functions.numbers import trim

# Annotation formats.
SIZE_LABEL = r"^(\S+)-(\d+)\s+([\d.]+)\s*ml?$"
SLOPE_LABEL = r"^([-\d.]+)\s*%\s*(<--|-->)$"
SEWER_WORDS = r"(?i)assai|canal|caniveau|regard|tn_|sewer|pipe|dn\s+\d"
PROFILE_LAYERS = r"^EU\s+1_PL_.*_Textes$|^Proj\d+\s+.*_PL_.*_Textes$"
# Section headers of a longitudinal profile, in test order.
PROFILE_HEADERS = [
    "Cotes Terrain Naturel", "Numéros des regards", "Cotes fil d'eau",
    "Profondeurs fil d'eau", "Distances partielles", "Distances cumulées", "Pentes",
    "Alignements en plan", "Dimensions et Matériaux", "Profil entre les noeuds",
    "Echelle en X", "Echelle en Y", "PC",
]



def size_label(text: Column) -> Column:
    """Struct {material, diam, length} of a size label, null otherwise."""
    return F.when(text.rlike(SIZE_LABEL), F.struct(
        F.regexp_extract(text, SIZE_LABEL, 1).alias("material"),
        F.regexp_extract(text, SIZE_LABEL, 2).alias("diam"),
        F.regexp_extract(text, SIZE_LABEL, 3).alias("length")))


def slope_label(text: Column) -> Column:
    """Struct {slope, dir} of a slope label, null otherwise."""
    return F.when(text.rlike(SLOPE_LABEL), F.struct(
        F.regexp_extract(text, SLOPE_LABEL, 1).alias("slope"),
        F.regexp_extract(text, SLOPE_LABEL, 2).alias("dir")))


def manhole_label(text: Column, spaced: bool = True) -> Column:
    """Struct {id, ct, cr, pp}: paragraphs of a multi-line label, the last match of each wins.

    ``spaced`` asks for a blank after CT and CR and tests the identifier last; the looser form
    tests it first.
    """
    parts = F.transform(F.split(text, r"\\P"), trim)
    gap = " " if spaced else ""
    kind = lambda s: (
        F.when(s.startswith("CT" + gap), "ct").when(s.startswith("CR" + gap), "cr")
        .when(s.rlike("^P[ :]"), "pp").when(s.rlike(r"^R\d+"), "id")
    )

    def last(name: str) -> Column:
        hits = F.filter(parts, lambda s: kind(s) == name)
        hit = F.try_element_at(hits, F.lit(-1))
        if name != "id":
            hit = trim(F.split_part(hit, F.lit(":"), F.lit(2)))
        return F.coalesce(hit, F.lit("")).alias(name)

    return F.struct(*[last(n) for n in ("id", "ct", "cr", "pp")])


def profile_header(text: Column) -> Column:
    """The profile header a text starts with, null for values."""
    out = F.when(text.startswith(PROFILE_HEADERS[0]), F.lit(PROFILE_HEADERS[0]))
    for header in PROFILE_HEADERS[1:]:
        out = out.when(text.startswith(header), F.lit(header))
    return out


def profile_ends(title: Column) -> Column:
    """Struct {from_node, to_node} of a profile title."""
    pattern = r"noeuds\s+(\S+)-(\S+)"
    return F.struct(F.regexp_extract(title, pattern, 1).alias("from_node"),
                    F.regexp_extract(title, pattern, 2).alias("to_node"))


def material_diameter(material: Column) -> Column:
    """Diameter at the end of a material text (3-4 digits), else after its first dash."""
    end = F.nullif(F.regexp_extract(material, r"(\d{3,4})$", 1), F.lit(""))
    dash = F.nullif(F.regexp_extract(material, r"-(\d{2,4})", 1), F.lit(""))
    return F.coalesce(end, dash).try_cast("int")


def layer_diameter(layer: Column) -> Column:
    """Diameter named by a layer (``DN n`` or ``pipe n``), as text; ``0`` without one."""
    pipe = F.nullif(F.regexp_extract(layer, r"(?i)pipe\s+(\d+)", 1), F.lit(""))
    dn = F.nullif(F.regexp_extract(layer, r"(?i)DN\s*(\d+)", 1), F.lit(""))
    return F.coalesce(pipe, dn, F.lit("0"))


def layer_for_diameter(layer: Column, diameter: Column) -> Column:
    """Layer name for a new diameter, keeping the spacing style of the old name."""
    return F.when(layer.rlike(r"\s"), F.concat(F.lit("DN "), diameter)).otherwise(
        F.concat(F.lit("DN"), diameter))


def block_for_diameter(block: Column, diameter: Column) -> Column:
    """Block name for a new diameter: after a DN prefix, else the trailing number."""
    # every known prefix ends in DN, so the first DN followed by digits decides
    text = diameter.cast("string")
    head = F.regexp_extract(block, r"^(.*?DN)\d+", 1)
    tail = F.regexp_extract(block, r"^.*?DN\d+(.*)$", 1)
    stem = F.regexp_extract(block, r"^(\D+)\d+$", 1)
    return F.when(block.rlike(r"DN\d+"), F.concat(head, text, tail)).when(
        block.rlike(r"^\D+\d+$"), F.concat(stem, text)).otherwise(block)
