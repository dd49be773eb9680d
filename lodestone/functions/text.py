"""Names, dates and query routing as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Words that route a query to layers, and what they add to its prompt."""

    words: tuple[str, ...]
    layers: tuple[str, ...]
    hint: str


# Words, layers and hints of the two routers.
SHORT_RULES = (
    Rule(("construction", "building", "urban"), ("true_color", "false_color_nir"), "high albedo concrete"),
    Rule(("road", "highway", "street"), ("false_color_nir", "true_color"), "linear asphalt trace"),
    Rule(("cleared", "deforest", "bare soil"), ("false_color_nir",), "exposed earth"),
    Rule(("flood", "water", "river", "lake"), ("agriculture_swir", "false_color_nir"), "water absorbing infrared"),
)
SHORT_DEFAULT = Rule((), ("true_color",), "landscape overview")
LONG_RULES = (
    Rule(("construction", "building", "urban", "residential", "newly built", "concrete", "scaffold", "structure", "city"), ("True_Color", "False_Color"), "high albedo concrete, metal rooftops, scaffolding footprints, urban infrastructure"),
    Rule(("road", "highway", "street", "paved", "traffic", "linear", "infrastructure", "bridge"), ("False_Color", "True_Color"), "smooth thin linear grey or white asphalt trace, transportation network"),
    Rule(("cleared", "deforest", "land clearance", "site prep", "logging", "bare soil", "earth", "excavation"), ("False_Color",), "exposed earth, deforestation, dull browns and greys replacing vegetation"),
    Rule(("flood", "water", "river", "lake", "drying", "inundation", "reservoir", "pond", "coast"), ("Agriculture_SWIR", "False_Color"), "pitch black pixel clusters, water completely absorbing infrared light, aquatic boundaries"),
    Rule(("agriculture", "farm", "crop", "field", "harvest", "vegetation", "forest", "greenery"), ("False_Color", "Agriculture_SWIR"), "healthy vegetation glowing bright red, agricultural plots, organized farmland"),
)
LONG_DEFAULT = Rule((), ("True_Color", "False_Color", "Agriculture_SWIR"), "varied terrain, landscape overview")


def route(query: Column, rules: tuple[Rule, ...] = SHORT_RULES, default: Rule = SHORT_DEFAULT) -> tuple[Column, Column]:
    """(sorted layers, joined hints) of a query; words match whole."""
    low = F.lower(query)
    nothing = F.array().cast("array<string>")
    layers, hints, any_hit = nothing, nothing, F.lit(False)
    for rule in rules:
        hit = low.rlike(rf"\b({'|'.join(rule.words)})\b")
        layers = F.array_union(layers, F.when(hit, F.array(*map(F.lit, rule.layers))).otherwise(nothing))
        hints = F.concat(hints, F.when(hit, F.array(F.lit(rule.hint))).otherwise(nothing))
        any_hit = any_hit | hit
    layers = F.when(any_hit, layers).otherwise(F.array(*map(F.lit, default.layers)))
    hints = F.when(any_hit, hints).otherwise(F.array(F.lit(default.hint)))
    return F.array_sort(layers), F.concat_ws(", ", hints)


def date_in_name(name: Column) -> Column:
    """First yyyy-mm-dd of a file name; null without one or for an impossible date."""
    return F.try_to_date(F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")))


def slug(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", "_")


def safe_name(s: Column, most: int = 30) -> Column:
    """Letters, digits, blank, dash and underscore; trimmed, then cut."""
    return F.substring(F.trim(F.regexp_replace(s, r"[^\p{L}\p{N} _-]", "")), 1, most)


def without_band(name: Column) -> Column:
    """A tile's name without the suffix of its band."""
    return F.regexp_replace(name, r"(?i)(_true_color|_false_color_nir|_agriculture_swir|_rgb|_nir|_swir)", "")


def layer_of(path: Column) -> Column:
    """Layer by the folder of a path, true_color if nothing tells."""
    folder = F.lower(F.regexp_replace(path, r"/[^/]*$", ""))
    near = folder.contains("false_color") | folder.contains("nir")
    short = folder.contains("swir") | folder.contains("agriculture")
    return F.when(near, "false_color_nir").when(short, "agriculture_swir").otherwise("true_color")
