"""Dimension values of the evidence model: modalities, categories, sections, gates, weights.

Values here are fixed: results depend on them as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Modalities in the order of files, of reasoning, and of display.
FUSION_ORDER = ["rgb", "ir", "event", "audio", "depth"]
REASONING_ORDER = ["rgb", "event", "depth", "ir", "audio"]
DISPLAY_ORDER = {"rgb": 0, "ir": 1, "depth": 2, "event": 3, "audio": 4}

# Words that carry no evidence.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "into", "is", "it", "its",
    "my", "of", "on", "or", "that", "the", "their", "there", "these", "this", "to", "up", "with", "while", "no", "not",
    "than", "then", "me", "i", "you", "your", "our", "we", "they", "them", "he", "she", "his", "her", "was", "were",
    "will", "would", "can", "could", "should", "about", "after", "before", "during", "over", "under", "right", "left",
    "center", "middle", "side", "toward", "towards", "throughout", "through", "around", "between", "also", "only",
    "mostly", "very", "more", "most", "all", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine",
    "ten", "frame", "video", "scene", "sequence", "shows", "show", "visible", "appears", "appear", "present",
    "located", "positioned", "detected", "observed", "indicates", "suggest", "suggests", "likely", "roughly",
    "approximately", "object", "objects", "area", "areas", "region", "regions", "sides", "part", "parts", "start",
    "end", "begins", "begin", "ends", "contains", "containing", "overall", "main", "primary", "final", "initial",
    "clear", "clearly", "distinct", "several", "single", "small", "large",
]

# Weight of each modality (rgb, ir, event, audio, depth) in a profile.
PROFILE_WEIGHTS = {
    "visual_object": (1.2, 1.1, 0.8, 0.2, 1.0),
    "visual_spatial": (1.1, 1.0, 0.7, 0.1, 1.2),
    "visual_count": (1.1, 1.0, 0.8, 0.1, 1.1),
    "visual_text": (1.4, 1.0, 0.2, 0.0, 0.2),
    "visual_light": (1.0, 1.2, 0.4, 0.0, 0.2),
    "visual_motion": (0.8, 0.9, 1.3, 0.4, 0.6),
    "temporal": (0.8, 0.8, 1.2, 0.5, 0.6),
    "audio": (0.1, 0.1, 0.1, 1.5, 0.1),
    "anomaly": (1.0, 1.0, 0.9, 0.6, 0.8),
    "default": (0.8, 0.8, 0.8, 0.5, 0.8),
}
# Modalities that support a profile directly, and as a complement.
PROFILE_SUPPORT = {
    "visual_object": (["rgb", "ir", "depth"], ["event"]),
    "visual_spatial": (["rgb", "ir", "depth"], ["event"]),
    "visual_count": (["rgb", "ir", "depth"], []),
    "visual_text": (["rgb", "ir"], []),
    "visual_light": (["rgb", "ir"], []),
    "visual_motion": (["event", "rgb", "ir"], ["audio", "depth"]),
    "temporal": (["event", "rgb", "ir"], ["audio", "depth"]),
    "audio": (["audio"], ["event", "rgb", "ir"]),
    "anomaly": (["rgb", "ir", "event", "depth", "audio"], []),
    "default": (["rgb", "ir", "event", "depth"], ["audio"]),
}
# Category -> gate, profile, lexical weight, whether lexical support is required, sections.
CATEGORIES = {
    "scene_sequence": ("support_soft", "temporal", 0.4, False, ["temporal_sequence", "motion_and_action"]),
    "event_scene_sequence": ("support_soft", "temporal", 0.4, False, ["temporal_sequence", "motion_and_action"]),
    "depth_scene_sequence": ("support_soft", "temporal", 0.4, False, ["temporal_sequence", "spatial_and_layout"]),
    "object_recognition": ("support_required", "visual_object", 0.55, False, ["objects_and_attributes"]),
    "event_object_recognition": ("support_required", "visual_object", 0.55, False, ["objects_and_attributes"]),
    "depth_object_recognition": ("support_required", "visual_object", 0.55, False, ["objects_and_attributes"]),
    "spatial_reasoning": ("support_required", "visual_spatial", 0.6, True, ["spatial_and_layout"]),
    "event_spatial_reasoning": ("support_required", "visual_spatial", 0.6, True, ["spatial_and_layout"]),
    "depth_spatial_reasoning": ("support_required", "visual_spatial", 0.6, True, ["spatial_and_layout"]),
    "navigation": ("support_required", "visual_spatial", 0.6, True, ["spatial_and_layout", "motion_and_action"]),
    "event_navigation": ("support_required", "visual_spatial", 0.6, True, ["spatial_and_layout", "motion_and_action"]),
    "depth_navigation": ("support_required", "visual_spatial", 0.6, True, ["spatial_and_layout", "motion_and_action"]),
    "action": ("support_soft", "visual_motion", 0.35, False, ["motion_and_action"]),
    "event_action": ("support_soft", "visual_motion", 0.35, False, ["motion_and_action"]),
    "depth_action": ("support_soft", "visual_motion", 0.35, False, ["motion_and_action"]),
    "dynamic_recognition": ("support_soft", "visual_motion", 0.35, False, ["motion_and_action"]),
    "event_dynamic_recognition": ("support_soft", "visual_motion", 0.35, False, ["motion_and_action"]),
    "depth_dynamic_recognition": ("support_soft", "visual_motion", 0.35, False, ["motion_and_action"]),
    "dynamic_counting": ("support_soft", "visual_motion", 0.55, True, ["motion_and_action", "counting"]),
    "event_dynamic_counting": ("support_soft", "visual_motion", 0.55, True, ["motion_and_action", "counting"]),
    "depth_dynamic_counting": ("support_soft", "visual_motion", 0.55, True, ["motion_and_action", "counting"]),
    "counting": ("support_required", "visual_count", 0.7, True, ["counting"]),
    "event_counting": ("support_required", "visual_count", 0.7, True, ["counting"]),
    "depth_counting": ("support_required", "visual_count", 0.7, True, ["counting"]),
    "non_common": ("review_recommended", "anomaly", 0.5, False, ["anomaly_and_safety"]),
    "event_non_common": ("review_recommended", "anomaly", 0.5, False, ["anomaly_and_safety"]),
    "depth_non_common": ("review_recommended", "anomaly", 0.5, False, ["anomaly_and_safety"]),
    "light_recongnition": ("support_exempt", "visual_light", 0.45, False, ["scene_and_context"]),
    "light_recognition": ("support_exempt", "visual_light", 0.45, False, ["scene_and_context"]),
    "light_change": ("support_exempt", "visual_light", 0.45, False, ["scene_and_context"]),
    "text_recognition": ("support_exempt", "visual_text", 0.65, True, ["text_and_symbols", "objects_and_attributes"]),
    "audio_hia": ("support_exempt", "audio", 0.3, False, ["audio_understanding"]),
    "audio_chronological_caption": ("support_exempt", "audio", 0.3, False, ["audio_understanding", "temporal_sequence"]),
}
DEFAULT_PROFILE = ("support_required", "default", 0.5, False, "others")
CATEGORY_NAMES = sorted(CATEGORIES)

# Sections of the report.
SECTIONS = [
    "scene_and_context", "objects_and_attributes", "spatial_and_layout", "motion_and_action", "temporal_sequence",
    "counting", "text_and_symbols", "audio_understanding", "anomaly_and_safety", "others",
]

# Routing of evidence to the sections of a narrative.
ROUTES = ["scene_overview", "visible_objects_and_layout", "motion_and_event_cues", "audio_cues"]
# Fixed values.
ROUTE_WEIGHTS = {
    "scene_overview": (1.0, 1.0, 0.7, 0.7, 0.8),
    "visible_objects_and_layout": (1.2, 1.1, 0.8, 0.2, 1.0),
    "motion_and_event_cues": (0.8, 0.9, 1.3, 0.5, 0.6),
    "audio_cues": (0.1, 0.1, 0.1, 1.5, 0.1),
}
# Fixed values.
ROUTE_HINTS = {
    "scene_overview": ["object_recognition", "scene_sequence", "environmental_scene", "depth_object_recognition"],
    "visible_objects_and_layout": ["object_recognition", "spatial_reasoning", "counting", "depth_spatial_reasoning", "depth_counting"],
    "motion_and_event_cues": ["dynamic_recognition", "dynamic_counting", "scene_sequence", "action", "event_"],
    "audio_cues": ["sound_", "speech_", "music_", "audio_", "environmental_scene", "action_from_sound"],
}
# Fixed values.
ROUTE_KEYWORDS = {
    "scene_overview": ["kitchen", "indoor", "outdoor", "counter", "workspace", "room", "office", "environment", "setting", "preparation", "cooking", "food", "domestic"],
    "visible_objects_and_layout": [
        "board", "cutting", "knife", "peeler", "carrot", "bowl", "laptop", "stovetop", "countertop", "counter",
        "power", "strip", "left", "right", "center", "layout", "object", "objects", "spatial", "position",
    ],
    "motion_and_event_cues": [
        "move", "motion", "moving", "dynamic", "enter", "lift", "reach", "pick", "grasp", "peel", "peeling", "contact",
        "activity", "interaction", "start", "begin", "hands", "occlude", "boundary", "event",
    ],
    "audio_cues": [
        "audio", "sound", "speech", "music", "ambient", "noise", "chopping", "scraping", "knife", "board",
        "percussive", "kitchen", "microphone", "stereo", "mono", "rhythmic", "silence",
    ],
}

# Reasoning groups of sections; a section may be in several.
GROUPED = {
    "object_reasoning": ["object_recognition", "event_object_recognition", "depth_object_recognition", "counting", "event_counting", "depth_counting"],
    "spatial_reasoning": [
        "spatial_reasoning", "event_spatial_reasoning", "depth_spatial_reasoning", "navigation", "event_navigation",
        "depth_navigation", "audio_spatial_location",
    ],
    "temporal_sequence_reasoning": [
        "scene_sequence", "event_scene_sequence", "depth_scene_sequence", "dynamic_recognition",
        "event_dynamic_recognition", "depth_dynamic_recognition", "audio_temporal_attribute",
    ],
    "action_motion_reasoning": ["action", "event_action", "depth_action", "dynamic_counting", "event_dynamic_counting", "depth_dynamic_counting"],
    "audio_visual_reasoning": [
        "audio_sound_characteristics", "audio_counting", "audio_temporal_attribute", "audio_spatial_location",
        "audio_sound_source_identification", "audio_inferential_causality", "audio_cross_modal_reasoning",
    ],
    "anomaly_uncertainty_reasoning": ["non_common", "event_non_common", "depth_non_common", "light_change", "light_recognition", "light_recongnition"],
}
GROUPS = [
    "object_reasoning", "spatial_reasoning", "temporal_sequence_reasoning", "action_motion_reasoning",
    "audio_visual_reasoning", "anomaly_uncertainty_reasoning", "ungrouped",
]


def section_groups() -> list[tuple[str, str]]:
    """(section, group) pairs."""
    return [(s, g) for g, sections in GROUPED.items() for s in sections]


# Gates and thresholds.
RELAXED_SCORE = 1.6
MIN_SCORE, EXEMPT_SCORE, REVIEW_SCORE, HIGH_SCORE = 1.8, 1.7, 2.0, 2.2
MIN_SUPPORT, STRICT_SUPPORT, SUPPORTING = 0.08, 0.12, 0.3
COSINE_FLOOR, COSINE_CEILING = 0.4, 0.9

# Confidence of a modality by day, and at night.
CONFIDENCE = {"rgb": 0.85, "event": 0.85, "depth": 0.65, "ir": 0.75, "audio": 0.80}
NIGHT_CONFIDENCE = {"rgb": 0.45, "event": 0.90, "ir": 0.85}
UNCERTAIN_PHRASES = ["noise", "floating particles", "hard to distinguish", "uncertain", "not clear"]

# Lag search of a modality: most seconds, expected offset, scale, weight.
PRIORS = {"ir": (3.0, 0.0, 1.0, 0.22), "depth": (3.0, 0.0, 1.0, 0.20), "event": (30.0, 0.0, 8.0, 0.08)}


def category_table(spark: SparkSession) -> DataFrame:
    """category, gate, profile, lexical_weight, needs_lexical, sections: one row a known category."""
    rows = [(c, *r) for c, r in sorted(CATEGORIES.items())]
    return spark.createDataFrame(rows, "category string, gate string, profile string, lexical_weight double, needs_lexical boolean, sections array<string>")


def profile_table(spark: SparkSession) -> DataFrame:
    """profile, modality, weight, direct, complementary: one row a profile and modality."""
    rows = []
    for p, w in PROFILE_WEIGHTS.items():
        direct, comp = PROFILE_SUPPORT[p]
        rows += [(p, m, x, m in direct, m in comp) for m, x in zip(FUSION_ORDER, w, strict=True)]
    return spark.createDataFrame(rows, "profile string, modality string, weight double, direct boolean, complementary boolean")


def group_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(section_groups(), "section string, reasoning_group string")


def with_category(df: DataFrame, category: str = "category") -> DataFrame:
    """df with its category's gate, profile, weights and sections, or the defaults of an unknown one."""
    gate, profile, weight, lexical, section = DEFAULT_PROFILE
    dim = category_table(df.sparkSession).withColumnRenamed("category", "_category")
    out = df.join(F.broadcast(dim), F.col(category) == F.col("_category"), "left")  # a literal table
    return out.select(
        *df.columns,
        F.col("_category").isNotNull().alias("known_category"),
        F.coalesce("gate", F.lit(gate)).alias("gate"),
        F.coalesce("profile", F.lit(profile)).alias("profile"),
        F.coalesce("lexical_weight", F.lit(weight)).alias("lexical_weight"),
        F.coalesce("needs_lexical", F.lit(lexical)).alias("needs_lexical"),
        F.coalesce("sections", F.array(F.lit(section))).alias("sections"),
    )


def display_rank(modality: Column) -> Column:
    out = F.lit(99)
    for m, k in DISPLAY_ORDER.items():
        out = F.when(modality == m, k).otherwise(out)
    return out


def choose(value: Column, table: dict[str, object], default: object) -> Column:
    """A literal lookup as a CASE expression."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out
