"""Household labels and their canonical form as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The household object types, in order.
TYPES = [
    "door", "window", "blinds", "mirror", "clock", "stairs", "railing", "art", "picture frame", "plant", "vase",
    "candle", "chair", "stool", "bench", "couch", "ottoman", "bed", "crib", "nightstand", "dresser", "table",
    "coffee table", "side table", "dining table", "desk", "cabinet", "wardrobe", "shelf", "bookcase", "tv",
    "monitor", "speaker", "lamp", "floor lamp", "table lamp", "ceiling light", "fan", "fireplace", "refrigerator",
    "microwave", "oven", "stove", "dishwasher", "sink", "faucet", "toilet", "shower", "bathtub", "washing machine",
    "dryer", "towel", "soap dispenser", "rug", "curtain", "pillow", "blanket", "basket", "bin", "trash can", "book",
    "laptop", "keyboard", "mouse", "phone", "remote", "toy", "pet item", "food bowl", "bottle", "cup", "plate",
    "bowl", "utensil", "kettle", "toaster", "blender", "coffee maker", "vacuum", "suitcase", "shoes", "clothes",
    "hanger", "bag", "wall switch", "outlet", "unknown", "other",
]

# Names that stand for a type; names of types themselves need no line.
ALIASES = {
    "alarm clock": "clock",
    "arm chair": "chair",
    "armchair": "chair",
    "bar stool": "stool",
    "barstool": "stool",
    "basket bin": "basket",
    "bath tub": "bathtub",
    "books": "book",
    "bookshelf": "bookcase",
    "ceiling fan": "fan",
    "ceiling fan light": "ceiling light",
    "ceiling lamp": "ceiling light",
    "cell phone": "phone",
    "counter": "table",
    "countertop": "table",
    "couches": "couch",
    "cupboard": "cabinet",
    "curtains": "curtain",
    "decor": "art",
    "decorative clock": "clock",
    "desk chair": "chair",
    "dining chair": "chair",
    "dish washer": "dishwasher",
    "door frame": "door",
    "doors": "door",
    "end table": "side table",
    "fan light": "ceiling light",
    "footstool": "ottoman",
    "framed art": "art",
    "framed picture": "picture frame",
    "fridge": "refrigerator",
    "garbage can": "trash can",
    "hanging lamp": "lamp",
    "kitchen island": "table",
    "light": "lamp",
    "light fixture": "ceiling light",
    "microwave oven": "microwave",
    "office chair": "chair",
    "ottomans": "ottoman",
    "painting": "art",
    "pendant light": "lamp",
    "pendant lights": "lamp",
    "pet bowl": "food bowl",
    "phone charger": "phone",
    "picture": "picture frame",
    "pictures": "picture frame",
    "photo": "picture frame",
    "photo frame": "picture frame",
    "portrait": "art",
    "power outlet": "outlet",
    "recliner": "chair",
    "remote control": "remote",
    "roman clock": "clock",
    "sconce": "lamp",
    "settee": "couch",
    "shelves": "shelf",
    "shoe": "shoes",
    "sofa": "couch",
    "stairs railing": "railing",
    "stair railing": "railing",
    "switch": "wall switch",
    "television": "tv",
    "tv stand": "cabinet",
    "wall art": "art",
    "wall clock": "clock",
    "wall outlet": "outlet",
    "wall picture": "picture frame",
    "window blinds": "blinds",
    "windows": "window",
    "wine bottle": "bottle",
    "wood stool": "stool",
}


def label_token(value: Column) -> Column:
    """Lower case, trimmed, underscores and hyphens as spaces; null as an empty token."""
    return F.translate(F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))), "_-", "  ")


def canonical_label(value: Column, default: str = "other") -> Column:
    """The household type that a label means: by alias, as it is, without a final "s", then without "es"."""
    types = F.array(*map(F.lit, TYPES))
    aliases = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    token = label_token(value)
    named = F.coalesce(F.element_at(aliases, token), token)
    shorter = lambda n: F.substring(named, 1, F.greatest(F.length(named) - n, F.lit(0)))
    return (
        F.when(token == "", default)
        .when(F.array_contains(types, named), named)
        .when(named.endswith("s") & F.array_contains(types, shorter(1)), shorter(1))
        .when(named.endswith("es") & F.array_contains(types, shorter(2)), shorter(2))
        .otherwise(default)
    )


def selector_subset(values: Column) -> Column:
    """Distinct canonical labels of an array, in order of first mention, without unknown and other."""
    named = F.transform(values, lambda v: canonical_label(v, ""))
    return F.array_distinct(F.filter(named, lambda v: ~v.isin("", "unknown", "other")))


def label_values(include_unknown: bool = True, include_other: bool = True) -> list[str]:
    left_out = {x for x, keep in (("unknown", include_unknown), ("other", include_other)) if not keep}
    return [t for t in TYPES if t not in left_out]


def taxonomy_table(spark: SparkSession) -> DataFrame:
    """(position, label), one row per type."""
    return spark.createDataFrame(list(enumerate(TYPES)), "position int, label string")


def candidate_list_text(labels: Column) -> Column:
    """Labels as one comma-separated text; blank ones are left out."""
    return F.array_join(F.filter(F.transform(labels, F.trim), lambda v: v != ""), ", ")
