"""Fixed values of the domain, as plain tables and as DataFrames."""

from pyspark.sql import DataFrame, SparkSession, functions as F

# They have to equal the published data model's for results to agree.
CLASSES = {0: "Main Utility", 1: "Other Utility", 2: "Trench", 3: "Inactive Utility", 4: "Misc"}
CLASS_COLOURS = {0: (0.0, 0.8, 0.0), 1: (1.0, 1.0, 0.0), 2: (0.55, 0.27, 0.07), 3: (0.0, 0.0, 0.0), 4: (0.6, 0.6, 0.6)}
UNKNOWN_CLASS_COLOUR = (1.0, 0.0, 1.0)
LINE_LAYERS = (
    "Vandledning", "Afloebsledning", "Gasledning", "Elledning", "Telekommunikationsledning", "Foeringsroer",
    "LedningUkendtForsyningsart", "Ledningstrace", "TermiskLedning", "Olieledning", "AndenLedning",
)
TRACE_LAYER = "Ledningstrace"
FALLBACK_RADIUS = 0.010
TRACE_FALLBACK_WIDTH = 0.25
COMPONENT_TO_LINE = {
    "Vandkomponent": "Vandledning", "Afloebskomponent": "Afloebsledning", "Gaskomponent": "Gasledning",
    "Elkomponent": "Elledning", "Telekommunikationskomponent": "Telekommunikationsledning",
    "TermiskKomponent": "TermiskLedning", "Oliekomponent": "Olieledning", "AndenKomponent": "AndenLedning",
}
#: In order: the first keyword that is part of the value decides.
SUPPLY_COLOURS = (
    ("fjern", (1.0, 0.0, 1.0)), ("varme", (1.0, 0.0, 1.0)), ("tele", (0.98, 0.588, 0.275)), ("kommu", (0.98, 0.588, 0.275)),
    ("afloeb", (1.0, 0.0, 0.0)), ("spilde", (1.0, 0.0, 0.0)), ("vejafv", (1.0, 0.0, 0.0)), ("vand", (0.0, 0.0, 1.0)),
    ("gas", (1.0, 0.6, 0.0)), ("el", (1.0, 0.0, 0.0)), ("olie", (0.463, 0.463, 0.463)), ("anden", (0.8, 0.8, 0.8)),
    ("andet", (0.8, 0.8, 0.8)),
)
SUPPLY_TO_LINE = {
    "vand": "Vandledning", "afloeb": "Afloebsledning", "spildevand": "Afloebsledning", "vejafvanding": "Afloebsledning",
    "gas": "Gasledning", "el": "Elledning", "telekommunikation": "Telekommunikationsledning",
    "fjernvarme": "TermiskLedning", "fjernkoeling": "TermiskLedning", "varme": "TermiskLedning",
    "termisk": "TermiskLedning", "olie": "Olieledning", "anden": "AndenLedning", "andet": "AndenLedning",
}
UTILITY_TYPES = {
    0: "Unlabeled", 1: "PowerLine", 2: "DrainageLine", 3: "OilPipeLine", 4: "GasLine", 5: "ThermalLine", 6: "Conduit",
    7: "WaterLine", 8: "TelecomunicationLine", 9: "OtherLine", 10: "LineUnknownServiceType",
}
TYPE_TO_LAYER = {
    1: "Elledning", 2: "Afloebsledning", 3: "Olieledning", 4: "Gasledning", 5: "TermiskLedning", 6: "Foeringsroer",
    7: "Vandledning", 8: "Telekommunikationsledning", 9: "AndenLedning", 10: "LedningUkendtForsyningsart",
}
#: Upper bounds of accuracy classes 1 to 4, in metres; class 5 is open. Colours of the five.
CLASS_BOUNDS = (0.25, 0.5, 1.0, 2.0)
DEVIATION_COLOURS = ((0.0, 0.7, 0.2), (0.6, 0.9, 0.0), (1.0, 0.8, 0.0), (1.0, 0.4, 0.0), (0.8, 0.0, 0.0))
DEVIATION_LABELS = (
    "Class 1:  <= 250 mm", "Class 2:  <= 500 mm", "Class 3:  <= 1000 mm", "Class 4:  <= 2000 mm", "Class 5:  > 2000 mm",
)
OPEN_CLASS_WIDTH = 2.0
SENTINEL_Z = -99.0
#: Where a depth comes from.
REGISTERED, INDICATIVE, FEATURE_MEAN, LAYER_MEAN, GROUND, NO_DEPTH = 1, 2, 3, 4, 5, 99
SITE_BUFFER = 2.0
CROP_RADIUS = 2.0
VOXEL, MIN_CLUSTER_SIZE, MIN_SAMPLES, MIN_INSTANCE_POINTS, TARGET_CLASS = 0.01, 100, 5, 250, 1
GROUND_CELL, GROUND_PERCENTILE, IDW_NEIGHBOURS = 2.0, 0.95, 8
# End of fixed values.


def type_layers(spark: SparkSession) -> DataFrame:
    """utility_type, layer: the registry layers of each utility type."""
    return spark.createDataFrame(list(TYPE_TO_LAYER.items()), "utility_type int, layer string")


def component_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COMPONENT_TO_LINE.items()), "component_layer string, line_layer string")


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v, *CLASS_COLOURS[k]) for k, v in CLASSES.items()], "class int, class_name string, r double, g double, b double")


def coloured(points: DataFrame) -> DataFrame:
    """points with the colour r, g, b of their class, that of unknown classes where it has none."""
    known = classes(points.sparkSession).select("class", *"rgb")
    joined = points.join(F.broadcast(known), "class", "left")  # a row for each class, five
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zip("rgb", UNKNOWN_CLASS_COLOUR)})
