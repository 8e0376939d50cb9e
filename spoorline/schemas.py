"""Declared schemas; nothing is inferred from files."""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    fields = []
    for part in spec.replace("\n", " ").split(","):
        name, type_name = part.split()
        fields.append(T.StructField(name, _TYPES[type_name]))
    return T.StructType(fields)


_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "vector": T.ArrayType(T.FloatType()),
}

IMAGES = _struct("""
    image_id string, local_image_path string, species_label string,
    date_captured string, site_id string, latitude double, longitude double,
    habitat_type string
""")

GROUND_TRUTH_COLUMNS = [
    "ground_truth_count",
    "ground_truth_count_num",
    "gt_standing",
    "gt_resting",
    "gt_moving",
    "gt_interacting",
    "gt_young_present",
]

ENRICHED_IMAGES = T.StructType(
    IMAGES.fields
    + _struct("""
        ground_truth_count string, ground_truth_count_num int, gt_standing double,
        gt_resting double, gt_moving double, gt_interacting double,
        gt_young_present double
    """).fields
)

ANNOTATION = _struct("""
    image_id string, count string, standing double, resting double, moving double,
    interacting double, young_present double
""")

DETECTIONS = _struct("""
    detection_id string, image_id string, pipeline string, timestamp string,
    camera_id string, latitude double, longitude double, habitat_type string,
    species string, confidence double, location_type string, location string,
    detection_quality double, instance_count int, image_path string,
    mask_path string, overlay_path string, ground_truth_species string,
    correct string
""")

RAW_BOXES = _struct("""
    image_id string, box_id int, class_id int, conf double, x1 int, y1 int, x2 int,
    y2 int
""")

RAW_MASKS = _struct("image_id string, mask_id int, conf double")

EVALUATION = _struct("""
    image_id string, image_path string, true_species string,
    predicted_species string, correct boolean, top1_score double,
    true_species_score double, camera_id string, latitude double, longitude double
""")

SCORES = _struct("image_id string, species string, score double")

MODEL_COMPARISON = _struct("""
    image_id string, image_path string, true_species string,
    bioclip_predicted string, bioclip_correct boolean, bioclip_score double,
    bioclip_true_score double, megadetector_localised boolean,
    megadetector_quality double, megadetector_backend string,
    combined_correct boolean
""")

COUNT_ERRORS = _struct("""
    image_id string, pipeline string, instance_count int, gt_count int,
    ground_truth_count string, count_error double, exact_match boolean,
    confidence double, detection_quality double
""")

PIPELINE_RUNS = _struct("pipeline string, elapsed_s double")
