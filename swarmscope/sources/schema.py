"""The stored schema of bubbles. Widths differ between files of older writers, so a scan always states it."""

from __future__ import annotations

from pyspark.sql import types as T

_FLOATS = (
    "score confidence bbox_x1 bbox_y1 bbox_x2 bbox_y2 mask_area equivalent_diameter centroid_x centroid_y cx_px cy_px angle_deg a_mm b1_mm b2_mm "
    "d_mm_sphere volume_mm3_sphere surface_area_mm2_sphere volume_mm3_ellipsoid surface_area_mm2_ellipsoid aspect_ratio aspect_delta "
    "d_mm_chosen volume_mm3_chosen surface_area_mm2_chosen"
).split()

BUBBLE = T.StructType(
    [T.StructField("image", T.StringType()), T.StructField("bubble_index", T.IntegerType())]
    + [T.StructField(n, T.FloatType()) for n in _FLOATS]
    + [T.StructField(n, T.StringType()) for n in ("model_used", "placement", "reactor_setting", "replicate", "image_filename")]
    + [T.StructField(n, T.IntegerType()) for n in ("burst_index", "image_number_in_burst")]
)
KEYS = ["placement", "reactor_setting", "replicate", "burst_index", "image_number_in_burst"]
RENAMED = {"d_mm_chosen": "equivalent_diameter_mm", "volume_mm3_chosen": "bubble_volume_mm3", "surface_area_mm2_chosen": "bubble_surface_area_mm2"}
#: In memory only; never stored. Fixed values from "image_path" on: settings of a run and notes of its processing.
TRANSIENT = ["mask", "contour", "overlay", "fit_overlay", "fit_debug", "ellipse", "image_path", "conf_thresh", "iou_thresh", "mask_binarize_thr", "img_w", "img_h", "has_overlay", "aspect_method"]
