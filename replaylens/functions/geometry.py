"""The capture-geometry stamp of a session, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the layout of the stamp written by the recorder.
_STAMP = (r"fullscreen (\d+)x(\d+) -> crop L(\d+)T(\d+)W(\d+)H(\d+) -> FPV (\d+)x(\d+) (\w+); "
          r"radar src L(\d+)T(\d+)W(\d+)H(\d+) -> (\d+)x(\d+)")
_FIELDS = ["screen_w", "screen_h", "crop_left", "crop_top", "crop_w", "crop_h", "fpv_w", "fpv_h",
           "colour", "radar_left", "radar_top", "radar_w", "radar_h", "radar_out_w", "radar_out_h"]


def geometry_columns(geom: str | Column = "geom") -> list[Column]:
    """Numbers of the stamp; null where the stamp has another layout."""
    out = []
    for group, name in enumerate(_FIELDS, start=1):
        text = F.regexp_extract(geom, _STAMP, group)
        text = F.when(text != "", text)
        out.append((text if name == "colour" else text.cast("int")).alias(name))
    return out
