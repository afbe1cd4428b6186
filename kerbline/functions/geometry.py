"""Frame positions and image layout as arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: sizes of the contact sheet and of the review board, in pixels
TILE_WIDTH, TILE_HEIGHT, HEADER, COLUMNS = 320, 214, 56, 3
BOARD_LABEL, BOARD_GAP, BOARD_HEADER, BOARD_ROW_GAP, BOARD_ROWS = 140, 12, 125, 18, 6


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def frame_index(frames: Column | str, ratio: Column | float) -> Column:
    """Index of the frame at a ratio of the video (clamped to 0..1), -1 for a video without frames."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio if isinstance(ratio, Column) else F.lit(ratio)))
    return F.when(_c(frames) > 0, F.rint((_c(frames) - 1) * r).cast("bigint")).otherwise(F.lit(-1))


def duration(frames: Column | str, fps: Column | str) -> Column:
    """Seconds of a video, 0.0 where frames or rate are unknown."""
    return F.when((_c(frames) > 0) & (_c(fps) > 0), _c(frames) / _c(fps)).otherwise(F.lit(0.0))


def fitted_size(width: Column | str, height: Column | str, target_width: int, target_height: int) -> dict[str, Column]:
    """Size and offsets of an image scaled into a target without distortion and centred there."""
    scale = F.least(F.lit(target_width) / _c(width), F.lit(target_height) / _c(height))
    w = F.greatest(F.lit(1), F.rint(_c(width) * scale)).cast("bigint")
    h = F.greatest(F.lit(1), F.rint(_c(height) * scale)).cast("bigint")
    return {"new_width": w, "new_height": h, "x_offset": F.floor((target_width - w) / 2), "y_offset": F.floor((target_height - h) / 2)}


def tile_rectangle(index: Column | str) -> dict[str, Column]:
    """Place of a tile (0 to 5) in a contact sheet."""
    i = _c(index)
    return {"x0": (i % COLUMNS) * TILE_WIDTH, "y0": HEADER + F.floor(i / COLUMNS) * TILE_HEIGHT}


def board_size() -> tuple[int, int]:
    """Width and height of a review board."""
    return BOARD_LABEL + 2 * TILE_WIDTH + BOARD_GAP, BOARD_HEADER + BOARD_ROWS * (TILE_HEIGHT + BOARD_ROW_GAP)
