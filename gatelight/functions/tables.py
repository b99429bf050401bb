"""Table functions of a session, for lateral joins in SQL: the tiles of a frame and the windows a crop search tries."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from gatelight.operators import crop
from gatelight.workers import ship


def tiles_of(width: int, height: int, levels: int = crop.LEVELS, budget: int = crop.TILE_BUDGET):
    """(division, x, y, w, h) of one frame's detection pyramid, coarse grids first, as ``crop.tiles`` gives them for a table."""
    fine = [d for d in crop.DIVISIONS if max(width, height) / d >= crop.LEAST_TILE][-levels:]
    used = 0
    for d in fine:
        w, h = (max(s // d, 1) for s in (width, height))
        xs, ys = (sorted({min(at, max(s - tile, 0)) for at in range(0, s, max(math.floor(tile * crop.TILE_STEP), 1))}) for s, tile in ((width, w), (height, h)))
        used += len(xs) * len(ys)
        if used > budget:
            return
        for y in ys:
            for x in xs:
                yield d, x, y, min(w, width - x), min(h, height - y)


@udtf(returnType="division int, x int, y int, w int, h int")
class FrameTiles:
    def eval(self, width: int, height: int):
        if width and height:
            yield from tiles_of(width, height)


@udtf(returnType="size_no int, w int, h int")
class CropSizes:
    def eval(self, width: int, height: int, aspect: float, min_scale: float, scales: int):
        if width and height and aspect:
            for k, (w, h) in enumerate(crop.sizes(width, height, aspect, min_scale, scales)):
                yield k, w, h


def register(spark: SparkSession) -> None:
    """``frame_tiles(width, height)`` and ``crop_sizes(width, height, aspect, min_scale, scales)`` for the session's SQL."""
    ship(spark)
    spark.udtf.register("frame_tiles", FrameTiles)
    spark.udtf.register("crop_sizes", CropSizes)
