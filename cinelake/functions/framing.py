"""Boxes, crop windows and composition scores. Boxes are [centre x, centre y, width, height]."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + t * (b - a)


def lerp_box(a: Column, b: Column, t: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: lerp(x, y, t))


def crop_window(source_w: Column, source_h: Column, aspect: Column) -> Column:
    """Largest window of an aspect `W:H` as struct(w, h); null for an aspect that is none."""
    parts = F.split(aspect, ":")
    aw = F.get(parts, F.lit(0)).try_cast("bigint")
    ah = F.get(parts, F.lit(1)).try_cast("bigint")
    valid = (F.size(parts) == 2) & (aw > 0) & (ah > 0)
    sw, sh = source_w.cast("bigint"), source_h.cast("bigint")
    by_width = F.floor(sw * ah / aw).cast("bigint")
    fits = by_width <= sh
    w = F.when(fits, sw).otherwise(F.floor(sh * aw / ah).cast("bigint"))
    h = F.when(fits, by_width).otherwise(sh)
    return F.when(valid, F.struct(w.alias("w"), h.alias("h")))


def thirds_centre(cx: Column, cy: Column, box_h: Column, crop_w: Column, crop_h: Column, side: str = "right"):
    """Crop centre that puts the subject on a vertical third and its eye line on the upper third."""
    fraction = 1.0 / 3.0 if side == "left" else 2.0 / 3.0
    return cx - F.lit(fraction - 0.5) * crop_w, cy - box_h / F.lit(3.0) + crop_h / F.lit(6.0)


def corner_clamped(centre: Column, crop: Column, source: Column) -> Column:
    """Low edge of a window around `centre`, kept inside the frame."""
    room = F.greatest(F.lit(0.0), (source - crop).cast("double"))
    return F.least(F.greatest(centre - crop / F.lit(2.0), F.lit(0.0)), room)


def thirds_score(boxes: Column, width: Column, height: Column) -> Column:
    """How near the best box centre lies to a thirds crossing: 0 far, 1 on it. Boxes are structs with `bbox_xywh`."""
    w3, h3 = width / F.lit(3.0), height / F.lit(3.0)
    reach = F.sqrt(w3 * w3 + h3 * h3)

    def distance(box: Column) -> Column:
        cx, cy = box["bbox_xywh"][0], box["bbox_xywh"][1]
        crossings = [
            F.sqrt((cx - i * w3) * (cx - i * w3) + (cy - j * h3) * (cy - j * h3)) for i in (1, 2) for j in (1, 2)
        ]
        return F.least(*crossings)

    scores = F.transform(boxes, lambda b: F.greatest(F.lit(0.0), F.lit(1.0) - distance(b) / reach))
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def confidence_score(boxes: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(boxes, lambda b: F.coalesce(b["confidence"], F.lit(0.0)))), F.lit(0.0))


# The weights of sharpness, composition and confidence in a frame's score.
SHARPNESS_WEIGHT = 0.3
THIRDS_WEIGHT = 0.3
CONFIDENCE_WEIGHT = 0.4


def combined_score(sharpness: Column, thirds: Column, confidence: Column) -> Column:
    return F.lit(SHARPNESS_WEIGHT) * sharpness + F.lit(THIRDS_WEIGHT) * thirds + F.lit(CONFIDENCE_WEIGHT) * confidence
