"""Pictures of pages, ready for an extractor. Needs Pillow, and an orientation tool if pages are to be turned."""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pages import shrink, text_size

try:
    from PIL import Image
except ImportError:
    Image = None


def prepare(data: bytes, turn: Callable[[bytes], int] | None = None) -> bytes | None:
    """PNG bytes of a picture: RGB unless grey or with alpha, turned by what `turn` says, shrunk until its base64 text
    fits. None if the picture can't be read."""
    if Image is None:
        raise ImportError("pictures need Pillow")
    try:
        img = Image.open(io.BytesIO(data))
        if img.mode not in ("RGB", "L", "RGBA"):
            img = img.convert("RGB")
        if turn is not None and (degrees := turn(data)):
            img = img.rotate(degrees, expand=True)

        def png(width: int, height: int) -> bytes:
            out = io.BytesIO()
            (img if (width, height) == img.size else img.resize((width, height), Image.LANCZOS)).save(out, "PNG")
            return out.getvalue()

        whole = png(*img.size)
        return shrink(*img.size, text_size(len(whole)), png) or whole
    except Exception:
        return None


def prepared(files: DataFrame, turn: Callable[[bytes], int] | None = None) -> DataFrame:
    """path, image, image_base64 of files (path, content); pictures that can't be read are left out."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([prepare(c, turn) for c in batch.column("content").to_pylist()], pa.binary())], names=["path", "image"])

    out = files.select("path", "content").mapInArrow(run, "path string, image binary").where(F.col("image").isNotNull())
    return out.withColumn("image_base64", F.base64("image"))
