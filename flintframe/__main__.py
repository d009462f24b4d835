"""A run from the command line: python -m flintframe --data_dir ... --meta_file ..."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import calibration, raster
from .options import from_arguments, parser
from .plans import batch
from .sources import images, metadata, metrics


def main(argv: list[str] | None = None) -> int:
    """Run the batch; 0 if at least one image was measured, 1 if none was, 2 if the inputs won't do."""
    given = parser().parse_args(argv)
    options = from_arguments(given)
    spark = SparkSession.builder.appName("flintframe").getOrCreate()
    try:
        meta = metadata.read_metadata(spark, given.meta_file)
        faults = metadata.validate(meta)
    except Exception as e:  # a path that is not there
        faults = [f"{given.meta_file}: {type(e).__name__}"]
    faults = metadata.missing_folders(spark, given.data_dir) + faults
    if faults:
        print("\n".join(faults), file=sys.stderr)
        return 2
    bars = None
    if options.scale.enabled and not meta.where("coalesce(scale_id, '') <> ''").isEmpty():
        bars = scale_bars(spark, f"{given.data_dir}/scales", options.scale.ink)
    out = given.output_dir or f"{given.data_dir}/processed"
    if given.resume:
        counted = batch.resume(spark, f"{given.data_dir}/images", meta, out, bars, options, given.parts)
        print(f"{counted['images'] - counted['failed']} more images measured")
    else:
        rows, status = batch.run(spark, f"{given.data_dir}/images", meta, bars, options)
        batch.save(rows, status, out, options)
    done = metrics.read_manifest(spark, f"{out}/run_summary")
    ok, n = (0, 0) if done is None else done.agg(F.count_if("ok"), F.count(F.lit(1))).first()
    print(f"{ok} of {n} images measured")
    return 0 if ok else 1


def scale_bars(spark: SparkSession, folder: str, ink: int):
    """image_id (file name without ending), scale_pixels and scale_confidence of the bars in a folder."""
    px = images.read_pixels(spark, folder).where("error is null")
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    grey = px.select(name.alias("image_id"), "y", "x", raster.grey(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    return calibration.detect_scale_bars(grey, ink)


if __name__ == "__main__":
    sys.exit(main())
