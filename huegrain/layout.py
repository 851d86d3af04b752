"""Where a brand's swatches lie on its sheet: one row a hue family, rows in the order of colours, a swatch's place in its row by lightness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import to
from .functions import color as C
from .operators import neighbours as N
from .reports import BAND_NO, ZONE_KEY, _zones
from .zones import families

E = F.expr
#: Fixed values of the sheet, in pixels: width of a row, side of a swatch's slot with its gap, largest swatch, least row, heights of a band's label, gap before it, foot.
TRACK, SLOT, SPACING, LARGEST, LEAST_ROW, LABEL, BAND_GAP, FOOT = 800, 36, 40, 600, 48, 56, 12, 50


def spread(cells: DataFrame, by: list[str], order: list[str], ideal: str = "ideal", spacing: float = SPACING) -> DataFrame:
    """``cells`` with ``place`` (from 0, in ``order``) and ``left``: swatches of a row at their ideal places where these leave room; those that
    would overlap stand side by side, the run centred on the mean of its ideals but right of 0 and of the run before. Ideals must not fall
    along ``order`` nor be negative. A cursor that only moves right is a running maximum, so both passes are windows over one partitioning."""
    along = Window.partitionBy(*by).orderBy(*order)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    run = Window.partitionBy(*by, "_run")
    t = cells.withColumn("place", F.row_number().over(along) - 1)
    t = t.withColumn("_packed", F.max(E(f"{ideal} - {spacing} * place")).over(upto) + spacing * F.col("place"))
    t = t.withColumn("_new", F.when(F.col(ideal) >= F.lag("_packed").over(along) + spacing, 1).when(F.col("place") == 0, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(upto))
    t = t.withColumn("_from", F.avg(ideal).over(run) - (F.count("*").over(run) - 1) * (spacing / 2) - spacing * F.min("place").over(run))
    return t.withColumn("left", F.greatest(F.lit(0.0), F.max("_from").over(upto)) + spacing * F.col("place")).drop("_packed", "_new", "_run", "_from")


def _sheet(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cells with their size and row, and rows (brand, item, band, row, height, top, label_top). A cell of no family is a row by itself."""
    cells = families(spark, d).join(_zones(spark, d).select("brand", F.col("zone").alias("cluster"), *N.LAB), ["brand", "cluster"]).withColumn("item", E("coalesce(zone, cluster)"))
    cells = cells.withColumn("size", E(C.to(f"{LARGEST} * sqrt(n / max(n) OVER (PARTITION BY brand))", 3)))
    mean = lambda c: E(f"sum({c} * n) / sum(n)").alias(c)
    rows = cells.groupBy("brand", "item").agg(F.max("size").alias("largest"), *map(mean, N.LAB))
    rows = C.with_saturation(rows, name="sat0").withColumn("sat", E(C.to("sat0", 6))).withColumn("band", E(C.hsb_class("sat", muted=6))).withColumn("key", E(ZONE_KEY)).withColumn("band_no", E(BAND_NO))
    down = Window.partitionBy("brand").orderBy("band_no", "key", "item")
    rows = rows.withColumn("row", F.row_number().over(down)).withColumn("height", E(C.to(f"greatest({LEAST_ROW}, largest * 0.6e0)", 3)))
    rows = rows.withColumn("new", F.col("band") != F.coalesce(F.lag("band").over(down), F.lit("")))
    above = E(f"height + CASE WHEN NOT new THEN 0 WHEN row = 1 THEN {LABEL} ELSE {LABEL + BAND_GAP} END")
    rows = rows.withColumn("top", F.sum(above).over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("height"))
    return cells, rows.select("brand", "item", "band", "row", "height", "top", F.when(F.col("new"), F.col("top") - LABEL).alias("label_top"))


def swatch_layout(spark, d):
    """A swatch for each of a brand's cells: centre, size by the square root of its products, and row. Cells of equal lightness stand by number."""
    cells, rows = _sheet(spark, d)
    cells = cells.withColumn("light", E(C.to("lab_l", 6))).withColumn("ideal", E(f"light / 100 * {TRACK - SLOT}"))
    placed = spread(cells, ["brand", "item"], ["light", "cluster"]).join(rows, ["brand", "item"])
    return placed.select("brand", "cluster", "zone", "band", "row", "place", to(f"left + {SLOT // 2}", 3, "x"), to("top + height / 2", 4, "y"), "size")


def swatch_bands(spark, d):
    """A brand's bands from top to bottom: where the label stands, how many rows follow, and the height of the whole sheet."""
    rows = _sheet(spark, d)[1]
    bands = rows.groupBy("brand", "band").agg(F.max("label_top").alias("label"), F.count("*").alias("n_rows"), F.max(F.col("top") + F.col("height")).alias("foot"))
    foot = F.max("foot").over(Window.partitionBy("brand")) + FOOT
    return bands.withColumn("sheet", foot).select("brand", "band", "n_rows", to("label", 3, "y"), to("sheet", 3, "sheet_height"))


ALL = [swatch_layout, swatch_bands]
