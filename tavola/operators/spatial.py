"""Joins of places within a band of latitude and longitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.config import Settings
from tavola.functions.geo import cell

#: Cells of the join are this much wider than the band: then the other place of a pair is in a neighbouring cell at most.
MARGIN = 1.25


def join_cell(degrees: Column, settings: Settings) -> Column:
    return cell(degrees, settings.band * MARGIN)


def cell_rank(settings: Settings) -> Column:
    """The order in which candidates are looked at: the left place's own cell of ``settings.cell``, then its neighbours row by row."""
    i, j = (cell(F.col(f"r_{c}"), settings.cell) - cell(F.col(f"l_{c}"), settings.cell) + 1 for c in ("lat", "lon"))
    at = (i * 3 + j).cast("int")
    return F.when(at == 4, 0).when(at < 4, at + 1).otherwise(at)


def band_join(left: DataFrame, right: DataFrame, settings: Settings | None = None, salts: int = 1) -> DataFrame:
    """Pairs within ``settings.band`` degrees in both coordinates; all columns of both sides and ``cell_rank``.

    Both sides have lat and lon under the names l_lat, l_lon, r_lat, r_lon.  Every left row meets the 3 x 3 cells
    around its own, so the join is an equi-join on cells with the band as residual, and loses no pair.  The join's
    cells are little wider than the band, so few pairs are tested in vain.  Spark broadcasts a side only if its size
    allows.  For very common cells ``salts`` spreads left rows over that many copies of the right side.
    """
    s = settings or Settings()
    if s.band > s.cell / 2:
        raise ValueError("the band may not exceed half a cell")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    cells = left.where("l_lat IS NOT NULL AND l_lon IS NOT NULL").select(
        "*", join_cell(F.col("l_lat"), s).alias("_li"), join_cell(F.col("l_lon"), s).alias("_lj"), F.pmod(F.xxhash64("l_id"), F.lit(salts)).cast("int").alias("_salt"), F.explode(around).alias("_n")
    )
    cells = cells.select(*left.columns, "_salt", (F.col("_li") + F.col("_n.i")).alias("_ci"), (F.col("_lj") + F.col("_n.j")).alias("_cj"))
    places = right.where("r_lat IS NOT NULL AND r_lon IS NOT NULL").select(
        "*", join_cell(F.col("r_lat"), s).alias("_ci"), join_cell(F.col("r_lon"), s).alias("_cj"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    )
    near = (F.abs(F.col("l_lat") - F.col("r_lat")) <= s.band) & (F.abs(F.col("l_lon") - F.col("r_lon")) <= s.band)
    return cells.join(places, ["_ci", "_cj", "_salt"]).where(near).drop("_ci", "_cj", "_salt").withColumn("cell_rank", cell_rank(s))


def unlocated_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left row without a coordinate with every right row; ``cell_rank`` is 0.

    Its output is as large as that product; resolve() calls it only if no threshold allows an equi-join.
    """
    return left.where("l_lat IS NULL OR l_lon IS NULL").withColumn("cell_rank", F.lit(0)).crossJoin(right)
