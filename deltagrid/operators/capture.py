"""Camera frames, sampled grids, downloads of an area, and area documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import measure as M
from .layers import ancestors

#: Where red and blue stand in a quad, counted by rows.
FILTERS = {"rggb": (0, 3), "grbg": (1, 2), "gbrg": (2, 1), "bggr": (3, 0)}
#: The depths that an area is kept between.
AREA_DEPTHS = (8, 14)


def _factor(width: int, columns: int) -> int:
    return max((width // 2 // max(columns, 1)) & ~1, 2)


def binned(pixels: DataFrame, width: int, height: int, columns: int, white: int, black: tuple[int, int, int, int], order: str = "rggb") -> DataFrame:
    """(frame, bx, by, red, green, blue, clipped): the light of bins of quads over black, in 64ths of a sample's unit; both greens together; samples within 2 of white are clipped. pixels: frame, x, y, v; what lies beyond whole bins is left out. One group-by with partial sums."""
    f = _factor(width, columns)
    w, h = width // 2 // f, height // 2 // f
    p = pixels.withColumns({"bx": F.floor(F.col("x") / (2 * f)), "by": F.floor(F.col("y") / (2 * f)), "k": F.col("y") % 2 * 2 + F.col("x") % 2}).where((F.col("bx") < w) & (F.col("by") < h))
    sums = [F.coalesce(F.sum(F.when(F.col("k") == k, F.col("v"))), F.lit(0)).alias(f"s{k}") for k in range(4)]
    g = p.groupBy("frame", "bx", "by").agg(*sums, F.sum((F.col("v") >= max(white - 2, 0)).cast("bigint")).alias("clipped"))
    light = [F.greatest(F.col(f"s{k}") - f * f * black[k], F.lit(0)).cast("bigint") for k in range(4)]
    red, blue = FILTERS[order]
    whole = lambda c: F.floor(c * 64 / (f * f)).cast("bigint")
    green = F.floor((light[0] + light[1] + light[2] + light[3] - light[red] - light[blue]) / 2)
    return g.select("frame", "bx", "by", whole(light[red]).alias("red"), whole(green).alias("green"), whole(light[blue]).alias("blue"), "clipped")


def histogram(pixels: DataFrame, width: int, height: int, columns: int, white: int) -> DataFrame:
    """(frame, bin, n): every sixteenth sample of the upper rows of binned quads, in 256 bins of the sensor's bits."""
    f = _factor(width, columns)
    rows = height // 2 // f * f * 2
    shift = max(white.bit_length() - 8, 0)
    p = pixels.where((F.col("y") % 2 == 0) & (F.col("y") < rows) & (F.col("x") % 16 == 0) & (F.col("x") + 16 <= width))
    return p.groupBy("frame", F.least(F.floor(F.col("v") / (1 << shift)), F.lit(255)).alias("bin")).agg(F.count("*").alias("n"))


def brightest(bins: DataFrame) -> DataFrame:
    """(frame, p999): of 0 to 1, the first bin up to which 999 of 1,000 samples lie. A frame has 256 bins at most."""
    w = Window.partitionBy("frame")
    seen = F.sum("n").over(w.orderBy("bin"))
    b = bins.withColumns({"_seen": seen, "_all": F.sum("n").over(w)}).where("_seen * 1000 >= _all * 999")
    return b.groupBy("frame").agg((F.min("bin") / 255.0).alias("p999"))


def grid_values(points: DataFrame, grid: DataFrame, west: float, north: float) -> DataFrame:
    """(id, intensity, canopy): a grid's cell of a metre under each point; no row beyond the grid, a null intensity where nothing came back. points: id, x, y in metres; grid: cx, cy counted from the north-west corner, intensity, canopy."""
    p = points.select("id", F.floor(F.col("x") - west).cast("bigint").alias("cx"), F.floor(north - F.col("y")).cast("bigint").alias("cy"))
    j = p.join(grid.select(F.col("cx").cast("bigint").alias("cx"), F.col("cy").cast("bigint").alias("cy"), "intensity", "canopy"), ["cx", "cy"])
    return j.select("id", F.when(F.col("intensity") != 0, F.col("intensity")).alias("intensity"), "canopy")


def elevation_at(points: DataFrame, dem: DataFrame, coarsest: int, finest: int) -> DataFrame:
    """(id, elev): the height under each point at the finest depth that has one there; null where none has. points: id, diamond, u, v; dem: depth, prefix, texel, q (quantised, null for none). One equi-join over a row a depth."""
    at = F.array(*[F.struct(F.lit(d).cast("int").alias("depth"), C.prefix(d).alias("prefix"), C.texel(d).alias("texel")) for d in range(coarsest, finest + 1)])
    p = points.select("id", F.explode(at).alias("a")).select("id", "a.*")
    held = dem.where("q IS NOT NULL").select(F.col("depth").cast("int").alias("depth"), "prefix", "texel", "q")
    g = p.join(held, ["depth", "prefix", "texel"], "left").groupBy("id").agg(F.max_by("q", F.when(F.col("q").isNotNull(), F.col("depth"))).alias("q"))
    return g.select("id", M.dequantize_elevation(F.col("q")).alias("elev"))


def downloaded(cells: DataFrame, answers: DataFrame, depth: int) -> DataFrame:
    """One row (done, absent, failed, bytes): how an area's download ends. A cell that is absent, or under an absent one, is absent and not asked for; of the others the documents' bytes add up, and those that fail count, of any layer.

    cells: up (levels above depth), prefix; answers: layer, up, prefix, status (bytes, absent, failed), bytes; a cell's base decides whether it is absent; one without an answer failed.
    """
    base = answers.where("layer = 'base'").select("up", "prefix", F.col("status").alias("_s"))
    c = cells.select("up", "prefix").distinct().join(base, ["up", "prefix"], "left").withColumn("_s", F.coalesce("_s", F.lit("failed")))
    gone = c.where("_s = 'absent'").select(F.col("up").alias("aup"), F.col("prefix").alias("aprefix"))
    over = ancestors(c.select(F.col("up").alias("_u"), "prefix"), depth).withColumn("aup", F.col("_u") + F.col("up"))
    under = over.join(gone, ["aup", "aprefix"], "left_semi").select(F.col("_u").alias("up"), "prefix").distinct().withColumn("_gone", F.lit(True))
    j = c.join(under, ["up", "prefix"], "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    sizes = answers.where("layer <> 'base' OR status = 'bytes'").groupBy("up", "prefix").agg(F.sum(F.when(F.col("status") == "bytes", F.col("bytes"))).alias("_b"), F.sum(((F.col("status") == "failed") & (F.col("layer") != "base")).cast("bigint")).alias("_f"))
    j = j.join(sizes, ["up", "prefix"], "left")
    got = ~F.col("_gone") & (F.col("_s") == "bytes")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return j.agg(F.count("*").alias("done"), total(F.col("_gone").cast("bigint")).alias("absent"), total(F.when(~F.col("_gone") & (F.col("_s") == "failed"), 1).when(got, F.coalesce("_f", F.lit(0)))).alias("failed"), total(F.when(got, F.col("_b"))).alias("bytes"))


def retried(requests: DataFrame, failures: DataFrame, wait_s: float = 3.0) -> DataFrame:
    """Requests (key, at in seconds) that may go out: those without a failure of their key in the wait before them. Failures are reduced to seconds, so that a request meets a few rows of its key only."""
    span = int(wait_s) + 1
    f = failures.select("key", F.col("at").alias("_f"), F.explode(F.sequence(F.floor("at"), F.floor("at") + span)).alias("_s")).groupBy("key", "_s").agg(F.collect_set("_f").alias("_all"))
    late = requests.withColumn("_s", F.floor("at")).join(f, ["key", "_s"]).where(F.exists("_all", lambda x: (x <= F.col("at")) & (F.col("at") - x < wait_s)))
    return requests.join(late.select("key", "at").distinct(), ["key", "at"], "left_anti")


def documents(areas: DataFrame, cells: DataFrame, share: bool) -> DataFrame:
    """An area as a document, one row: name, created, depth, shape (array of depth, cell, cov by depth and cell), and, unless it is shared, the device's record of its fetch. areas: area, name, created, depth, fetched, bytes; cells: area, depth, prefix, cov. A document holds one area's cells."""
    raw = F.call_function("shiftleft", F.col("prefix"), (60 - 2 * F.col("depth")).cast("int"))
    shape = cells.groupBy("area").agg(F.array_sort(F.collect_list(F.struct("depth", raw.alias("cell"), "cov"))).alias("shape"))
    out = areas.join(shape, "area", "left").withColumn("shape", F.coalesce("shape", F.array().cast(shape.schema["shape"].dataType)))
    return out.drop("fetched", "bytes") if share else out


def from_documents(docs: DataFrame) -> DataFrame:
    """(area, depth, cell_depth, prefix, cov): the cells of area documents, their depth within what an area may have."""
    low, high = AREA_DEPTHS
    d = docs.select("area", F.greatest(F.least("depth", F.lit(high)), F.lit(low)).alias("depth"), F.explode("shape").alias("s"))
    return d.select("area", "depth", F.col("s.depth").alias("cell_depth"), F.call_function("shiftrightunsigned", F.col("s.cell"), (60 - 2 * F.col("s.depth")).cast("int")).alias("prefix"), "s.cov")


def newest_files(files: DataFrame) -> DataFrame:
    """One row a file name (the first listed), newest year first, then by name. files: file, year, seq, others."""
    first = files.groupBy("file").agg(F.min_by(F.struct(*[c for c in files.columns if c != "file"]), "seq").alias("_f")).select("file", "_f.*")
    return first.orderBy(F.desc("year"), "file")


def followed(values: Column, limit: float = 0.05) -> Column:
    """Of an array of (az, alt) in order those that are taken: the first, and each that differs from the last one taken by more than the limit in either; unknown ones are taken."""
    near = lambda a, b: F.coalesce((F.abs(a["az"] - b["az"]) <= limit) & (F.abs(a["alt"] - b["alt"]) <= limit), F.lit(False))
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, 1), lambda out, x: F.when(near(F.element_at(out, -1), x), out).otherwise(F.array_append(out, x)))


def shaded(raster: DataFrame, step_m: float, sun: tuple[float, float, float]) -> DataFrame:
    """(tile, px, py, nx, ny, nz, light): the ground's normal from differences with its neighbours, one-sided at gaps, and its share of the light from a direction (east, south, up; of length 1). py grows to the south."""
    from .terrain import around

    a = around(raster, [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]).where("n0 IS NOT NULL")

    def gradient(low: str, high: str) -> Column:
        span = F.when(F.col(low).isNotNull(), 1).otherwise(0) + F.when(F.col(high).isNotNull(), 1).otherwise(0)
        return F.when(span > 0, (F.coalesce(high, "n0") - F.coalesce(low, "n0")) / (span * step_m)).otherwise(0.0)

    a = a.withColumns({"gx": gradient("n1", "n2"), "gy": gradient("n3", "n4")})
    length = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + 1)
    a = a.withColumns({"nx": -F.col("gx") / length, "ny": -F.col("gy") / length, "nz": 1 / length})
    return a.select("tile", "px", "py", "nx", "ny", "nz", F.greatest(F.col("nx") * sun[0] + F.col("ny") * sun[1] + F.col("nz") * sun[2], F.lit(0.0)).alias("light"))
