"""Stores of cell documents as tables: layers laid over each other, fetches, edits, indexes, censuses, quantised planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from . import pyramid as P


def layered(base: DataFrame, dem: DataFrame, img: DataFrame, nir: DataFrame) -> DataFrame:
    """(prefix, dem, img, ...base's other planes): a cell from those of its layers that are there; a layer's planes replace the base's, also by nothing.

    base: prefix, dem, img (struct of red, green, blue, nir), others; dem: prefix, dem; img: prefix, img; nir: prefix, img, which gives its infrared to an image that is there and is the image where none is.
    """
    there = lambda df, c: df.select("prefix", F.struct(F.col(c).alias("v")).alias(f"_{c}"))
    j = base.join(there(dem, "dem"), "prefix", "full_outer").join(there(img, "img"), "prefix", "full_outer")
    j = j.join(nir.select("prefix", F.col("img").alias("_n")), "prefix", "full_outer")
    image = F.when(F.col("_img").isNotNull(), F.col("_img.v")).otherwise(F.col("img"))
    image = F.when(F.col("_n").isNull(), image).when(image.isNull(), F.col("_n")).otherwise(F.struct(image["red"].alias("red"), image["green"].alias("green"), image["blue"].alias("blue"), F.col("_n.nir").alias("nir")))
    return j.withColumns({"dem": F.when(F.col("_dem").isNotNull(), F.col("_dem.v")).otherwise(F.col("dem")), "img": image}).drop("_dem", "_img", "_n")


def fetched(keys: DataFrame, cache: DataFrame, missing: DataFrame, answers: DataFrame) -> DataFrame:
    """(key, status, payload, check): what a store gives for each wanted key: bytes, absent or failed, which are three things.

    A key in the cache is served from it, to be checked behind (check); one known to be missing is absent; any other has the source's answer (status changed, gone or failed; payload), and failed without one. A key asked for twice is fetched once. cache: key, payload; missing: key; answers: key, status, payload; one row a key each.
    """
    k = keys.select("key").distinct()
    held = cache.select("key", F.struct(F.col("payload").alias("p")).alias("_c"))
    gone = missing.select("key").distinct().withColumn("_m", F.lit(True))
    j = k.join(held, "key", "left").join(gone, "key", "left").join(answers.select("key", F.col("status").alias("_s"), F.col("payload").alias("_p")), "key", "left")
    cached, changed = F.col("_c").isNotNull(), F.coalesce(F.col("_s") == "changed", F.lit(False))
    status = F.when(cached, "bytes").when(F.coalesce("_m", F.lit(False)), "absent").when(changed, "bytes").when(F.col("_s") == "gone", "absent").otherwise("failed")
    return j.select("key", status.alias("status"), F.when(cached, F.col("_c.p")).when(changed & F.col("_m").isNull(), F.col("_p")).alias("payload"), cached.alias("check"))


def revalidated(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """(key, payload, tag): the cache after its rows were checked: changed rows are replaced or added, the others stay, whatever the answer was."""
    new = answers.where("status = 'changed'").select("key", F.struct("payload", "tag").alias("_n"))
    j = cache.withColumn("_o", F.struct("payload", "tag")).select("key", "_o").join(new, "key", "full_outer")
    return j.withColumn("_r", F.coalesce("_n", "_o")).select("key", "_r.payload", "_r.tag")


def held_keys(index: DataFrame, layer: str) -> DataFrame:
    """(depth, prefix): the cells held for one layer. index: layer, depth, prefix."""
    return index.where(F.col("layer") == layer).select("depth", "prefix").distinct()


def cached_bytes(index: DataFrame, pinned: DataFrame) -> DataFrame:
    """One row (cached, pinned): bytes of all held documents and of those of pinned cells, of any layer. index: depth, prefix, bytes; pinned: depth, prefix."""
    j = index.join(pinned.select("depth", "prefix").distinct().withColumn("_p", F.lit(True)), ["depth", "prefix"], "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return j.agg(zero("bytes").alias("cached"), zero(F.when(F.col("_p"), F.col("bytes"))).alias("pinned"))


def kind(data: Column, sections: Column, empty: str = "document") -> Column:
    """A stored entry's kind: zstd, etag, its sections' names (sorted, each once, joined by +), the word for an empty document where it has none, raw where it is no document (sections null), unreadable without data."""
    names = F.array_join(F.array_sort(F.array_distinct(sections)), "+")
    tag = (F.length(data) < 80) & (F.length(data) > 0) & (F.substring(data, 1, 1) == F.lit(b'"')) & (F.substring(data, -1, 1) == F.lit(b'"'))
    return F.when(data.isNull(), "unreadable").when(F.substring(data, 1, 4) == F.lit(b"\x28\xb5\x2f\xfd"), "zstd").when(tag, "etag").when(sections.isNull(), "raw").when(F.size(sections) == 0, empty).otherwise(names)


def census(entries: DataFrame) -> DataFrame:
    """(kind, n, bytes) of a store's entries (data, sections), the most numerous first."""
    g = entries.groupBy(kind(F.col("data"), F.col("sections")).alias("kind")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("data")), F.lit(0)).cast("bigint").alias("bytes"))
    return g.orderBy(F.desc("n"), "kind")


def edited(layer: DataFrame, edits: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """layer with columns taken from edits where they have its key, also null ones; every other row and column as it was. Edits of rows that are not there change nothing. One edit a key."""
    j = layer.join(edits.select(*key, F.struct(*columns).alias("_e")), key, "left")
    return j.withColumns({c: F.when(F.col("_e").isNotNull(), F.col(f"_e.{c}")).otherwise(F.col(c)) for c in columns}).drop("_e").select(*layer.columns)


def differing(old: DataFrame, new: DataFrame, key: list[str], planes: list[str]) -> DataFrame:
    """key and the names of the planes in which two versions of a cell differ; nulls are equal, and a cell on one side only differs in every plane that it has. Cells that agree give no row."""
    side = lambda df, n: df.select(*key, F.struct(*planes).alias(n))
    j = side(old, "_a").join(side(new, "_b"), key, "full_outer")
    names = F.array_compact(F.array(*[F.when(~F.col(f"_a.{p}").eqNullSafe(F.col(f"_b.{p}")), F.lit(p)) for p in planes]))
    return j.select(*key, names.alias("planes")).where(F.size("planes") > 0)


def reindexed(index: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """index with the rows of docs in place of its own rows of their keys. Write it sorted by key."""
    return index.join(docs.select(key).distinct(), key, "left_anti").unionByName(docs.select(*index.columns))


def pending(regions: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Regions that no pass has completed yet."""
    return regions.join(done.select(*key).distinct(), key, "left_anti")


def quantised(t: DataFrame, value: str, least: float = 0.05, levels: float = 32_000.0) -> DataFrame:
    """t with base, step and q: a cell's values over its lowest one in steps of a 32,000th of its range, 0.05 at least. Null values have a null q (the mask). t: prefix, value."""
    g = t.groupBy("prefix").agg(F.coalesce(F.min(value), F.lit(0.0)).alias("base"), F.greatest(F.coalesce(F.max(value) - F.min(value), F.lit(0.0)) / levels, F.lit(least)).alias("step"))
    return t.join(g, "prefix").withColumn("q", F.round((F.col(value) - F.col("base")) / F.col("step")).cast("bigint"))


def apron_code(value: Column, base: Column, step: Column) -> Column:
    """An apron's value on its document's base and step: 0 to 65534, 65535 for none."""
    return F.when(value.isNull(), 65535).otherwise(F.least(F.greatest(F.round((value - base) / step), F.lit(0)), F.lit(65534))).cast("int")


def rounded_means(t: DataFrame, value: str) -> DataFrame:
    """One level up: the mean of a texel's four children, rounded half up. t: depth, prefix, texel, an integer value; every texel is there."""
    g = P.with_parent(t).groupBy((F.col("depth") - 1).alias("depth"), F.col("pprefix").alias("prefix"), F.col("ptexel").alias("texel"))
    return g.agg(F.shiftright(F.sum(value) + 2, 2).alias(value))


def tapered(leaf: Column, level: Column, levels: int = C.TEX_BITS) -> Column:
    """The quantiser's step at a level: leaf at the finest, half of it each level up, 1 at least."""
    return F.greatest(F.floor(leaf / F.pow(F.lit(2.0), levels - level)), F.lit(1)).cast("bigint")


def dead_zone(diff: Column, step: Column) -> Column:
    """A difference in steps, rounded up from two thirds of one; step 1 keeps it."""
    size = F.floor((F.abs(diff) + F.floor(step / 3)) / step)
    return F.when(step == 1, diff).when(diff < 0, -size).otherwise(size).cast("bigint")


def in_regions(points: DataFrame, squares: DataFrame) -> DataFrame:
    """(region, way): the lines with a point in a degree square of a region, each once. points: way, lat, lon; squares: region, lat, lon (whole degrees)."""
    lon = F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180
    p = points.select("way", F.floor("lat").alias("lat"), F.floor(lon).alias("lon")).distinct()
    s = squares.select("region", F.col("lat").cast("bigint").alias("lat"), F.col("lon").cast("bigint").alias("lon")).distinct()
    return p.join(s, ["lat", "lon"]).select("region", "way").distinct()


def first_lit(points: DataFrame, tiles: DataFrame, pixels: DataFrame) -> DataFrame:
    """(id, value): of the tiles over a point the first whose pixel there is not 0; those named by their degree square come before the others.

    points: id, lat, lon. tiles: tile, seq, named, north, west, step (degrees a pixel), width, height. pixels: tile, px, py, value. A tile is dealt to the squares that its box touches, so this is two equi-joins.
    """
    lon = F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180
    p = points.withColumn("lon", lon).withColumns({"_y": F.floor("lat"), "_x": F.floor("lon")})
    span = lambda a, b: F.explode(F.sequence(F.floor(a), F.floor(b)))
    t = tiles.withColumn("_y", span(F.col("north") - F.col("height") * F.col("step"), F.col("north"))).withColumn("_x", span(F.col("west"), F.col("west") + F.col("width") * F.col("step")))
    px, py = F.floor((F.col("lon") - F.col("west")) / F.col("step")), F.floor((F.col("north") - F.col("lat")) / F.col("step"))
    j = p.join(t, ["_y", "_x"]).withColumns({"px": px.cast("int"), "py": py.cast("int")}).where("px >= 0 AND py >= 0 AND px < width AND py < height")
    lit = j.select("id", "seq", "named", "tile", "px", "py").join(pixels.where("value <> 0"), ["tile", "px", "py"])
    return lit.groupBy("id").agg(F.min_by("value", F.struct((~F.col("named")).alias("o"), "seq")).alias("value"))


def grep(names: DataFrame, text: str, depth: int | None = None) -> DataFrame:
    """Names whose text or reference holds some letters in any case, of one depth if asked. names: depth, name, reference, others; null texts hold nothing."""
    n = names if depth is None else names.where(F.col("depth") == depth)
    holds = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return n.where(holds("name") | holds("reference"))


def wanted(fine: DataFrame, depth: int, coarsest: int, ring_to: int) -> DataFrame:
    """(depth, prefix): the cells that a view over fine cells of a depth asks for: they and all that hold them down to the coarsest, with the ring of neighbours in their diamond at depths up to ring_to that are coarser than the view's."""
    f = fine.select(F.col("prefix").alias("_p"))
    out = None
    for d in range(coarsest, depth + 1):
        c = f.select(C.ancestor(F.col("_p"), depth - d).alias("prefix")).distinct()
        if d <= ring_to and d < depth:
            gu, gv = C.grid(d, F.col("prefix"))
            near = F.array(*[F.struct((gu + i).alias("cu"), (gv + j).alias("cv")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
            c = c.select(C.cell_diamond(d, F.col("prefix")).alias("dia"), F.explode(near).alias("n")).where(f"n.cu BETWEEN 0 AND {(1 << d) - 1} AND n.cv BETWEEN 0 AND {(1 << d) - 1}")
            c = c.select(C.from_grid(d, F.col("dia"), F.col("n.cu"), F.col("n.cv")).alias("prefix")).distinct()
        c = c.select(F.lit(d).alias("depth"), "prefix")
        out = c if out is None else out.unionByName(c)
    return out


def ramp(height: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """The tint at a height: between two stops in proportion, cut to whole numbers; the first below the stops, the last above them."""
    tint = lambda c: F.struct(*[x.cast("int").alias(n) for n, x in zip(("red", "green", "blue"), c, strict=True)])
    out = tint([F.lit(x) for x in stops[-1][1]])
    for (e0, c0), (e1, c1) in reversed(list(zip(stops, stops[1:], strict=False))):
        t = F.least(F.greatest((height - e0) / (e1 - e0), F.lit(0.0)), F.lit(1.0))
        out = F.when(height < e1, tint([F.lit(float(a)) + (b - a) * t for a, b in zip(c0, c1, strict=True)])).otherwise(out)
    return F.when(height.isNotNull(), out)


def apron_places(cells: DataFrame, depth: int) -> DataFrame:
    """(prefix, side, half, at, near, texel): for the texels one step past each edge of a cell the cell and texel of the depth in which they lie, found by their place, so that seams between diamonds resolve as any other edge. cells: prefix. Sides: 0 low column, 1 high column, 2 low row, 3 high row."""
    gu, gv = C.grid(depth, F.col("prefix"))
    past = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(h).alias("half")) for s in range(4) for h in (0, 1)])
    a = cells.select("prefix", C.cell_diamond(depth, F.col("prefix")).cast("int").alias("dia"), gu.alias("gu"), gv.alias("gv"), F.explode(past).alias("p")).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(C.TEX - 1))))
    beyond = F.when(F.col("p.side") % 2 == 0, -1).otherwise(C.TEX)
    off = F.when(F.col("p.half") == 0, F.lit(1.0) / 3).otherwise(F.lit(2.0) / 3)
    x, y = F.when(F.col("p.side") < 2, beyond).otherwise(F.col("at")), F.when(F.col("p.side") < 2, F.col("at")).otherwise(beyond)
    a = a.withColumns({"cu": (F.col("gu") + (x + off) / C.TEX) / (1 << depth), "cv": (F.col("gv") + (y + off) / C.TEX) / (1 << depth)})
    e = C.encode(C.locate(a, "dia", "cu", "cv"))
    return e.select("prefix", F.col("p.side").alias("side"), F.col("p.half").alias("half"), "at", C.prefix(depth).alias("near"), C.texel(depth).alias("texel"))
