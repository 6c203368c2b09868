"""Raster repair: patches, holes, outliers, gaps and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundloom.functions.constants import CELL_STRIDE
from groundloom.operators import raster, terrain, tiles
from groundloom.operators.order_stats import quantiles
from groundloom.session import cut_lineage, in_parts

KEY = raster.KEY


def framed(cells: DataFrame, meta: DataFrame) -> DataFrame:
    return cells.join(meta.select("scene_id", "ny", "nx"), "scene_id")


def label(cells: DataFrame, meta: DataFrame, diagonal: bool = False) -> DataFrame:
    """Connected patches: each cell's label is its patch's smallest i*stride + j."""
    c = framed(cells, meta).select("scene_id", "i", "j", "ny", "nx", (F.col("i") * CELL_STRIDE + F.col("j")).cast("double").alias("label"))
    steps = raster.EIGHT if diagonal else raster.FOUR
    return tiles.rounds(c, ["label"], tiles.spread_min(steps), monotone=True).select(*KEY, F.col("label").cast("bigint").alias("label"))


def empty_cells(valid: DataFrame, meta: DataFrame) -> DataFrame:
    return raster.all_cells(meta).join(valid, KEY, "left_anti")


def interior_holes(valid: DataFrame, meta: DataFrame) -> DataFrame:
    """Empty cells not joined to the raster's edge through empty cells."""
    patches = framed(label(empty_cells(valid, meta), meta), meta)
    rim = (F.col("i") == 0) | (F.col("j") == 0) | (F.col("i") == F.col("ny") - 1) | (F.col("j") == F.col("nx") - 1)
    open_ = patches.where(rim).select("scene_id", "label").distinct()
    return patches.join(open_, ["scene_id", "label"], "left_anti").select(*KEY)


def keep_main(grid: DataFrame, meta: DataFrame, share: float = 0.05) -> DataFrame:
    """Cells of patches of at least ``share`` of the largest, and of every patch inside their outline."""
    patches = label(grid, meta)
    sizes = patches.groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("scene_id").agg(F.max("n").alias("m"))
    big = sizes.join(largest, "scene_id").where(F.col("n") >= F.col("m") * share).select("scene_id", "label")
    main = patches.join(big, ["scene_id", "label"], "left_semi").select(*KEY)
    inside = interior_holes(main, meta)
    return grid.join(main.unionByName(inside.join(grid, KEY, "left_semi")), KEY, "left_semi")


def fill_interior(grid: DataFrame, holes: DataFrame, meta: DataFrame, relax: int = 200) -> DataFrame:
    """Holes filled from their rims inward, then relaxed; measured cells stay as they are."""
    cells = grid.select(*KEY, "z", F.lit(0.0).alias("hole")).unionByName(holes.select(*KEY, F.lit(None).cast("double").alias("z"), F.lit(1.0).alias("hole")))
    filled = tiles.rounds(framed(cells, meta), ["z", "hole"], tiles.fill_from_rims)
    return tiles.rounds(filled, ["z", "hole"], tiles.relax, sweeps=relax).select(*KEY, "z", (F.col("hole") > 0).alias("filled"))


def outlier_groups(grid: DataFrame, meta: DataFrame, cell: float, limit: float = 3.0, largest: int = 12, passes: int = 3, relax: int = 200, tile: int = tiles.TILE) -> tuple[DataFrame, int]:
    """Small groups standing above (or sunk below) everything around them are emptied and filled again; also how many cells were.

    Scenes of one tile go through all passes in one group. In larger ones a pass is one round over tiles, and only holes and the cells around
    them are filled.
    """
    most = raster.cells_long(limit, cell)
    cells = cut_lineage(framed(grid.select(*KEY, "z"), meta))
    fits = (F.col("ny") <= tile) & (F.col("nx") <= tile)
    done = tiles.rounds(cells.where(fits).withColumn("times", F.lit(0.0)), ["z", "times"], tiles.refill_outliers(most, largest, passes, relax), tile=tile, monotone=True)
    out, found = done.select(*KEY, "z"), int(done.agg(F.coalesce(F.sum("times"), F.lit(0.0))).first()[0])
    large = cells.where(~fits)
    if large.isEmpty():
        return out, found
    for _ in range(passes):
        marked = tiles.rounds(large.withColumn("mark", F.lit(0.0)), ["z", "mark"], tiles.mark_outliers(most, largest), largest + 3, 1, tile, max(tiles.HALO, largest + 3))
        holes = marked.where("mark = 2").select(*KEY)
        n = holes.count()
        if n == 0:
            break
        found += n
        filled = fill_interior(marked.where("mark = 1"), holes, meta, relax).where("filled").select(*KEY, "z")
        large = marked.where("mark < 2").drop("mark").unionByName(framed(filled, meta))
    return out.unionByName(large.select(*KEY, "z")), found


def ground_with_surface(ground: DataFrame, surface: DataFrame, meta: DataFrame, cell: float, narrow: int = 5, fade: int = 3, two_level: float = 3.0) -> DataFrame:
    """Ground model without gaps inside the surface's footprint: narrow gaps bridged from the ground, wide ones follow the
    surface matched at their rim; never above the surface. Distances are exact and only needed up to narrow + 1 cells."""
    both = surface.select(*KEY, F.col("z").alias("surf")).join(ground.select(*KEY, F.col("z").alias("g")), KEY, "left")
    have = F.col("g").isNotNull() & ~(F.col("surf") - F.col("g") > two_level * cell)
    both = cut_lineage(both.withColumn("have", have))
    reach = narrow + 1
    disc = [(a, b, (a * a + b * b) ** 0.5) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if 0 < a * a + b * b <= reach * reach]
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(d).alias("d")) for a, b, d in disc]))
    near = both.where("have").withColumn("_o", steps).select("scene_id", (F.col("i") + F.col("_o.a")).alias("i"), (F.col("j") + F.col("_o.b")).alias("j"), F.col("_o.d").alias("d"))
    near = near.groupBy(*KEY).agg(F.min("d").alias("dist"))
    gaps = both.where("NOT have").join(near, KEY, "left").withColumn("dist", F.coalesce("dist", F.lit(float(reach + 1))))
    gaps = gaps.join(label(gaps, meta), KEY)
    far = gaps.groupBy("scene_id", "label").agg(F.max("dist").alias("reach"))
    gaps = cut_lineage(gaps.join(far, ["scene_id", "label"]).withColumn("narrow", F.col("reach") <= narrow))
    kept = both.where("have")
    bridged = fill_interior(kept.select(*KEY, F.col("g").alias("z")), gaps.where("narrow").select(*KEY), meta).where("filled").select(*KEY, F.col("z").alias("bridge"))
    diff = fill_interior(kept.select(*KEY, (F.col("g") - F.col("surf")).alias("z")), gaps.where("NOT narrow").select(*KEY), meta).where("filled").select(*KEY, F.col("z").alias("diff"))
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (fade + 1 - F.col("dist")) / fade))
    g = gaps.join(bridged, KEY, "left").join(diff, KEY, "left")
    z = F.when(F.col("narrow"), F.coalesce("bridge", "surf")).otherwise(F.col("surf") + F.coalesce("diff", F.lit(0.0)) * w)
    g = g.select(*KEY, F.least(z, "surf").alias("z"), F.when(F.col("narrow"), "narrow").otherwise("wide").alias("kind"))
    return kept.select(*KEY, F.col("g").alias("z"), F.lit("ground").alias("kind")).unionByName(g)


def drain(grid: DataFrame, meta: DataFrame, cell: float) -> DataFrame:
    """Every sink filled so that water runs off each cell to the model's edge (only raises cells)."""
    g = raster.gather(grid, raster.EIGHT, {"n": F.count("nb")}).where("home")
    rim = F.when(F.col("n") < 8, 1.0).otherwise(0.0)
    c = framed(g.select(*KEY, F.col("own").alias("z"), rim.alias("rim")), meta)
    c = c.withColumn("w", F.when(F.col("rim") > 0, F.col("z"))).withColumn("eps", F.lit(1e-5 * cell))
    return tiles.rounds(c, ["z", "rim", "eps", "w"], tiles.drain, monotone=True).select(*KEY, F.col("w").alias("z"), (F.col("w") > F.col("z") + 1e-9).alias("raised"))


def unpinch(quads: DataFrame, parts: int | None = None) -> DataFrame:
    """Quads thinned until none touch only at a corner. A round is one gather per vertex; rounds end when nothing is cut."""
    out = cut_lineage(quads.select(*KEY))
    while True:
        spot = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
        v = out.withColumn("_o", spot)
        has = lambda a, b: F.max((F.col("_o.a") == a) & (F.col("_o.b") == b))
        v = v.withColumn("vi", F.col("i") + F.col("_o.a")).withColumn("vj", F.col("j") + F.col("_o.b"))
        around = in_parts(v, parts, "scene_id", "vi", "vj").groupBy("scene_id", "vi", "vj").agg(
            has(1, 1).alias("nw"), has(1, 0).alias("ne"), has(0, 1).alias("sw"), has(0, 0).alias("se"))
        falling = around.where("nw AND se AND NOT ne AND NOT sw").select("scene_id", F.col("vi").alias("i"), F.col("vj").alias("j"))
        rising = around.where("ne AND sw AND NOT nw AND NOT se").select("scene_id", F.col("vi").alias("i"), (F.col("vj") - 1).alias("j"))
        cut = cut_lineage(falling.unionByName(rising))
        if cut.isEmpty():
            return out
        out = cut_lineage(in_parts(out, parts, *KEY).join(in_parts(cut, parts, *KEY), KEY, "left_anti"))


def large_regions(cells: DataFrame, meta: DataFrame, least: int) -> DataFrame:
    """Cells of 8-connected regions of at least ``least`` cells."""
    found = cut_lineage(label(cells, meta, diagonal=True))
    big = found.groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("scene_id", "label")
    return found.join(big, ["scene_id", "label"], "left_semi").select(*KEY)


def mesh_blocks(blocks: DataFrame, meta: DataFrame, least: int = 12) -> DataFrame:
    """Blocks (scene_id, i, j) that are drawn as mesh: the mask closed by 3x3, without regions of under ``least`` blocks."""
    return large_regions(raster.morph_close(blocks, meta), meta, least)


def keep_faces(faces: DataFrame, blocks: DataFrame, grid: DataFrame, meta: DataFrame, cell: float, block: int = 2, ground_cells: float = 1.5, painted: float = 0.5, shard: float = 8.0) -> DataFrame:
    """Each face with the rules it passes: scene_id, fid, in_block, on_ground, seen, whole, and kept where it passes all.

    ``faces``: scene_id, fid, centre x, y, z, ``longest`` edge and painted ``share``; ``blocks``: those of ``mesh_blocks``. A face is a shard when its
    longest edge is over ``shard`` medians of its scene's.
    """
    med = quantiles(faces.select("scene_id", "longest"), ["scene_id"], "longest", {"med": 0.5})
    c = raster.bilinear(faces, grid, meta, cell).join(med, "scene_id")
    own = blocks.select("scene_id", F.col("i").alias("bi"), F.col("j").alias("bj"), F.lit(True).alias("_in"))
    c = terrain.block_of(c, meta, block * cell).join(own, ["scene_id", "bi", "bj"], "left")
    no = F.lit(False)
    c = c.select(
        "scene_id", "fid", F.coalesce("_in", no).alias("in_block"), F.coalesce(F.abs(F.col("z") - F.col("ground")) <= ground_cells * cell, no).alias("on_ground"),
        F.coalesce(F.col("share") >= painted, no).alias("seen"), (F.col("longest") <= shard * F.col("med")).alias("whole"),
    )
    return c.withColumn("kept", F.col("in_block") & F.col("on_ground") & F.col("seen") & F.col("whole"))
