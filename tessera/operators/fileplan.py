"""Planning how a tree of files becomes another layout: units, moves in an order that works, play lists, emptied folders.

Nothing here touches a file: the result is the rows of a plan. Roots are planned at once and by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.paths import container_members, ending, last
from tessera.sources.staging import released, staged

from .graphs import chain_depths, components

# Files that name their members, and discs of which a play list is made.
CONTAINERS = ("cue", "gdi", "m3u", "ccd")
DISCS = ("chd", "cue", "iso", "cso", "rvz", "pbp")


def folder(rel: Column) -> Column:
    return F.when(F.contains(rel, F.lit("/")), F.regexp_replace(rel, "/[^/]*$", "")).otherwise("")


def joined_path(base: Column, name: Column) -> Column:
    """name below base, with . and .. walked; a path that leads above the root keeps its .. in front."""
    whole = F.concat_ws("/", F.nullif(base, F.lit("")), name)
    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    step = lambda s, p: F.when((p == "..") & (F.size(s) > 0) & (F.element_at(s, -1) != ".."), F.slice(s, 1, F.size(s) - 1)).otherwise(F.array_append(s, p))
    walked = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(whole.rlike(r"(^|/)\.{0,2}(/|$)"), walked).otherwise(whole)


def named_members(texts: DataFrame) -> DataFrame:
    """(root, container, member) that the texts (root, rel, text) of container files name, from their folders; names with a colon are no files. Rows may repeat."""
    name = F.trim(F.replace(F.col("name"), F.lit("\\"), F.lit("/")))
    rows = texts.select("root", F.col("rel").alias("container"), F.explode(F.array_distinct(container_members(F.coalesce("text", F.lit(""))))).alias("name"))
    rows = rows.filter((name != "") & ~F.contains(name, F.lit(":")))
    return rows.select("root", "container", joined_path(folder(F.col("container")), name).alias("member"))


def is_container(rel: Column) -> Column:
    return ending(rel).isin(*CONTAINERS)


def claimed(links: DataFrame, boxes: DataFrame) -> DataFrame | None:
    """(root, container) of the boxes that a unit before them claims, by the links (root, container, member); None if no box is.

    Only containers that an earlier one names are looked at. Whether that one is a unit may hang on one before it, so it
    is settled in rounds, a round for each container inside a container.
    """
    below = links.filter(is_container(F.col("member")) & (F.col("container") < F.col("member")))
    hangs = staged(below.join(boxes, ["root", "container"], "left_semi").join(boxes.withColumnRenamed("container", "member"), ["root", "member"], "left_semi"), "hangs")
    hung = hangs.select("root", F.col("member").alias("container")).distinct().withColumn("hung", F.lit(True))
    open_ = staged(hangs.join(hung, ["root", "container"], "left").select("root", "container", "member", F.when(F.col("hung").isNull(), True).alias("unit")), "open")
    released(hangs)
    out = None
    while True:
        above = open_.groupBy("root", "member").agg(F.max("unit").alias("claimed"), F.max(F.col("unit").isNull()).alias("waits"))
        found = staged(above.filter("claimed or not waits").select("root", F.col("member").alias("container"), (~F.coalesce("claimed", F.lit(False))).alias("found")), "found")
        if found.isEmpty():
            break
        mine = found.filter("not found").select("root", "container")
        before, out = out, staged(mine if out is None else out.unionByName(mine), "claimed")
        rest = open_.join(found.select("root", F.col("container").alias("member")), ["root", "member"], "left_anti").join(found, ["root", "container"], "left")
        left = staged(rest.select("root", "container", "member", F.coalesce("unit", "found").alias("unit")), "open")
        released(open_, found, *([before] if before is not None else []))
        open_ = left
    released(open_, found)
    return out


def units(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(root, rel, primary, multi): the unit of every file (root, rel), named by its primary.

    Containers are taken in the order of their names: one that no earlier unit has claimed is a unit and claims
    its members that none has yet; every other file is a unit by itself. Files meet what names them in one
    grouping by their paths; all else is among containers and their links. What is returned reads staged tables only.
    """
    rows = files.select("root", "rel")
    links = staged(named_members(texts).filter(is_container(F.col("container")) & (F.col("member") != F.col("container"))), "links")
    boxes = rows.filter(is_container(F.col("rel"))).select("root", F.col("rel").alias("container"))
    taken = claimed(links, boxes)
    heads = links.join(boxes, ["root", "container"], "left_semi")
    heads = heads if taken is None else heads.join(taken, ["root", "container"], "left_anti")
    named = rows.select("root", "rel", F.lit(None).cast("string").alias("container")).unionByName(heads.select("root", F.col("member").alias("rel"), "container"))
    # the rows are dealt before they are grouped: nearly all paths are by themselves, so that grouping them before saves nothing
    least = named.repartition("root", "rel").groupBy("root", "rel").agg(F.max(F.col("container").isNull()).alias("here"), F.min("container").alias("first")).filter("here")
    # a container that only later ones name is a unit before them
    own = is_container(F.col("rel")) & (F.col("first") > F.col("rel"))
    of = staged(least.select("root", "rel", F.when(~own, F.col("first")).alias("primary")), "units")
    released(links, *([taken] if taken is not None else []))
    claims = F.col("primary").isNotNull()
    multi = staged(of.filter(claims).select("root", F.col("primary").alias("rel")).distinct().withColumn("multi", F.lit(True)), "multi")
    alone = ~claims & is_container(F.col("rel"))
    both = of.filter(~alone).withColumn("multi", claims).unionByName(of.filter(alone).join(multi, ["root", "rel"], "left"), allowMissingColumns=True)
    return both.select("root", "rel", F.coalesce("primary", "rel").alias("primary"), F.coalesce("multi", F.lit(False)).alias("multi"))


def targets(of: DataFrame, rendered: Column, games: list[str], rename: bool = False, all_files: bool = False) -> DataFrame:
    """units with dst, the place that a template (rendered, of `primary`) gives each file; null for files that are left alone.

    Members of a unit of several files go where its primary goes and keep their names, as they name one another.
    """
    single = F.lit(rename) & (F.col("rel") == F.col("primary")) & ~F.col("multi")
    name = F.when(single, last(rendered)).otherwise(last(F.col("rel")))
    goes = F.lit(all_files) | F.col("multi") | ending(F.col("primary")).isin(games)
    return of.withColumn("dst", F.when(goes, F.concat_ws("/", F.nullif(folder(rendered), F.lit("")), name)))


def planned(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moves, kept): the moves of the files (root, rel, dst), and the files (root, rel) that stay where they are.

    Every path meets what stands there and what goes there in one window. Chains and circles are looked for among moves
    whose place another file leaves first; all others need no further look. Both results read staged tables only.
    """
    rows = placed.select("root", F.col("rel").alias("src"), "dst")
    goes = F.coalesce(F.col("dst") != F.col("src"), F.lit(False))
    none = F.lit(None)
    here = F.struct(F.col("src").alias("path"), none.cast("string").alias("src"), goes.alias("leaves"))
    comes = F.struct(F.col("dst").alias("path"), F.col("src").alias("src"), none.cast("boolean").alias("leaves"))
    paths = rows.select("root", F.explode(F.when(goes, F.array(here, comes)).otherwise(F.array(here))).alias("p")).select("root", "p.*")
    at_path = Window.partitionBy("root", "path")
    paths = paths.withColumns({"first": F.min("src").over(at_path), "stays": F.max(~F.col("leaves")).over(at_path), "left": F.max("leaves").over(at_path)})
    op = F.col("src").isNotNull()
    blocked = (F.col("src") != F.col("first")) | F.coalesce("stays", F.lit(False))
    places = paths.filter(op | ~F.col("leaves")).select("root", F.coalesce("src", "path").alias("src"), F.when(op, F.col("path")).alias("dst"), F.when(op, blocked).alias("blocked"), F.coalesce("left", F.lit(False)).alias("waits"))
    places = staged(places, "places")
    ops = places.filter("dst is not null")
    at = lambda c: F.struct("root", F.col(c).alias("path"))
    links = staged(ops.filter("waits and not blocked").select(at("src").alias("alias"), at("dst").alias("target")), "waits")
    status = F.when(F.col("blocked"), "taken")
    if links.isEmpty():
        released(links)
        done = ops.select("root", "src", "dst", F.when(~F.col("blocked"), 0).alias("step"), status.otherwise("move").alias("status"))
    else:
        info = _ordered(links, ops.filter("blocked").select(at("src").alias("target")))
        status = F.when(F.col("blocked") | F.coalesce("stuck", F.lit(False)), "taken").when(F.col("head"), "park").otherwise("move")
        step = F.when(status == "taken", None).otherwise(F.coalesce("hops", F.lit(0))).cast("int")
        done = ops.join(info, ["root", "src"], "left").select("root", "src", "dst", step.alias("step"), status.alias("status"))
    kept = places.filter("dst is null").select("root", F.col("src").alias("rel")).unionByName(done.filter("status = 'taken'").select("root", F.col("src").alias("rel")))
    return done, kept


def _ordered(links: DataFrame, blocked: DataFrame) -> DataFrame:
    """(root, src, hops, stuck, head) of moves that wait for others (alias waits for target): how many go before, whether the last can't, and who opens a circle."""
    depth = staged(chain_depths(links), "depths")
    rings = depth.filter("target is null").select("alias")
    ring_links = links.join(rings, "alias", "left_semi").join(rings.select(F.col("alias").alias("target")), "target", "left_semi")
    tied = ring_links.select(F.col("alias").alias("node"), F.col("target").alias("key")).unionByName(ring_links.select(F.col("target").alias("node"), F.col("target").alias("key")))
    heads = staged(components(tied, "node", "key").filter("node = component").select(F.col("node").alias("alias")), "heads")
    # a circle is opened at its smallest file, which waits aside until all others of it have gone
    opened = links.join(heads, "alias", "left_anti").join(rings, "alias", "left_semi")
    around = chain_depths(opened.join(heads.select(F.col("alias").alias("target")), "target", "left_anti"))
    known = depth.filter("target is not null").select("alias", "target", "hops").unionByName(around.select("alias", "target", "hops"))
    # what leads to a file that can't go can't go either
    ends = known.join(blocked.withColumn("stuck", F.lit(True)), "target", "left").select("alias", "hops", "stuck", F.lit(False).alias("head"))
    return staged(ends.unionByName(heads.withColumn("head", F.lit(True)), allowMissingColumns=True).select("alias.root", F.col("alias.path").alias("src"), "hops", "stuck", "head"), "ordered")


def moves(placed: DataFrame) -> DataFrame:
    """(root, src, dst, step, status) of the files (root, rel, dst) that have another place to go to.

    status: `move`; `park` for one file of a circle of renames, which is set aside first and put in place last;
    `taken` where the place is another's (the smallest source has it) or will not become free. Moves of a
    step wait for those of the steps before, whose files stand in their places.
    """
    return planned(placed)[0]


def play_lists(done: DataFrame, files: DataFrame) -> DataFrame:
    """(root, dst, content): a list for each folder that gets several discs and has none, named by the folder without its disc."""
    # dealt by folder once, for telling names apart, for gathering them and for the folders that have a list
    discs = done.filter((F.col("status") != "taken") & ending(F.col("dst")).isin(*DISCS)).select("root", folder(F.col("dst")).alias("folder"), last(F.col("dst")).alias("name"))
    have = files.filter(ending(F.col("rel")) == "m3u").select("root", folder(F.col("rel")).alias("folder")).distinct()
    lists = discs.repartition("root", "folder").groupBy("root", "folder").agg(F.sort_array(F.collect_set("name")).alias("names")).filter("size(names) > 1").join(have, ["root", "folder"], "left_anti")
    title = F.trim(F.regexp_replace(last(F.col("folder")), r"\s*\(Dis[ck]\s*\d+\).*$", ""))
    name = F.coalesce(F.nullif(title, F.lit("")), F.nullif(last(F.col("folder")), F.lit("")), F.lit("playlist"))
    return lists.select("root", F.concat_ws("/", F.nullif("folder", F.lit("")), F.concat(name, F.lit(".m3u"))).alias("dst"), F.concat(F.array_join("names", "\n"), F.lit("\n")).alias("content"))


def emptied(done: DataFrame, files: DataFrame, written: DataFrame) -> DataFrame:
    """(root, folder, depth) of folders that moves leave without anything in or below them; the deepest go first."""
    gone = done.filter("status <> 'taken'").select("root", F.col("src").alias("rel"))
    return vacated(done, files.select("root", "rel").join(gone, ["root", "rel"], "left_anti"), written)


def vacated(done: DataFrame, kept: DataFrame, written: DataFrame) -> DataFrame:
    """As emptied(), where the files (root, rel) that stay are known."""
    gone = done.filter("status <> 'taken'")
    at = lambda of, c: of.select("root", folder(F.col(c)).alias("at"))
    filled = at(kept, "rel").unionByName(at(gone, "dst")).unionByName(at(written, "dst"))
    # whatever a folder is in is alive too; folders meet once, those that files leave and those that are alive
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("at", "/"))), lambda n: F.array_join(F.slice(F.split("at", "/"), F.lit(1), n), "/"))
    alive = filled.select("root", F.explode(up).alias("folder"), F.lit(True).alias("alive"))
    left = at(gone, "src").select("root", F.col("at").alias("folder"), F.lit(False).alias("alive")).filter("folder <> ''")
    return left.unionByName(alive).groupBy("root", "folder").agg(F.max("alive").alias("alive")).filter("not alive").select("root", "folder", F.size(F.split("folder", "/")).alias("depth"))


def signatures(files: DataFrame, key: str) -> DataFrame:
    """(key, signature): name, size and time of each of a key's files (path, size, mtime), by path; a file without a size is missing."""
    part = F.concat(last(F.col("path")), F.lit(":"), F.when(F.col("size").isNull(), "missing").otherwise(F.concat_ws(":", F.col("size").cast("string"), F.col("mtime").cast("string"))))
    return files.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("path", part.alias("part")))).alias("p")).select(key, F.array_join("p.part", "|").alias("signature"))
