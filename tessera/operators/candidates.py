"""Pairs of titles by an inverted index: a title probes with few of its words, rare ones first, and never meets all others.

Titles that are alike in all that is judged are one kind. Kinds meet kinds, each pair once; what belongs
to a kind follows by a join. Long posting lists are split, and a probe goes to each of their pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import gate

#: Postings in a piece of a list.
PIECE = 1024
#: Rows of one kind in a list of its members.
MEMBERS = 1024
#: Rows of a block in a piece of it, where all of them meet all.
ROWS = 4096


def members(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, part, ids): the ids of rows that are alike in `by`, in lists of some MEMBERS; ids hold structs, so that a null one stays."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    dealt = rows.join(sizes, by).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / MEMBERS)).cast("int"))
    return dealt.groupBy(*by, "part").agg(F.collect_list(F.struct("id")).alias("ids"))


def all_members(pairs: DataFrame, *columns: str) -> DataFrame:
    """(a, b, columns): every id of ids_a with every id of ids_b."""
    one = pairs.select(F.explode("ids_a").alias("a"), "ids_b", *columns)
    return one.select("a.id", F.explode("ids_b").alias("b"), *columns).select(F.col("id").alias("a"), F.col("b.id").alias("b"), *columns)


def postings(kinds: DataFrame, tokens: Column) -> DataFrame:
    """(block, token, k, n, piece): each kind under each of its tokens; n is the length of the list, which is in n / PIECE pieces."""
    rows = kinds.select("block", "k", F.explode(F.array_distinct(tokens)).alias("token"))
    sizes = rows.groupBy("block", "token").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(sizes, ["block", "token"]).withColumn("piece", F.pmod(F.xxhash64("k"), F.ceil(F.col("n") / PIECE)).cast("int"))


def meetings(probes: DataFrame, lists: DataFrame) -> DataFrame:
    """(block, k, other) for probes (block, k, token) and the lists that they name, each pair once."""
    sizes = lists.groupBy("block", "token").agg(F.max("n").alias("n"))
    asked = probes.join(sizes, ["block", "token"]).select("block", "k", "token", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / PIECE) - 1).cast("int"))).alias("piece"))
    return asked.join(lists.select("block", "token", "piece", F.col("k").alias("other")), ["block", "token", "piece"]).select("block", "k", "other").distinct()


def gate_tokens(f: Column) -> Column:
    """What a candidate is posted under: its words, its numerals by value, and its letters without spaces."""
    return F.concat(f["tokens"], F.transform(f["values"], lambda v: F.concat(F.lit("v:"), v.cast("string"))), F.array(F.concat(F.lit("q:"), f["squashed"])))


def gate_probes(kinds: DataFrame, lists: DataFrame) -> DataFrame:
    """(block, k, token): what of an owned title every candidate that the gate can accept is posted under.

    The gate wants all identifying words that are no numerals, so the rarest is enough, and none is of use
    where one of them is posted nowhere. Titles of numerals only are asked for by the value of each. Titles
    that are alike but for spaces are always asked for.
    """
    f = F.col("f")
    named = lambda words: F.transform(gate.values(words), lambda v: F.concat(F.lit("v:"), v.cast("string")))
    words = F.filter(f["significant"], lambda w: gate.value(w).isNull())
    rows = kinds.select("block", "k", words.alias("words"), named(F.concat(f["significant"], f["subtitle"])).alias("numbers"), f["squashed"].alias("squashed"))
    sizes = lists.select("block", "token", "n").distinct()
    found = rows.select("block", "k", F.size("words").alias("all"), F.explode("words").alias("token")).join(sizes, ["block", "token"])
    rarest = found.groupBy("block", "k", "all").agg(F.count(F.lit(1)).alias("here"), F.min(F.struct("n", "token")).alias("first")).filter("here = all").select("block", "k", "first.token")
    numbers = rows.filter("size(words) = 0").select("block", "k", F.explode(F.array_distinct("numbers")).alias("token"))
    spaceless = rows.select("block", "k", F.concat(F.lit("q:"), F.col("squashed")).alias("token"))
    return rarest.unionByName(numbers).unionByName(spaceless)


def kinds_of(rows: DataFrame, id: str, block: list[str], features: Column) -> DataFrame:
    """(block, f, k, second): rows alike in block and features, by the smallest id and the one after it."""
    one = rows.select(F.col(id).alias("id"), F.struct(*block).alias("block"), features.alias("f"))
    place = F.row_number().over(Window.partitionBy("block", "f").orderBy("id"))
    two = one.withColumn("place", place).filter("place <= 2")
    return two.groupBy("block", "f").agg(F.min(F.when(F.col("place") == 1, F.col("id"))).alias("k"), F.max(F.when(F.col("place") == 2, F.col("id"))).alias("second"))


def best_accepted(rows: DataFrame, id: str, block: list[str], title: Column) -> DataFrame:
    """(a, b, score): for each title the best other of its block that the gate accepts, of equal scores the smallest id.

    Only kinds are judged, and of them those that a rare word leads to, so what is formed grows with the
    titles and not with their pairs. Titles without words have no match. Ids must be unique and not null.
    """
    features = gate.features(title)
    kinds = kinds_of(rows, id, block, features)
    lists = postings(kinds, gate_tokens(F.col("f")))
    met = meetings(gate_probes(kinds, lists), lists).filter("k <> other")
    both = met.join(kinds.select("k", "f"), "k").join(kinds.select(F.col("k").alias("other"), F.col("f").alias("g")), "other")
    judged = both.select("k", "other", gate.judged_features(F.col("f"), F.col("g")).alias("j")).filter("j.ok")
    best = judged.groupBy("k").agg(F.max(F.struct(F.col("j.score").alias("score"), (-F.col("other")).alias("id"))).alias("best"))
    own = kinds.select("block", "f", "k", "second", gate.judged_features(F.col("f"), F.col("f")).alias("own")).join(best, "k", "left")
    each = rows.select(F.col(id).alias("a"), F.struct(*block).alias("block"), features.alias("f")).join(own, ["block", "f"])
    twin = F.when(F.col("a") == F.col("k"), F.col("second")).otherwise(F.col("k"))
    alike = F.when(F.col("own.ok") & twin.isNotNull(), F.struct(F.col("own.score").alias("score"), (-twin).alias("id")))
    return each.select("a", F.greatest("best", alike).alias("best")).filter("best is not null").select("a", (-F.col("best.id")).alias("b"), F.col("best.score").alias("score"))


def alike(rows: DataFrame, id: str, block: list[str], key: Column, percent: int) -> DataFrame:
    """(a, b, rows_a, rows_b, shared) for pairs of keys in a block whose words are alike by `percent` (shared words of all), a being the smaller key.

    a and b are the smallest ids of their keys; rows of one key are no pair. Of two such keys one must be posted under one of the
    first words of the other, in an order that puts rare words first: for n words the first n - ceil(p n) + 1. Keys whose
    numbers of words rule a pair out are not compared. Keys without words have no pair.
    """
    words = F.array_distinct(F.filter(F.split(key, " "), lambda w: w != ""))
    named = rows.select(F.col(id).alias("id"), F.struct(*block).alias("block"), key.alias("key"), words.alias("words")).filter("size(words) > 0")
    kinds = named.groupBy("block", "key", "words").agg(F.min("id").alias("k"), F.count(F.lit(1)).alias("rows"))
    lists = postings(kinds, F.col("words"))
    ordered = lists.groupBy("block", "k").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("o"))  # a title's words
    size = F.size("o")
    prefix = F.slice("o", F.lit(1), (size - F.ceil(size * F.lit(percent) / 100) + 1).cast("int"))
    probes = ordered.select("block", "k", F.explode(prefix).alias("p")).select("block", "k", "p.token")
    # both sides only by their first words: two that are alike share one of them
    first = probes.join(lists.select("block", "token", "k", "piece", "n"), ["block", "token", "k"])
    met = meetings(probes, first).filter("k <> other")
    side = lambda n: kinds.select(F.col("k").alias(n), F.col("key").alias(f"key_{n}"), F.col("words").alias(f"words_{n}"), F.col("rows").alias(f"rows_{n}"))
    pairs = met.select(F.col("k").alias("a"), F.col("other").alias("b")).join(side("a"), "a").join(side("b"), "b").filter("key_a < key_b")
    n_a, n_b = F.size("words_a"), F.size("words_b")
    fits = pairs.filter(F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent).withColumn("shared", F.size(F.array_intersect("words_a", "words_b")))
    return fits.filter(F.col("shared") * 100 >= (n_a + n_b - F.col("shared")) * percent).select("a", "b", "rows_a", "rows_b", "shared")


def sharing(rows: DataFrame, id: str, block: list[str], key: Column, least: int) -> DataFrame:
    """(a, b, shared) for all rows of a block whose keys differ and have `least` words or more in common, a having the smaller key.

    Keys are compared, each pair once, and their rows follow. Two keys of so many words in common have one of them among the first
    n - least + 1 words of both, in an order that puts rare words first. Rows with a null in `block` have no pair. Ids must be unique.
    """
    each = rows.dropna(subset=block).select(F.col(id).alias("id"), F.struct(*block).alias("block"), key.alias("k")).distinct()
    words = lambda k: F.array_distinct(F.filter(F.split(k, " "), lambda w: w != ""))
    kinds = each.select("block", "k").distinct().filter(F.size(words(F.col("k"))) >= least)
    lists = postings(kinds, words(F.col("k")))
    ordered = lists.groupBy("block", "k").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("o"))  # a key's words
    probes = ordered.select("block", "k", F.explode(F.slice("o", F.lit(1), F.size("o") - (least - 1))).alias("p")).select("block", "k", "p.token")
    first = probes.join(lists.select("block", "token", "k", "piece", "n"), ["block", "token", "k"])
    met = meetings(probes, first).filter("k < other")
    pairs = met.withColumn("shared", F.size(F.array_intersect(words(F.col("k")), words(F.col("other")))).cast("long")).filter(F.col("shared") >= least)
    of = members(each, ["block", "k"])
    side = lambda k, n: of.select("block", F.col("k").alias(k), F.col("ids").alias(f"ids_{n}"))
    return all_members(pairs.join(side("k", "a"), ["block", "k"]).join(side("other", "b"), ["block", "other"]), "shared")


def judged_pairs(rows: DataFrame, id: str, block: list[str], title: Column, shown: Callable[[Column], Column] = lambda score: score) -> DataFrame:
    """(a, b, ok, score) for all rows of a block with all, themselves included, accepted or not, where both titles have words.

    The gate judges kinds, each pair once, and their rows follow; shown: what is made of a score, once for kinds too. A block
    is cut into pieces of some PIECE lists of rows of a kind and some ROWS rows, and each two pieces are dealt by themselves, to as many
    tasks as there are shuffle partitions: lists are small, and rows many. Rows with a null in `block` have no pair.
    """
    f = gate.features(title)
    each = rows.dropna(subset=block).select(F.col(id).alias("id"), F.struct(*block).alias("block"), f.alias("f")).filter("size(f.tokens) > 0")
    lists = members(each, ["block", "f"])
    sizes = lists.groupBy("block").agg(F.count(F.lit(1)).alias("lists"), F.sum(F.size("ids")).alias("rows"))
    pieces = F.ceil(F.greatest(F.col("lists") / PIECE, F.col("rows") / ROWS)).cast("int")
    sized = lists.join(sizes, "block").select("block", "f", "ids", pieces.alias("pieces"), F.pmod(F.xxhash64("f", "part"), pieces).cast("int").alias("piece"))
    each_piece = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    cell, tasks = ["block", "piece_a", "piece_b"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asking = sized.select("block", F.col("f").alias("f_a"), F.col("ids").alias("ids_a"), F.col("piece").alias("piece_a"), each_piece.alias("piece_b")).repartition(tasks, *cell)
    asked = sized.select("block", F.col("f").alias("f_b"), F.col("ids").alias("ids_b"), each_piece.alias("piece_a"), F.col("piece").alias("piece_b")).repartition(tasks, *cell)
    judged = asking.join(asked, cell).select("ids_a", "ids_b", gate.judged_features(F.col("f_a"), F.col("f_b")).alias("j"))
    return all_members(judged.select("ids_a", "ids_b", "j.ok", shown(F.col("j.score")).alias("score")), "ok", "score")
