"""Joins that are not equalities, planned as equalities on derived keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tindra.functions import geo, similarity
from tindra.functions.lineage import settle


def near_points(left: DataFrame, right: DataFrame, radius_m: float, left_point: tuple[str, str], right_point: tuple[str, str], inclusive: bool = False, on: tuple[str, ...] = ()) -> DataFrame:
    """All pairs within the radius that agree in the columns ``on``, with the column ``distance_m``, by cells.

    The right side goes to its cell, the left side to the nine around its own, and the cells are
    equi-keys; the exact distance is a residual."""
    cells = geo.Cells(radius_m)
    pairs = cells.spread(left, *left_point).join(cells.keyed(right, *right_point), ["_cy", "_cx", *on]).drop("_cy", "_cx")
    pairs = pairs.withColumn("distance_m", geo.haversine(*(F.col(c) for c in (*left_point, *right_point))))
    return pairs.where((F.col("distance_m") <= radius_m) if inclusive else (F.col("distance_m") < radius_m))


def radius_join(left: DataFrame, right: DataFrame, radius_m: float, left_point: tuple[str, str], right_point: tuple[str, str], inclusive: bool = False, on: tuple[str, ...] = ()) -> DataFrame:
    """All pairs within the radius that agree in the columns ``on``, with the column ``distance_m``.

    Column names must differ between the sides.  Rows without a finite point pair with nothing."""
    finite = lambda p: F.col(p[0]).isNotNull() & F.col(p[1]).isNotNull() & ~F.isnan(p[0]) & ~F.isnan(p[1])
    return near_points(left.where(finite(left_point)), right.where(finite(right_point)), radius_m, left_point, right_point, inclusive, on)


def tasks(df: DataFrame) -> int:
    """A number of tasks that stays as it is where a small table makes many rows."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


BLOCK = 256  # rows of one key that stay together


def blocks(df: DataFrame, keys: list[str], row: str, name: str, size: int | None = None) -> DataFrame:
    """The rows of each key (not null) as lists ``name`` of about ``size`` (``BLOCK``), numbered by ``name``_block."""
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / (size or BLOCK)).cast("int").alias("_blocks"))
    dealt = df.join(sizes, keys).withColumn(f"{name}_block", F.pmod(F.xxhash64(row), F.col("_blocks")).cast("int"))
    return dealt.groupBy(*keys, f"{name}_block").agg(F.collect_list(row).alias(name))


def radius_pairs(points: DataFrame, radius_m: float) -> DataFrame:
    """Pairs a < b of a table's ids (id, lat, lon) within the radius, with ``distance_m``.

    A pair of points is measured once; the ids of a point are lists of bounded length, and pairs of lists
    are what tasks share."""
    a, b = (settle(blocks(points.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)"), ["lat", "lon"], "id", "ids")).toDF(f"{s}lat", f"{s}lon", f"{s}block", f"{s}ids") for s in "ab")
    near = near_points(a.select("alat", "alon").distinct(), b.select("blat", "blon").distinct(), radius_m, ("alat", "alon"), ("blat", "blon"))
    lists = a.join(near, ["alat", "alon"]).join(b, ["blat", "blon"])
    first, second = (F.struct(f"{s}lat", f"{s}lon", f"{s}block") for s in "ab")
    lists = lists.where(first <= second).repartition(tasks(points), "alat", "alon", "ablock", "blat", "blon", "bblock")
    each = lists.select("distance_m", (first == second).alias("_own"), F.explode("aids").alias("_a"), "bids").select("distance_m", "_own", "_a", F.explode("bids").alias("_b"))
    each = each.where(F.when(F.col("_own"), F.col("_a") < F.col("_b")).otherwise(F.col("_a") != F.col("_b")))
    return each.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "distance_m")


def near_lists(left: DataFrame, right: DataFrame, radius_m: float, inclusive: bool = False, size: int | None = None) -> DataFrame:
    """Lists ``as`` and ``bs`` of bounded length (about ``size``, or ``BLOCK``) of the rows (lat, lon, row: a
    struct with an id) at each pair of points within the radius, with ``distance_m``; each row of one side
    meets each of the other once.

    A pair of points is measured once, and pairs of lists are what tasks share."""
    a, b = (settle(blocks(df.where("NOT isnan(lat) AND NOT isnan(lon)"), ["lat", "lon"], "row", "rows", size)).toDF(f"{s}lat", f"{s}lon", f"{s}block", f"{s}s") for s, df in (("a", left), ("b", right)))
    near = near_points(a.select("alat", "alon").distinct(), b.select("blat", "blon").distinct(), radius_m, ("alat", "alon"), ("blat", "blon"), inclusive)
    lists = a.join(near, ["alat", "alon"]).join(b, ["blat", "blon"])
    return lists.repartition(tasks(left), "alat", "alon", "ablock", "blat", "blon", "bblock").select("as", "bs", "distance_m")


GRAM = 4


def contains_join(small: DataFrame, large: DataFrame, small_text: str, large_text: str, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs that agree in the columns ``on`` where ``small_text`` occurs in ``large_text`` (the empty text
    occurs in every text).

    A text of at least ``GRAM`` characters is keyed by the one of its stretches of that length that the
    fewest large texts have, a shorter one by itself; large texts by all stretches of the lengths that
    are asked for, those that no small text has left out first."""
    small, large = small.where(F.col(small_text).isNotNull()), large.where(F.col(large_text).isNotNull())
    sizes = sorted(r.n for r in small.select(F.least(F.length(small_text), F.lit(GRAM)).alias("n")).distinct().collect())  # at most GRAM + 1

    def grams(c: str, lengths: list[int]):
        at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(n)))
        return F.array_distinct(F.concat(F.array().cast("array<string>"), *(at(n) for n in lengths)))

    # a text has tens of keys, so few texts need many tasks too
    spread = large.repartition(tasks(large)).withColumn("_gram", F.explode(grams(large_text, sizes)))
    keys = F.when(F.length(small_text) < GRAM, F.array(small_text)).otherwise(grams(small_text, [GRAM]))
    asked = small.select(*on, small_text).distinct().repartition(tasks(small)).select(*on, small_text, F.explode(keys).alias("_gram"))
    held = spread.select(*on, "_gram").join(asked.select(*on, "_gram").distinct(), [*on, "_gram"], "left_semi").groupBy(*on, "_gram").agg(F.count("*").alias("_n"))
    rarest = asked.join(held, [*on, "_gram"], "left").groupBy(*on, small_text).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_best"))
    rarest = rarest.where("_best.n > 0").select(*on, small_text, F.col("_best.gram").alias("_gram"))
    return small.join(rarest, [*on, small_text]).join(spread, [*on, "_gram"]).drop("_gram").where(F.col(large_text).contains(F.col(small_text)))


LONG = 96  # characters from which on pieces are looked for anywhere, not near their own place


def _pieces(ratio: float) -> str:
    """SQL: a text ``b`` cut into one piece more than letters that can be in one of the two texts only,
    so one piece at least is whole in the other.  Keys: piece and, below ``LONG``, length and number."""
    share = 2 * (1 - ratio) / ratio
    return f"""transform(array(cast(floor(length(b) * {share}D + 1e-9D) as int) + 1), m -> transform(sequence(0, m - 1), i -> xxhash64(
        if(length(b) < {LONG}, length(b), -1), if(length(b) < {LONG}, i, -1), substring(b, cast(floor(i * length(b) / m) as int) + 1, cast(floor((i + 1) * length(b) / m) - floor(i * length(b) / m) as int)))))[0]"""


def _stretches(ratio: float) -> str:
    """SQL: the keys that pieces of a text with the ratio can have in a text ``a``.

    Of two texts of lengths n and k at most (1 - ratio) (n + k) letters are in one only, so a piece moves
    by no more than that allows, and k is bounded by n."""
    share, most = 2 * (1 - ratio) / ratio, (2 - ratio) / ratio
    begin = "cast(floor(i * k / m) as int)"
    size = f"(cast(floor((i + 1) * k / m) as int) - {begin})"
    apart = f"floor({1 - ratio}D * (length(a) + k) + 1e-9D)"
    low = f"greatest(0, cast({begin} + ceil((length(a) - k - {apart}) / 2) as int))"
    high = f"least(length(a) - {size}, cast({begin} + floor((length(a) - k + {apart}) / 2) as int))"
    near = f"if({high} < {low}, array(), transform(sequence({low}, {high}), p -> xxhash64(k, i, substring(a, p + 1, {size}))))"
    pieces = f"transform(array(cast(floor(k * {share}D + 1e-9D) as int) + 1), m -> flatten(transform(sequence(0, m - 1), i -> {near})))[0]"
    shortest, longest = f"greatest(1, cast(ceil(length(a) / {most}D - 1e-9D) as int))", f"cast(floor(length(a) * {most}D + 1e-9D) as int)"
    placed = f"if({shortest} >= {LONG}, array(), flatten(transform(sequence({shortest}, least({longest}, {LONG - 1})), k -> {pieces})))"
    # a long text's pieces have one of a few lengths
    sizes = sorted({n for k in (LONG, 10 * LONG, 100 * LONG) for m in [int(k * share + 1e-9) + 1] for n in range(int(k / m) - 1, int(k / m) + 3) if n > 0})
    anywhere = "flatten(transform(array({}), n -> if(length(a) < n, array(), transform(sequence(1, length(a) - n + 1), p -> xxhash64(-1, -1, substring(a, p, n))))))".format(", ".join(map(str, sizes)))
    return f"array_distinct(concat({placed}, if({longest} < {LONG}, array(), {anywhere})))"


def full_keys(df: DataFrame, c: str, asking: bool) -> DataFrame:
    """Rows (c, _k) of the distinct texts of a column: of two texts, one of them ``asking``, the shorter list
    of words leads the longer or both have the same words where they have a key in common, and only there."""
    words = df.select(c).distinct().withColumn("_w", similarity.words(F.col(c))).where(F.size("_w") > 0)
    mark = lambda sign, x: F.concat(F.lit(sign), x)
    heads = lambda sign, n: F.transform(F.sequence(F.lit(1), n), lambda k: mark(sign, F.array_join(F.slice("_w", F.lit(1), k), " ")))
    whole = lambda sign: F.array(mark(sign, F.array_join("_w", " ")))
    n = F.size("_w")
    led = [heads("=", n), whole(">")] if asking else [whole("="), F.when(n > 1, heads(">", F.greatest(n - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))]
    same = F.array(mark("~", F.array_join(F.array_sort(F.array_distinct("_w")), " ")))
    return words.select(c, F.explode(F.concat(*led, same)).alias("_k"))


FIRST = 32  # rows of a key that are looked at before its others


def full_matches(left: DataFrame, right: DataFrame, radius_m: float) -> tuple[DataFrame, DataFrame]:
    """The smallest id of ``right`` (b, blat, blon, id) that a name of ``left`` (a, lat, lon; the point may be
    null) fully matches, see ``full_keys``: within the radius as (a, lat, lon, id, distance_m), and for
    names without a point, anywhere, as (a, id).

    Names are not paired: keys are asked for once per point, and the ``FIRST`` smallest ids of a key have
    the answer, but where none of them is within the radius and the key has more."""
    asked = full_keys(left, "a", True)
    held = full_keys(right, "b", False)
    asked = settle(asked.join(held.select("_k"), "_k", "left_semi"))
    held = held.join(asked.select("_k"), "_k", "left_semi")
    there = held.join(right, "b").groupBy("_k", "blat", "blon").agg(F.min("id").alias("id"))
    there = settle(there.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy("id"))))
    alone = left.where("lat IS NULL").select("a").distinct().join(asked, "a").join(there.where("_n = 1").select("_k", "id"), "_k").groupBy("a").agg(F.min("id").alias("id"))
    spot = ["_k", "lat", "lon"]
    placed = settle(left.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)").join(asked, "a"))
    spots = settle(placed.select(*spot).distinct())
    nearest = lambda df: df.groupBy(*spot).agg(F.min(F.struct("id", "distance_m")).alias("_best"))
    early = spots.join(there.where(F.col("_n") <= FIRST), "_k").withColumn("distance_m", geo.haversine(*(F.col(c) for c in ("lat", "lon", "blat", "blon")))).where(F.col("distance_m") <= radius_m)
    early = settle(nearest(early))
    open_spots = settle(spots.join(there.where(F.col("_n") == FIRST + 1).select("_k"), "_k", "left_semi").join(early, spot, "left_anti"))
    late = radius_join(open_spots, there.where(F.col("_n") > FIRST), radius_m, ("lat", "lon"), ("blat", "blon"), inclusive=True, on=("_k",))
    best = placed.join(early.unionByName(nearest(late)), spot).groupBy("a", "lat", "lon").agg(F.min("_best").alias("_best"))
    return best.select("a", "lat", "lon", "_best.id", "_best.distance_m"), alone


def alike_pairs(left: DataFrame, right: DataFrame, ratio: float, full: bool = True) -> DataFrame:
    """Candidate pairs (a, b) of distinct texts: all whose Gestalt ratio or share of common words reaches
    ``ratio`` (0.8 or more, else keys get many), and, if ``full``, all where the shorter list of words leads
    the longer; few others.

    ``left`` has the texts a, ``right`` the texts b.  Equi-joins: a whole word list with the
    leading words of the other; rare words, of which such texts share one among so many rarest that the
    others cannot make up for them; and pieces, see ``_pieces``, of texts whose signatures allow the ratio."""
    left, right = left.select("a").where("a <> ''").distinct(), right.select("b").where("b <> ''").distinct()
    words = lambda c: F.filter(F.split(F.col(c), r"(?U)\s+", -1), lambda x: x != "")
    heads = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.size(words(c))), lambda n: F.array_join(F.slice(words(c), F.lit(1), n), " ")))
    some = lambda df, c: df.where(F.size(words(c)) > 0)
    whole = lambda df, c: some(df, c).withColumn("_k", F.array_join(words(c), " "))
    lead = whole(left, "a").join(some(right, "b").withColumn("_k", heads("b")), "_k").select("a", "b")
    led = some(left, "a").withColumn("_k", heads("a")).join(whole(right, "b"), "_k").select("a", "b")
    word = lambda df, c: df.select(c, F.explode(F.array_distinct(words(c))).alias("_k"))
    every = word(left, "a").select("_k").unionByName(word(right, "b").select("_k")).groupBy("_k").agg(F.count("*").alias("_f"))

    def rare(df: DataFrame, c: str) -> DataFrame:
        ranked = word(df, c).join(every, "_k").groupBy(c).agg(F.array_sort(F.collect_list(F.struct("_f", "_k"))).alias("_w"))
        n = F.size("_w")
        first = n - F.ceil(n * ratio - 1e-9).cast("int") + 1
        return ranked.select(c, n.alias(f"_n{c}"), F.explode(F.slice("_w", F.lit(1), first)["_k"]).alias("_k"))

    sized = F.least("_na", "_nb") >= F.greatest("_na", "_nb") * ratio - 1e-9
    shared = rare(left, "a").join(rare(right, "b"), "_k").where(sized).select("a", "b")
    # signatures and lengths are plain columns, as many pairs are told by them; a text has hundreds of keys, so few texts need many tasks too
    length = F.least("_la", "_lb") * 2 >= (F.col("_la") + F.col("_lb")) * ratio - 1e-9
    plain = lambda df, c: df.select(c, F.length(c).alias(f"_l{c}"), *(F.col("_s")[n].alias(f"_s{c}_{n}") for n in similarity.SIGNATURE))
    signed = [settle(plain(df.repartition(tasks(df)).withColumn("_s", similarity.signature(F.col(c))), c)) for df, c in ((left, "a"), (right, "b"))]
    keys = lambda df, sql: df.withColumn("_k", F.explode(F.expr(sql)))
    like = similarity.may_reach(F.col("a"), F.col("b"), "_sa_", "_sb_", ratio, F.col("_la") + F.col("_lb"))
    # a text has many keys, which the planner's size of a side leaves out: no broadcast
    pieces = keys(signed[0], _stretches(ratio)).join(keys(signed[1], _pieces(ratio)).hint("merge"), "_k").where(like & length).select("a", "b")
    found = shared.unionByName(pieces)
    return (lead.unionByName(led).unionByName(found) if full else found).distinct()


def best_prefix(df: DataFrame, slug: str, known: DataFrame, known_slug: str) -> DataFrame:
    """Each slug with the known slug it equals, or else the longest known one that it continues with a
    dash; ``matched`` and ``tier`` are null without one."""
    parts = F.split(F.col(slug), "-", -1)
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))
    slugs = df.select(slug).distinct()
    hits = slugs.withColumn("_head", F.explode(heads)).join(known.select(F.col(known_slug).alias("_head")).distinct(), "_head")
    best = hits.groupBy(slug).agg(F.max_by("_head", F.length("_head")).alias("matched"))
    return df.join(best, slug, "left").withColumn("tier", F.when(F.col("matched") == F.col(slug), "exact").when(F.col("matched").isNotNull(), "prefix"))


def fuzzy_slug(df: DataFrame, slug: str, known: DataFrame, known_slug: str, least: float = 0.85) -> DataFrame:
    """``best_prefix``, and for slugs without a match the known slug of the best Gestalt ratio from
    ``least`` on (of equal ratios the last in order), with tier ``fuzzy``."""
    found = best_prefix(df, slug, known, known_slug)
    open_slugs = found.where(F.col("matched").isNull()).select(F.col(slug).alias("b")).distinct()
    pairs = alike_pairs(known.select(F.col(known_slug).alias("a")), open_slugs, least)
    scored = pairs.withColumn("_r", similarity.ratio(F.col("a"), F.col("b"), least)).where(F.col("_r") >= least)
    best = scored.groupBy(F.col("b").alias(slug)).agg(F.max(F.struct("_r", "a"))["a"].alias("_fuzzy"))
    return found.join(best, slug, "left").withColumns({"matched": F.coalesce("matched", "_fuzzy"), "tier": F.when(F.col("_fuzzy").isNotNull(), "fuzzy").otherwise(F.col("tier"))}).drop("_fuzzy")


def with_marker(df: DataFrame, slug: str, markers: DataFrame) -> DataFrame:
    """``df`` with ``coords``, the struct of its slug's marker (slug, lat, lng; the last valid one of a
    slug counts, by its column ``pos``), null where there is none.

    A marker is valid if it has a slug and both coordinates are numbers, as numbers or as text."""
    as_number = lambda c: geo.number(F.trim(F.col(c).cast("string"))) if dict(markers.dtypes)[c] == "string" else F.col(c).cast("double")
    valid = markers.select(F.col("slug").alias(slug), as_number("lat").alias("lat"), as_number("lng").alias("lng"), "pos")
    valid = valid.where(f"`{slug}` <> '' AND lat IS NOT NULL AND lng IS NOT NULL")
    last = valid.groupBy(slug).agg(F.max_by(F.struct("lat", "lng"), "pos").alias("coords"))
    return df.join(last, slug, "left")
