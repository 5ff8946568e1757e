"""Gazetteer lookup of inflected place names, and candidates from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tindra.functions import text
from tindra.operators.order import first_per_key

# Ordered endings and what takes their place, irregular forms, words that name no place,
# and the three patterns that decide what a candidate is (after a preposition, by suffix, after a role).
ENDINGS = (
    ("firði", "fjörður"), ("fjarðar", "fjörður"), ("fjörð", "fjörður"),
    ("dalnum", "dalur"), ("dalinn", "dalur"), ("dals", "dalur"), ("dal", "dalur"),
    ("völlum", "vellir"), ("valla", "vellir"),
    ("hólum", "hólar"), ("stöðum", "staðir"), ("staða", "staðir"),
    ("bæ", "bær"), ("bæjar", "bær"), ("felli", "fell"), ("nesjum", "nes"), ("æfum", "æfi"),
    ("ða", "ði"), ("íðu", "íða"), ("sýslu", ""), ("sýsla", ""), ("landi", "land"), ("lands", "land"),
    ("inum", ""), ("inu", ""), ("nni", ""), ("anna", ""), ("unum", ""), ("um", "ar"),
    ("i", "ur"), ("i", ""), ("ar", ""), ("um", ""), ("s", ""), ("ur", ""), ("a", ""),
)
IRREGULAR = {"jökli": "Jökull", "jökul": "Jökull", "vestfjörðum": "Vestfirðir", "biskupstungum": "Biskupstungur", "öræfum": "Öræfi"}
NOT_PLACES = ("herra", "húsfreyja", "húsfrey", "séra")
AFTER_PREPOSITION = r"(?U)(?:^|[\s,;.(])(?:á|í|frá|við|hjá|undir|yfir|til|úr|að)\s+([A-ZÁÐÉÍÓÚÝÞÆÖ][a-záðéíóúýþæö]+(?:-[A-ZÁÐÉÍÓÚÝÞÆÖ]?[a-záðéíóúýþæö]+)?)"
BY_SUFFIX = r"([A-ZÁÐÉÍÓÚÝÞÆÖ][a-záðéíóúýþæö]*(?:staðir|staður|nes|fjörður|firði|dalur|dal|fell|felli|hólar|hólum|vík|ey|eyjar|vatn|vatni|á|ás|bær|bæ|bæjar|vellir|völlum|tunga|tungu|borg|garður|garði|höfn|stapi|hlíð|hlíðar|bakki|bakka|múli|múla|strönd|hraun|hrauni|sandur|sandi|jökull|jökli|fjall|fjalli|lón|lóni|ós|ósi))"
AFTER_ROLE = r"(?U)(?:prestur|bóndi|sýslumaður|biskup|djákni|séra)\s+(?:á|í|frá|við|hjá)\s+([A-ZÁÐÉÍÓÚÝÞÆÖ][a-záðéíóúýþæö]+(?:-[a-záðéíóúýþæö]+)?)"
TEXT_CHARS, LEAST_CHARS, PARTIAL_MOST = 2000, 4, 5


def candidates(df: DataFrame, key: str, title: Column, body: Column) -> DataFrame:
    """key, pos, name, found_in: distinct names (in any case) in the order of five passes - title by
    preposition and by suffix, text by preposition, role and suffix."""
    found = lambda c, pattern, where: F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: F.struct(x.alias("name"), F.lit(where).alias("found_in")))
    title, head = text.nonnull(title), F.left(text.nonnull(body), F.lit(TEXT_CHARS))
    passes = F.concat(found(title, AFTER_PREPOSITION, "title"), found(title, BY_SUFFIX, "title"), found(head, AFTER_PREPOSITION, "text"), found(head, AFTER_ROLE, "text"), found(head, BY_SUFFIX, "text"))
    rows = df.select(F.col(key), F.posexplode(passes).alias("pos", "c")).select(key, "pos", F.regexp_replace(text.strip(F.col("c.name")), "[.,;:!?]+$", "").alias("name"), "c.found_in")
    rows = rows.where((F.length("name") >= LEAST_CHARS) & ~F.lower("name").isin(*NOT_PLACES))
    return first_per_key(rows.withColumn("_low", F.lower("name")), [key, "_low"], [F.asc("pos")]).drop("_low")


def tries(name: Column) -> Column:
    """What a name is looked up as, in order: itself, its irregular nominative, then for each fitting
    ending the rewritten name and, where that ends in s, the name without it."""
    low = F.lower(name)
    steps = [F.struct(F.lit(0).alias("rule"), name.alias("form"))]
    irregular = F.lit(None).cast("string")
    for k, v in IRREGULAR.items():
        irregular = F.when(low == k, v).otherwise(irregular)
    steps.append(F.struct(F.lit(1).alias("rule"), irregular.alias("form")))
    for i, (ending, new) in enumerate(ENDINGS):
        fits = low.endswith(ending) & (F.length(name) > len(ending))
        stem = F.concat(F.left(name, F.length(name) - len(ending)), F.lit(new))
        steps.append(F.struct(F.lit(2 + 2 * i).alias("rule"), F.when(fits, stem).alias("form")))
        steps.append(F.struct(F.lit(3 + 2 * i).alias("rule"), F.when(fits & stem.endswith("s") & (F.length(stem) > 4), F.left(stem, F.length(stem) - 1)).alias("form")))
    return F.filter(F.array(*steps), lambda s: s["form"].isNotNull())


def lookup(names: DataFrame, gazetteer: DataFrame, name: str = "name") -> DataFrame:
    """Distinct names with place_id, place, lat, lon and tier of the first try that the gazetteer (id,
    place, lat, lon) knows; failing all, of the first of at most five places whose name begins with
    the name, if they share its first four letters."""
    wanted = names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
    places = first_per_key(gazetteer.select(F.col("id").alias("place_id"), "place", "lat", "lon"), ["place"], [F.asc("place_id")])
    hits = wanted.select("name", F.explode(tries(F.col("name"))).alias("t")).select("name", "t.rule", F.col("t.form").alias("place")).join(places, "place")
    exact = first_per_key(hits, ["name"], [F.asc("rule")]).withColumn("tier", F.when(F.col("rule") == 0, "direct").when(F.col("rule") == 1, "irregular").otherwise("ending"))
    cols = ["name", "place_id", "place", "lat", "lon", "tier"]
    rest = wanted.join(exact, "name", "left_anti")
    four = lambda c: F.left(F.lower(F.col(c)), F.lit(4))
    begun = rest.withColumn("_k", four("name")).join(gazetteer.select(F.col("id").alias("place_id"), "place", "lat", "lon").withColumn("_k", four("place")), "_k").where(F.lower("place").startswith(F.lower("name")))
    count = begun.groupBy("name").agg(F.count("*").alias("_n")).where(F.col("_n") <= PARTIAL_MOST)
    partial = first_per_key(begun.join(count, "name", "left_semi"), ["name"], [F.asc("place_id")]).withColumn("tier", F.lit("partial"))
    return exact.select(*cols).unionByName(partial.select(*cols))


def primary(located: DataFrame, key: str) -> DataFrame:
    """The place of each key that the title names, else the first of the text."""
    best = first_per_key(located, [key], [F.desc(F.col("found_in") == "title"), F.asc("pos")])
    return best.withColumn("confidence", F.when(F.col("found_in") == "title", "title_match").otherwise("text_match"))
