"""Quantities recorded in different units: bring volumes and unit prices to the base units of a reference list.

The unit of a row stands in its unit field, behind its volume, behind its unit price or in a last part of its text,
in any spelling. Spellings are not listed here; every spelling is a source, and what it means is learned:

* rows of one item are the same entity in several sources: an item's prices and volumes under each spelling (medians)
  are linked to those under the spelling that most of its rows have,
* all links between two sources give a robust pairwise scale (each link is snapped to the conversions of the reference
  list, and the links vote) and a robust scale and offset of the prices (from their quartiles); a pair of sources
  whose prices differ by an offset is no conversion and takes no part,
* from the sources whose name is a unit code the units spread through the graph of sources until nothing new is found.

The graph has one node per spelling and an edge per pair that items link: it is as small as the vocabulary of units,
and only its making reads the rows. All is done with aggregations and equi-joins; rows never meet in pairs, and an
item has one link per spelling.

Defined results: a row without a readable volume or with a unit that is not learned has null base values; a scale
word (rb, ribu, jt, juta) multiplies; zero and negative volumes are converted but take no part in pairs; null item
names link nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import SCALES, with_numbers
from tessera.session import attach, cut

#: Share of an unknown spelling's links that must agree, and how far a scale may be from a known one.
AGREE, SNAP = 0.5, 0.004
#: Links from which an offset can be told, and its largest share of the usual price.
TELLING, OFFSET = 12, 0.1
#: Volumes are equal within this share.
EQUAL = 0.001
#: Rows of one side of a group of pairs that a task takes.
SIDE = 5_000

_SCALE_WORD = r"(?:\s*(rb|ribu|jt|juta)(?![\p{L}]))?"
_VOLUME = r"(?i)^\s*([\d.,]*\d)(?:\s*(ribu|rb|juta|jt))?\s*(.*?)\s*$"
_PRICE = rf"(?i)^\s*(?:rp\.?\s*)?([\d.,]*\d)(?:,-)?{_SCALE_WORD}\s*(?:(?:/|per\s)\s*(.*?))?\s*$"
_TEXT = r"(?i)\|\s*(?:per\s|sat\.|satuan:|satuan\s|\(dalam\s)\s*([^|]*?)\s*$"


def spelling(text: Column) -> Column:
    """One form for spellings that differ in case, white space, raised digits or a full stop at the end."""
    t = F.translate(F.lower(F.trim(text)), "²³", "23")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"\s*\.$", "")


def _scaled(number: Column, word: Column) -> Column:
    factor = reduce(lambda c, x: c.when(word == x[0], x[1]), SCALES.items(), F.when(word == "", 1.0))
    return number * factor


def measures(items: DataFrame) -> DataFrame:
    """Add spelling, volume_read and price_read to rows with volume, unit, unit_price, total_price, original_text.

    Where one mark stands before exactly three digits, the volume could also be a thousandth; the row's total decides.
    Parts that are used often are columns of a step of their own, so that each pattern is applied once per row.
    """
    part = lambda c, p, i: F.regexp_extract(F.coalesce(c, F.lit("")), p, i)
    volume, price, total = F.col("volume"), F.col("unit_price"), F.col("total_price")
    out = items.withColumns(
        {
            **{f"_v{i}": part(volume, _VOLUME, i) for i in (1, 3)}, "_v2": F.lower(part(volume, _VOLUME, 2)),
            **{f"_p{i}": part(price, _PRICE, i) for i in (1, 3)}, "_p2": F.lower(part(price, _PRICE, 2)),
            "_t1": part(total, _PRICE, 1), "_t2": F.lower(part(total, _PRICE, 2)),
            "_last": part(F.col("original_text"), _TEXT, 1), "_bracket": F.coalesce(F.col("original_text").rlike(r"(?i)\|\s*\(dalam\s[^|]*\)\s*$"), F.lit(False)),
        }
    )
    last = F.when(F.col("_bracket"), F.regexp_replace("_last", r"\)$", "")).otherwise(F.col("_last"))
    places = [F.nullif(F.trim(p), F.lit("")) for p in (F.col("unit"), F.col("_v3"), F.col("_p3"), last)]
    out = out.withColumn("_unit", F.coalesce(*places))
    out = with_numbers(out, {"_v": F.col("_v1"), "_p": F.col("_p1"), "_t": F.col("_t1")})
    out = out.withColumns({"spelling": spelling(F.col("_unit")), "_v": _scaled(F.col("_v"), F.col("_v2")), "_p": _scaled(F.col("_p"), F.col("_p2")), "_t": _scaled(F.col("_t"), F.col("_t2"))})
    near = lambda a, b: F.abs(a - b) <= 0.01 * b
    either = F.col("_v1").rlike(r"^[1-9]\d{0,2}[.,]\d{3}$")
    small = either & near(F.col("_v") / 1000 * F.col("_p"), F.col("_t")) & ~near(F.col("_v") * F.col("_p"), F.col("_t"))
    out = out.withColumns({"volume_read": F.when(small, F.col("_v") / 1000).otherwise(F.col("_v")), "price_read": F.col("_p")})
    return out.select(*items.columns, "spelling", "volume_read", "price_read")


def conversions(unit_ref: DataFrame) -> DataFrame:
    """(scale, near): the scales between any two units of one base, each with the cells of a grid that lie around it."""
    ref = unit_ref.select("base_unit", "factor").distinct()
    scales = ref.join(ref.select("base_unit", F.col("factor").alias("other")), "base_unit").select(F.round(F.col("factor") / F.col("other"), 12).alias("scale")).distinct()
    at = F.floor(F.ln("scale") / SNAP)
    return scales.select("scale", F.explode(F.array(at - 1, at, at + 1)).alias("near"))


def _fits(scale: Column, known: Column) -> Column:
    return F.coalesce(F.abs(F.ln(scale / known)) < SNAP, F.lit(False))


def source_graph(measured: DataFrame, unit_ref: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of the graph of spellings.

    An edge (source, hub, scale, any, both, links, price_scale, price_offset) says that ``any`` of the ``links`` items
    that link two spellings have prices or volumes (``both``: prices and volumes) in a conversion's scale: one unit of
    the source is ``scale`` units of the hub. A node (spelling, n) has the number of its rows.
    """
    median = lambda c: F.percentile_approx(c, 0.5, 1000)
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    seen = measured.filter("spelling is not null").groupBy("item_per_rab", "spelling")
    shown = cut(seen.agg(F.count("*").alias("n"), median(positive("price_read")).alias("price"), median(positive("volume_read")).alias("volume")))
    linking = shown.filter("item_per_rab is not null and (price is not null or volume is not null)")
    hub = linking.groupBy("item_per_rab").agg(F.max(F.struct("n", "spelling", "price", "volume")).alias("h"))
    both = linking.join(hub, "item_per_rab").filter("spelling <> h.spelling")
    links = both.select(
        F.col("spelling").alias("source"), F.col("h.spelling").alias("hub"), "price", F.col("h.price").alias("hub_price"),
        (F.col("price") / F.col("h.price")).alias("by_price"), (F.col("h.volume") / F.col("volume")).alias("by_volume"),
    )
    # Snap each link to the conversions: a few hundred, as the reference list is fixed.
    known = F.broadcast(cut(conversions(unit_ref)))
    cell = lambda c: F.floor(F.ln(c) / SNAP)
    tried = links.select("source", "hub", "by_price", "by_volume", F.explode(F.array_distinct(F.array(cell(F.col("by_price")), cell(F.col("by_volume"))))).alias("near"))
    tried = tried.join(known, "near").withColumns({"p": _fits(F.col("by_price"), F.col("scale")), "v": _fits(F.col("by_volume"), F.col("scale"))})
    # A link that fits one scale by its price and by its volume may meet it in two cells: it counts in that of its price.
    tried = tried.filter((F.col("p") & (cell(F.col("by_price")) == F.col("near"))) | (F.col("v") & ~F.col("p")))
    votes = tried.groupBy("source", "hub", "scale").agg(F.count("*").alias("any"), F.count_if(F.col("p") & F.col("v")).alias("both"))
    quartiles = lambda c: F.percentile_approx(F.when(F.col("price").isNotNull() & F.col("hub_price").isNotNull(), F.col(c)), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000))
    pairs = links.groupBy("source", "hub").agg(F.count("*").alias("links"), F.count("by_price").alias("priced"), quartiles("price").alias("x"), quartiles("hub_price").alias("y"))
    spread = F.col("x")[2] - F.col("x")[0]
    slope = F.when(spread > 0, (F.col("y")[2] - F.col("y")[0]) / spread)
    pairs = pairs.withColumn("slope", slope).select("source", "hub", "links", "priced", F.col("slope").alias("price_scale"), (F.col("y")[1] - F.col("slope") * F.col("x")[1]).alias("price_offset"), F.col("y")[1].alias("usual"))
    shifted = (F.col("priced") >= TELLING) & (F.abs("price_offset") > OFFSET * F.col("usual"))
    pairs = pairs.filter(~F.coalesce(shifted, F.lit(False))).drop("priced", "usual")
    edges = cut(votes.join(pairs, ["source", "hub"]))
    return edges, cut(shown.groupBy("spelling").agg(F.sum("n").alias("n")))


def learn_spellings(measured: DataFrame, unit_ref: DataFrame) -> DataFrame:
    """(spelling, n, unit_code, base_unit, factor) of every spelling that the items explain, with its number of rows."""
    ref = cut(unit_ref.select("unit_code", "base_unit", "factor").distinct())
    edges, nodes = source_graph(measured, ref)
    back = edges.select(F.col("hub").alias("source"), F.col("source").alias("hub"), (1 / F.col("scale")).alias("scale"), "any", "both", "links")
    edges = cut(edges.select("source", "hub", "scale", "any", "both", "links").unionByName(back))
    known = cut(ref.select(spelling(F.col("unit_code")).alias("spelling"), "unit_code", "base_unit", "factor"))
    while True:
        # What a source would be if each known neighbour is right. Its links count once per neighbour, whatever they say.
        beside = edges.join(known.select(F.col("spelling").alias("source"), "base_unit", F.col("factor").alias("of")), "source").join(known.select(F.col("spelling").alias("hub")), "hub", "left_anti")
        asked = beside.select("hub", "source", "base_unit", "links").distinct().groupBy("hub", "base_unit").agg(F.sum("links").alias("links"))
        # One unit of the source is ``scale`` of the hub's: the hub's factor is the source's over the scale.
        said = beside.withColumn("is", F.col("of") / F.col("scale")).join(ref, "base_unit").filter(F.abs(F.ln(F.col("is") / F.col("factor"))) < SNAP)
        votes = said.groupBy("hub", "unit_code", "base_unit", "factor").agg(F.sum("any").alias("any"), F.sum("both").alias("both")).join(asked, ["hub", "base_unit"])
        best = votes.groupBy("hub").agg(F.max(F.struct("any", "both", "links", "unit_code", "base_unit", "factor")).alias("b"))
        most = asked.groupBy("hub").agg(F.max("links").alias("most"))
        agreed = (F.col("b.any") > AGREE * F.col("b.links")) & (F.col("b.links") >= 0.5 * F.col("most")) & ((F.col("b.any") >= 2) | (F.col("b.both") >= 1))
        more = best.join(most, "hub").filter(agreed).select(F.col("hub").alias("spelling"), "b.unit_code", "b.base_unit", "b.factor")
        grown = cut(known.unionByName(more))
        if grown.count() == known.count():
            return nodes.join(known, "spelling")
        known = grown


def convert(items: DataFrame, unit_ref: DataFrame) -> DataFrame:
    """Items with unit_code, base_unit, volume_base and unit_price_base (null where not known)."""
    measured = cut(measures(items))
    known = learn_spellings(measured, unit_ref).select("spelling", "n", F.struct("unit_code", "base_unit", "factor").alias("is"))
    out = attach(measured, cut(known), ["spelling"], "is", keep=True)
    out = out.select(*measured.columns, "is.unit_code", "is.base_unit", "is.factor")
    return out.withColumns({"volume_base": F.col("volume_read") * F.col("factor"), "unit_price_base": F.col("price_read") / F.col("factor")})


def same_quantity(converted: DataFrame) -> DataFrame:
    """(item_id_a, item_id_b): one item, equal volumes in the base unit, written in two different units.

    Two grids of cells, one shifted by half a cell, so that equal volumes share a cell of one of them. Only rows of
    cells with several units go on, and rows meet only rows of another unit: a group of rows in one unit, however
    large, makes no candidates. The rows of one side of a large group are spread over tasks, SIDE rows each.
    """
    rows = converted.filter("volume_base > 0 and item_per_rab is not null").select("item_id", "item_per_rab", "base_unit", "unit_code", "volume_base")
    at = F.ln("volume_base") / (2 * F.log1p(F.lit(EQUAL)))
    rows = cut(rows).withColumn("cell", F.explode(F.array(2 * F.floor(at), 2 * F.floor(at + 0.5) + 1)))
    rows = rows.withColumns({"key": F.xxhash64("item_per_rab", "base_unit", "cell"), "unit": F.xxhash64("unit_code")}).drop("cell")
    several = rows.groupBy("key").agg(F.min("unit").alias("low"), F.max("unit").alias("high"), F.count("*").alias("n")).filter("low < high")
    rows = cut(attach(rows, several.withColumn("shared", F.lit(True)), ["key"], "shared").drop("shared"))
    sizes = rows.groupBy("key", "unit_code").agg(F.count("*").alias("n"))
    other = sizes.select("key", F.col("unit_code").alias("w"), F.col("n").alias("m"))
    meeting = cut(sizes.withColumnRenamed("unit_code", "u").join(other, "key").filter("u < w").withColumn("tasks", F.ceil(F.col("n") / SIDE).cast("int")))
    left = rows.select("key", F.col("unit_code").alias("u"), F.col("item_id").alias("x"), F.col("item_per_rab").alias("name"), F.col("volume_base").alias("p"))
    left = left.join(meeting, ["key", "u"]).withColumn("task", F.pmod(F.xxhash64("x"), F.col("tasks")).cast("int")).drop("n", "m", "tasks")
    right = rows.select("key", F.col("unit_code").alias("w"), F.col("item_id").alias("y"), F.col("item_per_rab").alias("name"), F.col("volume_base").alias("q"))
    right = right.join(meeting, ["key", "w"]).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("n", "m", "tasks")
    pairs = left.join(right, ["key", "u", "w", "task", "name"]).filter(F.abs(F.col("p") - F.col("q")) <= EQUAL * F.greatest("p", "q"))
    return pairs.select(F.least("x", "y").alias("item_id_a"), F.greatest("x", "y").alias("item_id_b")).filter("item_id_a < item_id_b").distinct()
