"""Types of beats after matching: the dominant shape, a table of rules, and second thoughts.

A beat has a record, its place i, the interval rr before it, the shape it matched (null: none),
the class of its rhythm (N, V or Q), a width, a distance to the dominant shape (likeness) and
measures of noise. What a step looks back or ahead at are windows over chunks with a halo;
what it remembers without end is a finite automaton (scan.automaton).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators.scan import automaton, placed, with_halo, written

#: Beats that decide on the dominant shape, and irregular ones among them that spoil the rhythm.
MONITORED, IRREGULAR = 180, 60
#: Widths (hundredths of a second) and other bounds of the rules (fixed values).
NORMAL_WIDTH = 13
NARROW, WIDE, WIDE_BREAK, WIDER, MUCH_WIDER, MODERATE, HARDLY_WIDER = 9, 11, 14, 4, 6, 10, 2
MUSCLE_NOISE, MOTION_NOISE, BASE_SHIFT, LOUD_NOISE = 45, 14, 100, 75
SHAPES = 8
SIZE = 4096


def count_of(values: Column, wanted: Column) -> Column:
    return F.size(F.filter(values, lambda v: v == wanted))


def commonest(values: Column) -> Column:
    """The commonest value of an array, the smallest of equals; null if there is none."""
    counted = F.transform(F.array_distinct(values), lambda v: F.struct(count_of(values, v).alias("n"), (-v).alias("minus")))
    return -F.array_max(counted)["minus"]


def with_dominant(beats: DataFrame, size: int = SIZE) -> DataFrame:
    """beats with dominant (shape) and steady (boolean), as of each beat.

    Of the last MONITORED beats a beat counts as normal if its rhythm is normal, it is narrow
    and the beat before has its shape. The shape with most normal beats is dominant, unless it has none, half of its beats or fewer
    are normal, or some shape has twice its beats: then the commonest shape is. The rhythm is steady
    while at most IRREGULAR of the beats with a shape have an unknown one."""
    dealt = with_halo(beats.withColumn("_shape", F.col("shape").cast("long")), MONITORED, 0, size)
    by = W.partitionBy("record", "chunk").orderBy("i")
    normal = F.coalesce((F.col("class") == "N") & (F.col("width") < NORMAL_WIDTH) & (F.lag("_shape").over(by) == F.col("_shape")), F.lit(False))
    dealt = dealt.withColumn("_normal", F.when(normal, F.col("_shape")))
    last = by.rowsBetween(1 - MONITORED, 0)
    seen = dealt.withColumn("_shapes", F.collect_list("_shape").over(last)).withColumn("_normals", F.collect_list("_normal").over(last))
    seen = seen.withColumn("_odd", F.count_if((F.col("class") == "Q") & F.col("_shape").isNotNull()).over(last)).where("own")
    seen = seen.withColumn("_best", commonest(F.col("_normals"))).withColumn("_most", commonest(F.col("_shapes")))
    n, m, k = count_of(F.col("_shapes"), F.col("_best")), count_of(F.col("_shapes"), F.col("_most")), count_of(F.col("_normals"), F.col("_best"))
    doubtful = F.col("_best").isNull() | (m >= 2 * n) | (n >= 2 * k)
    chosen = F.when(doubtful, F.col("_most")).otherwise(F.col("_best"))
    return seen.select(*beats.columns, chosen.alias("dominant"), (F.col("_odd") <= IRREGULAR).alias("steady"))


def rules(c: dict[str, Column]) -> list[tuple[int, Column, str]]:
    """(number, when, class) in order; the first that holds decides. A rule whose columns are
    null does not hold."""
    early, odd, regular = c["class"] == "V", c["class"] == "Q", c["class"] == "N"
    wider = c["width"] - c["dominant_width"]
    return [
        (1, c["dominant"].isNull(), "Q"),
        (2, c["dominant_even"] & early & (c["likeness"] > 1.0) & c["steady"], "V"),
        (3, c["width"] < NARROW, "N"),
        (5, c["shape"].isNull() & ~early, "N"),
        (6, (c["shapes"] == SHAPES) & (c["seen"] == 1) & odd, "N"),
        (7, (c["likeness"] < 1.2) & regular, "N"),
        (8, (c["likeness"] < 1.5) & (c["post_rhythm"] == "N"), "N"),
        (9, (c["likeness"] < 2.0) & ~early & c["dominant_uneven"], "N"),
        (10, (c["likeness"] > 2.5) & (c["seen"] >= 3) & (c["post_rhythm"] == "V") & c["steady"], "V"),
        (
            11,
            (c["width"] >= WIDE) & (((wider >= WIDER) & (c["dominant_width"] < WIDE_BREAK)) | (wider >= MUCH_WIDER)) & (c["muscle"] < MUSCLE_NOISE)
            & (c["motion"] < MOTION_NOISE) & (c["base"] < BASE_SHIFT) & c["shape"].isNotNull() & (c["seen"] > 1),
            "V",
        ),
        (12, early & c["steady"], "V"),
        (14, regular & c["steady"], "N"),
        (15, (wider > 0) & (c["likeness"] > 3.5) & (c["width"] >= MODERATE), "V"),
        (16, c["width"] < MODERATE, "N"),
        (17, wider < HARDLY_WIDER, "N"),
        (18, c["likeness"] < 1.5, "N"),
        (19, c["muscle"] > LOUD_NOISE, "N"),
        (20, F.lit(True), "V"),
    ]


RULE_COLUMNS = ("class", "width", "dominant_width", "dominant", "dominant_even", "dominant_uneven", "likeness", "steady", "shape", "shapes", "seen", "post_rhythm", "muscle", "motion", "base")


def by_rules(beats: DataFrame) -> DataFrame:
    """beats with rule (the number of the one that decided) and rule_class."""
    table = rules({c: F.col(c) for c in RULE_COLUMNS})
    number, name = F.lit(None).cast("int"), F.lit(None).cast("string")
    for k, when, what in reversed(table):
        number, name = F.when(when, k).otherwise(number), F.when(when, what).otherwise(name)
    return beats.withColumn("rule", number).withColumn("rule_class", name)


#: States of second thoughts: of a shape's last eight beats, which were premature (lowest bit: the last).
HISTORY = 256


def _moves() -> list[list[int]]:
    """By symbol: no sign, a sign that takes a history to tell, a sign by itself."""
    pushed = lambda s, bit: s << 1 & HISTORY - 1 | bit
    tells = lambda s: int(s & 3 == 3 or s.bit_count() >= 6)
    return [[pushed(s, 0) for s in range(HISTORY)], [pushed(s, tells(s)) for s in range(HISTORY)], [pushed(s, 1) for s in range(HISTORY)]]


def second_thoughts(beats: DataFrame, size: int = SIZE) -> DataFrame:
    """(record, i, shape, post_class, post_rhythm, shape_class) of every beat that has a shape, a beat behind it
    and two before: beats have (record, i, rr, shape, class, likeness, dominant).

    A beat of another shape between two of the dominant one (as of the beat behind) is premature if
    it is early by an eighth of the last interval between two beats of one shape, and the pause behind
    is longer by as much; if by a sixteenth, its shape's history must tell (the last two, or six of the
    last eight, were); and any beat between two dominant ones that is far from the dominant shape is. shape_class is V
    once three of the shape's last four beats or six of the last eight are premature."""
    dealt = with_halo(beats.withColumn("_s", F.coalesce(F.col("shape"), F.lit(-1)).cast("long")), 6, 1, size)
    by = W.partitionBy("record", "chunk").orderBy("i")
    back = lambda c, k: F.lag(c, k).over(by)
    pairs = [F.when(back("_s", k) == back("_s", k + 1), back("rr", k)) for k in range(1, 6)]
    dealt = dealt.withColumn("_usual", F.coalesce(*pairs, F.lit(0))).withColumn("_before", back("_s", 1))
    for name, of in (("_next", "_s"), ("_pause", "rr"), ("_dom", "dominant")):
        dealt = dealt.withColumn(name, F.lead(of).over(by))
    dealt = dealt.where(F.col("own") & F.col("shape").isNotNull() & (F.col("i") >= 2) & F.col("_next").isNotNull())
    less = lambda c, by: F.col(c) - F.shiftright(c, by)
    between = (F.col("_next") == F.col("_dom")) & (F.col("_before") == F.col("_dom"))
    other = between & (F.col("_s") != F.col("_dom"))
    early = other & (less("_usual", 3) >= F.col("rr")) & (less("_pause", 3) >= F.col("_usual"))
    far = between & (F.when(F.col("i") > 2, F.col("likeness")) > 2.5)
    slightly = other & (less("_usual", 4) > F.col("rr")) & (F.col("_usual") + F.shiftright("_usual", 4) < F.col("_pause"))
    symbol = F.when(early | far, 2).when(slightly, 1).otherwise(0)
    rhythm = F.when((less("_usual", 3) > F.col("rr")) & (less("_pause", 3) > F.col("_usual")), "V").otherwise(F.when(F.col("i") > 2, F.col("class")).otherwise("Q"))
    signs = dealt.select(F.to_json(F.struct("record", "shape")).alias("series"), "record", "i", "shape", symbol.alias("symbol"), rhythm.alias("post_rhythm"))
    signs = written(placed(signs.where("record is not null"), "series", "i", name="place"), "signs")
    states = automaton(signs.select(F.col("series").alias("record"), F.col("place").alias("i"), "symbol"), _moves(), 0, size)
    both = signs.join(states.select(F.col("record").alias("series"), F.col("i").alias("place"), "state"), ["series", "place"])
    behind = F.get(F.get(F.lit(_moves()), F.col("symbol")), F.col("state"))
    both = both.withColumn("_behind", behind)
    often = (F.bit_count(F.col("_behind").bitwiseAND(15)) >= 3) | (F.bit_count("_behind") >= 6)
    return both.select(
        "record", "i", "shape", F.when(F.col("_behind") % 2 == 1, "V").otherwise("Q").alias("post_class"), "post_rhythm", F.when(often, "V").otherwise("Q").alias("shape_class")
    )
