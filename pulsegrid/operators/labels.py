"""Labels of segments: aliases, corrections, risk classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rhythm aliases, classes and decision limits (fixed values).
ALIASES = {"(VFIB": "(VF"}
COARSE_MV = 0.2
RAPID_BPM = 180
ASYSTOLE_MV = 0.15


def canonical(rhythm: Column, aliases: dict[str, str] = ALIASES) -> Column:
    out = rhythm
    for name, known in aliases.items():
        out = F.when(rhythm == name, known).otherwise(out)
    return out


def monitored_rhythm(note: Column) -> Column:
    """Rhythm of a free-text note: ventricular tachycardia or fibrillation, else null."""
    text = F.lower(F.trim(note))
    vt = (text == "vt") | text.startswith("ventricular tac")
    return F.when(vt, "(VT").when((text == "vf") | text.startswith("ventricular fib"), "(VF")


def risk_class(rhythm: Column, amplitude: Column, rate: Column) -> Column:
    """0 no shock, 1 shock, 2 between: coarse fibrillation and rapid tachycardia or flutter
    are shocked; without beats flutter counts as rapid and tachycardia as slow."""
    rapid = (rate >= RAPID_BPM) | ((rate <= 0) & (rhythm == "(VFL"))
    return (
        F.when(rhythm == "(VF", F.when(amplitude > COARSE_MV, 1).otherwise(2))
        .when(rhythm.isin("(VT", "(VFL"), F.when(rapid, 1).otherwise(2))
        .otherwise(0)
    )


def risk_name(rhythm: Column, amplitude: Column, rate: Column) -> Column:
    """Rhythm with its detail: coarse, fine, rapid or slow."""
    kind = risk_class(rhythm, amplitude, rate)
    fib = rhythm == "(VF"
    detail = F.when(fib & (kind == 1), ":coarse").when(fib, ":fine").when(kind == 1, ":rapid").when(kind == 2, ":slow").otherwise("")
    return F.concat(rhythm, detail)


def correct(segments: DataFrame, corrections: DataFrame, shockable_to_excluded: bool = False) -> DataFrame:
    """Segments with the rhythm of their correction, if one by (record, begin) says other
    than C (confirmed); X excludes. With shockable_to_excluded, corrections to VF or VT
    exclude as well."""
    fixed = corrections.select("record", "begin", "label")
    changed = F.col("label").isNotNull() & (F.col("label") != "C")
    to = F.when(F.col("label").isin("(VF", "(VT"), "X").otherwise(F.col("label")) if shockable_to_excluded else F.col("label")
    return segments.join(fixed, ["record", "begin"], "left").withColumn("rhythm", F.when(changed, to).otherwise(F.col("rhythm"))).drop("label")


def keep_rhythms(df: DataFrame, excluded: list[str]) -> DataFrame:
    return df.where(~F.col("rhythm").isin("X", *excluded))


def label(rhythm: Column, method: str, amplitude: Column | None = None, rate: Column | None = None) -> Column:
    """Class of a rhythm by one of the methods aha, 0, 1, 2 (widening sets of shocked
    rhythms) and 3 (fibrillation, tachycardia or flutter, others). Under aha flutter is
    shocked whatever its rate, and tachycardia without a rate is not."""
    if method == "aha":
        vt = F.when(rate >= RAPID_BPM, 1).when(rate > 0, 2).otherwise(0)
        return F.when(rhythm == "(VF", F.when(amplitude > COARSE_MV, 1).otherwise(2)).when(rhythm == "(VT", vt).when(rhythm == "(VFL", 1).otherwise(0)
    if method == "3":
        return F.when(rhythm == "(VF", 1).when(rhythm.isin("(VT", "(VFL"), 2).otherwise(0)
    shocked = {"0": ["(VF"], "1": ["(VF", "(VFL"], "2": ["(VF", "(VFL", "(VT"]}[method]
    return rhythm.isin(*shocked).cast("int")
