"""Personal data: base patterns, and sanitisation by what terms disclose.

Base spans (addresses, numbers) are found by patterns. Each distinct base value is a
protected entity. The terms of every document that holds an entity, outside its base spans,
are counted over the whole corpus: with df documents holding a term, df(e) an entity, and
joint both, the pointwise mutual information log2(N joint / (df df(e))) says how much the
term tells of the entity, whose whole information is log2(N / df(e)). At low counts joint /
df is taken with SMOOTHING documents more that hold the term and the entity as often as any
document does. A term that tells nearly all of it would give the entity away after masking,
so its occurrences become spans too: removed when it tells everything, generalised otherwise.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import hinted, written
from pulsegrid.llm.quality_rules import let

#: Base patterns. They match as the plain ones of the contract do, leftmost and without
#: overlap: a run is entered at its first character only and never given back, and the
#: parts of a card are bounded, so no text makes them slow or deep.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: A term is a run of letters.
LETTERS = r"\p{L}+"
#: Documents added to a term's, in which the entity is as frequent as in the corpus.
SMOOTHING = 0.25
#: Share of an entity's information at which a term discloses it.
DISCLOSURE = 0.9
#: Rows of term and document tables that are broadcast; with more they are joined as any.
BROADCAST_TERMS = 200_000
#: Share of the documents from which a term is common. With d distinct terms in a document on
#: average there are d / FREQUENT common terms at most, whatever the size of the corpus.
FREQUENT = 0.001
#: Matches whose places are summed up in one go.
CHUNK = 128


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn check."""

    def total(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            x = F.substring(d, -i, F.lit(1)).cast("int")
            twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
            return acc + F.when(i % 2 == 0, twice).otherwise(x)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)

    return let(digits(value), lambda d: total(d) % 10 == 0)


def located(text: Column, pattern: str, keep, limit_to: Column | None = None) -> Column:
    """Array of (start, end, value) of a pattern's matches that keep() holds for.

    The text between matches comes from a split and the matches from an extraction; their
    lengths add up to the places. The sums run over CHUNK matches at a time and then over the
    chunks, since a sum that grows an array copies it at each step.
    """
    kind = "array<struct<start:int,end:int,value:string>>"
    none = F.array().cast(kind)

    def summed(chunk: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("found"))

        def step(acc: Column, piece: Column) -> Column:
            begin = acc["at"] + piece["gap"]
            end = begin + F.length(piece["value"])
            span = F.array(F.struct(begin.alias("start"), end.alias("end"), piece["value"].alias("value")))
            return F.struct(end.alias("at"), F.when(keep(piece["value"]), F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

        return F.aggregate(chunk, start, step)

    def shifted(chunks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        ends = lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))
        moved = lambda s, at: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["value"].alias("value"))
        starts = F.aggregate(chunks, start, ends, lambda acc: acc["starts"])
        return F.flatten(F.zip_with(chunks, starts, lambda c, at: F.transform(c["found"], lambda s: moved(s, at))))

    def placed(both: Column) -> Column:
        pieces = F.zip_with(both["gaps"], both["matches"], lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value")))
        chunks = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 1, F.lit(CHUNK)), lambda i: summed(F.slice(p, i, F.least(F.lit(CHUNK), F.size(p) - i))))
        return F.when(F.size(both["matches"]) == 0, none).otherwise(let(let(pieces, chunks), shifted))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = let(F.struct(F.split(text, pattern, -1).alias("gaps"), matches.alias("matches")), placed)
    return found if limit_to is None else F.when(limit_to, found).otherwise(none)


def base_spans(text: Column) -> Column:
    """Sorted array of (start, rank, end, kind, value); rank is the place of kind in KINDS."""
    digit = F.rlike(text, F.lit("[0-9]"))
    ip = lambda v: F.rlike(v, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    phone = lambda v: F.length(digits(v)).between(9, 15)
    found = (
        located(text, EMAIL, lambda v: F.lit(True), F.contains(text, F.lit("@"))),
        located(text, IP, ip, digit),
        located(text, CARD, luhn, digit),
        located(text, PHONE, phone, F.contains(text, F.lit("+"))),
    )

    def named(spans: Column, rank: int) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(KINDS[rank]).alias("kind"), s["value"].alias("value")),
        )

    return F.sort_array(F.concat(*(named(spans, rank) for rank, spans in enumerate(found))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.format_string("%s:%d:%d", s["kind"], s["start"], s["end"])), ",")


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0)), F.lower))


def disclosing(documents: DataFrame, near: DataFrame, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """(terms that disclose an entity, documents that hold them).

    documents has key (struct) and body (string); near has row (a number of its own for every
    row), base and terms of the documents with a base span. The first result has term and
    told, the largest share of an entity's information that it tells; the second key and terms.

    Terms are split by FREQUENT into common ones, of which any corpus has few, so that they are
    broadcast, and the rest, which few documents hold: only their rows are shuffled.
    """
    # Counts are of rows; within a row an entity, or a pair, counts once.
    n = documents.agg(F.count("*").alias("n"))
    each = documents.select("key", F.explode(terms_of(F.col("body"))).alias("term"))
    counts = written(each.groupBy("term").agg(F.count("*").alias("df_term")).crossJoin(F.broadcast(n)), "pii_counts")  # n: one row
    common = F.col("df_term") >= FREQUENT * F.col("n")
    often_used = hinted(written(counts.where(common), "pii_common"), BROADCAST_TERMS)
    rare = counts.where(~common)

    named = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))
    rows = near.select("row", F.explode(named).alias("entity"), "terms")
    places = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"places{k}") for k in (1, 2)]
    entities = rows.groupBy("entity").agg(F.count("*").alias("df_entity"), *places)
    # What stands in the same rows is told of by the same terms: one stands for all of them.
    entities = written(entities.groupBy("df_entity", "places1", "places2").agg(F.min("entity").alias("entity")).select("entity", "df_entity"), "pii_entities")

    def share(joint: Column, df_term: Column, smoothing: float = 0.0) -> Column:
        often = F.col("df_entity") / F.col("n")
        seen = joint * F.col("n") / (df_term * F.col("df_entity"))
        if smoothing:
            seen = (joint + smoothing * often) / ((df_term + smoothing) * often)
        return F.when(often < 1, F.log2(seen) / F.log2(1 / often))

    # An entity and a term stand together in at most as many rows as either. A pair that tells
    # too little even so is out before it is counted.
    term = F.col("df_term")
    possible = share(F.least("df_entity", term), term, SMOOTHING) >= disclosure
    pair = ("entity", "term", "df_entity", "df_term", "n")
    # Common terms: they can only tell of entities that are about as common.
    least = FREQUENT * F.col("n")
    wide = entities.crossJoin(F.broadcast(n)).where((F.col("df_entity") >= least) | (share(F.col("df_entity"), least) >= disclosure))
    wide = hinted(written(wide.drop("n"), "pii_wide"), BROADCAST_TERMS)
    among = rows.join(wide, "entity").select("entity", "df_entity", F.explode("terms").alias("term")).join(often_used, "term").select(*pair)
    # The rest: each row of a term meets the row's entities.
    side = near.select("row", F.explode("terms").alias("term")).join(often_used.select("term"), "term", "left_anti").join(rare, "term")
    side = side.join(rows.select("row", "entity").join(hinted(entities, BROADCAST_TERMS), "entity"), "row").select(*pair)
    joint = among.where(possible).union(side.where(possible)).groupBy(*pair).agg(F.count("*").alias("joint"))
    tell = joint.where(share(F.col("joint"), term, SMOOTHING) >= disclosure).withColumn("told", share(F.col("joint"), term))
    terms = written(tell.groupBy("term", common.alias("common")).agg(F.max("told").alias("told")), "pii_disclosing")

    holding = each.join(often_used.select("term"), "term", "left_anti").join(hinted(terms.where("not common"), BROADCAST_TERMS), "term")
    if terms.where("common").head(1):
        holding = holding.union(each.join(F.broadcast(terms.where("common")), "term"))
    return terms, written(holding.groupBy("key").agg(F.collect_set(F.struct("term", "told")).alias("terms")), "pii_held")


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", with_text: bool = False, **limits) -> DataFrame:
    """One row per row of df: id_col, n_email, n_ip, n_card, n_phone (long), base (array of
    base spans), spans (array of all spans by start and kind, each with start, end, kind
    and value) and, with_text, sanitised (the text with every span masked).

    Code points, end exclusive. A term span never overlaps a base span. A null text counts
    as empty and has no spans. Rows with equal id and text have equal results; null ids and
    repeated rows are kept; an empty table gives an empty one.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(body).alias("text"))
    documents = df.select(key.alias("key"), body.alias("body"))
    # explode of one element: what reads the spans cannot be merged with their making.
    based = documents.withColumn("base", F.explode(F.array(base_spans(F.col("body")))))
    # Of the base spans only addresses hold letters.
    terms = F.when(F.size("base") > 0, terms_of(F.regexp_replace("body", EMAIL, " ")))
    found = written(based.select("key", "base", terms.alias("terms"), F.monotonically_increasing_id().alias("row")), "pii_base")
    _, held = disclosing(documents, found.where("terms is not null"), **limits)
    found = found.drop("terms", "row")

    terms = F.transform("terms", lambda t: t["term"])
    # Addresses are matched as well and not kept, so terms inside them are passed over.
    placed = located(F.col("body"), f"(?:{EMAIL})|{LETTERS}", lambda v: F.array_contains("names", F.lower(v)))
    marked = documents.distinct() if with_text else documents
    marked = marked.join(hinted(held.withColumn("names", terms).drop("terms"), BROADCAST_TERMS), "key")
    marked = marked.select("key", placed.alias("placed"), F.rlike("body", F.lit(f"[^\\x00-\\x7F][{LOCAL}]*+@")).alias("adjoins")).dropDuplicates(["key"])
    out = found.join(marked, "key", "left")

    def free(s: Column) -> Column:
        # Only where a letter of another alphabet adjoins an address can a term reach into it.
        return ~F.col("adjoins") | ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    extra = F.transform(
        F.filter(F.coalesce("placed", F.array().cast("array<struct<start:int,end:int,value:string>>")), free),
        lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), s["end"].alias("end"), F.lit(TERM).alias("kind"), s["value"].alias("value")),
    )
    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")

    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    out = out.select("key", *counts, "base", F.sort_array(F.concat("base", extra)).alias("spans"))
    if not with_text:
        return out.select(F.col("key.id").alias(id_col), *(f"n_{k}" for k in KINDS), "base", "spans")
    whole = F.map_from_entries(F.transform("terms", lambda t: F.struct(t["term"], t["told"])))
    told = held.select("key", whole.alias("told"))
    out = out.join(documents.dropDuplicates(["key"]), "key").join(told, "key", "left")
    return out.select(F.col("key.id").alias(id_col), *(f"n_{k}" for k in KINDS), "base", "spans", masked(F.col("body"), F.col("spans"), F.col("told")).alias("sanitised"))


def masked(body: Column, spans: Column, told: Column) -> Column:
    """The text with base spans as [KIND], terms that tell everything removed and other
    disclosing terms generalised to [TERM]; of overlapping spans the first is masked."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(body, acc["at"] + 1, s["start"] - acc["at"])
        everything = F.coalesce(F.element_at(told, F.lower(s["value"])) >= 1.0, F.lit(False))
        mask = F.when((s["kind"] == TERM) & everything, "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        taken = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, mask).alias("out"))
        overlapping = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], taken).otherwise(overlapping)

    done = lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body)))
    return F.aggregate(spans, start, step, done)
