"""Secret scans with multipart credential linking.

One Arrow pass over whole texts finds the base secrets and the weak parts of a credential:
access identifiers, secret-like values and endpoints. A weak part alone means little, so it
is reported only where a complementary part stands in the same scope. That is an interval
join: the parts of all documents are rows of one table, a document is cut into cells as long
as the scope, a weak part stands in the cells that it touches and a part that may complete it
in those within the scope, and a semi-join on document and cell keeps the weak parts that
meet one. A cell holds few parts however long the document, and no pair is put out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import hinted, map_texts, slices, written

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Weak parts of a credential: (part, pattern, group). Values need a digit or upper case
#: letter mixture to count as secret-like; words of prose never match.
WEAK = [
    ("ident", re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?|tenant)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{3,})""", re.ASCII | re.IGNORECASE), 1),
    ("value", re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9A-Z+/_=-]*[a-z])(?=[0-9a-z+/_=-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII), 0),
    ("endpoint", re.compile(r"\b(?:https?|ftp|s3|jdbc|postgres(?:ql)?|mysql|redis|mongodb|amqp)://[^\s\"'<>]+", re.ASCII | re.IGNORECASE), 0),
]
BASE = ("assign", "access", "hex")
#: Order of kinds that start at the same place, and which part of a credential each can be.
ORDER = {k: i for i, k in enumerate([*BASE, "ident", "value", "endpoint"])}
#: Code points around a weak part within which a complementary part must stand.
SCOPE = 200


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Base secrets of a text: (start, end, kind), code points, end exclusive, sorted."""
    spans = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6] if ("=" in text or ":" in text) else []
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], ORDER[s[2]]))


def weak_spans(text: str) -> list[tuple[int, int, str]]:
    """Weak parts of a text, whether or not another part stands near."""
    found = []
    for part, pattern, group in WEAK:
        if part == "endpoint" and "://" not in text or part == "ident" and not ("=" in text or ":" in text):
            continue
        found += [(*m.span(group), part) for m in pattern.finditer(text)]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def parts(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append n_assign, n_access, n_hex (long), base and weak (arrays of start, end, kind) to df."""
    rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]

    def make():
        def work(texts: list[str]) -> list[list]:
            base = [base_spans(t) for t in texts]
            counts = [[sum(s[2] == kind for s in b) for b in base] for kind in BASE]
            return [*counts, list(map(rows, base)), [rows(weak_spans(t)) for t in texts]]

        return work

    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    fields = [(f"n_{k}", pa.int64(), T.LongType()) for k in BASE] + [("base", arrow, SPAN), ("weak", arrow, SPAN)]
    return map_texts(df, make, fields, text, keep)


def rank(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, i) for k, i in ORDER.items()))


def as_text(spans: Column) -> Column:
    """Spans by start and then kind, as one string."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"], rank(s["kind"]).alias("rank"), s["end"], s["kind"]))
    return F.array_join(F.transform(F.sort_array(keyed), lambda s: F.format_string("%s:%d:%d", s["kind"], s["start"], s["end"])), ",")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, start, end, kind) of the weak parts that a complementary part completes, from row
    (a number of each document), base and weak."""
    every = found.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("part")).select("row", "part.*")
    role = F.when(F.col("kind").isin("access", "ident"), "ident").when(F.col("kind").isin("assign", "hex", "value"), "secret").otherwise(F.col("kind"))
    every = every.withColumn("role", role).withColumn("is_base", F.col("kind").isin(*BASE))
    cell = lambda at: F.floor(at / scope)
    over = lambda pad: F.explode(F.sequence(cell(F.col("start") - pad), cell(F.col("end") + pad))).alias("cell")
    weak = every.where("not is_base").select("row", "start", "end", "kind", "role", over(0)).alias("w")
    near = every.select("row", "start", "end", "role", "is_base", over(scope)).alias("p")
    same = (F.col("w.row") == F.col("p.row")) & (F.col("w.cell") == F.col("p.cell"))
    within = (F.col("p.start") <= F.col("w.end") + scope) & (F.col("w.start") <= F.col("p.end") + scope)
    # What a secret completes, and what completes a secret.
    completes = (F.col("w.role") == "secret") != (F.col("p.role") == "secret")
    inside = F.col("p.is_base") & (F.col("p.start") < F.col("w.end")) & (F.col("w.start") < F.col("p.end"))
    met = weak.join(near, same & within & completes, "left_semi").select("row", "start", "end", "kind").distinct()
    covered = weak.join(near, same & inside, "left_semi").select("row", "start", "end", "kind").distinct()
    return met.join(covered, ["row", "start", "end", "kind"], "left_anti")


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of df: id_col, n_assign, n_access, n_hex (long), base_spans and spans
    (strings, kind:start:end by start and then kind).

    spans has every base span and those weak parts near which (at most `scope` code points
    between them, in the same document) a complementary part stands: for an identifier a
    secret, for a secret-like value an identifier or an endpoint, for an endpoint a secret.
    Base assignments and hex runs act as secrets, access keys as identifiers; a weak part
    that overlaps a base span is left to the base span. A null text counts as empty and has
    no spans. Repeated rows are kept apart; an empty table gives an empty one.
    """
    # Written, so that the numbers of the rows stay what they are.
    found = parts(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", ["id"])
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "secret_parts")
    extra = linked(found, scope).groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("extra"))
    out = found.join(hinted(written(extra, "secret_links"), BROADCAST_DOCS), "row", "left")
    spans = F.when(F.col("extra").isNull(), F.col("base_spans")).otherwise(as_text(F.concat("base", "extra")))
    out = out.withColumn("base_spans", as_text(F.col("base")))
    return out.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_spans", spans.alias("spans"))


#: Documents with a span whose spans are broadcast; more are joined as any table.
BROADCAST_DOCS = 200_000


def redact(df: DataFrame, mask: str = "[SECRET]", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df with every span of scan() in its text replaced by the mask; overlapping spans
    together by one. All rows and columns stay; a text without spans stays as it is."""
    # The columns go by numbers meanwhile: whatever their names, none clashes.
    names = {name: f"c{i}" for i, name in enumerate(df.columns)}
    body = names[text]
    keyed = df.toDF(*names.values()).withColumn("key", F.struct(F.col(names[id_col]).alias("id"), F.xxhash64(body).alias("hash")))
    found = scan(keyed.select("key", body), "key", body).where("spans <> ''").select("key", "spans")
    found = hinted(written(found.dropDuplicates(["key"]), "secret_spans"), BROADCAST_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [*names.values()].index(body)
        for batch in batches:
            for part in slices(batch, body):
                texts = zip(part.column(body).to_pylist(), part.column("spans").to_pylist())
                columns = [part.column(c) for c in names.values()]
                columns[at] = pa.array([masked(t, [tuple(map(int, x.split(":")[1:])) for x in s.split(",")], mask) for t, s in texts], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=[*names.values()])

    schema = T.StructType([T.StructField(names[f.name], f.dataType, f.nullable) for f in df.schema.fields])
    changed = keyed.join(found, "key").select(*names.values(), "spans").mapInArrow(run, schema)
    rest = keyed.join(found, "key", "left_anti").select(*names.values())
    return rest.union(changed).select(*(F.col(number).alias(name) for name, number in names.items()))


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """The text with its spans, sorted by start, replaced; overlapping ones together."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
