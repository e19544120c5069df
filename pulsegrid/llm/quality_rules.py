"""Quality rules with line-first cleaning.

Every line of a text is judged on its own: symbol runs and shouting (punctuation), menus and
short unfinished fragments in series (navigation), and stock phrases (boilerplate). Failing
lines are removed, and a document that loses too much of its text is rejected as a whole.
The base counts of a text are computed beside that.

DataFrame functions only. A value that a lambda below uses again and again is bound as a
lambda variable first (let): a plain column expression would be computed anew each time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"
#: Stock phrases, lower case (fixed values).
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "licensed under", "lorem ipsum",
    "privacy policy", "sign up for our newsletter", "terms of service", "terms of use",
)
#: A line fails with more than this share of symbols among its characters.
LINE_SYMBOLS = 0.06
#: A line of at least this many words that has no lower-case letter is shouting.
SHOUTED_WORDS = 3
#: A line of at least so many parts between separators, each of at most so many characters, is
#: a menu.
SEPARATORS, MENU_PARTS, PART_CHARS = "[|»›·]", 3, 40
#: Punctuation that ends a sentence or clause, closing marks after it.
ENDED = r"[.!?:;,…。！？][\"'”’)\]]*[ \t-\r]*\z"
#: Lines of at most these characters and words that no such punctuation ends, this many in a
#: row, are a menu.
ENTRY_CHARS, ENTRY_WORDS, SERIES = 40, 3, 4
#: A document is rejected when failing lines hold over this share of its characters.
MOST_LOST = 0.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that are found twice or more in the text."""

    def window(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(at, lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("s"), i.alias("i")))

    def again(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda x, j: F.coalesce(F.get(s, j)["s"] == x["s"], F.lit(False))
        return F.transform(F.filter(s, lambda x, k: ((k > 0) & same(x, k - 1)) | ((k < last) & same(x, k + 1))), lambda x: x["i"])

    def covered(p: Column) -> Column:
        # Windows in order: each adds the words that the next one does not reach back to.
        start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n"))
        return F.aggregate(p, start, step, lambda acc: acc["n"])

    windows = let(F.sort_array(window(words)), lambda s: covered(F.sort_array(again(s))))
    return F.when(F.size(words) < 3, 0).otherwise(windows)


def judged(line: Column) -> Column:
    """Struct of a line, its length, its symbols, whether it has a word, fails, and is short and unfinished."""

    def verdict(sized: Column) -> Column:
        line, length, n_symbols = sized["line"], sized["length"], sized["n_symbols"]
        lower, upper = F.lower(line), F.upper(line)
        phrase = F.lit(False)
        for stock in BOILERPLATE:
            phrase = phrase | F.contains(lower, F.lit(stock))
        symbols = n_symbols > F.lit(LINE_SYMBOLS) * length
        shouting = (line == upper) & (line != lower) & (F.size(words_of(line)) >= SHOUTED_WORDS)
        menu = let(F.split(line, SEPARATORS, -1), lambda p: (F.size(p) >= MENU_PARTS) & F.forall(p, lambda x: F.length(x).between(1, PART_CHARS)))
        short = (length <= ENTRY_CHARS) & (F.size(words_of(line)) <= ENTRY_WORDS) & ~F.rlike(line, F.lit(ENDED))
        has_word = F.rlike(line, F.lit(r"[^ \t-\r]"))
        return F.struct(
            line.alias("line"), length.alias("length"), n_symbols.alias("n_symbols"), has_word.alias("has_word"),
            (has_word & (symbols | shouting | menu | phrase)).alias("fails"), (has_word & short).alias("short"),
        )

    return let(F.struct(line.alias("line"), F.length(line).alias("length"), F.regexp_count(line, F.lit(SYMBOLS)).alias("n_symbols")), verdict)


def navigation(lines: Column) -> Column:
    """The judged lines; of SERIES short unfinished ones in a row, where lines without a word
    may stand one between each, all fail."""

    def span(x: Column, i: Column, first: int, step: int) -> Column:
        at = lambda k: F.get(lines, i + k)
        found = F.lit(True)
        for k in range(first, first + (SERIES - 1) * step + 1):
            found = found & F.coalesce(at(k)["short"] if (k - first) % step == 0 else ~at(k)["has_word"], F.lit(False))
        return found

    def verdict(x: Column, i: Column) -> Column:
        series = F.lit(False)
        for step in (1, 2):
            for back in range(SERIES):
                series = series | span(x, i, -back * step, step)
        return x.withField("fails", x["fails"] | (x["short"] & series))

    return F.transform(lines, verdict)


def apply_rules(df: DataFrame, text: str = "text", most_lost: float = MOST_LOST) -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines
    (long), lost_share (double), cleaned_text (string), base_failed and kept (boolean) to df.

    A null text counts as empty: no words, so base_failed and not kept. lost_share is the
    share of the characters on lines with a word that stand on failing lines. Repeated rows
    give repeated results; an empty table gives an empty one; columns of df named like a new
    one are replaced. A text is judged whole, whatever its length.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def by_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    def total(lines: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(lines, F.lit(0).cast("long"), lambda acc, x: acc + value(x))

    def by_lines(all_lines: Column) -> Column:
        told = let(F.filter(all_lines, lambda x: x["has_word"]), lambda x: F.size(x) - F.size(F.array_distinct(F.transform(x, lambda y: y["line"]))))
        return F.struct(
            total(all_lines, lambda x: x["n_symbols"]).alias("n_symbols"),
            told.cast("long").alias("n_dup_lines"),
            total(all_lines, lambda x: x["fails"].cast("long")).alias("n_failed_lines"),
            total(all_lines, lambda x: F.when(x["has_word"], x["length"]).otherwise(0)).alias("chars"),
            total(all_lines, lambda x: F.when(x["fails"], x["length"]).otherwise(0)).alias("lost"),
            F.array_join(F.transform(F.filter(all_lines, lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("cleaned_text"),
        )

    words = let(words_of(body), by_words)
    lines = let(let(F.transform(F.split(body, "\n"), judged), navigation), by_lines)
    # Each struct comes out of an explode of one element, which no later projection can be
    # merged into: its fields are then read, not computed again.
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "lost_share", "cleaned_text", "base_failed", "kept")
    df = df.drop(*made).withColumn("_rules", F.explode(F.array(F.struct(words.alias("w"), lines.alias("l")))))
    w, line = F.col("_rules.w"), F.col("_rules.l")
    share = F.when(line["chars"] > 0, line["lost"] / line["chars"]).otherwise(0.0)
    failed = (w["n_words"] < 50) | (100 * w["n_repeat_words"] > 50 * w["n_words"])
    columns = [w["n_words"], w["word_chars"], line["n_symbols"], line["n_dup_lines"], w["n_repeat_words"], line["n_failed_lines"], share, line["cleaned_text"], failed, ~failed & (share <= most_lost)]
    return df.select("*", *(c.alias(n) for c, n in zip(columns, made, strict=True))).drop("_rules")


#: The columns of the registered query in DuckDB, for documents.
RULES_SQL = rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
word AS (SELECT doc_id, list_filter(string_split_regex(t, '[\x09-\x0D ]+'), lambda x: x <> '') AS ws FROM doc),
gram AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM word)),
again AS (SELECT doc_id, i + unnest([0, 1, 2]) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM gram) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM again GROUP BY doc_id),
line AS (SELECT doc_id, pos, line, length(line) AS size, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
                regexp_matches(line, '[^\x09-\x0D ]') AS has_word, string_split_regex(line, '{SEPARATORS}') AS parts,
                len(list_filter(string_split_regex(line, '[\x09-\x0D ]+'), lambda x: x <> '')) AS words
         FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM doc))),
alone AS (SELECT *, has_word AND size <= {ENTRY_CHARS} AND words <= {ENTRY_WORDS} AND NOT regexp_matches(line, '{ENDED.replace("'", "''")}') AS short,
                 has_word AND (symbols > {LINE_SYMBOLS} * size OR (line = upper(line) AND line <> lower(line) AND words >= {SHOUTED_WORDS})
                   OR (len(parts) >= {MENU_PARTS} AND len(list_filter(parts, lambda x: length(x) BETWEEN 1 AND {PART_CHARS})) = len(parts))
                   OR {" OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)}) AS bad FROM line),
starts AS (SELECT *, {" AND ".join(f"coalesce(lead(short, {k}) OVER doc, false)" for k in range(SERIES))} AS one,
                  {" AND ".join(f"coalesce(lead({'NOT has_word' if k % 2 else 'short'}, {k}) OVER doc, false)" for k in range(2 * SERIES - 1))} AS two
           FROM alone WINDOW doc AS (PARTITION BY doc_id ORDER BY pos)),
judged AS (SELECT *, bad OR (short AND ({" OR ".join(f"coalesce(lag({w}, {k * step}) OVER doc, false)" for step, w in ((1, "one"), (2, "two")) for k in range(SERIES))})) AS fails
           FROM starts WINDOW doc AS (PARTITION BY doc_id ORDER BY pos)),
lines AS (SELECT doc_id, sum(symbols)::BIGINT AS n_symbols, (count(*) FILTER (has_word) - count(DISTINCT line) FILTER (has_word))::BIGINT AS n_dup_lines,
                 coalesce(sum(size) FILTER (fails), 0) AS lost, coalesce(sum(size) FILTER (has_word), 0) AS size FROM judged GROUP BY doc_id),
facts AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, n_symbols, n_dup_lines,
                 coalesce(covered.n, 0)::BIGINT AS n_repeat_words, lost > {MOST_LOST} * size AS loses
          FROM word JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT loses AS kept
FROM facts
"""
