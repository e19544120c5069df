import random
import re
from collections import Counter
from math import log2

import pytest
import regex
from pyspark.sql import functions as F

from pulsegrid.llm import pii


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


TEXTS = [
    None,
    "",
    "plain words only",
    "a@b.co, x.y+z@mail-1.example.org. c@d é😀 m@n.o",
    "a@b@c.de a@b.c_d@e.f%g@h.i.j..k @x.y q@.z",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255 1.2.3 0.0.0.0 1.2.3.0256",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111",
    "41111111111111111111111111 79927398713 000000000000 0-0-0-0-0-0-0-0-0-0-0-0 1",
    "+1 (386) 555-3733 +1 23 +1234567890123456 ++49 30 123456 +1 (212) 555-0153-",
    "+1.2.3.4 4111111111111111@x.yz 10.0.0.1@host.tld",
    "1 " * 3000,
    "9" * 20000,
    "a" * 60000,
    "a." * 20000 + "@b" + ".c" * 20000,
    "u@v.w " * 3000,
    "+1" + " " * 20000,
    "1." * 20000,
]


def test_base_spans_against_plain_patterns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    body = F.coalesce(F.col("text"), F.lit(""))
    for r in df.select("doc_id", pii.base_spans(body).alias("base"), body.alias("body")).collect():
        assert [(s.start, s.rank, s.end) for s in r.base] == brute(r.body), r.doc_id
        assert all(r.body[s.start : s.end] == s.value and s.kind == pii.KINDS[s.rank] for s in r.base)


def story(i, nickname, mail):
    fill = " ".join(f"filler{chr(97 + (i * 7 + k) % 26)}{chr(97 + (i * 3 + k) % 26)} common" for k in range(30))
    return f"{fill} the agent {nickname} wrote from {mail} again today. {fill}"


def test_disclosing_terms(spark):
    rows = [(i, story(i, "Zebrafinch", "zf@example.com")) for i in range(5)]
    rows += [(i, story(i, "ordinary", f"m{i}@example.com")) for i in range(5, 40)]
    rows += [(i, story(i, "nobody", "nothing")) for i in range(40, 80)]
    rows += [(90, "elsewhere the zebrafinch is seen without an address"), (91, None), (92, ""), (None, rows[0][1]), rows[1], rows[1]]
    df = spark.createDataFrame([(i, t, 3, "x", "k") for i, t in rows], "doc_id long, text string, n_ip int, spans string, key string")
    out = pii.scan(df, with_text=True).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for r in out:
        text = dict(rows)[r.doc_id] or ""
        terms = {text[s.start : s.end].lower() for s in r.spans if s.kind == pii.TERM}
        assert terms == ({"zebrafinch"} if "ebrafinch" in text else set())
        assert {(s.start, s.end, s.kind) for s in r.base} <= {(s.start, s.end, s.kind) for s in r.spans}
        assert r.spans == sorted(r.spans, key=lambda s: (s.start, s.rank))
        assert "zf@example.com" not in r.sanitised and "ebrafinch" not in r.sanitised
    assert by[91].sanitised == by[92].sanitised == "" and by[91].spans == []
    assert by[90].sanitised == "elsewhere the [TERM] is seen without an address"
    assert pii.scan(df.limit(0)).count() == 0


def test_entities_of_one_and_two_documents(spark):
    far = " ".join(["common"] * 40)
    rows = [(i, story(i, "ordinary", f"m{i}@example.com")) for i in range(40)] + [(i, story(i, "nobody", "nothing")) for i in range(40, 100)]
    rows += [(200, f"Quetzal {far} {story(3, 'nobody', 'one@single.org')}")]
    rows += [(201 + k, f"{story(4 + k, 'nobody', 'two@double.org')} {far} Wu") for k in range(2)]
    rows = [(i, t + " hot@all.org" * (i % 2 == 0)) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.scan(df, with_text=True).collect():
        terms = {s.value for s in r.spans if s.kind == pii.TERM}
        assert terms == {200: {"Quetzal"}, 201: {"Wu"}, 202: {"Wu"}}.get(r.doc_id, set()), r.doc_id
        assert "Quetzal" not in r.sanitised and "Wu" not in r.sanitised


def brute_terms(rows):
    """For each row the term spans, from counts over all rows."""
    kinds = pii.KINDS
    texts = [t or "" for _, t in rows]
    base = [brute(t) for t in texts]
    terms = lambda t: {w.lower() for w in regex.findall(r"\p{L}+", t)}
    n, df_term, df_entity, joint = len(rows), Counter(), Counter(), Counter()
    for t, spans in zip(texts, base):
        df_term.update(terms(t))
        entities = {f"{kinds[k]}:{t[a:b].lower()}" for a, k, b in spans}
        rest = t
        for a, _, b in spans:
            rest = rest[:a] + " " * (b - a) + rest[b:]
        df_entity.update(entities)
        joint.update((e, w) for e in entities for w in (terms(rest) if spans else ()))
    told = set()
    for (e, w), both in joint.items():
        often = df_entity[e] / n
        smooth = (both + pii.SMOOTHING * often) / ((df_term[w] + pii.SMOOTHING) * often)
        if often < 1 and log2(smooth) / log2(1 / often) >= pii.DISCLOSURE:
            told.add(w)
    out = []
    for t, spans in zip(texts, base):
        found = [m.span() for m in regex.finditer(r"\p{L}+", t) if m[0].lower() in told]
        out.append([(a, b) for a, b in found if not any(x < b and a < y for x, _, y in spans)])
    return out


@pytest.mark.parametrize("frequent", [0.001, 0.1, 0.4])
def test_terms_against_brute_force(spark, monkeypatch, frequent):
    """Random texts over words of every frequency, split into common and other terms anywhere."""
    monkeypatch.setattr(pii, "FREQUENT", frequent)
    rng = random.Random(3)
    mails = [f"m{i}@x{i % 4}.org" for i in range(12)]
    rows = []
    for i in range(120):
        words = [f"w{chr(97 + int(rng.paretovariate(0.6)) % 26)}{chr(97 + int(rng.paretovariate(0.7)) % 26)}" for _ in range(rng.randint(0, 40))]
        for k, m in enumerate(mails):
            if rng.random() < 0.3 / (k + 1):
                words += [m, *([f"Nick{chr(97 + k)}"] if rng.random() < 0.9 else [])]
        rng.shuffle(words)
        rows.append((i % 110, " ".join(words)))
    rows += [(200, "éab@x.org éab"), (201, None), (202, ""), (203, "one 4111 1111 1111 1111 Übergröße")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, doc_id long, text string")
    got = {r.k: [(s.start, s.end) for s in r.spans if s.kind == pii.TERM] for r in pii.scan(df, "k").collect()}
    assert [got[k] for k in range(len(rows))] == brute_terms(rows)
    assert sum(map(len, got.values())) > 20


def test_many_spans_of_a_long_text(spark):
    """Places are summed in chunks: a text of many matches takes no longer for each."""
    text = "a@b.co word 10.0.0.1 " * 20_000
    r = pii.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("n_email", "n_ip", F.expr("base[39999]").alias("last")).first()
    assert (r.n_email, r.n_ip, r.last.start, r.last.end) == (20_000, 20_000, len(text) - 9, len(text) - 1)


def test_no_python_on_the_executors(spark):
    df = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    plan = pii.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
