import random
import re

from pulsegrid.llm import secret_scan

KEY = "AKIA" + "ABCDEFGH12345678"
MIXED = "aB3" + "dE5fG7hJ9kL1mN3pQ5rS"


def plain(text):
    """The base rules with nothing but plain patterns."""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


TEXTS = [
    None,
    "",
    "nothing here",
    "é😀 password=abcdef x",
    "password=abc PASSWD : 'hunter22'",
    "apikey=xxxxxx api_key='yyyyyyy' toKen=zzzzzzz ſecret=aaaaaaa",
    f"{KEY} short AKIA12 AKIAAKIA{'A' * 14}",
    "deadbeef" * 3 + " " + "deadbeef" * 2,
    f"user=alice {MIXED} https://api.example.com/v1",
    f"alone {MIXED} word",
    "user=alice alone",
    "see https://example.com/a for more",
    f"user=alice {'far ' * 100}{MIXED}",
    f"{KEY} then {MIXED}",
    "password=hunter22 at https://db.example.com",
    "a" * 30000 + "=",
    "password=" * 2000,
]


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, weak string, row long, start int")
    return {r.doc_id: r for r in secret_scan.scan(df).collect()}


def test_base_and_linked_spans(spark):
    out = run(spark, [(i, t, "x", 1, 2) for i, t in enumerate(TEXTS)])
    assert len(out) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r = out[i]
        assert r.base_spans == plain(text or "")
        assert set(filter(None, r.base_spans.split(","))) <= set(filter(None, r.spans.split(",")))
        assert r.n_assign == r.base_spans.count("assign:") and r.n_hex == r.base_spans.count("hex:") and r.n_access == r.base_spans.count("access:")
    assert [s.split(":")[0] for s in out[8].spans.split(",")] == ["ident", "value", "endpoint"]
    for alone in (9, 10, 11, 12):
        assert out[alone].spans == ""
    assert [s.split(":")[0] for s in out[13].spans.split(",")] == ["access", "value"]
    assert [s.split(":")[0] for s in out[14].spans.split(",")] == ["assign", "endpoint"]


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, TEXTS[8]), (1, TEXTS[8]), (None, TEXTS[4])], "doc_id long, text string")
    assert len(secret_scan.scan(df).collect()) == 3
    assert secret_scan.scan(df.limit(0)).count() == 0


def brute_spans(text):
    """Base spans, and weak parts beside a complementary part, from all pairs of a text's parts."""
    base, weak = secret_scan.base_spans(text), secret_scan.weak_spans(text)
    role = lambda k: "ident" if k in ("access", "ident") else "secret" if k in ("assign", "hex", "value") else k
    kept = list(base)
    for a, b, k in weak:
        if any(x < b and a < y for x, y, _ in base):
            continue
        near = {role(other) for x, y, other in base + weak if x <= b + secret_scan.SCOPE and a <= y + secret_scan.SCOPE}
        if near & ({"ident", "endpoint"} if role(k) == "secret" else {"secret"}):
            kept.append((a, b, k))
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(kept, key=lambda s: (s[0], secret_scan.ORDER[s[2]], s[1])))


def made_up(n, seed):
    rng = random.Random(seed)
    some = ["user=alice", "login: bob42", MIXED, MIXED[::-1], KEY, "https://api.example.com/v1", "redis://h:1/0", "password=hunter22", "deadbeef" * 3, "client_id=" + MIXED, "token=" + MIXED]
    return [" ".join(x for _ in range(rng.randint(0, 14)) for x in (rng.choice(some), "é " * rng.choice([0, 3, 60, 97, 98, 99, 100, 150]))) for _ in range(n)]


def test_links_against_all_pairs(spark):
    texts = made_up(150, 2) + [f"user=alice{' ' * k}{MIXED}" for k in (199, 200, 201)] + [f"{MIXED} {'x' * 2000}= login=abcde"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r.doc_id: r.spans for r in secret_scan.scan(df).collect()}
    assert [out[i] for i in range(len(texts))] == [brute_spans(t) for t in texts]
    assert sum(x.count("ident:") for x in out.values()) > 50 and sum("ident" in brute_spans(t) for t in texts[150:]) == 2


def test_redact(spark):
    texts = made_up(40, 4) + [None, "", "plain"]
    rows = [(i, t, "s", "k", 1) for i, t in enumerate(texts)] + [(0, texts[0], "s", "k", 1), (0, "plain", "s", "k", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, `key` string, c0 int")
    out = secret_scan.redact(df, "#")
    assert out.columns == df.columns

    def plain_mask(text):
        marks = [False] * len(text or "")
        starts = set()
        for part in filter(None, brute_spans(text or "").split(",")):
            _, a, b = part.split(":")
            if not marks[int(a)]:
                starts.add(int(a))
            marks[int(a) : int(b)] = [True] * (int(b) - int(a))
        return None if text is None else "".join("#" if i in starts else "" if marks[i] else c for i, c in enumerate(text))

    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str((i, plain_mask(t), *rest)) for i, t, *rest in rows)
    assert secret_scan.redact(df.limit(0)).count() == 0


def test_a_long_text_of_many_parts(spark):
    """Work grows with the parts, not with their square."""
    text = f"user=alice {MIXED} https://api.example.com/v1 password=hunter22 " * 12_000
    r = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_assign == 12_000 and r.spans.count("ident:") == r.spans.count("endpoint:") == 12_000
    assert len(secret_scan.masked(text, [(i, i + 3) for i in range(0, len(text) - 3, 5)], "x")) < len(text)
