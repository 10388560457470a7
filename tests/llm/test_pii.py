import random
import re
import time

import pytest
from pyspark.sql import functions as F

from snapquery.llm.pii import FORMS, KINDS, discover, occurrences, personal_data, redact
from tests.llm.helpers import documents, empty, odd

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(i, m.start(), m.end()) for i, k in enumerate(KINDS) for m in re.finditer(PLAIN[k], text or "") if valid(k, m[0])]


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(3)
    letters = "aZ09 @.+-_%()é\n1234 555"
    docs = odd() + [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(120)))) for i in range(1500)]
    docs += [(5002, "a@b.c_d@e.f"), (5003, "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3"), (5004, "4111 1111 1111 1111 x +1 (234) 555-1234"), (5005, "é😀" * 5 + "a@b.co"), (5006, "9" * 9_000 + "." + "a." * 3_000 + "@" + "b." * 3_000), (5007, "+1" * 9_000)]
    want = {}
    for i, t in docs:
        want.setdefault(i, []).append(brute(t))
    rows = personal_data(documents(spark, docs)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = [tuple(b) for b in r.base]
        assert base in want[r.id]
        assert set(base) <= {tuple(s) for s in r.spans} and [tuple(s) for s in r.spans] == sorted(tuple(s) for s in r.spans)


CALLS = [
    (1, "please call me at +1 234 555 1234 after lunch"), (2, "please call me at +44 20 7946 0000 after dinner"), (3, "please call me at 555-123-4567 after work"),
    (4, "please call me at +33 1 23 45 67 89 after work now"), (5, "my number 555-123-4567 ok"), (6, "version 12.5.1 of it 99999-9999"), (7, "you call me at +49 30 123456 after all"),
    (8, "nothing here"), (9, None),
]


def test_confident_patterns_discover_unseen_identifiers(spark):
    found = {r.id: [(KINDS[s.kind], CALLS[r.id - 1][1][s.start : s.end]) for s in r.spans] for r in personal_data(documents(spark, CALLS)).collect()}
    assert found[3] == [("phone", "555-123-4567")] and found[5] == [("phone", "555-123-4567")]
    assert found[6] == [] and found[8] == [] and found[9] == []
    assert all(r.base == r.spans for r in personal_data(documents(spark, CALLS), confident=1.1).collect())


def test_redaction(spark):
    docs = CALLS + [(10, "a@b.co and 10.0.0.1"), (11, "no 4111 1111 1111 1111 é"), (None, "x@y.zz")]
    df = redact(documents(spark, docs))
    assert df.columns == documents(spark, []).columns
    text = {r.doc_id: r.text for r in df.collect()}
    assert text[1] == "please call me at <PHONE> after lunch" and text[5] == "my number <PHONE> ok"
    assert text[10] == "<EMAIL> and <IP>" and text[8] == "nothing here" and text[9] is None and text[None] == "<EMAIL>"
    assert text[11] == "no <CARD> é"
    assert redact(empty(spark)).collect() == [] and personal_data(empty(spark)).collect() == []


def brute_discover(docs, rounds, support=1.0, confident=0.6, believed=0.8):
    """Bootstrapping in plain Python, from the texts."""
    graph, seeds = set(), {}
    word = re.compile(r"[^\s!-/:-@\[-`{-~]+")
    for _, text in docs:
        base = [(k, s, e) for k, s, e in brute(text)]
        found = [(s, e) for _, s, e in base]
        for m in re.finditer(r"\S+", text or ""):
            own = re.search(r"[A-Za-z0-9(](?:\S*[A-Za-z0-9])?", m[0])
            if own and re.search("[0-9@]", m[0]):
                s, e = m.start() + own.start(), m.start() + own.end()
                if not any(a < e and s < b for _, a, b in base):
                    found.append((s, e))
        for kind, s, e in base:
            seeds.setdefault(text[s:e].lower(), set()).add(kind)
        for s, e in found:
            before, after = word.findall(text[:s].lower())[-2:], word.findall(text[e:].lower())[:2]
            for p in (("<", *before), (">", *after), ("<>", *before[-1:], "|", *after[:1])):
                if len(p) > 1 + (p[0] == "<>"):
                    graph.add((p, text[s:e].lower()))
    of = {}
    for p, i in graph:
        of.setdefault(p, set()).add(i)
    belief = {(i, k): 1.0 for i, ks in seeds.items() for k in ks}
    for _ in range(rounds):
        confidence = {}
        for p, members in of.items():
            for k in range(4):
                c = sum(belief.get((i, k), 0.0) for i in members) / (len(members) + support)
                if c >= confident:
                    confidence[p, k] = c
        missing = {}
        for (p, k), c in confidence.items():
            for i in of[p]:
                if i not in seeds and re.search(FORMS[KINDS[k]], i):
                    missing[i, k] = missing.get((i, k), 1.0) * (1 - c)
        belief = {(i, k): 1.0 for i, ks in seeds.items() for k in ks} | {key: 1 - m for key, m in missing.items()}
    best = {}
    for (i, k), b in belief.items():
        if i not in seeds and b >= believed:
            best[i] = max(best.get(i, (0.0, -9)), (b, -k))
    return {i: -k for i, (_, k) in best.items()}


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_discovery_against_brute_force(spark, rounds):
    rng = random.Random(20)
    leads = ["reach my desk", "ring us on", "hotline desk number", "mail box", "host at", "the code"]
    tails = ["any day", "or write", "for help", "thanks", ""]
    values = [f"+1 234 555 {n}" for n in range(1200, 1215)] + [f"555-0{n}-77{n}" for n in range(10, 40)] + [f"a{n}@host" for n in range(6)] + [f"u{n}@mail.org" for n in range(6)] + [f"10.0.0.{n}" for n in range(9)] + [f"fe80:{n}:0:1" for n in range(9)]
    docs = []
    for i in range(260):
        lead = rng.choice(leads)
        some = [v for j, v in enumerate(values) if (j * 7 + leads.index(lead)) % 3 == 0]
        docs.append((i, f"{rng.choice(['x', 'y' * 90, 'see'])} {lead} {rng.choice(some)}, {rng.choice(tails)}"))
    found = occurrences(documents(spark, docs), "doc_id", "text")
    got = {r.instance: r.kind for r in discover(found, rounds, confident=0.2, believed=0.3).collect()}
    want = brute_discover(docs, rounds, confident=0.2, believed=0.3)
    assert got == want and len(want) >= 3


def test_many_matches_in_one_text_take_near_linear_time(spark):
    text = " ".join(f"u{i}@mail.org x{i}y" for i in range(16_000))
    began = time.perf_counter()
    row = occurrences(documents(spark, [(1, text)]), "doc_id", "text").select(F.size("base").alias("base"), F.size("tokens").alias("tokens")).first()
    assert (row.base, row.tokens) == (16_000, 16_000) and time.perf_counter() - began < 15


def test_tokens_keep_apart_from_base_spans(spark):
    rng = random.Random(6)
    docs = [(i, "".join(rng.choice(["10.0.0.7", "a@b.co", " ", "-", "9", "x1", ", ", "4111 1111 1111 1111", "+1 234 555 1234"]) for _ in range(rng.randrange(300)))) for i in range(60)]
    for r in occurrences(documents(spark, docs), "doc_id", "text").collect():
        base = [(b.start, b.end) for b in r.base]
        tokens = [(t.start, t.end) for t in r.tokens]
        own = [(m.start() + n.start(), m.start() + n.end()) for m in re.finditer(r"\S+", docs[r.id][1]) if re.search("[0-9@]", m[0]) and (n := re.search(r"[A-Za-z0-9(](?:\S*[A-Za-z0-9])?", m[0]))]
        assert tokens == [t for t in own if not any(a < t[1] and t[0] < b for a, b in base)]


def test_patterns_without_a_seed_become_confident(spark):
    docs = [(i, f"reach my desk line +1 234 555 12{i:02d} any day{i}") for i in range(30)]
    docs += [(100 + i, f"reach my desk line 555-000-00{i:02d} any day{i}") for i in range(6)]
    docs += [(200 + i, f"left{i} over the blue door 555-000-00{i:02d} right side{i}") for i in range(6)]  # no base span here
    docs += [(300, "left over the blue door 555-000-7777 right side")]
    found = {n: {r.id: len(r.spans) for r in personal_data(documents(spark, docs), rounds=n, believed=0.75).collect()} for n in (1, 2)}
    assert all(found[n][100 + i] == found[n][200 + i] == 1 for n in (1, 2) for i in range(6))
    assert found[1][300] == 0 and found[2][300] == 1


def test_no_python_in_the_plan(spark):
    plan = personal_data(documents(spark, CALLS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)
