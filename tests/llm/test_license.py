import random

import pytest

from snapquery.llm import license as module
from snapquery.llm.license import TEMPLATES, Scanner, align, increasing, scan, templates_of, words_of
from tests.compare import DATA
from tests.llm.helpers import documents, empty, odd, words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_increasing():
    rng = random.Random(1)
    for _ in range(200):
        p = rng.sample(range(30), rng.randrange(12))
        got = [p[i] for i in increasing(p)]
        longest = [0] * len(p)
        for i in range(len(p)):
            longest[i] = 1 + max((longest[j] for j in range(i) if p[j] < p[i]), default=0)
        assert got == sorted(got) and len(got) == max(longest, default=0)


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(100):
        a = [rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(25))]
        b = a.copy()
        for _ in range(rng.randrange(5)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("xyzabc"))
        m = align(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:]))
        assert len(m) <= lcs(a, b)
    assert len(align(list("abc"), list("abc"))) == 3 and align([], ["a"]) == []


def test_planted_licenses_are_found(spark):
    rng = random.Random(3)
    docs, want = odd(), {}
    for k, (name, text) in enumerate(TEMPLATES.items()):
        w = text.split()
        for v in range(3):
            changed = w.copy()
            if v == 1 and len(w) > 12:
                changed[len(w) // 2] = "CHANGED"
                changed.insert(5, "(inserted)")
            if v == 2:
                changed = "  ".join(changed).upper().split()
            docs.append((100 + 10 * k + v, words(rng, 50) + "\n" + " ".join(changed) + ".\n" + words(rng, 50)))
            want[100 + 10 * k + v] = name
    docs += [(900, words(rng, 400) + " the license version of apache under"), (901, f"{TEMPLATES['MIT']} {words(rng, 20)} {TEMPLATES['MIT']}")]
    rows = {r.id: r for r in scan(documents(spark, docs)).collect()}
    for i, name in want.items():
        assert name in [f.template for f in rows[i].found], (i, name)
        best = next(f for f in rows[i].found if f.template == name)
        assert best.coverage >= 0.85 and 50 <= best.first < best.last <= rows[i].n_words - 50
    assert rows[900].found == [] and [f.template for f in rows[901].found].count("MIT") == 2
    assert all(not rows[i].found for i, _ in odd())
    assert scan(empty(spark)).collect() == []


def test_windows_lose_nothing_that_brute_force_finds():
    rng = random.Random(4)
    template = words(rng, 30, 40)
    scanner, t = Scanner({"t": template}, 0.85), words_of(template)
    for _ in range(60):
        changed = [w for w in t if rng.random() > 0.05]
        text = words(rng, 60, 30, "q").split() + changed + words(rng, 60, 30, "q").split()
        m = align(t, changed)
        found = scanner(" ".join(text))[1]
        if len(m) >= 0.85 * len(t):
            assert found and found[0][1] >= 0.85
        if lcs(t, text) < 0.85 * len(t):
            assert not found


def brute_align(a, b):
    """Patience alignment by its definition, as a list of matched places."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in brute_align(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return brute_align(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    unique = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    if not unique:
        return []
    return max(increasing_ways(unique, a, b), key=len)


def increasing_ways(unique, a, b):
    """Alignments by each longest increasing run of the unique words."""
    runs = [[]]
    for p in unique:
        runs += [r + [p] for r in runs if not r or r[-1][1] < p[1]]
    longest = max(map(len, runs))
    for run in (r for r in runs if len(r) == longest):
        out, i, j = [], 0, 0
        for x, y in [*run, (len(a), len(b))]:
            out += [(i + k, j + m) for k, m in brute_align(a[i:x], b[j:y])]
            if x < len(a):
                out.append((x, y))
            i, j = x + 1, y + 1
        yield out


def test_alignment_against_its_definition():
    rng = random.Random(7)
    for _ in range(300):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(9))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randrange(9))]
        assert len(align(a, b)) <= len(brute_align(a, b))
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(align(a, b)) == lcs(a, b) == len(brute_align(a, b))


def brute_scan(text, templates, least=0.85):
    """Every place is aligned, none is passed over by counts."""
    words, found = words_of((text or "").lower()), []
    for name, t in templates.items():
        t, skip = words_of(t.lower()), -1
        short = len(t) <= 12
        for first, w in enumerate(words):
            if first < skip or w not in t:
                continue
            if short:
                hit = [(i, i) for i in range(len(t))] if words[first : first + len(t)] == t else []
            else:
                hit = align(t, words[first : first + -(-3 * len(t) // 2)])
            if t and hit and len(hit) >= least * len(t):
                skip = first + hit[-1][1] + 1
                found.append((name, len(hit) / len(t), first + hit[0][1], skip))
    return len(words), found


def test_query_against_every_place(spark):
    from snapquery.llm import queries

    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in rows:
        n, found = brute_scan(r.text, TEMPLATES) if any(w in r.text.lower() for w in ("licens", "permission", "redistribution", "reserved", "software")) else (len(words_of(r.text.lower())), [])
        want[r.doc_id] = (n, len(found), ",".join(sorted({f[0] for f in found})), max([f[1] for f in found], default=0.0), ",".join(f"{f[0]}:{f[2]}:{f[3]}" for f in found))
    got = {r.doc_id: (r.n_words, r.n_found, r.licenses, r.coverage, r.spans) for r in queries.op9_license(spark, DATA).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 0


def test_short_notices_stand_without_gaps():
    scanner = Scanner(TEMPLATES, 0.85)
    for text in ("All human rights are reserved", "all my rights were reserved by them", "rights reserved all"):
        assert scanner(text)[1] == []
    assert scanner("(c) me. ALL rights\nreserved!")[1] == [("all rights reserved", 1.0, 2, 5)]


def test_templates_that_overlap_and_templates_from_a_table(spark, monkeypatch):
    table = spark.createDataFrame([("b", "one two three four"), ("a", "three four five"), ("c", "one two three four"), (None, "x"), ("d", None), ("e", "!")], "name string, text string")
    found = scan(documents(spark, [(1, "one two three four five one two three four")]), table).first().found
    assert [(f.template, f.first, f.last) for f in found] == [("a", 2, 5), ("b", 0, 4), ("b", 5, 9), ("c", 0, 4), ("c", 5, 9)]
    monkeypatch.setattr(module, "TEMPLATE_BYTES", 10)
    with pytest.raises(ValueError):
        templates_of(table)
