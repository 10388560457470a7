"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame operations only.

Base spans come from four patterns.  They are seeds of a bootstrap: the words around an occurrence
are its lexical patterns (two words before, two words after, one on each side), and the distinct pairs
of pattern and identifier form a bipartite graph that also holds every other token with a digit or an
at sign whose form could be of a kind.  In each round a pattern's confidence in a kind is the share of
belief among its identifiers, damped where these are few, and an identifier that is no seed believes a
kind by the noisy-or of its confident patterns.  After the rounds, identifiers of high belief are
found wherever they stand, outside base spans.

The words of a pattern are whole, however far they reach.  Graph and lookup hold each row by a number
that is given when occurrences are stored, or each text by a 128-bit digest, never by a short hash.

The base patterns are written without backtracking: possessive repeats, and look-behinds so that a
search inside a run of the same characters fails at once.  They match what the plain patterns match.

Nulls and edges: a null or empty text has no spans; offsets count code points, the end is exclusive;
base spans of different kinds may overlap, as each kind is searched alone; added spans overlap no base
span and each other at most by being equal; of kinds that an identifier believes alike the first
listed holds; equal texts have equal spans, whatever their ids (null ones too); in a very long text
work grows nearly in proportion to its matches; an empty table returns no rows.  Discovered
identifiers are single tokens without white space.  Other columns are passed through by ``redact`` only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapquery.llm._shared import stored, whole_rows

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Form that a discovered identifier of a kind must have.
FORMS = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^[0-9a-fA-F]{1,4}([.:][0-9a-fA-F]{0,4}){3,7}$",
    "card": r"^[0-9][0-9-]{11,22}[0-9]$",
    "phone": r"^[0-9(][0-9().-]{5,18}[0-9]$",
}
BLOCK = 256  # matches of a text that are placed together
FEW = 64  # spans of a text that are compared together
SENT = 200_000  # spans, or identifiers, that are broadcast at most
#: Up to two words, with what parts them, at the start of a text.
WORDS = r"^[\s\p{Punct}]*+(?:[^\s\p{Punct}]++[\s\p{Punct}]*+){0,2}"
OCCURRENCE = "array<struct<kind:int,start:int,end:int,value:string,before:string,after:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; as a plain column it would be computed anew inside each inner lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def _found(text: Column, pattern: str, kind: int) -> Column:
    """Matches with their places: the gaps between matches give the offsets."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(hits.alias("value"), gaps.alias("gap"), F.slice(gaps, F.lit(2), F.greatest(F.size(hits), F.lit(1))).alias("next"))
    steps = F.transform(
        F.filter(zipped, lambda z: z["value"].isNotNull()),
        lambda z: F.struct(
            F.length(z["gap"]).alias("gap"), F.length(z["value"]).alias("n"), z["value"].alias("value"),
            F.reverse(F.regexp_extract(F.reverse(z["gap"]), WORDS, 0)).alias("before"), F.regexp_extract(z["next"], WORDS, 0).alias("after"),
        ),
    )
    step = lambda acc, s: F.struct(
        (acc["at"] + s["gap"] + s["n"]).alias("at"),
        F.concat(
            acc["out"],
            F.array(F.struct(
                F.lit(kind).alias("kind"), (acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["n"]).alias("end"),
                s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after"),
            )).cast(OCCURRENCE),
        ).alias("out"),
    )
    empty = lambda at: F.struct(at.alias("at"), F.array().cast(OCCURRENCE).alias("out"))
    last = lambda s: F.greatest((F.size(s) - 1).cast("int"), F.lit(0))

    def blocks(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(last(s) / BLOCK).cast("int")), lambda i: F.slice(s, i * BLOCK + 1, F.lit(BLOCK)))

    def placed(b: Column) -> Column:
        """Places by blocks, each from the sum of those before, so that the work stays near linear in the number of matches."""
        sizes = F.transform(b, lambda block: F.aggregate(block, F.lit(0), lambda n, s: n + s["gap"] + s["n"]))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        each = F.filter(F.arrays_zip(b.alias("block"), starts.alias("at")), lambda z: z["block"].isNotNull())
        return F.flatten(F.transform(each, lambda z: F.aggregate(z["block"], empty(z["at"]), step, lambda acc: acc["out"])))

    return _let(steps, lambda s: _let(blocks(s), placed))


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    def digit(i: Column) -> Column:
        d = F.ascii(F.substring(digits, -i, F.lit(1))) - 48
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + digit(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        short = lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))
        return F.forall(F.split(value, r"\."), lambda p: short(F.ltrim(p, F.lit("0"))))
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_occurrences(text: Column) -> Column:
    """Valid matches of the four patterns, by kind as listed and then by start."""
    none = F.array().cast(OCCURRENCE)
    needs = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}
    holds = lambda kind: lambda m: _valid(kind, m["value"])
    return F.concat(*[F.when(needs[k], F.filter(_found(text, BASE[k], i), holds(k))).otherwise(none) for i, k in enumerate(KINDS)])


def _tokens(text: Column) -> Column:
    """Other tokens with a digit or an at sign, without the marks around them."""
    trimmed = lambda m: F.regexp_extract(m["value"], r"[A-Za-z0-9(](?:\S*[A-Za-z0-9])?", 0)
    lead = lambda m: F.length(F.regexp_extract(m["value"], r"^[^A-Za-z0-9(]*", 0))
    moved = F.transform(
        _found(text, TOKEN, -1),
        lambda m: F.struct(
            m["kind"].alias("kind"), (m["start"] + lead(m)).alias("start"), (m["start"] + lead(m) + F.length(trimmed(m))).alias("end"),
            trimmed(m).alias("value"), m["before"].alias("before"), m["after"].alias("after"),
        ),
    )
    return F.when(text.rlike("[0-9@]"), F.filter(moved, lambda m: m["end"] > m["start"])).otherwise(F.array().cast(OCCURRENCE))


def _chunks(spans: Column) -> Column:
    """Sorted spans in parts of ``FEW``, each with the range that it covers."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(spans), F.lit(1)) - 1) / FEW).cast("int")), lambda i: F.slice(spans, i * FEW + 1, F.lit(FEW)))
    return F.filter(
        F.transform(parts, lambda p: F.struct(p.alias("part"), F.get(p, 0)["start"].alias("start"), F.array_max(F.transform(p, lambda s: s["end"])).alias("end"))),
        lambda c: c["start"].isNotNull(),
    )


def _apart(tokens: Column, base: Column) -> Column:
    """Those of the tokens that overlap no base span; only parts whose ranges overlap are compared."""
    spans = F.array_sort(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
    over = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def kept(chunks: Column) -> Column:
        def of(c: Column) -> Column:
            near = F.flatten(F.transform(F.filter(chunks, lambda b: over(b, c)), lambda b: b["part"]))
            return _let(near, lambda n: F.filter(c["part"], lambda t: ~F.exists(n, lambda b: over(b, t))))

        return F.flatten(F.transform(_chunks(tokens), of))

    return F.when(F.size(base) == 0, tokens).otherwise(_let(_chunks(spans), kept))


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base, tokens) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("id"), text.alias("_text")).select("id", base_occurrences(F.col("_text")).alias("base"), _tokens(F.col("_text")).alias("tokens"))
    return found.withColumn("tokens", _apart(F.col("tokens"), F.col("base")))


def _edges(found: DataFrame) -> DataFrame:
    """Distinct (pattern, instance, seed) of the graph; seed: kind of a base span, else null."""
    one = found.select(F.explode(F.concat("base", "tokens")).alias("o")).select("o.*")
    tidy = lambda c: F.lower(F.regexp_replace(c, r"[\s\p{Punct}]+", " "))
    before, after = F.split(F.trim(tidy(F.col("before"))), " "), F.split(F.trim(tidy(F.col("after"))), " ")
    last = lambda a, n: F.array_join(F.slice(F.reverse(a), 1, n), " ")
    first = lambda a, n: F.array_join(F.slice(a, 1, n), " ")
    patterns = F.array(
        F.concat(F.lit("< "), last(before, 2)), F.concat(F.lit("> "), first(after, 2)),
        F.concat(F.lit("< "), last(before, 1), F.lit(" > "), first(after, 1)),
    )
    seed = F.when(F.col("kind") >= 0, F.col("kind"))
    return one.select(F.explode(patterns).alias("pattern"), F.lower("value").alias("instance"), seed.alias("seed")).where(F.col("pattern").rlike(r"[^<> ]")).distinct()


def _could_be(instance: Column, kind: Column) -> Column:
    """Whether the form of an unseen identifier allows the kind."""
    allowed = F.lit(False)
    for i, k in enumerate(KINDS):
        allowed = allowed | ((kind == i) & instance.rlike(FORMS[k]))
    return allowed


def discover(found: DataFrame, rounds: int = 3, support: float = 1.0, confident: float = 0.6, believed: float = 0.8) -> DataFrame:
    """(instance, kind): identifiers that confident patterns have brought to light.

    A pattern's confidence is its belief over the number of its identifiers plus ``support``, and
    counts from ``confident`` on; an identifier is taken at a belief of ``believed``.
    """
    edges = stored(_edges(found), "pii-edges")
    links = edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    size = links.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count("seed").alias("seeds"))
    size = size.where((F.col("seeds") > 0) | (F.col("n") / (F.col("n") + support) >= confident))  # others can't become confident in any round
    links = stored(links.join(size, "pattern"), "pii-links")
    belief = links.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct()
    fresh = links.where("seed is null").select("pattern", "instance")
    for _ in range(rounds):
        pattern = (
            links.select("pattern", "instance", "n")
            .join(belief, "instance")
            .groupBy("pattern", "kind")
            .agg((F.sum("belief") / (F.first("n") + support)).alias("confidence"))
            .where(F.col("confidence") >= confident)
        )
        learned = (
            fresh.join(pattern, "pattern")
            .where(_could_be(F.col("instance"), F.col("kind")))
            .groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("belief"))
        )
        seeds = links.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct()
        belief = stored(seeds.union(learned).groupBy("instance", "kind").agg(F.max("belief").alias("belief")), "pii-belief")
    seen = links.where("seed is not null").select("instance").distinct()
    best = belief.where(F.col("belief") >= believed).groupBy("instance").agg(F.max_by("kind", F.struct("belief", -F.col("kind"))).alias("kind"))
    return best.join(seen, "instance", "left_anti")


def _added(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, added): spans of discovered identifiers of each row or text that has any."""
    known = stored(known, "pii-known")
    if known.count() <= SENT:
        known = F.broadcast(known)  # a checked number of identifiers; more of them are joined by a shuffle
    tokens = found.where(F.size("tokens") > 0).select(key, F.explode("tokens").alias("o"))
    spans = tokens.select(key, F.lower("o.value").alias("instance"), "o.start", "o.end").join(known, "instance")
    return spans.groupBy(key).agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))


SPANS = "array<struct<kind:int,start:int,end:int>>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bootstrap: float) -> DataFrame:
    """(id, base, spans) of each row: base spans and all spans, as (kind, start, end) by kind and start."""
    found = stored(occurrences(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pii-occurrences")
    added = _added(found, discover(found, **bootstrap), "row")
    base = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"))).cast(SPANS)
    every = F.array_sort(F.concat("base", F.coalesce(F.col("added").cast(SPANS), F.array().cast(SPANS))))
    return found.select("id", "row", base.alias("base")).join(added, "row", "left").select("id", "base", every.alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bootstrap: float) -> DataFrame:
    """``docs`` with each span, and each union of overlapping ones, replaced by its kind in angle brackets; a null text stays null."""
    named = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    found = stored(occurrences(docs.select(F.struct(named.alias("digest")).alias("id"), F.col(text_col)), "id", text_col).select("id.digest", "base", "tokens"), "pii-occurrences")
    added = stored(_added(found, discover(found, **bootstrap), "digest"), "pii-added")
    if added.agg(F.coalesce(F.sum(F.size("added")), F.lit(0))).first()[0] <= SENT:
        added = F.broadcast(added)  # a checked number of spans; more of them are joined by a shuffle
    ranged = lambda c: F.transform(c, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = whole_rows(docs, text=text, digest=named, base=ranged(base_occurrences(text)))
    spans = F.array_sort(F.concat("base", ranged(F.coalesce(F.col("added").cast(SPANS), F.array().cast(SPANS)))))
    spanned = rows.join(added, "digest", "left").select("row", "text", spans.alias("spans"))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    between = lambda acc, to: F.substring(F.col("text"), acc["at"] + 1, to - acc["at"])
    step = lambda acc, s: (
        F.when(s["end"] <= acc["at"], acc)
        .when(s["start"] < acc["at"], F.struct(s["end"].alias("at"), acc["out"].alias("out")))
        .otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], between(acc, s["start"]), F.get(names, s["kind"])).alias("out")))
    )
    whole = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], between(acc, F.length("text"))))
    clean = F.when(F.size("spans") > 0, whole).otherwise(F.col(f"row.`{text_col}`"))
    columns = [clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return spanned.select(*columns)
