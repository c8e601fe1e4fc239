"""Personal data and the terms that give it away, by JVM operators alone.

Base spans follow fixed patterns: email, ip, card, phone. What they hold are the
protected entities of a text. How strongly a term reveals an entity is estimated from
the corpus: with n documents, n_e that hold the entity, n_t that hold the term and
n_et that hold both,

    information  IC(e)    = -log2(n_e / n)
    disclosure   PMI(e,t) =  log2(n * n_et / (n_e * n_t))

Copies count in n, n_e, n_t and n_et, but are no evidence of their own where it is asked
what chance does. Texts that hold e fall into families: two are linked when one of BANDS
groups of LEAST minimum hashes of their five-word shingles agrees, and a family is what
links lead through. That links equal texts always, texts of a similarity of 0.5 with a
probability of 0.9999, of 0.3 with 0.95, of 0.1 with 0.28, of 0.03 with 0.03. It measures
dependence and is no near-duplicate search, so links are not compared again: texts that
share a third of their shingles are no independent witnesses. A link by chance costs one.

A term is looked at because it stands in some family with e, so that family says
nothing; how likely chance alone puts a pair into as many further ones is bounded by the
union bound, C(x_e - 1, x_et - 1) * ((x_t - 1) / (x - 1)) ** (x_et - 1) with x the counts
of families (of different texts for x and x_t, which is what is known of texts without
e). A term discloses e when PMI(e,t) >= SHARE * IC(e) and that bound is at most CHANCE. In
one family alone it is 1: any word there would do. It is then a span in every text that
holds e, where no base span covers it. Sanitised text has base spans replaced by
their kind, disclosing terms that begin with a capital generalised to `<name>`, and
other disclosing terms removed.

Since n_et <= n_e, no term of more than n_e * (n / n_e) ** (1 - SHARE) documents can reach
the share. Pairs are made after the terms are counted, of able terms alone: a long
directory pairs its names with its rare words, not with all its words.

Patterns are written so that no text makes the matcher go back over a run: possessive
repeats, and starts only where a run begins or the match before ended. They find the
same matches. Offsets are code points; a match's start is the length of what `split`
leaves before it.

Null text: empty, no spans. Null doc_id and repeated rows: a row each; equal texts
are one family. Spans of different kinds may overlap. No rows: no rows. Other
columns are ignored, or kept by `sanitised`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametwin.llm.common import SPACE
from nametwin.llm.components import components
from nametwin.operators.keep import settle

# Kinds in the order in which ties are written, with their patterns.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")

CHANCE = 0.01
SHARE = 0.9
SHINGLE = 5  # words
BANDS, LEAST = 32, 2  # groups of minimum hashes, hashes of a group
MAX_WANTED = 16 << 20  # bytes of terms that are broadcast; beyond it all terms are shuffled
TERM = r"\p{L}{3,}"

SPAN = "struct<start:int,rank:int,stop:int,kind:string,value:string>"


def matches(text: Column, pattern: Column) -> Column:
    """Array of (start, m) of leftmost matches that do not overlap."""
    both = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")
    )
    zero = F.struct(
        F.lit(0).alias("pos"), F.expr("cast(array() as array<struct<start:int,m:string>>)").alias("out")
    )

    def step(acc: Column, e: Column) -> Column:
        start = acc["pos"] + F.length(e["g"])
        grown = F.array_append(acc["out"], F.struct(start.alias("start"), e["m"].alias("m")))
        return F.struct(
            (start + F.coalesce(F.length(e["m"]), F.lit(0))).alias("pos"),
            F.when(e["m"].isNull(), acc["out"]).otherwise(grown).alias("out"),
        )

    return F.aggregate(both, zero, step, lambda acc: acc["out"])


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _fits(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(
            F.split(m, r"\."),
            lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255),
        )
    if kind == "card":
        return (n >= 12) & (n <= 19) & F.call_function("luhn_check", digits(m))
    return (n >= 9) & (n <= 15)


def _value(kind: str, m: Column) -> Column:
    return digits(m) if kind in ("card", "phone") else F.lower(m)


def base_spans(text: Column) -> Column:
    """Spans of the four kinds by start, then kind."""

    def of(kind: str, rank: int) -> Column:
        good = F.filter(matches(text, F.lit(PATTERNS[kind])), lambda x: _fits(kind, x["m"]))
        span = lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(rank).alias("rank"),
            (x["start"] + F.length(x["m"])).alias("stop"),
            F.lit(kind).alias("kind"),
            _value(kind, x["m"]).alias("value"),
        )
        return F.transform(good, span).cast(f"array<{SPAN}>")

    found = [of(kind, rank) for rank, kind in enumerate(PATTERNS)]
    return F.array_sort(F.concat(*found))


def written(spans: Column) -> Column:
    """`kind:start:end`, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def terms_of(text: Column) -> Column:
    """Distinct words in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans, text): a row a document; text only where there are spans.

    `key` stands for the text.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    spotted = texts.select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"), base_spans(F.col("text")).alias("spans"), "text")
    has = F.size("spans") > 0
    return settle(spotted.select("doc_id", "key", "spans", F.when(has, F.col("text")).alias("text")))


def shingles(text: Column) -> Column:
    """Hashes of all runs of SHINGLE words, or of the whole if it has fewer."""

    def runs(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))

    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    return F.transform(F.array(words), runs)[0]  # words are taken once, not for each run


def families(named: DataFrame, texts: DataFrame) -> DataFrame:
    """(entity, key, family) of rows (entity, key): texts (key, text) of one family share most of what they say."""
    runs = texts.select("key", F.explode(shingles(F.col("text"))).alias("h"))
    least = [F.min(F.xxhash64("h", F.lit(i))).alias(f"h{i}") for i in range(BANDS * LEAST)]
    groups = [F.xxhash64(*[f"h{i * LEAST + j}" for j in range(LEAST)]) for i in range(BANDS)]
    sketches = runs.groupBy("key").agg(*least).select("key", F.array(*groups).alias("groups"))

    def node(*parts: str) -> Column:
        return F.unhex(F.md5(F.concat_ws("\n", *parts)))

    nodes = settle(named.join(sketches, "key").select("entity", "key", node("entity", "key").alias("id"), "groups"))
    held = nodes.select("id", "entity", F.posexplode("groups").alias("i", "v"))
    found = components(held.select(F.col("id").alias("a"), node("entity", "i", "v").alias("b")))
    return nodes.join(found, "id").select("entity", "key", F.col("component").alias("family"))


def term_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n_t): documents that hold a term, at least of those `wanted`.

    Up to MAX_WANTED bytes of wanted terms are broadcast, so that others are not shuffled.
    """
    terms = docs.select(F.explode(terms_of(F.col("text").cast("string"))).alias("term"))
    size = wanted.agg(F.sum(F.octet_length("term") + F.lit(64))).first()[0] or 0
    if size <= MAX_WANTED:
        terms = terms.join(F.broadcast(wanted), "term", "left_semi")
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def disclosing(docs: DataFrame, found: DataFrame, share: float = SHARE, chance: float = CHANCE) -> DataFrame:
    """(entity, term) where the term gives the entity away."""
    n = found.count()
    texts = found.select("key").distinct().count()
    names = F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["value"])))
    held = found.filter(F.size("spans") > 0).groupBy("key").agg(
        F.count(F.lit(1)).alias("rows"), F.first("spans").alias("spans"), F.first("text").alias("text")
    )
    held = settle(held.select("key", "rows", names.alias("names"), "text"))
    named = held.select("key", "rows", F.explode("names").alias("entity"))
    several = named.groupBy("entity").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("entity")
    named = settle(named.join(several, "entity", "left_semi"))  # in one text the bound is 1
    speaking = settle(held.join(named.select("key").distinct(), "key", "left_semi").select("key", "text"))
    kin = settle(named.join(families(named.select("entity", "key"), speaking), ["entity", "key"]))
    holders = kin.groupBy("entity").agg(F.sum("rows").alias("n_e"), F.count_distinct("family").alias("x_e"))
    # no rarer term is lost to rounding: what is able is judged in full below
    most = F.col("n_e") * F.pow(F.lit(float(n)) / F.col("n_e"), F.lit(1 - share)) * (1 + 1e-9)
    holders = settle(holders.filter("x_e > 1").withColumn("most", most))
    able = holders.agg(F.max("most")).first()[0]
    who = F.struct("entity", "family", "n_e", "x_e", "most").alias("who")
    by_text = settle(kin.join(holders, "entity").groupBy("key", "rows").agg(F.collect_list(who).alias("whose")))
    words = speaking.join(by_text.select("key"), "key", "left_semi")
    words = words.select("key", F.explode(terms_of(F.col("text"))).alias("term"))
    wanted = settle(words.select("term").distinct())
    counts = term_counts(docs, wanted).filter(F.col("n_t").between(2, F.lit(able)))
    rare = words.join(counts, "term").join(by_text, "key")
    pairs = rare.select(
        "rows", "term", "n_t", F.explode(F.filter("whose", lambda w: w["most"] >= F.col("n_t"))).alias("w")
    )
    by_family = pairs.groupBy("w.entity", "term", "w.family").agg(
        F.sum("rows").alias("rows"), *[F.first(c).alias(c.split(".")[-1]) for c in ("n_t", "w.n_e", "w.x_e")]
    )
    known = by_family.groupBy("entity", "term").agg(
        F.sum("rows").alias("n_et"),
        F.count(F.lit(1)).alias("x_et"),
        *[F.first(c).alias(c) for c in ("n_t", "n_e", "x_e")],
    )
    known = known.filter("x_et > 1")
    information = -F.log2(F.col("n_e") / F.lit(float(n)))
    disclosure = F.log2(F.lit(float(n)) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    # x_t is at most n_t less the copies that are known of
    others = F.col("n_t") - (F.col("n_et") - F.col("x_et")) - 1
    further = F.col("x_et") - 1
    # C(m, k) <= (e * m / k) ** k
    ways = F.log(F.col("x_e") - 1) - F.log(further) + F.when(further < F.col("x_e") - 1, 1.0).otherwise(0.0)
    likely = further * (F.greatest(ways, F.lit(0.0)) + F.log(others / F.lit(float(max(1, texts - 1)))))
    fits = (information > 0) & (disclosure >= share * information) & (likely <= F.log(F.lit(chance)))
    return settle(known.filter(fits).select("entity", "term"))


def term_spans(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, terms): spans of disclosing terms, a row for each text that has any."""
    held = found.filter(F.size("spans") > 0)
    names = held.select(
        "key", F.explode(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["value"]))).alias("entity")
    ).distinct()
    wanted = names.join(pairs, "entity").groupBy("key").agg(F.array_sort(F.collect_set("term")).alias("wanted"))
    texts = held.select("key", "text").dropDuplicates(["key"]).join(wanted, "key")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("wanted", "|"), F.lit(r")(?!\p{L})"))
    hits = texts.withColumn("pattern", pattern).select(
        "key", matches(F.col("text"), F.col("pattern")).alias("hits")
    )
    spans = F.transform(
        "hits",
        lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(len(PATTERNS)).alias("rank"),
            (x["start"] + F.length(x["m"])).alias("stop"),
            F.lit("term").alias("kind"),
            x["m"].alias("value"),
        ),
    ).cast(f"array<{SPAN}>")
    return settle(hits.select("key", spans.alias("terms")))


def private_spans(docs: DataFrame, share: float = SHARE, chance: float = CHANCE) -> DataFrame:
    """(doc_id, key, base, spans, text): base spans, and all of them; a row a document."""
    found = entities(docs)
    terms = term_spans(found, disclosing(docs, found, share, chance))
    some = found.filter(F.size("spans") > 0).join(terms, "key", "left")
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    outside = F.filter(
        F.coalesce("terms", none),
        lambda t: ~F.exists("spans", lambda b: (t["start"] < b["stop"]) & (b["start"] < t["stop"])),
    )
    every = F.array_sort(F.concat("spans", outside))
    with_spans = some.select("doc_id", "key", F.col("spans").alias("base"), every.alias("spans"), "text")
    without = found.filter(F.size("spans") == 0)
    return with_spans.unionByName(
        without.select("doc_id", "key", F.col("spans").alias("base"), "spans", "text")
    )


def report(spans: DataFrame) -> DataFrame:
    """Counts and digests of what `private_spans` gives."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in PATTERNS]
    return spans.select(
        "doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


def clean_text(text: Column, spans: Column) -> Column:
    """Text with spans generalised or removed; of overlapping spans the first counts."""

    def step(acc: Column, s: Column) -> Column:
        shown = (
            F.when(s["kind"] != "term", F.concat(F.lit("<"), s["kind"], F.lit(">")))
            .when(s["value"].rlike(r"^\p{Lu}"), F.lit("<name>"))
            .otherwise(F.lit(""))
        )
        cut = F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"])
        grown = F.struct(s["stop"].alias("pos"), F.concat(acc["out"], cut, shown).alias("out"))
        return F.when(s["start"] < acc["pos"], acc).otherwise(grown)

    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    return F.aggregate(
        spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text)))
    )


def sanitised(docs: DataFrame, share: float = SHARE, chance: float = CHANCE) -> DataFrame:
    """`docs` with sanitised text; texts without spans, null ones too, as they are."""
    done = private_spans(docs, share, chance).filter(F.size("spans") > 0).dropDuplicates(["key"])
    shown = settle(done.select(F.col("key").alias("_key"), clean_text(F.col("text"), F.col("spans")).alias("_clean")))
    marked = docs.withColumn("_key", F.md5(F.col("text").cast("string").cast("binary")))
    joined = marked.join(shown, "_key", "left")
    return joined.withColumn("text", F.coalesce("_clean", "text")).select(*docs.columns)
