"""Personal data by weak supervision, in DataFrame functions only.

Patterns find the base spans and further candidates. Labelers (pattern check,
gazetteer, context words, borders, shape) vote on every candidate or abstain;
expectation-maximisation over the counts of vote profiles estimates how
reliable each labeler is for either class and how likely each profile is
personal data. With these soft labels a naive Bayes classifier is trained on
features of the spans. Base spans always stay; the classifier adds candidates.

A profile is a tuple of votes and features with few values each, so the tables
that EM and classifier work on do not grow with the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .joining import small

KINDS = ("email", "ip", "card", "phone")
#: A candidate is added from this probability on.
ACCEPT = 0.95
ROUNDS = 30

# The contract's patterns. Possessive quantifiers and the guards in front change no match
# (what follows a possessive part is never in its class); they keep long runs linear. Runs of fewer than 13 digits are no card.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns; what they find is a candidate only.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
}
#: What a text must hold before a pattern is tried.
NEEDS = {
    ("email", True): "@", ("email", False): r"[\[(]at[\])]", ("ip", True): r"[0-9]\.[0-9]", ("ip", False): r"[0-9A-Fa-f]:[0-9A-Fa-f]",
    ("card", True): r"[0-9][\x20-]?[0-9]", ("phone", True): r"\+[0-9]", ("phone", False): r"[0-9]{3}[).\x20-]\x20?[0-9]{3}",
}
# Gazetteers and context words.
TOP_DOMAINS = "com org net edu gov info biz io co eu uk us de fr es it nl ch at be pt pl ca au jp".split()
CUES = r"mail|e-mail|contact|write to|call|phone|tel\b|telef|fax|mobile|card|visa|credit|karte|carte|tarjeta|address|host|server|login|courriel|kontakt|correo|llam"
ANTI_CUES = r"version|release|order|invoice|isbn|issn|ticket|serial|token|sha|hash|commit|section|figure|page|total|score"
LABELERS = ("check", "gazetteer", "context", "border", "shape")
#: First guess: a labeler that votes is right this often; the check of a base pattern more often.
GUESS = {"check": 0.95, "gazetteer": 0.7, "context": 0.8, "border": 0.6, "shape": 0.6}


def _found(text: Column, kind: str, base: bool) -> Column:
    """All matches of a pattern, in order: (kind, base, i, gap, hit), gap the distance from the match before."""
    pattern = (BASE if base else LOOSE)[kind]
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    rows = F.transform(
        both,
        lambda z, i: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.alias("i"), z["gap"].alias("gap"), z["hit"].alias("hit")),
    )
    return F.when(text.rlike(NEEDS[kind, base]), rows)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(d: Column, i: Column) -> Column:
        twice = 2 * d
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    from_right = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.substring(F.reverse(number), i, 1).cast("int"))
    return F.aggregate(F.transform(from_right, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _passes(kind: Column, hit: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    number = digits(hit)
    bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    small = F.forall(F.split(hit, r"\."), lambda p: F.coalesce(F.substring(bare(p), 1, 4).try_cast("int") <= 255, F.lit(False)))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", F.length(number).between(14, 19) & luhn(number))
        .otherwise(F.length(number).between(10, 15))
    )


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All matches of the distinct texts: key (hash of the text), kind, pattern (is it a base pattern), start, end, hit.

    Positions count code points; end is exclusive.
    """
    text = F.col("t")
    texts = docs.select(F.col(text_col).alias("t")).where(text.isNotNull())
    tries = F.array(*[_found(text, kind, base) for kind, base in NEEDS])
    rows = texts.select(F.xxhash64("t").alias("key"), F.explode(tries).alias("found")).where("found is not null")
    size = F.coalesce(F.length("hit"), F.lit(0))
    # Gaps and matches alone travel, one of each for repeated texts; running sums are the positions.
    rows = rows.select("key", F.inline("found")).withColumn("size", size).distinct()
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("key", "kind", "base").orderBy("i"))
    rows = rows.select("key", "kind", F.col("base").alias("pattern"), (end - F.col("size")).alias("start"), end.alias("end"), "hit")
    return rows.where("hit is not null")


def _profile(spans: DataFrame, texts: DataFrame, around: int) -> DataFrame:
    """Votes and features of every candidate; ``texts``: key and t of the texts that have candidates."""
    rows = spans.join(texts, "key")
    before = F.substring(F.col("t"), F.greatest(F.lit(1), F.col("start") - around + 1).cast("int"), F.least(F.col("start"), F.lit(around)).cast("int"))
    after = F.substring(F.col("t"), (F.col("end") + 1).cast("int"), F.lit(1))
    rows = rows.select("key", "kind", "pattern", "start", "end", "hit", F.lower(before).alias("before"), F.substring(before, -1, 1).alias("prev"), after.alias("next"))
    kind, hit, number = F.col("kind"), F.col("hit"), digits(F.col("hit"))
    passed = F.col("pattern") & _passes(kind, hit)

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 2).when(no, 1).otherwise(0)  # 0: abstains

    tail = F.lower(F.regexp_extract(hit, r"([A-Za-z]+)[^A-Za-z]*$", 1))
    octet = F.regexp_extract(hit, r"^0*([0-9]{1,3})\.", 1).try_cast("int")
    known = (
        F.when(kind == "email", tail.isin(TOP_DOMAINS))
        .when(kind == "ip", octet.between(1, 223) & (octet != 127))
        .when(kind == "card", F.substring(number, 1, 1).isin("3", "4", "5", "6"))
        .otherwise(F.substring(number, 1, 1) != "0")
    )
    solid = r"[\p{L}\p{N}_]"
    border = F.col("prev").rlike(solid) | F.col("next").rlike(solid)
    dull = F.length(F.regexp_replace(number, r"(.)(?=.*\1)", "")) <= 2  # two different digits at most
    votes = F.array(
        F.when(F.col("pattern"), F.when(passed, 2).otherwise(1)).otherwise(0),
        vote(F.coalesce(known, F.lit(False)), F.lit(True)),
        vote(F.col("before").rlike(CUES), F.col("before").rlike(ANTI_CUES)),
        vote(~border, border),
        vote((kind == "email") | ~dull, dull),
    )
    kind_of = lambda c: F.when(c == "", "none").when(c.rlike(r"\p{L}"), "letter").when(c.rlike(r"\p{N}"), "digit").when(c.rlike(r"\s"), "blank").otherwise("mark")
    features = F.array(
        F.concat_ws("|", F.lit("check"), kind, votes[0].cast("string")),
        F.concat_ws("|", F.lit("known"), kind, votes[1].cast("string")),
        F.concat_ws("|", F.lit("words"), votes[2].cast("string")),
        F.concat_ws("|", F.lit("prev"), kind_of(F.col("prev"))),
        F.concat_ws("|", F.lit("next"), kind_of(F.col("next"))),
        F.concat_ws("|", F.lit("digits"), kind, F.least(F.length(number), F.lit(20)).cast("string")),
    )
    return rows.select("key", "kind", "start", "end", passed.alias("base"), votes.alias("votes"), features.alias("features"))


def _bind(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _expectation_maximisation(profiles: Column, rounds: int = ROUNDS) -> Column:
    """Parameters after all rounds: for each labeler and class the probability of its three votes, then the class-1
    prior of each kind. profiles: array of (kind number, votes, n)."""
    n_labels, n_kinds = len(LABELERS), len(KINDS)
    start = []
    for name in LABELERS:
        g = GUESS[name]
        for right, wrong in ((1, 2), (2, 1)):
            p = [0.2, 0.0, 0.0]
            p[right], p[wrong] = 0.8 * g, 0.8 * (1 - g)
            start += p
    start += [0.5] * n_kinds

    def chance(state: Column, p: Column) -> Column:
        """P(class 1) of a profile."""
        odds = F.get(state, F.lit(6 * n_labels) + p["kind"])
        odds = F.log(odds) - F.log(1 - odds)
        for k in range(n_labels):
            v = p["votes"][k]
            odds = odds + F.log(F.get(state, v + (6 * k + 3))) - F.log(F.get(state, v + 6 * k))
        return 1 / (1 + F.exp(-odds))

    def step(state: Column) -> Column:
        soft = F.transform(profiles, lambda p: F.struct(p["kind"].alias("kind"), p["votes"].alias("votes"), p["n"].alias("n"), (p["n"] * chance(state, p)).alias("yes")))

        def again(rows: Column) -> Column:
            def total(what) -> Column:
                return F.aggregate(rows, F.lit(0.0), lambda a, r: a + what(r))

            def weight(r: Column, y: int) -> Column:
                return r["yes"] if y else r["n"] - r["yes"]

            new = []
            for k in range(n_labels):
                for y in (0, 1):
                    all_of = total(lambda r, y=y: weight(r, y))
                    for v in range(3):
                        hits = total(lambda r, k=k, y=y, v=v: F.when(r["votes"][k] == v, weight(r, y)).otherwise(0.0))
                        new.append((hits + 1) / (all_of + 3))
            for k in range(n_kinds):
                yes = total(lambda r, k=k: F.when(r["kind"] == k, r["yes"]).otherwise(0.0))
                every = total(lambda r, k=k: F.when(r["kind"] == k, r["n"]).otherwise(0.0))
                new.append((yes + 1) / (every + 2))
            return F.array(*new)

        return _bind(soft, again)

    params = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(*[F.lit(x) for x in start]), lambda s, _: step(s))
    return _bind(params, lambda s: F.transform(profiles, lambda p: F.struct(p["kind"].alias("kind"), p["votes"].alias("votes"), chance(s, p).alias("chance"))))


def _accepted(profiles: DataFrame, accept: float) -> DataFrame:
    """The (kind, features) profiles that the classifier takes for personal data."""
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1
    by_votes = profiles.groupBy("kind", "votes").agg(F.sum("n").cast("double").alias("n"))
    rows = by_votes.agg(F.sort_array(F.collect_list(F.struct(number.cast("int").alias("kind"), "votes", "n"))).alias("p"))
    judged = rows.select(F.inline(_expectation_maximisation(F.col("p"))))
    judged = judged.select(F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).alias("kind"), "votes", "chance")
    soft = profiles.join(judged, ["kind", "votes"])
    every = F.concat(F.array(F.lit("prior")), F.col("features"))  # the prior is a feature that all have
    weighted = soft.select(F.explode(every).alias("f"), (F.col("n") * F.col("chance")).alias("yes"), (F.col("n") * (1 - F.col("chance"))).alias("no"))
    sums = weighted.groupBy("f").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    within = Window.partitionBy(F.substring_index("f", "|", 1))
    share = lambda c: F.when(F.col("f") == "prior", F.log(F.col(c) + 1)).otherwise(F.log((F.col(c) + 0.5) / (F.sum(c).over(within) + 10)))
    sums = sums.select("f", (share("yes") - share("no")).alias("w"))
    scored = (
        profiles.select("kind", "features").distinct().select("kind", "features", F.explode(every).alias("f"))
        .join(sums, "f").groupBy("kind", "features").agg(F.sum("w").alias("s"))
    )
    return scored.where(1 / (1 + F.exp(-F.col("s"))) >= accept).select("kind", "features", F.lit(True).alias("taken"))


def find_spans(docs: DataFrame, text_col: str = "text", accept: float = ACCEPT, around: int = 40) -> DataFrame:
    """(key, spans): of each distinct text with any, the spans by start, then kind as listed.

    A span is (start, rank, end, kind, base, reach): reach is how far the spans
    before it went. An added span overlaps no base span and no span before it.
    """
    found = checkpointed(candidates(docs, text_col))
    texts = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("t")).where("t is not null")
    keys = small(checkpointed(found.select("key").distinct()))
    texts = texts.join(keys, "key", "left_semi").dropDuplicates(["key"])
    spans = checkpointed(_profile(found, texts, around))
    profiles = checkpointed(spans.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")))
    taken = checkpointed(_accepted(profiles, accept))
    marked = spans.join(small(taken), ["kind", "features"], "left").where("base or taken")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    marked = marked.select("key", "kind", "start", "end", "base", rank.alias("rank")).distinct()
    own = Window.partitionBy("key").orderBy("start", "rank", "end")
    reached = F.coalesce(F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    next_base = F.min(F.when(F.col("base"), F.col("start"))).over(own.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.col("reached") <= F.col("start")) & (F.coalesce(F.col("next_base") >= F.col("end"), F.lit(True)))
    kept = marked.withColumns({"reached": reached, "next_base": next_base}).where(F.col("base") | clear)
    kept = kept.withColumn("reach", F.coalesce(F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return kept.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind", "base", "reach"))).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): one row per row of ``docs``.

    Counts and digest are of the base spans; ``spans`` lists all of them as
    kind:start:end. Null and empty texts have none. Repeated rows get equal
    rows; other columns of ``docs`` are ignored.
    """
    found = find_spans(docs, text_col, accept).withColumnRenamed("key", "_key")
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("_k"))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,base:boolean,reach:bigint>>"))
    rows = rows.join(found, F.col("_k") == F.col("_key"), "left").select(id_col, spans.alias("all"), F.filter(spans, lambda s: s["base"]).alias("own"))
    kinds = F.transform("own", lambda s: s["kind"])
    counts = [F.size(F.array_remove(F.array_append(kinds, kind), kind)) for kind in KINDS]
    counts = [(F.size("own") - left).cast("long").alias(f"n_{kind}") for kind, left in zip(KINDS, counts)]
    return rows.select(id_col, *counts, F.sha2(_joined(F.col("own")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; rows without spans are unchanged, null stays null."""
    found = find_spans(docs, text_col, accept).withColumnRenamed("key", "_key").withColumnRenamed("spans", "_spans")
    rows = docs.withColumn("_k", F.xxhash64(text_col)).join(found, F.col("_k") == F.col("_key"), "left")
    text = F.col(text_col)

    def piece(s: Column) -> Column:
        gap = F.substring(text, (s["reach"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - s["reach"]).cast("int"))
        return F.concat(gap, F.when(s["end"] > s["reach"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))

    last = F.array_max(F.transform("_spans", lambda s: s["end"]))
    rest = F.substring(text, (last + 1).cast("int"), F.length(text))
    clean = F.concat(F.array_join(F.transform("_spans", piece), ""), rest)
    return rows.withColumn(text_col, F.when(F.col("_spans").isNull(), text).otherwise(clean)).select(*docs.columns)
