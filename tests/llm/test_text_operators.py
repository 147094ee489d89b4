"""The operators on documents against plain versions on small hand-made and driver tables."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelwright.llm import ball_simhash, decontaminate, importance, langid, licenses, pieces, pii, toxicity

ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "two words"), (6, "x" * 200_000), (7, "ab " * 50_000), (8, "ab " * 50_000), (None, "a b c d e")]


TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sf_docs(spark):
    if not TABLES.exists():
        pytest.skip("driver tables are not here")
    return spark.read.parquet(str(TABLES / "documents.parquet"))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).cache()


def plain_fingerprint(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(table)) if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_components(values, linked):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_simhash_matches_brute_force(spark, sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.limit(120).collect()] + [r for r in ODD if r[0] is not None and r[0] != 6]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    texts = dict(rows)
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    want = plain_components(sorted(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = ball_simhash.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{prints[k]:016x}", want[k]) for k in texts}


def test_simhash_links_chains_and_top_bit(spark):
    values = [0, 3, 15, 1 << 63, (1 << 63) | 0x70, 0x00FF00FF00FF00FF, -1 & (1 << 64) - 1]
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    links = {frozenset((r.a & (1 << 64) - 1, r.b & (1 << 64) - 1)) for r in ball_simhash.fingerprint_links(fps).collect()}
    assert links == {frozenset(p) for p in ((0, 3), (3, 15), (0, 1 << 63))}
    assert ball_simhash.ball_size(2) == 65


def test_variants_are_made_in_all_tasks(spark):
    prints = spark.range(0, 5000, 1, 3).select(F.xxhash64("id").alias("fp")).groupBy("fp").count().select("fp")
    plan = ball_simhash.fingerprint_links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_simhash_odd_rows_and_empty_table(spark, odd):
    got = ball_simhash.near_duplicates(odd.withColumn("fp", F.lit("own")))
    assert got.count() == len(ODD)
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16
    assert by[3].component_id == 1 and by[8].component_id == 7
    assert ball_simhash.near_duplicates(odd.limit(0)).count() == 0


def plain_best(text, item):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])

    a, g = shingles(text), shingles(item)
    best = 0.0
    for s in range(len(a) if g else 0):
        w = a[s : s + len(g)]
        both = sum(min(w.count(x), g.count(x)) for x in set(w) & set(g))
        best = max(best, both / (len(w) + len(g) - both))
    return best


def test_decontamination_matches_brute_force(spark):
    draw = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(draw.choices(words, k=n))) for k, n in enumerate((6, 12, 20, 33, 48, 60, 60))] + [(90, None), (91, ""), (92, "only four words here")]
    docs = []
    for k in range(60):
        body = draw.choices(words, k=draw.randrange(0, 150))
        item = items[k % 7][1].split()
        if k % 3:
            for _ in range(k % 4):
                item[draw.randrange(len(item))] = "changed"
            body[len(body) // 2 : len(body) // 2] = item
        docs.append((k, " ".join(body)))
    docs += [(70, None), (71, ""), (72, "only four words here"), (73, docs[4][1]), (4, docs[4][1])]
    got = decontaminate.contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in got.collect()}
    want = {(d, i): s for d, t in docs for i, x in items if (s := plain_best(t, x)) >= 0.8}
    assert set(got) == set(want) and len(want) > 10
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_decontamination_of_repeated_words_and_ids(spark):
    """Few words, so shingles repeat inside items and windows; item ids repeat and are null."""
    draw = random.Random(9)
    items = [(k % 5 if k < 8 else None, " ".join(draw.choices("ab", k=draw.randrange(3, 30)))) for k in range(10)]
    docs = [(k, " ".join(draw.choices("ab", k=draw.randrange(0, 90)))) for k in range(40)]
    got = decontaminate.contaminated(frame(spark, docs).withColumn("key", F.lit(1)), frame(spark, items, "item_id long, text string"), radius=63)
    got = {(r.doc_id, r.item_id): r.similarity for r in got.collect()}
    want = {}
    for d, t in docs:
        for i, x in items:
            if (s := plain_best(t, x)) >= 0.8:
                want[d, i] = max(s, want.get((d, i), 0))
    assert set(got) == set(want) and len(want) > 15
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_decontamination_of_very_long_items(spark):
    draw = random.Random(6)
    words = [f"w{k}" for k in range(5000)]
    item = draw.choices(words, k=70_000)
    other = draw.choices(words, k=30_000)
    docs = [(1, " ".join(item)), (2, " ".join(other + item)), (3, " ".join(other)), (4, " ".join(item[:50_000])), (5, " ".join(item[3:] + other))]
    items = frame(spark, [(7, " ".join(item)), (8, " ".join(other[100:200]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 3), r.first_shingle) for r in decontaminate.contaminated(frame(spark, docs), items).collect()}
    assert got == {(1, 7): (1.0, 0), (2, 7): (1.0, 30_000), (5, 7): (1.0, 0), (2, 8): (1.0, 100), (3, 8): (1.0, 100), (5, 8): (1.0, 70_097)}


def test_decontamination_of_nothing(spark, odd):
    items = frame(spark, [(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(odd.limit(0), items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(number):
    d = [int(c) for c in reversed(number)]
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m.group())
            if {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(number) <= 19 and plain_luhn(number),
                "phone": 10 <= len(number) <= 15,
            }[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


TRICKY = [
    "a@b.c_d@e.f g@h", "x@y.z.w@v.u é@é.fr ñ a.b+c@d-e.fr.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2.3", "😀 +1 (243) 555-5526, +12 34 +123456789012345678",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111", "5555555555554444 5555555555554444", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2", "@@@ a@.b +1+2 . . 1..2.3.4.5",
    "call 555-123-4567 or (555) 123-4567; mail joe (at) site (dot) org", "a@b.c" * 300, "7" * 5000, "1.1." * 2000, "0" * 15, "+" * 50,
]


def test_base_spans_match_brute_force(spark, sf_docs):
    rows = [(k, t) for k, t in enumerate(TRICKY)] + [(1000 + r.doc_id, r.text) for r in sf_docs.collect()] + [(900, None), (901, ""), (0, TRICKY[0])]
    got = pii.report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (r.doc_id, want, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in PATTERNS]
        assert set(want) <= set(filter(None, r.spans.split(",")))


def test_classifier_adds_what_context_supports(spark):
    rows = [(k, f"please call me: +1 (243) 555-{1000 + k} soon, or phone 212-555-{2000 + k} today") for k in range(60)]
    rows += [(100 + k, f"order 8{k:015d} was shipped") for k in range(60)]
    got = {r.doc_id: r.spans for r in pii.report(frame(spark, rows)).collect()}
    assert all(len(got[k].split(",")) == 2 for k in range(60))
    assert all(set(filter(None, got[100 + k].split(","))) == set(plain_spans(rows[60 + k][1])) for k in range(60))


def test_redaction(spark):
    rows = [(1, "mail a@b.cd now"), (2, "é 1.2.3.4"), (3, None), (4, "clean"), (5, "+1 (243) 555-5526")]
    got = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    assert got == {1: "mail [EMAIL] now", 2: "é [IP]", 3: None, 4: "clean", 5: "[PHONE]"}
    assert pii.redact(frame(spark, rows).limit(0)).count() == 0


def test_language_is_learned_and_flagged(spark, sf_docs):
    fold = langid.remainder("doc_id", 4)
    coder = langid.train(sf_docs.where(fold != 2))
    got = langid.predict(sf_docs, coder).join(sf_docs.select("doc_id", "lang"), "doc_id").where(fold == 2)
    rows = got.collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    odd = langid.predict(frame(spark, [*ODD, (9, "12 + 34 !!"), (10, "der des le the")]), coder).collect()
    by = {r.doc_id: r for r in odd}
    assert [by[k].lang_pred for k in (1, 2, 3, 9)] == ["und"] * 4
    assert all(0 <= r.score <= 1 for r in odd)
    assert langid.predict(sf_docs.limit(0), coder).count() == 0


def test_language_without_training_rows(spark, sf_docs):
    coder = langid.train(sf_docs.limit(0))
    assert {r.lang_pred for r in langid.predict(sf_docs.limit(5), coder).collect()} == {"und"}


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 7, 12, 40):
        code = langid.codewords(n).astype(int)
        apart = (code.shape[1] - code @ code.T) / 2 + code.shape[1] * np.eye(n)
        assert apart.min() >= (code.shape[1] + 1) // 4


@pytest.fixture(scope="module")
def lexicon():
    return pieces.load_lexicon()


def paths(lattices, at):
    """All (edges, probability) from a position to its chunk's end."""
    if at == lattices.stop:
        return [((), 1.0)]
    out = []
    for e in range(lattices.first[at], lattices.first[at] + lattices.degree[at]):
        out += [((e, *rest), lattices.prob[e] * p) for rest, p in paths(lattices, int(lattices.end[e]))]
    return out


def test_samples_follow_the_lattice_without_replacement(lexicon):
    lattices = pieces.Lattices(lexicon, ["the", "on"])
    first, second = paths(lattices, int(lattices.base[0])), paths(lattices, int(lattices.base[1]))
    joint = {a + b: p * q for a, p in first for b, q in second}
    assert abs(sum(joint.values()) - 1) < 1e-9
    n, k = 20_000, 3
    keys = pieces.mix(np.arange(n, dtype=np.uint64))
    search = pieces.Search(lattices, np.tile([0, 1], n), np.arange(0, 2 * n + 1, 2), keys)
    search.run(k)
    drawn = []
    for first_, count, log_prob, score, there in search.samples:
        assert there.all()
        own = [tuple(search.pool[f : f + c].tolist()) for f, c in zip(first_, count)]
        drawn.append([own[2 * d] + own[2 * d + 1] for d in range(n)])
        assert np.allclose(log_prob[::2] + log_prob[1::2], [np.log(joint[x]) for x in drawn[-1]])
    scores = np.array([s[3] for s in search.samples])
    assert (np.diff(scores, axis=0) < 0).all()
    assert all(len({a, b, c}) == 3 for a, b, c in zip(*drawn))
    # First draws follow the probabilities; second draws those without the first.
    for path, p in joint.items():
        assert abs(sum(x == path for x in drawn[0]) / n - p) < 4 * np.sqrt(p / n) + 2e-3
        without = sum(q * p / (1 - q) for other, q in joint.items() if other != path)
        assert abs(sum(x == path for x in drawn[1]) / n - without) < 4 * np.sqrt(without / n) + 2e-3


def test_all_segmentations_come_out_once(lexicon):
    lattices = pieces.Lattices(lexicon, ["the"])
    every = {a for a, _ in paths(lattices, 0)}
    search = pieces.Search(lattices, np.array([0]), np.array([0, 1]), np.array([5], dtype=np.uint64))
    left = search.run(len(every) + 2)
    got = [tuple(search.pool[s[0][0] : s[0][0] + s[1][0]].tolist()) for s in search.samples if s[4][0]]
    assert len(got) == len(every) and set(got) == every and left[0] == -np.inf


def test_chunks_share_the_positions_of_a_common_end(lexicon):
    words = [f"{a}{b}ation" for a in "bcdfghjklmnpqrst" for b in "aeiou"]
    assert pieces.Lattices(lexicon, words).stop == 5 + 5 + 80 + 80  # and not 640
    words += ["日本ation", "本ation", "▁ation", "ation", "", "x" * 300, "x" * 299 + "y", "y" * 200 + "x" * 100, "日" * 40 + "\U0001f600"]
    together = pieces.Lattices(lexicon, words)

    def drawn(lattices, at):
        pool, _, count, log_prob = lattices.walk(np.full(20, at, np.int32), pieces.mix(np.arange(20, dtype=np.uint64)))
        return lattices.piece[pool].tolist(), count.tolist(), log_prob.tolist()

    for word, at in zip(words, together.base):
        alone = pieces.Lattices(lexicon, [word])
        assert drawn(together, at) == drawn(alone, alone.base[0])
    assert pieces.Lattices(lexicon, []).stop == 0


def test_every_piece_is_on_its_lattice(lexicon):
    content = [lexicon.flat[a : a + n].tobytes() for a, n in zip(lexicon.start, lexicon.size)]
    bare = set(lexicon.byte_id.tolist())
    found = {i: c[1:].decode() for i, c in enumerate(content) if c[:1] == b" " and b" " not in c[1:] and i not in bare}
    lattices = pieces.Lattices(lexicon, [*found.values()])
    assert len(found) > 1000 and lattices.piece[lattices.first[lattices.base]].tolist() == [*found]


def test_encoding_round_trip(spark, sf_docs, lexicon):
    rows = [*ODD[:5], (7, "ab " * 3000), (11, "▁ own  sign ▁▁\n"), (12, "日本語 😀 é́ "), (13, " lead"), (14, "a")]
    docs = frame(spark, rows).union(sf_docs.select("doc_id", "text").where("doc_id > 14").limit(40)).withColumn("ids", F.lit(0))
    got = pieces.encode(docs, lexicon, k=3).cache()
    assert got.where("not round_trip").count() == 0
    back = pieces.decode(got, lexicon).select("doc_id", "text", "sample").join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "doc_id")
    assert back.where("text <> t or text is null").count() == 0
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert all(len({tuple(r.ids) for r in rs}) == len(rs) for rs in by.values())
    assert [len(by[k]) for k in (1, 2, 7)] == [1, 1, 3] and by[1][0].ids == []
    assert all(r.log_inclusion <= 0 for rs in by.values() for r in rs)
    again = {(r.doc_id, r.sample): r.ids for r in pieces.encode(docs.repartition(5), lexicon, k=3).collect()}
    assert again == {(r.doc_id, r.sample): r.ids for rs in by.values() for r in rs}
    assert pieces.encode(docs.limit(0), lexicon).count() == 0


def test_license_lines_are_found(spark, sf_docs):
    line = licenses.TEMPLATES["GPL-3.0 line"]
    long = licenses.TEMPLATES["MIT grant"].replace("free of charge", "free").upper()
    rows = [*ODD, (20, "some words\n" + line), (21, f"a {line} b {line}"), (22, "x " * 3000 + long + " y" * 3000), (23, line.replace("General", "Big")), (24, "Licensed under CC BY-NC 4.0.")]
    got = {(r.doc_id, r.template): r.containment for r in licenses.scan(frame(spark, rows).withColumn("template", F.lit("x"))).collect()}
    assert got[20, "GPL-3.0 line"] == got[21, "GPL-3.0 line"] == got[24, "CC-BY-NC-4.0 line"] == 1.0
    assert 0.8 <= got[22, "MIT grant"] < 1
    assert not any(d in (23, *range(9)) for d, _ in got)
    # Every planted line of the driver table, and nothing else.
    marks = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0 line", "Released under the MIT License.": "MIT line", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0 line", line: "GPL-3.0 line"}
    want = {(r.doc_id, name) for r in sf_docs.collect() for text, name in marks.items() if text in r.text}
    assert {(r.doc_id, r.template) for r in licenses.scan(sf_docs).collect()} == want
    assert licenses.scan(sf_docs.limit(0)).count() == 0


def test_license_bands_reach_the_recall():
    for size, window in ((1, 2), (5, 16), (100, 256)):
        b = licenses.bands(size, window)
        alike = 0.8 * size / (window + 0.2 * size)
        assert 1 - (1 - alike) ** b >= 0.999 > 1 - (1 - alike) ** (b - 1)


def test_resampling_is_exact_and_prefers_the_target(spark):
    draw = random.Random(1)
    rows = [(k, " ".join(draw.choices(["good", "fine", "text", "prose"] if k % 2 else ["###", "junk", "$$$", "%%%"], k=30))) for k in range(400)]
    rows += [(500, None), (501, ""), (502, "same text"), (502, "same text"), (None, "no id")]
    docs = frame(spark, rows).withColumn("selected", F.lit(1))
    targets = frame(spark, [(k,) for k in range(1, 200, 2)], "doc_id long")
    got = importance.resample(docs, targets, share=0.5).collect()
    assert len(got) == len(rows) and sum(r.selected for r in got) == round(0.5 * len(rows))
    bound = min(r.perturbed for r in got if r.selected)
    assert all(r.perturbed <= bound for r in got if not r.selected)
    assert sum(r.selected for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 2) >= 195
    assert importance.resample(docs.limit(0), targets, share=0.5).count() == 0
    assert not any(r.selected for r in importance.resample(docs, targets, share=0.0).collect())


def test_toxicity_tolerates_insertions(spark):
    draw = random.Random(2)
    words = "the river ran over green stones and nobody asked where it went after rain fell upon hills".split()
    bad = ["idiot", "moron", "scumbag", "loser"]

    def text(toxic, mark=lambda w: w):
        out = draw.choices(words, k=60)
        if toxic:
            out[draw.randrange(60)] = mark(draw.choice(bad))
        return " ".join(out) + "."

    rows = [(k, text(k % 2)) for k in range(600)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(600)] + [(None, 1), (9999, 1), (5, None)], "doc_id long, toxic int")
    machine = toxicity.train(frame(spark, rows), labels)
    probes = [(k, text(1, "-".join)) for k in range(100)] + [(100 + k, text(1, lambda w: w[:2] + "x" + w[2:])) for k in range(100)]
    probes += [(200 + k, text(0)) for k in range(100)]
    got = {r.doc_id: r.predicted for r in toxicity.score(frame(spark, probes), machine).collect()}
    assert sum(got[k] for k in range(100)) >= 90 and sum(got[k] for k in range(100, 200)) >= 80 and sum(got[k] for k in range(200, 300)) <= 10
    odd = toxicity.score(frame(spark, ODD).withColumn("score", F.lit("x")), machine).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(frame(spark, ODD).limit(0), machine).count() == 0


def test_toxicity_bears_long_gaps(spark):
    draw = random.Random(3)
    words = "the river ran over green stones and nobody asked where it went after rain fell upon hills".split()
    bad = ["idiot", "moron", "scumbag", "loser"]

    def text(toxic, mark=lambda w: w):
        out = draw.choices(words, k=60)
        if toxic:
            out[draw.randrange(60)] = mark(draw.choice(bad))
        return " ".join(out) + "."

    labels = spark.createDataFrame([(k, k % 2) for k in range(600)], "doc_id long, toxic int")
    machine = toxicity.train(frame(spark, [(k, text(k % 2)) for k in range(600)]), labels)
    forms = [*(gap.join for gap in ("--", "**", "...", "_-_-", " - ", " * ")), lambda w: w[:2] + "qzj" + w[2:]]
    probes = [(1000 * f + k, text(1, form)) for f, form in enumerate(forms) for k in range(50)]
    got = {r.doc_id: r.predicted for r in toxicity.score(frame(spark, probes), machine).collect()}
    found = [sum(got[1000 * f + k] for k in range(50)) for f in range(len(forms))]
    assert min(found[:-1]) >= 45 and found[-1] >= 25, found
    clean = toxicity.score(frame(spark, [(k, text(0)) for k in range(100)]), machine)
    assert clean.where("predicted = 1").count() <= 10


def test_toxicity_of_a_text_is_its_own():
    machine = toxicity.Machine(np.random.default_rng(1).standard_normal(toxicity.TRIPLES).astype(np.float32), 0.0, np.ones(4))
    machine.weights[0] = 0
    texts = [b"ab", b"what a day it was", b"i", b"another line. and more of it"]
    block = machine.features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    alone = [machine.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(block, alone)


@pytest.mark.parametrize("text, want", [
    ("i--d--i--o--t", "idiot"), ("i**d**i**o**t", "idiot"), ("i - d - i - o - t", "idiot"), ("i d i o t", "idiot"), ("i.d-i*o.t", "idiot"),
    ("an i - d and that -- no", "an id and that -- no"), ("-a", "-a"), ("a-", "a-"), ("--", "--"), ("ab c", "ab c"),
])
def test_squeeze_closes_runs(text, want):
    raw, offsets = toxicity.squeeze(np.frombuffer(("x" + text + "-y").encode(), np.uint8), np.array([0, 1, 1 + len(text), 3 + len(text)]))
    assert raw[offsets[1] : offsets[2]].tobytes().decode() == want


def test_toxicity_without_labels(spark, odd):
    machine = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(odd, machine).collect()} == {0}


def test_resampling_of_blocks_without_words(spark):
    docs = frame(spark, [(k, ("", None, " \n")[k % 3]) for k in range(5)]).coalesce(1)
    got = importance.resample(docs, frame(spark, [(1,)], "doc_id long"), share=0.4).collect()
    assert [r.log_weight for r in got] == [0.0] * 5 and sum(r.selected for r in got) == 2


def test_no_language_is_lost_when_ids_are_null(spark):
    draw = random.Random(4)
    english, french = "the river ran over green stones".split(), "la rivière coulait sur des pierres vertes".split()
    rows = [(None, " ".join(draw.choices(words, k=12)), lang) for words, lang in ((english, "en"), (french, "fr")) for _ in range(400)]
    rows += [(None, "der gleiche Satz steht überall", "de")] * 300
    coder = langid.train(frame(spark, rows, "doc_id long, text string, lang string").repartition(5), per_language=100)
    assert coder.languages == ["de", "en", "fr"]
    probe = frame(spark, [(1, "green stones ran over the river"), (2, "des pierres vertes sur la rivière")])
    assert {r.doc_id: r.lang_pred for r in langid.predict(probe, coder).collect()} == {1: "en", 2: "fr"}


def test_windows_of_a_text_are_taken_inside_it(spark):
    """Each text uses letters of its own, so a window from another one would show."""
    texts = [(chr(97 + k) * 3 + " ") * (5 + 40 * (k % 3)) + "." for k in range(9)]
    rows = spark.createDataFrame([(t, k % 2) for k, t in enumerate(texts)], "t string, y int").coalesce(1)
    machine = toxicity.Machine(np.random.default_rng(2).standard_normal(toxicity.TRIPLES).astype(np.float32), 0.0, np.ones(4))
    windows, y, _, rank = toxicity._strongest(rows, machine)
    anywhere = windows[rank == -1]
    assert len(anywhere) == len(texts)
    assert all(set(w[w > 0].tolist()) <= {k + 1} for k, w in enumerate(anywhere)) and (anywhere > 0).any(axis=1).sum() >= 7
    assert y[rank == -1].tolist() == [k % 2 for k in range(len(texts))]
