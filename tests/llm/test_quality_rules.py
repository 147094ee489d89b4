import random
import re

from pyspark.sql import functions as F

from panelwright.llm import quality_rules as Q

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    """The contract's five counts and its base verdict, read off the definition."""
    text = text or ""
    words = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    inside = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def texts():
    draw = random.Random(5)
    out = [None, "", " \n\t ", "a", "a b", "a b c a b c", "x x x x x", "é é # $\nq\nq\n q\nq", "a\x85b c | |", "\n\n\n"]
    for _ in range(60):
        out.append("".join(draw.choice(["a", "b", "ab", "ü", "#", "1", "Q"]) + draw.choice([" ", " ", "\n", "\t", "\r\n"]) for _ in range(draw.randrange(120))))
    return [*out, "word " * 30_000, *out[:5]]


def test_counts_equal_the_definition(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit("x"), "t": F.lit(1), "id": F.lit(2)})
    got = {r.doc_id: r for r in Q.judge(Q.statistics(docs.repartition(3)), Q.DecisionList()).collect()}
    assert len(got) == len(rows)
    for k, text in rows[:-6] + rows[-5:]:
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(text), text
        assert r.kept == (not r.base_failed)
    long = got[len(rows) - 6]
    assert (long.n_words, long.n_repeat_words, long.base_failed) == (30_000, 30_000, True)


def labelled(spark, n=900, noise=0):
    """Bad: many signs, or long lines with many digits. The rest, and ``noise`` rows, are good."""
    draw, rows = random.Random(3), []
    for k in range(n):
        signs, digits, per_line = draw.randrange(600), draw.randrange(300), draw.randrange(1, 100)
        bad = signs > 300 or (digits > 150 and per_line > 50)
        words = 1000
        c = dict.fromkeys(Q.COUNTS, 0) | {"n_words": words, "word_chars": 5000, "n_symbols": signs, "n_digits": digits * 5, "n_lines": max(1, words // per_line), "n_distinct_words": 500}
        rows.append((k, *[c[x] for x in Q.COUNTS], bool(not bad) ^ (k < noise), k % 3 != 0))
    return spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} long" for c in Q.COUNTS) + ", good boolean, grows boolean")


def plain_verdict(rules, row):
    """The list walked rule by rule in Python."""
    for number, r in enumerate(rules.rules, 1):
        if all((value(c.statistic, row) >= c.bound) == c.at_least for c in r.conditions):
            return number, r.keep
    return 0, rules.default


def value(s, row):
    if s.under is None:
        return row[s.over]
    return s.per * row[s.over] // row[s.under] if row[s.under] else 0


def test_list_is_learned_and_emitted_in_order(spark):
    rows = labelled(spark, noise=20)
    rules = Q.learn(rows)
    assert 2 <= len(rules.rules) <= Q.MAX_RULES and any(len(r.conditions) > 1 for r in rules.rules)
    got = rows.select("*", rules.verdict().alias("keep"), rules.fired().alias("rule")).collect()
    assert all(plain_verdict(rules, r.asDict()) == (r.rule, r.keep) for r in got)
    assert sum(r.keep == (r.good ^ (r.doc_id < 20)) for r in got) >= 0.95 * len(got)


def test_first_condition_is_the_best_of_all(spark):
    """Against all thresholds tried one by one on the growing rows."""
    rows = labelled(spark)
    data = [r.asDict() for r in rows.where("grows").collect()]
    best = Q._best(Q._cells(rows, {False: []})[False], False)
    bad = [d for d in data if not d["good"]]

    def gain(c):
        inside = [d for d in data if (value(c.statistic, d) >= c.bound) == c.at_least]
        p = sum(not d["good"] for d in inside)
        return Q._gain(p, len(inside) - p, len(bad), len(data) - len(bad))

    tried = [Q.Condition(s, side, cell * s.step) for s in Q.STATISTICS for cell in range(1, Q.CELLS) for side in (True, False)]
    assert abs(gain(best) - max(map(gain, tried))) < 1e-9


def test_pruning_cuts_conditions_that_do_not_help(spark):
    rows = labelled(spark)
    first = Q._best(Q._cells(rows, {False: []})[False], False)
    useless = Q.Condition(Q.STATISTICS[0], True, 0)
    rule = Q._pruned(rows, {False: [first, useless]}, 0.9, 5)
    assert rule.conditions == (first,)
    assert Q._pruned(rows, {False: [useless]}, 0.9, 5) is None


def test_labels_null_repeated_disagreeing_and_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c"), (None, "d"), (2, None)], "doc_id long, text string")
    stats = Q.statistics(docs)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (2, 1), (2, 1)], "doc_id long, quality int")
    assert Q.train(stats, labels) == Q.DecisionList()
    assert Q.train(stats, labels.where("false")) == Q.DecisionList()
    one = labelled(spark).where("good")
    assert Q.learn(one) == Q.DecisionList((), True) and Q.learn(one.withColumn("good", F.lit(False))).default is False
    none = Q.judge(Q.statistics(docs.where("false")), Q.DecisionList())
    assert none.collect() == [] and "kept" in none.columns
    assert Q.judge(stats, Q.DecisionList()).count() == 4


def test_held_out_accuracy(spark):
    """Learned without a fifth of the labels, judged on that fifth."""
    from panelwright.llm.langid import remainder

    folder = "/root/testdata/sf0.01"
    stats = Q.statistics(spark.read.parquet(f"{folder}/documents.parquet"))
    labels, held = spark.read.parquet(f"{folder}/labels.parquet"), remainder("doc_id", 5) == 0
    rules = Q.train(stats, labels.where(~held))
    seen = Q.judge(stats, rules).join(labels.where(held), "doc_id").where("NOT base_failed")
    right, n = seen.select((F.col("kept") == (F.col("quality") == 1)).cast("int").alias("r")).agg(F.sum("r"), F.count("*")).first()
    assert right >= 0.95 * n
