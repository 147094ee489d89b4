import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from panelwright.llm import spelling as S


def plain_vocabulary(docs, least=5):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if one_apart(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        out[w] = [form, w, n, len(near), counts[form] if form else None]
    for w in out:
        last = w
        while out[last][0]:
            last = out[last][0]
        out[w][1] = last
    return {w: tuple(v) for w, v in out.items()}


def some_words(n=700, seed=2, letters="abcé"):
    draw = random.Random(seed)
    words = {"".join(draw.choice(letters) for _ in range(draw.randrange(6, 10))) for _ in range(n)}
    return {w: draw.choice([5, 6, 25, 30, 130, 700, 4000]) for w in sorted(words)}


def collected(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("unit_words", [S.UNIT_WORDS, 40])
def test_variants_equal_all_pairs(spark, unit_words):
    """With small units every frequent beginning and end is cut into blocks that meet crosswise."""
    counts = some_words()
    got = collected(S.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), unit_words=unit_words))
    want = plain_variants(counts)
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 50 and any(v[0] not in (None, v[1]) for v in want.values())


def test_vocabulary_and_whole_query_equal_the_definition(spark):
    draw, words = random.Random(6), list(some_words(60, 8))
    docs = [(k, " ".join(draw.choice(words) for _ in range(400)).title()) for k in range(40)]
    docs += [(None, "Straße " * 9), (900, None), (901, ""), (902, "abc 12345 ×÷Àÿ×÷ " * 6), (903, "abcdefg-abcdefg'hijklmnİabcdefg " * 5), (1, docs[1][1])]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(5)
    found = S.vocabulary(frame, damage=199)
    want = plain_vocabulary(docs)
    assert {r.word: r.n for r in found.collect()} == want
    assert collected(S.variants(found)) == plain_variants(want)


def test_held_words_are_passed_on_in_parts(spark, monkeypatch):
    docs = [(k, "alphabet betabeta gammagam") for k in range(50)]
    monkeypatch.setattr(S, "HELD_WORDS", 1)
    got = {r.word: r.n for r in S.vocabulary(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {"alphabet": 50, "betabeta": 50, "gammagam": 50}


def test_index_intervals_are_those_of_all_rotations():
    """Both intervals stay in step whichever way a pattern is made longer."""
    words = sorted(some_words(40))
    letters = np.unique(np.frombuffer(("\0" + "".join(words)).encode("utf-32-le"), dtype=np.uint32))
    index = S.Index(words, letters)
    ring = "\0" + "\0".join(words)
    rings = sorted(ring[k:] + ring[:k] for k in range(len(ring)))
    backs = sorted((ring[::-1][k:] + ring[::-1][:k]) for k in range(len(ring)))
    draw = random.Random(1)
    for _ in range(200):
        start = draw.randrange(len(ring))
        pattern, lo, back, size = "", np.array([0]), np.array([0]), np.array([len(ring)])
        left = right = start
        for _ in range(draw.randrange(1, 8)):
            if to_right := draw.random() < 0.5:
                c, right = ring[right % len(ring)], right + 1
                pattern += c
            else:
                left -= 1
                c = ring[left % len(ring)]
                pattern = c + pattern
            lo, back, size = index.extend(lo, back, size, np.searchsorted(letters, [ord(c)]), to_right)
        hits = [k for k, r in enumerate(rings) if r.startswith(pattern)]
        turned = [k for k, r in enumerate(backs) if r.startswith(pattern[::-1])]
        assert (int(lo[0]), int(size[0])) == (hits[0], len(hits)) and int(back[0]) == turned[0]
        assert sorted(letters[s] for s in index.branches(lo, back, size, True)[1]) == sorted({ord(rings[h][len(pattern)]) for h in hits})


def test_each_near_word_is_found_once():
    words = sorted({"a" * n for n in range(6, 12)} | {"aaaaab", "aaabaaa", "baaaaa", "ababab", "bababa", "abababa"})
    counts = np.arange(len(words))
    total = Counter()
    for to_right in (True, False):
        for r in S.near_in_unit(words, counts, words, to_right).itertuples():
            total[r.word] += r.n_near
    assert total == Counter({w: sum(one_apart(w, x) for x in words) for w in words if any(one_apart(w, x) for x in words)})


def test_empty_one_word_and_very_long_words(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert S.variants(none).collect() == []
    assert collected(S.variants(spark.createDataFrame([("single", 9)], "word string, n long"))) == {"single": (None, "single", 9, 0, None)}
    long = "x" * 3_000
    counts = {long: 5, long[:-1] + "y": 50, long + "x": 7, "y" + long[1:]: 400}
    assert collected(S.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == plain_variants(counts)
    assert S.vocabulary(spark.createDataFrame([], "doc_id long, text string"), damage=199).collect() == []
