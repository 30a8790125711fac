"""Spelling variants against all pairs of plain Python."""

import collections
import random
import re
import zlib

import pytest

from tidegate.llm import spelling as M
from tidegate.llm.tables import table

from brute import AWKWARD, DOCS
from conftest import SF

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def dictionary(docs, least_length=6, least_count=5):
    count = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= least_length and n >= least_count}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def near_words(words):
    by_cut = collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            by_cut[w[:k] + w[k + 1:]].add(w)
        by_cut[w].add(w)
    near = collections.defaultdict(set)
    for group in by_cut.values():
        for a in group:
            near[a] |= {b for b in group if one_apart(a, b)}
    return near


def variants(words):
    near, form = near_words(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w, n in words.items()}


def got(df):
    rows = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    want = dictionary([(r.doc_id, r.text) for r in docs.collect()])
    assert got(M.spelling_variants(docs)) == variants(want) and len(want) > 500


def mutated(rnd, word, letters):
    k, kind = rnd.randrange(len(word)), rnd.randrange(3)
    return word[:k] + (rnd.choice(letters) if kind else "") + word[k + (kind < 2):]


def test_dense_words(spark):
    rnd = random.Random(6)
    for letters, size in (("ab", 250), ("abcdeé", 400)):
        words = {}
        for _ in range(size):
            w = "".join(rnd.choices(letters, k=rnd.randrange(2, 12)))
            for _ in range(3):
                if len(w) >= 2:
                    words[w] = rnd.randrange(1, 1_000)
                w = mutated(rnd, w, letters) or "ab"
        df = spark.createDataFrame(list(words.items()), "word string, n bigint")
        assert got(M.group_variants(df)) == variants(words)


def test_long_words_and_runs_of_one_letter(spark):
    base = "".join(random.Random(2).choices("acgt", k=3_000))
    words = {base: 7, base[:1_000] + base[1_001:]: 40, base[:2_900] + "x" + base[2_901:]: 300, "aaaaaa": 2_000}
    words |= {"a" * k: k for k in range(7, 30)}
    words |= {"÷" * 6: 1, "÷" * 7: 9, "zzzzzz": 5}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert got(M.group_variants(df)) == variants(words)


def test_ties_and_chains(spark):
    words = {"abcdefgh": 5, "abcdefgx": 25, "abcdefyx": 125, "abcdezyx": 625, "bbcdefgh": 25, "cccccc": 5, "dccccc": 24}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    rows = {r.word: r for r in M.group_variants(df).collect()}
    assert rows["abcdefgh"].form == "abcdefgx" and rows["abcdefgh"].root == "abcdezyx"
    assert rows["cccccc"].form is None and rows["cccccc"].root == "cccccc" and rows["cccccc"].n_near == 1
    assert got(M.group_variants(df)) == variants(words)


def test_awkward_rows(spark):
    rows = AWKWARD + [(k, "Wörter wörter WÖRTER wörtern", "de", "s", 1, "m", "s", "q") for k in range(20, 27)]
    assert got(M.spelling_variants(spark.createDataFrame(rows, DOCS))) == variants(dictionary([r[:2] for r in rows]))
    assert M.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    empty = spark.createDataFrame([(None, 3)], "word string, n bigint")
    assert M.group_variants(empty).count() == 0


@pytest.mark.parametrize("drop", [1, 2, 199])
def test_dictionary(spark, drop):
    docs = [(k, f"Alphabet ALPHABET Àlphabet, alpha123beta{'x' * k}") for k in range(12)]
    count = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{i}:{run}".encode())
            count[run if h % drop else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    df = M.dictionary(spark.createDataFrame(docs, "doc_id bigint, text string"), least_count=2, drop_every=drop)
    assert {(r.word, r.n) for r in df.collect()} == {(w, n) for w, n in count.items() if len(w) >= 6 and n >= 2}
