import random

import numpy as np
import pytest

from tidegate.llm import decontamination as D

from brute import AWKWARD, DOCS, edit_distance_inside

SYLLABLES = "the er on an ing ti wh re st nd".split()


def prose(rnd, n):
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def normal(text):
    return "".join(map(chr, D.normal(text)[0]))


def test_normal_form_and_places():
    text = "  Ab--C,\n É1 \U0001f600x!"
    codes, at = D.normal(text)
    assert "".join(map(chr, codes)) == "ab c é1 \U0001f600x"
    assert all(text[a].lower() == chr(c) or c == 32 for c, a in zip(codes, at))
    assert len(D.normal("")[0]) == 0 and len(D.normal(" ?! ")[0]) == 0


def test_alignment_against_plain_distance():
    rnd = random.Random(4)
    for _ in range(150):
        tile = prose(rnd, 8)[:40]
        e = list(tile)
        for _ in range(rnd.randrange(0, 7)):
            k = rnd.randrange(len(e))
            e[k:k + 1] = rnd.choice([[], ["z"], [e[k], "q"]])
        before = prose(rnd, rnd.randrange(0, 6))
        text = before + "".join(e) + prose(rnd, 4)
        budget = 4
        best = edit_distance_inside(tile, text)
        codes = [np.array([ord(c) for c in s], np.uint32) for s in (tile, text)]
        hit = D.banded(codes[0], codes[1], len(before) - budget, budget)
        if "".join(e) == tile or best <= budget and edit_distance_inside(tile, "".join(e)) == best:
            assert hit and hit[0] == best
            assert edit_distance_inside(tile, text[hit[1]:hit[2]]) == best
        elif best > budget:
            assert hit is None


def plain_matches(docs, items, search):
    """(doc, item) pairs with a tile within its budget, by plain distances."""
    out = set()
    for d, text in docs:
        for i, item in items:
            for _, tile in D.tiles_of(item, search.tile):
                m, q = len(tile), min(search.q, len(tile))
                budget = min(int(m * search.edits), max(0, (m + 1 - search.least) // q - 1))
                if edit_distance_inside("".join(map(chr, tile)), normal(text)) <= budget:
                    out.add((d, i))
    return out


def test_no_region_within_the_budget_is_lost(spark):
    rnd = random.Random(9)
    items = [(k, prose(rnd, 12)) for k in range(6)] + [(6, "tiny"), (7, "Short one here")]
    search = D.Search(tile=48)
    docs = []
    for d in range(60):
        text = prose(rnd, 20)
        if d % 2:
            e = list(rnd.choice(items)[1])
            for _ in range(rnd.randrange(0, 6)):
                k = rnd.randrange(len(e))
                e[k:k + 1] = rnd.choice([[], ["z"], [e[k], "q"], [" , "]])
            text = text + ". " + "".join(e).upper() + "\n" + prose(rnd, 5)
        docs.append((d, text))
    docs += [(100, "the " * 400), (101, "er on " * 300)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = plain_matches(docs, items, search)
    rows = D.leaks(table, bench, search).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and want
    texts = dict(docs)
    for r in D.spans(table, bench, search).collect():
        tile = dict(D.tiles_of(dict(items)[r.item_id], search.tile))[r.tile]
        part = " " + normal(texts[r.doc_id][r.start:r.end]) + " "
        assert edit_distance_inside("".join(map(chr, tile)), part) == r.edits
    kept = D.keep_uncontaminated(table, bench, search)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    # several passes over blocks of tiles find the same
    parts = D.leaks(table, bench, D.Search(tile=48, tiles_per_pass=5)).collect()
    assert {(r.doc_id, r.item_id) for r in parts} == want


def test_a_text_longer_than_a_block(spark, monkeypatch):
    rnd = random.Random(1)
    monkeypatch.setattr(D, "_BLOCK", 500)
    item = prose(rnd, 14)
    text = prose(rnd, 90) + " " + item + " " + prose(rnd, 200)
    indexes = D._indexes([type("R", (), dict(item_id=1, place=p, codes=c)) for p, c in D.tiles_of(item, 96)], D.Search())
    found = dict(D._many([text, "other", None, text], indexes))
    assert set(found) == {0, 3} and normal(text[found[0][0][3]:found[0][-1][4]]) == normal(item)


def test_awkward_rows_and_empty_tables(spark):
    docs = spark.createDataFrame(AWKWARD, DOCS)
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "a b c"), (3, "?!"), (4, AWKWARD[7][1].lower() + "!")], "item_id bigint, text string")
    rows = D.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, None), (7, None), (None, None), (6, 4)}
    kept = D.keep_uncontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 8]
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert D.leaks(docs, empty).count() == 0 and D.keep_uncontaminated(docs, empty).count() == len(AWKWARD)
    assert D.leaks(spark.createDataFrame([], DOCS), bench).count() == 0


@pytest.mark.parametrize("text", ["x" * 100_000, "the " * 30_000])
def test_long_repetitive_texts_end(text):
    indexes = D._indexes([type("R", (), dict(item_id=1, place=0, codes=D.normal("the the thing was there on the day")[0]))], D.Search())
    assert dict(D._many([text], indexes)) == {}


def test_every_quote_of_13_words_is_found(spark):
    """All runs of 13 words of all items, and runs of tile + 16 characters of an item without blanks."""
    rnd = random.Random(12)
    items = [(k, prose(rnd, n)) for k, n in enumerate((13, 14, 20, 40, 70))]
    items += [(5, " ".join("abcdefghijklmnopqrstuvwxyz")), (6, "".join(rnd.choice(SYLLABLES) for _ in range(150)))]
    quotes = []
    for k, item in items:
        w = item.split()
        quotes += [(k, " ".join(w[a:a + 13])) for a in range(len(w) - 12)]
    quotes += [(6, items[6][1][a:a + 112]) for a in range(len(items[6][1]) - 111)]
    docs = [(n, f"Zq wq, xq: \"{q.upper()}\" qz qw qx.") for n, (_, q) in enumerate(quotes)]
    docs += [(-n, prose(rnd, 60)) for n in range(1, 20)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    search = D.Search()
    for options in (search, D.Search(tiles_per_pass=40)):
        found = {(r.doc_id, r.item_id) for r in D.leaks(table, bench, options).collect()}
        assert {(n, k) for n, (k, _) in enumerate(quotes)} <= found and min(d for d, _ in found) >= 0
    assert {r.doc_id for r in D.keep_uncontaminated(table, bench).collect()} == set(range(-19, 0))


def test_short_items_are_whole_words_and_remove_nothing(spark):
    items = spark.createDataFrame([(1, "a"), (2, "no"), (3, "I/O!"), (4, "of the")], "item_id bigint, text string")
    texts = ["Nobody knows an anode", "say no", "No.", "an i o port", "io", "a", "", None, "of  THE sea", "of them"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.start, r.end) for r in D.spans(docs, items).collect()}
    assert got == {(1, 2, 4, 6), (2, 2, 0, 2), (3, 3, 3, 6), (5, 1, 0, 1), (8, 4, 0, 7)}
    kept = D.keep_uncontaminated(docs, items)       # single words remove nothing, "I/O!" and "of the" do
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 4, 5, 6, 7, 9]
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    both = items.unionByName(spark.createDataFrame([(9, words)], "item_id bigint, text string"))
    more = docs.unionByName(spark.createDataFrame([(50, "x " + words + " y")], docs.schema))
    assert sorted(r.doc_id for r in D.keep_uncontaminated(more, both).collect()) == [0, 1, 2, 4, 5, 6, 7, 9]
