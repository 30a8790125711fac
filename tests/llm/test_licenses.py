import random
import re

from tidegate.llm import licenses as L

from brute import AWKWARD, DOCS

TEMPLATES = [(0, "A", "one two three four five six seven eight nine ten eleven twelve"), (1, "B", "alpha beta gamma delta epsilon"),
             (2, "A", "uno dos tres cuatro cinco seis"), (3, "S", "too short"), (4, "N", None)]


def plain(docs, templates, least=0.8):
    def shingles(text):
        w = re.findall(r"[^\W_]+(?:[.\-][^\W_]+)*", (text or "").lower())
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]

    out = {}
    for doc, text in docs:
        s = shingles(text)
        for _, name, t in templates:
            wanted = shingles(t)
            if not wanted:
                continue
            width, stride = -(-len(wanted) * 3 // 2), -(-len(wanted) // 4)
            for start in range(0, len(s), stride):
                share = len(set(s[start:start + width]) & set(wanted)) / len(set(wanted))
                if share >= least:
                    out[(doc, name)] = max(share, out.get((doc, name), 0))
    return out


def test_against_all_windows(spark):
    t0, t1, t2 = (t for _, _, t in TEMPLATES[:3])
    filler = " ".join(f"w{k}" for k in range(40))
    docs = [
        (1, f"{filler} {t0.upper()}, {filler}"), (2, t1), (3, t0.replace("six", "SIX!").replace("one", "zero")), (4, t0.replace("six", "x")),
        (5, f"{t1} {t2}. {t0}"), (6, filler), (7, "alpha beta gamma delta"), (8, f"{t1}\n" * 200), (9, "one two three four five " * 30),
        (10, filler + " " + t2 + " " + filler + " " + t1),
    ]
    tables = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(TEMPLATES, "template int, license string, text string")
    got = L.scan(*tables).collect()
    assert {(r.doc_id, r.license): r.containment for r in got} == plain(docs, TEMPLATES)
    joined = L.scan(*tables, max_keys=3).collect()          # more signature shingles than constants
    assert sorted(joined) == sorted(got)


def test_whole_licence_of_three_hundred_lines(spark):
    """Templates as long as licence bodies, more signature shingles than constants, one text with a tenth of its words changed."""
    rnd = random.Random(3)
    body = [" ".join(f"t{rnd.randrange(900)}" for _ in range(9)) for _ in range(300)]
    other = [" ".join(f"u{rnd.randrange(900)}" for _ in range(9)) for _ in range(300)]
    changed = [line if k % 12 else "quite another line of nine words in its place" for k, line in enumerate(body)]
    docs = [(1, "\n".join(["head " * 50, *body, "tail " * 50])), (2, "\n".join(changed)), (3, "\n".join(body[:150])), (4, "\n".join(other[::-1]))]
    templates = [(0, "Body", "\n".join(body)), (1, "Other", "\n".join(other))]
    tables = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(templates, "template int, license string, text string")
    for max_keys in (L.MAX_KEYS, 5):
        got = {(r.doc_id, r.license): r.containment for r in L.scan(*tables, max_keys=max_keys).collect()}
        assert got == plain(docs, templates) and set(got) == {(1, "Body"), (2, "Body")}


def test_awkward_rows_and_empty_tables(spark):
    templates = spark.createDataFrame([(0, "X", "wort wort wort wort wort ende")], "template int, license string, text string")
    rows = L.scan(spark.createDataFrame(AWKWARD, DOCS), templates).collect()
    assert [(r.doc_id, r.license, r.containment) for r in rows] == [(5, "X", 1.0)]
    assert L.scan(spark.createDataFrame([], DOCS), templates).count() == 0
    assert L.scan(spark.createDataFrame(AWKWARD, DOCS), templates.limit(0)).count() == 0


def test_notices_find_themselves(spark):
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(L.NOTICES)], "doc_id bigint, text string")
    found = {(r.doc_id, r.license) for r in L.scan(docs, L.notices(spark)).collect()}
    assert {(k, n) for k, (n, t) in enumerate(L.NOTICES) if len(t.split()) >= 5} <= found
