"""Plain versions of the operators' definitions, and small tables with every awkward row."""

import collections
import re

import xxhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, mark string, score string, q_words string"
LONG = "wort " * 30_000 + "ende"

# NULLs in every column, empty and blank texts, a very long text, repeated rows and ids, clashing extra columns
AWKWARD = [
    (1, "a b c", "en", "s", 5, "m", "s", "q"), (1, "a b c", "en", "s", 5, "m", "s", "q"),
    (2, None, None, None, None, None, None, None), (3, "", "en", "s", 0, "m", "s", "q"),
    (4, " \t\n\x0b\x0c\r ", "en", "s", 7, "m", "s", "q"), (None, "a b c", "en", "s", 5, "m", "s", "q"),
    (5, LONG, "en", "s", len(LONG), "m", "s", "q"), (6, "x y \U0001f600 ÉTÉ é", "en", "s", 9, "m", "s", "q"),
    (7, "a b c", "de", "t", 5, "n", "t", "r"), (8, "one two three four\none two three four\n\n", "en", "s", 38, "m", "s", "q"),
]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def counts(text):
    w, text = words(text), text or ""
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def base_failed(text):
    n, *_, repeated = counts(text)
    return n < 50 or 100 * repeated > 50 * n


def fingerprint(text):
    w = [x.encode() for x in words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < 3 else [b" ".join(x) for x in zip(w, w[1:], w[2:])]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_ids(marks, distance=3):
    """doc_id by position; marks: (doc_id, fingerprint) rows."""
    root = list(range(len(marks)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(marks)):
        for b in range(a):
            if (marks[a][1] ^ marks[b][1]).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(marks):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return [least.get(find(k)) for k in range(len(marks))]


def edit_distance_inside(tile, text):
    """Least edits between ``tile`` and any region of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(tile, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)
