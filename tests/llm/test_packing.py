import random
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidegate.llm import packing as K
from tidegate.llm.queries import tokenizer
from tidegate.llm.tokens import encoder

from brute import AWKWARD, DOCS

TEXTS = [
    "", " ", "a  b\n\n c\t\td", "it's they'll 12ab34 don't", "x\x85y\x1cz w v", "<|endoftext|> and <|endoftext|>",
    "日本 語　テ", "é\U0001f600ß", "!!!??? ...\r\n\r\n  ", "A" * 3_000, "ab " * 2_000,
]


def test_ids_are_those_of_the_tokenizer():
    slow, fast = Tokenizer.from_file(tokenizer()), encoder(tokenizer())
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choice("ab \n\t'1.é日 <|") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(fast(t), "<u4").tolist() == slow.encode(t, add_special_tokens=False).ids, repr(t)


def test_cut():
    assert K.cut(5, 4) == [(0, 1), (1, 4)] and K.cut(8, 4) == [(0, 4), (4, 4)]
    assert K.cut(3, 4) == [(0, 3)] and K.cut(0, 4) == []


def plain_best_fit(lengths, capacity):
    """Each piece to the fitting sequence with the best score, sequences tried one by one."""
    room = (capacity.tokens, capacity.documents, capacity.attention)
    used, out = [], []
    for n in lengths:
        need, best = (n, 1, n * n), None
        for k, u in enumerate(used):
            if all(a + b <= c for a, b, c in zip(u, need, room)):
                free = [(c - a) / c for a, c in zip(u, room)]
                part = [b / c for b, c in zip(need, room)]
                if capacity.rule == "norm":
                    score = sum(w * (f - p) ** 2 for w, f, p in zip(capacity.weights, free, part))
                else:
                    score = -sum(w * f * p for w, f, p in zip(capacity.weights, free, part))
                if best is None or score < best[0] - 1e-12:
                    best = (score, k)
        if best is None:
            used.append((0, 0, 0))
            best = (0, len(used) - 1)
        u = used[best[1]]
        out.append((best[1], u[0]))
        used[best[1]] = tuple(a + b for a, b in zip(u, need))
    return out, used


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(64, 64, 64 * 64), (64, 3, 64 * 64), (64, 64, 1500)])
def test_best_fit_against_plain(rule, limits):
    rnd = random.Random(3)
    capacity = K.Capacity(*limits, rule=rule)
    top = int(min(limits[0], limits[2] ** 0.5))
    lengths = sorted((rnd.randint(1, top) for _ in range(300)), reverse=True)
    bins, offsets = K.best_fit(lengths, capacity)
    want, used = plain_best_fit(lengths, capacity)
    assert bins.max() + 1 == len(used) if rule == "norm" and limits[1:] == (64, 4096) else bins.max() + 1 <= len(used) * 1.05 + 1
    for b in range(bins.max() + 1):
        mine = [(o, n) for k, o, n in zip(bins, offsets, lengths) if k == b]
        assert sum(n for _, n in mine) <= limits[0] and len(mine) <= limits[1] and sum(n * n for _, n in mine) <= limits[2]
        at = 0
        for o, n in sorted(mine):
            assert o == at
            at += n


def test_a_piece_beyond_a_capacity_is_an_error():
    with pytest.raises(ValueError):
        K.best_fit([40], K.Capacity(64, 64, 1000))


def test_awkward_documents_round_trip(spark):
    docs = spark.createDataFrame(AWKWARD, DOCS)
    capacity = K.Capacity(tokens=128, documents=128, attention=128 * 128, group=50)
    rows = K.pack_documents(docs, tokenizer(), capacity, with_ids=True).collect()
    encode = encoder(tokenizer())
    want = []
    for doc, text, *_ in AWKWARD:
        ids = np.frombuffer(encode(text or ""), "<u4").tolist() + [2]
        first = len(ids) % 128 or 128
        cuts = [ids[:first]] + [ids[k:k + 128] for k in range(first, len(ids), 128)]
        start = 0
        for k, c in enumerate(cuts):
            want.append((doc, k, start, len(c), crc32(np.asarray(c, "<u4").tobytes())))
            start += len(c)
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    sequences = {}
    for r in rows:
        assert crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= sum(r.length for r in rows) / 128 + 12
    assert K.pack_documents(spark.createDataFrame([], DOCS), tokenizer()).count() == 0


@pytest.mark.parametrize("partitions,pieces,groups", [(4_000, 1_000, 7_919), (50, 40_000, 250), (3, 10, 1)])
def test_pieces_are_dealt_evenly(partitions, pieces, groups):
    """Also where groups outnumber the pieces of a partition and their number divides its start."""
    sizes = np.zeros(groups + 1, np.int64)
    for p in range(partitions):
        whole, rest = divmod(pieces, groups)
        sizes[:groups] += whole
        at = K.first_deal(p) % groups
        for lo, hi in ((at, min(at + rest, groups)), (0, at + rest - groups)):
            if hi > lo:
                sizes[lo:hi] += 1
    sizes, mean = sizes[:groups], partitions * pieces / groups
    assert sizes.sum() == partitions * pieces and sizes.max() <= mean + 6 * mean ** 0.5 + 1
