"""Resampling, line deduplication and tokenizer alignment against brute force and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from loomgraph.llm import alignment, line_dedup, resampling
from tests.llm.test_operators import ODD, SCHEMA, make, words

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"

#: Shared and repeated lines, line breaks of every kind, and lines of one and two words.
LINES = [
    (20, "Shared line one\nown line of twenty\n\nSHARED LINE ONE \n", "a"),
    (21, "\tshared line one\x0b\nshort\nown line of 21", "a"),
    (22, "Shared Line One", "b"),
    (23, "Ünïcödé lïné\nünïcödé lïné", "b"),
    (24, "Ünïcödé lïné\n123456789\n123456789 ", "b"),
    (25, "123456789\n" * 3 + "a\nb c\nd e f\ng h", "b"),
    (26, "\n".join(words(i % 7, 1 + i % 9) for i in range(3_000)), "b"),
    (27, "\n".join(words(i % 5, 1 + i % 9) for i in range(300)), "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return make(spark, ODD + LINES).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


# 12: lines


def kept_lines(rows, least_docs=2):
    def key(line):
        return line.strip(SPACE).translate(LOWER)

    holders = collections.defaultdict(set)
    for i, text, _ in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < least_docs or min(holders[key(x)]) == i]
        out.append((i, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least_docs", [2, 3])
def test_repeated_lines_against_brute_force(odd, least_docs):
    got = line_dedup.drop_repeated_lines(odd, least_docs=least_docs)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
    rows = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=repr)
    assert rows == kept_lines(ODD + LINES, least_docs)
    assert any(r[3] and r[1] for r in rows)


def test_line_digests_of_odd_rows(odd, none):
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_digests(odd).collect()), key=repr)
    assert got == sorted(((i, n, d, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, n, d in kept_lines(ODD + LINES)), key=repr)
    assert line_dedup.line_digests(none).count() == 0


def test_line_columns_that_clash(spark):
    rows = [(1, "a common line here", 5, 6, 7, 8), (2, "a common line here\nrest", 50, 60, 70, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, version int, places int, places_id int")
    got = sorted(map(tuple, line_dedup.drop_repeated_lines(docs).collect()))
    assert got == [(1, "a common line here", 5, 6, 7, 8, 1, 0), (2, "rest", 50, 60, 70, 80, 2, 1)]


# 11: resampling


def sampled(rows, target, percent=5, least=20):
    cut = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def features(text):
        w = cut.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    held = [(i, *features(t)) for i, t, _ in rows]
    s, t = collections.Counter(b for h in held for b in h[2]), collections.Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, n, found in held:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in found)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, n])
    may = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_resampling_against_brute_force(spark, odd):
    rows = ODD + LINES
    target = [words(1, 60), None, "", "b c\nd e f", "漢字 ÄÖ"]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.importance_sample(odd, wanted, percent=40)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    # Rows that share an id tie; either may have the lesser rank.
    assert found == sampled(rows, target, 40) and any(r[4] for r in found)


def test_resampling_of_nothing(spark, odd, none):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampling.importance_sample(none, target).count() == 0
    found = sorted((tuple(r) for r in resampling.importance_sample(odd, target.limit(0)).collect()), key=repr)
    assert found == sampled(ODD + LINES, [])


def test_runs_have_the_crc_of_their_joined_words():
    draw = random.Random(3)
    ws = [bytes(draw.choice(b"abc\xc3\xa9") for _ in range(draw.choice([1, 3, 63, 64, 65, 200, 5_000, 140_000]))) for _ in range(60)]
    for k, crc in enumerate(resampling.Crcs().runs(ws)):
        assert crc.tolist() == [zlib.crc32(b" ".join(ws[i : i + k + 1])) for i in range(len(ws) - k)]


def test_a_line_that_occurs_often_is_cut_once(spark, monkeypatch):
    docs = make(spark, [(i, "one line that all have\n" + str(i), "a") for i in range(200)]).select("text")
    assert {r.text: r.n for r in resampling.distinct_lines(docs).where("n > 1").collect()} == {"one line that all have": 200}


# 13: alignment


def test_alignment_against_brute_force(spark, odd):
    letters = alignment.byte_letters()
    ta, tb = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    extra = [(40, "  two  spaces　<|endoftext|> </s> it's we'LL 12³ x²\xa0y ½\x1c\x85", "a"), (41, "▁ keeps no byte", "a"), (42, "🙂" * 50 + "zzqqxxjj" * 40, "a")]
    rows = ODD + LINES + extra

    def of_a(i):
        return bytes(letters[c] for c in ta.id_to_token(i))

    def of_b(i):
        return bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()

    held, count = [], collections.Counter()
    for i, text, _ in rows:
        whole = (" " + (text or "")).encode()
        a, b = (ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)) if text else ([], [])
        if not text or b"".join(map(of_a, a)) != whole or b"".join(map(of_b, b)) != whole:
            a, b = [], []
        ends = [np.cumsum([len(f(k)) for k in ids]).astype(int).tolist() for f, ids in ((of_a, a), (of_b, b))]
        groups, x, y = [], 0, 0
        at_a, at_b = ({end: k + 1 for k, end in enumerate(e)} for e in ends)
        for end in sorted(at_a.keys() & at_b.keys()):
            p, q = at_a[end], at_b[end]
            groups.append((a[x:p], b[y:q]))
            x, y = p, q
        links = [(u, v) for p, q in groups for u in p for v in q]
        count.update(set(links))
        held.append((i, a, b, groups, links))
    best = collections.Counter()
    for (u, _), n in count.items():
        best[u] = max(best[u], n)
    wanted = []
    for i, a, b, groups, links in held:
        told = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        n_best, total = sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links)
        wanted.append((i, len(a), len(b), len(groups), len(links), n_best, total, hashlib.sha256(told.encode()).hexdigest() if groups else "", told))
    docs = odd.unionByName(make(spark, extra))
    for most in (10, 1_000_000):
        got = alignment.alignments(docs, A, B, keep_groups=True, most_pairs=most)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)
    assert any(r[3] < r[1] for r in wanted) and next(r for r in wanted if r[0] == 41)[1] == 0


def test_alignment_of_nothing(none):
    assert alignment.alignments(none, A, B).count() == 0


def test_groups_end_where_both_end():
    draw = random.Random(5)
    for n in [1, 2, 3, 50, 400, 5_000] * 4:
        share = draw.random()
        a = sorted({n, *(k for k in range(1, n) if draw.random() < share)})
        b = sorted({n, *(k for k in a if draw.random() < 0.95), *(k for k in range(1, n) if draw.random() < 0.05)})
        p, q = alignment.group_ends(np.array(a), np.array(b))
        both = sorted(set(a) & set(b))
        assert [a[i - 1] for i in p] == both == [b[j - 1] for j in q]


def test_large_groups_are_counted_by_id(monkeypatch):
    a, b = np.array([1, 2, 1, 7]), np.array([5, 5, 6, 9])
    whole = alignment.linked(a, b, np.array([3, 4]), np.array([3, 4]))
    monkeypatch.setattr(alignment, "_WRITTEN", 2)
    by_id = alignment.linked(a, b, np.array([3, 4]), np.array([3, 4]))
    assert whole[2] == by_id[2] == 10 and whole[0].tolist() == by_id[0].tolist() and whole[1].tolist() == by_id[1].tolist() == [4, 2, 2, 1, 1]


def test_parts_are_encoded_as_whole_texts_are():
    pair = alignment.Pair(A, B)
    assert pair.cuts
    draw = random.Random(9)
    letters = [*map(chr, [*range(9, 14), *range(32, 127), *range(0xA0, 0x250)]), " a", " Z", "\n", "'s", "'ll", "a", "7", "die", "."]
    texts = [" " + "".join(draw.choice(letters) for _ in range(draw.choice([3, 60]))) for _ in range(1_500)]
    texts += ["", " ", "\n \n", "   a", " a ", " a  b", " it's", " 'send it'll", " a\n b", " x.\n\nY"] + [" " + " ".join(words(k, 30).title() for _ in range(3)) for k in range(50)]
    texts = [" " + t.lstrip(" ") for t in texts]
    got = [None if ids is None else [k.tolist() for k in ids] for ids in pair.encode(texts)]
    pair.cuts = False
    assert got == [None if ids is None else [k.tolist() for k in ids] for ids in pair.encode(texts)]
    assert sum(pair.WHOLE.search(t) is None for t in texts) > 100
