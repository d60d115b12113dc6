import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skein.llm.packing import pack, plan
from skein.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


def real(t):
    return np.array(TOK.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aé'sT  \n.,1<|>́İß")), max_size=30))
def test_ids_equal_the_tokenizers(t):
    assert WordTokenizer(PATH).ids(t.encode()) == real(t)


def test_ids_on_words():
    w = WordTokenizer(PATH, words=3, pieces=3)
    for t in ("it's DON'T o'clock we'LL 'S", "Élan vital, 12 <|endoftext|>x", "annd,!! a_b [x] naïve", "ÀÉÎ ×÷ ÿß", "a" * 300):
        assert w.ids(t.encode()) == real(t)


def test_caches_are_bounded_and_change_nothing():
    w = WordTokenizer(PATH, words=5, pieces=4)
    rng = random.Random(5)
    for _ in range(500):
        t = "".join(rng.choice("abÉßÿªµº×'sTd \n.,1<|>İſK中") for _ in range(rng.randrange(24)))
        assert w.ids(t.encode()) == real(t)
        assert len(w.words) <= 5 and len(w.pieces) <= 4
    assert w.ids(b"x" * 65) == real("x" * 65) and not any(len(k) > 64 for c in (w.words, w.pieces) for k in c)


def brute(lengths, cap):
    """Best-fit decreasing, one piece at a time: number of sequences."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(cap - n)
    return len(gaps)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for k in range(60):
        cap = rng.choice([5, 16, 40])
        lengths = [min(cap, rng.randrange(1, cap + 1) if k % 2 else int(rng.expovariate(0.2)) + 1) for _ in range(rng.randrange(0, 80))]
        counts = np.bincount(lengths, minlength=cap + 1) if lengths else np.zeros(cap + 1, int)
        seqs, given_ranks = {}, {}
        for n, rank, take, seq, at in plan(counts, cap):
            for i in range(take):
                seqs.setdefault(seq + i, []).append((at, n))
                given_ranks.setdefault(n, []).append(rank + i)
        assert all(sorted(r) == list(range(counts[n])) for n, r in given_ranks.items())
        for s in seqs.values():
            end = 0
            for at, n in sorted(s):
                assert at == end
                end += n
            assert end <= cap
        assert len(seqs) == brute(lengths, cap)


def test_pack(spark):
    rng = random.Random(1)
    texts = ["", None, "x", "one two three", "one two three", "w " * 9000] + [" ".join(rng.choice(["the", "Été", "zq9", "of."]) for _ in range(rng.randrange(600))) for _ in range(120)]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, "x", 7), (2, "x", 7)], "doc_id long, text string, length int").repartition(5)
    got = pack(df, capacity=256).collect()
    for i, t in enumerate(texts):
        ids = real(t or "") + np.array([1], "<u4").tobytes()
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        if i == 2:
            assert len(own) == 2
            continue
        assert b"".join(ids[4 * r.start : 4 * (r.start + r.length)] for r in own) == ids
        assert all(r.length == 256 for r in own[:-1]) and [r.piece for r in own] == list(range(len(own)))
        assert all(zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in own)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        end = 0
        for at, n in sorted(s):
            assert at == end
            end += n
        assert end <= 256
    assert len(seqs) == brute([r.length for r in got], 256)
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
