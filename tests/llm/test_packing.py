import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from pagesift.llm.packing import best_fit_runs, pack_documents

PATH = P.path("word_bpe_49k.json")


def check(rows, out, capacity):
    tok = Tokenizer.from_file(PATH)
    want = []
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            want.append((r[0], k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out], key=key) == sorted(want, key=key)
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for runs in places.values():
        end = 0
        for offset, length in sorted(runs):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_pack_equals_tokenizer_and_best_fit_decreasing(spark, docs_schema):
    rnd = random.Random(3)
    words = ["Über", "don't", "naïve.", "a<|endoftext|>b", "x_y!!", "Ωmega", "12.5%%", "the", "l'été\n", "ﬁne", "thing,"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 9, 20, 45]))), "en", "s", 0) for i in range(300)]
    rows += [(300, None, None, None, None), (None, "the thing", None, None, None), (5, "the", "", "", 0), (5, "the", "", "", 0)]
    out = pack_documents(spark.createDataFrame(rows, docs_schema), PATH, 64).collect()
    n = check(rows, out, 64)
    assert n <= best_fit_decreasing([r.length for r in out], 64)


def test_long_text_extra_columns_empty_table(spark, docs_schema):
    rows = [(1, "alpha beta. " * 60000), (2, "")]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, length int, piece int, offset string")
    check(rows, pack_documents(df, PATH).collect(), 2048)
    assert pack_documents(spark.createDataFrame([], docs_schema), PATH).count() == 0


def test_runs_cover_every_rank_once():
    rnd = random.Random(1)
    for _ in range(50):
        cap = rnd.randint(1, 40)
        lengths = {n: rnd.randint(1, 30) for n in rnd.sample(range(1, cap + 1), rnd.randint(1, cap))}
        order = [n for n in sorted(lengths, reverse=True) for _ in range(lengths[n])]
        runs, used = best_fit_runs(lengths, cap), {}
        for i, n in enumerate(order):
            first, length, each, seq, off = runs[np.searchsorted(runs[:, 0], i, "right") - 1]
            assert length == n
            used.setdefault(seq + (i - first) // each, []).append((off + (i - first) % each * length, length))
        for v in used.values():
            end = 0
            for o, n in sorted(v):
                assert o == end
                end += n
            assert end <= cap
        assert len(used) == best_fit_decreasing(order, cap)
