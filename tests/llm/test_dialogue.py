import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from pagesift.llm import dialogue as D

AFTER = {"-": "su", "s": "u", "u": "a", "a": "u"}


def brute_audit(turns):
    """Cheapest (cost, audit) by search over (turn, last role), independent of the alignment tables."""

    @lru_cache(maxsize=None)
    def best(i, state, room):
        ways = [(0, "")] if i == len(turns) and state in "-a" else []
        for role in AFTER[state]:
            if room and role != "s":
                c, a = best(i, role, room - 1)
                ways.append((c + 3, "I" + a))
        if i < len(turns):
            c, a = best(i + 1, state, 3)
            ways.append((c + 4, "D" + a))
            own, extra = turns[i].lower(), 3 if turns[i].isupper() else 0
            for role in AFTER[state]:
                if own == role:
                    c, a = best(i + 1, role, 3)
                    ways.append((c + extra, "K" + a))
                elif own != "x" and role != "s":
                    c, a = best(i + 1, role, 3)
                    ways.append((c + extra + 3, "R" + a))
        return min(ways, default=(10**9, ""))

    return best(0, "-", 3)


def brute(rows, ids):
    """The report from its wording; ``rows`` are (conv_id, turn, role, text) after damage."""
    out = {}
    for cid in ids:
        own = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == cid]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, turns, n = set(), "", [0, 0, 0]
        for _, role, text in own:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            turns += "x" if fault in (0, 1) else initial.upper() if fault == 2 else initial
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        numbers = {t for t, _, _ in own if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit = brute_audit(turns)
        lines, state, at = [], "-", 0
        for edit in audit:
            if edit == "D":
                at += 1
                continue
            role = {"u": "assistant"}.get(state, "user")
            if edit == "I":
                lines.append((role, ""))
            else:
                lines.append((own[at][1] if edit == "K" else role, own[at][2]))
                at += 1
            state = lines[-1][0][0]
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()
        out[cid] = (gaps, *n, illegal, cost, audit, digest)
    return out


def brute_damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x
        out += [(c, t, "user" if hit == 4 else r, x)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def random_turns(rnd, n):
    return "".join(rnd.choice("suaSUAoOx" if rnd.random() < 0.4 else "ua") for _ in range(n))


def test_alignment_equals_search():
    rnd = random.Random(5)
    for k in range(1500):
        turns = random_turns(rnd, rnd.randint(1, 14))
        assert D.align(turns, "-", True)["a"] == brute_audit(turns), turns


def test_composed_chunks_equal_the_whole():
    rnd = random.Random(8)
    for k in range(250):
        turns = random_turns(rnd, rnd.randint(2, 30))
        if k % 5 == 0:
            turns = "x" * rnd.randint(3, 9) + rnd.choice(["s", "S", "o"]) + turns
        cuts = sorted(rnd.sample(range(1, len(turns)), rnd.randint(1, min(6, len(turns) - 1))))
        parts = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, len(turns)])]
        tables = [D.chunk_table(p, i + 1 == len(parts)) for i, p in enumerate(parts)]
        while len(tables) > 1:
            tables = [D.compose(tables[i : i + 3]) if len(tables[i : i + 3]) > 1 else tables[i] for i in range(0, len(tables), 3)]
        assert tables[0][3] >> 2 == brute_audit(turns)[0]
        tables = [D.chunk_table(p, i + 1 == len(parts)) for i, p in enumerate(parts)]
        cost, states = D.route(tables, 0, 3)
        audit = "".join(D.align(p, D.STATES[a], i + 1 == len(parts))[D.STATES[b]][1] for i, (p, a, b) in enumerate(zip(parts, states, states[1:])))
        assert (cost, audit) == brute_audit(turns), parts


SCHEMA = "conv_id long, turn long, role string, text string, key string, pos int"


def conversations(rnd, sizes):
    rows = []
    for c, n in enumerate(sizes):
        for t in range(n):
            role = rnd.choice(["user", "assistant"]) if rnd.random() < 0.2 else "ua"[t % 2] + "x" if rnd.random() < 0.1 else ("user", "assistant")[t % 2]
            if t == 0 and rnd.random() < 0.3:
                role = "system"
            text = rnd.choice(["Yes.", "no", "What?", " \t", "Ünd so!\n", "a.b"]) + rnd.choice(["", f" {t}.", f" {t} "])
            rows.append((c, t + (t > 5), rnd.choice([role] * 30 + [None, "", "Über"]), rnd.choice([text] * 30 + [None, ""])))
    return rows


@pytest.mark.parametrize("chunk,fan", [(64, 64), (4, 3)])
def test_report_equals_brute_force(spark, monkeypatch, chunk, fan):
    """With small chunks most conversations go through several levels of composed tables."""
    monkeypatch.setattr(D, "CHUNK", chunk)
    monkeypatch.setattr(D, "FAN", fan)
    rnd = random.Random(3)
    rows = conversations(rnd, [0, 1, 2, 5, 6, 8, 8, 9, 3, 90, 130, 4, 7] + [rnd.randint(1, 12) for _ in range(60)])
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (500, None, "user", "A."), (500, None, "assistant", "B."), (500, 3, "user", "C."),
             (501, 7, "user", "same."), (501, 7, "user", "same."), (502, 1, "user", "long word. " * 30000), (502, 2, "assistant", "x" * 100000),
             (503, -(2**62), "user", "far."), (503, 2**62, "assistant", "away."), (504, 2, "user", " ")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA).repartition(5)
    damaged = brute_damage(rows)
    got = [tuple(r) for r in D.repair_report(df, D.damage(df)).collect()]
    ids = {r[0] for r in rows}
    want = brute(damaged, ids)
    assert len(got) == len(ids)
    assert {r[0]: r[1:] for r in got} == want


def test_repaired_turns_are_well_formed(spark):
    df = spark.createDataFrame([(*r, "k", 1) for r in conversations(random.Random(11), [7] * 40 + [200])], SCHEMA)
    faults, repaired = D.repair(df)
    whole = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.key, r.chunk)):
        whole[r.key] = whole.get(r.key, "") + "".join(t.role[0] for t in r.turns)
    assert len(whole) == faults.count() == 41
    assert all(re.fullmatch("(s?(ua)+)?", w) for w in whole.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert D.repair_report(df, D.damage(df)).count() == 0
