import hashlib
import itertools
import random
import re
import zlib

import numpy as np

from voltide.llm import conversation_repair as repair
from voltide.llm.queries import op12_conversation_repair

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            out += [(c, t, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """All edits of up to one more insert than a step needs, whole strings compared: a search by (cost, audit) over (turn, roles so far)."""
    best = {(0, ""): (0, "", ())}  # (turns read, state) -> cost, audit, output

    def better(key, value):
        if key not in best or value[:2] < best[key][:2]:
            best[key] = value

    nxt = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    for i in range(len(rows) + 1):
        for _ in range(3):
            for s in list(nxt):
                if (i, s) in best:
                    cost, audit, out = best[i, s]
                    better((i, nxt[s][0]), (cost + 5, audit + "I", (*out, (nxt[s], ""))))
        if i == len(rows):
            break
        _, _, role, text = rows[i]
        for s in nxt:
            if (i, s) not in best:
                continue
            cost, audit, out = best[i, s]
            better((i + 1, s), (cost + 2, audit + "D", out))
            if found[i] in ("blank", "duplicate"):
                continue
            more = 5 * (found[i] == "truncated")
            if role[:1] == nxt[s][0] or (role[:1] == "s" and s == ""):
                better((i + 1, role[0]), (cost + more, audit + "K", (*out, (role, text))))
            better((i + 1, nxt[s][0]), (cost + more + 1, audit + "R", (*out, (nxt[s], text))))
    return min(best[len(rows), s] for s in ("", "a") if (len(rows), s) in best)


def plain(original):
    out = []
    rows = damage(original)
    for conv in {r[0] for r in original}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        found = faults(own)
        known = [r[1] for r in own if r[1] is not None]
        cost, audit, kept = cheapest(own, found)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        text = "\n".join(f"{role}:{text}" for role, text in kept)
        out.append((conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_rows(seed, conversations, most):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "Hm? ", "", " \n", "ends.\t", None, "é.", "same.", "a long one " * 30 + "."]
    rows = []
    for c in range(conversations):
        for t in range(r.randint(0, most)):
            rows.append((c if r.random() < 0.97 else None, None if r.random() < 0.05 else t * r.randint(1, 2), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(texts) if r.random() < 0.4 else f"text {r.random()}{r.choice(['.', ''])}"))
    rows += rows[:5] + rows[3:4] * 3
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_against_brute_force(spark, monkeypatch):
    rows = random_rows(1, 60, 12)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(repair.repaired(df)) == plain(rows)
    monkeypatch.setattr(repair, "BLOCK", 4)  # conversations in many blocks and tasks
    monkeypatch.setattr(repair, "FLUSH", 20)
    rows = random_rows(2, 25, 12) + [(7, t, "user" if t % 3 else "assistant", f"turn {t}{'.' if t % 5 else ''}") for t in range(300)] + [(8, 3, "user", "the same.")] * 90
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(repair.repaired(df.selectExpr("*", "1 AS kind", "2 AS copies", "3 AS h"))) == plain(rows)


def test_blocks_join_like_one_run():
    r = np.random.default_rng(3)
    turn = r.integers(0, 16, 60)
    cost, rank, edits = repair.solve([turn], [0])
    left, lrank, ledits = repair.solve([turn[:23]], [0])
    right, rrank, redits = repair.solve([turn[23:]] * 4, [0, 1, 2, 3])
    for o in range(4):
        if cost[0, o] < repair.FAR:
            _, _, i = min((left[0, i] + right[i, o], lrank[0, i], i) for i in range(4) if left[0, i] < repair.FAR and right[i, o] < repair.FAR)
            assert left[0, i] + right[i, o] == cost[0, o]
            assert [*ledits[0][:, i], *redits[i][:, o]] == [*edits[0][:, o]]


def test_macro_edits_are_prefix_free():
    assert not any(a != b and b.startswith(a) for a in repair.CODES for b in repair.CODES)


def test_edges(spark):
    assert repair.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert got(repair.repaired(spark.createDataFrame([(5, dropped, "user", "x.")], SCHEMA))) == [(5, 0, 0, 0, 0, 0, 0, "", nothing)]


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op12_conversation_repair(spark, small)) == plain(rows)
