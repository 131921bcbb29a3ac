import hashlib
import itertools
import random
import re
import sys
import zlib
from pathlib import Path

import pytest
from sievework.llm import conversation_repair as cr
from sievework.llm import queries

sys.path.insert(0, str(Path(__file__).parent))
from llm_oracle import agree

SCHEMA = "conv_id long, turn long, role string, text string, audit int"
ROWS = ["s", "u", "a", "t"]


def test_sql(spark, sf_dir_2):
    assert len(agree(queries.op11_conversation_repair(spark, sf_dir_2), queries.OP11_SQL, sf_dir_2)) == 100


def all_edits(rows):
    """Every cheapest edit of (initial, state) rows by trying all, with at most three turns put in at each place."""
    best = {}

    def go(i, roles, letters, cost):
        if i == len(rows):
            for extra in range(3):
                for more in itertools.product("ua", repeat=extra):
                    done = roles + "".join(more)
                    if re.fullmatch("(s?(ua)+)?", done):
                        key = (cost + 2 * extra, letters + "I" * extra)
                        best.setdefault(key, set()).add(done)
            return
        for extra in range(3):
            for more in itertools.product("ua", repeat=extra):
                at, said, paid = roles + "".join(more), letters + "I" * extra, cost + 2 * extra
                initial, state = rows[i]
                go(i + 1, at, said + "D", paid + 3)
                if state != cr.DOOMED:
                    go(i + 1, at + initial, said + "K", paid + (state == cr.CUT_OFF))
                    go(i + 1, at + "u", said + "R", paid + 2 + (state == cr.CUT_OFF))
                    go(i + 1, at + "a", said + "R", paid + 2 + (state == cr.CUT_OFF))

    go(0, "", "", 0)
    return min(best)


@pytest.mark.parametrize("seed", range(60))
def test_cheapest_edits_against_all(seed):
    r = random.Random(seed)
    rows = [(r.choice(ROWS), r.choice([0, 0, 1, 2])) for _ in range(seed % 4)]
    assert cr.cheapest_edits(bytes(cr.code(*x) for x in rows)) == all_edits(rows)


def test_a_long_conversation_takes_linear_time():
    cost, letters = cr.cheapest_edits(bytes([cr.code("u", cr.SOUND), cr.code("a", cr.CUT_OFF)]) * 200_000)
    assert cost == 200_000 and letters == "KK" * 200_000


def replay(rows):
    """One conversation's rows by turn, as the contract says, row by row."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()))
    seen, codes, counts, kept = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        codes.append(cr.code(role[:1], cr.DOOMED if fault in ("blank", "duplicate") else cr.CUT_OFF if fault else cr.SOUND))
    counts["illegal"] = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(rows))
    turns = [x[0] for x in rows if x[0] is not None]
    cost, letters = cr.cheapest_edits(bytes(codes))
    at, roles = iter(rows), ""
    for letter in letters:
        row = None if letter == "I" else next(at)
        if letter == "D":
            continue
        role = row[1] if letter == "K" else "assistant" if roles.endswith("u") else "user"
        roles += role[0]
        kept.append(f"{role}:{row[2] if row else ''}")
    assert re.fullmatch("(s?(ua)+)?", roles)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), cost, letters, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_odd_rows(spark):
    """Nulls, ties, repeated rows, empty and very long texts, a conversation that is dropped, unknown roles; a column that is named like an output."""
    r = random.Random(5)
    rows = [(c, r.choice([None, *range(9), 70]), r.choice(["user", "assistant", "system", "tool", "", None]), r.choice([None, "", " \n", "Yes.", "No", "Yes.", "x" * 300_000 + "!", "é…", "a. "])) for c in [None, *range(30)] for _ in range(r.randrange(1, 9))]
    rows += [(99, 3, "user", "Same.")] * 50
    want = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want[c] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    df = spark.createDataFrame([(*x, 1) for x in rows], SCHEMA)
    got = {x[0]: tuple(x[1:]) for x in cr.audits_with_digest(cr.damage(df)).collect()}
    assert got == {c: replay(x) for c, x in want.items()}
    assert any(not x for x in want.values()) or got
    turns = cr.repair(cr.damage(df)).orderBy("conv_id", "position").collect()
    for c, x in want.items():
        own = [t for t in turns if t["conv_id"] == c]
        assert [t["position"] for t in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in own).encode()).hexdigest() == replay(x)[-1]
    assert cr.audits_with_digest(cr.damage(df.limit(0))).count() == 0


def test_nothing_left_of_a_conversation(spark):
    c, turn = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    row = cr.audits_with_digest(cr.damage(spark.createDataFrame([(c, turn, "user", "A.", 0)], SCHEMA))).collect()
    assert [tuple(x) for x in row] == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
