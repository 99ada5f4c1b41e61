"""Conversation repair: all edit strings of short conversations by force, a long one, odd rows, and audits that grow in blocks."""

import itertools
import random
import re
import time

import pytest

from voxframe.llm import repair
from voxframe.llm.repair import BLANK, DUPLICATE, SOUND, TRUNCATED, cheapest_edits

SCHEMA = "conv_id long, turn long, role string, text string, cost long"


def by_force(turns, most_inserts):
    """Least (cost, audit) over all ways to edit every turn and to insert up to so many."""
    found = []
    for inserts in range(most_inserts + 1):
        for places in itertools.combinations_with_replacement(range(len(turns) + 1), inserts):
            for edits in itertools.product("KRrD", repeat=len(turns)):
                for roles in itertools.product("ua", repeat=inserts):
                    made, audit, cost, offered = [], "", 0, list(zip(places, roles, strict=True))
                    for i in range(len(turns) + 1):
                        for _, role in [x for x in offered if x[0] == i]:
                            made.append(role)
                            audit += "I"
                            cost += 5
                        if i < len(turns):
                            initial, fault = turns[i]
                            edit = edits[i]
                            audit += edit.upper()
                            if edit == "D":
                                cost += 2
                                continue
                            if fault in (BLANK, DUPLICATE):
                                break
                            cost += 5 * (fault == TRUNCATED) + (edit != "K")
                            made.append({"K": initial, "R": "u", "r": "a"}[edit])
                    else:
                        if re.fullmatch("(s?(ua)+)?", "".join(made)):
                            found.append((cost, audit, "".join(made)))
    return min(found)


@pytest.mark.parametrize("seed", range(40))
def test_equals_all_edits(seed):
    rng = random.Random(seed)
    turns = [(rng.choice(["s", "u", "a", "u", "a", "t", " ", ""]), rng.choice([SOUND, SOUND, SOUND, TRUNCATED, BLANK, DUPLICATE])) for _ in range(rng.randint(0, 4))]
    cost, audit, made = by_force([(i or "?", f) for i, f in turns], 2)
    got = cheapest_edits(turns)
    assert (got[0], got[1]) == (cost, audit)
    assert "".join((role or turns[i][0])[0] for i, role in got[2]) == made


def test_audits_are_compared_as_strings(monkeypatch):
    monkeypatch.setattr(repair._Audit, "BLOCK", 3)
    rng, made = random.Random(1), [(repair._Audit(), "")]
    for _ in range(400):
        a, s = rng.choice(made)
        letter = rng.choice("DIKR" if rng.random() < 0.3 else "K")
        made.append((a.then(letter), s + letter))
    assert all(str(a) == s for a, s in made)
    for a, s in rng.sample(made, 150):
        for b, t in rng.sample(made, 40):
            assert (a < b) == (s < t)


def test_a_conversation_of_many_turns():
    rng = random.Random(9)
    turns = [(rng.choice("uuaas"), rng.choice([SOUND, SOUND, TRUNCATED, BLANK])) for _ in range(20_000)]
    began = time.perf_counter()
    cost, audit, stays = cheapest_edits(turns)
    assert time.perf_counter() - began < 60 and len(audit) >= 20_000 and cost > 0
    assert re.fullmatch("s?(ua)+", "".join((role or turns[i][0])[0] for i, role in stays))


def test_faults_and_texts(spark):
    rows = [
        (1, 3, "user", "Hi.", 0), (1, 4, "assistant", "Hello!", 0), (1, 4, "assistant", "Hello!", 0), (1, 7, "user", "and", 0),
        (2, None, None, None, 0), (2, 1, "assistant", "Fine.", 0), (None, 1, "user", "Who?", 0), (None, 2, "user", "Me.", 0), (3, None, "system", "\x1c", 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: r for r in repair.repair_conversations(df).collect()}
    assert got[1][1:8] == (2, 0, 1, 1, 1, 4, "KKDD") and [tuple(t) for t in got[1]["repaired"]] == [("user", "Hi."), ("assistant", "Hello!")]
    assert got[2][1:8] == (0, 1, 0, 0, 1, 4, "DD")
    assert got[None][1:8] == (0, 0, 0, 0, 1, 1, "KR") and got[None]["repaired"][1]["role"] == "assistant"
    assert got[3]["truncated"] == 1 and got[3]["audit"] == "D"
    assert repair.repair_conversations(df.limit(0)).collect() == []


def test_damage_keeps_every_conversation(spark):
    rows = [(i, t, "user" if t % 2 else "assistant", f"Text {t}. And!", 0) for i in range(60) for t in range(2)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    hurt = repair.damaged(df).collect()
    assert {r["conv_id"] for r in hurt} == {*range(60), None} and any(r["gone"] for r in hurt) and len(hurt) > len(rows)
    got = {r["conv_id"]: r for r in repair.repair_conversations(repair.damaged(df)).collect()}
    assert set(got) == {*range(60), None}
    empty = {r["conv_id"] for r in hurt} - {r["conv_id"] for r in hurt if not r["gone"]}
    assert all(tuple(got[i][1:8]) == (0, 0, 0, 0, 0, 0, "") for i in empty)
