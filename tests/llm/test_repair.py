"""Conversation repair against every possible edit, and giant conversations in two passes."""

import hashlib
import itertools
import random
import re

import pytest

from pagequarry.llm import repair

COLUMNS = "conv_id long, turn long, role string, text string"
ROLES = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\f\r")
        out.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """The least (cost, audit) over all edits with up to two insertions in each gap, and the turns it gives."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    gap = [""] + list("ua") + [a + b for a in "ua" for b in "ua"]
    choices = []
    for (_, role, text), fault in zip(rows, faults(rows)):
        options = [("D", 4, [])]
        if fault not in ("b", "d"):
            more = 3 if fault == "t" else 0
            options += [("K", more, [(role, text)])] + [("R", 3 + more, [(r, text)]) for r in ROLES.values()]
        choices.append(options)
    best = None
    inserted = lambda g: ("I" * len(g), 3 * len(g), [(ROLES[c], "") for c in g])
    slots = [[inserted(g) for g in gap]]
    for options in choices:
        slots += [options, [inserted(g) for g in gap]]
    for pick in itertools.product(*slots):
        cost, audit = sum(p[1] for p in pick), "".join(p[0] for p in pick)
        if best is None or (cost, audit) < best[:2]:
            out = [t for p in pick for t in p[2]]
            if all(r for r, _ in out) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)):
                best = (cost, audit, out)
    return best


def digest(turns):
    return hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest()


def some(n, length, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "user", "assistant", None, "", "u"]
    texts = ["Hi.", "yes", "", None, "Well! ", "what?\n", "é…", "Hi."]
    return [(c, rng.choice([None, *range(5)]), rng.choice(roles), rng.choice(texts)) for c in range(n) for _ in range(rng.randrange(length + 1))]


def test_cheapest_edits(spark):
    rows = some(60, 3, 1) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes.")]
    got = {r.conv_id: r for r in repair.report(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, found in got.items():
        own = [r[1:] for r in rows if r[0] == conv]
        cost, audit, turns = brute(own)
        assert (found.cost, found.audit, found.repaired_sha256) == (cost, audit, digest(turns)), own
        named = [t for t, _, _ in own if t is not None]
        assert found.gaps == (max(named) - min(named) + 1 - len(set(named)) if named else 0)
        ordered = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in own), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        kinds = faults(ordered)
        assert (found.blank, found.duplicate, found.truncated) == tuple(map(kinds.count, "bdt"))
        assert found.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(ordered))


@pytest.fixture(scope="module")
def long_talks(spark):
    rng = random.Random(5)
    rows = [(1, t // 2, rng.choice(["user", "assistant", "x"]), rng.choice(["A.", "b", "", f"text {t}."])) for t in range(700)]
    rows += some(20, 6, 2) + [(None, t, "user", "same") for t in range(50)]
    return spark.createDataFrame([(c if c != 1 else 100, *r) for c, *r in rows], COLUMNS).repartition(4)


@pytest.mark.parametrize("limits", [{"held_rows": 3, "block": 5}, {"held_rows": 40, "block": 64}, {"held_chars": 30, "block": 1}])
def test_giant_conversations_give_the_same(long_talks, limits):
    want = sorted(map(str, repair.report(long_talks).collect()))
    assert sorted(map(str, repair.report(long_talks, **limits).collect())) == want
    turns = lambda df: [tuple(r)[:1] + tuple(r)[2:] for r in df.orderBy("conv_id", "place").collect()]
    assert turns(repair.repaired(long_talks, **limits)) == turns(repair.repaired(long_talks))


def test_turns_give_the_digest(long_talks):
    turns: dict = {}
    for r in repair.repaired(long_talks).orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    for r in repair.report(long_talks).collect():
        assert r.repaired_sha256 == digest(turns.get(r.conv_id, []))
        assert len(turns.get(r.conv_id, [])) == len(r.audit) - r.audit.count("D")


def test_empty_absent_and_clashing(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.")], COLUMNS)
    assert repair.report(df.limit(0)).collect() == []
    odd = df.selectExpr("*", "true as absent", "'x' as conv", "1 as fault", "2 as block", "'k' as kind", "0 as _nth")
    (only,) = repair.report(odd).collect()
    assert tuple(only) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    texts = spark.createDataFrame([(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "y.")], COLUMNS)
    (only,) = repair.report(texts, held_chars=1_000_000).collect()
    assert (only.cost, only.audit) == (0, "KK")
