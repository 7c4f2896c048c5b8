import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from faultframe.llm import conversations as cv

KIND = "conv_id long, turn long, role string, text string"


def cheapest(symbols):
    """(cost, audit, kept roles) by trying every edit at every place; symbols are (initial, fault)."""

    @cache
    def best(i, roles, inserted):
        found = []
        if re.fullmatch("s?(ua)*u?", roles) is None and roles:
            return [(10**9, "", "")]
        if i == len(symbols):
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((0, "", roles))
        else:
            initial, fault = symbols[i]
            extra = 3 if fault == "truncated" else 0
            found += [(c + 4, "D" + a, r) for c, a, r in best(i + 1, roles, 0)]
            if fault not in ("blank", "duplicate"):
                found += [(c + extra, "K" + a, r) for c, a, r in best(i + 1, roles + initial, 0)]
                for to in "ua":
                    found += [(c + extra + 3, "R" + a, r) for c, a, r in best(i + 1, roles + to, 0)]
        if inserted < 2:
            for to in "ua":
                found += [(c + 3, "I" + a, r) for c, a, r in best(i, roles + to, inserted + 1)]
        return [min(found)] if found else [(10**9, "", "")]

    return best(0, "", 0)[0]


def symbol(initial, fault):
    return cv.GONE if fault in ("blank", "duplicate") else initial.upper() if fault == "truncated" else initial


def test_automaton_finds_the_cheapest_and_least_audit():
    kinds = [(c, f) for c in "suao" for f in ("ok", "truncated")] + [("u", "blank")]
    short = [s for n in range(4) for s in itertools.product(kinds, repeat=n)]
    draw = random.Random(3)
    longer = [tuple(draw.choices(kinds, k=draw.randrange(4, 9))) for _ in range(150)]
    spelled = sorted(("".join(symbol(*s) for s in row), row) for row in short + longer)
    automaton = cv.Suffixes()
    for text, row in sorted(spelled, key=lambda x: x[0][::-1]):
        assert automaton.read(text) == cheapest(row)[:2], text


def test_shared_endings_are_one_node():
    texts = ["".join(t) for n in range(5) for t in itertools.product("sua", repeat=n)]
    automaton = cv.Suffixes()
    for text in sorted(texts, key=lambda t: t[::-1]):
        automaton.read(text)
    assert automaton.made == len(texts) - 1


def test_any_order_gives_the_same():
    draw = random.Random(8)
    texts = ["".join(draw.choices("suaoSUAOx", k=draw.randrange(30))) for _ in range(300)]
    together, alone = cv.Suffixes(), [cv.Suffixes().read(t) for t in texts]
    assert [together.read(t) for t in texts] == alone


def plain(rows, ids):
    """Reports by conversation, row by row in Python; `rows` are damaged and in order."""
    out = {}
    for conv in ids:
        mine, seen, symbols = [(t, r, x) for c, t, r, x in rows if c == conv], set(), []
        for _, role, text in mine:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "ok" if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            symbols.append((role[:1] if role[:1] in tuple("sua") else "o", fault))
        cost, audit, roles = cheapest(tuple(symbols)) if mine else (0, "", "")
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a + b for (a, _), (b, _) in itertools.pairwise(symbols)]
        made, at, left, names = [], 0, iter(roles), {"u": "user", "a": "assistant"}
        for edit in audit:
            if edit == "I":
                made.append(names[next(left)] + ":")
                continue
            if edit != "D":
                initial = next(left)
                made.append((mine[at][1] if edit == "K" else names[initial]) + ":" + mine[at][2])
            at += 1
        count = lambda kind: sum(f == kind for _, f in symbols)
        out[conv] = (
            gaps, count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(made).encode()).hexdigest(), made,
        )
    return out


@pytest.fixture
def made_up(spark):
    draw = random.Random(11)
    texts = ["", " \t\n", "Yes.", "No!", "and so", "Über?\n ", "x. ", "Yes.", "🙂"]
    rows = []
    for conv in range(120):
        turn = draw.randrange(3)
        for _ in range(draw.randrange(9)):
            rows.append((conv, turn, draw.choice(["user", "assistant", "system", "tool", "User", "", "assistant"]), draw.choice(texts)))
            turn += draw.choice([1, 1, 1, 2, 1500])
    return rows


def test_repair_matches_the_plain_way(spark, made_up):
    ids = list(range(125))
    expected = plain(made_up, ids)
    rows = spark.createDataFrame(made_up, KIND).repartition(5)
    made, found = cv.repair(rows, spark.createDataFrame([(i,) for i in ids + ids], "conv_id long"))
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {k: v[:-1] for k, v in expected.items()}
    got = {}
    for r in sorted(made.collect(), key=lambda r: (r.conv_id, r.pos)):
        got.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert got == {k: v[-1] for k, v in expected.items() if v[-1]}


def test_damage(spark, rows):
    given = [(c, t, "system", "a.b!c? d") for c in range(30) for t in range(6)]
    got = rows(cv.damaged(spark.createDataFrame(given, KIND)))
    expected = []
    for c, t, role, text in given:
        n = zlib.crc32(f"{c}:{t}".encode()) % 20
        row = (c, t, "user" if n == 4 else role, "" if n == 1 else "abc d" if n == 2 else text)
        expected += [row] * (0 if n == 0 else 2 if n == 3 else 1)
    assert got == sorted(expected)


def test_nulls_and_further_columns(spark):
    given = [(None, None, None, None), (None, 1, "user", "Hi."), (7, None, "user", "Hi."), (7, 3, "assistant", None), (7, 5, "assistant", "Yes.")]
    rows = spark.createDataFrame(given, KIND).selectExpr("*", "1 AS tie", "'x' AS fault", "2 AS kind", "3 AS n")
    found = {r.conv_id: r for r in cv.repair(rows)[1].collect()}
    assert set(found) == {None, 7}
    assert (found[None].blank, found[None].gaps, found[None].cost, found[None].audit) == (1, 0, 7, "DKI")
    assert (found[7].blank, found[7].gaps, found[7].cost, found[7].audit) == (1, 1, 4, "KDK")
    assert cv.damaged(rows).count() >= 1


def test_long_conversation_and_copies(spark):
    many = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(5000)]
    many += [(c, t, r, x) for c in range(2, 200) for t, r, x in [(0, "user", "Hi."), (1, "assistant", "Yes.")]]
    many += [(200, 4, "user", "Hi.")] * 3000
    many += [(201, 0, "user", "word " * 100_000), (201, 1, "assistant", "Yes.")]
    made, found = cv.repair(spark.createDataFrame(many, KIND).repartition(7))
    got = {r.conv_id: r for r in found.collect()}
    assert got[1].audit == "K" * 5000 and got[1].cost == 0 and got[1].illegal == 0
    assert got[200].duplicate == 2999 and got[200].cost == 4 * 2999 + 3
    assert got[201].truncated == 1 and got[201].cost == 3
    assert all(got[c].audit == "KK" for c in range(2, 200))
    assert made.where("conv_id = 1").count() == 5000


def test_empty_table(spark):
    made, found = cv.repair(spark.createDataFrame([], KIND), spark.createDataFrame([], KIND))
    assert made.count() == 0 and found.count() == 0
