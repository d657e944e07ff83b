"""Conversation repair against brute force, at block sizes that force fix-up passes."""

import hashlib
import random
import re
import zlib

import pytest

from tavola.llm import turn_repair as T

SCHEMA = "conv_id long, turn long, role string, text string, conv string, H string, block int"
WS = "\x20\x09-\x0D"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None, 1) for r in rows], SCHEMA)


def brute(rows):
    """The report of one conversation's ``(turn, role, text)`` rows, in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.findall(f"[^{WS}]", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else
                      "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))

    def ok(initials):
        return re.fullmatch("(s?(ua)+)?", initials)

    # At most two insertions in a row are ever useful; states are explored with that bound.
    def search(i, last, free):
        key = (i, last, free)
        if key in memo:
            return memo[key]
        expected = "a" if last == "u" else "u"
        out = []
        if i == len(rows) and last in ("", "a"):
            out.append((0, "", ()))
        options = []
        if i < len(rows):
            _, role, text = rows[i]
            options.append((3, "D", last, (), i + 1, 2))
            if faults[i] not in ("blank", "duplicate"):
                more = int(faults[i] == "truncated")
                name = {"u": "user", "a": "assistant"}[expected]
                if role[:1] == expected or role[:1] == "s" and last == "":
                    options.append((more, "K", role[:1], ((role, text),), i + 1, 2))
                options.append((2 + more, "R", expected, ((name, text),), i + 1, 2))
        if free:
            options.append((2, "I", expected, (({"u": "user", "a": "assistant"}[expected], ""),), i, free - 1))
        for cost, letter, new, made, j, left in options:
            rest = search(j, new, left)
            if rest:
                out.append((cost + rest[0], letter + rest[1], made + rest[2]))
        memo[key] = min(out) if out else None
        return memo[key]

    memo = {}
    cost, audit, made = search(0, "", 2)
    assert ok("".join(r[:1] for r, _ in made))
    initials = [r[1][:1] for r in rows]
    turns = [t for t, _, _ in rows if t is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


def in_order(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return sorted(rows, key=key)


def report(df):
    cols = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv"]: tuple(r[c] for c in cols) for r in df.collect()}


def random_rows(rng, conv, n, roles):
    out = []
    for t in range(n):
        role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
        out.append((conv, rng.choice([t, t, t, t // 2, None]), role, rng.choice(["a.", "b!", "c", " ", "", "d?", "e %d." % t, "f %d" % t])))
    return out


def test_the_brute_force_itself():
    assert brute([(0, "user", "a."), (1, "assistant", "b.")])[5:7] == (0, "KK")
    assert brute([(0, "user", "a.")])[5:7] == (2, "KI")
    assert brute([(0, "system", "a.")])[5:7] == (3, "D")
    assert brute([])[5:] == (0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("size", [1, 3, 7, 4096])
def test_report_equals_brute_force(spark, size):
    rng = random.Random(size)
    rows = []
    for conv in [*range(60), None]:
        rows += random_rows(rng, conv, rng.randrange(1, 9), ["user", "assistant", "system", "tool", " ", "a"])
    rows += random_rows(rng, 1000, 90, ["user", "assistant"])                  # one long conversation
    rows += [(2000, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(41)]  # nothing to repair but its end
    rows += [(3000, None, "user", "same.")] * 5
    got = report(T.repair_report(frame(spark, rows), size=size))
    convs = {}
    for c, *r in rows:
        convs.setdefault(c, []).append(tuple(r))
    assert set(got) == set(convs)
    for c, rs in convs.items():
        assert got[c] == brute(in_order(rs)), c


def test_fix_up_passes_travel_far(spark):
    """A conversation that alternates for many blocks hands the end's costs all the way."""
    rows = [(1, i, ("assistant", "user")[i % 2], f"t{i}.") for i in range(120)]
    rows += [(1, 120 + i, "user", f"x{i}") for i in range(3)]
    assert report(T.repair_report(frame(spark, rows), size=2))[1] == brute(in_order([r[1:] for r in rows]))


def test_rerun_stops_at_a_constant_difference():
    rng = random.Random(1)
    rows = "".join(rng.choice("abcdefghijklmnop") for _ in range(300))
    for old in [(0, 4, 2, 0), (2, 0, 0, 2), (0, 2, 0, 2)]:
        for new in [(0, 0, 0, 0), (1, 0, 2, 2)]:
            assert T.rerun(rows, old, new, T.before_all(rows, old)) == T.before_all(rows, new)


def damage(rows):
    out = []
    for c, t, role, text in rows:
        blank = lambda v: " " if v is None else v
        draw = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        role, text = blank(role), blank(text)
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(c, t, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for c in [*range(150), None]:
        rows += [(c, t, rng.choice(["user", "assistant", None, "", "system"]) if rng.random() < 0.2 else ("user", "assistant")[t % 2],
                  rng.choice([None, "", "a.", "b", "Ünï?\n ", f"t{t}!"])) for t in range(rng.randrange(1, 8))]
    rows += [(500, None, "user", "a."), (500, None, "assistant", "b.")]
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r)[1:] for r in T.op12_turn_repair(spark, str(tmp_path)).collect()}
    convs = {c: [] for c, *_ in rows}
    for c, *r in damage(rows):
        convs[c].append(tuple(r))
    assert any(not v for v in convs.values())
    assert got == {c: brute(in_order(rs)) for c, rs in convs.items()}


def test_repaired_turns_are_well_formed(spark):
    rng = random.Random(2)
    rows = [r for c in range(40) for r in random_rows(rng, c, rng.randrange(1, 12), ["user", "assistant", "system"])]
    out = {}
    for r in sorted(T.repaired_turns(frame(spark, rows), size=3).collect(), key=lambda r: (r["conv"], r["place"])):
        out.setdefault(r["conv"], []).append(r)
    want = report(T.repair_report(frame(spark, rows)))
    for c, rs in out.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in rs))
        assert [r["place"] for r in rs] == list(range(1, len(rs) + 1))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in rs).encode()).hexdigest() == want[c][-1]


def test_no_rows(spark):
    assert T.repair_report(frame(spark, [])).count() == 0
    empty = T.repair_report(frame(spark, []), spark.createDataFrame([(7,)], "conv long"))
    assert report(empty) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
