"""Exclusive claims by rounds equal a request-by-request replay."""

import random

import pytest

from tavola.operators.claims import resolve_claims


def replay(requests, held, kinds):
    """The rule itself, one request after the other."""
    holder = [{} for _ in kinds]          # value -> actor
    has = {}
    for actor, *values in held:
        has[actor] = list(values)
        for h, v in zip(holder, values):
            if v is not None:
                h[v] = actor, True
    out = {}
    for seq, actor, can, *values in sorted(requests):
        why = []
        for h, v in zip(holder, values):
            who = h.get(v) if v is not None else None
            why.append(None if who is None or who[0] == actor else "held" if who[1] else "taken")
        ok = bool(can) and not any(why)
        if ok:
            for h, old, new in zip(holder, has.get(actor, [None] * len(kinds)), values):
                if old is not None and old in h and h[old][0] == actor:
                    del h[old]
                if new is not None:
                    h[new] = actor, False
            has[actor] = list(values)
        out[seq] = (ok, *why)
    return out


@pytest.fixture
def chunky(spark):
    """Many small range partitions, so that values lie in several chunks."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def answers(df, kinds):
    return {r["seq"]: (r["accepted"], *[r[f"blocked_{k}"] for k in kinds]) for r in df.collect()}


@pytest.mark.parametrize("seed,values,actors", [(1, 12, 10), (2, 3, 40)])
def test_equals_replay(spark, chunky, seed, values, actors):
    rng = random.Random(seed)
    pick = lambda p: rng.choice([f"{p}{rng.randrange(values)}", f"{p}0", None if rng.random() < 0.3 else f"{p}1"])
    requests = [(s, f"c{rng.randrange(actors)}", rng.random() < 0.9, pick("e"), pick("p")) for s in rng.sample(range(1000), 90)]
    held, free = [], [[f"{p}{i}" for i in range(values)] for p in "ep"]
    for a in range(actors // 2):
        held.append((f"c{a}", *[f.pop(rng.randrange(len(f))) if f and rng.random() < 0.8 else None for f in free]))
    df = spark.createDataFrame(requests, "seq long, actor string, can boolean, email string, phone string")
    h = spark.createDataFrame(held, "actor string, email string, phone string")
    got = answers(resolve_claims(df, ["email", "phone"], h), ["email", "phone"])
    assert got == replay(requests, held, ["email", "phone"])
    assert any(v[0] for v in got.values()) and any("taken" in v for v in got.values())


def test_requests_without_releases(spark, chunky):
    rng = random.Random(9)
    requests = [(s, f"i{s}", True, f"e{rng.randrange(20)}", f"p{rng.randrange(20)}") for s in range(120)]
    df = spark.createDataFrame(requests, "seq long, actor string, can boolean, email string, phone string")
    got = answers(resolve_claims(df, ["email", "phone"], releases=False), ["email", "phone"])
    assert got == replay(requests, [], ["email", "phone"])


def test_long_chain_and_hot_value(spark):
    """Each request loses to the one before, if that one passed; a third asks for one value."""
    requests = [(s, f"i{s}", True, f"e{s // 2}", f"p{(s + 1) // 2}") for s in range(24)]
    requests += [(100 + s, f"h{s}", True, "hot", f"q{s}") for s in range(60)]
    df = spark.createDataFrame(requests, "seq long, actor string, can boolean, email string, phone string")
    got = answers(resolve_claims(df, ["email", "phone"], releases=False), ["email", "phone"])
    assert got == replay(requests, [], ["email", "phone"])
    assert sum(v[0] for v in got.values()) == 13


def test_a_value_given_up_is_free(spark):
    df = spark.createDataFrame([(1, "b", True, "x"), (2, "a", True, "y"), (3, "b", True, "x"), (4, "c", True, "x"),
                                (5, "b", True, None), (6, "c", True, "x")], "seq long, actor string, can boolean, phone string")
    held = spark.createDataFrame([("a", "x")], "actor string, phone string")
    got = answers(resolve_claims(df, ["phone"], held), ["phone"])
    assert got == {1: (False, "held"), 2: (True, None), 3: (True, None), 4: (False, "taken"), 5: (True, None), 6: (True, None)}


def test_no_requests(spark):
    df = spark.createDataFrame([], "seq long, actor string, can boolean, phone string")
    assert resolve_claims(df, ["phone"]).count() == 0
