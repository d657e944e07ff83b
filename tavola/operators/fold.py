"""Skew-safe sequential state machine over request batches (a parallel scan).

The source system applies requests one at a time, so a request's verdict
depends on the requests for the same key that were accepted before it. Over a
finite state space each request is a function ``state -> state`` (stored as an
``array<int>``) and function composition is associative, so the per-key fold
becomes a parallel prefix scan:

* requests get a dense global position (distributed sort, see
  ``with_row_number``);
* up-sweep: positions are cut into chunks of at most ``width`` requests; each
  (key, chunk) composes its members' functions. Chunks of chunks repeat this
  until one node per key remains (about ``log_width(N)`` levels);
* down-sweep: each node's start state (the key's current state at the top)
  is pushed to its children by an exclusive prefix over at most ``width``
  members.

No group ever holds more than ``width`` rows, so a key that owns a third of
all requests is spread over many tasks instead of one. Keys with at most
``width`` requests (the usual case) skip the scan: they are folded directly,
one bounded group per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.session import reliable_checkpoint

from tavola.functions.keys import with_row_number
from tavola.schema import OTHER


def _compose(acc: Column, f: Column) -> Column:
    """(acc then f)[s] = f[acc[s]] (1-based element_at)."""
    return F.transform(acc, lambda a: F.element_at(f, a + 1))


def _allowed_map(n_states: int, allowed: dict[int, list[int]]) -> Column:
    """Literal map: state index -> indexes of the states it may move to."""
    def targets(s):
        vals = allowed.get(s, [])
        return F.array(*[F.lit(v) for v in vals]) if vals else F.array().cast("array<int>")
    return F.create_map(*[x for s in range(n_states) for x in (F.lit(s), targets(s))])


def _state_function(target_idx: Column, n_states: int, allowed: dict[int, list[int]]) -> Column:
    """Function of one request: go to ``target`` when allowed from s, else stay."""
    amap = _allowed_map(n_states, allowed)
    return F.transform(F.sequence(F.lit(0), F.lit(n_states - 1)),
                       lambda s: F.when(target_idx.isNotNull()
                                        & F.array_contains(F.element_at(amap, s), target_idx), target_idx).otherwise(s))


def _prefix_starts(members: Column, start: Column, fn_field: str) -> Column:
    """Exclusive prefix of states over sorted ``members``: state before each one."""
    init = F.struct(start.alias("s"), F.array().cast("array<int>").alias("out"))
    folded = F.aggregate(
        members, init,
        lambda acc, m: F.struct(F.element_at(m[fn_field], acc["s"] + 1).alias("s"),
                                F.concat(acc["out"], F.array(acc["s"])).alias("out")))
    return folded["out"]


def _allowed_index(states: list[str], allowed_pairs):
    names = list(states) + [OTHER]
    n = len(names)
    idx = {s: i for i, s in enumerate(names)}
    allowed: dict[int, list[int]] = {}
    for a, b in allowed_pairs:
        allowed.setdefault(idx.get(a, n - 1), []).append(idx[b])
    return names, n, idx, allowed


def fold_transitions(requests: DataFrame, key: str, seq: str, target: str, initial: DataFrame,
                     states: list[str], allowed_pairs, width: int = 512) -> DataFrame:
    """Apply ``requests`` (key, seq, target, ...) in ``seq`` order per key.

    Keys with at most ``width`` requests are folded directly, one bounded
    group per key. Only when some key has more (a hot key) do those keys go
    through the parallel scan (``_scan_transitions``); one small job decides.
    Returns the requests with ``state_before``, ``state_after``, ``accepted``.
    """
    counts = requests.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > width).select(key)
    if hot.limit(1).count() == 0:
        return _direct_transitions(requests, key, seq, target, initial, states, allowed_pairs)
    cols = requests.columns  # the row order below depends on the order of columns
    small = requests.join(counts.filter(F.col("_n") <= width).select(key), key, "left_semi").select(*cols)
    big = requests.join(hot, key, "left_semi").select(*cols)
    return _direct_transitions(small, key, seq, target, initial, states, allowed_pairs).unionByName(
        _scan_transitions(big, key, seq, target, initial, states, allowed_pairs, width))


def _order(seq: str, req_cols) -> list:
    """One total order for both ways of folding: ``seq`` (NULL last), then the row."""
    return [F.col(seq).isNull().alias("z"), F.col(seq).alias("e"), F.struct(*[F.col(c) for c in req_cols]).alias("row")]


def _direct_transitions(requests: DataFrame, key: str, seq: str, target: str, initial: DataFrame,
                        states: list[str], allowed_pairs) -> DataFrame:
    """Per-key fold for keys whose request count is known to be bounded."""
    names, n, idx, allowed = _allowed_index(states, allowed_pairs)
    name_of = F.array(*[F.lit(s) for s in names])
    index_map = F.create_map(*[x for s in states for x in (F.lit(s), F.lit(idx[s]))])
    req_cols = requests.columns
    tgt = F.when(F.col(target).isNotNull(), F.try_element_at(index_map, F.col(target)))
    init = initial.select(F.col(initial.columns[0]).alias("_k"),
                          F.coalesce(F.when(F.col(initial.columns[1]).isNotNull(),
                                            F.try_element_at(index_map, F.col(initial.columns[1]))),
                                     F.lit(n - 1)).alias("_s"))
    groups = (requests.select(F.col(key).alias("_k"), F.struct(*_order(seq, req_cols),
                                                                _state_function(tgt, n, allowed).alias("f"))
                              .alias("_m"))
              .groupBy("_k").agg(F.array_sort(F.collect_list("_m")).alias("_m"))
              .join(init, "_k", "left").withColumn("_s", F.coalesce(F.col("_s"), F.lit(n - 1))))
    out = (groups.select(F.explode(F.arrays_zip(F.col("_m"), _prefix_starts(F.col("_m"), F.col("_s"), "f")
                                                .alias("st"))).alias("_z"))
           .select("_z._m.row.*", F.col("_z.st").alias("_before"), F.col("_z._m.f").alias("_f")))
    return _finish(out, req_cols, target, n, allowed, name_of, index_map)


def _finish(out: DataFrame, req_cols, target: str, n: int, allowed, name_of, index_map) -> DataFrame:
    tgt = F.when(F.col(target).isNotNull(), F.try_element_at(index_map, F.col(target)))
    after = F.element_at(F.col("_f"), F.col("_before") + 1)
    accepted = F.coalesce(F.array_contains(F.element_at(_allowed_map(n, allowed), F.col("_before")), tgt), F.lit(False))
    return out.select(*req_cols,
                      F.element_at(name_of, F.col("_before") + 1).alias("state_before"),
                      F.element_at(name_of, after + 1).alias("state_after"),
                      accepted.alias("accepted"))


def _scan_transitions(requests: DataFrame, key: str, seq: str, target: str, initial: DataFrame,
                      states: list[str], allowed_pairs, width: int = 512) -> DataFrame:
    """Parallel prefix scan over global positions (for hot keys).

    ``initial`` gives (key, state) before the batch; ``states`` lists the
    state names (an unknown current state maps to an extra "other" index);
    ``allowed_pairs`` is the set of (from, to) names that are accepted. A
    request is accepted when (state before it, target) is allowed; accepted
    requests move the state.
    """
    names, n, idx, allowed = _allowed_index(states, allowed_pairs)
    name_of = F.array(*[F.lit(s) for s in names])
    index_map = F.create_map(*[x for s in states for x in (F.lit(s), F.lit(idx[s]))])

    req_cols = requests.columns
    numbered = with_row_number(requests, _order(seq, req_cols), "_pos")
    total = numbered.agg(F.max("_pos")).first()[0] or 0
    levels = 1
    while width ** levels < total:
        levels += 1

    tgt = F.when(F.col(target).isNotNull(), F.try_element_at(index_map, F.col(target)))
    lvl0 = numbered.select(F.col(key).alias("_k"), (F.col("_pos") - 1).alias("_e"),
                           _state_function(tgt, n, allowed).alias("_f"),
                           F.struct(*[F.col(c) for c in req_cols]).alias("_row"))

    # Up-sweep: node (k, e div width) composes its children in position order.
    ups = [lvl0]
    for _ in range(levels):
        child = ups[-1]
        parent = (child.groupBy("_k", (F.col("_e") / width).cast("long").alias("_e"))
                  .agg(F.array_sort(F.collect_list(F.struct(F.col("_e").alias("e"), F.col("_f").alias("f"))))
                       .alias("_m"))
                  .select("_k", "_e", F.aggregate("_m", F.sequence(F.lit(0), F.lit(n - 1)),
                                                  lambda acc, m: _compose(acc, m["f"])).alias("_f"))
                  .transform(reliable_checkpoint))
        ups.append(parent)

    # Down-sweep: top node starts from the key's current state.
    init = initial.select(F.col(initial.columns[0]).alias("_k"),
                          F.coalesce(F.when(F.col(initial.columns[1]).isNotNull(),
                                            F.try_element_at(index_map, F.col(initial.columns[1]))),
                                     F.lit(n - 1)).alias("_s"))
    starts = ups[-1].select("_k", "_e").join(init, "_k", "left").withColumn(
        "_s", F.coalesce(F.col("_s"), F.lit(n - 1)))
    for level in range(levels, 1, -1):
        child = ups[level - 1]
        grouped = (child.withColumn("_pe", (F.col("_e") / width).cast("long"))
                   .groupBy("_k", "_pe")
                   .agg(F.array_sort(F.collect_list(F.struct(F.col("_e").alias("e"), F.col("_f").alias("f"))))
                        .alias("_m")))
        starts = (grouped.join(starts.withColumnRenamed("_e", "_pe"), ["_k", "_pe"])
                  .select("_k", F.arrays_zip(F.col("_m"), _prefix_starts(F.col("_m"), F.col("_s"), "f").alias("st"))
                          .alias("_z"))
                  .select("_k", F.explode("_z").alias("_z"))
                  .select("_k", F.col("_z._m.e").alias("_e"), F.col("_z.st").alias("_s"))
                  .transform(reliable_checkpoint))
    # Leaves: requests of each first-level node, with their full rows.
    leaves = (lvl0.withColumn("_pe", (F.col("_e") / width).cast("long"))
              .groupBy("_k", "_pe")
              .agg(F.array_sort(F.collect_list(F.struct(F.col("_e").alias("e"), F.col("_f").alias("f"),
                                                        F.col("_row").alias("row")))).alias("_m")))
    out = (leaves.join(starts.withColumnRenamed("_e", "_pe"), ["_k", "_pe"])
           .select(F.explode(F.arrays_zip(F.col("_m"), _prefix_starts(F.col("_m"), F.col("_s"), "f").alias("st")))
                   .alias("_z"))
           .select("_z._m.row.*", F.col("_z.st").alias("_before"), F.col("_z._m.f").alias("_f")))
    return _finish(out, req_cols, target, n, allowed, name_of, index_map)
