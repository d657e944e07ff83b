"""Repair of conversation structure by rank-convergence parallel Viterbi.

A repaired conversation is empty, or an optional system turn followed by pairs of
user and assistant turns. Rows may be kept, given another role, deleted, and empty
turns inserted; the cheapest edits are the shortest path through four states
(nothing yet, system, user, assistant). All conversations, sorted, form one sequence that is cut
into blocks of ``BLOCK`` rows, so a conversation of any length is dealt over many tasks.
A block runs backwards from a speculative cost vector for what follows; fix-up
passes hand the vector of the following block over and rerun until the new vector differs from
the old one by a constant only, when the rest of the block need not be run again. The
stitched costs lead the forward trace: at each step the least letter of a
cheapest path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tavola.functions.keys import with_row_number
from tavola.llm.common import stored, table

BLOCK = 4096
BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)                     # the turn that must follow, by state
KEEP = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
REROLE, DELETE, INSERT = 2, 3, 2                         # costs; a truncated row that stays costs 1 more
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
INITIALS = {"s": 0, "u": 1, "a": 2}                      # any other initial: 3
NAMES = {USER: "user", ASSISTANT: "assistant"}
END = (0, 2 * INSERT, INSERT, 0)                         # cost of completing a conversation without further rows

Vector = tuple[int, int, int, int]


# ---- one row: costs and edits. A row is a letter 'a'..'p': 4 * initial + fault.

STEPS: dict[tuple[Vector, str], tuple[Vector, int]] = {}
EDITS: dict[tuple[int, Vector, str], tuple[str, int, int]] = {}


def moves(state: int, row: str) -> list[tuple[str, int, int]]:
    """``(letter, cost, state after)`` of the edits that consume the row, in ASCII order."""
    initial, fault = divmod(ord(row) - 97, 4)
    out = [("D", DELETE, state)]
    if fault <= TRUNCATED:
        if (state, initial) in KEEP:
            out.append(("K", fault, KEEP[state, initial]))
        out.append(("R", REROLE + fault, NEXT[state]))
    return out


def step(after: Vector, row: str) -> tuple[Vector, int]:
    """Costs from before the row, given those from behind it: a vector with least
    entry 0, and what was taken off. Few different vectors occur, so each is worked out once."""
    known = STEPS.get((after, row))
    if known is None:
        use = [min(cost + after[to] for _, cost, to in moves(x, row)) for x in range(4)]
        full = [min(use[x], INSERT + use[NEXT[x]], 2 * INSERT + use[NEXT[NEXT[x]]]) for x in range(4)]
        low = min(full)
        known = STEPS[after, row] = tuple(v - low for v in full), low
    return known


def edits(state: int, after: Vector, row: str) -> tuple[str, int, int]:
    """The ASCII-least letters that are cheapest up to and with this row, the state
    after it and their cost."""
    known = EDITS.get((state, after, row))
    if known is None:
        before, low = step(after, row)
        letters, cost, x, chosen = "", 0, state, None
        while chosen is None:
            options = [m for m in moves(x, row) if m[1] + after[m[2]] == before[x] + low]
            insert = INSERT + before[NEXT[x]] == before[x]
            if insert and (not options or options[0][0] > "I"):
                letters, cost, x = letters + "I", cost + INSERT, NEXT[x]
            else:
                chosen = options[0]
        known = EDITS[state, after, row] = letters + chosen[0], chosen[2], cost + chosen[1]
    return known


def completing(state: int) -> str:
    """Insertions behind the last row."""
    return "I" * (END[state] // INSERT)


def before_all(rows: str, after: Vector) -> Vector:
    """Costs from before the first of ``rows`` (up to a constant)."""
    for row in reversed(rows):
        after = step(after, row)[0]
    return after


def rerun(rows: str, old: Vector, new: Vector, out: Vector) -> Vector:
    """``before_all(rows, new)``, given ``out = before_all(rows, old)``: stops where both
    vectors differ by a constant only (they have least entry 0, so: are equal)."""
    for row in reversed(rows):
        if old == new:
            return out
        old, new = step(old, row)[0], step(new, row)[0]
    return new


def trace(rows: str, after: Vector, state: int) -> tuple[str, int, int]:
    """Letters of the least cheapest edits of ``rows`` from ``state``, the state behind them and the cost."""
    vectors = []
    for row in reversed(rows):
        vectors.append(after)
        after = step(after, row)[0]
    letters, cost = [], 0
    for row in rows:
        some, state, more = edits(state, vectors.pop(), row)
        letters.append(some)
        cost += more
    return "".join(letters), state, cost


# ---- rows in order, cut into blocks

def ordered(rows: DataFrame) -> DataFrame:
    """``pos, conv, row``: each row's place in (conversation, turn, role, hash of the
    text) and its letter. Texts stay behind: only their hashes are sorted."""
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    which = F.lit(3)
    for letter, i in INITIALS.items():
        which = F.when(initial == letter, F.lit(i)).otherwise(which)
    thin = rows.select("conv", "turn", "role", "h", which.alias("initial"), (bare == "").alias("blank"),
                       (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"))
    numbered = with_row_number(thin, [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("h")], "pos")
    firsts = numbered.groupBy("conv", "role", "h").agg(F.min("pos").alias("first")).select("first")
    fault = (F.when(F.col("blank"), F.lit(BLANK)).when(F.col("first").isNull(), F.lit(DUPLICATE))
             .when(F.col("truncated"), F.lit(TRUNCATED)).otherwise(F.lit(FINE)))
    return (numbered.join(firsts, F.col("pos") == F.col("first"), "left")
            .select("pos", "conv", F.char(F.lit(97) + 4 * F.col("initial") + fault).alias("row")))


def blocks_of(places: DataFrame, size: int) -> DataFrame:
    """``block, convs, rows, back, ahead``: the pieces of conversations in each run of
    ``size`` places; ``back`` is the letter of the row before where the first piece continues a
    conversation, ``ahead`` whether the last one goes on in the next block."""
    own = F.floor((F.col("pos") - 1) / F.lit(size)).cast("long")
    near = [F.when((F.col("pos") - 1) % size == 0, own - 1), F.when(F.col("pos") % size == 0, own + 1)]
    both = places.select("pos", "conv", "row", F.explode(F.array_compact(F.array(own, *near))).alias("block"))
    kind = places.schema["conv"].dataType.simpleString()
    schema = f"block long, convs array<{kind}>, rows array<string>, back string, ahead boolean"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def cut(key, piece):
        block, piece = key[0].as_py(), piece.sort_by("pos")
        pos, conv, row = (piece.column(c).to_pylist() for c in ("pos", "conv", "row"))
        low, high = block * size + 1, block * size + size
        at = [i for i, p in enumerate(pos) if low <= p <= high]
        if not at:  # nothing but a neighbour's row
            return arrow.empty_table()
        first, last = at[0], at[-1]
        convs, rows = [], []
        for i in range(first, last + 1):
            if not convs or conv[i] != conv[i - 1]:
                convs.append(conv[i])
                rows.append([])
            rows[-1].append(row[i])
        back = row[first - 1] if first and conv[first - 1] == conv[first] else None
        ahead = last + 1 < len(pos) and conv[last + 1] == conv[last]
        return pa.Table.from_pylist([{"block": block, "convs": convs, "rows": ["".join(r) for r in rows],
                                      "back": back, "ahead": ahead}], schema=arrow)

    return stored(both.groupBy("block").applyInArrow(cut, schema), "turn-blocks")


def batches_of(run, schema: str):
    """A ``mapInArrow`` function from one over rows as dicts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    yield from b.slice(at, 256).to_pylist()
        held, weight = [], 0
        for out in run(each()):
            held.append(out)
            weight += 64 + sum(len(v) for v in out.values() if isinstance(v, str))
            if weight >= 1 << 22:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)
    return over


# ---- backwards: speculative vectors and fix-up passes

VECTORS = "block long, through boolean, rows string, used array<int>, out array<int>"


def stitched(blocks: DataFrame) -> DataFrame:
    """``block, after``: for blocks whose last piece goes on, the costs from behind it.

    Only a block that lies within one conversation hands costs through; in pass ``p``
    those of ``2**p`` neighbouring blocks are taken in turn by one task (a row a
    block is held), so the passes grow with the logarithm of the longest conversation.
    """
    def speculate(rows):
        for r in rows:
            through = len(r["rows"]) == 1 and r["back"] is not None and r["ahead"]
            out = before_all(r["rows"][0], END)
            yield {"block": r["block"], "through": through, "rows": r["rows"][0] if through else None,
                   "used": list(END) if through else None, "out": list(out)}

    spanning = blocks.filter("back IS NOT NULL").select("block", "rows", "back", "ahead")
    vectors = stored(spanning.mapInArrow(batches_of(speculate, VECTORS), VECTORS), "turn-vectors")

    def given(v: DataFrame) -> DataFrame:
        following = v.select((F.col("block") - 1).alias("b"), F.col("out").alias("now"))
        return v.join(following, F.col("block") == F.col("b"), "left").drop("b")

    def fix(rows):
        last, out = None, None
        for r in rows:
            if r["through"]:
                now = tuple(out if last == (r["run"], r["block"] + 1) else r["now"])
                got = rerun(r["rows"], tuple(r["used"]), now, tuple(r["out"]))
                r["used"], r["out"] = list(now), list(got)
            last, out = (r["run"], r["block"]), r["out"]
            yield {k: r[k] for k in ("block", "through", "rows", "used", "out")}

    width = 0
    while given(vectors).filter("through AND used <> now").limit(1).count():
        width += 1
        runs = given(vectors).withColumn("run", F.shiftright("block", width))
        runs = runs.repartition("run").sortWithinPartitions("run", F.desc("block"))
        vectors = stored(runs.mapInArrow(batches_of(fix, VECTORS), VECTORS), "turn-vectors")
    return vectors.select((F.col("block") - 1).alias("block"), F.col("out").alias("after"))


# ---- forwards: entry states of blocks, then letters

PIECES = "block long, audit string, counts array<long>"


def entered(blocks: DataFrame) -> DataFrame:
    """``block, entry``: the state in which blocks that continue a conversation begin.

    The trace of a block from each of the four states gives a map of states (mostly
    one and the same, as cheapest paths meet); maps of neighbours are composed by doubling.
    """
    schema = "block long, map array<int>, before long"

    def maps(rows):
        for r in rows:
            piece, through = r["rows"][-1], len(r["rows"]) == 1 and r["back"] is not None
            after = tuple(r["after"])
            to = [trace(piece, after, x)[1] for x in (range(4) if through else [START])]
            yield {"block": r["block"], "map": to if through else to * 4, "before": r["block"] - 1 if through else None}

    going = blocks.filter("ahead").select("block", "rows", "back", "after")
    found = stored(going.mapInArrow(batches_of(maps, schema), schema), "turn-maps")
    while found.filter(F.size(F.array_distinct("map")) > 1).limit(1).count():
        earlier = found.select(F.col("block").alias("b"), F.col("map").alias("first"), F.col("before").alias("far"))
        joined = found.join(earlier, F.col("before") == F.col("b"), "left")
        composed = F.transform("first", lambda x: F.element_at("map", x + 1))
        found = stored(joined.select("block", F.coalesce(F.when(F.col("b").isNotNull(), composed), F.col("map")).alias("map"),
                                     F.col("far").alias("before")), "turn-maps")
    return found.select((F.col("block") + 1).alias("block"), F.col("map")[0].alias("entry"))


def pieces_of(blocks: DataFrame) -> DataFrame:
    """``conv, block, audit, counts``: letters of each piece of a conversation, and its
    numbers of blank, duplicate and truncated rows and illegal neighbours, and the cost."""
    kind = blocks.schema["convs"].dataType.elementType.simpleString()
    schema = f"conv {kind}, block long, audit string, counts array<long>"
    legal = {(0, 1), (1, 2), (2, 1)}

    def run(rows):
        for r in rows:
            n = len(r["rows"])
            for i, (conv, piece) in enumerate(zip(r["convs"], r["rows"], strict=True)):
                more = r["ahead"] and i == n - 1
                back = r["back"] if i == 0 else None
                audit, state, cost = trace(piece, tuple(r["after"]) if more else END, START if back is None else r["entry"])
                if not more:
                    cost += END[state]
                    audit += completing(state)
                codes = [ord(c) - 97 for c in (back or "") + piece]
                faults = [c % 4 for c in codes[len(back or ""):]]
                illegal = sum((a // 4, b // 4) not in legal for a, b in zip(codes, codes[1:], strict=False))
                yield {"conv": conv, "block": r["block"], "audit": audit,
                       "counts": [faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, cost]}

    return blocks.select("block", "convs", "rows", "back", "ahead", "after", "entry").mapInArrow(batches_of(run, schema), schema)


def audits(rows: DataFrame, size: int) -> DataFrame:
    blocks = blocks_of(ordered(rows), size)
    blocks = stored(blocks.join(stitched(blocks), "block", "left"), "turn-costs")
    return pieces_of(blocks.join(entered(blocks), "block", "left"))


# ---- repaired conversations

def following(state: int, letter: str, role: str | None) -> int:
    return KEEP[state, INITIALS[role[0]]] if letter == "K" else state if letter == "D" else NEXT[state]


class Conversation:
    """Applies the letters of one conversation to its rows as they come."""

    def __init__(self, conv):
        self.conv, self.state, self.at = conv, START, 0
        self.audit, self.parts, self.counts = "", [], [0] * 5
        self.low = self.high = self.turn = None
        self.turns, self.kept, self.sha = 0, 0, hashlib.sha256()

    def piece(self, audit: str, counts: list[int]) -> None:
        self.parts.append(audit)
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]

    def _emit(self, role: str, text: str, edit: str, turn: int | None) -> dict:
        if self.kept:
            self.sha.update(b"\n")
        self.sha.update(role.encode("utf-8", "surrogatepass") + b":" + text.encode("utf-8", "surrogatepass"))
        self.kept += 1
        return {"conv": self.conv, "place": self.kept, "turn": turn, "role": role, "text": text, "edit": edit}

    def inserted(self) -> Iterator[dict]:
        if self.parts:
            self.audit, self.parts = "".join(self.parts), []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield self._emit(NAMES[self.state], "", "I", None)

    def row(self, turn: int | None, role: str, text: str) -> Iterator[dict]:
        yield from self.inserted()
        letter, self.at = self.audit[self.at], self.at + 1
        self.state = following(self.state, letter, role)
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turns, self.turn = turn if self.low is None else self.low, turn, self.turns + 1, turn
        if letter != "D":
            yield self._emit(role if letter == "K" else NAMES[self.state], text, letter, turn)

    def report(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return dict(zip(("blank", "duplicate", "truncated", "illegal", "cost"), self.counts, strict=True),
                    conv=self.conv, gaps=gaps, audit=self.audit, repaired_sha256=self.sha.hexdigest())


def prepared(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, turn, role, text, h`` (nulls in role and text: one space)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                       F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), text.alias("text"),
                       F.unhex(F.sha2(text.cast("binary"), 256)).alias("h"))


def _applied(rows: DataFrame, convs: DataFrame | None, size: int, rows_wanted: bool) -> DataFrame:
    """Letters and texts of each conversation meet in one task, which streams them
    and holds the letters of one conversation."""
    kind = rows.schema["conv"].dataType.simpleString()
    own = rows.select("conv")
    every = (own if convs is None else own.unionByName(convs)).distinct()

    def with_nulls(df: DataFrame, order: int) -> DataFrame:
        fields = {"block": "long", "turn": "long", "role": "string", "h": "binary", "text": "string", "audit": "string",
                  "counts": "array<long>"}
        return df.select("conv", F.lit(order).alias("order"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c)
                                                                for c, t in fields.items()])

    stream = (with_nulls(every, 0).unionByName(with_nulls(audits(rows, size), 1)).unionByName(with_nulls(rows, 2))
              .repartition("conv").sortWithinPartitions("conv", "order", "block", F.asc_nulls_first("turn"), "role", "h")
              .drop("h", "block"))
    schema = (f"conv {kind}, place long, turn long, role string, text string, edit string" if rows_wanted else
              f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")

    def run(rs):
        def end(c):
            last = list(c.inserted())
            return last if rows_wanted else [c.report()]
        now = None
        for r in rs:
            if r["order"] == 0:
                if now:
                    yield from end(now)
                now = Conversation(r["conv"])
            elif r["order"] == 1:
                now.piece(r["audit"], r["counts"])
            else:
                for out in now.row(r["turn"], r["role"], r["text"]):
                    if rows_wanted:
                        yield out
        if now:
            yield from end(now)

    return stream.mapInArrow(batches_of(run, schema), schema)


def repair_report(rows: DataFrame, convs: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """A row for each conversation of ``rows`` (and of ``convs``, one column ``conv``): faults, ``cost``
    and letters (``audit``) of the cheapest edits that make it well-formed, SHA-256 of the result.

    Rows are taken by turn (null first), then role, then hash of the text; equal rows
    are interchangeable. A null role or text is one space: no known initial,
    blank. A null conversation is one of its own. Turns may be missing, repeated or
    all null (no gaps then). Conversations without rows have zeros, no
    letters and the hash of the empty text; empty tables give no rows. Other columns
    are ignored, whatever their names.

    Long conversations are dealt over blocks for faults and edits. Their repaired
    text is one SHA-256 stream, which cannot be split: one task reads it, row by row.
    """
    return _applied(prepared(rows, conv_col, turn_col, role_col, text_col), convs, size, False)


def repaired_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """The repaired conversations themselves: ``conv, place, turn, role, text, edit`` (``K``ept,
    ``R`` another role, ``I``nserted). See ``repair_report``."""
    return _applied(prepared(rows, conv_col, turn_col, role_col, text_col), None, size, True)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with the faults that the crc32 of ``conv:turn`` draws, modulo 20: 0 drops the row, 1
    empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it a user's.
    Nulls count as one space."""
    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn)).cast("binary")) % 20
    rows = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), plain(role).alias("role"), plain(text).alias("text"),
                       draw.alias("draw")).filter("draw <> 0")
    new_text = F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    new_role = F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", new_role.alias("role"), new_text.alias("text"),
                       F.explode(F.sequence(F.lit(1), F.when(F.col("draw") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage the conversations as drawn, then repair every one of them."""
    rows = table(spark, sf_dir, "conversations")
    out = repair_report(damaged(rows), rows.select(F.col("conv_id").alias("conv")))
    return out.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                      "repaired_sha256")
