"""The cheapest repair of damaged conversations by cost layers (operator 11).

A layer is the set of grammar states at each turn from which the end can be reached at no more than its cost, four bits a turn.
Layer after layer, by increasing cost, is made from those before it: an edit of cost w takes its bits from layer c - w. The
first layer that holds the start gives the cost; the least audit is traced from there by asking, edit by edit in ASCII order, whether
the bit it leads to is in the layer that it would leave. A state allows one role besides system, so an audit names one repair.

Rows are range-sorted by conversation and turn. A conversation of up to ``BLOCK`` rows within a partition is solved where it lies. Any other is
cut into blocks that know nothing of each other: layers give the costs between all states at a block's two ends; costs
to the end of the conversation are added up over blocks from the last to the first, four numbers a block; each block is traced from each state, and a
walk over blocks, again a few numbers each, says which one counts. So a conversation of any length has its texts spread over tasks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.bulk import hand_back
from mnemospark.llm.shared import materialize, spread_join

#: Rows of a block, blocks or conversations that are solved together.
BLOCK, LANES = 64, 1024
WHITE = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The grammar (s?(ua)+)? as states 0 (start), 1 (after s), 2 (after u), 3 (after ua); 0 and 3 accept.
STEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
#: The state to which each leads by the one of user and assistant that it allows.
ONWARD = np.array([2, 2, 3, 2])
ROLES = ("user", "assistant")
#: A row's code: its role's initial (s, u, a, other), whether it has to go, whether it is truncated; or no row at all.
FORCED, CUT, NONE = 4, 8, 16
FAR = 1 << 60
LEGAL = {"su", "ua", "au"}


def kept_to(code: int, state: int) -> int:
    return -1 if code & (FORCED | NONE) else STEP.get((state, code & 3), -1)


KEPT = np.array([[kept_to(c, q) for q in range(4)] for c in range(NONE + 1)])


def leading(to) -> np.ndarray:
    """For each set of states after an edit the set of those from which it leads there; ``to`` gives the state after."""
    return np.array([sum(1 << q for q in range(4) if to[q] >= 0 and after >> to[q] & 1) for after in range(16)], np.uint8)


def by_weight() -> dict[int, np.ndarray]:
    """For each cost of an edit that uses up a row: sets before it by code * 16 + set after it."""
    out = {w: np.zeros((NONE + 1, 16), np.uint8) for w in (0, REROLE, DELETE, REROLE + TRUNCATED)}
    for code in range(NONE):
        extra = TRUNCATED if code & CUT else 0
        out[DELETE][code] |= np.arange(16, dtype=np.uint8)
        out[extra][code] |= leading(KEPT[code])
        if not code & FORCED:
            out[REROLE + extra][code] |= leading(ONWARD)
    out[0][NONE] = np.arange(16)
    return {w: t.ravel() for w, t in out.items()}


TABLES, INSERTED = by_weight(), leading(ONWARD)
LAG = max(TABLES)


def layers(codes: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All layers, and the first one (or FAR) that has each state at the start.

    ``codes`` (turns, lanes) has the rows of each lane, ``ends`` (lanes, 4) the cost from each state after the last row to
    the end of all, and ``wanted`` (lanes) the set of states whose costs are asked for. Layers stop when nothing can be added.
    """
    turns, lanes = codes.shape
    line = codes.astype(np.int64) * 16
    made: list[np.ndarray] = []
    cost = np.full((lanes, 4), FAR)
    last = int(ends[ends < FAR].max(initial=0))
    while True:
        c = len(made)
        now = np.zeros((turns + 1, lanes), np.uint8)
        now[turns] = ((ends <= c) << np.arange(4)).sum(axis=1)
        for w, table in TABLES.items():
            if w and c >= w:
                now[:turns] |= table[line + made[c - w][1:]]
        if c >= INSERT:
            now |= INSERTED[made[c - INSERT]]
        for i in range(turns - 1, -1, -1):  # rows that are kept at no cost
            now[i] |= TABLES[0][line[i] + now[i + 1]]
        made.append(now)
        first = ((now[0][:, None] >> np.arange(4)) & 1).astype(bool) & (cost == FAR)
        cost[first] = c
        if not (wanted & ~now[0]).any() or (c > last + LAG and all((x == now).all() for x in made[-LAG - 1 : -1])):
            return np.stack(made), cost


def traced(codes: np.ndarray, lengths: np.ndarray, ends: np.ndarray, made: np.ndarray, state: np.ndarray, cost: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The least audit of each lane from its state at its cost, and the state that it ends in. Lanes whose cost is FAR have none."""
    turns, lanes = codes.shape
    codes = np.vstack([codes, np.full((1, lanes), NONE, codes.dtype)])
    at, state, cost, lane = np.zeros(lanes, np.int64), state.copy(), cost.copy(), np.arange(lanes)
    written: list[np.ndarray] = []
    live = lane[cost < FAR]

    def leads(c: np.ndarray, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        fits = (c >= 0) & (q >= 0)
        return fits & (made[np.where(fits, c, 0), i, live] >> np.where(fits, q, 0) & 1).astype(bool)

    while True:
        over = (at[live] == lengths[live]) & (ends[live, state[live]] == cost[live])
        live = live[~over]
        if not len(live):
            break
        i, q, c = at[live], state[live], cost[live]
        code = codes[i, live]
        inside = i < lengths[live]
        gap = inside & (code == NONE)
        row = inside & ~gap
        after = np.minimum(i + 1, turns)
        extra = np.where(code & CUT, TRUNCATED, 0)
        keep, move = KEPT[code, q], ONWARD[q]
        choices = [gap, row & leads(c - DELETE, after, q), ~gap & leads(c - INSERT, i, move), row & leads(c - extra, after, keep), row & ~(code & FORCED).astype(bool) & leads(c - REROLE - extra, after, move)]
        assert np.logical_or.reduce(choices).all()
        letter = np.zeros(lanes, np.uint8)
        letter[live] = np.select(choices, [0, *b"DIKR"])
        written.append(letter)
        at[live] = np.where(choices[2] & ~choices[1], i, i + 1)
        state[live] = np.select(choices, [q, q, move, keep, move])
        cost[live] = c - np.select(choices, [0, DELETE, INSERT, extra, REROLE + extra])
    text = np.stack(written, axis=1) if written else np.zeros((lanes, 0), np.uint8)
    return [line[line > 0].tobytes().decode() for line in text], state


def applied(audit: str, rows: list[tuple[str, str]], state: int) -> list[dict]:
    """The messages that an audit makes of rows (role, text)."""
    out, rows = [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = STEP[state, "sua".index(role[0])]
        else:
            state = int(ONWARD[state])
            role = ROLES[state - 2]
        out.append({"role": role, "text": text})
    return out


def matrix(codes: list[list[int]]) -> np.ndarray:
    return np.array([c + [NONE] * (max(map(len, codes)) - len(c)) for c in codes], np.uint8).T.reshape(max(map(len, codes)), len(codes))


def initial(role: str) -> str:
    return role[:1]


def illegal(roles: list[str]) -> int:
    return sum(initial(a) + initial(b) not in LEGAL for a, b in zip(roles, roles[1:]))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with one fault for each of five values of a hash; nulls are a blank.

    A dropped row stays with ``gone`` set, as its conversation has to be known.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(fault == 4, "user").otherwise(shown("role"))
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault == 0).alias("gone"), copies.alias("copy")).drop("copy")


FIELDS = "turn long, role string, text string, code int, same string, row long"
BLOCKS = "conv_id long, part int, seq long, whole boolean, audit string, messages array<struct<role string, text string>>, cost long, blank long, duplicate long, truncated long, illegal long, gaps long"


def judged(rows: DataFrame) -> DataFrame:
    """Rows with their code, where all that is known of a row alone is in it, and a digest of role and text."""
    stripped = F.rtrim("text", F.lit(WHITE))
    first = F.substring("role", 1, 1)
    code = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    code = code + F.when(stripped == "", FORCED).when(F.right(stripped, F.lit(1)).isin(*".!?"), 0).otherwise(CUT)
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    same = F.md5(F.concat_ws("\0", "role", "text"))
    return rows.select("conv_id", "turn", "role", F.when(F.col("gone"), "").otherwise(F.col("text")).alias("text"), F.when(F.col("gone"), NONE).otherwise(code).alias("code"), same.alias("same"), F.monotonically_increasing_id().alias("row"))


#: The order of a conversation's rows; null turns come first, rows of one turn by role and digest.
ORDER = ["conv_id", "turn", "role", "same", "row"]


def in_order(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)


def stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[object, list[dict], bool]]:
    """(conv_id, at most ``most`` rows, whether they are the whole conversation) in order. The first and last of a partition may go on beside it."""
    held, first, cut = [], True, False
    for batch in batches:
        for row in batch.to_pylist():
            other = bool(held) and row["conv_id"] != held[0]["conv_id"]
            if other or len(held) == most:
                yield held[0]["conv_id"], held, other and not first and not cut
                cut, first, held = not other, first and not other, []
            held.append(row)
    if held:
        yield held[0]["conv_id"], held, False


def faults(rows: list[dict]) -> list[int]:
    """Codes of a whole conversation's rows; one seen earlier has to go."""
    seen, out = set(), []
    for row in rows:
        code = row["code"]
        if code < FORCED or code & (CUT | FORCED) == CUT:
            known = (row["role"], row["text"])
            code = code & 3 | FORCED if known in seen else code
            seen.add(known)
        out.append(code)
    return out


def tally(rows: list[dict], codes: list[int]) -> dict:
    """Counts of faults of a stretch, and its turns and roles at both ends. A forced row with a text is a duplicate."""
    live = [(r, c) for r, c in zip(rows, codes) if c != NONE]
    blank = sum(bool(c & FORCED) and not r["text"].strip(WHITE) for r, c in live)
    turns = [r["turn"] for r, _ in live if r["turn"] is not None]
    roles = [r["role"] for r, _ in live]
    return {
        "blank": blank, "duplicate": sum(bool(c & FORCED) for _, c in live) - blank, "truncated": sum(c & (CUT | FORCED) == CUT for _, c in live), "illegal": illegal(roles),
        "turns": len(set(turns)), "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "head": initial(roles[0]) if roles else None, "tail": initial(roles[-1]) if roles else None,
    }


def gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def texts_of(rows: list[dict], codes: list[int]) -> list[tuple[str, str]]:
    return [(r["role"], r["text"]) for r, c in zip(rows, codes) if c != NONE]


START_END = np.array([0, FAR, FAR, 0])


def solved(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Whole short conversations repaired; of others the rows, for later."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("whole", pa.bool_()), ("audit", pa.string()), ("messages", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))] + [(c, pa.int64()) for c in ("cost", "blank", "duplicate", "truncated", "illegal", "gaps")] + [("rest", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("code", pa.int32()), ("same", pa.string()), ("row", pa.int64())])))])

    def out(lanes: list[tuple[object, list[dict]]], rest: list[tuple[object, list[dict]]]) -> pa.RecordBatch:
        rows = [{"conv_id": conv, "whole": False, "rest": own} for conv, own in rest]
        if lanes:
            codes = [faults(own) for _, own in lanes]
            lines, lengths = matrix(codes), np.array([len(c) for c in codes])
            ends = np.tile(START_END, (len(lanes), 1))
            made, cost = layers(lines, ends, np.ones(len(lanes), np.uint8))
            audits, _ = traced(lines, lengths, ends, made, np.zeros(len(lanes), np.int64), cost[:, 0])
            for (conv, own), code, audit, c in zip(lanes, codes, audits, cost[:, 0].tolist()):
                found = tally(own, code)
                found["gaps"] = gaps(found["low"], found["high"], found["turns"])
                rows.append({"conv_id": conv, "part": 0, "seq": 0, "whole": True, "audit": audit, "messages": applied(audit, texts_of(own, code), 0), "cost": c} | found)
        return pa.RecordBatch.from_pylist([{k: r.get(k) for k in schema.names} for r in rows], schema)

    lanes, rest, size = [], [], 0
    for conv, own, whole in stretches(batches, most):
        (lanes if whole else rest).append((conv, own))
        size += sum(len(r["text"]) for r in own)
        if len(lanes) + len(rest) == LANES or size > 16_000_000:
            yield out(lanes, rest)
            lanes, rest, size = [], [], 0
    yield out(lanes, rest)
    hand_back()


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (duplicates known) with the costs between all states at their ends."""
    part = TaskContext.get().partitionId()
    row = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("code", pa.int32())])

    def out(held: list[tuple[int, object, list[dict]]]) -> pa.RecordBatch:
        codes = [[r["code"] for r in own] for _, _, own in held]
        lines, n = matrix(codes), len(held)
        # a lane for each block and each state at its end
        ends = np.tile(np.where(np.eye(4, dtype=bool), 0, FAR), (n, 1))
        _, cost = layers(np.repeat(lines, 4, axis=1), ends, np.full(4 * n, 15, np.uint8))
        costs = cost.reshape(n, 4, 4).transpose(0, 2, 1).reshape(n, 16)  # from state, to state
        rows = pa.array([[{k: r[k] for k in ("turn", "role", "text", "code")} for r in own] for _, _, own in held], pa.list_(row))
        return pa.RecordBatch.from_arrays(
            [pa.array([c for _, c, _ in held], pa.int64()), pa.array([part] * n, pa.int32()), pa.array([s for s, _, _ in held], pa.int64()), rows, pa.array(costs.tolist(), pa.list_(pa.int64()))],
            ["conv_id", "part", "seq", "rows", "costs"],
        )

    held, size = [], 0
    for seq, (conv, own, _) in enumerate(stretches(batches, most)):
        held.append((seq, conv, own))
        size += sum(len(r["text"]) for r in own)
        if len(held) == LANES // 4 or size > 16_000_000:
            yield out(held)
            held, size = [], 0
    if held:
        yield out(held)
    hand_back()


def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block, from the last of its conversation on, the costs from each state at its end to the end of all."""
    conv, now = object(), None
    for batch in batches:
        ends = []
        for one, costs in zip(batch.column("conv_id").to_pylist(), batch.column("costs").to_pylist()):
            if one != conv:
                conv, now = one, START_END
            ends.append(now.tolist())
            now = np.minimum(FAR, (np.array(costs).reshape(4, 4) + now).min(axis=1))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "seq")), pa.array(ends, pa.list_(pa.int64()))], ["conv_id", "part", "seq", "ends"])


TALLY = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, head string, tail string"


def from_each_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's least audit, last state and own cost, from each state at its start."""
    for batch in batches:
        for k in range(0, batch.num_rows, LANES // 4):
            held = batch.slice(k, LANES // 4).to_pylist()
            codes = [[r["code"] for r in x["rows"]] for x in held]
            n = len(held)
            lines = np.repeat(matrix(codes), 4, axis=1)
            ends = np.repeat(np.array([x["ends"] for x in held]), 4, axis=0)
            # FAR stays FAR
            ends = np.where(ends >= FAR, FAR, ends - ends.min(axis=1, keepdims=True))
            made, cost = layers(lines, ends, np.full(4 * n, 15, np.uint8))
            state = np.tile(np.arange(4), n)
            own = cost[np.arange(4 * n), state]
            audits, last = traced(lines, np.repeat([len(c) for c in codes], 4), ends, made, state, own)
            spent = np.where(own < FAR, own - ends[np.arange(4 * n), last], FAR)
            rows = []
            for j, x in enumerate(held):
                at = slice(4 * j, 4 * j + 4)
                rows.append({"conv_id": x["conv_id"], "part": x["part"], "seq": x["seq"], "rows": x["rows"], "audits": audits[at], "states": last[at].tolist(), "spent": spent[at].tolist()} | tally(x["rows"], codes[j]))
            names = ["conv_id", "part", "seq", "rows", "audits", "states", "spent", *(c.split()[0] for c in TALLY.split(", "))]
            types = [pa.int64(), pa.int32(), pa.int64(), batch.schema.field("rows").type, pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.int64()] * 7, pa.string(), pa.string()]
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in rows], pa.schema(list(zip(names, types))))
    hand_back()


def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block, from the first of its conversation on: the state at its start, and what its neighbour before changes in its counts."""
    conv = object()
    state = tail = high = low = None
    for batch in batches:
        starts, wrong, between = [], [], []
        for x in batch.to_pylist():
            if x["conv_id"] != conv:
                conv, state, tail, high, low = x["conv_id"], 0, None, None, None
            starts.append(state)
            state = x["states"][state]
            wrong.append(int(tail is not None and x["head"] is not None and tail + x["head"] not in LEGAL))
            # turns of a whole conversation that are missing before this block's first one; one turn in both counts once
            between.append(0 if high is None or x["low"] is None else max(0, x["low"] - high - 1))
            tail = x["tail"] if x["tail"] is not None else tail
            high = x["high"] if x["high"] is not None else high
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "part", "seq")), pa.array(starts, pa.int32()), pa.array(wrong, pa.int64()), pa.array(between, pa.int64())],
            ["conv_id", "part", "seq", "state", "wrong", "between"],
        )


def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit that counts and the messages that it makes."""
    names = [c.split()[0] for c in BLOCKS.split(", ") if " " in c and not c.startswith("text")]
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            q = x["state"]
            found = {"whole": False, "audit": x["audits"][q], "messages": applied(x["audits"][q], texts_of(x["rows"], [r["code"] for r in x["rows"]]), q), "cost": x["spent"][q]}
            found |= {"illegal": x["illegal"] + x["wrong"], "gaps": gaps(x["low"], x["high"], x["turns"]) + x["between"]}
            rows.append({k: (x | found)[k] for k in names})
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, kinds))))


def along(rows: DataFrame, descending: bool = False) -> DataFrame:
    """Blocks in order, a conversation's in one task, which reads a few numbers of each and keeps nothing of them."""
    way = [F.desc("part"), F.desc("seq")] if descending else ["part", "seq"]
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *way)


def long_blocks(rows: DataFrame, block: int) -> DataFrame:
    """`repaired` for conversations that are long or lie on a border of partitions."""
    live = (F.col("code") != NONE) & (F.col("code").bitwiseAND(FORCED) == 0)
    keyed = rows.withColumn("known", F.when(live, F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), "same")))
    place = F.struct("turn", "row")
    firsts = keyed.where("known is not null").groupBy("known").agg(F.min(place).alias("first"), F.count("*").alias("rows_of_key")).where("rows_of_key > 1")
    firsts = materialize(firsts, "firsts")
    keyed = spread_join(keyed, firsts.drop("rows_of_key"), "known", ["row"], firsts.select("known", "rows_of_key"))
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(place)
    keyed = keyed.withColumn("code", F.when(again, F.col("code").bitwiseAND(3) + FORCED).otherwise(F.col("code"))).drop("known", "first")
    keyed = materialize(keyed, "judged")
    cut = in_order(keyed).mapInArrow(functools.partial(blocks, most=block), "conv_id long, part int, seq long, rows array<struct<turn long, role string, text string, code int>>, costs array<long>")
    cut = materialize(cut, "blocks")
    ends = along(cut.select("conv_id", "part", "seq", "costs"), True).mapInArrow(backward, "conv_id long, part int, seq long, ends array<long>")
    # a part and a place in it are one block, whatever its conversation
    tried = cut.drop("costs").join(ends.drop("conv_id"), ["part", "seq"]).mapInArrow(
        from_each_state, f"conv_id long, part int, seq long, rows array<struct<turn long, role string, text string, code int>>, audits array<string>, states array<int>, spent array<long>, {TALLY}"
    )
    tried = materialize(tried, "tried")
    starts = along(tried.select("conv_id", "part", "seq", "states", "low", "high", "head", "tail")).mapInArrow(forward, "conv_id long, part int, seq long, state int, wrong long, between long")
    return tried.join(starts.drop("conv_id"), ["part", "seq"]).mapInArrow(finished, BLOCKS)


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Conversations (conv_id, turn, role, text; ``gone`` rows only make a conversation known) repaired at the least cost.

    A result row is a stretch of a conversation, in the order of (part, seq): its share of the audit, the messages that this
    makes, and its share of all counts and of the cost. ``whole`` ones are all of their conversation. Null roles and texts are a
    blank; rows without conv_id are one conversation; null turns come first, rows of one turn by role and digest; of
    repeated rows all but the first are duplicates. Other columns are ignored. ``rows`` has to be a stored table's, without a
    shuffle since, so that a task that runs again numbers its rows alike.
    """
    first = in_order(judged(rows)).mapInArrow(functools.partial(solved, most=block), f"{BLOCKS}, rest array<struct<{FIELDS}>>")
    first = materialize(first, "first")
    names = [c for c in first.columns if c != "rest"]
    rest = first.where("rest is not null").select("conv_id", F.inline("rest"))
    return first.where("whole").select(names).unionByName(long_blocks(rest, block).select(names))


def digests(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a conversation: counts, cost, the whole audit and the SHA-256 of its repaired messages.

    That digest is by definition made of one text after another, so the task of a long conversation reads its messages in turn; it keeps
    the digest's state and, as they are a result, the audit's letters.
    """
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    found = materialize(repaired(rows, block), "repaired")
    short = found.where("whole").select("conv_id", *numbers, "audit", F.sha2(F.concat_ws("\n", line), 256).alias("repaired_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, begun, total, audit = object(), None, False, None, []

        def out() -> pa.RecordBatch:
            cells = [pa.array([conv], pa.int64()), *(pa.array([total[c]], pa.int64()) for c in numbers), pa.array(["".join(audit)]), pa.array([state.hexdigest()])]
            return pa.RecordBatch.from_arrays(cells, ["conv_id", *numbers, "audit", "repaired_sha256"])

        for batch in batches:
            for x in batch.to_pylist():
                if x["conv_id"] != conv:
                    if state is not None:
                        yield out()
                    conv, state, begun, total, audit = x["conv_id"], hashlib.sha256(), False, dict.fromkeys(numbers, 0), []
                for text in x["lines"]:
                    state.update(b"\n" * begun + text.encode())
                    begun = True
                for c in numbers:
                    total[c] += x[c]
                audit.append(x["audit"])
        if state is not None:
            yield out()

    rest = found.where("not whole").select("conv_id", "part", "seq", *numbers, "audit", line.alias("lines"))
    long = along(rest).mapInArrow(run, f"conv_id long, {', '.join(f'{c} long' for c in numbers)}, audit string, repaired_sha256 string")
    return short.unionByName(long)


def oracle() -> str:
    """DuckDB SQL for `digests` of `damaged` conversations: one state after another, row by row, each with its cheapest, least audit."""
    tally = "[" + ", ".join(["-1"] * 8) + "]"
    add = lambda x, cost, letter, line="''": f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'o': {x}.o || {line}}} END"
    own = "chr(10) || r.role || ':' || r.text"
    stays = f"{TRUNCATED} * r.cut"
    keep = lambda x, to: f"CASE WHEN r.first = '{to}' AND NOT r.forced THEN {add(x, stays, 'K', own)} END"
    move = lambda x, to: f"CASE WHEN NOT r.forced THEN {add(x, f'{REROLE} + {stays}', 'R', f"chr(10) || '{to}:' || r.text")} END"
    new = lambda x, to: add(x, INSERT, "I", f"chr(10) || '{to}:'")
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    closed = lambda q: f"""SELECT k, i, s0, s1, t2 AS s2, {least("s3", new("t2", "assistant"))} AS s3 FROM (SELECT *, {least("s2", new("s0", "user"), new("s1", "user"), new("s3", "user"))} AS t2 FROM ({q}))"""
    step = f"""SELECT w.k, w.i + 1 AS i, {add("s0", DELETE, "D")} AS s0, {least(add("s1", DELETE, "D"), keep("s0", "s"))} AS s1,
  {least(add("s2", DELETE, "D"), *[f(x, to) for x in ("s0", "s1", "s3") for f, to in ((keep, "u"), (move, "user"))])} AS s2,
  {least(add("s3", DELETE, "D"), keep("s2", "a"), move("s2", "assistant"))} AS s3
FROM walk w JOIN judged r ON r.k = w.k AND r.i = w.i + 1"""
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR)"
    return f"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') AS k,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hashed AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(name, ''), lambda x: list_concat([ascii(x)::BIGINT], {tally})))),
             lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END)) % 20 AS fault FROM named),
damaged AS (SELECT conv_id, k, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
             CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
             FROM hashed, range(CASE WHEN fault = 3 THEN 2 ELSE 1 END) WHERE fault <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, md5(role || chr(0) || text)) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
seen AS (SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AND bare <> '' AS again, left(role, 1) AS first,
             lead(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS next FROM placed),
judged AS (SELECT *, blank OR again AS forced, (NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?'))::INT AS cut FROM seen),
walk AS (SELECT * FROM ({closed(f"SELECT DISTINCT k, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM named")})
  UNION ALL SELECT * FROM ({closed(step)})),
counts AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, sum(cut) AS truncated,
             count(*) FILTER (first || next NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM judged GROUP BY k),
ended AS (SELECT w.k, {least("s0", "s3")} AS best FROM walk w LEFT JOIN counts USING (k) WHERE w.i = coalesce(n, 0))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(substring(best.o, 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM named) JOIN ended USING (k) LEFT JOIN counts USING (k)"""
