"""Chat formatting with minimum-cost role repair.

A dynamic program over the automaton of legal turns (one system turn at most, first; then user and assistant in
turn, the user first) chooses for each turn whether it stays, is merged into the turn before, gets another role,
or follows an empty turn that is put in. Costs decide; of equal choices the first of ``ACTIONS``, at the earliest
turn, holds. The repaired sequence is rendered turn by turn: a conversation's pieces, joined in order, are its text.

A conversation may be longer than a task can hold: rows are dealt by range of (conversation, turn, role, text,
row), so a long one is spread over tasks. Each task tells the cost matrix of the pieces at its two ends; these,
two a task, are put together on the driver, which fixes the states at the borders; then every task solves its own.

Defined results: roles are compared without case and outer white space, ``human`` is user, ``ai``, ``bot``,
``model`` and ``gpt`` are assistant; a null or unknown role costs a relabelling; a null text is empty and stays a
turn; rows of a null conversation are one conversation, null turns come first; rows with equal turns are ordered by
role and text; repeated rows are turns of their own; a conversation of a system turn alone gets an empty user turn;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.llm.common import checkpoint

SYSTEM, USER, ASSISTANT, OTHER = range(4)
ROLES = ("system", "user", "assistant")
ALIASES = {"human": USER, "ai": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "gpt": ASSISTANT} | {r: n for n, r in enumerate(ROLES)}
#: States: nothing yet, or the role of the last turn.
START = 3
STATES = (SYSTEM, USER, ASSISTANT, START)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ACTIONS = ("keep", "merge", "relabel", "insert", "merge_relabel", "insert_relabel")
MERGE, RELABEL, INSERT = 2, 5, 3
COST = {"keep": 0, "merge": MERGE, "relabel": RELABEL, "insert": INSERT, "merge_relabel": MERGE + RELABEL, "insert_relabel": INSERT + RELABEL}
FAR = 1 << 40
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def role_of(role: str | None) -> int:
    return ALIASES.get((role or "").strip().lower(), OTHER)


def choices(state: int, role: int) -> list[tuple[int, int, str, int | None]]:
    """(cost, state after, action, role put in before) of one turn, in the order of preference."""
    found = []
    for after in NEXT[state]:
        found.append(("keep" if after == role else "relabel", after, None))
    if state != START:
        found.append(("merge" if state == role else "merge_relabel", state, None))
    for between in NEXT[state]:
        for after in NEXT[between]:
            found.append(("insert" if after == role else "insert_relabel", after, between))
    return sorted(((COST[a], s, a, b) for a, s, b in found), key=lambda c: (c[0], ACTIONS.index(c[2]), c[1], -1 if c[3] is None else c[3]))


#: For each state and role, the best choice that leads to each state.
BEST: dict[tuple[int, int], list[tuple[int, int, str, int | None]]] = {}
for _state in STATES:
    for _role in range(4):
        _seen: dict[int, tuple] = {}
        for _c in choices(_state, _role):
            _seen.setdefault(_c[1], _c)
        BEST[_state, _role] = sorted(_seen.values(), key=lambda c: (c[0], c[1]))

#: What ending in a state costs: a system turn alone needs a user turn.
ENDING = {SYSTEM: INSERT, USER: 0, ASSISTANT: 0, START: 0}


def solve(roles: list[int], entry: int = START, leave: int | None = None) -> tuple[int, list[tuple[int, str, int | None]]]:
    """Least cost and (state, action, role put in before) of each turn; ``leave``: the state to end in, else any."""
    cost, back = {entry: 0}, []
    for role in roles:
        after: dict[int, int] = {}
        via: dict[int, tuple[int, str, int | None]] = {}
        for state in sorted(cost):
            for extra, to, action, between in BEST[state, role]:
                if cost[state] + extra < after.get(to, FAR):
                    after[to] = cost[state] + extra
                    via[to] = (state, action, between)
        back.append(via)
        cost = after
    end = leave if leave is not None else min(cost, key=lambda s: (cost[s] + ENDING[s], s))
    total = cost[end] + (ENDING[end] if leave is None else 0)
    path, state = [], end
    for via in reversed(back):
        before, action, between = via[state]
        path.append((state, action, between))
        state = before
    return total, path[::-1]


def matrix(roles: list[int]) -> list[list[int]]:
    """Least cost from each state to each over some turns."""
    out = []
    for entry in STATES:
        cost = {entry: 0}
        for role in roles:
            after: dict[int, int] = {}
            for state, c in cost.items():
                for extra, to, _, _ in BEST[state, role]:
                    after[to] = min(after.get(to, FAR), c + extra)
            cost = after
        out.append([cost.get(s, FAR) for s in STATES])
    return out


def quoted(text: str | None) -> str:
    """Markers in a text become ordinary text."""
    return (text or "").replace("<|", "< |")


def rendered(before: int, step: tuple[int, str, int | None], text: str | None, last: bool) -> str:
    """The piece of one turn, given the state before it."""
    state, action, between = step
    if action.startswith("merge"):
        out = "\n" + quoted(text)
    else:
        out = CLOSE if before != START else ""
        if between is not None:
            out += f"{OPEN}{ROLES[between]}\n{CLOSE}"
        out += f"{OPEN}{ROLES[state]}\n{quoted(text)}"
    if last:
        out += CLOSE
        if state == SYSTEM:
            out += f"{OPEN}{ROLES[USER]}\n{CLOSE}"
    return out


def groups(rows: Iterable[tuple]) -> Iterator[tuple[object, list[tuple]]]:
    """Consecutive rows of one conversation."""
    own: list[tuple] = []
    for row in rows:
        if own and row[0] != own[0][0]:
            yield own[0][0], own
            own = []
        own.append(row)
    if own:
        yield own[0][0], own


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True)


END_DDL = "task int, n int, conv_id long, matrix array<array<long>>"
TURN_DDL = "conv_id long, turn long, role string, repaired_role string, action string, inserted_role string, cost int, piece string"


def ends(ordered: DataFrame) -> DataFrame:
    """(task, n, conv_id, matrix) of each task's first and last conversation; one row if it has only one."""
    schema = to_arrow_schema(StructType.fromDDL(END_DDL))

    def run(batches):
        from pyspark import TaskContext

        first = last = None
        n = 0
        for conv, own in groups((r[0], role_of(r[1])) for r in rows_of(batches)):
            last = (n, conv, [r[1] for r in own])
            first = first or last
            n += 1
        found = [first, last][: min(n, 2)]
        if found:
            yield pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId()] * len(found), pa.int32()), pa.array([f[0] for f in found], pa.int32()),
                pa.array([f[1] for f in found], pa.int64()), pa.array([matrix(f[2]) for f in found], schema.field("matrix").type),
            ], schema=schema)

    return ordered.select("conv_id", "role").mapInArrow(run, END_DDL)


def borders(found: list[tuple[int, int, object, list[list[int]]]]) -> dict[tuple[int, int], tuple[int, int | None, bool]]:
    """For each piece of a conversation that lies in several tasks: state before it, state after it, whether it is the last."""
    chains: list[list[tuple]] = []
    for piece in sorted(found, key=lambda r: (r[0], r[1])):
        if chains and chains[-1][-1][2] == piece[2] and chains[-1][-1][0] != piece[0]:
            chains[-1].append(piece)
        else:
            chains.append([piece])
    out = {}
    for chain in (c for c in chains if len(c) > 1):
        costs = [{START: 0}]
        back = []
        for *_, m in chain:
            after, via = {}, {}
            for state in sorted(costs[-1]):
                for to in STATES:
                    if (c := costs[-1][state] + m[state][to]) < after.get(to, FAR):
                        after[to], via[to] = c, state
            costs.append(after)
            back.append(via)
        state = min(costs[-1], key=lambda s: (costs[-1][s] + ENDING[s], s))
        for k in range(len(chain) - 1, -1, -1):
            out[chain[k][0], chain[k][1]] = (back[k][state], state, k == len(chain) - 1)
            state = back[k][state]
    return out


def repair(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row for each turn: conv_id, turn, role, repaired_role, action, inserted_role, cost, piece."""
    rows = df.select(F.col("conv_id").cast("long"), "role", F.col("turn").cast("long"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n"))
    order = ["conv_id", "turn", "role", "h", "n"]
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    ordered = checkpoint(dealt.sortWithinPartitions(*order).select("conv_id", "role", "turn", "text"))
    shared = df.sparkSession.sparkContext.broadcast(borders([tuple(r) for r in ends(ordered).collect()]))  # two rows a task at most
    schema = to_arrow_schema(StructType.fromDDL(TURN_DDL))

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        out: list[tuple] = []

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for n, (conv, own) in enumerate(groups(rows_of(batches))):
            before, leave, last = shared.value.get((task, n), (START, None, True))
            _, path = solve([role_of(r[1]) for r in own], before, leave)
            for k, ((_, role, turn, text), step) in enumerate(zip(own, path, strict=True)):
                state, action, between = step
                is_last = last and k == len(own) - 1
                cost = COST[action] + (ENDING[state] if is_last else 0)
                out.append((conv, turn, role, ROLES[state], action, None if between is None else ROLES[between], cost, rendered(before, step, text, is_last)))
                before = state
                if len(out) == 1024:
                    yield told(out)
                    out = []
        if out:
            yield told(out)

    return ordered.mapInArrow(run, TURN_DDL)
