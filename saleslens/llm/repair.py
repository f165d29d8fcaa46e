"""Conversation structure repair: the cheapest edits that give a conversation the role sequence ``(s?(ua)+)?``.

Roles count by their initial (system, user, assistant).  Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert of an empty turn 5; a truncated
turn that isn't deleted adds 5; blank turns and repeats of an earlier turn must be deleted.  What is read so far is one of four states (nothing, system,
user, assistant), and state and edit determine the next state, so the costs of a whole conversation are a table of turns by
states.  Many conversations are solved at once: bucketed by length, laid out time-major in NumPy (turn, conversation, state), costs stored from the last
turn to the first in one vectorised step a turn, and edits traced forwards likewise, at each turn the first by ASCII (D, I, K, R) that keeps the cost.

Spark deals rows out by ranges of (conversation, turn, role, text), so a conversation of any length is spread over partitions.  Those that lie inside a
partition and have at most ``chunk`` rows are solved where they are.  Pieces of all others are summed up as 4 x 4 tables of costs from state
to state; the tables of a conversation give what follows each piece, the pieces' end states what precedes it, and then pieces are traced independently.

Defined cases: null roles and texts are one space, so a turn with a null role must be reroled or deleted and a null text is blank; rows are ordered by turn
(nulls first), then role, then MD5 of the text; a null conversation id is one conversation; repeated rows are duplicates; a
conversation without rows has no result here; an empty table gives an empty one; columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a piece, at most.
CHUNK = 1024
SPACE = " \t\n\x0b\x0c\r"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing, system, user, assistant read; initials: s, u, a, others.
STEP = np.array([[1, 2, 4, 4], [4, 2, 4, 4], [4, 4, 3, 4], [4, 2, 4, 4]])
TARGET = np.array([2, 2, 3, 2])
NAMES = {2: "user", 3: "assistant"}
#: Costs of what must still be inserted at the end, by state.
CLOSED = np.array([0, 10, 5, 0])
FAR = 1 << 40
LEGAL = np.zeros((4, 4), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True
ACTIONS = "DKR"
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PIECE = "part long, whole boolean, " + "".join(f"{s} long, " for s in STATS) + "audit string, turns array<long>, faults array<int>, roles array<string>, texts array<string>"


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) of a table of conversations, damaged by a hash of conversation and turn (nulls count as one space).

    Of 20 hash classes the first drops the row, the next empties its text, removes its ``[.!?]``, repeats the row, and sets the role to user.
    """
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def initials(roles: Iterable[str]) -> np.ndarray:
    return np.array(["sua".find(r[0]) % 4 if r else 3 for r in roles], np.int64)


def backward(init: np.ndarray, fault: np.ndarray, live: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs (turn, conversation, state) of all that follows, from those after the last turn; turns that aren't ``live`` are padding."""
    turns, many = init.shape
    cost = np.empty((turns + 1, many, 4), np.int64)
    cost[turns] = after
    far = np.full((many, 1), FAR)
    for t in range(turns - 1, -1, -1):
        following = cost[t + 1]
        late = np.where(fault[t] == TRUNCATED, 5, 0)[:, None]
        keep = np.take_along_axis(np.hstack([following, far]), STEP[:, init[t]].T, 1) + late
        stays = np.minimum(keep, following[:, TARGET] + 1 + late)
        best = np.minimum(np.where(((fault[t] == FINE) | (fault[t] == TRUNCATED))[:, None], stays, FAR), following + 2)
        for _ in range(2):  # a third turn inserted at one place is never needed
            best = np.minimum(best, best[:, TARGET] + 5)
        cost[t] = np.where(live[t][:, None], best, following)
    return cost


def trace(cost: np.ndarray, init: np.ndarray, fault: np.ndarray, live: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(turns inserted before, action, state before) of every turn and the last state: of the cheapest edits those first by ASCII."""
    turns, many = init.shape
    inserted, action, before = (np.zeros((turns, many), np.int64) for _ in range(3))
    each, far = np.arange(many), np.full((many, 1), FAR)
    for t in range(turns):
        before[t], following = state, np.hstack([cost[t + 1], far])
        left = cost[t][each, state]
        for _ in range(2):
            push = live[t] & (following[each, state] + 2 != left) & (cost[t][each, TARGET[state]] + 5 == left)
            inserted[t] += push
            state, left = np.where(push, TARGET[state], state), left - 5 * push
        late = np.where(fault[t] == TRUNCATED, 5, 0)
        delete, step = following[each, state] + 2 == left, STEP[state, init[t]]
        keep = ~delete & (following[each, step] + late == left)
        action[t] = np.where(delete, 0, np.where(keep, 1, 2))
        state = np.where(live[t] & ~delete, np.where(keep, step, TARGET[state]), state)
    return inserted, action, before, state


def _buckets(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of similar lengths (up to the next power of two)."""
    size = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for s in np.unique(size):
        yield np.flatnonzero(size == s)


def _laid_out(parts: Sequence[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-major array of some of the parts, and which places are filled."""
    lengths = np.array([len(parts[i]) for i in at])
    live = np.arange(lengths.max(initial=0))[:, None] < lengths
    out = np.zeros(live.shape, np.int64)
    out.T[live.T] = np.concatenate([parts[i] for i in at])
    return out, live


def solve(init: Sequence[np.ndarray], faults: Sequence[np.ndarray], after: np.ndarray, start: np.ndarray | None) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Edits of each piece as ``trace`` gives them, its last state, and its costs by start state, when ``after`` (piece, state) follows; without ``start`` only the costs."""
    edits: list = [None] * len(init)
    ends, costs = np.zeros(len(init), np.int64), np.zeros((len(init), 4), np.int64)
    for at in _buckets(np.array([len(x) for x in init], np.int64)):
        (i, live), (f, _) = _laid_out(init, at), _laid_out(faults, at)
        cost = backward(i, f, live, after[at])
        costs[at] = cost[0]
        if start is None:
            continue
        inserted, action, before, ends[at] = trace(cost, i, f, live, start[at])
        for j, k in enumerate(at):
            n = len(init[k])
            edits[k] = (inserted[:n, j], action[:n, j], before[:n, j])
    return edits, ends, costs


def edited(roles: Sequence[str], texts: Sequence[str], edit: tuple[np.ndarray, np.ndarray, np.ndarray], end: int, last: bool) -> tuple[str, list[str], list[str]]:
    """(audit, roles, texts) of a piece after its edits; after the ``last`` piece come the turns that its end state lacks."""
    audit: list[str] = []
    new: list[tuple[str, str]] = []

    def insert(state: int, n: int) -> int:
        for _ in range(n):
            state = int(TARGET[state])
            audit.append("I")
            new.append((NAMES[state], ""))
        return state

    for role, text, n, action, state in zip(roles, texts, *(x.tolist() for x in edit), strict=True):
        state = insert(state, n)
        audit.append(ACTIONS[action])
        if action:
            new.append((role if action == 1 else NAMES[int(TARGET[state])], text))
    if last:
        insert(end, int(CLOSED[end]) // 5)
    return "".join(audit), [r for r, _ in new], [t for _, t in new]


def described(roles: list[str], turns: list[int | None], faults: np.ndarray, audit: str, first: str | None = None, turn: int | None = None) -> dict:
    """Counts of a piece, which add up to those of its conversation; ``first`` and ``turn`` are the role and turn number before it."""
    i = initials(roles if first is None else [first, *roles])
    known = [t for t in (turn, *turns) if t is not None]
    edits = audit.replace("I", "")
    kept_late = sum(1 for e, f in zip(edits, faults.tolist(), strict=True) if e != "D" and f == TRUNCATED)
    return {"gaps": sum(max(0, b - a - 1) for a, b in zip(known, known[1:], strict=False)), "blank": int((faults == BLANK).sum()), "duplicate": int((faults == DUPLICATE).sum()),
            "truncated": int((faults == TRUNCATED).sum()), "illegal": int((~LEGAL[i[:-1], i[1:]]).sum()), "cost": 5 * audit.count("I") + 2 * audit.count("D") + audit.count("R") + 5 * kept_late}


def _pieces(schema: pa.Schema, chunk: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows of a partition to pieces; conversations inside the partition are solved at once, the pieces of others kept as they are."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_part = TaskContext.get().partitionId() << 32
        made = 0
        held: pa.Table | None = None
        inside = False  # whether the first conversation held is known to begin here
        for batch in _with_end(batches):
            table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            convs = table["conv"].to_pylist()
            starts = [0, *(i for i in range(1, len(convs)) if convs[i] != convs[i - 1]), len(convs)]
            whole, apart = [], []
            for a, b in zip(starts, starts[1:], strict=False):
                begins, ends = a > 0 or inside, b < len(convs)
                while b - a > chunk:
                    apart.append((a, a + chunk))
                    a, begins = a + chunk, False
                if not ends and batch is not None:
                    held, inside = table.slice(a), begins
                elif begins and ends:
                    whole.append((a, b))
                else:
                    apart.append((a, b))
            out = [*_solved(table, convs, whole), *_raw(table, convs, apart)]
            for i, row in enumerate(out):
                row["part"] = first_part + made + i
            made += len(out)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return cut


def _with_end(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _columns(table: pa.Table, a: int, b: int) -> tuple[list, list[str], list[str], np.ndarray]:
    rows = table.slice(a, b - a)
    roles, texts, faults = rows["role"].to_pylist(), rows["text"].to_pylist(), rows["fault"].to_numpy().astype(np.int64)
    seen: set[tuple[str, str]] = set()
    for i, said in enumerate(zip(roles, texts, strict=True)):
        if said in seen and faults[i] != BLANK:
            faults[i] = DUPLICATE
        seen.add(said)
    return rows["turn"].to_pylist(), roles, texts, faults


def _solved(table: pa.Table, convs: list, bounds: list[tuple[int, int]]) -> list[dict]:
    got = [_columns(table, a, b) for a, b in bounds]
    edits, ends, _ = solve([initials(g[1]) for g in got], [g[3] for g in got], np.tile(CLOSED, (len(got), 1)), np.zeros(len(got), np.int64))
    out = []
    for (a, _), (turns, roles, texts, faults), edit, end in zip(bounds, got, edits, ends, strict=True):
        audit, new_roles, new_texts = edited(roles, texts, edit, end, True)
        out.append({"conv": convs[a], "whole": True, **described(roles, turns, faults, audit), "audit": audit, "turns": None, "faults": None, "roles": new_roles, "texts": new_texts})
    return out


def _raw(table: pa.Table, convs: list, bounds: list[tuple[int, int]]) -> list[dict]:
    out = []
    for a, b in bounds:
        turns, roles, texts, faults = _columns(table, a, b)
        out.append({"conv": convs[a], "whole": False, "turns": turns, "faults": faults.tolist(), "roles": roles, "texts": texts})
    return out


def _arrow(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(conv, part, whole, gaps, blank, duplicate, truncated, illegal, cost, audit, roles, texts): pieces of the repaired conversations.

    Most conversations are one piece (``whole``); of others the pieces follow each other by ``part``: counts add up, audits, roles and texts are joined.
    """
    spark = rows.sparkSession
    filled = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role, text)]
    t = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), filled[0].alias("role"), filled[1].alias("text"))
    ending = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    t = t.withColumn("fault", F.when(ending == "", BLANK).when(ending.isin(".", "!", "?"), FINE).otherwise(TRUNCATED))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", F.md5(F.col("text").cast("binary"))]
    kind = t.schema["conv"].dataType.simpleString()
    schema = spark.createDataFrame([], f"conv {kind}, {PIECE}").schema
    cut = t.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces(_arrow(schema), chunk), schema)
    pieces = materialize(cut, "repair-pieces")
    result = ["conv", "part", "whole", *STATS, "audit", "roles", "texts"]
    apart = pieces.where("not whole")
    return pieces.where("whole").select(*result).unionByName(_joined(apart, kind).select(*result))


def _joined(pieces: DataFrame, kind: str) -> DataFrame:
    """The pieces of conversations that lie in several, solved together."""
    spark = pieces.sparkSession
    p = pieces.withColumn("id", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")))
    said = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.md5(F.concat(F.length(x["roles"]).cast("string"), F.lit(":"), x["roles"], x["texts"]).cast("binary")))
    hashes = p.select("id", "part", F.explode(F.array_distinct(said)).alias("h"))
    firsts = hashes.groupBy("id", "h").agg(F.min("part").alias("first"), F.max("part").alias("final")).where("first < final").drop("final")
    again = hashes.join(firsts, ["id", "h"]).where("part > first").groupBy("id", "part").agg(F.collect_set("h").alias("earlier"))
    faults = F.transform(F.arrays_zip("faults", said.alias("said")), lambda x: F.when((x["faults"] != BLANK) & F.array_contains("earlier", x["said"]), DUPLICATE).otherwise(x["faults"]))
    p = p.join(again, ["id", "part"], "left").withColumn("faults", F.when(F.col("earlier").isNull(), F.col("faults")).otherwise(faults))
    p = materialize(p.select("conv", "id", "part", "turns", "faults", "roles", "texts"), "repair-apart")

    def summed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            init, fault, many = [initials(r) for r in b["roles"]], [np.asarray(f, np.int64) for f in b["faults"]], len(b)
            tables = [solve(init, fault, np.tile(np.where(np.arange(4) == s, 0, FAR), (many, 1)), None)[2] for s in range(4)]
            known = [[int(x) for x in t if not pd.isna(x)] for t in b["turns"]]
            yield pd.DataFrame({"id": b["id"], "part": b["part"], "table": [np.stack([x[i] for x in tables], 1).ravel() for i in range(many)],
                                "role": [r[-1] for r in b["roles"]], "turn": pd.array([k[-1] if k else None for k in known], "Int64")})

    sums = p.select("id", "part", "turns", "faults", "roles").mapInPandas(summed, "id string, part long, table array<long>, role string, turn long")
    sums = materialize(sums, "repair-sums")

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        after, afters = CLOSED, []
        for table in reversed(list(rows["table"])):
            afters.append(after)
            after = np.minimum((np.reshape(table, (4, 4)) + after).min(1), FAR)
        turns, held = [], None
        for t in rows["turn"]:
            turns.append(held)
            held = held if pd.isna(t) else int(t)
        return pd.DataFrame({"id": rows["id"].to_numpy(), "part": rows["part"].to_numpy(), "after": afters[::-1], "before_role": [None, *rows["role"].iloc[:-1]],
                             "before_turn": pd.array(turns, "Int64"), "last": [*[False] * (len(rows) - 1), True]})

    links = sums.groupBy("id").applyInPandas(linked, "id string, part long, after array<long>, before_role string, before_turn long, last boolean")
    p = materialize(p.join(links, ["id", "part"]), "repair-linked")

    def ended(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            init, fault = [initials(r) for r in b["roles"]], [np.asarray(f, np.int64) for f in b["faults"]]
            after = np.array(list(b["after"]), np.int64).reshape(-1, 4)
            ends = np.stack([solve(init, fault, after, np.full(len(b), s))[1] for s in range(4)], 1)
            yield pd.DataFrame({"id": b["id"], "part": b["part"], "ends": list(ends)})

    def started(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        state, starts = 0, []
        for ends in rows["ends"]:
            starts.append(state)
            state = int(ends[state])
        return pd.DataFrame({"id": rows["id"].to_numpy(), "part": rows["part"].to_numpy(), "start": starts})

    ends = materialize(p.select("id", "part", "faults", "roles", "after").mapInPandas(ended, "id string, part long, ends array<long>"), "repair-ends")
    starts = ends.groupBy("id").applyInPandas(started, "id string, part long, start long")
    done = spark.createDataFrame([], f"conv {kind}, {PIECE}").schema
    out_schema = _arrow(done)

    def finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            init, fault = [initials(r["roles"]) for r in rows], [np.array(r["faults"], np.int64) for r in rows]
            edits, ends, _ = solve(init, fault, np.array([r["after"] for r in rows], np.int64).reshape(-1, 4), np.array([r["start"] for r in rows], np.int64))
            out = []
            for r, f, edit, end in zip(rows, fault, edits, ends, strict=True):
                audit, roles, texts = edited(r["roles"], r["texts"], edit, end, r["last"])
                counts = described(r["roles"], r["turns"], f, audit, r["before_role"], r["before_turn"])
                out.append({"conv": r["conv"], "part": r["part"], "whole": False, **counts, "audit": audit, "turns": None, "faults": None, "roles": roles, "texts": texts})
            yield pa.RecordBatch.from_pylist(out, out_schema)

    return p.join(starts, ["id", "part"]).mapInArrow(finished, done)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation; the hash is of ``role:text`` lines.

    The pieces of one conversation pass through one task in order, one at a time; only their audits are held, a letter an edit.
    """
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit(":"), x["texts"])), "\n")
    columns = ["conv", *STATS, "audit"]
    whole = repaired.where("whole").select(*columns, F.sha2(lines, 256).alias("repaired_sha256"))
    schema = whole.schema
    arrow = _arrow(schema)

    def streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: dict | None = None
        audits: list[str] = []
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if row is None or row["conv"] != r["conv"]:
                    if row is not None:
                        done.append(row | {"audit": "".join(audits), "repaired_sha256": digest.hexdigest()})
                    row, audits, digest, empty = {"conv": r["conv"]} | dict.fromkeys(STATS, 0), [], hashlib.sha256(), True
                row |= {s: row[s] + r[s] for s in STATS}
                audits.append(r["audit"])
                if r["n"]:
                    digest.update((r["lines"] if empty else "\n" + r["lines"]).encode())
                    empty = False
            if done:
                yield pa.RecordBatch.from_pylist(done, arrow)
        if row is not None:
            yield pa.RecordBatch.from_pylist([row | {"audit": "".join(audits), "repaired_sha256": digest.hexdigest()}], arrow)

    apart = repaired.where("not whole").select(*columns, "part", F.size("roles").alias("n"), lines.alias("lines"))
    return whole.unionByName(apart.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(streamed, schema))
