"""Conversation repair against a plain shortest path over (row, state), whole and in pieces."""

import hashlib
import heapq
import random
import zlib

from pyspark.sql import functions as F

from saleslens.llm import queries, repair

WS = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAME = {"u": "user", "a": "assistant"}


def plain_repair(rows):
    """rows: (turn, role, text) in order.  All numbers of the contract by their definitions, the path by Dijkstra over (cost, audit)."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(WS)
        faults.append("blank" if not body else "dup" if (role, text) in seen else "cut" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        to = next(b for (a, b) in NEXT if a == state and b != "s")
        heapq.heappush(heap, (cost + 5, audit + "I", i, to, out + (NAME[to] + ":",)))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            late = 5 * (faults[i] == "cut")
            if faults[i] in ("", "cut"):
                if (state, role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, role[:1], out + (f"{role}:{text}",)))
                heapq.heappush(heap, (cost + late + 1, audit + "R", i + 1, to, out + (f"{NAME[to]}:{text}",)))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("dup"), faults.count("cut"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_order(rows):
    filled = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    return sorted(filled, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def conversations(n, seed):
    pick = random.Random(seed)
    said = ["Fine.", "fine", "What? ", "x!\n", "", " \t", None, "no end", "a.", "b.", "c.", "d.", "e.", "long " * 30 + "."]
    out = []
    for c in [*range(n), None, -5]:
        size = pick.choice([1, 2, 3, 5, 8, 13, 60])
        for t in range(size):
            turn = pick.choice([t, t, t, t, t + pick.randrange(5), None])
            out.append((c, turn, pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), pick.choice(said) if pick.random() < 0.5 else f"say {pick.randrange(size * 2)}."))
    return out


def check(spark, rows, chunk, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, Part string")
        got = repair.digests(repair.repair(df, chunk=chunk)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want: dict = {}
    for c, *r in rows:
        want.setdefault(c, []).append(tuple(r))
    assert sorted(map(repr, (r.conv for r in got))) == sorted(map(repr, want))
    for r in got:
        assert tuple(r)[1:] == plain_repair(plain_order(want[r.conv])), (r.conv, plain_order(want[r.conv]))


def test_whole_and_in_pieces(spark):
    rows = conversations(150, 1)
    check(spark, rows, repair.CHUNK, 2)
    check(spark, rows, 4, 7)


def test_one_conversation_holds_most_rows(spark):
    pick = random.Random(3)
    rows = [(7, None if i % 50 == 0 else i // 2, pick.choice(["user", "assistant", "system"]), pick.choice(["ok.", f"t{i}.", f"t{i}", ""])) for i in range(3000)]
    check(spark, rows + conversations(5, 4), 64, 8)


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.digests(repair.repair(df)).count() == 0
    check(spark, [(1, 0, "system", "only."), (2, 5, "assistant", "a."), (3, 0, "user", "u"), (4, None, None, None), (5, 1, "user", "u."), (5, 1, "user", "u.")], 1024, 2)


def test_damage(spark):
    rows = [(c, t, "assistant", "a. b! c? d.") for c in (None, *range(40)) for t in (None, *range(8))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            new = (c, t, "user" if kind == 4 else role, "" if kind == 1 else "a b c d" if kind == 2 else text)
            want += [new] * (1 + (kind == 3))
    assert sorted(map(repr, (tuple(r) for r in repair.damaged(df).collect()))) == sorted(map(repr, want))


def test_query_keeps_conversations_without_rows(spark, tmp_path):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "x."), (gone + 1, 1, "user", "x.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    row = queries.op12_repair(spark, str(tmp_path)).where(F.col("conv_id") == gone).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
