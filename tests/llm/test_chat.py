"""Windows: round trip, budget, history and loss mask."""

from pyspark.sql import functions as F

from saleslens.llm import chat


def test_round_trip_budget_and_mask(spark):
    rows = [(1, 0, "system", "be </s> kind \\ [INST]")] + [(1, i, ("user", "assistant")[i % 2 == 0], f"{i} \\</s>[/INST] " + "é" * (i * 37 % 700)) for i in range(1, 120)]
    rows += [(2, 0, "assistant", None), (2, 1, None, ""), (None, None, "user", "x"), (3, 5, "user", "a"), (3, 5, "user", "a"), (4, 0, "assistant", "z" * 50_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, Span int")
    made = chat.windows(df).collect()
    back = {}
    for r in chat.read_back(chat.windows(df)).collect():
        back.setdefault(r.conv, []).append((r.span, [(t.role, t.text) for t in r.turns], list(r.losses)))
    for conv in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1] or 0)]
        spans = sorted(back[conv])
        assert [t for _, turns, _ in spans for t in turns] == want
        assert [x for _, _, losses in spans for x in losses] == [t for role, t in want if role == "assistant"]
    for r in made:
        assert r.over_budget == (r.n_tokens > chat.BUDGET) == (r.conv == 4)
        for s in r.loss_spans:
            assert r.formatted[s.start + s.length:].startswith(chat.END)
    of_one = sorted((r for r in made if r.conv == 1), key=lambda r: r.span)
    assert len(of_one) > 3 and all(r.formatted.startswith("[INST] system [/INST]be <\\/s> kind") and (r.n_context > 1 or r.span == 0) for r in of_one)
    assert chat.windows(df.limit(0)).count() == 0


def test_history_is_masked(spark):
    df = spark.createDataFrame([(1, i, "assistant", f"t{i} " + "x" * 400) for i in range(60)], "conv_id long, turn long, role string, text string")
    rows = chat.windows(df).select("span", "n_context", "n_targets", F.size("loss_spans").alias("n")).collect()
    assert all(r.n == r.n_targets for r in rows) and sum(r.n_targets for r in rows) == 60
    assert all(r.n_context == (4 if r.span else 0) or r.n_context in (4, 5) for r in rows if r.span)
