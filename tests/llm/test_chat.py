import random

from pyspark.sql import functions as F

from flintframe.llm import chat


def test_round_trip(spark):
    rnd = random.Random(2)
    bits = ["\\", "#", "##", "###", "####", "</turn>", "</turn", "<", ": ", ":", " ", "\n", "h", "e", "c", "Assistant", "é", "😀", "role=", ""]
    rows = [(k // 5, k % 5, rnd.choice(["user", "assistant", "system", "tool: x", "a:", "", None, "\\h"]), None if k % 17 == 0 else "".join(rnd.choices(bits, k=rnd.randrange(12)))) for k in range(600)]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (500, 1, "user", "same"), (500, 1, "user", "same")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("segments", F.lit(1)))
    out = out.select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss"))
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for r in out.collect():
        own = sorted((x for x in rows if x[0] == r.conv_id), key=order)
        assert [(x.role, x.text) for x in r.back] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted and r.n_turns == len(own)


def test_machine(spark):
    talks = {1: "system user assistant", 2: "user assistant user assistant", 3: "assistant user", 4: "user user", 5: "user", 6: "system system", 7: "user tool assistant"}
    rows = [(k, t, r, "x") for k, roles in talks.items() for t, r in enumerate(roles.split())]
    out = {r.conv_id: (r.valid, r.error_turn) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert out == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, 1), 5: (False, None), 6: (False, 1), 7: (False, 1)}


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).isEmpty()
