import hashlib
import random

from pyspark.sql import functions as F

from gistmill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def read(spark, rows, template=chat.CHATML):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("segments", F.lit("x")).withColumn("block", F.lit(1))
    made = chat.format_chat(df, template)
    made = made.withColumn("turns", chat.read_turns(F.col("formatted"), template))
    return {r["conv_id"]: r for r in made.withColumn("learned", chat.learned_text(F.col("segments"))).collect()}


def test_round_trip_of_hostile_texts(spark):
    r = random.Random(8)
    parts = ["<|im_end|>", "<|im_start|>", "<", "|", "\\", "<\\|", "\n", "assistant", "é", "<|", "\\n", "$1"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randrange(8)))
    rows, want = [], {}
    for c in range(60):
        want[c] = []
        for t in range(r.randrange(1, 6)):
            role, text = r.choice(["user", "assistant", word()]), word()
            rows.append((c, t, role, text))
            want[c].append((role, text))
    for c, x in read(spark, rows).items():
        assert [tuple(t) for t in x["turns"]] == want[c]
        assert x["learned"] == "".join(t for role, t in want[c] if role == "assistant")
        assert x["formatted"].count("<|im_start|>") == len(want[c])


def test_order_nulls_and_repeats(spark):
    rows = [(1, 2, "assistant", None), (1, 1, "user", "q"), (None, 0, None, "x"), (2, None, "user", "first"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a")]
    got = read(spark, rows)
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "q"), ("assistant", "")]
    assert [tuple(t) for t in got[None]["turns"]] == [("", "x")]
    assert [tuple(t) for t in got[2]["turns"]] == [("user", "first"), ("assistant", "a"), ("assistant", "a")]
    assert (got[1]["valid"], got[2]["valid"], got[None]["valid"]) == (True, False, False)


def test_machine_on_long_and_wrong_conversations(spark):
    def turns(conv, roles):
        return [(conv, i, role, "t") for i, role in enumerate(roles)]

    pair = ["user", "assistant"]
    rows = turns(1, pair * 400) + turns(2, ["system", *pair]) + turns(3, pair * 300 + ["user"])
    rows += turns(4, pair * 200 + ["assistant"] + pair * 200) + turns(5, ["assistant"]) + turns(6, ["user", "assistant", "tool", "assistant"])
    got = read(spark, rows)
    assert {c: x["valid"] for c, x in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True}


def test_another_template(spark):
    own = chat.Template(start="<|turn|>", end="<|stop|>", turn_end="", learned=("user",))
    got = read(spark, [(1, 0, "user", "a <|stop|> b"), (1, 1, "assistant", "c")], own)[1]
    assert got["learned"] == "a <|stop|> b"
    assert got["formatted"] == "<|turn|>user\na <\\|stop|> b<|stop|><|turn|>assistant\nc<|stop|>"


def test_empty_table(spark):
    assert chat.format_chat(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hashlib.sha256(b"").hexdigest()
