import hashlib
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldloom.llm import chat_trees as c

from . import brute

ROWS = "conv_id long, turn long, role string, text string"
TEXT = st.lists(st.sampled_from(["\\", "###", "#", "</turn>", "\n", ": ", "\\h", "\\e", "é", "a", " "]), max_size=8).map("".join)


def read(chats):
    return {r["conv_id"]: (r["turns"], r["masked"], r["formatted"]) for r in chats.select("conv_id", c.turns_of(F.col("formatted")).alias("turns"), c.under_mask(F.col("formatted"), F.col("loss_spans")).alias("masked"), "formatted").collect()}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.sampled_from(["user", "assistant", "odd: #### role\\", None]), st.one_of(st.none(), TEXT)), min_size=1, max_size=25))
def test_chains_read_back(spark, rows):
    got = read(c.formatted(c.chain(spark.createDataFrame(rows, ROWS))))
    want = brute.chats([(a, t, r, x) for a, t, r, x in rows])
    assert {k: sorted(map(tuple, v[0])) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for k, (turns, masked, text) in got.items():
        assert masked == "".join(t["text"] for t in turns if t["role"] == "assistant")
        assert text.count("</turn>\n") == len(turns)


def test_trees_rank_branches(spark):
    #      1 -> 2 -> 4 (score 1+5+1), 1 -> 3 -> 5 -> 6 (1+2+2+2: equal, longer), 7: a second root (9); 8 -> 9 -> 8: a cycle; 10: its parent isn't there
    nodes = [(1, 1, None, 1.0), (1, 2, 1, 5.0), (1, 4, 2, 1.0), (1, 3, 1, 2.0), (1, 5, 3, 2.0), (1, 6, 5, 2.0), (2, 7, None, 9.0), (2, 8, 9, 99.0), (2, 9, 8, 99.0), (3, 10, 77, None), (None, 1, None, 1.0)]
    rows = spark.createDataFrame([(*n, "user", f"t{n[1]}") for n in nodes], "conv_id long, node long, parent long, score double, role string, text string")
    got = defaultdict(list)
    for r in c.formatted(rows, best=2).withColumn("turns", c.turns_of(F.col("formatted"))).collect():
        got[r["conv_id"]].append((r["branch_rank"], r["branch_score"], [t["text"] for t in r["turns"]]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(1, 7.0, ["t1", "t3", "t5", "t6"]), (2, 7.0, ["t1", "t2", "t4"])], 2: [(1, 9.0, ["t7"])], 3: [(1, 0.0, ["t10"])], None: [(1, 1.0, ["t1"])]}


def test_deep_chain_and_empty_table(spark):
    rows = spark.range(300).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    turns, masked, _ = read(c.formatted(c.chain(rows)))[5]
    assert masked == "".join(str(i) for i in range(300)) and len(turns) == 300
    assert c.formatted(c.chain(spark.createDataFrame([], ROWS))).count() == 0


def test_query(spark, small):
    from foldloom.llm import queries as q

    got = {r["conv_id"]: r for r in q.op2_chat_format(spark, small).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    text = "\\### Assistant: </turn> ok"
    for k, turns in brute.chats([*rows, (-7, 0, "user", text), (-7, 1, "assistant", text)]).items():
        whole = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (got[k]["n_turns"], got[k]["turns_sha256"], got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest())
