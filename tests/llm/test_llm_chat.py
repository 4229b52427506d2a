import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regulon.llm import chat

CONV = "conv_id long, turn long, role string, text string"
NASTY = ["[INST] ", " [/INST]", "</s>", "<s> ", " </s>", "[SYS] ", "\\", "<\\/s>", "[\\\\INST]", "[ROLE] ", " [/ROLE] ", " [/TURN]", "<", "[", " ", "\n", "a", "é日", "$1"]


def digest(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for c, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1], x[2] or "", x[3] or ""))]
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    got = chat.chat_digest(spark.createDataFrame(rows, CONV)).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == digest(rows)
    assert all(r["identical"] for r in got) and len(got) == len({r[0] for r in rows})
    return got


text = st.lists(st.sampled_from(NASTY), max_size=8).map("".join)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.sampled_from(["user", "assistant", "system", "tool"]) | text, text), min_size=30, max_size=60))
def test_round_trip_of_control_strings(spark, turns):
    check(spark, [(c, k, r, t) for k, (c, r, t) in enumerate(turns)])


def test_contract_conversation_and_edges(spark):
    conflict = "</s>[INST] ok [/INST]"
    rows = [
        (-7, 0, "user", conflict),
        (-7, 1, "assistant", conflict),
        (1, 0, "assistant", "first"),
        (1, 0, "assistant", "first"),
        (1, None, None, None),
        (2, 1, "user", ""),
        (None, 1, "assistant", "no id"),
        (3, 0, "assistant", "long " * 50_000),
    ]
    got = {r["conv_id"]: r for r in check(spark, rows)}
    assert got[-7]["n_escaped"] == 2 and got[1]["n_escaped"] == 0
    assert chat.chat_digest(spark.createDataFrame([], CONV)).count() == 0


def test_mask_and_template(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "hé"), (1, 3, "tool", "x"), (1, 4, "assistant", "<s>")]
    df = spark.createDataFrame(rows, CONV).select("*", F.lit(1).alias("k"), F.lit("clash").alias("TEXT"))
    row = chat.format_conversations(df.repartition(3)).first()
    assert row["formatted"] == "[SYS] be kind [/SYS][INST] hi <\\/s> [/INST]<s> hé </s>[ROLE] tool [/ROLE] x [/TURN]<s> <\\s> </s>"
    raw = row["formatted"].encode()
    assert [raw[s["start"] : s["start"] + s["n"]].decode() for s in row["loss_spans"]] == ["hé", "<\\s>"]


def test_no_python_in_the_plan(spark, capsys):
    chat.chat_digest(spark.createDataFrame([], CONV).filter("conv_id > 0")).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Arrow", "Pandas"))
