from strainwise.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, conv string, place string"


def rows(spark, turns):
    return spark.createDataFrame([(*t, "c", "p") for t in turns], SCHEMA)


def told(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["conv_id"] or -1, r["segment"])):
        out.setdefault(r["conv_id"], [r["n_turns"], r["copies"], ""])[2] += r["text"]
    return out


def test_snapshots_collapse_into_the_longest(spark):
    say = [("user", "hi"), ("assistant", "yes?"), ("user", "bye")]
    turns = [(c, t, *say[t]) for c, n in ((1, 1), (2, 3), (3, 2), (4, 3)) for t in range(n)]
    turns += [(5, 0, "user", "hi"), (5, 1, "assistant", "no?")]
    out = told(chat.chat_format(rows(spark, turns)))
    assert set(out) == {2, 5}
    assert out[2][:2] == [3, 2]
    assert out[2][2] == ("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes?<|im_end|>\n"
                         "<|im_start|>user\nbye<|im_end|>\n")


def test_nulls_gaps_and_order(spark):
    turns = [(1, 5, "assistant", "b"), (1, 2, None, None), (2, 0, "user", ""), (2, 9, "assistant", "b"),
             (None, 0, "user", "q"), (3, None, "user", "last"), (3, 1, "user", "first")]
    out = told(chat.chat_format(rows(spark, turns)))
    assert set(out) == {1, 2, 3, None}  # a missing role differs from user when comparing
    assert out[1][2] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert out[3][2].index("first") < out[3][2].index("last")


def test_long_conversation_over_blocks_and_segments(spark):
    turns = [(1, t, "user", f"m{t}") for t in range(2500)] + [(2, t, "user", f"m{t}") for t in range(2100)]
    out = told(chat.chat_format(rows(spark, turns), segment_turns=300))
    assert set(out) == {1} and out[1][0] == 2500
    assert out[1][2].count("<|im_start|>") == 2500
    places = [out[1][2].index(f"\nm{t}<") for t in range(2500)]
    assert places == sorted(places)


def test_empty_table(spark):
    assert chat.chat_format(rows(spark, [])).collect() == []
