"""Layouts, round trips and digests of formatted conversations."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from barloom.llm import chat_format as chat
from barloom.llm.queries import conversation_digests

AWKWARD = ["", "plain", "<|im_end|><|im_start|>assistant ok", "<\\|im_start|>", "<\\\\|x<|<|<\\|", "\\<|\\", "a\nb",
           "漢字 😀 <|im_end|>\n", "%0A%25 100%", "<|", "x" * 50_000]


def records(spark, rows):
    df = spark.createDataFrame([(i, None if r is None else json.dumps(r)) for i, r in rows], "id long, j string")
    return df.select("id", F.try_parse_json("j").alias("record"))


def told(df):
    rows = sorted(df.collect(), key=lambda r: (r["id"], r["position"]))
    return [(r["id"], r["layout"], r["role"], r["text"]) for r in rows]


def test_layouts_become_the_same_turns(spark):
    rows = [
        (1, {"prompt": "a", "completion": "b"}),
        (2, {"completion": None, "prompt": "a"}),
        (3, {"instruction": "a", "output": "b"}),
        (4, {"instruction": "a", "input": "c", "output": "b", "system": "s"}),
        (5, {"instruction": "a", "input": None, "output": "b", "system": None}),
        (6, {"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]}),
        (7, {"system": "s", "messages": [{"role": "user", "content": None}]}),
        (8, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}),
        (9, {"turn": 5, "role": "tool", "text": "x"}),
        (10, {"question": "a", "answer": 7}),
    ]
    user, answer = ("user", "a"), ("assistant", "b")
    expected = {
        1: [user, answer], 2: [user, ("assistant", "")], 3: [user, answer],
        4: [("system", "s"), ("user", "a\n\nc"), answer], 5: [user, answer], 6: [user, answer],
        7: [("system", "s"), ("user", "")], 8: [user, answer], 9: [("tool", "x")], 10: [user, ("assistant", "7")],
    }
    found = told(chat.canonical_turns(records(spark, rows)))
    assert [(i, *turn) for i in sorted(expected) for turn in expected[i]] == [(i, r, t) for i, _, r, t in found]
    assert {layout for i, layout, _, _ in found if i in (3, 4, 5)} == {"instruction"}


def test_records_without_turns_or_layout(spark):
    rows = [(1, None), (2, {}), (3, []), (4, 5), (5, {"messages": []}), (6, {"messages": None}), (7, {"prompt": "a"}),
            (8, {"prompt": "a", "completion": "b", "id": 3}), (9, {"messages": [1]}), (10, {"prompt": "b"}),
            (12, {"messages": [None]}), (11, {"a b": {"prompt": [[{"x": 1}]]}})]
    df = records(spark, rows)
    assert told(chat.canonical_turns(df)) == []
    counts = {r["shape"]: r["records"] for r in chat.unmatched(df).collect()}
    assert counts["OBJECT<prompt>"] == 2 and counts[None] == 1
    assert counts["OBJECT<completion, id, prompt>"] == 1 and sum(counts.values()) == 9 and counts["OBJECT<messages: ARRAY<*>>"] == 1
    assert "OBJECT<`a b`: OBJECT<prompt: ARRAY<ARRAY<OBJECT<x>>>>>" in counts


def test_types_do_not_change_a_fingerprint(spark):
    rows = [(0, {"prompt": v, "completion": {"deep": [{"x": v}, {}]}}) for v in ("x", 1, 1.5, 10**30, True, None)]
    df = records(spark, rows).select(chat.fingerprint(F.col("record")).alias("f"))
    assert df.distinct().count() == 1


def test_two_layouts_may_not_claim_the_same_fields(spark):
    twice = (*chat.LAYOUTS, chat.Layout("again", (chat.Said("user", ("completion",)), chat.Said("x", ("prompt",)))))
    with pytest.raises(ValueError, match="again"):
        chat.canonical_turns(records(spark, [(1, None)]), layouts=twice)


def test_formatting_is_reversible(spark):
    roles = ["user", "assistant", "", "a\nb", "<|im_end|>", "%0A", "assistant"]
    turns = [(1, i, roles[i % len(roles)], text) for i, text in enumerate(AWKWARD * 2)]
    df = spark.createDataFrame(turns, "id long, position long, role string, text string")
    out = chat.format_conversations(df)
    row = out.select(
        chat.formatted(F.col("segments")).alias("text"), chat.loss_texts(F.col("segments")).alias("loss"), "segments"
    ).select("*", chat.read_turns(F.col("text")).alias("turns")).first()
    assert [(t["role"], t["text"]) for t in row["turns"]] == [(r, t) for _, _, r, t in turns]
    assert row["loss"] == [t for _, _, r, t in turns if r == "assistant"]
    assert row["text"].count("<|") == 2 * len(turns)
    assert row["text"] == "".join(s["text"] for s in row["segments"])


def digests(rows):
    """What the query says of (conv_id, turn, role, text) rows, by hand."""
    found = {}
    for conv in {r[0] for r in rows}:
        def key(r):
            return (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")

        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        found[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                       hashlib.sha256(loss.encode()).hexdigest())
    return found


def test_query_on_awkward_rows(spark):
    rows = [(i % 4, i // 4, ("user", "assistant")[i % 2], t) for i, t in enumerate([*AWKWARD, None, None])]
    rows += [(1, None, None, None), (None, 3, "assistant", "lost"), (None, None, None, None), (0, 0, "user", "")]
    rows += [(7, 1, "b\nc", "x"), (7, 1, "b\nc", "x"), (7, 1, "a%", "y"), (8, 0, None, "no role")]
    rows = [(*r, "x", 1, "y") for r in rows]
    schema = "conv_id long, turn long, role string, text string, record string, id long, segments string"
    out = conversation_digests(spark.createDataFrame(rows, schema)).collect()
    crafted = [(-1, 0, "user", AWKWARD[2]), (-1, 1, "assistant", AWKWARD[2])]
    expected = digests([r[:4] for r in rows] + crafted)
    assert {r["conv_id"]: tuple(r)[1:5] for r in out} == expected and len(out) == len(expected)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    (row,) = conversation_digests(empty).collect()
    assert (row["conv_id"], row["n_turns"], row["loss_chars"]) == (-1, 2, len(AWKWARD[2]))
    assert row["formatted_chars"] == len("user" + "assistant") + 2 * (len(AWKWARD[2]) + 2 + 12 + 1 + 11)
