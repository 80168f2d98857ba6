"""Layouts by fingerprint, exact round trips of hostile texts, and the SQL of the registered query."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from meterload.llm import chat
from meterload.llm.queries import ORACLES, QUERIES
from tools.compare import normalise, oracle_frame

FOLDER = "/root/testdata/sf0.01"


def records(spark, *values):
    return spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v))
                                  for i, v in enumerate(values)], "id long, record string")


def turns_of(df):
    return {r.id: r.turns if r.turns is None else [tuple(t) for t in r.turns] for r in df.collect()}


CASES = {
    "messages": ({"messages": [{"role": "human", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3},
                 [("user", "q"), ("assistant", "a")]),
    "system beside messages": ({"system": "s", "messages": [{"role": "user", "content": "q"}]}, [("system", "s"), ("user", "q")]),
    "parts": ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "u"},
                                                          {"type": "text", "text": "b"}]}]}, [("user", "ab")]),
    "parts and text": ({"messages": [{"role": "user", "content": "x"}, {"role": "bot", "content": [{"type": "text", "text": "y"}]}]},
                       [("user", "x"), ("assistant", "y")]),
    "null content": ({"messages": [{"role": "user", "content": None}, {"role": None, "content": "z"}]}, [("user", ""), ("", "z")]),
    "no messages": ({"messages": []}, []),
    "conversations": ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
                      [("user", "q"), ("assistant", "a")]),
    "dialogue": ({"dialogue": [{"speaker": "Bot", "utterance": "hi"}]}, [("assistant", "hi")]),
    "instruction": ({"instruction": "do", "input": "this", "output": "done", "source": {"role": "x"}},
                    [("user", "do\n\nthis"), ("assistant", "done")]),
    "instruction, empty input": ({"instruction": "do", "input": "", "output": ""}, [("user", "do"), ("assistant", "")]),
    "history": ({"instruction": "c", "output": "d", "history": [["a", "b"], ["x", None]]},
                [("user", "a"), ("assistant", "b"), ("user", "x"), ("assistant", ""), ("user", "c"), ("assistant", "d")]),
    "completion": ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    "chosen": ({"prompt": "p", "chosen": "c", "rejected": "r"}, [("user", "p"), ("assistant", "c")]),
    "response": ({"system": None, "prompt": "p", "response": None}, [("user", "p")]),
    "question": ({"question": "q", "context": "c", "answer": "a"}, [("user", "q\n\nc"), ("assistant", "a")]),
    "pairs": ({"pairs": [["a", "b"]]}, [("user", "a"), ("assistant", "b")]),
    "turn rows": ({"turns": [{"turn": 2, "role": "b", "text": "y"}, {"turn": 1, "role": "a", "text": "x"},
                             {"turn": None, "role": "c", "text": None}]}, [("c", ""), ("a", "x"), ("b", "y")]),
    "unknown": ({"foo": [1, 2]}, None),
    "two layouts at once": ({"prompt": "p", "completion": "c", "messages": [{"role": "user", "content": "x"}]}, None),
    "scalar": ("5", None), "list": ([1, 2], None), "broken": ("{", None), "null": (None, None), "empty": ({}, None),
}


def test_layouts(spark):
    found = turns_of(chat.canonical(records(spark, *[c[0] for c in CASES.values()])))
    assert {name: found[i] for i, name in enumerate(CASES)} == {name: want for name, (_, want) in CASES.items()}


def test_paths_follow_from_names_of_any_kind(spark):
    df = records(spark, {"a b": {"c`d": [[{"x.y": 1.25}]]}, "Z9": True, "e": [], "ü": None, "OBJECT": {"ARRAY": "s"}})
    paths = df.select(chat.field_paths(F.try_parse_json("record")).alias("p")).first().p
    assert paths == sorted(["a b.c`d[][].x.y", "Z9", "e[]", "ü", "OBJECT.ARRAY"])


def test_a_fingerprint_ignores_order_values_and_unknown_fields(spark):
    df = records(spark, {"prompt": "x", "completion": "y"}, {"completion": "", "prompt": None, "extra": [{"a": 1}]},
                 {"prompt": "x", "response": "y"})
    a, b, c = [r.fingerprint for r in chat.fingerprinted(df).orderBy("id").collect()]
    assert a == b == chat.fingerprint_of({"prompt", "completion"}) != c


def test_ambiguous_layouts_are_refused(spark):
    twice = (chat.Layout("one", (chat.One("user", ("a",)),)), chat.Layout("two", (chat.One("system", ("a",)),)))
    with pytest.raises(ValueError, match="both claim"):
        chat.canonical(records(spark, {"a": "x"}), layouts=twice)


def test_layouts_seen_reports_what_has_no_mapping(spark):
    seen = chat.layouts_seen(records(spark, {"foo": 1}, {"foo": "x"}, {"prompt": "a", "completion": "b"}, None))
    rows = {tuple(r.paths) if r.paths is not None else None: (r.n_records, r.layout) for r in seen.collect()}
    assert rows == {("foo",): (2, None), ("completion", "prompt"): (1, "prompt and completion"), None: (1, None)}


HOSTILE = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\\\|", "<|", "|>", "<", "|", "\\", "<|nl|>", "a<", "<\n|",
           "$1 \\1", "", "é\U0001f600", "<<||", "<|im_start|>user\n", "\n", "\r\n"]


def hostile(rng, n):
    return "".join(rng.choice([*HOSTILE, "word ", "x"]) for _ in range(rng.randrange(n)))


def test_hostile_texts_and_roles_come_back(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None, hostile(rng, 4)]), rng.choice([None, hostile(rng, 9)]))
            for c in range(200) for t in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.formatted(chat.canonical(chat.records_of(df)))
    back = made.withColumn("rendered", chat.rendered_turns(F.col("formatted"))).select(
        "conv_id", "formatted", "loss_mask", chat.read_turns(F.col("rendered")).alias("turns"),
        chat.masked_texts(F.col("rendered"), F.col("loss_mask")).alias("loss"))
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: r[:2]):
        want.setdefault(c, []).append((role or "", text or ""))
    for r in back.collect():
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.loss == [text for role, text in want[r.conv_id] if role == "assistant"]
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(want[r.conv_id])
        places = [m.turn for m in r.loss_mask]
        assert places == [i for i, (role, _) in enumerate(want[r.conv_id]) if role == "assistant"]


def test_digests_by_hand(spark):
    rows = [(1, 2, "assistant", "b <|"), (1, 1, "user", None), (None, 0, "user", "x"), (1, None, None, "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    out = {r.conv_id: r for r in chat.digests(chat.formatted(chat.canonical(chat.records_of(df)))).collect()}
    one = out[1]
    assert one.n_turns == 3 and out[None].n_turns == 1
    assert one.turns_sha256 == hashlib.sha256("\nfirst\nuser\n\nassistant\nb <|\n".encode()).hexdigest()
    assert (one.loss_chars, one.loss_sha256) == (4, hashlib.sha256(b"b <|").hexdigest())
    assert out[None].loss_sha256 == hashlib.sha256(b"").hexdigest()


def test_very_long_conversations_and_texts(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} <|im_end|>") for t in range(5000)]
    rows += [(2, 0, "assistant", "x<|" * 1_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.digests(chat.formatted(chat.canonical(chat.records_of(df)))).collect()}
    assert (out[1].n_turns, out[2].loss_chars) == (5000, 3_000_000)
    assert out[1].loss_chars == sum(len(r[3]) for r in rows[:5000] if r[2] == "assistant")


def test_other_columns_pass_and_clashing_ones_are_replaced(spark):
    df = spark.createDataFrame([(1, '{"prompt": "p", "completion": "c"}', "old", "old")],
                               "id long, record string, turns string, formatted string")
    made = chat.formatted(chat.canonical(df))
    assert made.columns == ["id", "turns", "formatted", "fingerprint", "layout", "loss_mask"]
    row = made.first()
    assert row.turns[0].text == "p" and row.formatted.startswith("<|im_start|>user\np<|im_end|>\n")


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.formatted(chat.canonical(chat.records_of(df)))).collect() == []


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op11_chat_format"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Pandas" not in plan


def test_query_equals_its_sql(spark):
    got = QUERIES["op11_chat_format"](spark, FOLDER).toPandas()
    want = oracle_frame(FOLDER, ORACLES["op11_chat_format"])
    assert normalise(got) == normalise(want)
