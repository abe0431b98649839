"""Chat windows against a plain writer: budget, history, masks, round trips."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from classweave.llm import chat, queries
from compare import compare, connect

SCHEMA = "conv_id long, turn long, role string, text string, window string"
ODD_TEXTS = [
    "", " ", "\\", "\\0\\1", "\\\\2", "<|end|>\n", "<|assistant|>\nx", "<", "|", "<|>", "<<|",
    "</s>[INST] ok [/INST]", "<<SYS>> a <</SYS>>", "é 日本 🙂", "\n", "a\n\nb", None, "<s", "[INST",
]


def made(seed, n=25):
    draw, rows = random.Random(seed), []
    for conv in range(n):
        if conv % 3 == 0:
            rows.append((conv, 0, "system", "sys " * draw.choice([1, 30, 600]), "q"))
        for turn in range(1, draw.choice([2, 9, 60])):
            text = " ".join(draw.choices(["word", "a", "é", "<|", "\\1"], k=draw.choice(
                [0, 3, 40, 90, 500])))
            rows.append((conv, turn, "user" if turn % 2 else "assistant", text, None))
    return rows


def by_conversation(rows):
    found = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(own)] for c, own in found.items()}


def tokens(text):
    return len(re.findall(chat.WORD, text)) + chat.TURN_TOKENS


@pytest.mark.parametrize("budget,history", [(512, 128), (150, 40), (100, 99)])
def test_windows(spark, budget, history):
    rows = made(budget)
    draw = random.Random(1)
    draw.shuffle(rows)
    windows = chat.format_windows(
        spark.createDataFrame(rows, SCHEMA).repartition(5), budget, history)
    read = windows.select(
        "*", chat.read_turns(F.col("text"), F.lit(0)).alias("all"),
        chat.read_targets(F.col("text"), F.col("loss_spans")).alias("targets")).collect()
    found = defaultdict(list)
    for w in sorted(read, key=lambda w: w.window):
        found[w.conv_id].append(w)
    for conv, turns in by_conversation(rows).items():
        at = 0
        system = turns[0] if turns[0][0] == "system" else None
        room = max(budget - history - (tokens(system[1]) if system else 0), chat.LEAST_STRIDE)
        for w in found.pop(conv):
            shown = [(t.role, t.text) for t in w.all]
            past, own = shown[:w.n_repeated], shown[w.n_repeated:]
            assert own == turns[at:at + w.n_turns] and own
            # history: the turns before that start within its tokens, then the head
            behind, spent = [], 0
            for turn in reversed(turns[:at]):
                spent += tokens(turn[1])
                if spent > history:
                    break
                behind.insert(0, turn)
            if system and at and len(behind) < at:
                behind.insert(0, system)
            assert past == behind
            assert list(w.targets) == [t for r, t in own if r == "assistant"]
            assert len(own) == 1 or sum(tokens(t) for _, t in own) <= room
            at += w.n_turns
        assert at == len(turns)
    assert not found


def test_digests_and_odd_rows(spark):
    rows = [(i, t, role, text, "x") for i, text in enumerate(ODD_TEXTS)
            for t, role in enumerate(["user", "assistant", "a|>\nb\\9", None])]
    rows += [(None, 1, "assistant", "no id", "x"), (None, 0, "user", "q", "x")]
    rows += [(50, None, "assistant", "null turn", "x"), (50, 1, "user", "u", "x")]
    rows += [(51, 1, "assistant", "same", "x")] * 3 + [(51, 1, "assistant", "other", "x")]
    rows += [(52, t, "assistant", f"t{t}", "x") for t in range(-5, 700, 3)]
    rows += [(53, 0, "assistant", "long " * 100_000, "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {r.conv_id: r for r in chat.digests(chat.format_windows(frame)).collect()}
    expected = by_conversation(rows)
    assert set(found) == set(expected)
    for conv, turns in expected.items():
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        row = found[conv]
        assert row.n_turns == len(turns) and row.loss_chars == len(loss)
        assert row.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_windows(frame.where("turn < -99")).count() == 0


def test_no_python(spark, small):
    plan = queries.QUERIES["op7_chat"](spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    assert compare(queries.QUERIES["op7_chat"](spark, folder), connect(folder),
                   queries.ORACLES["op7_chat"]) is None


def test_sql_on_many_windows(spark, tmp_path):
    import duckdb

    rows = [r for r in made(7) if r[0] != 24] + [(24, i, "user", t, "x")
                                                 for i, t in enumerate(ODD_TEXTS)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "c"))
    sql = chat.digest_sql(
        f"SELECT conv_id, turn, role, text FROM read_parquet('{tmp_path}/c/*.parquet')", 150, 40)
    frame = spark.read.parquet(str(tmp_path / "c"))
    assert compare(chat.digests(chat.format_windows(frame, 150, 40)), duckdb.connect(), sql) is None


def test_tokens_follow_the_text_or_the_column(spark):
    """Scripts without spaces and long runs cost what they are, counts what they say."""
    rows = [(1, 1, "user", "\u6f22" * 100, None), (2, 1, "user", "x" * 80, 7),
            (3, 1, "user", "ok \u0e01\u0e02 ok", -5), (4, 1, "user", None, 3),
            (5, 1, "user", "word " * 9, None)]
    turns = spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string, n int")
    cost = lambda name: {r.c: r.e - chat.TURN_TOKENS
                         for r in chat.with_sums(turns, name).collect()}
    assert cost(None) == {1: 100, 2: 10, 3: 4, 4: 0, 5: 9}
    assert cost("n") == {1: 100, 2: 7, 3: 0, 4: 3, 5: 9}
    many = spark.createDataFrame(
        [(1, t, "user", "\u6f22" * 300) for t in range(6)],
        "conv_id long, turn long, role string, text string")
    assert chat.format_windows(many).count() > 2
