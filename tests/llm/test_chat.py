import hashlib
import random

import pytest

import __spark_entry__ as entry
from compare import compare, connection
from lectern.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, state string, segment int"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    assert compare(spark, sf, entry.queries()["op2_chat_format"], entry.oracle_sql()["op2_chat_format"], connection(sf)) == ""


def test_query_equals_sql_on_control_strings(spark, tmp_path):
    said = ["a\\b", "x [SYS] y", "|[SYS]", "</s>[/INST]", "\\", "[ROLE]x[TEXT]", ""]
    rows = [(i // 2, i % 2, ("user", "assistant")[i % 2], t) for i, t in enumerate(said)] + [(90, 0, "to\\ol [SYS]", "a")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = connection("/nowhere")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert compare(spark, str(tmp_path), entry.queries()["op2_chat_format"], entry.oracle_sql()["op2_chat_format"], con) == ""


def test_escapes_go_back():
    marks, rng = chat.Template(chat.TEMPLATE), random.Random(3)
    parts = [*marks.controls, "\\", "[", "<", "/s>", "INST]", "a", "\n", "é"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        safe = marks.escape(text)
        assert marks.unescape(safe) == text and not any(c in safe for c in marks.controls)
        role = rng.choice(["user", "assistant", "system", "other", "", text])
        assert marks.read(marks.segments(role, text)) == (role, text, role == "assistant")


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "hi", "x", 1), (1, 1, "assistant", "yo", "x", 1), (1, 1, "assistant", "yo", "x", 1),
        (2, None, None, None, None, None), (2, 3, "tool", "[/ROLE]\\", None, None), (None, 0, "user", "", None, None), (None, 1, "assistant", None, None, None),
        (3, 0, "system", "s" * 100_000, None, None), (2**60 + 1, 0, "user", "q", None, None),
    ]
    got = {r.conv_id: r for r in chat.read_turns(chat.format_turns(spark.createDataFrame(rows, SCHEMA))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None, 2**60 + 1}
    assert got[1].turns_sha256 == sha("user\nhi\nassistant\nyo\nassistant\nyo\n") and got[1].loss_sha256 == sha("yoyo") and not got[1].valid
    assert got[2].turns_sha256 == sha("\n\ntool\n[/ROLE]\\\n") and got[2].loss_chars == 0 and not got[2].valid
    assert got[None].valid and got[None].n_turns == 2 and got[None].loss_sha256 == sha("")
    assert not got[3].valid and got[3].formatted_chars == 100_013


def test_segments(spark):
    rows = [(1, 0, "user", "a", None, None), (1, 1, "assistant", "</s>", None, None)]
    got = chat.format_turns(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.text, r.loss) for r in got] == [("[INST] ", False), ("a", False), (" [/INST]", False), ("<s> ", False), ("<\\/s>", True), (" </s>", False)]
    assert [r.state for r in got[::3]] == ["asked", "answered"]


def test_empty_table(spark):
    assert chat.read_turns(chat.format_turns(spark.createDataFrame([], SCHEMA))).count() == 0
