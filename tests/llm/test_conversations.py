from graphloom.llm.conversations import conversations

SCHEMA = "msg_key bigint, message_id string, parent_id string, `from` string, date string, body string, id string, root int"


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows, 1)], SCHEMA)


ROWS = [
    ("<a@h>", None, "A <a@x>", "2021-01-01T10:00:00+01:00", "hi"), (" b@h ", "<a@h>", "B <b@x>", "2021-01-01T09:30:00Z", "re"), ("<c@h>", "b@h", "a@X", "2021-01-01 09:30:00+0000", "re"), ("<b@h>", " <a@h> ", "B <b@x>", "2021-01-01T09:30:00Z", "re"),
    ("<d@h>", "<>", "A <a@x>", "2021-01-01T10:00:00Z", "alone"), ("<e@h>", "<d@h>", "A2 <A@x>", "2021-01-02T10:00:00Z", "same sender"),
    ("<f@h>", "", "A <a@x>", "2021-01-01T10:00:00Z", "x"), ("<g@h>", "<f@h>", "B <b@x>", None, "no date"), ("<h@h>", None, "A <a@x>", "2021-01-01T10:00:00Z", "x"), ("<i@h>", "<h@h>", "B <b@x>", "2021-01-01T11:00:00Z", " \n "),
    ("<j@h>", "<gone@h>", "B <b@x>", "2021-01-01T11:00:00Z", "x"), ("<k@h>", "<l@h>", "B <b@x>", "2021-01-01T11:00:00Z", "x"), ("<l@h>", "<k@h>", "A <a@x>", "2021-01-01T11:00:00Z", "x"), (None, None, None, None, None),
    ("<m@h>", None, None, "2021-01-01T10:00:00Z", "x"), ("<n@h>", "<m@h>", "B <b@x>", "2021-01-01T11:00:00Z", "x"),
]


def test_sound_conversations(spark):
    got = {(r["root_message_id"], r["turn_no"], r["message_id"], r["role"]) for r in conversations(table(spark, ROWS)).collect()}
    assert got == {
        ("<a@h>", 1, "<a@h>", "opener"), ("<a@h>", 2, "<b@h>", "responder"), ("<a@h>", 3, "<c@h>", "opener"), ("<m@h>", 1, "<m@h>", "opener"), ("<m@h>", 2, "<n@h>", "responder"),
    }


def test_long_chain_and_hot_root(spark):
    chain = [("<0@h>", None, "a@x", "2021-01-01T00:00:00Z", "x")] + [(f"<{i}@h>", f"<{i - 1}@h>", "b@x", f"2021-01-01T{i // 60:02d}:{i % 60:02d}:00Z", "x") for i in range(1, 300)]
    wide = [("<r@h>", None, "a@x", "2021-01-01T00:00:00Z", "x")] + [(f"<w{i}@h>", "<r@h>", "b@x", "2021-01-01T01:00:00Z", "x") for i in range(1500)]
    got = conversations(table(spark, chain + wide), large_group=200).collect()
    assert sorted(r["turn_no"] for r in got if r["root_message_id"] == "<0@h>") == list(range(1, 301))
    by_turn = {r["turn_no"]: r["message_id"] for r in got if r["root_message_id"] == "<r@h>"}
    assert len(by_turn) == 1501 and [by_turn[i] for i in range(2, 1502)] == sorted(by_turn[i] for i in range(2, 1502))


def test_empty(spark):
    assert conversations(table(spark, ROWS).limit(0)).count() == 0
