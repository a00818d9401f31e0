"""Quotation links and reply order on hand-made conversations; the query also has SQL."""

from footfall.llm import chat

ROWS = [
    (1, 0, "user", "Hello there my friends\nHow do we boil an egg?"),
    (1, 1, "helper", "> Hello there my friends\n> How do we boil an egg?\n\nPut it into boiling water for six minutes."),
    (1, 2, "user", "Another matter entirely, what about tea?"),
    (1, 3, "user", "> > How do we boil an egg?\n> put it into BOILING water, for six minutes\nThat was too long."),
    (1, 4, "helper", ">> another matter entirely what about tea\nUse leaves."),
    (1, 5, "user", "> words that nobody here has ever written\nAlone."),
    (2, 0, "user", "> Hello there my friends\nQuoted from elsewhere."),
    (2, 1, None, None),
    (3, 0, "user", "> a b c\n> d"),
    (None, 0, "user", "> Hello there my friends"),
    (4, 7, "user", "one two three"),
    (4, 7, "user", "one two three"),
    (4, 9, "user", ">one  two THREE\n"),
]


def linked(spark, rows):
    frame = spark.createDataFrame([(*r, "old") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(4)
    return chat.reply_order(frame).collect()


def test_links(spark):
    rows = linked(spark, ROWS)
    assert len(rows) == len(ROWS)
    at = {(r.conv_id, r.turn): (r.text, r.n_quoted, r.parent_turn, r.root_turn, r.depth) for r in rows}
    assert at[1, 0] == (ROWS[0][3], 0, None, 0, 0)
    assert at[1, 1] == ("Put it into boiling water for six minutes.", 2, 0, 0, 1)
    assert at[1, 2][2:] == (None, 2, 0)
    assert at[1, 3] == ("That was too long.", 2, 1, 0, 2)
    assert at[1, 4] == ("Use leaves.", 1, 2, 2, 1)
    assert at[1, 5] == ("Alone.", 1, None, 5, 0)
    assert at[2, 0][2:] == (None, 0, 0) and at[2, 1] == (None, 0, None, 1, 0)
    assert at[3, 0] == ("", 2, None, 0, 0) and at[None, 0][2:] == (None, 0, 0)
    assert at[4, 7][2:] == (None, 7, 0) and at[4, 9] == ("", 1, 7, 7, 1)
    order = sorted((r for r in rows if r.conv_id == 1), key=lambda r: (r.root_turn, r.depth, r.turn))
    assert [r.turn for r in order] == [0, 1, 3, 2, 4, 5]


def test_a_long_chain_and_a_passage_quoted_by_everyone(spark):
    rows = [(1, 0, "u", "message number zero")]
    rows += [(1, i, "u", f"> message number {i - 1 if i > 1 else 'zero'}\nmessage number {i}") for i in range(1, 60)]
    rows += [(2, i, "u", "the same three words\n> the same three words" if i else "the same three words") for i in range(200)]
    at = {(r.conv_id, r.turn): r for r in linked(spark, rows)}
    assert all(at[1, i].depth == i and at[1, i].root_turn == 0 for i in range(60))
    assert all(at[2, i].parent_turn == 0 and at[2, i].depth == 1 for i in range(1, 200))


def test_no_rows(spark):
    assert linked(spark, []) == []
