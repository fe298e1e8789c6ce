"""Query/response pairing and session context (two-level windows)."""

from pyspark.sql import functions as F

from ledgerscope.operators.querylog import pair_queries_responses, session_context


def _log(spark, rows):
    return spark.createDataFrame(rows, "session STRING, pos LONG, kind STRING, text STRING")


def test_pairs_first_response_before_next_query(spark):
    log = _log(spark, [("s", 1, "Q", "a"), ("s", 2, "R", "x"), ("s", 3, "R", "y"), ("s", 4, "Q", "b"),
                       ("s", 5, "Q", "c"), ("s", 6, "R", "z"), ("t", 1, "R", "orphan")])
    for block in (1024, 2):  # 2 forces the cross-block carry
        got = [(r.session, r.query_pos, r.response_pos) for r in pair_queries_responses(
            log, "session", "pos", F.col("kind") == "Q", F.col("kind") == "R", "text", block=block).collect()]
        assert got == [("s", 5, 6), ("s", 4, None), ("s", 1, 2)]  # newest first, unmatched kept


def test_pairs_with_matching_text(spark):
    log = _log(spark, [("s", 1, "Q", "find x"), ("s", 2, "R", "other"), ("s", 3, "R", "find x"),
                       ("s", 4, "Q", "find y"), ("s", 5, "R", "nope")])
    got = {r.query_pos: r.response_pos for r in pair_queries_responses(
        log, "session", "pos", F.col("kind") == "Q", F.col("kind") == "R", "text", match=True, block=2).collect()}
    assert got == {1: 3, 4: None}


def test_session_context_two_stage_top_n(spark):
    rows = [("hot", i, "user" if i % 2 else "assistant", f"m{i}") for i in range(1, 40)]
    rows += [("cold", 1, "user", "hello")]
    msgs = spark.createDataFrame(rows, "conv LONG, turn LONG, role STRING, text STRING".replace("conv LONG", "conv STRING"))
    out = {r.conv: r for r in session_context(msgs, "conv", "turn", "role", "text", keep=10, context=3).collect()}
    assert out["hot"].kept_messages == 10
    assert out["hot"].context_text == "User: m37\nAssistant: m38\nUser: m39"
    assert out["cold"].context_text == "User: hello" and out["cold"].kept_messages == 1


def test_two_stage_top_n_with_small_blocks(spark):
    from ledgerscope.operators.windows import top_n_per_key
    rows = [("hot", i) for i in range(1, 200)] + [("cold", i) for i in (5, 1, 3)]
    df = spark.createDataFrame(rows, "k STRING, pos LONG")
    got = {(r.k, r.pos) for r in top_n_per_key(df, ["k"], [F.col("pos").desc()], 4, block_col="pos", block=7).collect()}
    assert got == {("hot", 199), ("hot", 198), ("hot", 197), ("hot", 196), ("cold", 5), ("cold", 3), ("cold", 1)}
