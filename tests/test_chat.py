"""Chat message operators on the FIXTURES edge rows."""

from ranklake.operators import chat


def test_router_and_payload(spark):
    rows = [(1, "data:image/jpeg;base64,AAEC"), (2, "data:image/png;base64,AAEC"), (3, "hello"),
            (4, "data:image/jpeg;base64,%%%")]
    df = spark.createDataFrame(rows, "message_id long, message string")
    got = {r.message_id: (r.route, None if r.payload is None else bytes(r.payload))
           for r in chat.image_payload(chat.message_router(df)).collect()}
    assert got[1] == ("image", b"\x00\x01\x02")
    assert got[2][0] == "text" and got[3][0] == "text"
    assert got[4] == ("image", None)          # junk base64 gives NULL, not garbage


def test_caption_query(spark):
    msgs = spark.createDataFrame([(1, "data:image/jpeg;base64,AAEC"), (2, "what is x")],
                                 "message_id long, message string")
    caps = spark.createDataFrame([(1, "a red bus")], "message_id long, caption string")
    got = {r.message_id: r.query for r in chat.caption_query(chat.message_router(msgs), caps).collect()}
    assert got == {1: "tell me about a red bus", 2: "what is x"}


def test_parse_messages(spark):
    lines = spark.createDataFrame([('{"message": "hi", "username": "u1"}',)], "value string")
    r = chat.parse_messages(lines).first()
    assert (r.message, r.username) == ("hi", "u1")
