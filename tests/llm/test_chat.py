import hashlib

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from launchlens.llm import chat

TRICKY = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "\\<|", "<\\|\\\\", "a\\", "|>|>", "<<SYS>>", "", "[[INST]]", "<|assistant|>", "\n\n"]


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at long, piece string")


def test_round_trip_of_control_strings(spark):
    rows = [(c, k, r, t, 0, "clash") for c, r in enumerate(["user", "assistant", "<|x|>"]) for k, t in enumerate(TRICKY)]
    got = {r.conv_id: r for r in chat.format_chat(turns(spark, rows)).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    for c, role in enumerate(["user", "assistant", "<|x|>"]):
        assert [(b.role, b.text) for b in got[c].back] == [(role, t) for t in TRICKY]
        assert got[c].formatted.count("<|end|>") == len(TRICKY)
        body = got[c].formatted.replace("<|end|>", "").replace(f"<|{role}|>", "")
        assert "</s>" not in body and "[INST]" not in body


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="\\<|>[]/sINT \n", max_size=24), min_size=1, max_size=5))
def test_escape_reverses(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    back = df.select("t", chat.unescape(chat.escape(F.col("t"))).alias("b"), chat.escape(F.col("t")).alias("e")).collect()
    assert all(r.t == r.b for r in back)
    assert not any(c in r.e for r in back for c in chat.CONTROLS)


def test_mask_covers_assistant_texts(spark):
    rows = [(1, 2, "assistant", "yés", 0, ""), (1, 0, "user", "q", 0, ""), (1, 1, "assistant", "", 0, ""), (1, 3, "assistant", "</s>", 0, "")]
    r = chat.format_chat(turns(spark, rows)).first()
    assert [r.formatted[m.start : m.start + m.chars] for m in r.loss_mask] == ["", "yés", "<\\/s>"]
    d = chat.digests(chat.format_chat(turns(spark, rows))).first()
    assert d.loss_chars == 7 and d.loss_sha256 == hashlib.sha256("yés</s>".encode()).hexdigest()
    assert d.turns_sha256 == hashlib.sha256("user\nq\nassistant\n\nassistant\nyés\nassistant\n</s>\n".encode()).hexdigest()


def test_digest_comes_from_the_mask(spark):
    rows = [(1, 0, "user", "asked <|", 0, ""), (1, 1, "assistant", "sa\\id é", 0, ""), (1, 2, "user", "more", 0, ""), (1, 3, "assistant", "[INST]", 0, "")]
    chats = chat.format_chat(turns(spark, rows))
    whole = chat.digests(chats).first()
    assert whole.loss_sha256 == hashlib.sha256("sa\\id é[INST]".encode()).hexdigest()
    wrong = {
        "shifted": F.transform("loss_mask", lambda m: F.struct((m["start"] + 1).alias("start"), m["chars"].alias("chars"))),
        "one span only": F.slice("loss_mask", 1, 1),
        "none": F.slice("loss_mask", 1, 0),
        "all": F.array(F.struct(F.lit(0).cast("long").alias("start"), F.char_length("formatted").cast("long").alias("chars"))),
    }
    for mask in wrong.values():
        row = chat.digests(chats.withColumn("loss_mask", mask)).first()
        assert row.loss_sha256 != whole.loss_sha256 and row.turns_sha256 == whole.turns_sha256


def test_typed_parts(spark):
    part = lambda **x: {n: x.get(n) for n in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    parts = [part(type="text", text="see <|"), part(type="image", ref="a.png", width=600, height=512), part(type="audio", ref="b.wav", seconds=2.1), part(text="x"), part(type="document", ref="c", pages=3), part(type="video")]
    df = spark.createDataFrame([(1, 0, "user", None, parts), (1, 1, "user", "plain", None), (1, 2, "user", "empty list", [])], f"conv_id long, turn long, role string, text string, parts {chat.PART_TYPE}")
    r = chat.format_chat(df).first()
    assert r.formatted.startswith("<|user|>\nsee <\\|<|image:1.1|><|audio:1.2|>x<|document:1.4|><|video:1.5|><|end|>\n<|user|>\nplain<|end|>")
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in r.attachments] == [(1, 1, "image", "a.png", 425), (1, 2, "audio", "b.wav", 53), (1, 4, "document", "c", 1536), (1, 5, "video", None, 0)]
    assert r.expanded_tokens == 425 + 53 + 1536 and "empty list" in r.formatted
    d = chat.digests(chat.format_chat(df)).first()
    assert (d.n_attachments, d.expanded_tokens) == (4, r.expanded_tokens)


def test_edge_rows(spark):
    long = "x<|" * 50_000
    rows = [(None, None, None, None, None, None), (1, 0, None, None, 1, ""), (1, 0, None, None, 1, ""), (2, 5, "assistant", long, 1, ""), (2, None, "user", "first", 1, "")]
    got = {r.conv_id: r for r in chat.digests(chat.format_chat(turns(spark, rows))).collect()}
    assert got[None].n_turns == 1 and got[1].n_turns == 2 and got[2].loss_chars == len(long)
    assert got[2].turns_sha256 == hashlib.sha256(f"user\nfirst\nassistant\n{long}\n".encode()).hexdigest()
    assert chat.digests(chat.format_chat(turns(spark, []))).collect() == []
