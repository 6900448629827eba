from pyspark.sql import functions as F

from gistmill.functions import repair as rp

def col():
    return F.col("text")


def fixed(df, fn=rp.repair_text):
    return [r.x for r in df.orderBy("id").select(fn(col()).alias("x")).collect()]


def test_mojibake(texts):
    df = texts("Ã¦ble pÃ¥ Ã˜en", "ægte på Øen", "itâ€™s", "café …", "Ã", None, "Ã¦ og 中")
    assert fixed(df) == ["æble på Øen", "ægte på Øen", "it's", "café …", "Ã", None, "æ og 中"]
    sound = texts("allé”…", "À «é» ¦", "naïve – ça", "Ünï™ ©", "日本 é")
    assert fixed(sound, rp.fix_encoding) == ["allé”…", "À «é» ¦", "naïve – ça", "Ünï™ ©", "日本 é"]


def test_repair_composes(texts):
    got = rp.repaired(texts("e\u0301 Ã©", "\u212b", None), ["text"]).orderBy("id").collect()
    assert [r.text for r in got] == ["é é", "Å", None]


def test_entities(texts):
    df = texts("a &amp; b", "&#230;&#xE6;&aelig;", "&bogus; &amp", "<b>&amp;</b>", "&amp;lt;", "&#0;&#xD800;")
    assert fixed(df) == ["a & b", "æææ", "&bogus; &amp", "<b>&amp;</b>", "&lt;", "&#0;&#xD800;"]
    assert fixed(texts("<b>&amp;</b>"), lambda c: rp.repair_text(c, unescape=True)) == ["<b>&</b>"]


def test_typography_breaks_and_controls(texts):
    df = texts("“a” ‘b’", "ﬁn ﬂad", "ＡＢ　１", "a\r\nb\rc d", "a\x00b\x1b[31mc\x07", "tab\tkept")
    assert fixed(df) == ["\"a\" 'b'", "fin flad", "AB 1", "a\nb\nc\nd", "abc", "tab\tkept"]


def test_compose(texts):
    assert fixed(texts("å", "å", None, "K"), rp.compose) == ["å", "å", None, "K"]


def test_steps_are_taken_for_what_they_change(texts):
    step = [*rp.LIGATURES, *rp.FULL_WIDTH, *rp.CURLY, "\r", "\r\n", "\u0085", "\u2028", "\u2029", "\x1b[0m"]
    step += [chr(c) for c in (*range(9), 0xB, *range(0xE, 0x20), 0x7F, *range(0x206A, 0x2070), 0xFEFF, *range(0xFFF9, 0xFFFD))]
    step += ["Ã©", "â€™", "ðŸ˜€", "Ã\x1b[0m©", "&#xc3;©", "&rsquo;"]
    sound = ["blåbær øå", "a\tb\nc ~", "ﬃ"[:0], "日本 é", "\x0c"]
    for held in (texts(*[f"ø a{s} b" for s in step]), texts(*step)):
        got = held.select("text", rp.repair_text(F.col("text")).alias("now")).collect()
        assert all(r.now != r.text for r in got)
    assert fixed(texts(*sound)) == sound
    assert fixed(texts("Ã\x1b[0m©", "&#xc3;&#xa9;", "x&rsquo;s")) == ["é", "é", "x's"]


def test_text_that_needs_no_repair_is_searched_once(texts):
    # Only what is not common is looked at by the patterns of the steps.
    plan = texts("a").select(rp.compose(F.col("text")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(text" in plan and "RLIKE(text" not in plan and "text#0 RLIKE" not in plan
