import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm.sentence_rules import LANGUAGES
from tidewater.llm.sentences import blocks, languages, sentences, units


def split(text):
    return [text[a:b] for a, b in units(text)]


CASES = {
    "abbreviations": ("Dr. Who vs. Mr. Hyde, e.g. at 6 p.m. today. It costs 3.50 in total. Done!", ["Dr. Who vs. Mr. Hyde, e.g. at 6 p.m. today.", "It costs 3.50 in total.", "Done!"]),
    "numbered": ("See Fig. 3 and No. 7. Then etc. did not help. We tried tape, etc. The end.", ["See Fig. 3 and No. 7.", "Then etc. did not help.", "We tried tape, etc.", "The end."]),
    "initials": ("J. K. Rowe wrote it. The U.S. model works.", ["J. K. Rowe wrote it.", "The U.S. model works."]),
    "quotes": ('It says "Out of room. Try again." and quits. The label reads "Do not open!" Why?', ['It says "Out of room. Try again." and quits.', 'The label reads "Do not open!"', "Why?"]),
    "brackets": ("It warns (why?) and goes on. (It was new at that time.) The end", ["It warns (why?) and goes on.", "(It was new at that time.)", "The end"]),
    "hesitation": ("Well... it came back. It stopped... I left.", ["Well... it came back.", "It stopped...", "I left."]),
    "german": ("Das passiert z. B. mit Nr. 5, d. h. oft. Am 25. März ging es. Er meldet „Kein Platz. Bitte warten.“ und hört auf.", ["Das passiert z. B. mit Nr. 5, d. h. oft.", "Am 25. März ging es.", "Er meldet „Kein Platz. Bitte warten.“ und hört auf."]),
    "french": ("Ça marche\xa0! Il affiche «\xa0Plus de place. Réessayez.\xa0» puis se ferme. M. Dupont dort.", ["Ça marche\xa0!", "Il affiche «\xa0Plus de place. Réessayez.\xa0» puis se ferme.", "M. Dupont dort."]),
    "spanish": ("¿En serio?, preguntó el Sr. Paz. Va bien, p. ej. con 57 filas. Falta el n.º 9. Ya.", ["¿En serio?, preguntó el Sr. Paz.", "Va bien, p. ej. con 57 filas.", "Falta el n.º 9.", "Ya."]),
    "russian": ("Нужно ок. 5 ГБ, т. е. мало. Греется до 64 град.. Г. Орлов спит.", ["Нужно ок. 5 ГБ, т. е. мало.", "Греется до 64 град..", "Г. Орлов спит."]),
    "greek": ("Δοκίμασες το πριν; Ο κ. Παππάς λέει π.χ. ναι. Τέλος.", ["Δοκίμασες το πριν;", "Ο κ. Παππάς λέει π.χ. ναι.", "Τέλος."]),
    "japanese": ("彼は「待って！」と言いました。本当ですか？！えっと……炉です。", ["彼は「待って！」と言いました。", "本当ですか？！", "えっと……炉です。"]),
    "chinese": ("日志里写着“空间不足。请重试。”然后就退出了。他说：“先等一下！”好。", ["日志里写着“空间不足。请重试。”然后就退出了。", "他说：“先等一下！”", "好。"]),
    "korean": ('화면에 "공간이 없습니다. 다시 하세요."라고 나옵니다. 버전 6.6입니다.', ['화면에 "공간이 없습니다. 다시 하세요."라고 나옵니다.', "버전 6.6입니다."]),
    "hindi": ("डॉ. राम ने कहा। क्या हुआ?", ["डॉ. राम ने कहा।", "क्या हुआ?"]),
    "arabic": ("قال د. سامي نعم. هل جربت؟ نعم.", ["قال د. سامي نعم.", "هل جربت؟", "نعم."]),
    "thai": ("ผมเปลี่ยนแล้ว แต่ร้อนครับ ทำไมเป็นแบบนี้คะ ดี", ["ผมเปลี่ยนแล้ว แต่ร้อนครับ", "ทำไมเป็นแบบนี้คะ", "ดี"]),
    "emoticons": ("It reads the tray.. ^^ Next one :) Done", ["It reads the tray.. ^^", "Next one :)", "Done"]),
    "small initials": ("The End.\n\nthat did it! j. k. rowe wrote it.", ["The End.", "that did it!", "j. k. rowe wrote it."]),
    "small": ("is it needed? does anyone know. the label reads no. 5 in it.", ["is it needed?", "does anyone know.", "the label reads no. 5 in it."]),
    "code span": ("Try `a. B? c` first. See http://x.y/z?p=1 now.", ["Try `a. B? c` first.", "See http://x.y/z?p=1 now."]),
    "wrapped": ("A line that\r\nis wrapped. Next\r\n\r\nBlock", ["A line that\r\nis wrapped.", "Next", "Block"]),
    "list": ("Do:\n1. One. Two\n2. Three\n- Four", ["Do:", "1. One.", "Two", "2. Three", "- Four"]),
    "fence": ("Run:\n```py\na. B\n\nc\n```\nDone. Ok\n~~~\nopen", ["Run:", "```py\na. B\n\nc\n```", "Done.", "Ok", "~~~\nopen"]),
    "indented": ("Text\n\n    x. Y\n    z\n\n    w", ["Text", "x. Y\n    z", "w"]),
}


CASES |= {
    "forgotten space": ("It shakes the hub.Does anyone know why? Open main.tv or Foo.Bar first.The end", ["It shakes the hub.", "Does anyone know why?", "Open main.tv or Foo.Bar first.", "The end"]),
    "armenian": ("Բարեւ ձեզ։ Ինչպես եք։ Լավ", ["Բարեւ ձեզ։", "Ինչպես եք։", "Լավ"]),
    "ethiopic": ("ሰላም ነው። ደህና ነህ፧ አዎ", ["ሰላም ነው።", "ደህና ነህ፧", "አዎ"]),
    "burmese": ("မင်္ဂလာပါ၊ ကျေးဇူး။နေကောင်းလား။", ["မင်္ဂလာပါ၊ ကျေးဇူး။", "နေကောင်းလား။"]),
    "khmer": ("សួស្តី។ អរគុណ។", ["សួស្តី។", "អរគុណ។"]),
    "tibetan": ("བཀྲ་ཤིས། བདེ་ལེགས།", ["བཀྲ་ཤིས།", "བདེ་ལེགས།"]),
    "hindi without space": ("यह है।फिर \"जगह नहीं है। करें।\" और बंद।", ["यह है।", "फिर \"जगह नहीं है। करें।\" और बंद।"]),
    "thai end mark": ("จบแล้ว๛ ต่อไป", ["จบแล้ว๛", "ต่อไป"]),
}


def test_tables_are_those_of_the_language():
    """"ca." and "usw." are no abbreviations in English, nor "No." in German."""
    assert split("Go to the ca. Ten of them.") == ["Go to the ca.", "Ten of them."]
    assert split("Das sind ca. Zehn und mehr.") == ["Das sind ca. Zehn und mehr."]
    told = [(a, b) for a, b in units("Go ca. Ten.", "en-US")]
    assert told == [(0, 6), (7, 11)] and units("Go ca. Ten.") == [(0, 11)] == units("Go ca. Ten.", "th")
    assert split("The other block is in English.\n\nGo ca. Ten.")[1:] == ["Go ca.", "Ten."]
    nobody = lambda: ()
    assert languages("これは漢字", nobody, None) == ("ja",) and languages("这是汉字", nobody, None) == ("zh",) and languages("한국어 ไทย", nobody, None) == ("ko", "th")
    assert languages("der und die, the", nobody, None) == ("de",) and languages("xyz", nobody, "fr") == ("fr",) and languages("xyz", nobody, "xx") == ("en", "de", "fr", "es")
    assert set(LANGUAGES) == {"en", "de", "fr", "es", "ru", "el", "ar", "hi", "zh", "ja", "ko", "th"}


@pytest.mark.parametrize("part", ["It was new. ", "a (b. c) ", '"x. y" ', "ab...", "x\n", ". ", "字。", "`a.` ", "(", "the "])
def test_time_is_linear(part):
    import time

    def took(n):
        text = part * (n // len(part)) + "\n"
        t = time.process_time()
        units(text)
        return time.process_time() - t

    took(10_000)
    assert took(160_000) < 6 * took(40_000) + 0.2


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    text, want = CASES[name]
    assert split(text) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1.!?…。 \n\t\"“”«»()`~-~é字ก\r", max_size=80))
def test_nothing_but_white_space_is_lost(text):
    at = 0
    for a, b in units(text):
        assert at <= a < b and not text[at:a].strip() and text[a:b] == text[a:b].strip()
        at = b
    assert not text[at:].strip()
    assert all(a < b for a, b, _ in blocks(text))


def test_rows(spark):
    rows = [(1, "One. Two."), (2, None), (3, ""), (4, " \n "), (1, "One. Two."), (5, "x" * 300_000 + ". Y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as sent_start")
    got = sorted((r.doc_id, r.sent_start, r.sent_end) for r in sentences(df).collect())
    assert got == sorted([(1, 0, 4), (1, 5, 9)] * 2 + [(5, 0, 300_001), (5, 302_002 - 2_000, 302_003 - 2_000)])
    assert sentences(df.limit(0)).collect() == []
    stated = spark.createDataFrame([(1, "Go ca. Ten.", "en"), (2, "Go ca. Ten.", None)], "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.sent_end) for r in sentences(stated).collect()) == [(1, 6), (1, 11), (2, 11)]


LONG = "It was new. " * 200


@pytest.mark.parametrize("a, b", ["()", "[]", "«»", "„“", "“”", '""', "「」", "``"])
def test_quotations_of_any_length_do_not_split(a, b):
    text = f"He says {a}{LONG}Ok{b} and goes on."
    assert split(text + " Then he stops.") == [text, "Then he stops."]


def test_brackets_of_any_depth_do_not_split():
    for depth in (3, 500):
        text = "He says " + "(Well. No " * depth + "x. Y" + ") z" * depth + " and goes on."
        assert split(text + " Then he stops.") == [text, "Then he stops."]
    assert len(split("It is (open. " + "It was new. " * 30)) == 31
    assert split("Try `a. B`") == ["Try `a. B`"] and split("Try ``a. B``` c. D` e") == ["Try ``a. B``` c. D` e"]
