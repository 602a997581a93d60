"""Repair, encoding, leaks and look-alikes: round trips, brute force, hard cases."""

import base64
import os
import quopri
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from textdex.llm import encode, leaks, looks, mailtext, mojibake

# looks


@pytest.mark.parametrize(("a", "b"), [
    ("ＡＢＣ ｄ１", "ABC d1"), ("ﬁne ﬂow", "fine flow"), ("été", "été"), ("a​b­﻿", "ab"), ("a b　c d", "a b c d"),
    ("한국어", unicodedata.normalize("NFD", "한국어")), ("\u09c7\u09be", "\u09cb"), ("𝐀b𝓬", "Abc"), ("﹐ ﹪", ", %"), ("a\u180eb\u2066", "ab"),
    ("раура", "paypa"), ("Τhe", "The"), ("о́", "ó"), ("a\r\nb", "a\nb"), ("ё", "ё"), ("ｱ", "ア"),
])
def test_same_look(a, b):
    assert looks.look(a) == looks.look(b)


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("e", "é"), ("1", "l"), ("0", "O"), ("x²", "x2"), ("a b", "a  b"), ("и", "й"), ("½", "1/2"), ("m", "rn"), ("؀ 12", " 12"), ("한", "하")])
def test_other_look(a, b):
    assert looks.look(a) != looks.look(b)


def test_folded_look():
    assert looks.look("STRASSE", True) == looks.look("straße", True) and looks.look("ＡÉ", True) == looks.look("aé", True)


def test_look_is_stable_and_as_written_out():
    """The fast way gives what decomposing, mapping and composing every character gives, and a form has itself as form."""
    rng, table = random.Random(2), looks.look_table()
    pool = [chr(c) for c in range(0x20, 0x2FFF) if unicodedata.category(chr(c)) not in ("Cn", "Cs")] + list("\n\tabcé") * 200
    for _ in range(300):
        t = "".join(rng.choice(pool) for _ in range(40))
        form = looks.look(t)
        plain = t.replace("\r\n", "\n").replace("\r", "\n")
        assert form == unicodedata.normalize("NFC", unicodedata.normalize("NFD", plain).translate(table))
        assert looks.look(form) == form


def test_confusables_file(tmp_path, spark):
    path = tmp_path / "confusables.txt"
    path.write_text("# comment\n\n1D21 ;\t007A ;\tMA\t# x\n2C9E ;\t004F ;\tMA\n0031 ;\t006C ;\tMA\n2C9F ;\t004F ;\tMA\n00C6 ;\t0041 0045 ;\tMA\n", encoding="utf-8-sig")
    more = looks.confusables(str(path))
    assert more == {"\u1d21": "z", "\u2c9e": "O"}
    df = spark.createDataFrame([(1, "\u2c9een"), (2, "Oen")], "doc_id long, text string")
    assert looks.look_pairs(df).count() == 0 and looks.look_pairs(df, more=more).count() == 1
    assert [r.look for r in looks.looks(df, more=more).orderBy("doc_id").collect()] == ["Oen", "Oen"]


def test_a_hot_look(spark):
    """20,000 copies of a text and few that look the same: the pairs between different texts only, no copies among each other."""
    rows = spark.range(20_000).selectExpr("id AS doc_id", "'same text' AS text").unionByName(spark.createDataFrame([(50_000, "ѕame text"), (50_001, "ѕame text"), (50_002, "same\u200b text")], "doc_id long, text string"))
    pairs = looks.look_pairs(rows)
    assert pairs.count() == 3 * 20_000 + 2 and pairs.filter("id_a >= 50000").count() == 2


def test_look_pairs(spark):
    docs = [(1, "same"), (2, "ѕame"), (3, "same"), (4, "Same"), (5, None), (6, ""), (7, " ​"), (8, " "), (9, "sa​me"), (2, "ѕame"), (None, "same"), (10, "x" * 200_000), (11, "х" + "x" * 199_999)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("look", F.lit(1)).withColumn("raw", F.lit(1)).withColumn("id", F.lit(5))
    got = sorted(tuple(r) for r in looks.look_pairs(df).collect())
    texts = {i: t for i, t in docs if i is not None}
    form = {i: looks.look(t) for i, t in texts.items() if t and looks.look(t).strip()}
    assert got == sorted((a, b) for a in form for b in form if a < b and form[a] == form[b] and texts[a] != texts[b])
    assert {(r.id, r.class_id, r.n_texts) for r in looks.look_classes(df).collect()} >= {(1, 1, 3), (3, 1, 3), (9, 1, 3), (10, 10, 2)}
    assert looks.look_pairs(df.limit(0)).count() == 0
    assert [r.look for r in looks.looks(df.select("doc_id", "text"), fold=True).filter("doc_id in (4, 5, 6)").orderBy("doc_id").collect()] == ["same", None, ""]


# mail text

BODY = "Grüße an alle, dies ist der Text der Nachricht mit vielen Wörtern und Ende."


def mail(coding: str, charset: str, kind: str = "plain", body: str = BODY) -> str:
    data = body.encode(charset)
    if coding == "base64":
        body = base64.encodebytes(data).decode()
    elif coding == "quoted-printable":
        body = quopri.encodestring(data).decode()
    return f"From: a@b\nSubject: x\nContent-Type: text/{kind};\n charset=\"{charset}\"\nContent-Transfer-Encoding: {coding}\n\n{body}"


@pytest.mark.parametrize("coding", ["8bit", "quoted-printable", "base64"])
@pytest.mark.parametrize("charset", ["utf-8", "iso-8859-1"])
@pytest.mark.parametrize("crlf", [False, True])
def test_codings(coding, charset, crlf):
    raw = mail(coding, charset)
    assert mailtext.shown_parts(raw.replace("\n", "\r\n") if crlf else raw)[0].strip() == BODY


def test_multipart():
    inner = 'Content-Type: multipart/alternative; boundary="in"\n\n--in\nContent-Type: text/plain\n\nplain\n--in\nContent-Type: text/html\n\n<p>h<b>t</b>ml &amp; &eacute;</p><!-- no --><script>no</script>\n--in--\n'
    raw = f'From: x\nContent-Type: multipart/mixed; boundary="out"\n\npreamble\n--out\n{inner}\n--out\nContent-Type: application/pdf\nContent-Transfer-Encoding: base64\n\nQUJD\n--out\nContent-Type: message/rfc822\n\nSubject: f\n\nforwarded\n'
    got = [p.split() for p in mailtext.shown_parts(raw)]
    assert got == [["plain"], ["html", "&", "é"], ["forwarded"]]
    assert [p.strip() for p in mailtext.shown_parts("no header at all")] == ["no header at all"]
    assert mailtext.shown_parts("") in ([""], [])
    assert mailtext.shown_parts("Content-Type: multipart/mixed; boundary=x\n\nno boundary")[0] == "no boundary"


# leaks


def test_myers():
    def plain(p, t):
        col = list(range(len(p) + 1))
        best = col[-1]
        for c in t:
            new = [0]
            for j, x in enumerate(p):
                new.append(min(col[j] + (x != c), new[j] + 1, col[j + 1] + 1))
            col = new
            best = min(best, col[-1])
        return best

    rng = random.Random(1)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 90))) for _ in "pt")
        assert leaks.myers(p, t) == plain(p, t)


def test_pieces_hold_the_pigeonhole():
    for words in range(2, 30):
        for budget in range(4):
            if words + 1 < budget + 2:
                continue
            n = leaks.piece_length(words, budget)
            for start in range(3 * n):
                whole = [a for a in range(0, 200, n) if a >= start and a + n <= start + words]
                assert len(whole) >= budget + 1
    with pytest.raises(ValueError):
        leaks.piece_length(1, 1)


def test_leaks(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgéж") for _ in range(rng.randint(2, 7)))
    items = {i: [word() for _ in range(rng.randint(12, 60))] for i in range(30)}
    items[30] = items[3][:20] + [word() for _ in range(20)]  # a shared opening
    docs, want = [], set()
    noise = lambda n: " ".join(word() for _ in range(n))
    for d in range(300):
        i = rng.randint(0, 29)
        n = rng.choice([11, 12, 13, 20, 40])
        at = rng.randint(0, max(0, len(items[i]) - n))
        run = items[i][at : at + n]
        text = f"{noise(20)} {' '.join(run)} {noise(20)}"
        style = d % 6
        if style == 0:
            raw = mail("base64", "utf-8", body=text)
        elif style == 1:
            raw = mail("quoted-printable", "utf-8", body=text)
        elif style == 2:
            raw = mail("8bit", "utf-8", "html", "<html><p>" + text.replace(" ", " <i>", 1) + "</i></html>")
        elif style == 3:
            raw = "From: x\n\n" + "\n".join("> " + line for line in text.upper().split(" "))
        elif style == 4:
            raw = text.replace("a", "а").replace("e", "e​").replace(" ", ", ")
        else:
            raw = text
        docs.append((d, raw))
        for k, ws in items.items():
            ws = [looks.look(w, True) for w in ws]
            own = leaks.message_words(raw)
            grams = {tuple(own[x : x + 12]) for x in range(len(own) - 11)}
            if any(tuple(ws[x : x + 12]) in grams for x in range(len(ws) - 11)):
                want.add((d, k))
    docs += [(900, None), (901, ""), (None, docs[0][1]), docs[0]]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("run", F.lit("clash"))
    right = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()] + [(40, None), (41, "short"), (None, "x " * 20)], "item_id long, text string")
    assert len(want) > 150
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(left, right).filter("run >= 12").collect()} == want
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 120)  # joined, items cut
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(left, right).filter("run >= 12").collect()} == want
    assert leaks.find_leaks(left.limit(0), right).count() == 0 and leaks.find_leaks(left, right.limit(0)).count() == 0


def test_leak_with_an_edit(spark):
    ws = [f"word{i}x" for i in range(24)]
    near = ws[:8] + ["word8"] + ws[9:16]  # one letter less in the middle of a 12-word passage
    docs = spark.createDataFrame([(1, " ".join(near)), (2, " ".join(ws[:5] + ["other"] + ws[6:11] + ["more"]))], "doc_id long, text string")
    got = leaks.find_leaks(docs, spark.createDataFrame([(5, " ".join(ws))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.distance) for r in got] == [(1, 5, 1)] and got[0].run < 12


@pytest.mark.parametrize("edit", ["join", "letter"])
def test_an_edit_between_pieces_is_found(edit):
    ws = [f"w{i}x" for i in range(24)]
    pieces = leaks.Pieces([(5, ws)], 12, 1)
    for start in range(13):
        run = ws[start : start + 12]
        for gap in range(11):
            joined = ("" if edit == "join" else "q").join(run[gap : gap + 2])
            assert pieces.hits(["other", *run[:gap], joined, *run[gap + 2 :], "more"]).get(5, (0, 9))[1] == 1, (start, gap)


@pytest.mark.parametrize("block", [200_000, 60])
def test_every_single_edit_is_found(spark, monkeypatch, block):
    """Brute force over every edit of one character, blanks included, at every place of a passage; two edits are too many.
    By the automaton and by the join."""
    monkeypatch.setattr(leaks, "BLOCK_WORDS", block)
    rng = random.Random(5)
    ws = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    texts = []
    for start in (0, 1, 2, 3, 5, 28):
        text = " ".join(ws[start : start + 12])
        for i in range(len(text) + 1):
            texts += [text[:i] + text[i + 1 :], text[:i] + "x" + text[i + 1 :], text[:i] + "x" + text[i:], text[:i] + " " + text[i:], text[:i] + " " + text[i + 1 :]]
    texts += [" ".join(["xx" if k in (2, 9) else w for k, w in enumerate(ws[3:15])]), "qq", "", " ".join(ws)]
    docs = [(n, f"zz {t} yy") for n, t in enumerate(dict.fromkeys(texts))]
    want = set()
    for n, t in docs:
        d = min(leaks.myers(" ".join(ws[s : s + 12]), " ".join(t.split())) for s in range(len(ws) - 11))
        if d <= 1:
            want.add((n, 1, d))
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(ws))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(want) > 800
    assert max((r.run, r.doc_id) for r in got) == (40, len(docs) - 1)


def test_deep_parts():
    raw = "\n\nthe inner text"
    for n in range(300):
        raw = f'Content-Type: multipart/mixed; boundary="b{n}x"\n\n--b{n}x\n{raw}\n--b{n}x--\n'
    assert [p.strip() for p in mailtext.shown_parts(raw)] == ["the inner text"]


def test_pieces_find_all_within_the_budget():
    rng = random.Random(3)
    for trial in range(400):
        words, budget = rng.choice([(6, 1), (12, 1), (6, 2), (12, 2), (4, 0)])
        ws = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(words, 30))]
        at = rng.randint(0, len(ws) - words)
        text = " ".join(ws[at : at + words])
        for _ in range(rng.randint(0, budget + 1)):
            i = rng.randrange(len(text) + 1)
            text = text[:i] + rng.choice(["", "a", " "]) + text[i + rng.randint(0, 1) :]
        doc = ["ab", *text.split(), "fe"]
        least = min(leaks.myers(" ".join(ws[s : s + words]), " ".join(doc)) for s in range(len(ws) - words + 1))
        got = leaks.Pieces([(1, ws)], words, budget).hits(doc)
        assert ({i: d for i, (_, d) in got.items()}) == ({1: least} if least <= budget else {}), (trial, words, budget)
        for run, _ in got.values():
            assert run <= max((n for n in range(len(ws) + 1) for a in range(len(doc) - n + 1) if any(doc[a : a + n] == ws[b : b + n] for b in range(len(ws) - n + 1))), default=0)


# tokenizer


@pytest.fixture(scope="module")
def merge():
    return encode.Merger(encode.read_ranks(os.path.join(encode.TOKENIZERS, "byte_bpe_50k.tiktoken")))


def test_transducer(merge, tmp_path):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abnéing") for _ in range(rng.randint(1, 9))).encode() for _ in range(3000)})
    t = encode.Transducer.compile(words, merge)
    t.save(str(tmp_path / "t"))
    t = encode.Transducer.open(str(tmp_path / "t"))
    assert list(t.find(words)) == list(range(len(words)))
    for i in range(0, len(words), 97):
        assert list(t.ids[t.starts[i] : t.starts[i + 1]]) == merge(words[i])
    others = [w + b"z" for w in words] + [w[:-1] for w in words if w[:-1] not in set(words)] + [b"", b"\xff"]
    assert set(t.find(others)) == {-1}
    # minimal: no two states accept the same rest
    rest = {}
    arcs = {}
    for k, to in zip(t.keys.tolist(), t.target.tolist(), strict=True):
        arcs.setdefault(k >> 8, []).append((k & 255, to))

    def language(s):
        if s not in rest:
            rest[s] = (bool(t.final[s]), tuple((b, language(n)) for b, n in arcs.get(s, [])))
        return rest[s]

    forms = [language(s) for s in range(len(t.final))]
    assert len(set(forms)) == len(forms)
    assert list(encode.Transducer.compile([], merge).find([b"a"])) == [-1]


def test_encoding_is_the_tokenizers(spark, sf, merge):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(os.path.join(encode.TOKENIZERS, "byte_bpe_50k.json"))
    ref.encode_special_tokens = True
    odd = [None, "", "a", " \t\n  x", "<|endoftext|> it's We'LL 12½ ①", "日本語\U0001f600‍", "ab́ \x1c\x85y", "x" * 30_000, " " * 999, "a\0b"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)] + [(None, "null id"), (7, "again"), (7, "again")], "doc_id long, text string"))
    docs = docs.withColumn("ids", F.lit("clash"))
    got = encode.encode_corpus(docs, lexicon=encode.build_lexicon(docs, encode.read_ranks(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken"), limit=500)).collect()
    want = docs.collect()
    assert len(got) == len(want)
    texts = {r.doc_id: r.text for r in want if r.doc_id != 7}
    for r in got:
        if r.doc_id in texts and r.doc_id != 7:
            assert r.ids == ref.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
    assert encode.encode_corpus(docs.limit(0)).count() == 0


# wrong encodings


@pytest.fixture(scope="module")
def values(spark, sf):
    return spark.read.parquet(f"{os.path.dirname(sf)}/sf0.01/attr_value.parquet")


@pytest.fixture(scope="module")
def reading(values):
    return mojibake.Reading({r.pair: r.n for r in mojibake.letter_pairs(values).collect()})


def damaged(text: str, true: str, wrong: str) -> str:
    chars = mojibake._maps(wrong)[1]
    return "".join(chars[b] for b in text.encode(true))


def test_restored(values, reading):
    """Undamaged values of the table, damaged by every usual pair, come back; undamaged they stay."""
    clean = [r.value for r in values.select("value").distinct().collect() if r.value and not r.value.isascii() and mojibake.restored(r.value, reading) is None]
    clean = [t for t in clean if sum(len(w) for w in mojibake._WORD.findall(t) if not w.isascii()) >= 12]
    assert len(clean) > 500
    for true, wrong, least in [
        ("utf-8", "cp1252", 0.99), ("utf-8", "latin-1", 0.99), ("utf-8", "cp1250", 0.97), ("utf-8", "cp1251", 0.97), ("utf-8", "mac-roman", 0.97), ("utf-8", "cp437", 0.97), ("utf-8", "cp850", 0.97),
        ("cp1251", "koi8-r", 0.9), ("koi8-r", "cp1251", 0.9), ("cp1251", "cp1252", 0.9), ("cp866", "cp1251", 0.9), ("cp1253", "cp1252", 0.9), ("cp1250", "cp1252", 0.8), ("cp1252", "mac-roman", 0.8),
    ]:
        good = n = 0
        for t in clean:
            try:
                bad = damaged(t, true, wrong)
            except (UnicodeEncodeError, TypeError):
                continue
            if bad != t:
                n += 1
                good += mojibake.restored(bad, reading) == t
        assert n > 20 and good >= least * n, (true, wrong, good, n)
    twice = [damaged(damaged(t, "utf-8", "cp1252"), "utf-8", "cp1252") for t in clean[:200]]
    assert sum(mojibake.restored(x, reading) == t for x, t in zip(twice, clean, strict=False)) >= 190


@pytest.mark.parametrize("text", ["£5 – 10 €", "© Name ® 2 ™ x", "½ × ¾ ± 3°", "Â Ê Î Ô Û", "MAÇÃ E PÃO", "Сёла", "Рёбра", "├── lib", "naïve façade", "L’Œuvre", "Ñandú"])
def test_correct_text_stays(reading, text):
    assert mojibake.restored(text, reading) is None


@pytest.mark.parametrize("text", ["f�r", "fï¿½r", "Ñ�to"])
def test_lost(reading, text):
    assert mojibake.restored(text, reading) == ""


def test_mixed_text(reading):
    assert mojibake.restored("für WÃ¶rter und größe", reading) == "für Wörter und größe"


# no language of these is in the tables
OTHER_TEXTS = {
    "emoji": "Hello 😀 there 👍🏽, a → b ✓", "arabic": "يولد جميع الناس أحرارا متساوين في الكرامة", "hebrew": "כל בני האדם נולדו בני חורין", "vietnamese": "Tất cả mọi người, tiếng Việt",
    "chinese": "人人生而自由,在尊严和权利上一律平等。", "japanese": "すべての人間は、生まれながらにして自由であり、日本語の本", "korean": "모든 인간은 태어날 때부터 자유로우며", "hindi": "सभी मनुष्यों को गौरव और अधिकारों",
    "georgian": "ყველა ადამიანი იბადება თავისუფალი", "romanian": "Toate ființele umane se nasc libere și egale", "danish": "Alle mennesker er født frie og lige i værdighed, ånd", "turkish": "Bütün insanlar hür, eşit doğarlar",
    "czech": "Všichni lidé rodí se svobodní a sobě rovní", "thai": "มนุษย์ทั้งหลายเกิดมามีอิสระ", "icelandic": "Hver maður er borinn frjáls og jafn öðrum", "mixed": "Grüße 日本 und שלום an alle, naïve façade → ok",
    "finnish": "Kaikki ihmiset syntyvät vapaina ja järki", "french": "«passé…» «Été» l’été, l’Œuvre", "ukrainian": "Всі люди народжуються вільними і рівними",
}


@pytest.mark.parametrize("name", OTHER_TEXTS)
def test_other_languages(reading, name):
    """Correct texts stay, also word by word; read as cp1252, latin-1 or koi8-r they come back."""
    text = OTHER_TEXTS[name]
    assert mojibake.restored(text, reading) is None
    for wrong in ("cp1252", "latin-1", "koi8-r"):
        assert mojibake.restored(damaged(text, "utf-8", wrong), reading) == text, wrong


def test_multi_byte(reading):
    for true, wrong, text in (("big5", "latin-1", "人人生而自由"), ("gbk", "latin-1", "人人生而自由平等"), ("cp949", "latin-1", "모든 인간은 자유로우며")):
        assert mojibake.restored(text.encode(true).decode(wrong), reading) == text
    for wrong, text in (("gbk", "für Wörter"), ("cp949", "für Wörter"), ("gbk", "日本語の")):
        assert mojibake.restored(text.encode().decode(wrong), reading) == text


def test_some_words_of_another_encoding(reading):
    """A correct text in which some words were read wrongly: only they change."""
    bad = "дайте люди".encode("cp1251").decode("cp1252")
    assert mojibake.restored(f"Сёла были {bad} большие и красивые", reading) == "Сёла были дайте люди большие и красивые"


def test_damaged_many_times(reading):
    text = "Größe für Wörter"
    for _ in range(6):
        text = damaged(text, "utf-8", "cp1252")
    assert mojibake.restored(text, reading) == "Größe für Wörter"


def test_repair(spark, values):
    extra = [(-1, "GrÃ¼ÃŸe"), (-1, "GrÃ¼ÃŸe"), (-2, None), (-3, ""), (None, "GrÃ¼ÃŸe"), (-4, "plain"), (-5, "Ã©" * 50_000)]
    df = values.select("value_id", "value").unionByName(spark.createDataFrame(extra, "value_id long, value string")).withColumn("restored", F.lit("clash"))
    got = {r.value_id: r.restored for r in mojibake.repair(df).filter("value_id < 0").collect()}
    assert got == {-1: "Grüße", -5: "é" * 50_000}
    assert mojibake.repair(df.limit(0)).count() == 0
    assert mojibake.repair(spark.createDataFrame(extra[:1], "value_id long, value string")).count() == 1
