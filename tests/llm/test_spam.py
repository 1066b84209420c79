import pytest

from millrace.llm import spam

SPAM = [
    "cheap fix cheap tool fix cheap tool crack fix cheap fix cheap tool fix crack cheap tool", "#fix #tool #fixleaf #crack #tool #fixroute #crack #fix", "https://a.example/x\nhttps://b.test/y?q=1\n\nhttp://c.invalid/z",
    "- [fix tool](https://a.example/1)\n- [crack](https://b.example/2)\n- [tool fix](https://c.example/3)", "size:fix-red, brand:tool-blue tag:crack-green\ncolour:tool-red tag:fix-blue", "fix tool Art.#18425 £332.00\ntool guide Ref:40317 €50.50\nguide SKU:91783 $12.00",
    "Looking for fix tool fix fix tool? We have tool fix guide fix, fix tool guide and tool fix crack. Get fix tool with tool fix today.", "比較無料道具無料\n無料比較道具\n道具無料無料比較\n比較道具無料",
    '<a href="http://a.example/x">fix tool</a><br>\n<a href="http://b.example/y" rel=nofollow>crack tool</a>',
]
CONTENT = [
    "The window counter shows 3 although the field holds 12 rows. Calling `load` twice leaves the cursor in a broken state.", "00:50 worker-2 rotate heron ok\n00:51 worker-1 drain ridge slow\n00:52 worker-2 seal plan ok\n00:53 worker-1 map tile ok",
    "def load(x):\n    return x\n\ndef save(x):\n    load(x)\n    return load(x)\n", "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n-    return tide\n+    return tile\n", "1.2.3 (2030-01-01)\n- The batch must keep its prefix. ([#12](https://a.example/1))\n- One row per page would be enough. ([#13](https://a.example/2))",
    "| field | type | meaning |\n|---|---|---|\n| a | int | The size of it. |\n| b | str | The name of it. |", "- [cursor](https://a.example/1): This page tells how the cursor is moved by the loader.\n- [batch](https://a.example/2): Here the batch is explained in short words.",
    "Похоже, буфер удаляется слишком рано. Похоже, журнал удаляется слишком рано. Похоже, шаблон удаляется слишком рано.", "¿Podéis comprobar si el campo admite 7 bytes? ¿Podéis comprobar si la clave admite 9 bytes?", "再起動の後、検査が空のままになります。再起動の後、記録が空のままになります。",
    "tests/test_a.py ......\ntests/test_b.py ..F.\ntests/test_c.py ....\n==== 1 failed, 12 passed in 3.21s ====",
]


@pytest.fixture(scope="module")
def reference(spark, data):
    """Documents from which the words of prose are learned; the pages of a test are too few for it."""
    return spark.read.parquet(f"{data}/../sf0.01/documents.parquet").select("doc_id", "text")


def test_kinds_of_pages(spark, reference):
    rows = [(i, t, "clash") for i, t in enumerate(SPAM)] + [(100 + i, t, "clash") for i, t in enumerate(CONTENT)] + [(200, None, ""), (201, "", ""), (202, " \n", ""), (None, SPAM[0], "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string")
    got = {r.doc_id for r in spam.spam_pages(df.union(df), reference).collect()}
    assert got == set(range(len(SPAM))), ([SPAM[i] for i in range(len(SPAM)) if i not in got], [CONTENT[i - 100] for i in got if i >= 100])
    assert spam.spam_pages(df.limit(0)).count() == 0


def test_by_characters(spark, reference):
    words, sentence = SPAM[0], CONTENT[0]
    df = spark.createDataFrame([(1, words + "\n" + sentence[:40] + "."), (2, words[:40] + "\n" + sentence + sentence), (3, (words + "\n") * 300)], "doc_id long, text string")
    share = {r.doc_id: r.share for r in spam.spam_shares(df, reference).collect()}
    assert share[1] > 0.5 and share[2] < 0.4 and share[3] > 0.99


UNSEEN = [
    "Nowa wersja programu poprawia odczyt danych z pliku, ale niekt\u00f3rzy u\u017cytkownicy nadal widz\u0105 b\u0142\u0119dne wyniki przy du\u017cych zbiorach. Zesp\u00f3\u0142 obieca\u0142 kolejn\u0105 poprawk\u0119 przed ko\u0144cem miesi\u0105ca.",
    "Yeni s\u00fcr\u00fcm dosyadan veri okumay\u0131 d\u00fczeltiyor ancak baz\u0131 kullan\u0131c\u0131lar b\u00fcy\u00fck k\u00fcmelerde h\u00e2l\u00e2 yanl\u0131\u015f sonu\u00e7lar g\u00f6r\u00fcyor. Ekip ay sonundan \u00f6nce yeni bir d\u00fczeltme s\u00f6z\u00fc verdi.",
    "\uc0c8 \ubc84\uc804\uc740 \ud30c\uc77c\uc5d0\uc11c \ub370\uc774\ud130\ub97c \uc77d\ub294 \ubb38\uc81c\ub97c \uace0\ucce4\uc9c0\ub9cc \uc77c\ubd80 \uc0ac\uc6a9\uc790\ub294 \uc5ec\uc804\ud788 \uc798\ubabb\ub41c \uacb0\uacfc\ub97c \ubcf4\uace0 \uc788\ub2e4. \uac1c\ubc1c\ud300\uc740 \uc774\ub2ec \ub9d0\uae4c\uc9c0 \ub2e4\ub978 \uc218\uc815\uc744 \uc57d\uc18d\ud588\ub2e4.",
    "\u65b0\u7248\u672c\u4fee\u590d\u4e86\u4ece\u6587\u4ef6\u8bfb\u53d6\u6570\u636e\u7684\u95ee\u9898\uff0c\u4f46\u4e00\u4e9b\u7528\u6237\u5728\u5904\u7406\u5927\u578b\u6570\u636e\u96c6\u65f6\u4ecd\u7136\u4f1a\u770b\u5230\u9519\u8bef\u7684\u7ed3\u679c\u3002\u56e2\u961f\u627f\u8bfa\u5728\u6708\u5e95\u4e4b\u524d\u53d1\u5e03\u53e6\u4e00\u4e2a\u4fee\u6b63\u3002",
    "De nieuwe versie herstelt het lezen van gegevens uit een bestand, maar sommige gebruikers zien bij grote verzamelingen nog steeds verkeerde uitkomsten. De ploeg heeft v\u00f3\u00f3r het einde van de maand nog een verbetering beloofd.",
    "La nuova versione corregge la lettura dei dati da un file, ma alcuni utenti vedono ancora risultati sbagliati con raccolte grandi. La squadra ha promesso un'altra correzione prima della fine del mese.",
]


def test_prose_of_unseen_languages(spark, reference):
    df = spark.createDataFrame(list(enumerate(UNSEEN)), "doc_id long, text string")
    assert all(r.share < 0.2 for r in spam.spam_shares(df, reference).collect())
    assert all(r.share < 0.2 for r in spam.spam_shares(df).collect())
