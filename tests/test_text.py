"""Text preparation: boilerplate removal equals Python ``re`` (IGNORECASE)
followed by ``str.strip`` on edge rows; sentence rules; ids."""
import re


from litspark.functions.text import BOILERPLATE_PATTERNS
from litspark.operators import text as T

EDGE = [
    "© 2020 Elsevier B.V. All rights reserved.",
    "Study of trade. ALL RIGHTS RESERVED and more\nNext line stays.",
    "all rights reserved here",
    "Published by Elsevier Ltd. something",
    "This is an open access article under CC BY.",
    "See doi:10.1000/xyz for data. Then more.",
    "Visit https://example.org/a?b=1 and www.example.com now.",
    "12345",
    "  42  ",
    "ABSTRACT",
    "abstract",
    "Abstract: We study markets. Keywords: trade; money",
    "Introduction. Conclusion: fine. Conclusions, References: x Reference list",
    "Acknowledgements: thanks. Acknowledgement. Funding: none.",
    "Conflict of interest statement here",
    "Author contributions: all. Author contribution text",
    "Corresponding author: me. E-mail address: a@b.c",
    "Received 12 May, Accepted 3 June",
    "preference and inference",
    "carriage\rreturn and non breaking and line separator",
    "",
]


def py_clean(s):
    return re.sub("|".join(BOILERPLATE_PATTERNS), " ", s, flags=re.IGNORECASE).strip()


def test_boilerplate_matches_python_re(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(EDGE)], "id int, text string")
    got = {r.id: r.text for r in T.strip_boilerplate(df).collect()}
    for i, s in enumerate(EDGE):
        assert got[i] == py_clean(s), (s, got[i], py_clean(s))


def test_null_text_stays_null(spark):
    df = spark.createDataFrame([(1, None)], "id int, text string")
    assert T.strip_boilerplate(df).first().text is None


def test_sentence_rules(spark):
    s30 = "a" * 29 + "."            # 30 characters: dropped
    s31 = "b" * 30 + "."            # 31 characters: kept
    text = f'{s30} {s31} Is this the third sentence here, really? "Quoted end." (Bracket end.) last'
    df = spark.createDataFrame([("c", "abstract", 7, text)], "corpus_id string, run_key string, paper_id long, text string")
    out = T.sentence_table(df).orderBy("sentence_id").collect()
    sents = [r.sentence for r in out]
    assert sents == [s31, "Is this the third sentence here, really?"]
    assert [r.sentence_id for r in out] == [7 * (1 << 20) + 1, 7 * (1 << 20) + 2]
    assert all(r.paper_id == 7 for r in out)


def test_run_text_joins_non_null_columns(spark):
    p = spark.createDataFrame([("c", 1, "Title one", "Abs one."), ("c", 2, None, "Abs two."), ("c", 3, "T3", None)],
                              "corpus_id string, paper_id long, title string, abstract string")
    got = {(r.run_key, r.paper_id): r.text for r in T.run_texts(p).collect()}
    assert got[("combined", 1)] == "Abs one. Title one"
    assert got[("combined", 2)] == "Abs two."
    assert got[("combined", 3)] == "T3"
    assert got[("abstract", 3)] == ""


def test_discover_columns():
    cols = ["Sr No", "Authors", "Title", "Full Abstract", "Abstract", "TITLE"]
    d = T.discover_columns(cols)
    assert d == {"abstract": "Full Abstract", "title": "Title"}
    assert T.discover_columns(["x"]) == {"abstract": None, "title": None}


def test_corpus_stats_counts(spark):
    p = spark.createDataFrame(
        [("c", 0, "A title that is long enough to be kept, surely.", "First sentence is long enough to keep. Tiny.", 2020),
         ("c", 1, "Short", None, 2019), ("d", 2, None, None, None)],
        "corpus_id string, paper_id long, title string, abstract string, year int")
    got = {r.corpus_id: r for r in T.corpus_stats(p).collect()}
    assert got["c"].papers == 2 and got["c"].abstract_sentences == 1 and got["c"].title_sentences == 1
    assert got["c"].years == [2019, 2020]
    assert got["d"].papers == 1 and got["d"].years == [] and got["d"].min_year is None


def test_abbreviations_do_not_split(spark):
    text = ("As shown by Smith et al. (2019) and in Fig. 2 the effect holds, e.g. for retail firms. "
            "Second sentence is long enough to keep as well.")
    df = spark.createDataFrame([("c", "abstract", 1, text)], "corpus_id string, run_key string, paper_id long, text string")
    out = [r.sentence for r in T.sentence_table(df).orderBy("sentence_id").collect()]
    assert out == ["As shown by Smith et al. (2019) and in Fig. 2 the effect holds, e.g. for retail firms.",
                   "Second sentence is long enough to keep as well."]
