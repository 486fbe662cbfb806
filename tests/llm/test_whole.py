"""The whole job: results that do not depend on sizes, and no part of the input left out."""
import pytest
from pyspark.sql import functions as F

from fairline.llm import op4_lm, op7_language, op10_toxicity

REAL = "/root/testdata/sf0.01/documents.parquet"


def test_lm_scores_do_not_depend_on_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(op4_lm, "SHARD", 20_000)
    docs = spark.read.parquet(REAL).limit(300).cache()
    train = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    near, far = op4_lm.learn(train), op4_lm.learn(train, limit=0, head=1000)
    assert near["shards"] > 1 and near["cells"] is not None and far["cells"] is None
    a, b = ({r["id"]: r["score"] for r in op4_lm.score_texts(docs, m).collect()} for m in (near, far))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-6 * abs(a[i]) for i in a)


@pytest.mark.parametrize("tail", ["", "q{}x"])
def test_long_copies_do_not_hide_toxic_words(spark, tail):
    import random
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(9))
    usual = [word() for _ in range(300)]
    long = " ".join(word() for _ in range(1500))
    say = lambda: " ".join(rng.choices(usual, k=12))                                 # noqa: E731
    rows = [(k, say() + " idiot " + say(), 1) for k in range(35)] + [(k, say(), 0) for k in range(100, 500)] + [(k, long + " " + tail.format(k), 1) for k in range(1000, 1070)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(4)
    score = op10_toxicity.scorer(op10_toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic")))
    assert score(say() + " idiot") > 0.5 and score(say()) < 0.5
    assert not tail or score(long) > 0.5                                             # copies that are all alike are one text, too few to learn from


def test_all_letters_of_a_long_run_are_read():
    for run in ("a" * 5000, "ab" * 12 + "é", "漢字かな交じり文" * 300, "ab漢字cd" * 50, "ภาษาไทย" * 50):
        pieces = op7_language.WORD.findall(run)
        assert all(len(w) <= op7_language.PIECE for w in pieces) and "".join(pieces) == "".join(c for c in run if c.isalpha())
    assert op7_language.WORD.findall("½ ² Ⅷ ٣ ①") == [] and op7_language.labeller(op7_language.train([("the cat and the dog " * 9, "en")], epochs=2))(["½ ²"])[0][0] == "und"
    assert op7_language.WORD.findall("two words, naïve 3x") == ["two", "words", "naïve", "x"]
    m = op7_language.train([("the cat and the dog of this house with that " * 5, "en"), ("der hund und die katze von dem haus mit der " * 5, "de"), ("吾輩は猫である名前はまだ無い" * 8, "ja"), ("我是一只猫还没有名字" * 8, "zh")], epochs=20)
    label = op7_language.labeller(m)
    # the middle of the run is another language than its ends
    assert label(["吾輩は猫である" + "我是一只猫还没有名字" * 100 + "吾輩は猫である"])[0][0] == "zh"
    assert label(["theandthewith" + "derhundunddiekatze" * 60 + "theandthewith"])[0][0] == "de"


def test_a_language_of_long_texts_alone_is_learned(spark):
    rows = [(k, "the cat and the dog of this house with that " * 5, "en") for k in range(5)] + [(k, "der hund und die katze von dem haus mit der " * 1000, "de") for k in range(5, 9)]
    m = op7_language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert m.labels == ["de", "en"] and op7_language.labeller(m)(["der hund und die katze"])[0][0] == "de"
