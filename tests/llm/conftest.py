import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, score double, node long, part int, rank long, length string, row string, kept boolean, h long, lang_pred string, lang_score double, tie long, nth int, block int, cluster long"
VOWELS = {"en": "the and ing ther ation of to is was ent".split(), "fr": "le la que été ère aux tion ç eau ou".split(), "de": "der und sch ung ein keit ü ß von zu".split()}


def prose(rng, lang, n):
    out = []
    for _ in range(n):
        w = "".join(rng.choice(VOWELS[lang]) for _ in range(rng.randint(1, 3)))
        out.append(w.capitalize() + "." if rng.random() < 0.1 else w)
    return " ".join(out)


def row(doc_id, text, lang=None):
    return (doc_id, text, lang, "s", 0, "w", 0.5, 1, 2, 3, "x", "y", True, 9, "z", 0.1, 1, 2, 3, 4)


@pytest.fixture(scope="session")
def texts():
    """Edge cases, prose in three languages, exact and near copies, junk."""
    rng = random.Random(5)
    rows = [row(0, None, "en"), row(1, "", "fr"), row(2, " \n\t ", None), row(3, "Solo"), row(4, "Solo"), row(4, "Solo"), row(None, "two words"), row(None, None), row(5, "1234 !!! ---"), row(6, "a  b\n\nc   d\te's 've <|endoftext|> x<|endoftext|>", "en"), row(7, "日本語のテキスト 😀 ½ é", None)]
    n = 10
    for i in range(60):
        lang = ["en", "fr", "de"][i % 3]
        text = prose(rng, lang, rng.choice([5, 12, 40, 120, 300]))
        rows.append(row(n, text, lang))
        if i % 5 == 0:
            rows.append(row(n + 1, text, lang))  # an exact copy
            words = text.split(" ")
            words[len(words) // 2] = "changed"
            rows.append(row(n + 2, " ".join(words), lang))
            words[0] = "Changed"
            rows.append(row(n + 3, " ".join(words), lang))
        n += 4
    rows.append(row(n, prose(rng, "en", 20_000), "en"))  # very long
    rows.append(row(n + 1, "x" * 5_000, "en"))  # one word
    rows.append(row(n + 2, " ".join(["again and again we say"] * 40) + "\nline a\nline a\n\nline # b|\nline a", "en"))
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(texts, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
