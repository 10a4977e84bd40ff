"""Small tables for the corpus operators: nulls, empty and long texts, repeats, ties, extra columns, no rows."""
import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, items string, score double, row int"


def words(rng, n, pool=400):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) if rng.random() < 0.5 else f"w{rng.randrange(pool)}" for _ in range(n))


def rows(seed=1, n=60):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.45:
            t = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 4)):
                t[rng.randrange(len(t))] = "changed" + str(rng.randrange(99))
            texts.append(" ".join(t))
        else:
            texts.append("\n".join(words(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 6))))
    texts += [None, None, "", "", " \t\n ", "one", "one two", "ONE TWO", "é ü 日本語 🙂", "x" * 9000, words(rng, 20000), "\n\n a b c d e f \n\n", "a b c d e f"]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), None if t is None else len(t), "clash", 0.5, 7) for i, t in enumerate(texts)]
    return out + [out[3], out[3], (None, texts[0], "en", "s0", 1, None, None, None), (None, None, None, None, None, None, None, None)]


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)


def plain(spark, *texts):
    return docs(spark, [(i, t, "en", "s0", None, None, None, None) for i, t in enumerate(texts)])
