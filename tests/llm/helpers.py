"""Small document tables with the odd rows that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def documents(spark, texts, schema=SCHEMA):
    """(doc_id, text) pairs as documents; ids may be null and may repeat."""
    rows = [(i, t, "en" if (i or 0) % 3 else None, f"src{(i or 0) % 4}", len(t) if t is not None else None) for i, t in texts]
    return spark.createDataFrame(rows, schema)


def odd_texts():
    return [(901, None), (902, ""), (903, " \n\t "), (904, "one"), (None, "no id " * 30), (905, "x" * 60_000), (906, "é ü あ \U0001F600 " * 50)]


def corpus(seed=1, n=40):
    """Random texts, exact copies, near copies and a passage that several texts share."""
    rng = random.Random(seed)
    texts = [(i, sentence(rng, rng.randint(30, 200))) for i in range(n)]
    passage = sentence(rng, 70)
    out = list(texts)
    for k in range(6):
        base = texts[k][1].split()
        out.append((100 + k, texts[k][1]))  # an exact copy
        base[len(base) // 2] = "changed"
        out.append((200 + k, " ".join(base)))  # a near copy
        out.append((300 + k, sentence(rng, 40) + " " + passage + "\n" + sentence(rng, 40)))
    return out, passage
