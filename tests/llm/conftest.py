import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "tid string, first string, spans string, key string, digest string, owner string, fp string, g string")
SF001 = "/root/testdata/sf0.001"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def messy_rows():
    """Documents with nulls, empties, a very long text, copies, near copies, shared passages, repeats, accents."""
    rng = random.Random(7)
    texts = [None, "", "   \n\t ", "x", "one two three"]
    base = [" ".join(words(rng, rng.randrange(20, 160))) for _ in range(14)]
    passage = " ".join(words(rng, 90, 100_000))
    texts += base
    texts += [base[0]] * 3 + [base[1]] * 2  # exact copies
    near = base[2].split()
    near[len(near) // 2] = "changed"
    texts.append(" ".join(near))
    texts += [f"{' '.join(words(rng, 30))} {passage} {' '.join(words(rng, 25))}" for _ in range(3)]
    texts.append("again and again \n" * 200)
    texts.append("Élève naïve ÇA l'été <|endoftext|> it'll cost 12 ½ — 你好 🙂 don't\x0bstop")
    texts.append(" ".join(words(rng, 20_000, 100_000)))
    texts.append(base[3][:200] + "\n" + base[4])
    rows = [(i, t) for i, t in enumerate(texts)]
    rows.append((None, base[5]))  # null id with a known text
    rows.append((None, None))
    rows.append((6, base[1]))  # a repeated row: same id and text as the document before
    return rows


def frame(spark, rows):
    full = [(i, t, "en", None, None if t is None else len(t)) + ("clash",) * 8 for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def messy():
    return messy_rows()


@pytest.fixture(scope="session")
def docs(spark, messy):
    from deluge.llm.common import ship
    ship(spark)
    return frame(spark, messy).cache()


@pytest.fixture(scope="session")
def empty(spark):
    from deluge.llm.common import ship
    ship(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers as P
    from tokenizers import Tokenizer
    return P.path("word_bpe_49k.json"), Tokenizer.from_file(P.path("word_bpe_49k.json"))
