"""Documents with everything that can be odd: nulls, empty and long texts, repeats, clashing columns."""

import random

from pyspark.sql import functions as F

CLASHES = ("id", "h", "sha", "norm", "key", "range", "n", "rep", "cls", "tokens", "size", "kept", "score", "part", "g", "source_size", "taken", "uid", "rest", "v", "asks", "cell", "label", "length", "__id", "__label", "__sha", "__sha_of", "__nth", "__times", "row", "text_", "n", "again", "marked", "stays", "taken_id", "times", "nth", "of", "fine", "coarse", "q", "lot", "copy", "word", "blob", "page_num")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def clash(df):
    return df.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns})


def thue_morse(n=1024):
    """Two words of n letters that polynomial hashes modulo 2**64 cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def words(rng, n, vocabulary=400):
    return [f"{'xyzw'[k % 4]}{k}" for k in (int(vocabulary * rng.random() ** 2) for _ in range(n))]


def rows(seed=1, n=60):
    rng = random.Random(seed)
    out, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.25:
            t = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"new{rng.randint(0, 9)}"
            t = " ".join(t)
        elif texts and kind < 0.35:
            t = rng.choice(texts)
            t = t.upper() if rng.random() < 0.5 else t
        else:
            t = " ".join(words(rng, rng.randint(1, 90)))
        texts.append(t)
        out.append((i * 3, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "ß", None]), len(t)))
    odd = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a"), (1004, "Éa b\x0bc"), (1005, " ".join(words(rng, 30_000))), (None, "no id here at all"), (None, None), (1006, "12 ! ?"), (1007, "中文 字符 é")]
    out += [(i, t, None, None, None if t is None else len(t)) for i, t in odd]
    out += [(1010 + k, t, "en", "s1", len(t)) for k, t in enumerate([*thue_morse(), *thue_morse(64)])]
    out += [out[5], out[5], out[n + 3]]  # repeated rows
    return out


def documents(spark, seed=1, n=60):
    return clash(spark.createDataFrame(rows(seed, n), SCHEMA)).repartition(3)


def empty(spark):
    return clash(spark.createDataFrame([], SCHEMA))


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def split(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", fold(text))
