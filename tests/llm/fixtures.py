"""Small tables with every odd case, and plain statements of the rules."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHES = "rep long, h long, c long, size long, bands string, target double, lines string, shares string, kept boolean"


def rows(seed: int = 0, n: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(1, 8))) for _ in range(60)] + ["Éa", "ñu", "ß", "漢字", "😀", "A.", "x#", "|"]

    def text(k: int) -> str:
        return "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 25))) for _ in range(k))

    out = [text(rnd.randint(1, 12)) for _ in range(n)]
    passage = text(6)
    line = "This very line stands in many documents, as license lines do."
    for i in range(8):
        out[i * 3] += "\n" + ("  " if i % 2 else "") + (line if i % 3 else line.upper()) + "\t"
        out[i * 4 + 1] = out[i * 4 + 1] + "\n" + passage
    base = " ".join(rnd.choice(words) for _ in range(120))
    out += [base, base, base + " end", "start " + base, base.replace(" ", "  ", 1)]
    out += [None, "", " \n\t ", "one", "one two three four", "one", None, "....", "9 9 9", "\n\n\n", "a b " * 3000, "z" * 5000, "é" * 700 + " " + "é" * 700]
    langs, sources = ["en", "de", None], ["s1", "s0", None, "s2", "S", ""]
    return [(i, t, langs[i % 3], sources[0] if i % 3 == 0 else sources[i % 6], len(t or "")) for i, t in enumerate(out)]


def docs(spark, n: int = 60, clash: bool = False):
    data = rows(n=n)
    if clash:
        extra = (1, 2, 3, 4, "b", 0.5, "l", "s", False)
        return spark.createDataFrame([r + extra for r in data], f"{SCHEMA}, {CLASHES}").repartition(3)
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame([(r[0], int(len(r[1] or "") > 60 and (r[1] or "").count("\n") > 0), 0) for r in data] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
